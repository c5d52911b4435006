"""The paged source: retries, pages, pushed filters, and tasks that take up where they were."""

import json
import os

import pytest

from tideline.sources import services as S


def test_pages_retries_filters_and_cache(spark, tmp_path):
    for t, n in (("A#1", 3), ("B", 1), ("C", 2)):
        for k in range(n):
            (tmp_path / f"{t}-{k}.json").write_text(json.dumps({"v": [t, k], "next": k + 1 < n}))
    url, cache = f"file://{tmp_path}/{{ticker}}-{{page}}.json", tmp_path / "cache"
    read = lambda **o: S.read_pages(spark, url, ["A#1", "B", "C"], pause=0.001, **o)
    got = sorted((r.ticker, r.page, *json.loads(r.body)["v"]) for r in read(drill=2, cache=cache).collect())
    assert got == [(t, k, t, k) for t, n in (("A#1", 3), ("B", 1), ("C", 2)) for k in range(n)]
    assert read().filter("ticker = 'C'").rdd.getNumPartitions() == 1
    assert sorted(r.ticker for r in read().filter("ticker in ('B', 'C')").collect()) == ["B", "C", "C"]
    with pytest.raises(Exception, match="429"):
        read(drill=9, tries=2).collect()
    for f in tmp_path.glob("C-*.json"):
        os.remove(f)
    assert read(cache=cache).filter("ticker = 'C'").count() == 2  # from what was read before
