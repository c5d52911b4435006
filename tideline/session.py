"""Sessions, and shipping of the package to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def session(name: str = "tideline", **options: str) -> SparkSession:
    """A session with the settings that the library relies on: UTC, adaptive plans, Arrow."""
    build = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    build = build.config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for key, value in options.items():
        build = build.config(key.replace("__", "."), value)
    return build.getOrCreate()


#: Rows of an Arrow batch: documents are long, and a batch lies in the JVM and in Python at once.
BATCH_ROWS = "1000"


def attach(spark: SparkSession) -> SparkSession:
    """Makes the package importable in Python workers where PYTHONPATH doesn't do that already.

    Arrow batches get BATCH_ROWS rows at most unless the session sets a size of its own.
    """
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(":") or getattr(context, "_tideline", False):
        return spark
    path = Path(tempfile.mkdtemp(prefix="tideline-")) / "tideline.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((ROOT / "tideline").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    context.addPyFile(str(path))
    context._tideline = True
    return spark
