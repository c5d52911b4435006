"""A training-corpus pipeline: quality rules, language, near-duplicates, mixing, packing.

Each stage takes all that the one before it kept; its result is written as Parquet in the shared folder
and read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import dropped, recording, small, written
from tideline.llm.langid import label_language
from tideline.llm.mixing import mixed_documents
from tideline.llm.ngram_join import similar_documents
from tideline.llm.packing import pack
from tideline.llm.quality import judge_quality
from tideline.session import attach

#: Texts whose language has a smaller share of the words' chances are no text in a known language.
LEAST_LANGUAGE_SCORE = 0.3
#: Words of a shingle and the least similarity, in hundredths, of the near-duplicate stage.
SHINGLE, PERCENT = 5, 80
#: Doc_ids to keep or to drop, whichever are fewer, are broadcast up to so many; more are joined by shuffle.
ID_ROWS = 1_000_000

_left: list[DataFrame] = []


def _stage(body):
    """A stage that deletes what the stages before it left in the shared folder, unless its input reads it.

    Stages are applied in their order to one corpus at a time; the first one starts anew.
    """

    @wraps(body)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        attach(spark)
        if body is STAGES[0][1].__wrapped__:
            _left.clear()
        read = docs.inputFiles() if _left else []
        for table in list(_left):
            folder = table._tideline_path.split("://")[-1]
            if not any(folder in f for f in read):
                dropped(table)
                _left.remove(table)
        with recording() as made:
            out = body(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return run_stage


def _packed(docs: DataFrame) -> DataFrame:
    """What the judges read, and the whole row beside it, whatever its columns are called."""
    return docs.select("doc_id", "text", "lang", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("tideline_row"))


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what passes the base rules and the adaptive thresholds of its language and source.

    Null and empty texts and texts under 10 words go (base rules); rows are judged each, ids don't matter.
    """
    return judge_quality(_packed(docs), keep=["tideline_row"]).filter("kept").select("tideline_row.*")


@_stage
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter (also null and empty ones) or without a language that the field is sure of."""
    labelled = label_language(_packed(docs))
    return labelled.filter((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE)).select("tideline_row.*")


@_stage
def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of similar documents: the one with the least doc_id.

    Of rows that share a kept doc_id one stays. Rows without doc_id go where their group has a document
    with one, else one of them stays for the group; those without any word stay all. Ids move, not texts:
    the smaller one of the lists of ids to keep and to drop is broadcast.
    """
    found = written(similar_documents(docs, SHINGLE, PERCENT), "pipeline-groups")
    rows = found.groupBy("doc_id").agg(F.count("*").alias("m"), F.min("component_id").alias("c")).filter("doc_id is not null")
    ids = written(rows.select("doc_id", "m", (F.col("c") == F.col("doc_id")).alias("stays")), "pipeline-ids")
    keep, drop, twice = ids.filter("stays").select("doc_id"), ids.filter("not stays").select("doc_id"), ids.filter("stays and m > 1").select("doc_id")
    named = docs.filter("doc_id is not null")
    if keep.count() <= drop.count():
        out = named.join(small(keep, ID_ROWS), "doc_id", "left_semi")
    else:
        out = named.join(small(drop, ID_ROWS), "doc_id", "left_anti")
    out = out.select(*docs.columns)
    if twice.count():
        again = small(twice, ID_ROWS)
        out = out.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(named.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))
    unnamed = found.filter("doc_id is null")
    if unnamed.count():
        bare = docs.filter("doc_id is null").withColumn("text_key", F.xxhash64("text"))
        empty = unnamed.filter("n_shingles = 0").select("text_key").distinct()
        first = unnamed.filter("n_shingles > 0 and component_id is null").groupBy("group").agg(F.min("text_key").alias("text_key")).select("text_key")
        ones = bare.join(small(written(first, "pipeline-unnamed"), ID_ROWS), "text_key", "left_semi").dropDuplicates(["text_key"])
        out = out.unionByName(ones.select(*docs.columns)).unionByName(bare.join(small(written(empty, "pipeline-empty")), "text_key", "left_semi").select(*docs.columns))
    return out


@_stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources meet their target words; documents without words stay once or more."""
    return mixed_documents(docs)


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mixed documents into sequences; a row per piece. A null text is one end token."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, json_path=public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: Language ID, mixing and packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    attach(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs = written(out, f"pipeline-{k}")
        if before is not None:
            dropped(before)
        before = docs
