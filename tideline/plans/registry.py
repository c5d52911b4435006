"""Queries by operator name, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.plans.fixtures import oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, d: str = "", i: str = "", digits: int = 6):
    """Registers a query; doubles are rounded to ``digits`` on both sides, as engines sum in other orders.

    ``sql`` may name the derived relations; ``d`` and ``i`` name its double and integer columns.
    """

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            shape = {"double": lambda c: F.round(F.col(c), digits) + F.lit(0.0), "int": lambda c: F.col(c).cast("long")}
            return df.select(*[shape[t](c).alias(c) if t in shape else F.col(c) for c, t in df.dtypes])

        QUERIES[name] = run
        if sql:
            same = [f"round(cast({c} as double), {digits}) + 0.0 AS {c}" for c in d.split()] + [f"cast({c} as bigint) AS {c}" for c in i.split()]
            replace = f" REPLACE ({', '.join(same)})" if same else ""
            ORACLE_SQL[name] = oracle(f"SELECT *{replace} FROM ({sql}) AS result")
        return f

    return add
