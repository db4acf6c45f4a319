"""Query registry: a callable and, where SQL can say it, the equivalent DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from .tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def canonical(df: DataFrame, digits: int) -> DataFrame:
    """Doubles rounded, integers widened: the same values in every engine."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def register(name: str, oracle: str | None = None, digits: int = 4):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return canonical(fn(Tables.of(spark, sf_dir)), digits)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return wrap


def rnd(expr: str, digits: int = 4) -> str:
    """The oracle's counterpart of ``canonical`` for one double expression."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"
