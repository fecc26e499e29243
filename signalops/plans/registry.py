"""Registered queries and, where SQL can state them, their independent check text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from signalops.functions.present import shown
from signalops.plans.fixtures import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] | str = ()):
    """Register ``fn(spark, sf_dir)`` under a name, with its check SQL if there is one."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, *((views,) if isinstance(views, str) else views))
        return fn
    return register


def out(df: DataFrame, keys: str = "", **digits: int) -> DataFrame:
    """Project to the shown columns: keys as they are (integers as bigint), numbers rounded."""
    types = {f.name: f.dataType for f in df.schema}

    def plain(c: str):
        small = isinstance(types[c], (T.IntegerType, T.ShortType, T.ByteType))
        return F.col(c).cast("bigint").alias(c) if small else F.col(c)

    return df.select(*[plain(c) for c in keys.split()], *[shown(c, d).alias(c) for c, d in digits.items()])
