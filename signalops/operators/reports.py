"""Report tables: facts, exclusions, leading rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def collect_facts(sections: dict[str, DataFrame]) -> DataFrame:
    """Scalar findings of single-row section frames as one long (section, name, value) table."""
    parts = []
    for section, df in sections.items():
        cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in df.columns])
        parts.append(df.select(F.lit(section).alias("section"), F.inline(cells)))
    return reduce(DataFrame.unionByName, parts)


def exclusions(flags: DataFrame, columns: list[str]) -> DataFrame:
    return flags.where(F.col("exclude_candidate")).select(*columns)


def head_rows(df: DataFrame, order: list[str], n: int = 20) -> DataFrame:
    """First n rows in an explicit order (Spark keeps n per task, then merges)."""
    return df.orderBy(*order).limit(n)
