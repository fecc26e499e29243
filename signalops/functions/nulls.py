"""Missing-value rules shared by every operator: missing is NULL, never NaN."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Guard added inside logarithms and ratio denominators (fixed value).
EPS = 1e-10


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Turn NaN into NULL once, at the source, for the float columns."""
    names = cols or [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in names})


def to_number(c: str | Column) -> Column:
    """Lenient numeric parse: unparseable and NaN become NULL."""
    return F.nanvl(col(c).try_cast("double"), F.lit(None).cast("double"))


def safe_div(num: str | Column, den: str | Column) -> Column:
    return col(num) / F.nullif(col(den), F.lit(0))


def log_guard(c: str | Column) -> Column:
    x = col(c) + F.lit(EPS)
    return F.when(x > 0, F.ln(x))


def add_all(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def row_mean(cols: list[str | Column]) -> Column:
    """Mean over the non-missing values of one row; NULL when all are missing."""
    cs = [col(c) for c in cols]
    total = add_all([F.coalesce(c, F.lit(0.0)) for c in cs])
    count = add_all([c.isNotNull().cast("int") for c in cs])
    return total / F.nullif(count, F.lit(0))


def corr_agg(x: str | Column, y: str | Column) -> Column:
    """Pearson r over pairwise-complete rows; NULL (not an error) when a side has no variance."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    sd = F.stddev_samp(F.when(both, x)) * F.stddev_samp(F.when(both, y))
    return F.covar_samp(x, y) / F.nullif(sd, F.lit(0.0))


def spearman_brown(r: Column) -> Column:
    return 2 * r / F.nullif(1 + r, F.lit(0.0))


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Fail before any job runs when a required column is absent."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def keep_columns(df: DataFrame, keep: list[str], rename: dict[str, str] | None = None) -> DataFrame:
    """Whitelist projection; names that are absent are skipped."""
    for old, new in (rename or {}).items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df.select([c for c in keep if c in df.columns])
