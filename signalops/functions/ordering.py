"""Ranks and exact quantiles that never sort a whole group in one task.

A plain ``row_number() over (partition by key order by x)`` sends every row of a key to one
task. Here the order range is first cut into buckets: the rows of (key, bucket) are ranked
locally and shifted by the number of rows in earlier buckets, which comes from a small
pre-aggregated count table. A key holding a third of the data is spread over all its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from signalops.functions.lineage import cut


def minute_bucket(ts: str) -> Column:
    """Order-preserving bucket of a timestamp: minutes since the epoch."""
    return (F.unix_date(F.to_date(ts)).cast("bigint") * 24 + F.hour(ts)) * 60 + F.minute(ts)


def bucket_count(df: DataFrame) -> int:
    """Buckets per key: a few per shuffle partition, so a hot key still fills the cluster."""
    return max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def bucketed_row_number(df: DataFrame, keys: list[str], order: list[str], bucket: Column,
                        name: str = "rn") -> DataFrame:
    """Add a 1-based row number within ``keys``; ``bucket`` must be monotone in ``order``."""
    b = "__bucket"
    tagged = df.withColumn(b, bucket)
    sizes = tagged.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*keys).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, b, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    local = W.partitionBy(*keys, b).orderBy(*order)
    ranked = tagged.withColumn("__local", F.row_number().over(local))
    return (ranked.join(offsets, [*keys, b])
            .withColumn(name, (F.col("__local") + F.col("__off")).cast("bigint"))
            .drop(b, "__local", "__off"))


def hash_row_number(df: DataFrame, keys: list[str], hash_col: str, tie: str, buckets: int | None = None,
                    modulus: int = 2147483647, name: str = "rn") -> DataFrame:
    """Row number in hash order; hash values are uniform, so equal-width buckets are even."""
    width = modulus // (buckets or bucket_count(df)) + 1
    return bucketed_row_number(df, keys, [hash_col, tie], F.floor(F.col(hash_col) / F.lit(width)), name)


def _edge_table(counts: DataFrame, key: str, value: str, buckets: int, fan: int = 64) -> DataFrame:
    """(key, coarse, fine): approximate quantile edges per key, every ``fan``-th in coarse and the spans between them in fine.

    One row per key, joined on the key: the plan does not grow with keys or edges and nothing
    reaches the driver.
    """
    edges = counts.groupBy(key).agg(F.percentile_approx(value, F.array(*[F.lit(i / buckets) for i in range(1, buckets)]),
                                                        F.lit(max(1000, 4 * buckets))).alias("e"))
    e = F.array_sort(F.array_distinct(F.coalesce("e", F.array().cast("array<double>"))))
    return edges.select(key, e.cast("array<double>").alias("e")).select(
        key, F.transform(F.sequence(F.lit(0), F.floor(F.size("e") / fan).cast("int")), lambda i: F.slice("e", i * fan + 1, fan)).alias("__fine")
    ).select(key, "__fine", F.transform(F.filter("__fine", lambda s: F.size(s) == fan), lambda s: s[fan - 1]).alias("__coarse"))


def _bucket_of(value: str, fan: int = 64) -> Column:
    """Bucket number of a value from the joined edges: the span first, then the place inside it."""
    below = lambda arr: F.size(F.filter(arr, lambda x: x < F.col(value)))
    c = below(F.col("__coarse"))
    return c * fan + F.greatest(below(F.get(F.col("__fine"), c)), F.lit(0))


def value_positions(df: DataFrame, key: str, value: str, buckets: int | None = None, parts: dict[str, Column] | None = None) -> DataFrame:
    """Distinct values of each key with ``n`` copies, ``below`` smaller rows and ``total`` rows; for each of ``parts`` (name: condition) the same
    of its rows, as ``n_name``, ``below_name`` and ``total_name``.

    ``key`` is one column, a struct for several. Ties are reduced on the map side
    and the distinct values are written once, so the input is read in a single pass. The bucket
    edges only steer the layout and do not change the result.
    """
    parts = parts or {}
    names = ["", *[f"_{p}" for p in parts]]
    counts = cut(df.where(F.col(value).isNotNull()).groupBy(key, value).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(f"n_{p}") for p, c in parts.items()]))
    edges = _edge_table(counts, key, value, buckets or min(4096, bucket_count(df)))
    counts = counts.join(edges, key).withColumn("__b", _bucket_of(value)).drop("__coarse", "__fine")
    sizes = counts.groupBy(key, "__b").agg(*[F.sum(f"n{x}").alias(f"__bn{x}") for x in names])
    whole = W.partitionBy(key)
    earlier = whole.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        key, "__b", *[F.coalesce(F.sum(f"__bn{x}").over(earlier), F.lit(0)).alias(f"__off{x}") for x in names],
        *[F.sum(f"__bn{x}").over(whole).alias(f"total{x}") for x in names])
    local = W.partitionBy(key, "__b").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    inside = counts.withColumns({f"__loc{x}": F.coalesce(F.sum(f"n{x}").over(local), F.lit(0)) for x in names})
    return inside.join(offsets, [key, "__b"]).select(
        key, value, *[c for x in names for c in (F.col(f"n{x}"), (F.col(f"__off{x}") + F.col(f"__loc{x}")).alias(f"below{x}"), F.col(f"total{x}"))])


def complement_medians(df: DataFrame, key: str, value: str, fold: str, folds: int) -> DataFrame:
    """(key, medians): exact medians over all rows but those of fold 0, 1, ..., and last over all rows.

    Each distinct value knows its place among all rows and among those of each fold, so the place outside a fold is
    the difference of the two; nothing is sorted once more for a fold.
    """
    pos = value_positions(df, key, value, parts={str(f): F.col(fold) == f for f in range(folds)})
    minus = lambda c, f: F.col(c) - F.col(f"{c}_{f}") if f < folds else F.col(c)

    def at(f: int, up: bool) -> Column:
        half = (minus("total", f) - 1) / 2
        index = F.ceil(half) if up else F.floor(half)
        hit = (minus("below", f) <= index) & (index < minus("below", f) + minus("n", f))
        return F.max(F.when(hit, F.col(value)))

    return pos.groupBy(key).agg(F.array(*[(at(f, False) + at(f, True)) / 2 for f in range(folds + 1)]).alias("medians"))


def average_rank_pct(df: DataFrame, key: str, value: str, buckets: int | None = None) -> DataFrame:
    """Percentile in sample with average ties, per distinct value of each key."""
    return (value_positions(df, key, value, buckets)
            .withColumn("pct_rank", (F.col("below") + (F.col("n") + 1) / 2.0) / F.col("total")))


def exact_quantiles(df: DataFrame, key: str, value: str, probs: dict[str, float], buckets: int | None = None) -> DataFrame:
    """Linear-interpolation quantiles per key, one column per entry of ``probs``."""
    pos = value_positions(df, key, value, buckets)

    def at(index: Column) -> Column:
        inside = (F.col("below") <= index) & (index < F.col("below") + F.col("n"))
        return F.max(F.when(inside, F.col(value)))

    aggs, outs = [], []
    for name, p in probs.items():
        h = (F.col("total") - 1) * F.lit(float(p))
        aggs += [at(F.floor(h)).alias(f"__lo_{name}"), at(F.ceil(h)).alias(f"__hi_{name}")]
        frac = (F.col("__total") - 1) * F.lit(float(p)) - F.floor((F.col("__total") - 1) * F.lit(float(p)))
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        outs.append((lo + frac * (hi - lo)).alias(name))
    return pos.groupBy(key).agg(F.max("total").alias("__total"), *aggs).select(key, *outs)
