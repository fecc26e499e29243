"""Sharding by a k-d tree: cuts at distributed weighted medians along the widest metadata dimension.

The unit of the tree is a group of equal texts, weighing its rows' bytes, at the coordinates of its metadata (source, language, size,
each on a scale of 2^28). A node that stands for k shards is cut along the dimension in which its units spread widest: the first
half of its shards gets the units up to the weighted median (the weighted k-quantile if k is odd), cut at the border of two units
nearest to it, so shards have nearly equal bytes. Medians come from running totals over ranges of (node, coordinate, text hash),
all nodes of a depth at once; nothing but one row a node is small enough to be broadcast, and is.

A group above ``SLACK`` of a shard's bytes is cut into parts of about that size in the order of doc_id, so one text with a third of all rows does
not unbalance the shards; there are at most shards / SLACK such groups. The parts stay neighbours, so only a group that a median meets is spread.

Defined cases: null and empty texts are one group of size 1 a row; null source or language has coordinate 0, and a group takes the least value of
its rows; repeated rows and null ids each get a slot; ties go by text hash, then part; a table of fewer groups than shards leaves shards empty;
an empty table gives no rows; further columns are ignored by ``report`` and carried by ``write``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from signalops.functions.lineage import cut
from signalops.llm.ranks import running
from signalops.llm.text import text_or_empty

SHARDS, SLACK, SCALE = 8, 0.01, 1 << 28
DIMS = ("x_source", "x_lang", "x_size")


def narrow(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """One narrow row per document: r (row number), doc_id, size, crc, h (hash of the text), source, lang."""
    t = text_or_empty()
    return docs.select((F.monotonically_increasing_id() if row is None else row).alias("r"), F.col("doc_id"),
                       (F.octet_length(t) + 1).cast("bigint").alias("size"), F.crc32(t.cast("binary")).alias("crc"), F.md5(t.cast("binary")).alias("h"),
                       F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))


def _coordinate(name: Column) -> Column:
    return F.coalesce(F.conv(F.substring(F.md5(name.cast("binary")), 1, 7), 16, 10).cast("bigint"), F.lit(0))


def groups_of(base: DataFrame) -> DataFrame:
    """h, w (bytes), n (rows) and coordinates: one row per distinct text, reduced on the map side."""
    g = cut(base.groupBy("h").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"), F.min("source").alias("source"),
                                  F.min("lang").alias("lang"), F.min("size").alias("size")))
    low, high = g.agg(F.min("size"), F.max("size")).first()
    low, high = low or 0, high or 0
    return g.select("h", "w", "n", _coordinate(F.col("source")).alias("x_source"), _coordinate(F.col("lang")).alias("x_lang"),
                    F.floor((F.col("size") - low) * SCALE / (high - low + 1)).alias("x_size"))


def split_nodes(units: DataFrame, shards: int) -> DataFrame:
    """Units (h, part, w, coordinates) with ``shard``. As many rounds as the tree is deep, one sort by ranges each."""
    u = units.withColumn("shard", F.lit(0).cast("bigint")).withColumn("k", F.lit(shards).cast("bigint"))
    width = shards
    while width > 1:
        spread = [(F.max(d) - F.min(d)).alias(d) for d in DIMS]
        nodes = u.groupBy("shard", "k").agg(F.sum("w").alias("total"), *spread)
        widest = F.greatest(*DIMS)
        dim = F.coalesce(*[F.when(F.col(d) == widest, F.lit(d)) for d in DIMS])
        nodes = cut(nodes.select("shard", "k", "total", dim.alias("dim")))
        at = F.coalesce(*[F.when(F.col("dim") == d, F.col(d)) for d in DIMS])
        u = u.join(F.broadcast(nodes), ["shard", "k"]).withColumn("at", at)
        u = running(cut(u), "shard", ["at", "h", "part"], "w", "before")
        left = F.ceil(F.col("k") / 2)
        is_left = (2 * F.col("before") + F.col("w")) * F.col("k") < 2 * F.col("total") * left
        u = u.select("h", "part", "w", *DIMS, F.when(is_left, F.col("shard")).otherwise(F.col("shard") + left).alias("shard"),
                     F.when(is_left, left).otherwise(F.greatest(F.col("k") - left, F.lit(1))).alias("k"))
        width = -(-width // 2)
    return u.select("h", "part", "shard")


def assign(base: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None, slack: float = SLACK) -> DataFrame:
    """r, doc_id, size, crc, shard, slot for a stored table of ``narrow`` rows; ``shards`` or as many as reach ``target_bytes``."""
    groups = cut(groups_of(base))
    total = groups.agg(F.sum("w")).first()[0] or 0
    shards = shards or max(1, -(-total // target_bytes))
    limit = max(1, int(total * slack / shards))
    big = cut(groups.where((F.col("w") > limit) & (F.col("n") > 1)).withColumn("parts", F.least("n", F.ceil(F.col("w") / limit))))
    small = groups.join(F.broadcast(big.select("h")), "h", "left_anti")
    placed = running(cut(base.join(F.broadcast(big.select("h", "n", "parts")), "h")), "h", ["doc_id", "r"])
    placed = cut(placed.select("r", "doc_id", "size", "crc", "h", F.floor(F.col("pos") * F.col("parts") / F.col("n")).alias("part")))
    pieces = placed.groupBy("h", "part").agg(F.sum("size").alias("w")).join(F.broadcast(big.select("h", *DIMS)), "h")
    columns = ["h", "part", "w", *DIMS]
    units = small.withColumn("part", F.lit(0).cast("bigint")).select(columns).union(pieces.select(columns))
    units = cut(split_nodes(cut(units), shards))
    whole = units.join(F.broadcast(big.select("h")), "h", "left_anti")
    parted = cut(units.join(F.broadcast(big.select("h")), "h"))  # at most two parts for each ``limit`` bytes
    out = ["r", "doc_id", "size", "crc", "shard"]
    rows = base.join(F.broadcast(big.select("h")), "h", "left_anti").join(whole, "h").select(out).union(
        placed.join(F.broadcast(parted), ["h", "part"]).select(out))
    return running(cut(rows), "shard", ["doc_id", "r"], name="slot")


def report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: bytes are the law)."""
    return assign(cut(narrow(docs)), **options).select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        "slot", F.lit(None).cast("int").alias("grown_shard"))


def write(docs: DataFrame, path: str, per_file: int = 1 << 16, **options) -> None:
    """Write the documents with their own columns as Parquet under ``path``, one folder ``__shard=N`` a shard.

    Files hold ``per_file`` consecutive slots, so a shard is written by many tasks and read in the order of its slots.
    """
    staged = cut(docs.withColumn("__row", F.monotonically_increasing_id()))
    at = assign(cut(narrow(staged, F.col("__row"))), **options).select(F.col("r").alias("__row"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    (staged.join(at, "__row").withColumn("__file", F.floor(F.col("__slot") / per_file)).repartition("__shard", "__file")
     .sortWithinPartitions("__shard", "__slot").drop("__row", "__file").write.partitionBy("__shard").parquet(path))
