"""Merkle manifest of a dataset on concatenated-level strings, in SQL functions.

A row's leaf is the SHA-256 (lowercase hex) of its fields. The leaves of a group (``lang``) in the order of ``doc_id`` are cut
into aligned blocks of ARITY ** HEIGHT. A block keeps each of its levels as one string of digests of 64 digits: substrings of
ARITY digests hash to the next level, the substrings that flank a node are its siblings. The digests on top of the blocks are
the leaves of the next tier, up to one digest a group, the subroot; the subroots form a last tree of the same kind. Paths
are joined downwards to blocks, one row each, and only then opened into rows, so no group is in one task and no path is shuffled.

Defined cases: a null field enters as ``-``, any other as its byte count, ``:`` and itself; a null group is one of its own, before all
others; null ids come first; rows of one id go by their leaf, and repeated rows stand beside one another with one
path each; a group of one row is its own subroot; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from signalops.functions.lineage import cut
from signalops.llm.ranks import running

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY, HEIGHT, DIGITS = 2, 8, 64


def field(value: Column) -> Column:
    s = value.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def depth(n: Column) -> Column:
    """Levels above n leaves: the least l with ARITY ** l >= n."""
    return sum((F.when(n > ARITY**e, 1).otherwise(0) for e in range(63) if ARITY**e < 2**62), F.lit(0))


def _upwards(level: Column) -> Column:
    """The next level of a block: every ARITY digests, the last run perhaps fewer, become one."""
    wide = DIGITS * ARITY
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / wide).cast("int"))
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(level, i * wide + 1, F.lit(wide)), 256)), "")


def _flanks(levels: Column, at: Column, steps: Column) -> Column:
    """(left, right) strings of the siblings of item ``at`` of a block, for each of its levels."""
    def siblings(e: Column) -> Column:
        level, i = F.get(levels, e["level"]), F.floor(at / e["size"]).cast("int")
        inside = i % ARITY
        return F.struct(F.substring(level, (i - inside) * DIGITS + 1, inside * DIGITS).alias("left"),
                        F.substring(level, (i + 1) * DIGITS + 1, (ARITY - 1 - inside) * DIGITS).alias("right"))
    sizes = F.array(*[F.struct(F.lit(e).alias("level"), F.lit(ARITY**e).alias("size")) for e in range(HEIGHT)])
    return F.transform(F.slice(sizes, F.lit(1), steps), siblings)


def climb(nodes: DataFrame) -> list[DataFrame]:
    """The tiers of the trees over ``nodes`` (g, pos, node, row): stored tables of blocks (g, block, rows, levels, steps, top).

    As many passes as the largest tree has tiers; each holds a share of about ARITY ** -HEIGHT of the one before.
    """
    sizes, tiers = cut(nodes.groupBy("g").agg(F.count(F.lit(1)).alias("n"))), []
    most = sizes.agg(F.max("n")).first()[0] or 0
    while True:
        rows = F.sort_array(F.collect_list(F.struct("pos", "node", "row"))).alias("rows")
        b = (nodes.groupBy("g", F.floor(F.col("pos") / ARITY**HEIGHT).alias("block")).agg(rows).join(sizes, "g")
             .withColumn("steps", F.least(F.lit(HEIGHT), depth(F.col("n"))))
             .withColumn("level", F.array_join("rows.node", "")))
        levels = F.aggregate(F.slice(F.array(*map(F.lit, range(HEIGHT))), F.lit(1), F.col("steps")), F.array("level"),
                             lambda found, _: F.concat(found, F.array(_upwards(F.element_at(found, -1)))))
        b = cut(b.withColumn("levels", levels).select("g", "block", "rows", "levels", "steps", F.element_at("levels", -1).alias("top")))
        tiers.append(b)
        if most <= ARITY**HEIGHT:
            return tiers
        nodes = b.select("g", F.col("block").alias("pos"), F.col("top").alias("node"), F.lit(None).cast("string").alias("row"))
        up = lambda n: F.ceil(n / ARITY**HEIGHT)
        sizes, most = sizes.select("g", up(F.col("n")).alias("n")), -(-most // ARITY**HEIGHT)


def descend(tiers: list[DataFrame], upper: DataFrame) -> DataFrame:
    """Rows of the lowest tier (g, pos, node, row) with ``path`` and the further columns of ``upper`` (g, block, path, ...)."""
    for k, b in reversed(list(enumerate(tiers))):
        more = [c for c in upper.columns if c not in ("g", "block", "path")]
        opened = (b.join(upper.withColumnRenamed("path", "above"), ["g", "block"])
                  .select("g", "levels", "steps", "above", *more, F.posexplode("rows").alias("at", "item"))
                  .select("g", "item.pos", "item.node", "item.row", *more, F.concat(_flanks(F.col("levels"), F.col("at"), F.col("steps")), "above").alias("path")))
        if k:
            opened = cut(opened.select("g", F.col("pos").alias("block"), *more, "path"))
        upper = opened
    return upper


def _no_path() -> Column:
    return F.array().cast("array<struct<left:string,right:string>>")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf leads to along its siblings."""
    return F.aggregate(path, start, lambda x, s: F.sha2(F.concat(s["left"], x, s["right"]), 256))


def proof(path: Column) -> Column:
    """SHA-256 of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(docs: DataFrame, offered: Column | None = None) -> DataFrame:
    """One row per document: doc_id, lang, pos, leaf, subroot, root, path (siblings from the leaf to the root) and ``offered``.

    ``offered`` is a further digest over columns of ``docs`` that is carried along, to be held against the root.
    """
    d = docs.select(F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("g"), "doc_id",
                    leaf([F.col(c) for c in FIELDS]).alias("node"),
                    (F.lit(None) if offered is None else offered).cast("string").alias("offered"), F.monotonically_increasing_id().alias("r"))
    leaves = running(cut(d), "g", ["doc_id", "node", "r"]).select("g", "pos", "node", F.struct("doc_id", "offered").alias("row"))
    tiers = climb(leaves)
    tops = cut(tiers[-1].select(F.lit("").alias("all"), "g", F.col("top").alias("subroot")))
    groups = climb(running(tops, "all", ["g"]).select(F.col("all").alias("g"), "pos", F.col("subroot").alias("node"), F.struct("g").alias("row")))
    root = groups[-1].select("g", "block", _no_path().alias("path"), F.col("top").alias("root"))
    above = descend(groups, root).select(F.col("row.g").alias("g"), F.lit(0).cast("bigint").alias("block"), F.col("node").alias("subroot"), "root", "path")
    return descend(tiers, cut(above)).select(
        "row.doc_id", F.when(F.col("g") != "", F.expr("substring(g, 2)")).alias("lang"), "pos", F.col("node").alias("leaf"), "row.offered", "subroot", "root", "path")


def report(docs: DataFrame, every: int = 7) -> DataFrame:
    """Manifest digests of every document, and what comes of ``n_chars`` plus one where ``every`` divides crc32 of the id."""
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    m = manifest(docs, F.when(hit, leaf(changed)))
    return (m.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"),
                     folded(F.coalesce("offered", "leaf"), F.col("path")).alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))
