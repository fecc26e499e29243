"""SimHash near-duplicates through covering locality-sensitive hashing.

Bit masks are built from a code: every bit position i gets a vector m(i) of r+1 bits, and every
non-zero vector v of r+1 bits gives the mask of the positions with <m(i), v> = 1 (mod 2). The
vectors of any r differing positions span at most r dimensions, so some v is orthogonal to all of
them and its mask leaves all differences out: each pair within radius r shares a bucket of at least one
of the 2^(r+1) - 1 tables. No pair within the radius is missed.

Copies share a fingerprint and are merged before bucketing. A bucket is cut into cells of at most
``CELL`` fingerprints and cell meets cell in separate tasks, so no bucket is gathered whole; a cell
pair gives back a spanning forest of its links, not all pairs.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other; texts under
three words use the whole sequence; repeated rows share the component; a null doc_id never
names a component, and a component with no other id has a null component_id; an empty table gives
no rows; further columns are ignored by ``report`` and carried by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from signalops.functions.lineage import cut
from signalops.llm.graph import components
from signalops.llm.text import keep_columns, text_or_empty

SHINGLE, SEED, RADIUS, CELL, SMALL = 3, 42, 3, 512, 24


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The 2^(radius+1) - 1 masks as unsigned integers; positions cycle through the non-zero vectors."""
    top = 1 << (radius + 1)
    vec = [1 + i % (top - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vec[i] & v).bit_count() % 2) for v in range(1, top)]


def shingle_hashes(text: str, size: int = SHINGLE) -> list[int]:
    """XXH64 of every window of ``size`` words; of the whole sequence if it is shorter."""
    w = text.encode().lower().split()
    if not w:
        return []
    joined = b" ".join(w)
    stop = np.cumsum(np.fromiter(map(len, w), np.int64, len(w))) + np.arange(len(w))
    if len(w) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    start = np.concatenate(([0], stop[:-size] + 1)).tolist()
    h = xxhash.xxh64_intdigest
    return [h(joined[a:b], SEED) for a, b in zip(start, stop[size - 1:].tolist())]


def fingerprint(text: str | None) -> int:
    """64 bits; a bit is set if it is set in over half of the shingle hashes."""
    h = shingle_hashes(text or "")
    if not h:
        return 0
    ones = np.zeros(64, np.int64)
    a = np.array(h, dtype="<u8")
    for i in range(0, len(a), 65536):  # bounded memory for very long texts
        ones += np.unpackbits(a[i:i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long; one Arrow pass, no shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py()) for t in b.column(1)], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def _forest(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the pairs (x, y) within the radius, found breadth first."""
    near = np.bitwise_count(x[:, None] ^ y[None, :]) <= radius
    a, b, fresh_x, fresh_y = [], [], np.ones(len(x), bool), np.ones(len(y), bool)
    for s in range(len(x)):
        queue = [s] if fresh_x[s] else []
        fresh_x[s] = False
        while queue:
            i = queue.pop()
            for j in np.flatnonzero(near[i] & fresh_y):
                fresh_y[j] = False
                a.append(i), b.append(j)
                more = np.flatnonzero(near[:, j] & fresh_x)
                fresh_x[more] = False
                a += more.tolist()
                b += [j] * len(more)
                queue += more.tolist()
    return x.view(np.int64)[np.array(a, np.intp)], y.view(np.int64)[np.array(b, np.intp)]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): pairs of distinct fingerprints within the radius that connect all such pairs.

    Buckets of up to ``SMALL`` fingerprints are compared inside one row with SQL functions; larger
    ones as cell pairs in NumPy.
    """
    table = F.explode(F.transform(F.array(*[F.lit(m if m < 2**63 else m - 2**64) for m in masks(radius)]),
                                  lambda m: F.struct(m.alias("m"), F.col("fp").bitwiseAND(m).alias("k"))))
    dealt = fps.select("fp", table.alias("t")).select("t.m", "t.k", "fp")
    sizes = cut(dealt.groupBy("m", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    crowded = dealt.join(sizes, ["m", "k"])
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= radius
    small = (crowded.where(F.col("n") <= SMALL).groupBy("m", "k").agg(F.sort_array(F.collect_list("fp")).alias("g"))
             .select(F.explode(F.flatten(F.transform("g", lambda x: F.transform(
                 F.filter("g", lambda y: (y > x) & near(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("e"))
             .select("e.a", "e.b"))
    cells = F.ceil(F.col("n") / CELL).cast("int")
    big = crowded.where(F.col("n") > SMALL).withColumn("k_cells", cells).withColumn("c", F.pmod(F.xxhash64("fp"), "k_cells").cast("int"))
    paired = big.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("k_cells") - 1))).select(
        "m", "k", F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j"), "c", "fp")

    def meet(pdf):
        i, j = pdf["i"].iat[0], pdf["j"].iat[0]
        f, c = pdf["fp"].to_numpy(), pdf["c"].to_numpy()
        a, b = _forest(f[c == i].view(np.uint64), f[c == j].view(np.uint64), radius)
        keep = a != b
        return type(pdf)({"a": a[keep], "b": b[keep]})

    return small.union(paired.groupBy("m", "k", "i", "j").applyInPandas(meet, "a bigint, b bigint")).distinct()


def report(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links)."""
    each = cut(fingerprints(docs))
    fps = cut(each.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(fps.select("fp"), radius))
    named = (fps.join(roots, fps["fp"] == roots["node"], "left")
             .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    first = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = cut(named.join(first, "root").select("fp", "component_id"))
    return each.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with its own columns.

    Rows with a null doc_id are kept. Rows that repeat a kept doc_id are reduced to one.
    """
    r = cut(report(docs, radius))
    gone = cut(r.where("doc_id <> component_id").select("doc_id").distinct())
    twice = cut(r.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null").select("doc_id"))
    left = docs.join(gone, "doc_id", "left_anti")
    single = left.join(twice, "doc_id", "left_anti")
    repeated = left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return keep_columns(single, docs).union(keep_columns(repeated, docs))
