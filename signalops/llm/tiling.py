"""Benchmark decontamination by greedy string tiling with Karp-Rabin seeds.

Texts become lower-case tokens without ASCII punctuation. Every window of ``SEED_TOKENS`` tokens has
a polynomial (Karp-Rabin) hash, rolled over the token hashes in NumPy. A document's windows pass
through a bitmap of fixed size made from the benchmark's window hashes; the survivors are joined
with the benchmark's windows on the hash, which gives the (text, item) pairs to compare. In each pair the longest run of seeds
that both sides share and that touches no marked token is marked as a tile, again and
again, until none of at least ``SEED_TOKENS`` tokens is left. Tiles may come in any order in the document, so
reordered passages count. A document is contaminated if tiles cover ``min_coverage`` of an item.

Tiles of at least s tokens that cover a share c of n tokens hold at least c * n / s of the item's windows. So the c * n / s - 1 windows of an item that
most items share may be left out of the join: a covered item still meets the text in another window, and a template of many items
does not make pairs. A pair carries the seeds of both sides, not their products: memory is linear in the two texts, whatever repeats in them.

Items under ``SEED_TOKENS`` tokens are looked for as one window of their own length; items without
tokens match nothing. Null and empty texts are clean. The verdict depends on the text alone, so
repeated rows and null ids share it. Ties between items go to the smallest item_id. An empty
documents or benchmark table gives clean or no rows. Columns of any name are ignored by ``report`` and
carried by ``keep_clean``.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from signalops.functions.lineage import cut
from signalops.llm.text import packed, text_or_empty

SEED_TOKENS, MIN_COVERAGE = 5, 0.5
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd multiplier of the rolling hash, modulo 2^64
BITMAP_BITS = 1 << 23  # one MiB, whatever the benchmark's size
_BLANK = bytes(32 if chr(i) in string.punctuation or i < 33 else i for i in range(256))


def token_hashes(text: str) -> np.ndarray:
    w = text.lower().encode().translate(_BLANK).split()
    return np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))


def window_hashes(tokens: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of every window of ``size`` tokens."""
    n = len(tokens) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h = h * BASE + tokens[j:j + n]
    return h


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20)) & np.uint64(BITMAP_BITS - 1)


def item_seeds(benchmark: DataFrame) -> DataFrame:
    """(item_id, n_tokens, size, ipos, h): the windows of every item."""
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, text in enumerate(b.column(1).to_pylist()):
                t = token_hashes(text)
                size = min(SEED_TOKENS, len(t))
                h = window_hashes(t, size) if size else np.empty(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column(0)[r].as_py()] * len(h), b.column(0).type), pa.array(np.full(len(h), len(t), np.int32)),
                     pa.array(np.full(len(h), size, np.int32)), pa.array(np.arange(len(h), dtype=np.int32)), pa.array(h.view(np.int64))],
                    ["item_id", "n_tokens", "size", "ipos", "h"])

    return benchmark.select("item_id", text_or_empty().alias("text")).mapInArrow(
        run, f"item_id {kind}, n_tokens int, size int, ipos int, h bigint")


def seeds_of(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(content, size, dpos, h): each text's windows that pass the bitmap, as arrays in one row for each size."""
    slot = F.shiftrightunsigned("h", 20).bitwiseAND(BITMAP_BITS - 1)
    words = (seeds.select(F.shiftrightunsigned(slot, 6).alias("word"), slot.bitwiseAND(63).cast("int").alias("bit"))
             .groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toPandas())  # at most BITMAP_BITS / 64 rows
    bitmap = np.zeros(BITMAP_BITS // 64, np.int64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
    sizes = sorted(r["size"] for r in seeds.select("size").distinct().collect())  # at most SEED_TOKENS
    shared = docs.sparkSession.sparkContext.broadcast((bitmap.tobytes(), sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed_bits, sizes = shared.value
        bits = np.frombuffer(packed_bits, np.uint64)
        for b in batches:
            content, kind, dpos, hashes = [], [], [], []
            for c, text in zip(b.column(0).to_pylist(), b.column(1)):
                t = token_hashes(text.as_py())
                for size in sizes:
                    h = window_hashes(t, size)
                    s = _slots(h)
                    at = np.flatnonzero(bits[s >> np.uint64(6)] >> (s & np.uint64(63)) & np.uint64(1))
                    if len(at):
                        content.append(c), kind.append(size), dpos.append(at.astype(np.int32)), hashes.append(h[at].view(np.int64))
            ends = np.cumsum([0, *map(len, dpos)]).astype(np.int32)
            flat = lambda parts, t: pa.array(np.concatenate([*parts, np.empty(0, t)]).astype(t))
            yield pa.RecordBatch.from_arrays(
                [pa.array(content, pa.int64()), pa.array(kind, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), flat(dpos, np.int32)),
                 pa.ListArray.from_arrays(pa.array(ends), flat(hashes, np.int64))], ["content", "size", "dpos", "h"])

    return docs.select(F.xxhash64(text_or_empty()).alias("content"), text_or_empty().alias("text")).mapInArrow(
        run, "content bigint, size int, dpos array<int>, h array<bigint>")


def _common(h: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and Karp-Rabin hashes of all runs of ``length`` consecutive positions in ``at``."""
    n = len(at) - length + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    whole = np.flatnonzero(at[length - 1:] - at[:n] == length - 1)
    return whole, _rolled(h, length)[whole]


def _rolled(h: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash of all windows of ``length`` by doubling: O(log length) array steps."""
    value, span, done, out = h, 1, 0, np.zeros(len(h) - length + 1, np.uint64)
    power, left = BASE, length
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                out = out * power + value[done:done + len(out)]
                done += span
            left >>= 1
            if left:
                value = value[:len(value) - span] * power + value[span:]
                span, power = 2 * span, power * power
    return out


def tile(dpos: np.ndarray, dh: np.ndarray, ipos: np.ndarray, ih: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling over two seed lists: (dpos, ipos, length) of the marked tiles, longest first, then by position.

    A match of n tokens is a run of n - size + 1 seeds. The longest run that both lists share is found by bisection over the length;
    all tiles of that length are marked before shorter ones are looked for. Seeds that a tile touches leave the lists.
    """
    tiles, most = [], len(ipos)
    keep = np.isin(dh, ih)
    dpos, dh = dpos[keep], dh[keep]
    while True:
        low, high = 0, min(most, len(ipos), len(dpos))
        while low < high:
            n = (low + high + 1) // 2
            if np.isin(_common(ih, ipos, n)[1], _common(dh, dpos, n)[1]).any():
                low = n
            else:
                high = n - 1
        if not low:
            return tiles
        starts, hashes = _common(ih, ipos, low)
        homes: dict[int, list[int]] = {}
        for i, x in zip(ipos[starts].tolist()[::-1], hashes.tolist()[::-1]):
            homes.setdefault(x, []).append(i)  # the smallest position is last
        starts, hashes = _common(dh, dpos, low)
        hit = np.isin(hashes, np.fromiter(homes, np.uint64, len(homes)))
        length, used, free_from, gone = low + size - 1, set(), -1, []
        for d, x in zip(dpos[starts[hit]].tolist(), hashes[hit].tolist()):
            if d < free_from:
                continue
            rest = homes[x]
            while rest and (rest[-1] in used or rest[-1] + length - 1 in used):
                rest.pop()  # tokens stay marked; all tiles of this round are equally long, so an end of one lies in any that overlaps it
            if rest:
                i = rest.pop()
                tiles.append((d, i, length))
                used.update(range(i, i + length))
                gone.append((d, i))
                free_from = d + length
        for d, i in gone:
            dkeep = (dpos + size <= d) | (dpos >= d + length)
            ikeep = (ipos + size <= i) | (ipos >= i + length)
            dpos, dh, ipos, ih = dpos[dkeep], dh[dkeep], ipos[ikeep], ih[ikeep]
        most = low


def _pairs(found: DataFrame, seeds: DataFrame, min_coverage: float) -> DataFrame:
    """(content, item_id, size): texts and items that share one of the item's windows, but for those that most items share."""
    rare = F.row_number().over(Window.partitionBy("item_id", "size").orderBy(F.col("n").desc(), "h"))
    distinct = seeds.select("item_id", "n_tokens", "size", "h").distinct()
    common = distinct.groupBy("size", "h").agg(F.count(F.lit(1)).alias("n"))
    # Repeats of one window inside an item count as often as they stand there.
    times = seeds.groupBy("item_id", "size", "h").agg(F.count(F.lit(1)).alias("times"))
    spare = F.ceil(F.lit(min_coverage) * F.col("n_tokens") / F.col("size")) - 1
    ranked = distinct.join(common, ["size", "h"]).join(times, ["item_id", "size", "h"]).withColumn("rank", rare)
    before = F.sum("times").over(Window.partitionBy("item_id", "size").orderBy("rank"))
    index = ranked.withColumn("past", before).where(F.col("past") > spare).select("item_id", "size", "h")
    return (found.select("content", "size", F.explode(F.array_distinct("h")).alias("h")).join(cut(index), ["size", "h"])
            .select("content", "item_id", "size").distinct())


def tilings(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(content, item_id, coverage, n_tiles, longest) for every text and item it covers by ``min_coverage``.

    Copies of a text are tiled once; a passage found in a third of all documents is spread over its texts.
    """
    seeds = cut(item_seeds(benchmark))
    found = cut(seeds_of(docs, seeds).dropDuplicates(["content", "size"]))
    items = seeds.groupBy("item_id", "n_tokens", "size").agg(F.sort_array(F.collect_list(F.struct("ipos", "h"))).alias("s")).select(
        "item_id", "n_tokens", "size", F.col("s.ipos").alias("ipos"), F.col("s.h").alias("ih"))
    pairs = _pairs(found, seeds, min_coverage).join(found, ["content", "size"]).join(items, ["item_id", "size"]).select(
        "content", "item_id", "n_tokens", "size", "dpos", "h", "ipos", "ih")
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, size = b.column(2).to_pylist(), b.column(3).to_pylist()
            cover, count, longest = [], [], []
            for r in range(b.num_rows):
                d, dh, i, ih = (b.column(c)[r].values.to_numpy(zero_copy_only=False) for c in range(4, 8))
                t = tile(d, dh.view(np.uint64), i, ih.view(np.uint64), size[r])
                cover.append(sum(x[2] for x in t) / total[r]), count.append(len(t)), longest.append(t[0][2] if t else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cover, pa.float64()), pa.array(count, pa.int32()), pa.array(longest, pa.int32())],
                                             ["content", "item_id", "coverage", "n_tiles", "longest"])

    out = pairs.mapInArrow(run, f"content bigint, item_id {kind}, coverage double, n_tiles int, longest int")
    return out.where(F.col("coverage") >= min_coverage)


def best(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Per contaminated text: the item with the highest coverage."""
    ranked = F.min(F.struct((-F.col("coverage")).alias("c"), "item_id", "n_tiles", "longest")).alias("b")
    return tilings(docs, benchmark, min_coverage).groupBy("content").agg(ranked).select(
        "content", "b.item_id", (-F.col("b.c")).alias("coverage"), "b.n_tiles", "b.longest")


def report(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per document: doc_id, contaminated, and the item with the highest coverage where one is covered."""
    found = cut(best(docs, benchmark, min_coverage))
    return (docs.select("doc_id", F.xxhash64(text_or_empty()).alias("content")).join(found, "content", "left")
            .select("doc_id", F.col("coverage").isNotNull().alias("contaminated"),
                    "item_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
                    F.coalesce("n_tiles", F.lit(0)).alias("n_tiles"), F.coalesce("longest", F.lit(0)).alias("longest_tile")))


def keep_clean(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """The documents without a covered benchmark item, with their own columns."""
    found = cut(best(docs, benchmark, min_coverage).select("content"))
    return packed(docs, F.xxhash64(text_or_empty()).alias("content")).join(found, "content", "left_anti").select("row.*")
