"""Hashed text features and a logistic model over them; counting and scoring are single Arrow passes.

A text becomes the set of its hashed byte n-grams (lower case, one space for any run of ASCII
characters other than letters). Presence counts, not frequency, so a long text is not drowned by its
common words. N-grams whose class log ratio tells nothing are dropped; the others enter scaled by their
log ratio, shrunk where few documents hold them, and normalised to length one, and a logistic layer
weighs them. All of it is fitted on a bounded sample of labelled rows, picked by id before any text is touched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from signalops.functions.lineage import cut

D = 1 << 18
GRAMS = (5, 7)
SLICE = 4096
HELD = 1 << 20
_LUT = np.array([i if i >= 128 or 97 <= i <= 122 else 32 for i in range(256)], np.uint8)
_CHUNK = 1 << 20


def letters(text: str) -> np.ndarray:
    """Lower-case UTF-8 bytes with single spaces for everything that is no letter, padded by spaces."""
    b = _LUT[np.frombuffer(b" " + text.lower().encode(errors="replace") + b" ", np.uint8)]
    gap = b == 32
    return b[np.concatenate(([True], ~(gap[1:] & gap[:-1])))]


def gram_ids(b: np.ndarray, grams: tuple[int, ...], buckets: int) -> Iterator[np.ndarray]:
    """Hashed ids of all windows, one array for each size; sizes ascend and share the rolling hash."""
    h, done = np.zeros(len(b), np.uint32), 0
    for n in grams:
        m = len(b) - n + 1
        if m <= 0:
            return
        h = h[:m]
        for j in range(done, n):
            h = h * np.uint32(0x01000193) + b[j:j + m]
        done = n
        x = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        yield (x >> np.uint32(13)) & np.uint32(buckets - 1)


def feature_set(text: str | None, mark: np.ndarray, grams: tuple[int, ...] = GRAMS) -> np.ndarray:
    """Distinct ids of the text's n-grams. ``mark``: an all-false array of the bucket count, left all false."""
    b = letters(text or "")
    for lo in range(0, len(b), _CHUNK):
        for ids in gram_ids(b[lo:lo + _CHUNK + grams[-1] - 1], grams, len(mark)):
            mark[ids.astype(np.intp)] = True
    eight = mark.view(np.uint64)  # most marks are unset: those of eight ids at a time
    groups = np.flatnonzero(eight != 0)
    near = np.flatnonzero(eight[groups].view(bool))
    found = (groups[near >> 3] << 3) + (near & 7)
    mark[found] = False
    return found


def class_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(2, D) document counts of every feature by class, and the class sizes, over ``rows`` (text, y).

    Each task adds up its rows; slices of the sums meet by slice, so the driver gets one array of fixed size.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, n, mark = np.zeros((2, D), np.int64), np.zeros(2, np.int64), np.zeros(D, bool)
        for b in batches:
            for text, y in zip(b.column(0), b.column(1).to_pylist()):
                c[y, feature_set(text.as_py(), mark)] += 1
                n[y] += 1
        part = [c[:, i:i + SLICE].tobytes() for i in range(0, D, SLICE)] + [n.tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(part)), pa.int32()), pa.array(part, pa.binary())], ["slice", "v"])

    def add(pdf):
        v = sum(np.frombuffer(x, np.int64) for x in pdf["v"])
        return pdf.iloc[:1].assign(v=[v.tobytes()])

    got = {r["slice"]: np.frombuffer(r["v"], np.int64) for r in
           rows.select("text", "y").mapInArrow(run, "slice int, v binary").groupBy("slice").applyInPandas(add, "slice int, v binary").collect()}
    k = D // SLICE
    if not got:
        return np.zeros((2, D)), np.zeros(2)
    return np.concatenate([got[i].reshape(2, SLICE) for i in range(k)], axis=1).astype(float), got[k].astype(float)


def log_ratios(counts: np.ndarray, sizes: np.ndarray, alpha: float = 1.0, min_docs: int = 5, min_ratio: float = 1.0,
               shrink: float = 5.0) -> np.ndarray:
    """Class log ratio of each feature, times n / (n + shrink); zero where it is rare or tells little."""
    r = np.log((counts[1] + alpha) / (sizes[1] + 2 * alpha)) - np.log((counts[0] + alpha) / (sizes[0] + 2 * alpha))
    n = counts.sum(0)
    return np.where((n >= min_docs) & (np.abs(r) >= min_ratio), r * n / (n + shrink), 0.0)


def bounded(ids: DataFrame, n: int, seed: int = 11) -> DataFrame:
    """About ``n`` rows of an id table, by a threshold on the hash of doc_id: the same rows in any layout."""
    total = ids.count()
    if total <= n:
        return ids
    return ids.where(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) < F.lit(int((1 << 53) * n / total)))


def taught(docs: DataFrame, labels: DataFrame, column: str, max_rows: int) -> DataFrame:
    """(doc_id, y) of about ``max_rows`` labelled documents of each class that exist in ``docs``; repeated labels count once.

    Only ids and labels are shuffled. The result is bounded by ``2 * max_rows`` rows, so it may be broadcast.
    """
    y = labels.where(F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))
    y = cut(docs.select("doc_id").where("doc_id is not null").distinct().join(y, "doc_id"))
    return cut(bounded(y.where("y = 1"), max_rows).union(bounded(y.where("y = 0"), max_rows)))


@dataclass
class Rows:
    """Sparse rows: the features of row i are ids[ptr[i]:ptr[i + 1]]."""
    ids: np.ndarray
    ptr: np.ndarray

    @staticmethod
    def of(parts: list[np.ndarray]) -> "Rows":
        ptr = np.cumsum([0, *map(len, parts)])
        ids = np.concatenate([*parts, np.empty(0, np.uint32)], out=np.empty(ptr[-1], np.int32), casting="unsafe")
        return Rows(ids, ptr)

    def blocks(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """First and last row, ids and lengths of consecutive rows with about ``HELD`` ids, so that what is derived of them stays small."""
        lo, n = 0, len(self.ptr) - 1
        while lo < n:
            hi = min(n, max(lo + 1, int(np.searchsorted(self.ptr, self.ptr[lo] + HELD, "right")) - 1))
            yield lo, hi, self.ids[self.ptr[lo]:self.ptr[hi]], np.diff(self.ptr[lo:hi + 1])
            lo = hi


class UnitRows:
    """Rows whose features hold the values ``r``, scaled to length one; values are made block by block, never for all ids at once."""

    def __init__(self, rows: Rows, r: np.ndarray):
        self.rows, self.r, self.scale = rows, r, 1.0
        self.scale = 1 / np.sqrt(self._sums(r * r) + 1e-9)

    def __len__(self) -> int:
        return len(self.rows.ptr) - 1

    def _sums(self, v: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self))
        for lo, hi, ids, sizes in self.rows.blocks():
            out[lo:hi] = np.bincount(np.repeat(np.arange(hi - lo), sizes), v[ids], hi - lo)
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        """Each row times the weights."""
        return self._sums(w * self.r) * self.scale

    def back(self, g: np.ndarray) -> np.ndarray:
        """The sum of all rows, each times its entry of ``g``."""
        out, g = np.zeros(len(self.r)), g * self.scale
        for lo, hi, ids, sizes in self.rows.blocks():
            out += np.bincount(ids, np.repeat(g[lo:hi], sizes), len(out))
        return out * self.r


def sparse(df: DataFrame, keep: np.ndarray, extra: tuple[str, ...] = ()) -> tuple[list[np.ndarray], dict[str, list]]:
    """Kept feature ids of every ``text`` of a bounded frame, with further columns, in row order of the texts' ids."""
    shared = df.sparkSession.sparkContext.broadcast(np.packbits(keep).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on, mark = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool), np.zeros(D, bool)
        for b in batches:
            ids = []
            for text in b.column(0):
                f = feature_set(text.as_py(), mark)
                ids.append(f[on[f]].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), *b.columns[1:]], ["f", *extra])

    types = "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in extra)
    t = df.select("text", *extra).mapInArrow(run, "f binary" + types).toPandas()
    t = t.sort_values(["f", *extra], kind="stable")  # the same order in any layout
    return [np.frombuffer(x, "<u4") for x in t["f"]], {c: t[c].tolist() for c in extra}


def logistic(rows: Rows, y: np.ndarray, r: np.ndarray, pairs: tuple[Rows, Rows] | None = None, pair_weight: float = 1.0,
             l2: float = 1e-4, steps: int = 80, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights (zero outside the kept features) and bias; classes weigh the same.

    ``pairs``: texts and their counterfactuals; the mean squared difference of their logits is added to the loss,
    times ``pair_weight``. Full-batch Adam, deterministic.
    """
    x, n = UnitRows(rows, r), len(y)
    sized = [UnitRows(p, r) for p in pairs or ()]
    w, b = np.zeros(len(r)), 0.0
    pos = max(1, int(y.sum()))
    cost = np.where(y == 1, n / (2 * pos), n / (2 * max(1, n - pos))) / max(1, n)
    m, v = np.zeros(len(r) + 1), np.zeros(len(r) + 1)
    for t in range(1, steps + 1):
        z = x.dot(w) + b
        g = cost * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.append(x.back(g) + l2 * w, g.sum())
        if sized and len(sized[0]):
            one, other = sized
            c = 2 * pair_weight / len(one) * (one.dot(w) - other.dot(w))
            grad[:-1] += one.back(c) - other.back(c)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


@dataclass
class TextModel:
    """Scaled weights and squared ratios of every feature, bias, and the calibration slope and shift of the logit."""
    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    @staticmethod
    def made(w: np.ndarray, r: np.ndarray, b: float) -> "TextModel":
        return TextModel((w * r).astype(np.float32), (r * r).astype(np.float32), b)

    def logit(self, f: np.ndarray) -> float:
        z = float(self.weight[f].sum(dtype=np.float64)) / float(np.sqrt(self.square[f].sum(dtype=np.float64) + 1e-9)) + self.bias
        return self.slope * z + self.shift


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def platt(z: np.ndarray, y: np.ndarray, steps: int = 100) -> np.ndarray:
    """Slopes and shift that map the logits of one or more views (columns of z) to a calibrated logit.

    Damped Newton steps on the smoothed log loss; a weak pull towards equal slopes that sum to 1
    and shift 0 keeps separable or few rows finite. Slopes are not negative.
    """
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    x = np.column_stack([z, np.ones(len(y))])
    k = x.shape[1] - 1
    home = np.append(np.full(k, 1 / k), 0.0)
    w = home.copy()

    def loss(v: np.ndarray) -> float:
        m = x @ v
        return float((np.logaddexp(0, m) - t * m).sum() + 0.05 * ((v - home) ** 2).sum())

    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (p - t) + 0.1 * (w - home)
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(k + 1)
        d, rate = np.linalg.solve(h, g), 1.0
        while rate > 1e-6 and loss(w - rate * d) > loss(w):
            rate /= 2
        w = w - rate * d
        if rate * np.abs(d).max() < 1e-9:
            break
    return np.append(np.maximum(w[:k], 1e-3), w[k])


def scored(df: DataFrame, model: TextModel, carry: list[str], finish: Callable | None = None, name: str = "score") -> DataFrame:
    """``carry`` columns and the probability of every ``text``; ``finish(logits, batch)`` may combine other columns."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, mark = shared.value, np.zeros(D, bool)
        for b in batches:
            z = np.array([m.logit(feature_set(t.as_py(), mark)) for t in b.column(0)])
            p = finish(z, b) if finish else sigmoid(z)
            yield pa.RecordBatch.from_arrays([*b.columns[1:len(carry) + 1], pa.array(np.atleast_1d(p), pa.float64())], [*carry, name])

    types = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in carry)
    return df.select("text", *carry).mapInArrow(run, f"{types}{name} double")
