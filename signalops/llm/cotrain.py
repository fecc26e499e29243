"""Quality classifier by co-training of a text view and a metadata view.

The text view reads hashed n-grams (``linear``) and no metadata. The metadata view reads what is known of a page without its words: source and
language (hashed to ``NAMES`` columns each, so every value has one), length, line layout, how many words are distinct and the shares of symbols, capitals, digits,
bars and spaces, each in quantile buckets; it reads no words. Either view is a set of class log ratios, so it is taught by sums alone.

Both start from a bounded sample of labelled rows. In each round one pass scores all rows that may teach; a row that one view is surer of than
``SURE`` (calibrated on labelled rows held apart) adds its features to the class sums of the other view. Tasks add up their rows, so every row takes part
whatever the size of the table and the driver gets arrays of fixed size. At the end a logistic layer a view over the labelled sample weighs the features whose ratios the
rounds have settled, held rows calibrate both views and weigh their logits against each other, and the combination scores all documents.

Bounds: about ``MAX_ROWS`` labelled rows of each class, picked by the hash of their ids. Rows teach if crc32 of their id modulo 5 is not 0; in the rounds
labelled rows count like any other, without their label.

Defined cases: null and empty texts are scored by their metadata and an empty feature set; null source and lang are values
of their own; null labels teach nothing; repeated labels count once and of rows of one id the least is sampled; if a class is missing every document has score 0.5
and is kept; an empty table gives no rows; columns of any name are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from signalops.functions.lineage import cut
from signalops.llm import linear
from signalops.llm.text import fold, text_or_empty

MAX_ROWS, ROUNDS, SURE, NAMES = 2500, 2, 0.95, 256
CUTS = (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.93, 0.95, 0.97, 0.99)
NUMBERS = 9
COLUMNS = 2 * NAMES + NUMBERS * (len(CUTS) + 1)
_SYMBOLS, _DIGITS, _CAPITALS = (np.frombuffer(s, np.uint8) for s in (b"#*$%&<>!", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))


def numbers(text: str) -> list[float]:
    """Log characters, log lines, log characters a line, shares of symbols, capitals, digits, bars and spaces, share of distinct words."""
    b = np.frombuffer(text.encode(errors="replace"), np.uint8)
    n, lines = max(len(text), 1), text.count("\n") + 1
    c = np.bincount(b, minlength=256)
    latin = 0 if len(b) == len(text) else int(((b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E)).sum())  # capitals from U+00C0 to U+00DE
    w = text.split()
    return [np.log1p(len(text)), np.log1p(lines), np.log1p(n / lines), c[_SYMBOLS].sum() / n, (c[_CAPITALS].sum() + latin) / n, c[_DIGITS].sum() / n,
            c[ord("|")] / n, c[32] / n, len(set(w)) / max(len(w), 1)]


@dataclass
class Views:
    """Both views: sums of class log ratios in the rounds, fitted layers over them at the end."""
    edges: np.ndarray
    text: linear.TextModel | None = None
    meta: linear.TextModel | None = None

    def columns(self, source: str, lang: str, nums: list[float]) -> np.ndarray:
        """The metadata columns of a row: source, language, and a bucket of each number."""
        named = [zlib.crc32(source.encode()) % NAMES, NAMES + zlib.crc32(lang.encode()) % NAMES]
        k = len(CUTS) + 1
        return np.array(named + [2 * NAMES + j * k + int(np.searchsorted(self.edges[j], x, "right")) for j, x in enumerate(nums)])


def _rows(b: pa.RecordBatch, mark: np.ndarray, views: Views) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text features and metadata columns of a batch (text, source, lang, ...)."""
    for text, source, lang in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
        t = text.as_py()
        yield linear.feature_set(t, mark), views.columns(source, lang, numbers(t))


def class_sums(df: DataFrame, views: Views, sure: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Class counts of text features and of metadata columns, (2, D + 1) and (2, COLUMNS + 1), last the rows themselves.

    ``df`` has text, source, lang and y. With ``sure`` a row teaches each view the label that the other view is surer of than this; without it,
    both views its label y.
    """
    shared = df.sparkSession.sparkContext.broadcast(views)
    least = None if sure is None else float(np.log(sure / (1 - sure)))
    width = linear.D + COLUMNS + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, mark, c = shared.value, np.zeros(linear.D, bool), np.zeros((2, width), np.int64)
        for b in batches:
            labels = b.column(3).to_pylist()
            for (f, m), y in zip(_rows(b, mark, v), labels):
                to_text = to_meta = y
                if least is not None:
                    zt, zm = v.text.logit(f), v.meta.logit(m)
                    to_text, to_meta = (int(z > 0) if abs(z) >= least else None for z in (zm, zt))
                if to_text is not None:
                    c[to_text, f] += 1
                    c[to_text, linear.D] += 1
                if to_meta is not None:
                    c[to_meta, linear.D + 1 + m] += 1
                    c[to_meta, -1] += 1
        parts = [np.ascontiguousarray(c[:, i:i + linear.SLICE]).tobytes() for i in range(0, width, linear.SLICE)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["slice", "v"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1].assign(v=[sum(np.frombuffer(x, np.int64) for x in pdf["v"]).tobytes()])

    got = (df.select("text", "source", "lang", "y").mapInArrow(run, "slice int, v binary").groupBy("slice").applyInPandas(add, "slice int, v binary")
           .orderBy("slice").collect())  # as many rows as there are slices
    if not got:
        return np.zeros((2, linear.D + 1)), np.zeros((2, COLUMNS + 1))
    c = np.concatenate([np.frombuffer(r["v"], np.int64).reshape(2, -1) for r in got], axis=1).astype(float)
    return c[:, :linear.D + 1], c[:, linear.D + 1:]


def looked_at(rows: DataFrame, views: Views, keep: np.ndarray) -> pd.DataFrame:
    """The bounded labelled rows on the driver: kept feature ids (f), metadata columns (m), numbers, y, held; in the order of their features."""
    shared = rows.sparkSession.sparkContext.broadcast((views, np.packbits(keep).tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, bits = shared.value
        on, mark = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool), np.zeros(linear.D, bool)
        for b in batches:
            f, meta, nums = [], [], []
            for text, (ids, m) in zip(b.column(0), _rows(b, mark, v)):
                f.append(ids[on[ids]].astype("<u4").tobytes()), meta.append(m.astype("<u4").tobytes()), nums.append(numbers(text.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.binary()), pa.array(meta, pa.binary()), pa.array(nums, pa.list_(pa.float64())), b.column(3), b.column(4)],
                                             ["f", "m", "nums", "y", "held"])

    t = rows.select("text", "source", "lang", "y", "held").mapInArrow(run, "f binary, m binary, nums array<double>, y int, held boolean").toPandas()
    return t.sort_values(["f", "m", "y"], kind="stable", ignore_index=True)


def _ratios(views: Views, text: np.ndarray, meta: np.ndarray) -> tuple[Views, np.ndarray, np.ndarray]:
    """The views of the given class sums, not yet calibrated, and the ratios of text features and metadata columns."""
    r = linear.log_ratios(text[:, :-1], text[:, -1])
    m = linear.log_ratios(meta[:, :-1], meta[:, -1], min_docs=1, min_ratio=0.0)
    made = lambda x: linear.TextModel.made(np.ones(len(x)), x, 0.0)
    return replace(views, text=made(r), meta=made(m)), r, m


def _calibrated(views: Views, t: pd.DataFrame) -> tuple[Views, np.ndarray]:
    """Both views calibrated on the held rows, and the weights of their logits."""
    t = t[t["held"]]
    if t["y"].nunique() < 2:
        return views, np.array([0.5, 0.5, 0.0])
    y = t["y"].to_numpy()
    z, lined = [], {}
    for name, column in (("text", "f"), ("meta", "m")):
        view = getattr(views, name)
        x = np.array([view.logit(np.frombuffer(f, "<u4")) for f in t[column]])
        slope, shift = map(float, linear.platt(x, y))
        lined[name] = replace(view, slope=slope, shift=shift)
        z.append(slope * x + shift)
    return replace(views, **lined), linear.platt(np.column_stack(z), y)


def fit(rows: DataFrame, teaching: DataFrame, rounds: int = ROUNDS, sure: float = SURE) -> tuple[Views, np.ndarray] | None:
    """Both views and the weights of their logits, from the bounded table ``rows`` (text, source, lang, y, held) and all ``teaching`` rows (y is not read).

    None if a class is missing.
    """
    nothing = np.zeros(linear.D, bool)
    blank = Views(np.zeros((NUMBERS, len(CUTS))))
    t = looked_at(rows, blank, nothing)
    own = t[~t["held"]]
    if t["y"].nunique() < 2:
        return None
    if own["y"].nunique() < 2 or t[t["held"]]["y"].nunique() < 2:
        rows = rows.withColumn("held", F.lit(False))
        own = t
    blank = Views(np.quantile(np.array(own["nums"].tolist()), CUTS, axis=0).T)
    base = class_sums(rows.where("not held"), blank)
    views, r, m = _ratios(blank, *base)
    for _ in range(rounds):
        some = rows.where("held") if t["held"].any() else rows
        views, _ = _calibrated(views, looked_at(some, views, r != 0))
        more = class_sums(teaching, views, sure)
        views, r, m = _ratios(blank, *[a + b for a, b in zip(base, more)])
    r = np.where(base[0][:, :-1].sum(0) >= 5, r, 0.0)  # the layer can only weigh what some labelled rows hold
    t = looked_at(rows, views, r != 0)
    own = t[~t["held"]]
    layers = {}
    for name, column, ratios in (("text", "f", r), ("meta", "m", m)):
        ids = linear.Rows.of([np.frombuffer(f, "<u4") for f in own[column]])
        w, b = linear.logistic(ids, own["y"].to_numpy(), ratios, steps=50)
        layers[name] = linear.TextModel.made(w, ratios, b)
    return _calibrated(replace(views, **layers), t)


def described(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_or_empty().alias("text"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang")])


def samples(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[DataFrame, DataFrame]:
    """The bounded labelled sample (text, source, lang, y, held) and all rows that may teach; ids are picked first and broadcast."""
    may = docs.where(fold("doc_id", 5) != 0)
    ids = linear.taught(may, labels, "quality", max_rows)
    one = F.min(F.struct("text", "source", "lang")).alias("one")
    rows = described(may).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(one).select("one.*", "y")
    held = F.pmod(F.xxhash64("text", F.lit(3)), F.lit(5)) == 0
    return cut(rows.withColumn("held", held)), described(may).withColumn("y", F.lit(0))


def report(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, **options) -> DataFrame:
    """doc_id, score (chance of quality 1), p_text, p_meta, predicted for every document."""
    found = fit(*samples(docs, labels, max_rows), **options)
    d = described(docs)
    names = ["doc_id", "score", "p_text", "p_meta", "predicted"]
    if found is None:
        return d.select("doc_id", *[F.lit(0.5).alias(c) for c in names[1:4]], F.lit(1).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views, both = shared.value
        mark = np.zeros(linear.D, bool)
        for b in batches:
            z = np.array([(views.text.logit(f), views.meta.logit(m)) for f, m in _rows(b, mark, views)]).reshape(-1, 2)
            p = linear.sigmoid(z @ both[:2] + both[2])
            yield pa.RecordBatch.from_arrays([b.column(3), *[pa.array(v, pa.float64()) for v in (p, linear.sigmoid(z[:, 0]), linear.sigmoid(z[:, 1]))],
                                              pa.array((p >= 0.5).astype(np.int32))], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return d.select("text", "source", "lang", "doc_id").mapInArrow(run, f"doc_id {kind}, score double, p_text double, p_meta double, predicted int")
