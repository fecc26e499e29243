"""Toxicity: a classifier whose score must not change when identity terms are swapped.

The text model of ``linear`` is fitted on labelled rows. Each sample text that names a group also gives counterfactuals:
the same text with every identity term replaced by another of its family. The loss adds the squared
difference between the logits of a text and its counterfactual, so features that only carry the identity get no
weight, and a neutral mention of a group does not raise the score. The model is fitted on about ``MAX_ROWS`` rows of
each class, picked by the hash of their ids; no text reaches the driver.

Defined cases: null and empty texts get the score of a text without features; rows without a label, or with a null
label, are scored but teach nothing; repeated label rows count once; if one class is missing every score is 0;
an empty documents table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from signalops.functions.lineage import cut
from signalops.llm import linear
from signalops.llm.text import fold, text_or_empty

MAX_ROWS, PAIR_WEIGHT = 5000, 1.0
# Families of identity terms whose members may stand for each other.
FAMILIES = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"), ("black", "white", "asian", "latino"),
    ("immigrants", "refugees", "natives", "foreigners"), ("french", "german", "spanish", "english", "african", "american"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"), ("old", "young", "disabled"))
_TERM = re.compile(r"\b(" + "|".join(sorted({t for f in FAMILIES for t in f}, key=lambda t: (-len(t), t))) + r")\b", re.IGNORECASE)
_HOME = {t: f for f in FAMILIES for t in f}


def swapped(text: str, turn: int = 1) -> str:
    """The text with each identity term replaced by the term ``turn`` places on in its family."""
    def other(m: re.Match) -> str:
        f = _HOME[m.group(0).lower()]
        new = f[(f.index(m.group(0).lower()) + turn) % len(f)]
        return new.capitalize() if m.group(0)[0].isupper() else new
    return _TERM.sub(other, text)


def _pairs(rows: DataFrame, keep: np.ndarray, turns: int = 3) -> tuple[linear.Rows, linear.Rows]:
    """Kept features of every text that names a group, and of its counterfactuals; only these ids leave the tasks."""
    shared = rows.sparkSession.sparkContext.broadcast(np.packbits(keep).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on, mark = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool), np.zeros(linear.D, bool)
        kept = lambda text: (lambda f: f[on[f]].astype("<u4").tobytes())(linear.feature_set(text, mark))
        for b in batches:
            pairs = [(own, kept(swapped(t, k))) for t in b.column(0).to_pylist() if _TERM.search(t) for own in [kept(t)] for k in range(1, turns + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in range(2)], ["a", "b"])

    t = rows.select("text").mapInArrow(run, "a binary, b binary").toPandas().sort_values(["a", "b"], kind="stable")
    return tuple(linear.Rows.of([np.frombuffer(x, "<u4") for x in t[c]]) for c in ("a", "b"))


def fit(rows: DataFrame, pair_weight: float = PAIR_WEIGHT) -> linear.TextModel | None:
    """The model of a bounded table of labelled ``rows`` (text, y in 0/1); None if a class is missing."""
    rows = cut(rows)
    counts, sizes = linear.class_counts(rows)
    if not sizes.all():
        return None
    r = linear.log_ratios(counts, sizes)
    parts, extra = linear.sparse(rows, r != 0, ("y",))
    pairs = _pairs(rows, r != 0)
    w, b = linear.logistic(linear.Rows.of(parts), np.array(extra["y"]), r, pairs, pair_weight)
    return linear.TextModel.made(w, r, b)


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(text, y) of a bounded sample of the rows that may teach: crc32 of the id modulo 5 is not 0; of rows of one id the least text."""
    may = docs.where(fold("doc_id", 5) != 0)
    ids = linear.taught(may, labels, "toxic", max_rows)
    rows = may.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "y")


def report(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = fit(labelled(docs, labels, max_rows), **options)
    d = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), text_or_empty().alias("text"))
    if model is None:
        s = d.select("doc_id", "held_out", F.lit(0.0).alias("score"))
    else:
        s = linear.scored(d, model, ["doc_id", "held_out"])
    return s.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
