"""Language identification by the nearest of several centroids per language.

A text becomes the TF-IDF vector of its hashed byte n-grams (one to three bytes of lower-case letters, log
term counts), scaled to length one. Document frequencies come from every learning row. The vectors of about
``SAMPLE`` rows per language are clustered by spherical k-means into ``CENTROIDS`` centroids. A text takes the
language of the centroid with the highest cosine; if it is farther than that centroid's learnt limit
(the ``TAIL`` quantile of its members' cosines, less ``SLACK``) the answer is marked as rejected.

Defined cases: null texts and texts without a letter are ``und`` with score 0; rows with a null lang teach
nothing; ties go to the language that sorts first; if nothing was learnt every text is ``und``; repeated rows get
the same answer; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from signalops.functions.lineage import cut
from signalops.llm import linear
from signalops.llm.text import fold

BUCKETS, GRAMS, SAMPLE, CENTROIDS, TAIL, SLACK = 4096, (1, 2, 3), 800, 4, 0.01, 0.1
_CHUNK = 1 << 20


def counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of the text's letters."""
    b = linear.letters(text)
    c = np.zeros(BUCKETS, np.int64)
    for lo in range(0, len(b), _CHUNK):
        for n, ids in zip(GRAMS, linear.gram_ids(b[lo:lo + _CHUNK + GRAMS[-1] - 1], GRAMS, BUCKETS)):
            last = lo + _CHUNK >= len(b)
            c += np.bincount(ids if last else ids[:_CHUNK], minlength=BUCKETS)
    return c


def has_letter(text: str | None) -> bool:
    return text is not None and any(ch.isalpha() for ch in text)


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each bucket, and the number of documents, over all of ``rows`` (text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS + 1, np.int64), 0
        for b in batches:
            for t in b.column(0):
                df[:-1] += counts(t.as_py()) > 0
                n += 1
        df[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(range(BUCKETS + 1), pa.int32()), pa.array(df)], ["slot", "n"])

    got = rows.select("text").mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS + 1, np.int64)
    df[got["slot"]] = got["n"]
    return df[:-1], int(df[-1])


def vector(text: str, idf: np.ndarray) -> np.ndarray:
    v = (np.log1p(counts(text)) * idf).astype(np.float32)
    n = np.sqrt((v * v).sum())
    return v / n if n else v


def clusters(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means with farthest-first seeds: centroids of length one and each member's cosine limit."""
    mean = x.mean(0)
    c = [mean / (np.linalg.norm(mean) or 1)]
    while len(c) < min(k, len(x)):
        c.append(x[np.argmin((x @ np.array(c).T).max(1))])
    c = np.array(c)
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        c = np.array([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    s = x @ c.T
    at, best = s.argmax(1), s.max(1)
    full = [j for j in range(len(c)) if (at == j).any()]
    return c[full], np.array([np.quantile(best[at == j], TAIL) - SLACK for j in full])


def fit(rows: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> tuple[np.ndarray, pd.DataFrame]:
    """idf, and a table (lang, centroid, floor) of at most ``centroids`` rows per language, from (text, lang) rows."""
    df, n = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + df)) + 1
    hashed = rows.withColumn("h", F.xxhash64("text", F.lit(5)))
    sizes = cut(hashed.select("lang", "h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")))  # distinct texts
    pick = (hashed.join(sizes, "lang").where(F.shiftrightunsigned("h", 11) <= F.lit(float(1 << 53)) * sample / F.col("n"))
            .dropDuplicates(["lang", "h"]).select("lang", "text"))
    shared = rows.sparkSession.sparkContext.broadcast(idf)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [vector(t.as_py(), shared.value).astype(np.float16).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v, pa.binary())], ["lang", "v"])

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array([np.frombuffer(v, np.float16) for v in sorted(pdf["v"])]).astype(np.float32)
        c, floor = clusters(x, centroids)
        return pd.DataFrame({"lang": pdf["lang"].iat[0], "centroid": [r.astype(np.float32).tobytes() for r in c], "floor": floor})

    table = pick.mapInArrow(vectors, "lang string, v binary").groupBy("lang").applyInPandas(group, "lang string, centroid binary, floor double")
    return idf, table.toPandas().sort_values(["lang", "centroid"], kind="stable").reset_index(drop=True)


def predict(docs: DataFrame, idf: np.ndarray, table: pd.DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` columns, lang_pred, score and rejected for every ``text`` (null allowed)."""
    c = np.array([np.frombuffer(x, np.float32) for x in table["centroid"]])
    shared = docs.sparkSession.sparkContext.broadcast((idf, c, table["lang"].tolist(), table["floor"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, c, names, floor = shared.value
        for b in batches:
            lang, score, far = [], [], []
            for t in b.column(0).to_pylist():
                if not names or not has_letter(t):
                    lang.append("und"), score.append(0.0), far.append(True)
                    continue
                s = c @ vector(t, idf)
                j = int(s.argmax())
                lang.append(names[j]), score.append(float(min(1.0, max(0.0, s[j])))), far.append(bool(s[j] < floor[j]))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())],
                                             [*carry, "lang_pred", "score", "rejected"])

    types = "".join(f"{x} {docs.schema[x].dataType.simpleString()}, " for x in carry)
    return docs.select("text", *carry).mapInArrow(run, f"{types}lang_pred string, score double, rejected boolean")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every document."""
    d = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    idf, table = fit(d.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang"), **options)
    return predict(d, idf, table, ["doc_id", "held_out"])
