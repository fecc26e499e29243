"""Quality rules: per-document base rules and cross-document line frequency, in SQL functions only.

A line is normalised (lower case, single spaces, trimmed) and hashed. For each host (the
``source`` column) the operator counts the distinct documents that hold the line. A line held by more
than ``max_docs`` documents of a host is boilerplate: it is removed from every document but one, the one with
the smallest doc_id (the smallest text hash on ties), so that a text whose copies fill a host is not lost with them.
A document is rejected if the base rules fail it, or if what remains is under ``min_words`` words or under ``min_share`` of its words.

Defined cases: null and empty texts have no words and fail the base rules; a null source is one
host of its own; a document is an id with a text: repeated rows count once and share their verdict, rows with a null id count once
a text and come after all ids; an empty table gives no rows; columns of any name are carried by ``keep`` and ignored by ``report``.
``keep`` returns the texts without the removed lines, ``report`` counts them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from signalops.functions.lineage import cut
from signalops.llm.text import packed, text_or_empty, words

MAX_DOCS, MIN_WORDS, MIN_SHARE = 20, 50, 0.5
MASK_WORDS = 1 << 17
SYMBOLS = r"[^#*$%&|<>]+"
KEY = ["host", "id", "content"]


def measured(docs: DataFrame) -> DataFrame:
    """Add the base measures of ``text`` under names that start with ``__``; the frame holds columns of ours only.

    The hashes of a document's 3-word windows are compared inside the row: only documents with a
    repeated hash sort (hash, position) pairs; a position belongs to a repeated window if a
    neighbour in that order has the same hash. Nothing is exploded or shuffled.

    The word count carries a term that is always 0 but not deterministic: no filter on the measures can
    move below their projection, where copies of their expressions would run anew for every word.
    """
    d = docs.withColumn("__text", text_or_empty()).withColumn("__w", words(F.col("__text")))
    w, n = F.col("__w"), F.size("__w")
    d = d.withColumn("__h", F.transform(F.slice(w, F.lit(1), F.greatest(n - 2, F.lit(0))),
                                        lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))
    repeats = F.size(F.array_distinct("__h")) < F.size("__h")
    pairs = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    d = d.withColumn("__s", F.when(repeats, pairs))
    s = F.col("__s")
    same = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
    inside = F.flatten(F.transform(same, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^ \t\x0B\f\r]"))
    d = d.withColumn("__lines", lines)
    return d.select(
        *docs.columns,
        (n + F.floor(F.rand(0))).cast("bigint").alias("__n_words"),
        F.length(F.array_join(w, "")).cast("bigint").alias("__word_chars"),
        F.length(F.regexp_replace("__text", SYMBOLS, "")).cast("bigint").alias("__n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("__n_dup_lines"),
        F.coalesce(F.when(s.isNotNull(), F.size(F.array_distinct(inside))), F.lit(0)).cast("bigint").alias("__n_repeat_words"))


def base_failed() -> F.Column:
    return (F.col("__n_words") < 50) | (100 * F.col("__n_repeat_words") > 50 * F.col("__n_words"))


def document() -> list[F.Column]:
    """host, id, content: what names a document; a null id is the empty text."""
    return [F.coalesce("source", F.lit("")).alias("host"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
            F.xxhash64(text_or_empty()).alias("content")]


def host_lines(docs: DataFrame) -> DataFrame:
    """One row per normalised line: host, id, content (hash of the text), doc_id, total (words of the text), pos, line (hash), words."""
    flat = F.regexp_replace(F.lower(text_or_empty()), r"[ \t\x0B\f\r]+", " ")
    lines = F.transform(F.split(flat, "\n"), lambda x: F.trim(x))
    return (docs.select(*document(), F.col("doc_id"), F.size(words(text_or_empty())).cast("bigint").alias("total"), F.posexplode(lines).alias("pos", "t"))
            .where(F.col("t") != "")
            .select(*KEY, "doc_id", "total", "pos", F.xxhash64("t").alias("line"),
                    F.size(F.split("t", " ")).cast("bigint").alias("words")))


def frequent_lines(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """Lines above the limit: host, line, n_docs and the document that keeps the line.

    (host, line, document) is reduced on the map side first, so a line that a third of all
    documents share arrives at its reducer as one row for each document and task, spread by document.
    """
    once = host_lines(docs).groupBy("host", "line", "id", "content").agg(F.min("doc_id").alias("first"))
    return (once.groupBy("host", "line")
            .agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct(F.col("first").isNull().alias("z"), "first", "content", "id")).alias("o"))
            .where(F.col("n_docs") > max_docs)
            .select("host", "line", "n_docs", F.struct("o.id", "o.content").alias("owner")))


def hit_lines(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """host, id, content, pos, words, total: the frequent lines of documents that are not the line's owner, repeated rows once.

    The frequent lines are written once; the join sees their size and is broadcast only if small,
    else Spark's skew join splits the hot lines.
    """
    frequent = cut(frequent_lines(docs, max_docs))
    return (host_lines(docs).join(frequent, ["host", "line"]).where(F.struct("id", "content") != F.col("owner"))
            .groupBy(*KEY, "pos").agg(F.max("words").alias("words"), F.max("total").alias("total")))


def removed_words(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """host, id, content, removed, n_removed_lines: words and number of the lines that go."""
    return hit_lines(docs, max_docs).groupBy(*KEY).agg(F.sum("words").alias("removed"), F.count(F.lit(1)).alias("n_removed_lines"))


def slot(*key):
    return F.pmod(F.xxhash64(*key), F.lit(64 * MASK_WORDS))


def mask(texts: DataFrame) -> F.Column:
    """One bit for each slot that a document of ``texts`` falls in, as a scalar array of MASK_WORDS longs."""
    s = texts.select(slot(*KEY).alias("s")).select(F.floor(F.col("s") / 64).alias("id"), (F.col("s") % 64).cast("int").alias("bit"))
    found = s.groupBy("id").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    every = texts.sparkSession.range(0, MASK_WORDS, numPartitions=1).join(found, "id", "left")
    rows = F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))))
    return every.agg(rows.alias("rows")).select(F.col("rows.bits")).scalar()


def enough(left, total, min_words: int, min_share: float):
    return (left >= min_words) & (left >= min_share * total)


def judged(docs: DataFrame, max_docs: int = MAX_DOCS, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id with its measures, removed words and verdict under ``__`` names."""
    removed = cut(removed_words(docs, max_docs))
    left = F.col("__n_words") - F.coalesce("removed", F.lit(0))
    return (measured(docs.select("doc_id", "text", *document())).join(removed, KEY, "left")
            .withColumn("__base_failed", base_failed())
            .withColumn("__kept", ~F.col("__base_failed") & enough(left, F.col("__n_words"), min_words, min_share)))


def report(docs: DataFrame, **limits) -> DataFrame:
    """One row per document: its measures, the removed lines and the verdict."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return judged(docs, **limits).select(
        "doc_id", *[F.col(f"__{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                                      "base_failed", "kept")],
        zero("n_removed_lines").alias("n_removed_lines"), zero("removed").alias("n_removed_words"))


def keep(docs: DataFrame, max_docs: int = MAX_DOCS, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """The documents that pass, with their own columns and without their frequent lines; ``n_chars`` follows the text.

    The lines to remove are positions for each document. A document whose slot in a mask of fixed size is empty has none
    and is judged where it is read; only the others meet the table of positions, so most texts are not shuffled
    even if that table outgrows a broadcast.
    """
    hit = hit_lines(docs, max_docs).groupBy(*KEY).agg(
        F.sum("words").alias("removed"), F.max("total").alias("total"), F.collect_list("pos").alias("gone"))
    hit = cut(hit.select(*KEY, "gone", (~enough(F.col("total") - F.col("removed"), F.col("total"), min_words, min_share)).alias("depleted")))
    at = slot(*document())
    maybe = F.get(mask(hit), F.floor(at / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % 64).cast("int"))) != 0
    untouched = measured(packed(docs.where(~maybe), "text")).where(~base_failed())
    # Lines are split below the join, so the removal reads them by position without splitting again.
    touched = (measured(packed(docs.where(maybe), "text", *document(), F.split(text_or_empty(), "\n").alias("parts"))).where(~base_failed())
               .join(hit, KEY, "left").where(~F.coalesce("depleted", F.lit(False))))
    parts = F.col("parts")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.coalesce("gone", F.array().cast("array<int>")))
    text = F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return untouched.select("row.*").union(touched.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns]))
