"""Mixing sources to target weights by iterative proportional fitting, in SQL functions only.

Documents fall into cells (source, language, topic) that are reduced to token counts first; only
this cell table is raked. Each round scales the cell weights to the target share of every source, then
language, then topic, until all marginals are within ``tolerance``. A document's probability is its cell's
weight per token, divided by the largest such ratio, so the expected tokens of the sample have the
target marginals without capping or repeating a document. The draw is a hash of doc_id and text.

Default targets flatten the observed shares: share ** ``flatten``, rescaled to sum to one. A table
without a ``topic`` column gets the kind of text as its topic (listing, symbols, capitals, or prose by length).

The expected sample holds as many tokens as it can without repeating a document, unless ``share`` asks for another share of the corpus' tokens;
a document whose expected number of copies exceeds one is then repeated, so the marginals hold at any size.

Raking goes on until every marginal is within ``tolerance`` of its target, or until its largest deviation has not fallen by a fifth over
``PATIENCE`` rounds: then no non-negative weights meet the targets, or none that raking comes near. ``report`` states the deviation that is left and whether the targets are met;
``sample`` warns, or raises if ``strict``.

Defined cases: null source, language or topic form a value of their own; texts without words weigh nothing, are sampled with
the probability of their cell and a cell of such texts alone has probability one; repeated rows share
their draw; an empty table gives no rows; columns of any name are carried.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, functions as F

from signalops.functions.lineage import cut
from signalops.llm.text import packed, text_or_empty, words

DIMS = ("source", "lang", "topic")
FLATTEN, TOLERANCE, PATIENCE, SEED = 0.85, 1e-6, 15, 7


def kind_of_text(text: Column, n_words: Column) -> Column:
    """Listing, symbols, capitals, or prose by number of words."""
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda others: F.length(F.regexp_replace(text, others, "")) / n
    return (F.when(share(r"[^|]+") > 0.02, "listing").when(share(r"[^#*$%&<>]+") > 0.02, "symbols")
            .when(share(r"[^\p{Lu}]+") > 0.3, "capitals").when(n_words < 100, "note").when(n_words < 500, "article")
            .otherwise("long"))


def placed(docs: DataFrame) -> DataFrame:
    """Packed documents with source, lang, topic (null as the empty text), tokens and key (hash of id and text)."""
    text = text_or_empty()
    given = [F.col("topic").cast("string").alias("topic")] if "topic" in docs.columns else []
    d = packed(docs, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in DIMS[:2]], *given, text.alias("text"),
               F.size(words(text)).cast("bigint").alias("tokens"), F.xxhash64(F.col("doc_id"), text, F.lit(SEED)).alias("key"))
    # The word count is a column before the kind of text reads it, so texts are split once.
    topic = F.coalesce("topic", F.lit("")) if given else kind_of_text(F.col("text"), F.col("tokens"))
    return d.select("row", *DIMS[:2], topic.alias("topic"), "tokens", "key")


def cell_table(docs: DataFrame) -> DataFrame:
    """source, lang, topic, tokens: one row per cell, reduced on the map side."""
    return placed(docs).groupBy(*DIMS).agg(F.sum("tokens").alias("tokens"))


def flattened(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Target shares (dim, share): observed token share ** power, rescaled."""
    t = cells.groupBy(dim).agg(F.sum("tokens").alias("t")).where("t > 0").select(dim, F.pow(F.col("t").cast("double"), power).alias("u"))
    total = t.agg(F.sum("u")).first()[0] or 1.0
    return t.select(dim, (F.col("u") / F.lit(total)).alias("share"))


def deviations(w: DataFrame, targets: dict[str, DataFrame]) -> dict[str, float]:
    """Largest absolute difference between a share of ``weight`` and its target, for each dimension; values on one side only count."""
    total = w.agg(F.sum("weight")).first()[0] or 1.0
    off = None
    for dim, target in targets.items():
        sums = w.groupBy(dim).agg((F.sum("weight") / F.lit(total)).alias("is"))
        gap = F.abs(F.coalesce("is", F.lit(0.0)) - F.coalesce("share", F.lit(0.0)))
        worst = sums.join(target, dim, "full").agg(F.max(gap).alias("gap")).select(F.lit(dim).alias("dim"), F.coalesce("gap", F.lit(0.0)).alias("gap"))
        off = worst if off is None else off.union(worst)
    return {r["dim"]: r["gap"] for r in off.collect()}


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, patience: int = PATIENCE) -> tuple[DataFrame, dict[str, float]]:
    """Cells with ``weight``, shares whose marginals meet the targets, and the deviation left in each. ``targets``: (dim, share) tables."""
    w = cells.where("tokens > 0").withColumn("weight", F.col("tokens").cast("double"))
    least: list[float] = []
    columns = w.columns
    while True:
        for dim, target in targets.items():
            sums = w.groupBy(dim).agg(F.sum("weight").alias("sum")).join(target, dim, "left")
            share = F.coalesce("share", F.lit(0.0))
            factor = sums.select(dim, F.when(F.col("sum") > 0, share / F.col("sum")).otherwise(0.0).alias("factor"), F.abs(F.col("sum") - share).alias(f"gap_{dim}"))
            w = w.join(factor, dim).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")
        w = cut(w)
        # How far each marginal was off when its turn came; nothing moves any more once all are within the tolerance.
        moved = w.agg(F.greatest(*[F.max(f"gap_{d}") for d in targets], F.lit(0.0))).first()[0] if targets else 0.0
        w = w.select(*columns)
        least.append(min(moved or 0.0, *least[-1:]) if least else moved or 0.0)
        if least[-1] <= tolerance / 4 or len(least) > patience and least[-1] > 0.8 * least[-1 - patience]:
            return w, deviations(w, targets)


def probabilities(docs: DataFrame, targets: dict[str, DataFrame] | None = None, flatten: float = FLATTEN, share: float | None = None
                  ) -> tuple[DataFrame, dict[str, float]]:
    """Cells with ``weight`` and the ``probability`` (expected copies) of their documents, and the deviations left.

    ``share``: expected tokens of the sample over those of the corpus; None for the most that repeats no document.
    """
    cells = cut(cell_table(docs))
    targets = targets or {d: cut(flattened(cells, d, flatten)) for d in DIMS}
    w, off = rake(cells, targets)
    w = w.withColumn("ratio", F.col("weight") / F.col("tokens"))
    top, weight, tokens = w.agg(F.max("ratio"), F.sum("weight"), F.sum("tokens")).first()
    times = 1 / top if top and share is None else (share or 0.0) * tokens / weight if weight else 1.0
    raked = w.select(*DIMS, "weight", (F.col("ratio") * F.lit(times)).alias("probability"))
    return cut(cells.join(raked, list(DIMS), "left").select(
        *DIMS, "tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("probability", F.lit(1.0)).alias("probability"))), off


def drawn(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """Packed documents with their cell, tokens, weight, probability and number of ``copies``; the cell table is joined by its measured size."""
    u = F.shiftrightunsigned("key", 11) / F.lit(float(1 << 53))
    whole = F.floor("probability")
    return (placed(docs).join(cells.drop("tokens"), list(DIMS))
            .withColumn("copies", (whole + (u < F.col("probability") - whole).cast("bigint")).cast("bigint")))


def report(docs: DataFrame, tolerance: float = TOLERANCE, **options) -> DataFrame:
    """One row per document: cell, tokens, the cell's target weight, probability and draw; the deviation left and whether the targets are met."""
    cells, off = probabilities(docs, **options)
    worst = max(off.values(), default=0.0)
    return drawn(docs, cells).select("row.doc_id", *DIMS, "tokens", "weight", "probability", (F.col("copies") > 0).alias("sampled"), "copies",
                                     F.lit(worst).alias("deviation"), F.lit(worst <= tolerance).alias("targets_met"))


def sample(docs: DataFrame, strict: bool = False, tolerance: float = TOLERANCE, **options) -> DataFrame:
    """The drawn documents, with their own columns, once for each copy."""
    cells, off = probabilities(docs, **options)
    unmet = {d: x for d, x in off.items() if x > tolerance}
    if unmet and strict:
        raise ValueError(f"no weights meet the targets; deviations left: {unmet}")
    if unmet:
        warnings.warn(f"no weights meet the targets; deviations left: {unmet}", stacklevel=2)
    d = drawn(docs, cells).where("copies > 0")
    if options.get("share") is not None:
        d = d.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return d.select("row.*")
