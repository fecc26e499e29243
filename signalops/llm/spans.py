"""Positions of regular-expression matches as SQL functions only.

Spark extracts matches without their places; the pieces between them give the places: a match starts
after all earlier pieces and matches. Sums run in chunks, so a text with very many matches stays
near linear. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CHUNK = 256
SPAN = "array<struct<start:int,stop:int,match:string,before:string,after:string>>"


def found(text: Column, pattern: str, context: int = 16) -> Column:
    """Leftmost non-overlapping matches of ``pattern``, which never matches the empty text.

    Each is a struct start, stop, match, before (up to ``context`` characters), after (up to one).
    ``pattern`` is a Java pattern; repeated groups in it are possessive, which keeps Java's matcher
    from recursing over very long runs.
    """
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.transform(matches, lambda m, i: F.struct(m.alias("match"), i.alias("i")))

    def placed(p: Column, s: Column) -> Column:
        width = lambda x: F.length(F.get(p, x["i"])) + F.length(x["match"])
        zero = F.lit(0)
        chunks = F.transform(F.sequence(zero, F.floor((F.size(s) - 1) / CHUNK).cast("int")), lambda c: F.slice(s, c * CHUNK + 1, CHUNK))
        totals = F.transform(chunks, lambda ch: F.aggregate(ch, zero, lambda a, x: a + width(x)))
        empty = F.array().cast("array<int>")
        running = lambda ls, first: F.aggregate(ls, F.struct(first.alias("at"), empty.alias("out")),
                                                lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"]).alias("out")))["out"]
        offsets = running(totals, zero)
        # Where each chunk's pieces begin, then where each piece within it begins.
        begin = F.flatten(F.transform(chunks, lambda ch, c: running(F.transform(ch, width), F.get(offsets, c))))
        return F.transform(F.array(begin), lambda b: F.transform(s, lambda x: F.struct(
            (F.get(b, x["i"]) + F.length(F.get(p, x["i"]))).alias("start"),
            (F.get(b, x["i"]) + F.length(F.get(p, x["i"])) + F.length(x["match"])).alias("stop"),
            x["match"].alias("match"), F.right(F.get(p, x["i"]), F.lit(context)).alias("before"),
            F.left(F.get(p, x["i"] + 1), F.lit(1)).alias("after"))))[0]

    both = F.transform(F.array(F.struct(pieces.alias("p"), steps.alias("s"))), lambda v: placed(v["p"], v["s"]))[0]
    return F.when(text.rlike(pattern), both).otherwise(F.array().cast(SPAN))


def joined(items: Column) -> Column:
    """kind:start:stop of sorted structs (kind, start, stop), joined by commas."""
    return F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
