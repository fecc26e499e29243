"""Small text helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The separators of words, as the result contracts state them.
SPACES = r"[ \t\n\x0B\f\r]+"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Array of the maximal runs of characters other than space and 0x09-0x0D."""
    return F.array_remove(F.split(text, SPACES), "")


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """The caller's whole row as the struct ``row`` beside columns of ours, so that no name of theirs can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)


def keep_columns(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, in its order."""
    return df.select(*[F.col(f"`{c}`") for c in like.columns])
