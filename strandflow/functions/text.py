"""Text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.mapping import update
from ..stream import Facts, Stream


def tokenize(stream: Stream, words: str = "words", word: str = "word", first_char: str = "first_char") -> Stream:
    """Replaces ``words`` by a row for each white-space-separated word (Unicode white space) and its first character.

    Null and blank texts give no row.
    """
    stream.require([words])
    rest = [c for c in stream.fields if c != words]
    each = F.explode(F.filter(F.split(F.col(f"`{words}`"), r"(?U)\s+"), lambda w: w != ""))
    df = stream.df.select(*rest, each.alias(word))
    return stream.with_df(df.withColumn(first_char, F.substring(word, 1, 1)), Facts())


def group_size(stream: Stream, group_field: str, name: str) -> Stream:
    """Adds the number of records of a nested collection."""
    return update(stream, add_fields={name: F.size(f"`{group_field}`").cast("long")})


def fold_group(stream: Stream, group_field: str, name: str, start, step) -> Stream:
    """Adds a fold over a nested collection: ``step(acc, record)`` on columns."""
    return update(stream, add_fields={name: F.aggregate(F.col(f"`{group_field}`"), start, step)})
