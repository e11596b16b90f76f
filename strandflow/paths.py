"""Nested collections: expressions applied to the collection at a path of field names."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import errors as E
from .stream import Facts, Key, Stream

Lift = Callable[[Column, T.StructType], Column]


def nested_type(schema: T.StructType, path: Sequence[str]) -> T.StructType:
    """The record type of the collection at ``path``."""
    here = schema
    if not path:
        raise E.FieldNotFound("an empty path")
    for name in path:
        if name not in here.names:
            raise E.FieldNotFound(f"field `{name}` not found on path {list(path)}")
        kind = here[name].dataType
        if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)):
            raise E.InvalidFieldType(f"field `{name}` is not a collection of records")
        here = kind.elementType
    return here


def record(x: Column, names: Sequence[str], last: Column | None = None, **new: Column) -> Column:
    """A struct of ``x``'s fields, some replaced in place."""
    return F.struct(*[new.get(n, x[n]).alias(n) for n in names])


def lift(stream: Stream, path: Sequence[str], fn: Lift, facts: Callable[[Facts], Facts], move: bool) -> Stream:
    """Applies ``fn`` to the collection at ``path``; with ``move`` each collection on the path becomes its record's last field.

    ``fn`` gets the array and its record type and gives the new array: a pure expression, so no shuffle and no Python.
    """
    schema = stream.df.schema
    nested_type(schema, path)

    def go(array: Column, kind: T.StructType, rest: Sequence[str]) -> Column:
        if not rest:
            return fn(array, kind)
        inner = kind[rest[0]].dataType.elementType

        def rebuild(x: Column) -> Column:
            new = go(x[rest[0]], inner, rest[1:]).alias(rest[0])
            if move:
                return F.struct(*[x[n].alias(n) for n in kind.names if n != rest[0]], new)
            return F.struct(*[new if n == rest[0] else x[n].alias(n) for n in kind.names])

        return F.transform(array, rebuild)

    top = path[0]
    new = go(F.col(f"`{top}`"), schema[top].dataType.elementType, path[1:])
    names = stream.df.columns
    if move:
        df = stream.df.select(*[F.col(f"`{n}`") for n in names if n != top], new.alias(top))
    else:
        df = stream.df.select(*[new.alias(top) if n == top else F.col(f"`{n}`") for n in names])
    old = stream.facts.at(tuple(path))
    return stream.with_df(df, stream.facts.put(tuple(path), facts(old)))


def comparator(keys: Sequence[Key]) -> Callable[[Column, Column], Column]:
    """Order of two records by directed keys; nulls are least."""

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for name, up in reversed(keys):
            x, y = a[name], b[name]
            less, more = (-1, 1) if up else (1, -1)
            out = (
                F.when(x.isNull() & y.isNotNull(), less)
                .when(x.isNotNull() & y.isNull(), more)
                .when(x < y, less)
                .when(x > y, more)
                .otherwise(out)
            )
        return out

    return compare
