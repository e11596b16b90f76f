"""Projection, mapping, forks, positions, and the transform framework."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import errors as E
from ..paths import lift, nested_type
from ..stream import Facts, Stream, order_columns

_tables = 0


def update(stream: Stream, remove_fields: Sequence[str] = (), add_fields: Mapping[str, Column] | None = None, body: Callable[[DataFrame], DataFrame] | None = None) -> Stream:
    """Removes and adds fields (added ones stand last, in order), and/or applies a whole-stream ``body``.

    Facts on fields that stay are kept; a body that reorders or repeats rows must restate them with ``declare``.
    """
    stream.require(remove_fields)
    added = dict(add_fields or {})
    for name in added:
        if name in stream.fields and name not in remove_fields:
            raise E.FieldAlreadyExistsInStream(f"field `{name}` already exists in stream")
    kept = [F.col(f"`{c}`") for c in stream.fields if c not in remove_fields]
    df = stream.df.select(*kept, *[c.alias(n) for n, c in added.items()])
    facts = stream.facts.without(remove_fields)
    if body:
        df = body(df)
        gone = [c for c in stream.fields if c not in df.columns]
        facts = facts.without(gone)
    return stream.with_df(df, facts)


def declare(stream: Stream, order_fields: Iterable = (), distinct_fields: Iterable[str] = ()) -> Stream:
    """States order and distinctness that the caller knows of."""
    from ..stream import directed

    keys, distinct = directed(order_fields), tuple(dict.fromkeys(distinct_fields))
    stream.require([*(k for k, _ in keys), *distinct])
    return replace(stream, facts=replace(stream.facts, order=keys, distinct=distinct))


def where(stream: Stream, condition: Column | str) -> Stream:
    """Rows that satisfy ``condition``; all facts hold on."""
    return stream.with_df(stream.df.where(condition))


def extract_fields(stream: Stream, fields: Sequence[str]) -> tuple[Stream, Stream]:
    """(the stream as it is, a stream of ``fields`` in that order, without facts)."""
    stream.require(fields)
    return stream, Stream(stream.df.select(*fields), Facts(), f"{stream.name}.extracted")


def pipe(stream: Stream) -> Stream:
    """The stream itself."""
    return stream


def accumulate(stream: Stream) -> Stream:
    """The stream, kept in memory and on disk so that several consumers compute it once."""
    return stream.with_df(stream.df.persist(StorageLevel.MEMORY_AND_DISK))


def debug(stream: Stream, out=None) -> Stream:
    """The stream itself; prints fields and facts, nested ones too, while the pipeline is built."""

    def show(kind: T.StructType, facts: Facts, indent: str) -> None:
        for f in kind.fields:
            print(f"{indent}{f.name}: {f.dataType.simpleString()}{'' if f.nullable else ' not null'}", file=out or sys.stderr)
            inner = getattr(f.dataType, "elementType", None)
            if isinstance(inner, T.StructType):
                show(inner, facts.sub.get(f.name, Facts()), indent + "  ")
        print(f"{indent}order: {list(facts.order)}, distinct: {list(facts.distinct)}", file=out or sys.stderr)

    show(stream.df.schema, stream.facts, "")
    return stream


def anchor(stream: Stream, anchor_field: str) -> Stream:
    """Appends a dense number from 0 in the stream's order.

    Needs an order fact.  Without a single-task window: range partitions in that order are counted, and a row's
    number is its place in its partition plus the rows of earlier ones.  Rows that tie in the order are numbered in
    either order.
    """
    global _tables
    if anchor_field in stream.fields:
        raise E.FieldAlreadyExistsInStream(f"field `{anchor_field}` already exists in stream")
    if not stream.facts.order:
        raise E.ExpectedMinimalOrder("anchor needs an ordered stream")
    number = dense_numbers(stream.df, stream.facts.order, anchor_field)
    _tables += 1
    meta = {"anchor_table": _tables}
    df = number.withColumn(anchor_field, F.col(anchor_field).alias(anchor_field, metadata=meta))
    return stream.with_df(df)


def dense_numbers(df: DataFrame, keys: Sequence, name: str, ties: Sequence[str] = ()) -> DataFrame:
    """``df`` with 0-based numbers in the order of ``keys``, then of the columns ``ties``.

    One shuffle: range partitions are sorted, and a row's number is its place in its partition plus the rows
    of earlier ones.  The places come from ``monotonically_increasing_id``, the rest from a count a partition.  The sorted rows are written
    to the checkpoint folder where there is one, else kept in memory and on disk, as counting and numbering must see the same partitions.
    """
    order = [*order_columns(keys), *[F.col(f"`{c}`").asc_nulls_first() for c in ties]]
    part, place, p, offset = (_free(df, c) for c in ("_part", "_place", "_p", "_offset"))
    split = df.repartitionByRange(*order).sortWithinPartitions(*order)
    split = split.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    if df.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir"):
        _checkpoint_folder(df)
        split = split.checkpoint()
    else:
        split = split.persist(StorageLevel.MEMORY_AND_DISK)
    before = Window.partitionBy(F.lit(0)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = split.groupBy(part).count()  # a row a partition
    offsets = counts.select(F.col(part).alias(p), F.coalesce(F.sum("count").over(before), F.lit(0)).alias(offset))
    out = split.join(F.broadcast(offsets), F.col(part) == F.col(p))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(offset) + F.col(place)).cast("long").alias(name))


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name = "_" + name
    return name


def _checkpoint_folder(df: DataFrame) -> None:
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir"))


@dataclass(frozen=True)
class Transform:
    """A per-field operation: ``expr`` makes the new value, ``facts`` says what remains known of changed fields.

    ``moves`` marks a change of type: such a field becomes its record's last.
    """

    expr: Callable[[Column], Column]
    facts: Callable[[Facts, Sequence[str]], Facts]
    accepts: Callable[[T.DataType], bool] = lambda t: True
    moves: bool = False

    def _check(self, kind: T.StructType, fields: Sequence[str]) -> None:
        for f in fields:
            if f not in kind.names:
                raise E.FieldNotFoundInStream(f"field `{f}` not found")
            if not self.accepts(kind[f].dataType):
                raise E.InvalidFieldType(f"field `{f}` has type {kind[f].dataType.simpleString()}")

    def _layout(self, names: Sequence[str], fields: Sequence[str]) -> list[str]:
        return [n for n in names if n not in fields] + list(fields) if self.moves else list(names)

    def apply(self, stream: Stream, fields: Sequence[str]) -> Stream:
        self._check(stream.df.schema, fields)
        cols = [(self.expr(F.col(f"`{n}`")) if n in fields else F.col(f"`{n}`")).alias(n) for n in self._layout(stream.fields, fields)]
        return stream.with_df(stream.df.select(*cols), self.facts(stream.facts, fields))

    def apply_nested(self, stream: Stream, path_fields: Sequence[str], fields: Sequence[str]) -> Stream:
        self._check(nested_type(stream.df.schema, path_fields), fields)

        def fn(array: Column, kind: T.StructType) -> Column:
            return F.transform(array, lambda x: F.struct(*[(self.expr(x[n]) if n in fields else x[n]).alias(n) for n in self._layout(kind.names, fields)]))

        return lift(stream, path_fields, fn, lambda f: self.facts(f, fields), move=self.moves)


def _is_string(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType)


TO_LOWERCASE = Transform(F.lower, lambda f, names: f.touched(names), _is_string)
REVERSE_CHARS = Transform(F.reverse, lambda f, names: f.touched(names, keep_distinct=True), _is_string)


def to_lowercase(stream: Stream, fields: Sequence[str]) -> Stream:
    """Full Unicode lower case, in place; null stays null."""
    return TO_LOWERCASE.apply(stream, fields)


def sub_to_lowercase(stream: Stream, path_fields: Sequence[str], fields: Sequence[str]) -> Stream:
    return TO_LOWERCASE.apply_nested(stream, path_fields, fields)


def reverse_chars(stream: Stream, fields: Sequence[str]) -> Stream:
    """Characters in reverse, by code point; distinct values stay distinct."""
    return REVERSE_CHARS.apply(stream, fields)


def sub_reverse_chars(stream: Stream, path_fields: Sequence[str], fields: Sequence[str]) -> Stream:
    return REVERSE_CHARS.apply_nested(stream, path_fields, fields)


def unwrap(stream: Stream, fields: Sequence[str], skip_nones: bool) -> Stream:
    """Nullable fields become not null and move last: rows with a null go, or the run fails.

    The failing form observes the rows as they pass (an observation is never optimised away), so it also fails when a later filter would hide the row.
    """
    stream.require(fields)
    _unwrappable(stream.df.schema, fields)
    df = stream.df
    if skip_nones:
        for f in fields:
            df = df.where(F.col(f"`{f}`").isNotNull())
    else:
        checks = [F.sum(F.when(F.col(f"`{f}`").isNull(), F.raise_error(F.lit(f"found None for field `{f}`"))).cast("int")).alias(f"none_{i}") for i, f in enumerate(fields)]
        df = df.observe(f"unwrap_{id(df)}", F.count(F.lit(1)).alias("rows"), *checks)
    rest = [F.col(f"`{c}`") for c in stream.fields if c not in fields]
    new = [_not_null(F.col(f"`{f}`"), df.schema[f].dataType).alias(f) for f in fields]
    return stream.with_df(df.select(*rest, *new))


def sub_unwrap(stream: Stream, path_fields: Sequence[str], fields: Sequence[str], skip_nones: bool) -> Stream:
    """The same within a nested collection; a record whose collection becomes empty stays."""
    kind = nested_type(stream.df.schema, path_fields)
    for f in fields:
        if f not in kind.names:
            raise E.FieldNotFoundInStream(f"field `{f}` not found")
    _unwrappable(kind, fields)
    if not skip_nones:
        bad = None
        for f in fields:
            missing = _exists(F.col(f"`{path_fields[0]}`"), path_fields[1:], f)
            check = F.sum(F.when(missing, F.raise_error(F.lit(f"found None for field `{f}`"))).cast("int")).alias(f"none_{f}")
            bad = [*(bad or []), check]
        stream = stream.with_df(stream.df.observe(f"sub_unwrap_{id(stream)}", F.count(F.lit(1)).alias("rows"), *bad))

    def fn(array: Column, kind: T.StructType) -> Column:
        keep = array
        for f in fields:
            keep = F.filter(keep, _has(f))
        order = [n for n in kind.names if n not in fields] + list(fields)
        return F.transform(keep, lambda x: F.struct(*[(_not_null(x[n], kind[n].dataType) if n in fields else x[n]).alias(n) for n in order]))

    return lift(stream, path_fields, fn, lambda f: f, move=True)


def _has(name: str) -> Callable[[Column], Column]:
    return lambda x: x[name].isNotNull()


def _exists(array: Column, rest: Sequence[str], name: str) -> Column:
    return F.exists(array, lambda x: _exists(x[rest[0]], rest[1:], name) if rest else x[name].isNull())


def _unwrappable(kind: T.StructType, fields: Sequence[str]) -> None:
    for f in fields:
        if not kind[f].nullable or isinstance(kind[f].dataType, T.ArrayType):
            raise E.InvalidFieldType(f"field `{f}` is not optional")


def _not_null(value: Column, kind: T.DataType) -> Column:
    return F.coalesce(value, default_value(kind))


def default_value(kind: T.DataType) -> Column:
    """The default of a type: 0, false, the empty string, an empty collection."""
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    if isinstance(kind, T.StructType):
        return F.struct(*[default_value(f.dataType).alias(f.name) for f in kind.fields])
    raise E.InvalidFieldType(f"type {kind.simpleString()} has no default")
