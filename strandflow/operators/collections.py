"""Sorting, de-duplication, grouping into nested collections, and the left join."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import errors as E
from ..paths import comparator, lift, nested_type
from ..stream import Facts, Key, Stream, directed
from .mapping import default_value, dense_numbers


def sort(stream: Stream, fields: Sequence[Any]) -> Stream:
    """States the order; rows are sorted where an operator or sink observes order, so sorts never stack up."""
    keys = directed(fields)
    stream.require(k for k, _ in keys)
    return replace(stream, facts=replace(stream.facts, order=keys))


def sub_sort(stream: Stream, path_fields: Sequence[str], fields: Sequence[Any]) -> Stream:
    """Sorts each nested collection; nulls are least."""
    keys = directed(fields)
    kind = nested_type(stream.df.schema, path_fields)
    for f, _ in keys:
        if f not in kind.names:
            raise E.FieldNotFoundInStream(f"field `{f}` not found")
    return lift(stream, path_fields, lambda a, k: sorted_array(a, k, keys), lambda f: replace(f, order=keys), move=False)


def sorted_array(array: Column, kind: T.StructType, keys: Sequence[Key]) -> Column:
    """A sorted collection.  If the keys ascend, records are re-laid with the keys in front and sorted natively, without a comparator."""
    if not keys:
        return array
    names = [k for k, _ in keys]
    if len({up for _, up in keys}) == 1 and all(_orderable(f.dataType) for f in kind.fields):
        laid = F.transform(array, lambda x: F.struct(*[x[n].alias(n) for n in names], *[x[n].alias(n) for n in kind.names if n not in names]))
        back = F.sort_array(laid, asc=keys[0][1])
        return F.transform(back, lambda x: F.struct(*[x[n].alias(n) for n in kind.names]))
    return F.array_sort(array, comparator(keys))


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, T.MapType)


def dedup(stream: Stream, positional: bool = False, leaving: Sequence[str] = ()) -> Stream:
    """Drops rows equal to the row before them in all fields.

    If the order covers all fields, equal rows are neighbours and this is a hash-distributed distinct.  Otherwise
    neighbours are a matter of position: pass ``positional`` (the stream needs an order fact), and only rows equal to their
    predecessor in that order go.  Fields ``leaving`` order the rows but are removed before rows are compared, so equal rows may
    stand apart and stay; no order is known afterwards.
    """
    stream.require(leaving)
    if leaving and not positional:
        raise E.ExpectedMinimalOrder("leaving fields needs positional=True")
    covered = {k for k, _ in stream.facts.order} >= set(stream.fields)
    if covered and not leaving:
        return stream.with_df(stream.df.dropDuplicates(), replace(stream.facts, distinct=tuple(stream.fields)))
    if not positional:
        raise E.ExpectedMinimalOrder("dedup needs an order of all fields, or positional=True")
    if not stream.facts.order:
        raise E.ExpectedMinimalOrder("positional dedup needs an ordered stream")
    # Each row meets its predecessor by number: an equi-join, not a window in one task.  Ties stand in order of the other
    # fields, so that both sides of the join number them alike.
    at, following, earlier = "_at", "_next", "_before"
    fields = [f for f in stream.fields if f not in leaving]
    keys = {k for k, _ in stream.facts.order}
    ties = [f.name for f in stream.df.schema if f.name not in keys and _orderable(f.dataType)]
    numbered = dense_numbers(stream.df, stream.facts.order, at, ties)
    before = numbered.select((F.col(at) + 1).alias(following), F.struct(*fields).alias(earlier))
    same = F.struct(*fields).eqNullSafe(F.col(earlier))
    df = numbered.join(before, F.col(at) == F.col(following), "left").where(F.col(following).isNull() | ~same).select(*fields)
    return stream.with_df(df, stream.facts.without(leaving)) if leaving else stream.with_df(df)


def sub_dedup(stream: Stream, path_fields: Sequence[str]) -> Stream:
    """Drops neighbours that are equal in all fields from each nested collection."""

    def fn(array: Column, kind: T.StructType) -> Column:
        none = F.array().cast(T.ArrayType(kind, False))
        if not kind.names:
            return F.slice(array, 1, 1)
        paired = F.transform(array, lambda x, i: F.struct(x.alias("x"), F.when(i > 0, F.try_element_at(array, i)).alias("p"), i.alias("i")))
        kept = F.filter(paired, lambda q: (q["i"] == 0) | ~q["x"].eqNullSafe(q["p"]))
        return F.coalesce(F.transform(kept, lambda q: q["x"]), none)

    kind = nested_type(stream.df.schema, path_fields)
    return lift(stream, path_fields, fn, lambda f: replace(f, distinct=tuple(kind.names)), move=False)


def _key_order(order: Sequence[Key], by: Sequence[str], what: str) -> None:
    if {k for k, _ in order[: len(by)]} != set(by):
        raise E.ExpectedMinimalOrder(f"{what} by {list(by)} needs them as the first order fields; the order is {list(order)}")


def _group_facts(facts: Facts, by: Sequence[str], inner: Sequence[str], group_field: str) -> Facts:
    nested = Facts(tuple(k for k in facts.order[len(by) :]), tuple(d for d in facts.distinct if d in inner), {k: v for k, v in facts.sub.items() if k in inner})
    return Facts(tuple(facts.order[: len(by)]), tuple(by), {**{k: v for k, v in facts.sub.items() if k in by}, group_field: nested})


def group(stream: Stream, by_fields: Sequence[str], group_field: str) -> Stream:
    """One row for each key, with all other fields of its rows as a nested collection in ``group_field``.

    Needs an order that starts with the keys; the collection stands in the rest of that order.  Null keys are a group.
    Without keys the whole stream is one group, and no row makes no group.  A group is one record: its rows must fit in a task.
    """
    stream.require(by_fields)
    _key_order(stream.facts.order, by_fields, "group")
    names = stream.fields
    by = [n for n in names if n in by_fields]
    inner = [n for n in names if n not in by_fields]
    if group_field in by:
        raise E.FieldAlreadyExistsInStream(f"field `{group_field}` already exists in stream")
    item = F.struct(*[F.col(f"`{n}`").alias(n) for n in inner])
    keys = [F.col(f"`{n}`") for n in by] or [F.lit(1).alias("_all")]
    df = stream.df.groupBy(*keys).agg(F.collect_list(item).alias(group_field))
    kind = T.StructType([stream.df.schema[n] for n in inner])
    rest = tuple(stream.facts.order[len(by_fields) :])
    df = df.select(*[F.col(f"`{n}`") for n in by], sorted_array(F.col(f"`{group_field}`"), kind, rest).alias(group_field))
    return stream.with_df(df, _group_facts(stream.facts, by_fields, inner, group_field))


def sub_group(stream: Stream, path_fields: Sequence[str], by_fields: Sequence[str], group_field: str) -> Stream:
    """Groups within each nested collection, which must be ordered by the keys first."""
    kind = nested_type(stream.df.schema, path_fields)
    for f in by_fields:
        if f not in kind.names:
            raise E.FieldNotFoundInStream(f"field `{f}` not found")
    _key_order(stream.facts.at(tuple(path_fields)).order, by_fields, "sub_group")
    by = [n for n in kind.names if n in by_fields]
    inner = [n for n in kind.names if n not in by_fields]

    def fn(array: Column, kind: T.StructType) -> Column:
        key = lambda x: F.struct(*[x[n].alias(n) for n in by])
        size = F.size(array)
        if not by:
            whole = F.array(F.struct(F.transform(array, lambda x: F.struct(*[x[n].alias(n) for n in inner])).alias(group_field)))
            return F.when(size > 0, whole).otherwise(F.filter(whole, lambda _: F.lit(False)))
        # Starts of runs of equal keys, then a slice for each run: linear in the collection, not in groups times it.
        starts = F.filter(
            F.transform(array, lambda x, i: F.when((i == 0) | ~key(x).eqNullSafe(key(F.try_element_at(array, F.greatest(i, F.lit(1))))), i + 1)),
            lambda i: i.isNotNull(),
        )
        # The starts are bound to a variable: evaluated once, not again for each of them.
        spans = lambda at: F.transform(at, lambda s, n: F.struct(s.alias("s"), F.coalesce(F.try_element_at(at, n + 2), size + 1).alias("e")))

        def one(q: Column) -> Column:
            part = F.slice(array, q["s"], q["e"] - q["s"])
            head = F.element_at(array, q["s"])
            nested = F.transform(part, lambda x: F.struct(*[x[n].alias(n) for n in inner]))
            return F.struct(*[head[n].alias(n) for n in by], nested.alias(group_field))

        return F.get(F.transform(F.array(starts), lambda at: F.transform(spans(at), one)), F.lit(0))

    return lift(stream, path_fields, fn, lambda f: _group_facts(f, by_fields, inner, group_field), move=True)


def ungroup(stream: Stream, group_field: str) -> Stream:
    """Flattens a nested collection; a row of an empty one vanishes. Inner fields stand last; no facts remain."""
    kind = nested_type(stream.df.schema, [group_field])
    rest = [n for n in stream.fields if n != group_field]
    for n in kind.names:
        if n in rest:
            raise E.FieldAlreadyExistsInStream(f"field `{n}` already exists in stream")
    df = stream.df.select(*rest, F.explode(f"`{group_field}`").alias("_g")).select(*rest, *[F.col("_g")[n].alias(n) for n in kind.names])
    return stream.with_df(df, Facts())


def sub_ungroup(stream: Stream, path_fields: Sequence[str], group_field: str) -> Stream:
    """Flattens a collection inside the records of a nested collection."""
    kind = nested_type(stream.df.schema, path_fields)
    inner = nested_type(kind, [group_field])
    rest = [n for n in kind.names if n != group_field]
    for n in inner.names:
        if n in rest:
            raise E.FieldAlreadyExistsInStream(f"field `{n}` already exists in stream")

    def fn(array: Column, kind: T.StructType) -> Column:
        flat = lambda r: F.transform(r[group_field], lambda x: F.struct(*[r[n].alias(n) for n in rest], *[x[n].alias(n) for n in inner.names]))
        return F.flatten(F.transform(array, flat))

    return lift(stream, path_fields, fn, lambda _: Facts(), move=True)


def join(primary: Stream, secondary: Stream, primary_fields: Sequence[str], secondary_fields: Sequence[str], check_unique: bool = False) -> Stream:
    """Left join one to one; nulls match nulls, and unmatched rows get the defaults of not-null fields (null for nullable ones).

    Both streams must be ordered ascending with the keys first and distinct in exactly the keys.  The secondary's other fields
    are appended.  With ``check_unique`` a repeated secondary key fails the run.
    """
    primary.require(primary_fields)
    secondary.require(secondary_fields)
    if len(primary_fields) != len(secondary_fields):
        raise E.ParseParams("join needs as many secondary fields as primary ones")
    for s, by in ((primary, primary_fields), (secondary, secondary_fields)):
        head = s.facts.order[: len(by)]
        if {k for k, _ in head} != set(by) or not all(up for _, up in head):
            raise E.ExpectedMinimalOrder(f"join needs `{s.name}` ordered ascending by {list(by)}; the order is {list(s.facts.order)}")
        if set(s.facts.distinct) != set(by):
            raise E.ExpectedDistinct(f"join needs `{s.name}` distinct in {list(by)}; it is distinct in {list(s.facts.distinct)}")
    extra = [f for f in secondary.df.schema.fields if f.name not in secondary_fields]
    for f in extra:
        if f.name in primary.fields:
            raise E.FieldAlreadyExistsInStream(f"field `{f.name}` already exists in stream")
        if (f.metadata or {}).get("anchor_table"):
            raise E.InvalidFieldType(f"anchor field `{f.name}` has no default")
    if not extra:
        return primary
    right = secondary.df
    if check_unique:
        right = _assert_unique(right, secondary_fields)
    keyed = right.select(*[F.col(f"`{s}`").alias(f"_key{i}") for i, s in enumerate(secondary_fields)], *[F.col(f"`{f.name}`") for f in extra], F.lit(True).alias("_match"))
    on = F.lit(True)
    for i, p in enumerate(primary_fields):
        on = on & F.col(f"`{p}`").eqNullSafe(F.col(f"_key{i}"))
    df = primary.df.join(keyed, on, "left")
    value = lambda f: F.col(f"`{f.name}`") if f.nullable and not isinstance(f.dataType, T.ArrayType) else F.coalesce(F.col(f"`{f.name}`"), default_value(f.dataType))
    df = df.select(*[F.col(f"`{c}`") for c in primary.fields], *[value(f).alias(f.name) for f in extra])
    return primary.with_df(df)


def _assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    many = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    checked = df.withColumn("_many", many)
    checked = checked.observe(f"unique_{id(df)}", F.sum(F.when(F.col("_many") > 1, F.raise_error(F.lit("repeated join key"))).cast("int")).alias("bad"))
    return checked.drop("_many")
