"""Streams: a DataFrame with what is known about its order and distinctness."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import errors as E

Key = tuple[str, bool]  # field, ascending


def directed(fields: Iterable[Any]) -> tuple[Key, ...]:
    """``"f"``, ``("f", "asc"|"desc")`` or ``{"Descending": "f"}`` -> keys; repeats after the first are dropped."""
    keys: dict[str, bool] = {}
    for f in fields:
        if isinstance(f, str):
            m = re.fullmatch(r"\s*(Ascending|Descending)\(\s*\"?(\w+)\"?\s*\)\s*", f)
            name, up = (m[2], m[1] == "Ascending") if m else (f, True)
        elif isinstance(f, Mapping):
            ((way, name),) = f.items()
            up = way == "Ascending"
        else:
            name, way = f
            up = way in (True, "asc", "Ascending")
        keys.setdefault(name, up)
    return tuple(keys.items())


@dataclass(frozen=True)
class Facts:
    """``order``: keys the rows are sorted by; ``distinct``: fields no two rows agree in; ``sub``: facts of nested collections."""

    order: tuple[Key, ...] = ()
    distinct: tuple[str, ...] = ()
    sub: Mapping[str, Facts] = field(default_factory=dict)

    def touched(self, fields: Iterable[str], keep_distinct: bool = False) -> Facts:
        """After the values of ``fields`` changed: order ends before the first of them."""
        gone = set(fields)
        order: list[Key] = []
        for k in self.order:
            if k[0] in gone:
                break
            order.append(k)
        distinct = self.distinct if keep_distinct or not gone & set(self.distinct) else ()
        return replace(self, order=tuple(order), distinct=distinct)

    def without(self, fields: Iterable[str]) -> Facts:
        """After ``fields`` were removed or renamed."""
        f = self.touched(fields)
        gone = set(fields)
        return replace(f, sub={k: v for k, v in f.sub.items() if k not in gone})

    def at(self, path: tuple[str, ...]) -> Facts:
        return self.sub.get(path[0], Facts()).at(path[1:]) if path else self

    def put(self, path: tuple[str, ...], facts: Facts) -> Facts:
        if not path:
            return facts
        return replace(self, sub={**self.sub, path[0]: self.sub.get(path[0], Facts()).put(path[1:], facts)})


@dataclass(frozen=True)
class Stream:
    """An immutable typed stream. ``df`` is lazy and in no order: ``ordered()`` sorts it where order is observed."""

    df: DataFrame
    facts: Facts = Facts()
    name: str = "stream"

    @property
    def fields(self) -> list[str]:
        return self.df.columns

    def with_df(self, df: DataFrame, facts: Facts | None = None, name: str | None = None) -> Stream:
        check_names(df.columns)
        return Stream(df, self.facts if facts is None else facts, name or self.name)

    def apply(self, op: Callable[..., Any], *args: Any, **params: Any) -> Any:
        return op(self, *args, **params)

    def ordered(self) -> DataFrame:
        """The rows in the order of the facts (as they are without such a fact)."""
        return self.df.orderBy(*order_columns(self.facts.order)) if self.facts.order else self.df

    def require(self, fields: Iterable[str]) -> None:
        for f in fields:
            if f not in self.df.columns:
                raise E.FieldNotFoundInStream(f"field `{f}` not found in stream `{self.name}`; it has {self.df.columns}")


def order_columns(keys: Iterable[Key]) -> list[Column]:
    """Sort columns: null first ascending, null last descending."""
    return [F.col(f"`{f}`").asc_nulls_first() if up else F.col(f"`{f}`").desc_nulls_last() for f, up in keys]


def check_names(names: Iterable[str]) -> None:
    seen: set[str] = set()
    for n in names:
        if not re.fullmatch(r"[^\W\d]\w*", n):
            raise E.InvalidFieldName(f"`{n}` is not a valid field name")
        if n.lower() in seen:
            raise E.FieldAlreadyExistsInStream(f"field `{n}` already exists in stream")
        seen.add(n.lower())


#: Names of scalar types and what stands for them.
SCALARS = {
    "u8": T.ShortType(), "i8": T.ByteType(), "u16": T.IntegerType(), "i16": T.ShortType(), "u32": T.LongType(), "i32": T.IntegerType(),
    "u64": T.DecimalType(20, 0), "i64": T.LongType(), "usize": T.LongType(), "isize": T.LongType(), "f32": T.FloatType(), "f64": T.DoubleType(),
    "bool": T.BooleanType(), "char": T.StringType(), "String": T.StringType(), "Box<str>": T.StringType(), "str": T.StringType(),
}


def field_type(name: str | T.DataType) -> tuple[T.DataType, bool]:
    """(Spark type, nullable) of a declared type: a scalar's name, ``Option<..>``, or a Spark type or its DDL."""
    if isinstance(name, T.DataType):
        return name, True
    text = name.strip()
    if m := re.fullmatch(r"Option<(.+)>", text):
        return field_type(m[1])[0], True
    if text.replace(" ", "") in SCALARS:
        return SCALARS[text.replace(" ", "")], False
    if re.fullmatch(r"AnchorId<.*>", text):
        return T.LongType(), False
    try:
        return T.DataType.fromDDL(text), True
    except Exception as cause:
        raise E.InvalidFieldType(f"invalid field type `{name}`") from cause


def schema_of(fields: Iterable[tuple[str, str | T.DataType]]) -> T.StructType:
    """A declared schema; types without ``Option`` are not nullable."""
    listed = list(fields)
    check_names(n for n, _ in listed)
    return T.StructType([T.StructField(n, *field_type(t)) for n, t in listed])
