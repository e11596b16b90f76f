"""Sources and sinks with declared schemas."""

from __future__ import annotations

import csv
import io
import os
import subprocess
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import errors as E
from ..operators.mapping import declare, default_value
from ..stream import Facts, Stream, schema_of

Fields = Sequence[tuple[str, Any]]


def emit(spark: SparkSession, fields: Fields, body: Callable[[], Iterable[tuple]] | DataFrame, order_fields: Iterable = (), distinct_fields: Iterable[str] = (), name: str = "emit") -> Stream:
    """A source from a function that yields tuples, or from a DataFrame whose columns take the declared types.

    A DataFrame stays distributed; a function runs on the driver and suits small inputs.
    """
    schema = schema_of(fields)
    if isinstance(body, DataFrame):
        if len(body.columns) != len(schema):
            raise E.InvalidFieldType(f"{len(body.columns)} columns for {len(schema)} declared fields")
        df = declared(body.toDF(*schema.names).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema]), schema)
    else:
        df = spark.createDataFrame(list(body()), schema)
    return declare(Stream(df, Facts(), name), order_fields, distinct_fields)


def declared(df: DataFrame, schema: T.StructType, checked: Sequence[Any] = ()) -> DataFrame:
    """``df`` with the declared not-null fields not null: rows are observed as they pass, and a null in such a field fails the run.

    ``checked`` are further columns to compute for every row, so that pruning can't skip a value that doesn't fit.
    """
    strict = [f for f in schema if not f.nullable]
    checks = [F.sum(F.when(F.col(f"`{f.name}`").isNull(), F.raise_error(F.lit(f"empty value for field `{f.name}`"))).cast("int")).alias(f"none_{i}") for i, f in enumerate(strict)]
    checks += [F.count(c).alias(f"checked_{i}") for i, c in enumerate(checked)]
    if checks:
        df = df.observe(f"declared_{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"), *checks)
    return df.select(*[(F.col(f"`{f.name}`") if f.nullable else _filled(f)).alias(f.name) for f in schema])


def _filled(f: T.StructField) -> Any:
    try:
        return F.coalesce(F.col(f"`{f.name}`"), default_value(f.dataType))
    except E.InvalidFieldType:  # a type without a default stays as it is
        return F.col(f"`{f.name}`")


def produce(spark: SparkSession, fields: Fields, body: Callable[[Callable[[tuple], None]], None], order_fields: Iterable = (), distinct_fields: Iterable[str] = (), name: str = "produce") -> Stream:
    """A source from a function that calls ``send(record)`` for each record."""
    rows: list[tuple] = []
    body(rows.append)
    return emit(spark, fields, lambda: rows, order_fields, distinct_fields, name)


def read_csv(spark: SparkSession, input_file: str, fields: Fields, order_fields: Iterable = (), distinct_fields: Iterable[str] = (), has_headers: bool = False, multi_line: bool = False) -> Stream:
    """A typed CSV scan.  A header must match the declared names exactly and in order; a row that doesn't fit fails the run,
    whichever columns are used later.

    An empty value is the empty string of a not-null string field and null of a nullable one.  Files are split among tasks;
    with ``multi_line`` values may hold line breaks, and a file is read by one task.
    """
    schema = schema_of(fields)
    if has_headers:
        for (line,) in spark.read.text(input_file).limit(1).toLocalIterator():
            head = next(csv.reader(io.StringIO(line)), [])
            if head != schema.names:
                raise E.Other(f"expected header {schema.names}, found {head}")
    open_schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    reader = spark.read.schema(open_schema).option("header", has_headers).option("enforceSchema", False).option("mode", "FAILFAST")
    df = reader.option("escape", '"').option("multiLine", multi_line).option("nullValue", "").csv(input_file)
    filled = [F.coalesce(F.col(f"`{f.name}`"), F.lit("")).alias(f.name) if not f.nullable and isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in schema]
    df = declared(df.select(*filled), schema, [F.col(f"`{f.name}`") for f in schema])
    return declare(Stream(df, Facts(), "read_csv"), order_fields, distinct_fields)


def write_csv(stream: Stream, output_file: str, has_headers: bool = False, single: bool = True) -> None:
    """Writes the stream in its order.  Nested collections are refused.

    ``single`` makes one file at ``output_file`` (parent folders are made): one task writes it.  Otherwise
    ``output_file`` becomes a folder of part files, range-partitioned in the stream's order.
    """
    for f in stream.df.schema:
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            raise E.Other(f"field `{f.name}` is nested and can't be written as CSV")
    df = stream.ordered()
    options = {"header": has_headers, "escape": '"', "emptyValue": "", "nullValue": ""}
    if not single:
        df.write.mode("overwrite").options(**options).csv(output_file)
        return
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(output_file)
    store = path.getFileSystem(conf)
    parent = path.getParent()
    if parent is not None:
        store.mkdirs(parent)
    scratch = jvm.org.apache.hadoop.fs.Path(f"{output_file}.{uuid.uuid4().hex}")
    if stream.facts.order:
        from ..stream import order_columns

        df = stream.df.repartition(1).sortWithinPartitions(*order_columns(stream.facts.order))
    else:
        df = df.coalesce(1)
    df.write.options(**options).csv(scratch.toString())
    parts = [s.getPath() for s in store.listStatus(scratch) if s.getPath().getName().startswith("part-")]
    store.delete(path, True)
    if parts:
        store.rename(parts[0], path)
    else:
        store.create(path).close()
    store.delete(scratch, True)


#: The fields that a commit has, with git's placeholder.
COMMIT_FIELDS = {
    "id": ("String", "%H"), "author": ("String", "%an <%ae>"), "author_name": ("Option<String>", "%an"), "author_email": ("Option<String>", "%ae"),
    "committer": ("String", "%cn <%ce>"), "committer_name": ("Option<String>", "%cn"), "committer_email": ("Option<String>", "%ce"),
    "message": ("Option<String>", "%B"), "summary": ("Option<String>", "%s"), "body": ("Option<String>", "%b"),
    "time_seconds": ("i64", "%ct"), "time_offset_minutes": ("i32", "%ci"),
}


def walk_commits(spark: SparkSession, repository: str, fields: Sequence[str], pushes: Sequence[str] = ("HEAD",), hides: Sequence[str] = ()) -> Stream:
    """Commits that are reachable from ``pushes`` and not from ``hides``; no facts."""
    for n, f in enumerate(fields):
        if f not in COMMIT_FIELDS:
            raise E.FieldNotFound(f"commits have no field `{f}`")
        if f in fields[:n]:
            raise E.FieldAlreadyExistsInStream(f"field `{f}` already exists in stream")
    # Fields end with NUL, which no commit can hold; every commit has as many as there are fields.
    layout = "%x00".join(COMMIT_FIELDS[f][1] for f in fields)

    def git(*command: str) -> bytes:
        done = subprocess.run(["git", "-C", repository, *command], capture_output=True)
        if done.returncode:
            raise E.Other(done.stderr.decode(errors="replace").strip())
        return done.stdout

    def resolved(names: Sequence[str]) -> list[str]:
        """Revisions as object names: nothing that is passed on can be taken for an option."""
        return [git("rev-parse", "--verify", "--quiet", "--end-of-options", f"{n}^{{commit}}").decode().strip() for n in names]

    def rows() -> Iterator[tuple]:
        starts, ends = resolved(pushes), resolved(hides)
        if not starts:
            return
        out = git("log", "-z", "--encoding=UTF-8", f"--format=tformat:{layout}", *starts, *[f"^{h}" for h in ends])
        values = out.decode(errors="replace").split("\0")[:-1]
        for at in range(0, len(values), len(fields)):
            yield tuple(_commit_value(f, v) for f, v in zip(fields, values[at : at + len(fields)], strict=True))

    return emit(spark, [(f, COMMIT_FIELDS[f][0]) for f in fields], rows, name="walk_commits")


def _commit_value(field: str, text: str) -> Any:
    if field == "time_seconds":
        return int(text)
    if field == "time_offset_minutes":
        zone = text.rsplit(" ", 1)[1]
        return (-1 if zone[0] == "-" else 1) * (60 * int(zone[1:3]) + int(zone[3:5]))
    if field == "body":
        return text.strip("\n") or None
    return text


def read_lines(spark: SparkSession, path: str, field: str) -> Stream:
    """One row a line of text files."""
    return Stream(spark.read.text(path).select(F.coalesce("value", F.lit("")).alias(field)), Facts(), "read_lines")


def walk_directory(spark: SparkSession, root: str) -> Stream:
    """id, file_name, path, parent_id of a folder and all below it; ordered by and distinct in id."""

    def rows() -> Iterator[tuple]:
        seen: dict[str, int] = {}
        for at, folders, files in os.walk(root):
            folders.sort()
            if at not in seen:
                seen[at] = len(seen)
                yield seen[at], os.path.basename(at), at, None
            for name in [*folders, *sorted(files)]:
                path = os.path.join(at, name)
                seen[path] = len(seen)
                yield seen[path], name, path, seen[at]

    return emit(spark, [("id", "usize"), ("file_name", "String"), ("path", "String"), ("parent_id", "Option<usize>")], rows, ["id"], ["id"], "walk_directory")


def read_jdbc(spark: SparkSession, url: str, table: str, fields: Fields, **options: str) -> Stream:
    """A typed JDBC scan; pass ``partitionColumn`` and bounds in ``options`` to read in parallel."""
    schema = schema_of(fields)
    df = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return Stream(df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]), Facts(), "read_jdbc")


def write_jdbc(stream: Stream, url: str, table: str, **options: str) -> None:
    stream.df.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()


def terminate(*streams: Stream, body: Callable[..., Any]) -> Any:
    """A sink: ``body`` gets an ordered row iterator for each stream, fetched a partition at a time."""
    if not streams:
        raise E.UnexpectedNumberOfStreams("terminate needs a stream")
    return body(*[s.ordered().toLocalIterator() for s in streams])
