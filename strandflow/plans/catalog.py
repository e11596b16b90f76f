"""Queries over the driver's tables that exercise every operator, each with its SQL."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import errors as E
from ..functions.text import group_size, tokenize
from ..operators import collections as C
from ..operators import mapping as M
from ..sources.connectors import emit, produce, read_csv, read_lines, terminate, write_csv
from ..stream import Facts, Stream
from .pipeline import Pipeline
from .wordlist import build_word_list


def _t(spark: SparkSession, sf: str, name: str, *cols: str) -> Stream:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return Stream(df.select(*cols) if cols else df, Facts(), name)


def _lines(spark, sf) -> Stream:
    """Lines of each order as a collection, ordered by line number."""
    s = _t(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity")
    return C.group(C.sort(s, ["l_orderkey", "l_linenumber"]), ["l_orderkey"], "lines")


def _words(spark, sf) -> Stream:
    s = tokenize(M.update(_t(spark, sf, "documents", "text"), ["text"], {"words": F.col("text")}))
    s = M.update(s, ["first_char"])
    return M.anchor(C.dedup(C.sort(s, ["word"])), "word_id")


def _shared(spark) -> str:
    """The folder that all executors share; a local one only for a local master."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise E.Other("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="strandflow-")
    return base.rstrip("/")


def _word_list(spark, sf):
    return build_word_list(_words(spark, sf), "word", "word_id", "ci_id", "refs")


def sort_rank(spark, sf):
    return M.anchor(C.sort(_t(spark, sf, "part", "p_partkey", "p_name"), ["p_name", ("p_partkey", "desc")]), "rank").df


def dedup_sorted(spark, sf):
    return C.dedup(C.sort(_t(spark, sf, "orders", "o_orderpriority", "o_orderstatus"), ["o_orderpriority", "o_orderstatus"])).df


def dedup_adjacent(spark, sf):
    """Event types in the order of their ids, without those equal to the one before: equal types that stand apart stay."""
    s = C.sort(_t(spark, sf, "events", "event_id", "event_type"), ["event_id"])
    return C.dedup(s, positional=True, leaving=["event_id"]).df


def dedup_positional(spark, sf):
    """Order statuses in order of decades of keys, falling, and keys: neighbours equal in status and decade once."""
    s = M.update(_t(spark, sf, "orders", "o_orderkey", "o_orderstatus"), [], {"decade": F.expr("o_orderkey div 40")})
    s = C.sort(M.update(s), [("decade", "desc"), "o_orderkey"])
    return C.dedup(s, positional=True, leaving=["o_orderkey"]).df


def group_orders(spark, sf):
    s = C.group(C.sort(_t(spark, sf, "orders", "o_custkey", "o_orderkey"), ["o_custkey", ("o_orderkey", "desc")]), ["o_custkey"], "orders")
    return s.df.select("o_custkey", F.size("orders").cast("long").alias("n"), F.array_join(F.col("orders.o_orderkey").cast("array<string>"), ",").alias("keys"))


def group_all(spark, sf):
    s = C.group(C.sort(_t(spark, sf, "nation", "n_nationkey"), ["n_nationkey"]), [], "all")
    return s.df.select(F.size("all").cast("long").alias("n"))


def group_empty_input(spark, sf):
    s = M.where(_t(spark, sf, "nation", "n_nationkey"), "n_nationkey < 0")
    return group_size(C.group(C.sort(s, ["n_nationkey"]), [], "all"), "all", "n").df.select("n")


def group_key_only(spark, sf):
    s = C.group(C.sort(_t(spark, sf, "customer", "c_mktsegment"), ["c_mktsegment"]), ["c_mktsegment"], "g")
    return s.df.select("c_mktsegment", F.size("g").cast("long").alias("n"))


def sub_sort_lines(spark, sf):
    s = C.sub_sort(_lines(spark, sf), ["lines"], [("l_quantity", "desc"), "l_linenumber"])
    return s.df.select("l_orderkey", F.array_join(F.col("lines.l_linenumber").cast("array<string>"), ",").alias("numbers"))


def _sub_grouped(spark, sf):
    s = C.sub_sort(_lines(spark, sf), ["lines"], ["l_returnflag", "l_linestatus", "l_linenumber"])
    return C.sub_group(s, ["lines"], ["l_returnflag"], "flagged")


def sub_group_lines(spark, sf):
    s = C.ungroup(_sub_grouped(spark, sf), "lines")
    return s.df.select("l_orderkey", "l_returnflag", F.array_join(F.col("flagged.l_linenumber").cast("array<string>"), ",").alias("numbers"))


def sub_group_lines_2(spark, sf):
    s = C.sub_group(_sub_grouped(spark, sf), ["lines", "flagged"], ["l_linestatus"], "stated")
    s = C.ungroup(C.ungroup(s, "lines"), "flagged")
    return s.df.select("l_orderkey", "l_returnflag", "l_linestatus", F.size("stated").cast("long").alias("n"))


def sub_dedup_lines(spark, sf):
    s = _t(spark, sf, "lineitem", "l_orderkey", "l_returnflag")
    s = C.sub_dedup(C.group(C.sort(s, ["l_orderkey", "l_returnflag"]), ["l_orderkey"], "flags"), ["flags"])
    return s.df.select("l_orderkey", F.array_join(F.col("flags.l_returnflag"), "").alias("flags"))


def sub_dedup_lines_2(spark, sf):
    s = _t(spark, sf, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus")
    s = C.group(C.sort(s, ["l_orderkey", "l_returnflag", "l_linestatus"]), ["l_orderkey"], "lines")
    s = C.sub_dedup(C.sub_group(s, ["lines"], ["l_returnflag"], "states"), ["lines", "states"])
    return C.ungroup(C.ungroup(s, "lines"), "states").df


def sub_ungroup_lines(spark, sf):
    s = C.ungroup(C.sub_ungroup(_sub_grouped(spark, sf), ["lines"], "flagged"), "lines")
    return s.df.select("l_orderkey", "l_returnflag", "l_linenumber", "l_suppkey")


def sub_ungroup_lines_2(spark, sf):
    s = C.sub_group(_sub_grouped(spark, sf), ["lines", "flagged"], ["l_linestatus"], "stated")
    s = C.sub_ungroup(s, ["lines", "flagged"], "stated")
    s = C.ungroup(C.sub_ungroup(s, ["lines"], "flagged"), "lines")
    return s.df.select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber")


def ungroup_roundtrip(spark, sf):
    return C.ungroup(_lines(spark, sf), "lines").df


def _labelled(spark, sf) -> Stream:
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("i"), "quality", "toxic")
    return Stream(d.join(labels, F.col("doc_id") == F.col("i"), "left").drop("i"), Facts(), "labelled")


def unwrap_skip(spark, sf):
    return M.unwrap(_labelled(spark, sf), ["quality", "toxic"], True).df


def unwrap_fail(spark, sf):
    return M.unwrap(_t(spark, sf, "labels"), ["quality"], False).df


def sub_unwrap_skip(spark, sf):
    s = C.group(C.sort(_labelled(spark, sf), ["source", "doc_id"]), ["source"], "docs")
    s = M.sub_unwrap(s, ["docs"], ["quality"], True)
    return s.df.select("source", F.size("docs").cast("long").alias("n"), F.aggregate("docs", F.lit(0).cast("long"), lambda a, x: a + x["quality"]).alias("good"))


def left_join_defaults(spark, sf):
    docs = M.declare(_t(spark, sf, "documents", "doc_id", "lang"), ["doc_id"], ["doc_id"])
    rows = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    # Declared without Option, so not null: unmatched rows take the default.
    labels = emit(spark, [("label_id", "i64"), ("quality", "i32")], rows.where("quality is not null"), ["label_id"], ["label_id"])
    return C.join(docs, labels, ["doc_id"], ["label_id"]).df


def join_defaults_csv(spark, sf):
    """The same with a secondary that was read from CSV, with a default string too."""
    path = f"{_shared(spark)}/segments-{uuid.uuid4().hex}"
    half = M.where(_t(spark, sf, "customer", "c_custkey", "c_mktsegment"), "c_custkey % 2 = 0")
    write_csv(M.declare(half, ["c_custkey"], ["c_custkey"]), path, has_headers=True, single=False)
    right = read_csv(spark, path, [("c_custkey", "i64"), ("c_mktsegment", "String")], ["c_custkey"], ["c_custkey"], has_headers=True)
    right = M.declare(M.update(right, ["c_custkey"], {"key": F.col("c_custkey")}), ["key"], ["key"])
    left = M.declare(_t(spark, sf, "customer", "c_custkey", "c_nationkey"), ["c_custkey"], ["c_custkey"])
    return C.join(left, right, ["c_custkey"], ["key"]).df


def sorted_rows(spark, sf):
    """Rows as a sink sees them: each with its place in the order."""
    s = C.sort(_t(spark, sf, "supplier", "s_suppkey", "s_nationkey"), [("s_nationkey", "desc"), "s_suppkey"])
    rows = terminate(s, body=lambda it: [(i, r.s_suppkey, r.s_nationkey) for i, r in enumerate(it)])
    return spark.createDataFrame(rows, "place long, s_suppkey long, s_nationkey long")


def produced_rows(spark, sf):
    return produce(spark, [("v", "i64"), ("t", "Option<String>")], lambda send: [send((i, None if i % 3 else f"t{i}")) for i in range(10)]).df


def accumulated_fork(spark, sf):
    """One accumulated stream for two consumers, counted by a pipeline that runs both and a side task."""
    p = Pipeline()
    s = M.debug(M.accumulate(_t(spark, sf, "nation", "n_nationkey", "n_regionkey")), io.StringIO())
    main, taken = M.extract_fields(s, ["n_regionkey"])
    p.sink("nations", lambda a: a.df.count(), main)
    p.sink("regions", lambda a: a.df.distinct().count(), taken)
    p.execute("side", lambda control: 7)
    got = p.run()
    s.df.unpersist()
    return spark.createDataFrame([(k, int(v)) for k, v in got.items()], "node string, n long")


def line_words(spark, sf):
    """Lines of text files, by their first word."""
    path = f"{_shared(spark)}/lines-{uuid.uuid4().hex}"
    _t(spark, sf, "region", "r_name").df.write.text(path)
    return read_lines(spark, path, "line").df


def unwrap_failure(spark, sf):
    """The failing unwrap over rows with a null: the failure it reports."""
    s = M.unwrap(_labelled(spark, sf), ["quality"], False)
    try:
        s.df.where("doc_id < 0").collect()
    except Exception as cause:
        found = re.search(r"found None for field `\w+`", str(cause))
        return spark.createDataFrame([(found[0] if found else str(cause)[:200],)], "failure string")
    return spark.createDataFrame([], "failure string")


def lower_text(spark, sf):
    return M.to_lowercase(_t(spark, sf, "documents", "doc_id", "text"), ["text"]).df


def reverse_text(spark, sf):
    return M.reverse_chars(_t(spark, sf, "documents", "doc_id", "text"), ["text"]).df


def sub_lower_reverse(spark, sf):
    s = C.group(C.sort(_t(spark, sf, "customer", "c_nationkey", "c_custkey", "c_name"), ["c_nationkey", "c_custkey"]), ["c_nationkey"], "g")
    s = M.sub_reverse_chars(M.sub_to_lowercase(s, ["g"], ["c_name"]), ["g"], ["c_name"])
    return C.ungroup(s, "g").df


def extract_fields_main(spark, sf):
    return M.extract_fields(M.pipe(_t(spark, sf, "customer")), ["c_name", "c_custkey"])[0].df


def extract_fields_extracted(spark, sf):
    return M.extract_fields(_t(spark, sf, "customer"), ["c_name", "c_custkey"])[1].df


def update_columns(spark, sf):
    return M.update(_t(spark, sf, "region"), ["r_name"], {"r_name": F.reverse("r_name"), "twice": F.col("r_regionkey") * 2}).df


def csv_roundtrip(spark, sf):
    path = f"{_shared(spark)}/region-{uuid.uuid4().hex}.csv"
    write_csv(C.sort(_t(spark, sf, "region"), ["r_regionkey"]), path, has_headers=True)
    return read_csv(spark, path, [("r_regionkey", "i32"), ("r_name", "String")], has_headers=True).df


def first_char_index(spark, sf):
    s = tokenize(_t(spark, sf, "documents", "text"), words="text")
    s = C.group(C.sort(C.dedup(C.sort(s, ["first_char", "word"])), ["first_char", "word"]), ["first_char"], "words")
    return s.df.select("first_char", F.size("words").cast("long").alias("n"), F.md5(F.array_join(F.col("words.word"), " ")).alias("words_md5"))


def nation_tree(spark, sf):
    """Children of each region by group and left join: regions without nations get an empty collection."""
    regions = M.declare(_t(spark, sf, "region"), ["r_regionkey"], ["r_regionkey"])
    kids = C.group(C.sort(_t(spark, sf, "nation"), ["n_regionkey", "n_nationkey"]), ["n_regionkey"], "children")
    joined = C.join(regions, kids, ["r_regionkey"], ["n_regionkey"])
    return joined.df.select("r_regionkey", "r_name", F.array_join(F.col("children.n_name"), ",").alias("names"))


def wordlist_words(spark, sf):
    return _word_list(spark, sf)[0].df


def wordlist_reversed(spark, sf):
    return _word_list(spark, sf)[1].df


def wordlist_ci(spark, sf):
    return _word_list(spark, sf)[2].df.select("word", "ci_id", F.array_join(F.col("refs.word_id").cast("array<string>"), ",").alias("refs"))


def wordlist_reversed_ci(spark, sf):
    return _word_list(spark, sf)[3].df


_WORDS = r"""words AS (SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_split_to_array(text, '[\s\x{0085}\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+')) AS w FROM documents) WHERE w <> ''),
numbered AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS word_id FROM words),
ci AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS ci_id, refs FROM (SELECT lower(word) AS word, string_agg(CAST(word_id AS VARCHAR), ',' ORDER BY word_id) AS refs FROM numbered GROUP BY lower(word)))"""
_FLAGS = "SELECT l_orderkey, l_returnflag"

CATALOG: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "sort_rank": (sort_rank, "SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_name NULLS FIRST, p_partkey DESC) - 1 AS rank FROM part"),
    "dedup_sorted": (dedup_sorted, "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders"),
    "dedup_adjacent": (dedup_adjacent, "SELECT event_type FROM (SELECT *, row_number() OVER w > 1 AND lag(event_type) OVER w IS NOT DISTINCT FROM event_type AS same FROM events WINDOW w AS (ORDER BY event_id)) WHERE NOT same"),
    "dedup_positional": (dedup_positional, "SELECT o_orderstatus, decade FROM (SELECT *, row_number() OVER w > 1 AND lag(o_orderstatus) OVER w IS NOT DISTINCT FROM o_orderstatus AND lag(decade) OVER w IS NOT DISTINCT FROM decade AS same FROM (SELECT o_orderkey, o_orderstatus, o_orderkey // 40 AS decade FROM orders) WINDOW w AS (ORDER BY decade DESC, o_orderkey)) WHERE NOT same"),
    "group_orders": (group_orders, "SELECT o_custkey, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey DESC) AS keys FROM orders GROUP BY o_custkey"),
    "group_all": (group_all, "SELECT count(*) AS n FROM nation HAVING count(*) > 0"),
    "group_empty_input": (group_empty_input, "SELECT count(*) AS n FROM nation WHERE n_nationkey < 0 HAVING count(*) > 0"),
    "group_key_only": (group_key_only, "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment"),
    "sub_sort_lines": (sub_sort_lines, "SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_quantity DESC NULLS LAST, l_linenumber NULLS FIRST) AS numbers FROM lineitem GROUP BY l_orderkey"),
    "sub_group_lines": (sub_group_lines, f"{_FLAGS}, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linestatus, l_linenumber) AS numbers FROM lineitem GROUP BY ALL"),
    "sub_group_lines_2": (sub_group_lines_2, f"{_FLAGS}, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL"),
    "sub_dedup_lines": (sub_dedup_lines, "SELECT l_orderkey, string_agg(DISTINCT l_returnflag, '' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY l_orderkey"),
    "sub_dedup_lines_2": (sub_dedup_lines_2, "SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem"),
    "sub_ungroup_lines": (sub_ungroup_lines, f"{_FLAGS}, l_linenumber, l_suppkey FROM lineitem"),
    "sub_ungroup_lines_2": (sub_ungroup_lines_2, f"{_FLAGS}, l_linestatus, l_linenumber FROM lineitem"),
    "ungroup_roundtrip": (ungroup_roundtrip, "SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_linestatus, l_quantity FROM lineitem"),
    "unwrap_skip": (unwrap_skip, "SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL"),
    "unwrap_fail": (unwrap_fail, "SELECT doc_id, toxic, quality FROM labels"),
    "sub_unwrap_skip": (sub_unwrap_skip, "SELECT d.source, count(l.quality) AS n, CAST(coalesce(sum(l.quality), 0) AS BIGINT) AS good FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source"),
    "left_join_defaults": (left_join_defaults, "SELECT d.doc_id, d.lang, coalesce(l.quality, 0) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)"),
    "join_defaults_csv": (join_defaults_csv, "SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS c_mktsegment FROM customer"),
    "sorted_rows": (sorted_rows, "SELECT row_number() OVER (ORDER BY s_nationkey DESC, s_suppkey) - 1 AS place, s_suppkey, CAST(s_nationkey AS BIGINT) AS s_nationkey FROM supplier"),
    "produced_rows": (produced_rows, "SELECT i AS v, CASE WHEN i % 3 = 0 THEN 't' || i END AS t FROM range(10) r(i)"),
    "accumulated_fork": (accumulated_fork, "SELECT 'nations' AS node, count(*) AS n FROM nation UNION ALL SELECT 'regions', count(DISTINCT n_regionkey) FROM nation UNION ALL SELECT 'side', 7"),
    "line_words": (line_words, "SELECT r_name AS line FROM region"),
    "unwrap_failure": (unwrap_failure, "SELECT 'found None for field `quality`' AS failure FROM (SELECT count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL) WHERE n > 0"),
    "lower_text": (lower_text, "SELECT doc_id, lower(text) AS text FROM documents"),
    "reverse_text": (reverse_text, "SELECT doc_id, reverse(text) AS text FROM documents"),
    "sub_lower_reverse": (sub_lower_reverse, "SELECT c_nationkey, c_custkey, reverse(lower(c_name)) AS c_name FROM customer"),
    "extract_fields_main": (extract_fields_main, "SELECT * FROM customer"),
    "extract_fields_extracted": (extract_fields_extracted, "SELECT c_name, c_custkey FROM customer"),
    "update_columns": (update_columns, "SELECT r_regionkey, reverse(r_name) AS r_name, r_regionkey * 2 AS twice FROM region"),
    "csv_roundtrip": (csv_roundtrip, "SELECT * FROM region"),
    "first_char_index": (first_char_index, f"WITH {_WORDS} SELECT left(word, 1) AS first_char, count(*) AS n, md5(string_agg(word, ' ' ORDER BY word)) AS words_md5 FROM words GROUP BY left(word, 1)"),
    "nation_tree": (nation_tree, "SELECT r_regionkey, r_name, coalesce(string_agg(n_name, ',' ORDER BY n_nationkey), '') AS names FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL"),
    "wordlist_words": (wordlist_words, f"WITH {_WORDS} SELECT * FROM numbered"),
    "wordlist_reversed": (wordlist_reversed, f"WITH {_WORDS} SELECT reverse(word) AS word, word_id FROM numbered"),
    "wordlist_ci": (wordlist_ci, f"WITH {_WORDS} SELECT word, ci_id, refs FROM ci"),
    "wordlist_reversed_ci": (wordlist_reversed_ci, f"WITH {_WORDS} SELECT reverse(word) AS word, ci_id FROM ci"),
}
