"""Streams that run under Structured Streaming.

Projections, lower case, reversal, skipping unwrap and all operators inside nested collections are stateless, so they
apply to ``readStream`` frames as they are.  Order is not defined on an unbounded stream: sort, anchor, dedup by
position and join are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import errors as E
from ..stream import Facts, Stream


def unbounded(df: DataFrame, name: str = "unbounded") -> Stream:
    """A stream over a ``readStream`` frame."""
    if not df.isStreaming:
        raise E.Other("not a streaming frame")
    return Stream(df, Facts(), name)


def start(stream: Stream, query: str, checkpoint: str, sink: str = "memory", mode: str = "append", **options: str):
    """Starts writing a stream in micro-batches."""
    if stream.facts.order:
        raise E.ExpectedMinimalOrder("an unbounded stream has no order")
    return stream.df.writeStream.format(sink).queryName(query).outputMode(mode).option("checkpointLocation", checkpoint).options(**options).start()
