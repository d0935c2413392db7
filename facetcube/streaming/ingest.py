"""Streams of facts: every micro-batch is compiled as a batch of its own.

The batch's name is made of the stream's name and the micro-batch's number, so
a micro-batch that is run again after a failure replaces its own cells: together
with the checkpoint that is exactly once. Late facts need no watermark, since
states add in any order.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from facetcube.model import Cube
from facetcube.operators.compile import chosen_cuboids, compact, compile_batch, vacuum
from facetcube.sources.catalog import Catalog


def compile_stream(catalog: Catalog, cube: Cube, facts: DataFrame, name: str, checkpoint: str, include: Collection[str] | None = None, exclude: Collection[str] | None = None, groups: Collection[str] | None = None, processing_time: str | None = None, compact_every: int | None = None) -> StreamingQuery:
    """Start compiling a streaming DataFrame. Without ``processing_time`` it takes what is there and ends.

    ``compact_every``: micro-batches after which the cuboids are compacted, so
    that queries of a long stream read few files. A micro-batch that is
    delivered again after that is in there already.
    """

    def one(batch: DataFrame, number: int) -> None:
        compile_batch(catalog, cube, batch, f"{name}-{number}", include, exclude, groups, absorbed="skip")
        if compact_every and number % compact_every == compact_every - 1:
            for c in chosen_cuboids(cube, groups):
                compact(catalog, cube, c)
                vacuum(catalog, cube, c)

    writer = facts.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(one)
    return (writer.trigger(processingTime=processing_time) if processing_time else writer.trigger(availableNow=True)).start()
