"""Documents that arrive as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import extract


def mention_counts(stream: DataFrame, time: str, window: str = "1 day", delay: str = "1 day", extractor: extract.Extractor = extract.capitalized) -> DataFrame:
    """(window, span_text, frequency) of mentions by tumbling windows; what is later than ``delay`` is dropped.

    Extraction is a map, so only counts are state, and the watermark bounds it.
    """
    spans = stream.withWatermark(time, delay).select(time, F.inline(extractor()))
    return spans.groupBy(F.window(time, window), "span_text").agg(F.count("*").alias("frequency"))


def ingest(stream: DataFrame, update: Callable[[DataFrame], object], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hand every micro-batch of documents to ``update``, such as a model's ``fit``.

    A model leaves out documents that it has, so a batch that is replayed after a
    failure changes nothing.
    """
    writer = stream.writeStream.foreachBatch(lambda df, _: update(df) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
