"""Structured Streaming over an append-only folder of pages: the same row-wise operators, a seen-set, a sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

PAGES = "page_id long, url string, html string"


def stream_pages(spark: SparkSession, folder: str, schema: str = PAGES, name: str | None = None) -> DataFrame:
    """A folder of page files as a stream; `name`: one table of the folder, be it a file or a folder itself."""
    reader = spark.readStream.schema(schema)
    if name is None:
        return reader.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{folder}/{name}")
    return reader.option("pathGlobFilter", name).parquet(folder)


def seen_once(pages: DataFrame, event_time: str | None = None, within: str = "1 day", by: tuple[str, ...] = ("url",)) -> DataFrame:
    """Each URL (or what `by` names) once: for ever, or within a watermark where a time column bounds the state."""
    if event_time is None:
        return pages.dropDuplicates(list(by))
    return pages.withWatermark(event_time, within).dropDuplicatesWithinWatermark(list(by))


def run(stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Calls process for every micro-batch; the checkpoint makes a restart go on where it stopped."""
    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
