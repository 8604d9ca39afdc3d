"""Streams of elements and chunks.

Stateless steps run on a stream as they are. Steps that need a whole document (windows, chunk assembly) run on each
micro-batch of whole documents through ``foreachBatch``; chunks are written once for each batch number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliospark import schemas
from foliospark.functions import text
from foliospark.operators import chunking


def read_elements(spark: SparkSession, directory: str, *, files_per_batch: int = 100) -> DataFrame:
    """Elements of JSON-lines files as they arrive. A file holds whole documents."""
    return spark.readStream.schema(schemas.ELEMENT).option("maxFilesPerTrigger", files_per_batch).json(directory)


def normalized(elements: DataFrame) -> DataFrame:
    """Text in normal form, with its role, heading level, token estimate and hash: no state."""
    clean = elements.withColumn("text", text.normalize(F.col("text")))
    kind = text.role(F.col("type"), F.col("text"))
    return clean.withColumns(
        {"role": kind, "level": text.heading_level(kind, F.col("text")), "tokens": text.estimated_tokens(F.col("text")), "content_sha256": text.content_hash(F.col("text"), F.col("html"))}
    )


def first_of_hash(rows: DataFrame, *, time: str, delay: str = "1 day") -> DataFrame:
    """The first row of each content hash that comes within ``delay`` by event time; the watermark bounds the state."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(["content_sha256"])


def chunk_stream(elements: DataFrame, output: str, checkpoint: str, *, once: bool = False, run: Callable = chunking.run_chunking, **options) -> StreamingQuery:
    """Chunks of every batch of whole documents as Parquet under ``output``; a repeated batch replaces its own rows."""

    def batch(rows: DataFrame, number: int) -> None:
        run(rows, **options)[0].write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = elements.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
