"""Streaming: documents that arrive as files are chunked, and added to an index that can be searched, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunking
from ..operators.index import Index, KeptIndex

KEY = ["doc_id", "chunk_index"]


def _kept(spark: SparkSession, out: str, schema: str) -> KeptIndex:
    chunks = chunking.fixed(spark.createDataFrame([], schema)).schema
    return KeptIndex(spark, f"{out}/index", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks), KEY)


def index_stream(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str) -> StreamingQuery:
    """Writes chunks of new documents to out/chunks and adds them to the index in out; ends when all files are read.

    A batch that comes again after a failure is written over, and counts once in the index.
    """
    kept = _kept(spark, out, schema)

    def append(batch: DataFrame, number: int) -> None:
        chunking.fixed(batch).write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        chunks = spark.read.schema(chunking.fixed(batch).schema).parquet(f"{out}/chunks/batch={number}")
        kept.add(chunks, batch=str(number))

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def open_index(spark: SparkSession, out: str, schema: str) -> Index:
    """The index of all batches so far."""
    return _kept(spark, out, schema).open()
