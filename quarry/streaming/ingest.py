"""Incremental ingestion on Structured Streaming.

Batches of new documents are cleaned, chunked and written with their text hash;
a chunk that is there already with the same text is left out, so a batch that
is run again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators import chunking as C


def prepared(docs: DataFrame) -> DataFrame:
    """chunk_id, doc_id, pos, section, text, num_tokens, text_hash."""
    cleaned = docs.withColumn("text", T.clean_text(T.repair_breaks(F.col("text")))).where("text <> ''")
    return C.chunks(cleaned).withColumn("text_hash", F.xxhash64("text"))


def write_new(chunks: DataFrame, path: str) -> None:
    """Appends what isn't there; the table is read anew in each batch."""
    spark = chunks.sparkSession
    keys = ["chunk_id", "text_hash"]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    new = chunks.join(spark.read.parquet(path).select(*keys), keys, "left_anti") if there else chunks
    new.dropDuplicates(keys).write.mode("append").parquet(path)


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = "doc_id bigint, text string") -> StreamingQuery:
    """Parquet files that appear in ``source`` to chunks in ``target``; runs until what is there has been read."""
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(lambda df, _: write_new(prepared(df), target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events by window and type; repeated events and those later than ``late`` are dropped on a stream."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else e.dropDuplicates(["event_id"])
    g = e.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "value")
