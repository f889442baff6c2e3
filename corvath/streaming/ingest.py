"""Incremental ingest: new document files become chunks as they arrive, each content once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from corvath.operators.chunk import describe, plain_chunks
from corvath.session import cut_lineage


def stream_documents(spark: SparkSession, folder: str, schema: StructType, late: str = "1 day") -> DataFrame:
    """Rows of new parquet files (id, raw_content, created_at, ...); a content that comes again within `late` is dropped."""
    rows = spark.readStream.schema(schema).parquet(folder)
    hashed = rows.where("raw_content is not null").withColumn("sha256", F.sha2("raw_content", 256))
    return hashed.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["sha256"])


def ingest(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write documents and chunks of every batch in folders of its number: a batch that runs again replaces its own.

    What the watermark has let go of is compared with the documents of earlier batches.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number:  # batches are partitions: only the earlier ones' hashes are read
            known = spark.read.parquet(f"{out}/documents").where(F.col("batch") < number).select("sha256").distinct()
            batch = batch.join(known, "sha256", "left_anti")
        batch = cut_lineage(batch)
        batch.write.mode("overwrite").parquet(f"{out}/documents/batch={number}")
        describe(plain_chunks(batch, "id", "raw_content")).write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
