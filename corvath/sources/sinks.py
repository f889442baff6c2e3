"""Index tables on disk: postings, field lengths and vectors, written, rebuilt, upserted and deleted from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvath.functions.text import STOPWORDS, query_terms
from corvath.operators.lexical import bm25, lengths, postings
from corvath.operators.vector import hash_embed

FIELDS = ("title", "content")
TARGETS = ("all", "lexical", "vector")
BUCKET_CHARS, SALTS = 1 << 30, 8


def buckets_for(hits: DataFrame) -> int:
    """Buckets of the postings: one for each BUCKET_CHARS of content, 16 at least."""
    chars = hits.agg(F.sum(F.length("content")).alias("n")).first()["n"] or 0  # a number
    return max(16, -(-chars // BUCKET_CHARS))


def build_indexes(hits: DataFrame, path: str, target: str = "all", vectors: DataFrame | None = None, partitions: int | None = None) -> int:
    """Derive the indexes anew from the hits (chunk_id, document_id, title, content); returns the number of buckets.

    Postings are partitioned by a hash of the term, so that a query reads the partitions of its terms only; a bucket is
    written by SALTS tasks, so that a term of all documents isn't one task's work. Where no vectors are given, the hash
    embedder makes them.
    """
    if target not in TARGETS:
        raise ValueError(f"target must be one of {TARGETS}")
    n = partitions or buckets_for(hits)
    if target != "vector":
        for field in FIELDS:
            own = postings(hits, field).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(n)).cast("int"))
            own.repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS))).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings_{field}")
            lengths(hits, field).write.mode("overwrite").parquet(f"{path}/lengths_{field}")
    if target != "lexical":
        own = vectors if vectors is not None else hash_embed(hits, "chunk_id", "content")
        keys = hits.select("chunk_id", "document_id")
        keys.join(own, "chunk_id").write.mode("overwrite").parquet(f"{path}/vectors")
    return n


def read_postings(spark: SparkSession, path: str, field: str, terms: list[str] | None = None, partitions: int = 16) -> DataFrame:
    """Postings of a field; for given terms, of their partitions only."""
    df = spark.read.parquet(f"{path}/postings_{field}")
    if terms is not None:
        of = spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(partitions)).cast("int").alias("b")).distinct()
        df = df.where(F.col("bucket").isin([r.b for r in of.collect()]) & F.col("term").isin(terms))
    return df.drop("bucket")


def search_index(spark: SparkSession, path: str, query: str, boosts: dict[str, float], partitions: int) -> DataFrame:
    """chunk_id, score (4 places): the best of the fields' boosted BM25 scores, from the written postings of the query's terms."""
    terms = [t for t in query_terms(query, distinct=True) if t not in STOPWORDS]
    queries = spark.createDataFrame([(0, t) for t in terms], "query_id int, term string")
    found = None
    for field, boost in boosts.items():
        own = bm25(read_postings(spark, path, field, terms, partitions), spark.read.parquet(f"{path}/lengths_{field}"), queries).select("chunk_id", (F.col("score") * F.lit(float(boost))).alias("s"))
        found = own if found is None else found.unionByName(own)
    return found.groupBy("chunk_id").agg(F.round(F.max("s"), 4).alias("score"))


def upsert_vectors(spark: SparkSession, path: str, rows: DataFrame, out: str) -> None:
    """The vectors at `path`, with rows (chunk_id, document_id, embedding) in place of those of equal key, written to `out`."""
    old = spark.read.parquet(f"{path}/vectors")
    if rows.where("embedding is null").limit(1).count():
        raise ValueError("each chunk needs a vector")
    old.join(rows.select("chunk_id"), "chunk_id", "left_anti").unionByName(rows).write.mode("overwrite").parquet(f"{out}/vectors")


def delete_from_indexes(spark: SparkSession, path: str, document_ids: DataFrame, hits: DataFrame, out: str) -> None:
    """All indexes without some documents (document_id), written to `out`; the lengths are those of the hits that are left."""
    left = hits.join(document_ids.distinct(), "document_id", "left_anti")
    chunks = hits.join(document_ids.distinct(), "document_id", "left_semi").select("chunk_id")
    for field in FIELDS:
        spark.read.parquet(f"{path}/postings_{field}").join(chunks, "chunk_id", "left_anti").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/postings_{field}")
        lengths(left, field).write.mode("overwrite").parquet(f"{out}/lengths_{field}")
    spark.read.parquet(f"{path}/vectors").join(document_ids.distinct(), "document_id", "left_anti").write.mode("overwrite").parquet(f"{out}/vectors")


def count_vectors(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/vectors").count()
