from datetime import datetime

import pytest

from corvath.sources import sinks
from corvath.streaming import ingest

HITS = "chunk_id string, document_id string, title string, content string"


def test_indexes(spark, tmp_path):
    hits = spark.createDataFrame([("a_0", "a", "One", "search index index"), ("b_0", "b", "Two", "index"), ("c_0", "c", None, None)], HITS)
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    sinks.build_indexes(hits, old, partitions=4)
    assert {(r.chunk_id, r.tf, r.dl) for r in sinks.read_postings(spark, old, "content", ["index"], 4).collect()} == {("a_0", 2, 3), ("b_0", 1, 1)}
    assert sinks.count_vectors(spark, old) == 3
    sinks.delete_from_indexes(spark, old, spark.createDataFrame([("a",)], "document_id string"), hits, new)
    assert {r.chunk_id for r in sinks.read_postings(spark, new, "content").collect()} == {"b_0"} and sinks.count_vectors(spark, new) == 2
    rows = spark.createDataFrame([("b_0", "b", [1.0]), ("d_0", "d", [2.0])], "chunk_id string, document_id string, embedding array<float>")
    sinks.upsert_vectors(spark, new, rows, str(tmp_path / "third"))
    assert sinks.count_vectors(spark, str(tmp_path / "third")) == 3
    with pytest.raises(ValueError):
        sinks.build_indexes(hits, old, "other")


def test_streaming_ingest(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id string, raw_content string, created_at timestamp"
    day = datetime(2024, 1, 1)
    first = spark.createDataFrame([("a", "hello world", day), ("b", "hello world", day), ("c", None, day)], schema)
    first.coalesce(1).write.parquet(folder)
    run = lambda: ingest.ingest(ingest.stream_documents(spark, folder, first.schema), out, str(tmp_path / "ck")).awaitTermination()
    run()
    spark.createDataFrame([("d", "more text", day), ("e", "hello world", day)], schema).coalesce(1).write.mode("append").parquet(folder)
    run()
    assert spark.read.parquet(f"{out}/documents").count() == 2
    assert {r.content for r in spark.read.parquet(f"{out}/chunks").collect()} == {"hello world", "more text"}
