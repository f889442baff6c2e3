"""Search: lexical and semantic candidates, reciprocal rank fusion, re-ranking and paging."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lexical import bm25_multifield, term_count_search
from .ranking import rerank
from .vector import cosine_search

RRF_K = 60
MODES = ("lexical", "semantic", "hybrid")


def candidate_limit(limit: int) -> int:
    return max(3 * limit, 50)


def ranked(hits: DataFrame, name: str, *order: Column) -> DataFrame:
    """A short list of candidates, numbered from 1."""
    return hits.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def rrf(lexical: DataFrame, semantic: DataFrame, k: int = RRF_K) -> DataFrame:
    """chunk_id, lexical_rank, semantic_rank, lexical_score, semantic_score, rrf_score of two ranked candidate lists."""
    lex = lexical.select("chunk_id", "lexical_rank", F.col("score").alias("lexical_score"))
    sem = semantic.select("chunk_id", "semantic_rank", F.col("score").alias("semantic_score"))
    part = lambda r: F.coalesce(F.lit(1.0) / (F.lit(float(k)) + F.col(r)), F.lit(0.0))
    return lex.join(sem, "chunk_id", "full").withColumn("rrf_score", part("lexical_rank") + part("semantic_rank"))


def search(hits: DataFrame, vectors: DataFrame, query: str, vector: list[float] | None, as_of: datetime, mode: str = "hybrid", limit: int = 10, offset: int = 0, source_type: str | None = None, engine: str = "term_count") -> DataFrame:
    """The page of re-ranked hits with all their scores, and `position` from 1; ties by chunk_id.

    hits: chunk_id, title, content, source_type, created_at; vectors: chunk_id, embedding. An unknown mode is hybrid. A
    blank query finds nothing. Candidates are the best max(3 x limit, 50) of each engine, so only these are re-ranked.
    """
    if not (1 <= limit <= 100 and offset >= 0):
        raise ValueError("limit must be 1 to 100, offset not negative")
    mode = mode.lower() if mode.lower() in MODES else "hybrid"
    pool, own = candidate_limit(limit), hits.where(F.col("source_type") == source_type) if source_type else hits
    if not query.strip():
        own = own.limit(0)
    lexical = semantic = None
    if mode != "semantic":
        if engine == "bm25":
            scored = bm25_multifield(hits, query, {"title": 3.0, "content": 1.0})
            found = own.select("chunk_id").join(scored, "chunk_id").orderBy(F.col("score").desc(), "chunk_id").limit(pool)
        else:
            found = term_count_search(own, query, pool).select("chunk_id", "score")
        lexical = ranked(found, "lexical_rank", F.col("score").desc(), "chunk_id")
    if mode != "lexical":
        if vector is None:
            raise ValueError("a semantic search needs the query's vector")
        near = cosine_search(vectors.join(own.select("chunk_id"), "chunk_id", "left_semi"), vector, pool, "chunk_id").select("chunk_id", "score")
        semantic = ranked(near, "semantic_rank", F.col("score").desc(), "chunk_id")
    if mode == "hybrid":
        fused = rrf(lexical, semantic).withColumn("score", F.col("rrf_score") * 100)
    elif mode == "lexical":
        fused = lexical.select("chunk_id", "lexical_rank", F.lit(None).cast("int").alias("semantic_rank"), F.col("score").alias("lexical_score"), F.lit(None).cast("double").alias("semantic_score"), F.lit(None).cast("double").alias("rrf_score"), "score")
    else:
        fused = semantic.select("chunk_id", F.lit(None).cast("int").alias("lexical_rank"), "semantic_rank", F.lit(None).cast("double").alias("lexical_score"), F.col("score").alias("semantic_score"), F.lit(None).cast("double").alias("rrf_score"), "score")
    # at most 2 x pool candidates: a proven bound for the broadcast
    scored = rerank(own.join(F.broadcast(fused), "chunk_id"), query, as_of)
    placed = scored.withColumn("position", F.row_number().over(Window.orderBy(F.col("final_score").desc(), "chunk_id")))
    return placed.where((F.col("position") > offset) & (F.col("position") <= offset + limit))
