"""Quality of ranked results: precision, recall, reciprocal rank, normalised discounted gain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def metrics(retrieved: DataFrame, judged: DataFrame, ks: tuple[int, ...] = (1, 3, 5), recall_k: int = 5, ndcg_k: int = 5) -> DataFrame:
    """query_id, p_at_K..., r_at_K, mrr, ndcg_at_K, each of 4 places, for every query that is judged or retrieved.

    retrieved: query_id, item, rank from 1; judged: query_id, item, grade (relevant above 0). Precision divides by K;
    recall by the relevant items judged; without any of these the values are 0. The ideal gain comes from all grades of
    the query; where it is 0, the gain counts as 1 for a list that has items and as 0 for an empty one.
    """
    grades = judged.where("grade > 0").groupBy("query_id", "item").agg(F.max("grade").alias("grade"))
    found = retrieved.join(grades, ["query_id", "item"], "left").withColumn("grade", F.coalesce("grade", F.lit(0.0)))
    gain = (F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("rank") + F.lit(1.0))
    of_hits = found.groupBy("query_id").agg(
        *[(F.count_if((F.col("rank") <= k) & (F.col("grade") > 0)) / F.lit(float(k))).alias(f"p_at_{k}") for k in ks],
        F.count_if((F.col("rank") <= recall_k) & (F.col("grade") > 0)).alias("hits"),
        F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first"), F.sum(F.when(F.col("rank") <= ndcg_k, gain)).alias("dcg"), F.count(F.lit(1)).alias("items"),
    )
    best = grades.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "item")))
    ideal = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"), F.sum(F.when(F.col("rank") <= ndcg_k, gain)).alias("idcg"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    ndcg = F.when(zero(F.col("idcg")) > 1e-9, zero(F.col("dcg")) / F.col("idcg")).when(F.coalesce("items", F.lit(0)) > 0, 1.0).otherwise(0.0)
    return of_hits.join(ideal, "query_id", "full").select(
        "query_id", *[F.round(zero(F.col(f"p_at_{k}")), 4).alias(f"p_at_{k}") for k in ks],
        F.round(F.when(F.col("relevant") > 0, F.coalesce("hits", F.lit(0)) / F.col("relevant")).otherwise(0.0), 4).alias(f"r_at_{recall_k}"),
        F.round(zero(F.lit(1.0) / F.col("first")), 4).alias("mrr"), F.round(ndcg, 4).alias(f"ndcg_at_{ndcg_k}"),
    )


def means(per_query: DataFrame, *by: str) -> DataFrame:
    """The mean of every metric, of 4 places, by mode or whatever else is named."""
    own = [c for c in per_query.columns if c not in ("query_id", *by)]
    return per_query.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), 4).alias(c) for c in own])


def by_mode(lexical: DataFrame, semantic: DataFrame, pool: int = 50, limit: int = 10, k: int = 60) -> DataFrame:
    """mode, query_id, item, rank of many queries in the three modes, from scored candidates (query_id, item, score).

    The best `pool` of each engine are candidates; hybrid is their reciprocal rank fusion by a full join of the ranks. All
    queries go together, and a mode's ranks are taken within its queries; ties go by item.
    """
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item")
    lex, sem = (d.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= pool) for d in (lexical, semantic))
    part = lambda r: F.coalesce(F.lit(1.0) / (F.lit(float(k)) + F.col(r)), F.lit(0.0))
    both = lex.select("query_id", "item", F.col("rank").alias("l")).join(sem.select("query_id", "item", F.col("rank").alias("s")), ["query_id", "item"], "full")
    fused = both.withColumn("score", F.round(part("l") + part("s"), 10)).withColumn("rank", F.row_number().over(best))
    named = [d.where(F.col("rank") <= limit).select(F.lit(n).alias("mode"), "query_id", "item", "rank") for n, d in (("lexical", lex), ("semantic", sem), ("hybrid", fused))]
    return named[0].unionByName(named[1]).unionByName(named[2])


def metrics_by_mode(retrieved: DataFrame, judged: DataFrame) -> DataFrame:
    """mode, query_id and the metrics of every judged query in every mode, retrieved or not."""
    modes = F.explode(F.array(*map(F.lit, ("lexical", "semantic", "hybrid")))).alias("mode")
    key = F.struct("mode", "query_id").alias("query_id")
    out = metrics(retrieved.select(key, "item", "rank"), judged.select("*", modes).select(key, "item", "grade"))
    return out.select("query_id.mode", "query_id.query_id", *[c for c in out.columns if c != "query_id"])
