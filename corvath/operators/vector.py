"""Vector retrieval: exact cosine top-k, and the deterministic hash embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries of one block (4096 of 384 doubles are 12 MB), and vectors of one.
QUERY_BLOCK, VECTOR_BLOCK = 4096, 16_384
HASH_DIMENSIONS = 384
MEMO_GRAMS = 200_000


def dot(a: Column, b: Column) -> Column:
    """In doubles, whatever the elements are."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_search(vectors: DataFrame, query: list[float], limit: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The nearest rows to one query vector, with `score` (4 places); the vector is a literal of the plan.

    Null vectors and those of length 0, as blank texts have, aren't found.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    length = float(np.sqrt(np.sum(np.square(np.asarray(query, dtype=np.float64)))))
    value = dot(F.col(vector_col), q) / F.nullif(norm(F.col(vector_col)) * F.lit(length or 1.0), F.lit(0.0))
    return vectors.withColumn("score", F.round(value, 4)).where("score is not null").orderBy(F.col("score").desc(), id_col).limit(limit)


def _nearest(ids: list, vectors: list, names: list, q: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every query (a row of unit length), the best ids and their cosines among some vectors; ties go by id."""
    pairs = [(i, v) for i, v in zip(ids, vectors) if v is not None and len(v) == q.shape[1]]
    if not pairs or not len(names):
        return np.zeros((len(names), 0), dtype=object), np.zeros((len(names), 0))
    x = np.array([v for _, v in pairs], dtype=np.float64)
    score = np.round(q @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).T, 10)
    own = np.array([i for i, _ in pairs], dtype=object)
    return _best(np.broadcast_to(own, score.shape), score, limit)


def _best(ids: np.ndarray, score: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    text = ids.size and isinstance(ids.flat[0], str)
    keep = np.lexsort((ids.astype(str) if text else ids.astype(np.int64), -score), axis=1)[:, :limit]
    return np.take_along_axis(ids, keep, 1), np.take_along_axis(score, keep, 1)


def _unit(rows: list) -> np.ndarray:
    matrix = np.array(rows, dtype=np.float64)
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)


def batch_search(vectors: DataFrame, queries: DataFrame, limit: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, id_col, score (4 places), rank: the nearest rows of every query, exactly.

    Up to QUERY_BLOCK queries are sent to all tasks, and no vector moves. More of them are cut into blocks, as are the
    vectors, and each block of the one meets each block of the other in a task of bounded size. A task keeps the best of
    its rows for every query, and the ranks are taken over these. Ties go by id. Rows without a vector, or of another
    length, aren't found.
    """
    spark = vectors.sparkSession
    asked = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("q")).where("q is not null")
    id_type = vectors.schema[id_col].dataType.simpleString()
    schema = f"query_id {id_type}, `{id_col}` {id_type}, s double"
    n_queries = asked.count()
    if n_queries == 0:
        return spark.createDataFrame([], f"query_id {id_type}, `{id_col}` {id_type}, score double, rank int")
    if n_queries <= QUERY_BLOCK:
        rows = asked.collect()
        sent = spark.sparkContext.broadcast(([r["query_id"] for r in rows], _unit([r["q"] for r in rows])))

        def of_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            ids, best = np.zeros((len(names), 0), dtype=object), np.zeros((len(names), 0))
            for batch in batches:
                own, score = _nearest(batch.column(0).to_pylist(), batch.column(1).to_pylist(), names, q, limit)
                ids, best = np.hstack([ids, own]), np.hstack([best, score])
                if ids.shape[1] > limit:
                    ids, best = _best(ids, best, limit)
            yield pa.RecordBatch.from_arrays([pa.array([n for n in names for _ in range(best.shape[1])]), pa.array(ids.ravel().tolist()), pa.array(best.ravel())], names=["query_id", id_col, "s"])

        every = vectors.select(id_col, vector_col).mapInArrow(of_task, schema)
    else:
        a, b = -(-vectors.count() // VECTOR_BLOCK) or 1, -(-n_queries // QUERY_BLOCK)
        numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.pmod(F.xxhash64(id_col), F.lit(a)).cast("int").alias("vb"), numbers(b).alias("qb"))
        right = asked.select("query_id", "q", F.pmod(F.xxhash64("query_id"), F.lit(b)).cast("int").alias("qb"), numbers(a).alias("vb"))

        def of_blocks(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            names = y["query_id"].tolist()
            ids, best = _nearest(x["id"].tolist(), x["v"].tolist(), names, _unit(y["q"].tolist()), limit) if names else (np.zeros((0, 0)), np.zeros((0, 0)))
            return pd.DataFrame({"query_id": [n for n in names for _ in range(best.shape[1])], id_col: ids.ravel().tolist(), "s": best.ravel()})

        every = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInPandas(of_blocks, schema)
    by_query = Window.partitionBy("query_id").orderBy(F.col("s").desc(), id_col)
    return every.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= limit).select("query_id", id_col, F.round("s", 4).alias("score"), "rank")


class _Buckets(dict):
    """The bucket of a gram's hash, remembered for as many grams as fit in some megabytes."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions

    def __missing__(self, gram: str) -> int:
        if len(self) >= MEMO_GRAMS:
            self.clear()
        self[gram] = k = int(hashlib.blake2b(gram.encode(), digest_size=8).hexdigest(), 16) % self.dimensions
        return k


def hash_vector(text: str, dimensions: int = HASH_DIMENSIONS, buckets: dict[str, int] | None = None) -> np.ndarray:
    """Signed hashes of the words, weighed by position, and of the 3- to 5-grams of characters; of length 1."""
    v = np.zeros(dimensions, dtype=np.float32)
    lowered = text.lower().strip()
    for i, word in enumerate(lowered.split()):
        data = word.encode()
        a, b = (int(h(data).hexdigest(), 16) % dimensions for h in (hashlib.md5, hashlib.sha256))
        signed = (1.0 if a % 2 == 0 else -1.0) / np.sqrt(i + 1.0)
        v[a] += signed
        v[b] -= 0.5 * signed
    buckets = _Buckets(dimensions) if buckets is None else buckets
    grams = [buckets[lowered[i : i + n]] for n in (3, 4, 5) for i in range(len(lowered) - n + 1)]
    v += np.float32(0.25) * np.bincount(np.array(grams, dtype=np.int64), minlength=dimensions).astype(np.float32)
    length = float(np.linalg.norm(v))
    return v / length if length > 1e-6 else v


def hash_embed(texts: DataFrame, id_col: str, text_col: str, dimensions: int = HASH_DIMENSIONS) -> DataFrame:
    """id_col, embedding; Spark has no such hash, hence a UDF on Arrow batches."""

    @F.pandas_udf("array<float>")
    def embed(text: Iterator[pd.Series]) -> Iterator[pd.Series]:
        buckets = _Buckets(dimensions)
        for part in text:
            yield pd.Series([hash_vector(t or " ", dimensions, buckets) for t in part])

    return texts.select(id_col, embed(F.col(text_col)).alias("embedding"))


def embed_query(query: str, dimensions: int = HASH_DIMENSIONS) -> list[float]:
    """The vector of one query's text, as hash_embed makes those of texts."""
    return hash_vector(query or " ", dimensions).tolist()


def point_id(chunk_id: Column) -> Column:
    """The name-based (version 5, DNS namespace) UUID of a chunk's key."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8")), F.encode(chunk_id, "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
