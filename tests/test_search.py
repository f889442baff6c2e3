import math
from collections import Counter
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvath.functions.text import STOPWORDS
from corvath.operators import evaluate, lexical, ranking, search, snippets, vector

NOW = datetime(2025, 1, 1, tzinfo=timezone.utc)
HITS = "chunk_id bigint, title string, content string, source_type string, created_at timestamp"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("title,anchor,low,high", [("Vector Search Guide", "", 1.5, 1.6), ("Search with a vector", "", 1.3, 1.49), ("Other", "vector part", 1.1, 1.1), ("Other", "", 1.0, 1.0), (None, None, 1.0, 1.0), ("Vector Search", "search", 1.6, 1.6)])
def test_title_boost(spark, title, anchor, low, high):
    assert low <= one(spark, ranking.title_boost(F.lit(title).cast("string"), F.lit(anchor).cast("string"), "vector search")) <= high


@pytest.mark.parametrize("kind,host,value", [("note", None, 1.3), ("upload", None, 1.2), ("code", "docs.x", 1.15), ("web", "a.org", 1.0), ("web", "docs.a.org", 1.1), (None, None, 1.0)])
def test_authority(spark, kind, host, value):
    assert one(spark, ranking.authority_boost(F.lit(kind).cast("string"), F.lit(host).cast("string"))) == value


def test_freshness(spark):
    at = lambda d: one(spark, ranking.freshness_boost(F.lit(NOW - timedelta(days=d)).cast("timestamp"), NOW))
    assert at(0) >= 0.99 and 0.73 <= at(90) <= 0.77 and 0.5 <= at(365) < at(90) and at(-5) == 1.0
    assert one(spark, ranking.freshness_boost(F.lit(None).cast("timestamp"), NOW)) == 0.9


@pytest.mark.parametrize("content,query,value", [("a hybrid  search engine", "hybrid search", 1.25), ("search in a hybrid way", "hybrid search", 1.1), ("hybrid " + "x " * 20 + "search", "hybrid search", 1.0), ("hybrid", "hybrid", 1.0), (None, "hybrid search", 1.0)])
def test_phrase(spark, content, query, value):
    assert one(spark, ranking.phrase_boost(F.lit(content).cast("string"), query)) == value


def test_rerank_prefers_the_fresh_note(spark):
    rows = [(1, "Old page", "about boats", "web", NOW - timedelta(days=700), 3.0), (2, "Search ranking", "about search ranking", "note", NOW, 2.2)]
    got = ranking.rerank(spark.createDataFrame(rows, HITS + ", score double"), "search ranking", NOW).orderBy(F.col("final_score").desc()).collect()
    assert got[0].chunk_id == 2 and got[0].explanation[0] == "Base: 2.2000"


def test_rrf(spark):
    lex = spark.createDataFrame([("c1", 1, 2.0), ("c2", 2, 1.0)], "chunk_id string, lexical_rank int, score double")
    sem = spark.createDataFrame([("c2", 1, 0.9), ("c3", 2, 0.8)], "chunk_id string, semantic_rank int, score double")
    got = {r.chunk_id: r.rrf_score for r in search.rrf(lex, sem).collect()}
    assert math.isclose(got["c2"], 1 / 62 + 1 / 61) and math.isclose(got["c1"], 1 / 61) and len(got) == 3


TEXTS = ["the index stores terms", "search the index of the archive", "boats and boats", "", "index index search", "archive"]


def hits(spark):
    rows = [(i, f"Title {i}", t, "note" if i % 2 else "web", NOW) for i, t in enumerate(TEXTS)] + [(9, None, None, None, None)]
    return spark.createDataFrame(rows, HITS)


def test_term_counts(spark):
    got = lexical.term_count_search(hits(spark), "Index search", 10).collect()
    assert [(r.chunk_id, r.score) for r in got] == [(4, 3.0), (1, 2.0), (0, 1.0)]
    assert [r.chunk_id for r in lexical.term_count_search(hits(spark), "index search", 10, "note").collect()] == [1]


def test_bm25_equals_brute_force(spark):
    docs = {i: [w for w in t.split() if w not in STOPWORDS] for i, t in enumerate(TEXTS)}
    docs = {i: t for i, t in docs.items() if t}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    expected = {}
    for i, t in docs.items():
        for q in ("index", "search"):
            if tf := Counter(t)[q]:
                df = sum(q in x for x in docs.values())
                expected[i] = expected.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
    queries = spark.createDataFrame([(7, "index"), (7, "search")], "query_id int, term string")
    got = {r.chunk_id: r.score for r in lexical.bm25(lexical.postings(hits(spark), "content"), lexical.lengths(hits(spark), "content"), queries).collect()}
    assert got.keys() == expected.keys() and all(math.isclose(got[k], expected[k]) for k in got)


def test_fuzzy(spark):
    vocabulary = spark.createDataFrame([(t,) for t in ("search", "saerch", "serch", "research", "index", "indexes", "ab", "ba", "xndex", "inxed")], "term string")
    got = {(r.query_term, r.term) for r in lexical.fuzzy_terms(vocabulary, "search index ab").collect()}
    assert {("search", "serch"), ("search", "saerch"), ("index", "xndex"), ("ab", "ab"), ("search", "research")} <= got
    assert ("ab", "ba") not in got and ("index", "inxed") not in got and ("index", "indexes") not in got


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)] + [(60, None), (61, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    m = np.array([r[1] for r in rows[:60]], dtype=np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    got = vector.batch_search(df, df.where("vec_id % 20 = 0 and vec_id < 60"), 5).collect()
    for q in (0, 20, 40):
        expected = np.argsort(-(m @ m[q]), kind="stable")[:5]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == expected.tolist()
    few, many = df.where("vec_id % 7 = 0 and vec_id < 60"), [tuple(r) for r in vector.batch_search(df, df.where("vec_id % 7 = 0 and vec_id < 60"), 5).collect()]
    monkeypatch.setattr(vector, "QUERY_BLOCK", 4)
    monkeypatch.setattr(vector, "VECTOR_BLOCK", 25)
    assert sorted(many) == sorted(tuple(r) for r in vector.batch_search(df, few, 5).collect())  # blocks of queries and of vectors
    near = vector.cosine_search(df.where("vec_id < 60"), rows[20][1], 3).collect()
    assert near[0].vec_id == 20 and near[0].score == 1.0
    assert vector.batch_search(df, df.where("vec_id = 60"), 5).count() == 0


def test_hash_embedder_and_point_ids(spark):
    import uuid

    a, b = vector.hash_vector("vector search ranking"), vector.hash_vector("boats on the river")
    assert len(a) == 384 and abs(np.linalg.norm(a) - 1) < 1e-3 and np.array_equal(a, vector.hash_vector("vector search ranking")) and float(a @ b) < 0.95
    assert one(spark, vector.point_id(F.lit("doc_1"))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "doc_1"))


def test_snippets(spark):
    text = "x" * 100 + " class Search mark " + "y" * 300
    s = one(spark, snippets.snippet(F.lit(text), ["search", "mark"]))
    assert s.startswith("...") and s.endswith("...") and "<mark>Search</mark> <mark>mark</mark>" in s
    assert one(spark, snippets.snippet(F.lit("short"), ["none"])) == "short"
    assert one(spark, snippets.default_snippet(F.lit("z" * 300))) == "z" * 240 + "..."
    assert one(spark, snippets.fragments(F.lit("no"), F.lit("A search"), ["search"])) == "A <mark>search</mark>"


@pytest.mark.parametrize("mode", ["lexical", "semantic", "hybrid", "odd"])
def test_modes(spark, mode):
    vectors = spark.createDataFrame([(i, [float(i == j) for j in range(6)]) for i in range(6)], "chunk_id bigint, embedding array<float>")
    got = search.search(hits(spark), vectors, "index search", [0.0, 1.0, 0.0, 0.0, 0.0, 0.0], NOW, mode, 2).orderBy("position").collect()
    assert len(got) == 2 and [r.position for r in got] == [1, 2]
    assert search.search(hits(spark), vectors, "  ", [1.0] * 6, NOW, mode, 2).count() == 0
    second = search.search(hits(spark), vectors, "index search", [0.0, 1.0, 0.0, 0.0, 0.0, 0.0], NOW, mode, 1, 1).collect()
    assert second[0].chunk_id == got[1].chunk_id
    with pytest.raises(ValueError):
        search.search(hits(spark), vectors, "x", None, NOW, mode, 0)


def test_metrics(spark):
    retrieved = spark.createDataFrame([("q", f"doc{i}", i) for i in range(1, 6)] + [("n", "x", 1)], "query_id string, item string, rank int")
    judged = spark.createDataFrame([("q", "doc1", 3.0), ("q", "doc3", 1.0), ("q", "doc8", 1.0), ("q", "doc9", 1.0), ("m", "y", 3.0)], "query_id string, item string, grade double")
    got = {r.query_id: r for r in evaluate.metrics(retrieved, judged, (1, 2, 3, 5)).collect()}
    q = got["q"]
    assert (q.p_at_1, q.p_at_2, q.p_at_3, q.p_at_5, q.r_at_5, q.mrr) == (1.0, 0.5, 0.6667, 0.4, 0.5, 1.0) and 0.5 < q.ndcg_at_5 < 1
    assert got["n"].ndcg_at_5 == 1.0 and got["n"].mrr == 0.0  # nothing relevant to find
    assert got["m"].ndcg_at_5 == 0.0 and got["m"].r_at_5 == 0.0
    assert evaluate.means(evaluate.metrics(retrieved, judged).withColumn("mode", F.lit("x")), "mode").first().queries == 3
