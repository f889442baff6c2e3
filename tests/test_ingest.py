from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corvath.operators import catalog, crawl, evaluate, ingest, ranking
from corvath.sources import sinks

FILES = "file_path string, mime_type string, content binary, source_type string, doc_metadata map<string,string>, created_at timestamp, sha256 string"
DAY = datetime(2024, 1, 1)
MARKDOWN = b"# Search Architecture\nIntro line.\n## Ranking\nBoosts.\n## Storage\nTables."
CODE = b"def score(x):\n    y = x\n    return y\n# end"
HTML = b"<html><head><title>Guide</title></head><body><script>evil()</script><h1>Setup</h1><p>Run it.</p></body></html>"


def test_files_of_all_kinds(spark):
    rows = [
        ("docs/architecture.md", None, MARKDOWN, "upload", {"filename": "given", "tag": "x"}, DAY, "clash"),
        ("scoring.py", None, CODE, "code", None, DAY, None),
        ("page.html", "text/html", HTML, "web", {}, DAY, None),
        ("meeting.txt", None, b"first line\nsecond line\n", "upload", None, DAY, None),
        ("meeting-copy.txt", None, b"first line\nsecond line\n", "upload", None, DAY, None),
        ("latin.txt", None, b"caf\xe9", "upload", None, DAY, None),
        ("stored.txt", None, b"stored", "upload", None, DAY, None),
        ("empty.txt", None, b"", "upload", None, None, None),
        ("null.txt", None, None, "upload", None, DAY, None),
        ("broken.docx", None, b"no zip", "upload", None, DAY, None),
        ("scan.pdf", None, b"%PDF", "upload", None, DAY, None),
    ]
    known = spark.createDataFrame([(b"stored",), (None,)], "content binary").select(F.sha2("content", 256).alias("sha256"))
    documents, chunks = ingest.ingest(spark.createDataFrame(rows, FILES).drop("sha256"), known)
    got = {r.file_path: r for r in documents.collect()}
    assert set(got) == {"docs/architecture.md", "scoring.py", "page.html", "meeting-copy.txt", "latin.txt", "empty.txt", "broken.docx"}
    assert got["docs/architecture.md"].title == "Search Architecture" and got["scoring.py"].title == "scoring.py" and got["page.html"].title == "Guide"
    assert got["meeting-copy.txt"].title == "Meeting Copy" and got["meeting-copy.txt"].doc_metadata == {"filename": "meeting-copy.txt", "total_lines": "2"}
    assert got["docs/architecture.md"].doc_metadata == {"filename": "architecture.md", "tag": "x", "total_lines": "6"}
    assert got["scoring.py"].doc_metadata["language"] == "python" and got["latin.txt"].raw_content == "café"
    of = {}
    for c in chunks.collect():
        of.setdefault(c.document_id, []).append(c.content)
    key = {k: r.sha256 for k, r in got.items()}
    assert of[key["docs/architecture.md"]] == ["Intro line.\n\nBoosts.\n\nTables."]
    assert of[key["page.html"]] == ["Setup\n\nRun it."] and key["empty.txt"] not in of and key["broken.docx"] not in of


def test_empty_ingest(spark):
    documents, chunks = ingest.ingest(spark.createDataFrame([], FILES).drop("sha256"), spark.createDataFrame([], "sha256 string"))
    assert documents.count() == 0 and chunks.count() == 0
    assert spark.range(1).select(ingest.note_file(F.lit("My Note")).alias("f")).first().f == "my_note.txt"


def test_jobs_and_domains(spark):
    domains = spark.createDataFrame([("docs.org", True, 0.5), ("off.org", False, 1.0)], "domain string, enabled boolean, rate_limit_delay double")
    asked = [("a", "https://docs.org/x?utm_a=1", 2, 10, None), ("b", "https://off.org/", 2, 10, None), ("c", "https://docs.org/", 9, 10, None), ("d", "nonsense", 2, 10, None), ("e", "http://docs.org", 1, 1, 20.0)]
    jobs = {r.id: r for r in catalog.create_jobs(spark.createDataFrame(asked, "id string, seed_url string, max_depth int, max_pages int, rate_limit_delay double"), domains).collect()}
    assert {k: r.status for k, r in jobs.items()} == {"a": "queued", "b": "rejected", "c": "rejected", "d": "rejected", "e": "rejected"}
    assert jobs["a"].rate_limit_delay == 0.5 and jobs["a"].seed_url == "https://docs.org/x"
    none = catalog.create_jobs(spark.createDataFrame(asked[:1], "id string, seed_url string, max_depth int, max_pages int, rate_limit_delay double"), domains.where("not enabled"))
    assert none.first().status == "queued"
    assert [r.domain for r in catalog.delete_domain(domains, "docs.org").collect()] == ["off.org"]
    with pytest.raises(ValueError):
        catalog.delete_domain(domains, "no.org")


def test_many_wildcards(spark):
    patterns = [(f"*.site{i}.org", True) for i in range(1500)] + [("mid.*.net", True), ("any.*", True)]
    urls = spark.createDataFrame([("http://a.site7.org/x",), ("http://site7.org/",), ("http://a.site1499.org",), ("http://mid.b.net/",), ("http://any.com/",), ("http://other.com/",), (None,)], "url string")
    got = {r.url for r in crawl.allowed(urls, spark.createDataFrame(patterns, "domain string, enabled boolean")).collect()}
    assert got == {"http://a.site7.org/x", "http://a.site1499.org", "http://mid.b.net/", "http://any.com/"}


def test_search_over_written_indexes(spark, tmp_path):
    hits = spark.createDataFrame([("a_0", "a", "Index", "search the index"), ("b_0", "b", "Two", "index index"), ("c_0", "c", "Three", "nothing")], "chunk_id string, document_id string, title string, content string")
    old, new = str(tmp_path / "i"), str(tmp_path / "j")
    n = sinks.build_indexes(hits, old, "all")
    assert n == 16
    ranked = [r.chunk_id for r in sinks.search_index(spark, old, "Index", {"title": 3.0, "content": 1.0}, n).orderBy(F.desc("score")).collect()]
    assert ranked == ["a_0", "b_0"]
    sinks.delete_from_indexes(spark, old, spark.createDataFrame([("a",)], "document_id string"), hits, new)
    assert [r.chunk_id for r in sinks.search_index(spark, new, "index", {"title": 3.0, "content": 1.0}, n).collect()] == ["b_0"]
    assert spark.read.parquet(f"{new}/lengths_content").first().n == 2


def test_explanations_tell_all_signals(spark):
    row = ("w", "Search guide", "the search guide", "web", DAY, 2.0, 1, 3, 0.0312, 0.87654, "Guide: 1-2", "docs.x.org")
    schema = "chunk_id string, title string, content string, source_type string, created_at timestamp, score double, lexical_rank int, semantic_rank int, rrf_score double, semantic_score double, anchor_label string, host string"
    lines = ranking.rerank(spark.createDataFrame([row], schema), "search guide", datetime(2024, 3, 1)).first().explanation
    assert lines[0].startswith("Fused base: 2.0000") and "Anchor: a term of the query" in lines and "Curated host" in lines
    assert any("(2 months)" in x for x in lines) and "Similarity: 0.877" in lines and "Ranks: lexical #1, semantic #3" in lines


def test_three_modes(spark):
    lex = spark.createDataFrame([(1, "c1", 2.0), (1, "c2", 1.0)], "query_id int, item string, score double")
    sem = spark.createDataFrame([(1, "c2", 0.9), (1, "c3", 0.5)], "query_id int, item string, score double")
    found = evaluate.by_mode(lex, sem)
    assert [r.item for r in found.where("mode = 'hybrid'").orderBy("rank").collect()] == ["c2", "c1", "c3"]
    judged = spark.createDataFrame([(1, "c2", 3.0), (2, "c9", 1.0)], "query_id int, item string, grade double")
    got = {(r["mode"], r.query_id): r.mrr for r in evaluate.metrics_by_mode(found, judged).collect()}
    assert got == {("lexical", 1): 0.5, ("semantic", 1): 1.0, ("hybrid", 1): 1.0, ("lexical", 2): 0.0, ("semantic", 2): 0.0, ("hybrid", 2): 0.0}
