import hashlib
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvath.operators import catalog, chunk

BLOCKS = "document_id string, block_no int, text string, line_start int, line_end int, section string"


def fold(blocks, target, overlap):
    """The rule, spelled out."""
    out, parts, n, a, b, sections = [], [], 0, None, None, []

    def put():
        out.append(("\n\n".join(parts), a, b, list(sections)))

    for text, start, end, section in blocks:
        if not (text := text.strip()):
            continue
        a, b = min(start, a or start), max(end, b or end)
        if section not in sections:
            sections.append(section)
        parts.append(text)
        n += len(text)
        if n >= target:
            put()
            parts = [parts[-1]] if len(parts) > 1 and len(parts[-1]) < overlap else []
            n, a, b, sections = sum(map(len, parts)), None, None, []
    if parts:
        put()
    return out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text("ab c", max_size=30), st.sampled_from(["s", "t"])), max_size=25))
def test_fold_follows_the_rule(spark, items):
    rows = [("d", i, t, i + 1, i + 1, s) for i, (t, s) in enumerate(items)]
    got = chunk.fold_blocks(spark.createDataFrame(rows, BLOCKS), 40, 12).orderBy("chunk_index").collect()
    assert [(r.content, r.line_start, r.line_end, r.sections) for r in got] == fold([r[2:] for r in rows], 40, 12)


def test_describe(spark):
    rows = [("d", 0, "x" * 50, None, None, ["s"], [3, 1]), ("d", 1, "ab", 4, 9, [], []), ("d", 2, "ab", None, None, ["s", "t"], []), ("d", 3, "ab", None, None, [], [7])]
    df = spark.createDataFrame(rows, "document_id string, chunk_index int, content string, line_start int, line_end int, sections array<string>, pages array<int>")
    got = chunk.describe(df).orderBy("chunk_index").collect()
    assert [r.anchor_label for r in got] == ["Pages 1-3", "Lines 4-9", "Section: s", "Page 7"]
    assert [r.token_count for r in got] == [12, 1, 1, 1] and got[1].chunk_hash == hashlib.sha256(b"1:ab").hexdigest()


def test_plain_chunks(spark):
    df = spark.createDataFrame([("a", "x" * 1300 + " " * 1500 + "y" * 10), ("b", ""), ("c", None), ("d", "  ")], "id string, t string")
    got = chunk.plain_chunks(df, "id", "t").collect()
    assert [(r.document_id, r.chunk_index, len(r.content)) for r in got] == [("a", 0, 1300), ("a", 1, 10)]


DOCS = "id string, title string, source_type string, raw_content string, created_at timestamp"


def docs(spark):
    t = lambda d: datetime(2024, 1, d)
    return spark.createDataFrame([("a", "A", "note", "same", t(3)), ("b", "B", "web", "same", t(1)), ("c", "C", "web", None, t(2)), ("d", "D", "web", None, None), ("e", "E", "note", "own", None)], DOCS)


def test_dedup_and_new(spark):
    assert {(r.id, r.copies) for r in catalog.first_of_each_hash(docs(spark), "id", "raw_content", "created_at").collect()} == {("b", 2), ("e", 1)}
    d = docs(spark)
    assert {r.id for r in catalog.new_documents(d.where("source_type = 'note'"), d.where("source_type = 'web'"), "raw_content").collect()} == {"e"}


def test_listing_details_and_deletion(spark):
    chunks = spark.createDataFrame([("c1", "a", 0, "x"), ("c1", "a", 0, "x"), ("c9", "a", 0, "x"), ("c2", "a", 1, "y"), ("c3", "b", 0, "z")], "id string, document_id string, chunk_index int, content string")
    got = catalog.list_documents(docs(spark), chunks, None, 3)
    assert [(r.id, r.chunk_count) for r in got.collect()] and {r.id: r.chunk_count for r in got.collect()} == {"a": 2, "c": 0, "b": 1}
    documents, left, index = catalog.delete_documents(spark.createDataFrame([("a",)], "id string"), docs(spark), chunks, chunks)
    assert documents.count() == 4 and left.count() == 1 and index.count() == 1
    with pytest.raises(ValueError):
        catalog.list_documents(docs(spark), chunks, None, 101)


def test_upsert_counters_domains_jobs(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert {tuple(r) for r in catalog.upsert(one, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), "k").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    pages = spark.createDataFrame([("p", "j", 200), ("p", "j", 200), ("q", "j", 403), ("r", "j", None)], "id string, job_id string, status_code int")
    assert tuple(catalog.job_counters(pages).first()) == ("j", 1, 2)
    domains = spark.createDataFrame([("x.org", True, 2, 1.0)], "domain string, enabled boolean, max_depth int, rate_limit_delay double")
    assert catalog.add_domain(domains, "https://Y.org:80/a").count() == 2
    for bad in (dict(domain="X.org"), dict(domain="z.org", max_depth=9)):
        with pytest.raises(ValueError):
            catalog.add_domain(domains, **bad)
    assert not catalog.toggle_domain(domains, "x.org", False).first().enabled
    jobs = spark.createDataFrame([("a", "running"), ("b", "completed")], "id string, status string")
    assert {r.status for r in catalog.cancel_job(catalog.cancel_job(jobs, "a"), "b").collect()} == {"cancelled", "completed"}
