"""The registered queries of the numbered problems, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvath.session import cut_lineage, table

from . import bpe, encodings, main_content, near_duplicates, packing, page_noise, site_lines, spans, splitting

CHAR_FIELDS = {"ingested_documents.raw_content": ("ingested_documents", "raw_content"), "document_chunks.content": ("document_chunks", "content")}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    noise, _, _ = page_noise.page_noise(table(spark, sf_dir, "ingested_documents"), table(spark, sf_dir, "document_chunks"))
    return noise.select("chunk_id", "noise").distinct()


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    noise, pages, _ = page_noise.page_noise(table(spark, sf_dir, "ingested_documents"), table(spark, sf_dir, "document_chunks"))
    return page_noise.cleaned(noise, pages)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, _ = main_content.extract(table(spark, sf_dir, "ingested_documents"), _sites(spark, sf_dir))
    return pages.select("document_id", F.explode("noise").alias("line_no"))


def p2_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every canonical URL; of several documents of one URL each has its row."""
    pages, _ = main_content.extract(table(spark, sf_dir, "ingested_documents"), _sites(spark, sf_dir))
    urls = table(spark, sf_dir, "crawl_pages").where("document_id is not null and canonical_url is not null").select("document_id", "canonical_url").distinct()
    return pages.join(urls, "document_id", "left").select("canonical_url", "document_id", "article")


def p2_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_content.extract(table(spark, sf_dir, "ingested_documents"), _sites(spark, sf_dir))[1]


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source is its site, else the program that made it, else its kind; a chunk's that of its document."""
    meta = F.col("doc_metadata")
    documents = table(spark, sf_dir, "ingested_documents").withColumn("source", F.coalesce(meta["domain"], meta["producer"], F.col("source_type")))
    of_document = documents.select(F.col("id").alias("document_id"), "source").where("document_id is not null").dropDuplicates(["document_id"])
    few = of_document.count() <= 200_000  # some 20 MB; more of them are joined
    chunks = table(spark, sf_dir, "document_chunks").join(F.broadcast(of_document) if few else of_document, "document_id", "left")
    records = documents.select(F.lit("document").alias("record_kind"), F.col("id").alias("record_id"), F.col("raw_content").alias("text"), "source").unionByName(
        chunks.select(F.lit("chunk").alias("record_kind"), F.col("id").alias("record_id"), F.col("content").alias("text"), "source")
    )
    runs = encodings.runs_by_source(records)
    model = encodings.learn(runs)
    return encodings.wrongly_decoded(records, model, encodings.ciphers(runs, model))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir).select("record_kind", "record_id").distinct()


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that the splitter cuts, from its table of pieces."""
    limits = table(spark, sf_dir, "size_limits")
    parts = [
        splitting.pieces(table(spark, sf_dir, name), "id", column, splitting.limits_of(limits, field)).select("limit_name", "record_id")
        for field, (name, column) in CHAR_FIELDS.items()
    ]
    return parts[0].unionByName(parts[1]).distinct()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = table(spark, sf_dir, "size_limits")
    documents, chunks = table(spark, sf_dir, "ingested_documents"), table(spark, sf_dir, "document_chunks")
    of_documents = splitting.split_records(documents, "id", "raw_content", splitting.limits_of(limits, "ingested_documents.raw_content"))
    of_chunks = splitting.split_records(chunks, "id", "content", splitting.limits_of(limits, "document_chunks.content"), "location_meta")
    return of_documents.withColumn("location_meta", F.lit(None).cast(chunks.schema["location_meta"].dataType)).unionByName(of_chunks)


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "ingested_documents"), threshold=0.6, shingle=3)  # as TESTDATA.md has it


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.all_pairs(*_near(spark, sf_dir))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.groups(*_near(spark, sf_dir))


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.domains_of_documents(table(spark, sf_dir, "crawl_pages"), table(spark, sf_dir, "crawl_jobs"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.repeated_lines(table(spark, sf_dir, "ingested_documents"), _sites(spark, sf_dir)).select("domain", "line")


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, sites = table(spark, sf_dir, "ingested_documents"), _sites(spark, sf_dir)
    return site_lines.without_repeated_lines(documents, sites, site_lines.repeated_lines(documents, sites), clusters=site_lines.repeated_clusters(documents, sites))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf_dir, "documents"))


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    limits = table(spark, sf_dir, "size_limits").where("field_name = 'documents.text' and unit = 'token'")
    sizes = cut_lineage(bpe.token_counts(table(spark, sf_dir, "documents")))  # counted once, read by every round
    return packing.pack(sizes, limits), limits


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)[0]


def p8_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.certificate(*_packed(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p9_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.merged(spans.shared_spans(table(spark, sf_dir, "documents")))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return spans.shares(documents, spans.shared_spans(documents))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_clean": p1_clean,
    "p2_found": p2_found,
    "p2_articles": p2_articles,
    "p2_wrappers": p2_wrappers,
    "p3_found": p3_found,
    "p3_restored": p3_restored,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_found": p6_found,
    "p6_clean": p6_clean,
    "p7_ids": p7_ids,
    "p8_containers": p8_containers,
    "p8_certificate": p8_certificate,
    "p9_found": p9_found,
    "p9_runs": p9_runs,
    "p9_shares": p9_shares,
}

_SITE_LINES = r"""
with sites as (
  select distinct p.document_id, lower(trim(j.domain)) as domain
  from crawl_pages p join crawl_jobs j on j.id = p.job_id where p.document_id is not null and j.domain is not null),
texts as (select s.domain, d.id, d.raw_content from ingested_documents d join sites s on s.document_id = d.id where d.raw_content is not null),
totals as (select domain, count(distinct id) as n from texts group by domain),
lines as (
  select distinct domain, id, regexp_replace(lower(trim(regexp_replace(raw, '[ \t\r]+', ' ', 'g'))), '[0-9]+', '0', 'g') as line
  from (select domain, id, unnest(string_split(raw_content, chr(10))) as raw from texts)),
repeated as (
  select l.domain, l.line from lines l join totals t on t.domain = l.domain
  where l.line <> '' group by l.domain, l.line, t.n having count(*) >= 10 and count(*) >= 0.1 * t.n)
"""

_SPANS = """
with windows as (
  select doc_id, length(text) as n, i, md5(substring(text, i, 200)) as h
  from (select doc_id, text, unnest(range(1, length(text) - 198)) as i from documents where length(text) >= 200)),
shared as (select h from windows group by h having count(distinct doc_id) > 1),
hits as (select distinct w.doc_id, w.i from windows w join shared s on s.h = w.h),
marked as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 200 then 0 else 1 end as new from hits),
runs as (select doc_id, i, sum(new) over (partition by doc_id order by i) as run from marked),
merged as (select doc_id, (min(i) - 1)::int as "start", (max(i) + 199)::int as "end" from runs group by doc_id, run)
"""

SQL: dict[str, str] = {
    "p9_found": _SPANS + "select distinct doc_id from hits",
    "p9_runs": _SPANS + 'select doc_id, "start", "end" from merged',
    "p9_shares": _SPANS + """
select d.doc_id, coalesce(length(d.text), 0) as n_chars, coalesce(c.covered, 0)::bigint as shared_chars,
  case when length(d.text) > 0 then round(coalesce(c.covered, 0) / length(d.text), 6) else 0.0 end as share
from documents d left join (select doc_id, sum("end" - "start") as covered from merged group by doc_id) c on c.doc_id = d.doc_id""",
    "p4_found": """
select distinct l.limit_name, d.id as record_id from ingested_documents d join size_limits l
  on l.field_name = 'ingested_documents.raw_content' and l.unit = 'char' and length(d.raw_content) > l.max_size
union
select distinct l.limit_name, c.id from document_chunks c join size_limits l
  on l.field_name = 'document_chunks.content' and l.unit = 'char' and length(c.content) > l.max_size""",
    "p5_found": r"""
with words as (select id, list_filter(regexp_split_to_array(lower(raw_content), '[ \t\r\n]+'), lambda w: w <> '') as w from ingested_documents where raw_content is not null),
shingles as (select distinct id, hash(s) as s from (select id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i+2])) as s from words where len(w) >= 3)),
sizes as (select id, count(*) as n from shingles group by id),
common as (select a.id as id_a, b.id as id_b, count(*) as c from shingles a join shingles b on a.s = b.s and a.id < b.id group by 1, 2)
select id_a, id_b from common join sizes x on x.id = id_a join sizes y on y.id = id_b where c >= 0.6 * (x.n + y.n - c)""",
    "p6_found": _SITE_LINES + "select domain, line from repeated",
}
