"""Documents and chunks as tables: ingest with deduplication, listings, details, deletion, job and domain bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvath.functions.urls import canonical_url, normalize_domain, url_domain
from corvath.operators.crawl import allowed


def content_hash(documents: DataFrame, text_col: str) -> DataFrame:
    return documents.withColumn("sha256", F.sha2(F.col(text_col), 256))


def first_of_each_hash(documents: DataFrame, id_col: str, text_col: str, order_col: str) -> DataFrame:
    """One row per content: the earliest, ties by id. Null contents are never duplicates of one another.

    min_by() over a struct aggregates before the shuffle, so a content that a third of all rows share is no hot group.
    """
    hashed = documents.select(F.col(id_col).alias("id"), F.col(order_col).alias("at"), F.sha2(F.col(text_col), 256).alias("sha256"))
    same = hashed.where("sha256 is not null").groupBy("sha256").agg(F.min(F.struct(F.col("at").isNull().alias("late"), "at", "id")).alias("f"), F.count(F.lit(1)).alias("copies"))
    return same.select(F.col("f.id").alias("id"), "sha256", "copies")


def new_documents(batch: DataFrame, existing: DataFrame, text_col: str) -> DataFrame:
    """The rows of a batch whose content isn't among the existing documents'."""
    known = existing.where(F.col(text_col).isNotNull()).select(F.sha2(F.col(text_col), 256).alias("sha256")).distinct()
    return batch.withColumn("sha256", F.sha2(F.col(text_col), 256)).join(known, "sha256", "left_anti")


def merge_metadata(given: str, parsed: str):
    """Two maps made one; the parser's entries win."""
    return F.map_concat(F.map_filter(F.coalesce(given, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(F.coalesce(F.col(parsed), F.create_map().cast("map<string,string>")), k)), F.coalesce(parsed, F.create_map().cast("map<string,string>")))


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks by document and index: exact duplicate rows and second ids of the same chunk count once."""
    return chunks.where("document_id is not null and chunk_index is not null").groupBy("document_id", "chunk_index").agg(F.min_by(F.struct("content", "token_count", "chunk_hash", "location_meta.anchor_label"), "id").alias("c"))


def list_documents(documents: DataFrame, chunks: DataFrame, source_type: str | None, limit: int, offset: int = 0) -> DataFrame:
    """The page of documents, latest first, with their number of chunks."""
    if not (1 <= limit <= 100 and offset >= 0):
        raise ValueError("limit must be 1 to 100, offset not negative")
    own = documents.where(F.col("source_type") == source_type) if source_type else documents
    page = own.select("id", "title", "source_type", "created_at").orderBy(F.col("created_at").desc(), "id").offset(offset).limit(limit)
    counts = chunks.select("document_id", "chunk_index").distinct().groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    return page.join(counts, F.col("id") == F.col("document_id"), "left").select("id", "title", "source_type", F.unix_micros("created_at").alias("created_us"), F.coalesce("n", F.lit(0)).alias("chunk_count"))


def delete_documents(doomed: DataFrame, documents: DataFrame, chunks: DataFrame, *indexes: DataFrame) -> list[DataFrame]:
    """Documents, chunks and every index by document_id without the doomed ids: all stores lose them together."""
    ids = doomed.select(F.col("id").alias("document_id")).distinct()
    return [documents.join(ids.withColumnRenamed("document_id", "id"), "id", "left_anti"), *(x.join(ids, "document_id", "left_anti") for x in (chunks, *indexes))]


def upsert(existing: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The existing rows, replaced where the key comes again."""
    return existing.join(rows.select(key), key, "left_anti").unionByName(rows)


def job_counters(pages: DataFrame) -> DataFrame:
    """job_id, pages_crawled, pages_failed recomputed from page rows; an exact duplicate row counts once."""
    once = pages.select("id", "job_id", "status_code").distinct()
    return once.groupBy("job_id").agg(F.count_if(F.col("status_code") == 200).alias("pages_crawled"), F.count_if((F.col("status_code") != 200) | F.col("status_code").isNull()).alias("pages_failed"))


def recent_jobs(jobs: DataFrame, limit: int = 100) -> DataFrame:
    return jobs.select("id", normalize_domain(F.col("domain")).alias("domain"), "status", F.unix_micros("created_at").alias("created_us")).orderBy(F.col("created_us").desc(), "id").limit(limit)


def add_domain(domains: DataFrame, domain: str, max_depth: int = 2, rate_limit_delay: float = 1.0) -> DataFrame:
    """The allowlist with one more domain; a ValueError where it is there already or its settings are out of range."""
    if not (1 <= max_depth <= 5 and 0.2 <= rate_limit_delay <= 10):
        raise ValueError("max_depth must be 1 to 5, rate_limit_delay 0.2 to 10")
    name = domains.sparkSession.range(1).select(normalize_domain(F.lit(domain)).alias("d")).first().d
    if not domains.where(F.col("domain") == name).isEmpty():
        raise ValueError(f"{name} is on the list")
    row = domains.sparkSession.createDataFrame([(name, True, max_depth, rate_limit_delay)], "domain string, enabled boolean, max_depth int, rate_limit_delay double")
    return domains.unionByName(row, allowMissingColumns=True)


def toggle_domain(domains: DataFrame, domain: str, enabled: bool) -> DataFrame:
    return domains.withColumn("enabled", F.when(F.col("domain") == domain, F.lit(enabled)).otherwise(F.col("enabled")))


def cancel_job(jobs: DataFrame, job_id: str) -> DataFrame:
    """A queued or running job made cancelled; any other stays as it is."""
    return jobs.withColumn("status", F.when((F.col("id") == job_id) & F.col("status").isin("queued", "running"), "cancelled").otherwise(F.col("status")))


def delete_domain(domains: DataFrame, domain: str) -> DataFrame:
    """The allowlist without a domain; a ValueError where it isn't there."""
    if domains.where(F.col("domain") == domain).isEmpty():
        raise ValueError(f"{domain} isn't on the list")
    return domains.where(F.col("domain").isNull() | (F.col("domain") != domain))


def create_jobs(requests: DataFrame, domains: DataFrame) -> DataFrame:
    """id, seed_url, domain, status, max_depth, max_pages, rate_limit_delay of requested crawls (id, seed_url, max_depth,
    max_pages, rate_limit_delay).

    Status is queued, or rejected where the seed has no host, its domain isn't on the list (unless the list has no
    enabled domain at all), or depth (1 to 5), pages (1 to 100) or delay (0.1 to 10) are out of range. A delay that isn't
    given is the domain's, else 1.
    """
    enabled = domains.where("enabled").select(normalize_domain(F.col("domain")).alias("domain"), F.col("rate_limit_delay").alias("own_delay")).dropDuplicates(["domain"])
    none = enabled.isEmpty()
    asked = requests.withColumn("domain", url_domain(F.col("seed_url")))
    fine = allowed(asked.select("id", "seed_url"), domains, "seed_url").select("id", F.lit(True).alias("listed")).distinct()
    joined = asked.join(fine, "id", "left").join(enabled, "domain", "left").withColumn("delay", F.coalesce("rate_limit_delay", "own_delay", F.lit(1.0)))
    good = (F.coalesce("listed", F.lit(False)) | F.lit(none)) & F.col("domain").isNotNull() & F.col("max_depth").between(1, 5) & F.col("max_pages").between(1, 100) & F.col("delay").between(0.1, 10.0)
    return joined.select("id", canonical_url(F.col("seed_url")).alias("seed_url"), "domain", F.when(good, "queued").otherwise("rejected").alias("status"), "max_depth", "max_pages", F.col("delay").alias("rate_limit_delay"))
