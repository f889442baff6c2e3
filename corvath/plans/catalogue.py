"""The registered queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvath.functions import text as tx
from corvath.functions import urls
from corvath.operators import catalog, chunk, crawl, evaluate, ingest, lexical, ranking, search, snippets, vector
from corvath.session import ensure_checkpoint_dir, table
from corvath.sources import parse, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TEXT = "note says"
WORDS = tx.query_terms(TEXT)
AS_OF = datetime(2025, 4, 1, tzinfo=timezone.utc)
LIMIT = 20
FUZZY = "serach indx archve"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the corpus as one chunk: chunk_id, title, content, source_type, created_at."""
    return table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("chunk_id"), F.coalesce("title", F.lit("")).alias("title"), F.col("text").alias("content"), F.coalesce("source_type", F.lit("upload")).alias("source_type"), "created_at")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of least id stands for the query's: one row, a literal of the plan."""
    return table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()["embedding"]


HITS = "hits as (select doc_id as chunk_id, coalesce(title, '') as title, text as content, coalesce(source_type, 'upload') as source_type, created_at from documents where text is not null)"
WORD = r"[\p{L}\p{N}_]+"
# what the SQL takes for stop words, spelled out here so that it doesn't follow the operators' own list
STOP = "'a','an','and','are','as','at','be','but','by','for','if','in','into','is','it','no','not','of','on','or','such','that','the','their','then','there','these','they','this','to','was','will','with'"


def _count(column: str, term: str) -> str:
    return f"((length({column}) - length(replace({column}, '{term}', ''))) // {len(term)})"


_HIT = " or ".join(f"contains(lower(title), '{t}') or contains(lower(content), '{t}')" for t in WORDS)
_SCORE = " + ".join(f"3 * {_count('lower(title)', t)} + {_count('lower(content)', t)}" for t in WORDS)
LEXICAL = f"lexical as (select *, round(greatest(({_SCORE})::double, 0.5), 3) as score from hits where {_HIT})"

# Documents and chunks


@query("select source_type, count(*) as documents, count(raw_content) as with_text from ingested_documents group by source_type")
def doc_count_by_source(spark, sf_dir):
    return table(spark, sf_dir, "ingested_documents").groupBy("source_type").agg(F.count(F.lit(1)).alias("documents"), F.count("raw_content").alias("with_text"))


@query("""select d.id, d.title, d.source_type, epoch_us(d.created_at) as created_us, coalesce(c.n, 0) as chunk_count
from (select * from ingested_documents where source_type = 'web' order by created_at desc, id limit 50 offset 10) d
left join (select document_id, count(distinct chunk_index) as n from document_chunks group by document_id) c on c.document_id = d.id""")
def doc_list_chunk_counts(spark, sf_dir):
    return catalog.list_documents(table(spark, sf_dir, "ingested_documents"), table(spark, sf_dir, "document_chunks"), "web", 50, 10)


@query("""select document_id, chunk_index, content from (
  select c.document_id, c.chunk_index, arg_min(c.content, c.id) as content from document_chunks c
  where c.document_id = (select min(id) from ingested_documents where raw_content is not null and raw_content <> '') group by 1, 2)""")
def doc_detail_chunks(spark, sf_dir):
    one = table(spark, sf_dir, "ingested_documents").where("raw_content is not null and raw_content <> ''").agg(F.min("id").alias("document_id"))
    own = table(spark, sf_dir, "document_chunks").join(F.broadcast(one), "document_id", "left_semi")
    return catalog.distinct_chunks(own).select("document_id", "chunk_index", "c.content")


@query("""select arg_min(id, (created_at is null, created_at, id)) as id, sha256, count(*) as copies
from (select id, created_at, sha256(raw_content) as sha256 from ingested_documents where raw_content is not null) group by sha256""")
def dedup_by_content_hash(spark, sf_dir):
    return catalog.first_of_each_hash(table(spark, sf_dir, "ingested_documents"), "id", "raw_content", "created_at")


@query("""select id from ingested_documents d where source_type = 'web' and raw_content is not null
and not exists (select 1 from ingested_documents e where e.source_type <> 'web' and sha256(e.raw_content) = sha256(d.raw_content))""")
def new_docs_anti_join(spark, sf_dir):
    every = table(spark, sf_dir, "ingested_documents")
    return catalog.new_documents(every.where("source_type = 'web' and raw_content is not null"), every.where("source_type <> 'web'"), "raw_content").select("id")


@query("""select 'documents' as store, count(*) as rows_left from ingested_documents where source_type <> 'note'
union all select 'chunks', count(*) from document_chunks where document_id not in (select id from ingested_documents where source_type = 'note')""")
def delete_cascade(spark, sf_dir):
    documents = table(spark, sf_dir, "ingested_documents")
    kept = catalog.delete_documents(documents.where("source_type = 'note'"), documents, table(spark, sf_dir, "document_chunks"))
    counts = [d.agg(F.count(F.lit(1)).alias("rows_left")).select(F.lit(n).alias("store"), "rows_left") for n, d in zip(("documents", "chunks"), kept)]
    return counts[0].unionByName(counts[1])


@query("""select c.document_id || '_' || c.chunk_index as chunk_id, d.title, d.source_type, coalesce(any_value(c.label), 'Chunk #' || (c.chunk_index + 1)) as anchor_label
from (select document_id, chunk_index, arg_min(location_meta.anchor_label, id) as label from document_chunks group by 1, 2) c join ingested_documents d on d.id = c.document_id
group by c.document_id, c.chunk_index, d.title, d.source_type""")
def ssot_scan(spark, sf_dir):
    chunks = table(spark, sf_dir, "document_chunks").groupBy("document_id", "chunk_index").agg(F.min_by("location_meta.anchor_label", F.when(F.col("location_meta.anchor_label").isNotNull(), F.col("id"))).alias("label"))
    joined = chunks.join(table(spark, sf_dir, "ingested_documents").select(F.col("id").alias("document_id"), "title", "source_type"), "document_id")
    return joined.select(F.concat("document_id", F.lit("_"), "chunk_index").alias("chunk_id"), "title", "source_type", F.coalesce("label", F.concat(F.lit("Chunk #"), F.col("chunk_index") + 1)).alias("anchor_label"))


@query("select id, map_extract(doc_metadata, 'lang')[1] as lang, cardinality(doc_metadata) as entries from ingested_documents where doc_metadata is not null")
def metadata_merge(spark, sf_dir):
    d = table(spark, sf_dir, "ingested_documents").where("doc_metadata is not null").withColumn("parsed", F.map_filter("doc_metadata", lambda k, _: k == "lang"))
    return d.withColumn("m", catalog.merge_metadata("doc_metadata", "parsed")).select("id", F.col("m")["lang"].alias("lang"), F.size("m").alias("entries"))


# Parsers and chunks

_EXT = "lower(regexp_extract(coalesce(file_path, ''), '(\\.[^./]+)$', 1))"


@query(f"""select id, case when {_EXT} = '.pdf' or lower(mime_type) = 'application/pdf' then 'pdf'
 when {_EXT} = '.docx' or lower(mime_type) = 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' then 'docx'
 when {_EXT} in ('.md', '.markdown') then 'markdown' when {_EXT} in ('.html', '.htm') or lower(mime_type) = 'text/html' then 'html'
 when {_EXT} in ('.py','.js','.jsx','.ts','.tsx','.go','.rs','.java','.c','.cpp','.h','.hpp','.cs','.rb','.php','.css','.sql','.json','.yaml','.yml','.sh','.ps1') or contains(lower(coalesce(mime_type, '')), 'code') then 'code' else 'text' end as parser from ingested_documents""")
def parser_dispatch(spark, sf_dir):
    return table(spark, sf_dir, "ingested_documents").select("id", parse.parser_of(F.col("file_path"), F.col("mime_type")).alias("parser"))


@query("select doc_id, sha256(text) as sha256 from documents where text is not null")
def byte_decode(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("bytes"))
    return d.select("doc_id", F.sha2(parse.decode(F.col("bytes")), 256).alias("sha256"))


_LINES = r"string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))"


@query(f"""select document_id, line_start, line_start as line_end, text from (
 select document_id, unnest(range(1, len(l) + 1))::int as line_start, unnest(l) as text from (select id as document_id, {_LINES.replace('text', 'raw_content')} as l from ingested_documents where raw_content is not null))
 where regexp_matches(text, '[^\\s\\x0B\\x1C-\\x1F\\x85\\p{{Z}}]')""")
def text_blocks(spark, sf_dir):
    return parse.text_blocks(table(spark, sf_dir, "ingested_documents"), "id", "raw_content")


_STRIP = r"'^[\s\x0B\x1C-\x1F\x85\p{Z}]+|[\s\x0B\x1C-\x1F\x85\p{Z}]+$', '', 'g'"


@query(rf"""with l as (select doc_id as document_id, unnest(range(0, len(x)))::int as ln, unnest(x) as line from (select doc_id, {_LINES} as x from documents where mime_type = 'text/markdown' and text is not null)),
h as (select *, nullif(regexp_replace(regexp_extract(line, '^(#{{1,6}})\s+(.+)$', 2), {_STRIP}), '') as heading from l),
p as (select *, count(heading) over w as island, coalesce(last_value(heading ignore nulls) over w, 'General') as section from h window w as (partition by document_id order by ln rows unbounded preceding))
select document_id, section, line_start, line_end, text from (select document_id, section, min(ln) + 1 as line_start, max(ln) + 1 as line_end, regexp_replace(string_agg(line, chr(10) order by ln), {_STRIP}) as text from p where heading is null group by document_id, island, section) where text <> ''""")
def markdown_sections(spark, sf_dir):
    return parse.markdown_blocks(table(spark, sf_dir, "documents").where("mime_type = 'text/markdown'"), "doc_id", "text")


@query(rf"""with l as (select id as document_id, regexp_replace(coalesce(file_path, ''), '^.*/', '') as name, {_LINES.replace('text', 'raw_content')} as x from ingested_documents where source_type = 'code' and raw_content is not null),
k as (select document_id, name, case when x[-1] = '' then x[:-2] else x end as x from l),
w as (select document_id, name, x, unnest(range(0, len(x), 30))::int as a from k where len(x) > 0)
select document_id, name || ':' || (a + 1) || '-' || least(a + 40, len(x)) as section, a + 1 as line_start, least(a + 40, len(x))::int as line_end, array_to_string(x[a + 1:a + 40], chr(10)) as text from w
where regexp_matches(array_to_string(x[a + 1:a + 40], chr(10)), '[^\s\x0B\x1C-\x1F\x85\p{{Z}}]')""")
def code_windows(spark, sf_dir):
    d = table(spark, sf_dir, "ingested_documents").where("source_type = 'code'").withColumn("name", F.regexp_replace(F.coalesce("file_path", F.lit("")), "^.*/", ""))
    return parse.code_blocks(d, "id", "raw_content", "name")


@query(rf"""with p as (select doc_id, trim(regexp_replace(coalesce(title, ''), {_STRIP})) as title, list_filter(list_transform(string_split_regex(text, '\n+'), lambda x: regexp_replace(x, {_STRIP})), lambda x: x <> '') as b from documents where source_type = 'web' and text is not null)
select doc_id as document_id, title, unnest(range(0, len(b)))::int as block_no, 'p' as tag, unnest(b) as text from p""")
def html_blocks(spark, sf_dir):
    """Blocks of pages whose HTML is made from the corpus."""
    d = table(spark, sf_dir, "documents").where("source_type = 'web' and text is not null")
    escape = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = d.select("doc_id", F.concat(F.lit("<html><head><title>"), escape(F.coalesce("title", F.lit(""))), F.lit("</title><script>x</script></head><body><p>"), F.regexp_replace(escape("text"), "\n+", "</p>\n<p>"), F.lit("</p></body></html>")).alias("html"))
    return parse.html_blocks(page, "doc_id", "html")


def _visited_links(spark, sf_dir):
    """job_id, source, target: within a job, every page of a depth hangs on one of the depth before, in turn."""
    p = table(spark, sf_dir, "crawl_pages").where("canonical_url is not null and depth is not null and job_id is not null")
    seen = p.groupBy("job_id", "canonical_url").agg(F.min("depth").alias("depth"))
    level = Window.partitionBy("job_id", "depth")
    placed = seen.select("*", (F.row_number().over(level.orderBy("canonical_url")) - 1).alias("at"), F.count(F.lit(1)).over(level).alias("n"))
    parents = placed.select("job_id", "depth", "at", F.col("canonical_url").alias("source"))
    sizes = placed.where("at = 0").select("job_id", "depth", F.col("n").alias("parents"))
    children = placed.select("job_id", (F.col("depth") - 1).alias("depth"), F.col("at").alias("own"), F.col("canonical_url").alias("target")).join(sizes, ["job_id", "depth"]).withColumn("at", F.col("own") % F.col("parents"))
    return children.join(parents, ["job_id", "depth", "at"]).select("job_id", "source", "target")


_VISITED = """seen as (select job_id, canonical_url, min(depth) as depth from crawl_pages where canonical_url is not null and depth is not null and job_id is not null group by 1, 2),
placed as (select *, row_number() over (partition by job_id, depth order by canonical_url) - 1 as at, count(*) over (partition by job_id, depth) as n from seen),
visited as (select c.job_id, p.canonical_url as source, c.canonical_url as target from placed c join placed p on p.job_id = c.job_id and p.depth = c.depth - 1 and p.at = c.at % p.n)"""


@query(f"""with {_VISITED}, kept as (select * from visited where regexp_matches(target, '^https?://') and not regexp_matches(lower(regexp_extract(target, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '[.](pdf|zip|tar|gz|rar|7z|png|jpg|jpeg|gif|svg|webp|mp3|mp4|avi|mov|mkv|exe|dmg|bin|iso)$'))
select job_id || ' ' || source as document_id, (row_number() over (partition by job_id, source order by target) - 1)::int as link_no, target as link from kept""")
def html_links(spark, sf_dir):
    """Links of the visited pages, whose HTML is made from what their jobs visited next."""
    escape = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("'"), F.lit("&#39;"))
    links = F.array_join(F.transform(F.array_sort(F.collect_list("target")), lambda t: F.concat(F.lit("<li><a href='"), escape(t), F.lit("'>x</a>"))), "")
    pages = _visited_links(spark, sf_dir).groupBy("job_id", "source").agg(F.concat(F.lit("<a href='#top'>t</a><a href='mailto:x@y.z'>m</a><ul>"), links, F.lit("</ul><a href='/logo.png'>l</a>")).alias("html"))
    return parse.html_links(pages.withColumn("id", F.concat("job_id", F.lit(" "), "source")), "id", "source", "html")


@query(rf"""with c as (select distinct id, content, list_min(location_meta.pages) as page from document_chunks where location_meta.pages is not null and content is not null),
b as (select id as document_id, page as page_number, unnest(range(0, len(x)))::int as block_no, unnest(x) as raw from (select id, page, string_split(content, chr(10) || chr(10)) as x from c))
select document_id, page_number, block_no, text from (select document_id, page_number, block_no, regexp_replace(raw, {_STRIP}) as text from b) where text <> ''""")
def page_blocks(spark, sf_dir):
    pdf = table(spark, sf_dir, "document_chunks").where("location_meta.pages is not null").select("id", "content", F.array_min("location_meta.pages").alias("page")).distinct()
    return parse.page_blocks(pdf, "id", "page", "content")


_PLAIN = r"""plain as (
  select document_id, (row_number() over (partition by document_id order by i) - 1)::int as chunk_index, content from (
    select document_id, i, regexp_replace(substring(text, (i + 1)::int, 1500), '^[\s\x0B\x1C-\x1F\x85\p{Z}]+|[\s\x0B\x1C-\x1F\x85\p{Z}]+$', '', 'g') as content
    from (select doc_id as document_id, text, unnest(range(0, length(text), 1300)) as i from documents where length(text) > 0)) where content <> '')"""


@query(f"with {_PLAIN} select document_id, chunk_index, sha256(content) as sha256, length(content) as n_chars from plain")
def plain_chunks(spark, sf_dir):
    return chunk.plain_chunks(table(spark, sf_dir, "documents"), "doc_id", "text").select("document_id", "chunk_index", F.sha2("content", 256).alias("sha256"), F.length("content").alias("n_chars"))


@query(f"""with {_PLAIN} select document_id, chunk_index, greatest(1, length(content) // 4) as token_count, sha256(chunk_index || ':' || content) as chunk_hash, 'Chunk #' || (chunk_index + 1) as anchor_label from plain""")
def chunk_hashes_tokens_anchors(spark, sf_dir):
    return chunk.describe(chunk.plain_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")).drop("content")


@query(rf"""with recursive l as (select doc_id, unnest(range(1, len(x) + 1))::int as line, unnest(x) as t from (select doc_id, {_LINES} as x from documents where text is not null)),
b as (select doc_id, row_number() over (partition by doc_id order by line) as k, line, regexp_replace(t, {_STRIP}) as t from l where regexp_matches(t, '[^\s\x0B\x1C-\x1F\x85\p{{Z}}]')),
f as (
  select doc_id, 0::bigint as k, []::varchar[] as parts, 0::bigint as n, null::int as a, null::int as z, null::varchar as content, null::int as line_start, null::int as line_end from b group by doc_id
  union all
  select doc_id, k, case when not full_ then g when keep then [t] else [] end, case when not full_ then n when keep then length(t) else 0 end, case when full_ then null else a end, case when full_ then null else z end,
    case when full_ then array_to_string(g, chr(10) || chr(10)) end, case when full_ then a end, case when full_ then z end
  from (select *, n >= 1500 as full_, len(g) > 1 and length(t) < 200 as keep from (select f.doc_id, b.k, b.t, list_append(f.parts, b.t) as g, f.n + length(b.t) as n, least(f.a, b.line) as a, greatest(f.z, b.line) as z from f join b on b.doc_id = f.doc_id and b.k = f.k + 1))),
out as (select doc_id, k, content, line_start, line_end from f where content is not null
  union all select doc_id, k + 1, array_to_string(parts, chr(10) || chr(10)), a, z from f where len(parts) > 0 and k = (select max(k) from b where b.doc_id = f.doc_id)),
numbered as (select *, (row_number() over (partition by doc_id order by k) - 1)::int as chunk_index from out)
select doc_id as document_id, chunk_index, line_start, line_end, greatest(1, length(content) // 4)::int as token_count, sha256(chunk_index || ':' || content) as chunk_hash,
  case when line_start is not null then 'Lines ' || line_start || '-' || line_end else 'Chunk #' || (chunk_index + 1) end as anchor_label from numbered""")
def chunk_fold(spark, sf_dir):
    blocks = parse.text_blocks(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("block_no", F.col("line_start"))
    return chunk.describe(chunk.fold_blocks(blocks)).select("document_id", "chunk_index", "line_start", "line_end", "token_count", "chunk_hash", "anchor_label")


# Ingest

_NAME = "coalesce(file_path, replace(lower(title), ' ', '_') || '.txt')"
_FILE_EXT = f"lower(regexp_extract({_NAME}, '(\\.[^./]+)$', 1))"


@query(rf"""with files as (select raw_content as text, mime_type, source_type, created_at, doc_metadata, {_NAME} as file_path, {_FILE_EXT} as ext, sha256(raw_content) as sha256 from ingested_documents where raw_content is not null and source_type <> 'web'),
new as (select *, row_number() over (partition by sha256 order by created_at is null, created_at, file_path) as nth from files where sha256 not in (select sha256(raw_content) from ingested_documents where raw_content is not null and source_type = 'web')),
kinds as (select *, regexp_replace(coalesce(file_path, ''), '^.*/', '') as name, case when ext = '.pdf' or lower(mime_type) = 'application/pdf' then 'pdf' when ext = '.docx' or lower(mime_type) = 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' then 'docx'
  when ext in ('.md', '.markdown') then 'markdown' when ext in ('.html', '.htm') or lower(mime_type) = 'text/html' then 'html'
  when ext in ('.py','.js','.jsx','.ts','.tsx','.go','.rs','.java','.c','.cpp','.h','.hpp','.cs','.rb','.php','.css','.sql','.json','.yaml','.yml','.sh','.ps1') or contains(lower(coalesce(mime_type, '')), 'code') then 'code' else 'text' end as parser from new where nth = 1),
stems as (select *, array_to_string(list_transform(string_split(regexp_replace(regexp_replace(name, '\.[^.]*$', ''), '[_-]', ' ', 'g'), ' '), lambda w: upper(substring(w, 1, 1)) || lower(substring(w, 2))), ' ') as stem,
  regexp_replace(regexp_extract(text, '(?m)^#[\s]+(.+)$', 1), {_STRIP}) as heading from kinds where parser <> 'pdf')
select sha256, case when parser = 'code' then name when parser = 'markdown' and heading <> '' then heading else stem end as title, source_type, file_path, parser, strlen(text)::int as file_size_bytes, least(100000, length(text))::int as n_chars,
  len(list_distinct(list_concat(coalesce(map_keys(doc_metadata), []), case when parser = 'code' then ['filename', 'language', 'total_lines'] when parser = 'docx' then ['filename', 'total_paragraphs'] else ['filename', 'total_lines'] end)))::int as entries from stems""")
def ingest_pipeline(spark, sf_dir):
    """Everything but web pages as files, into a store that has the web pages."""
    every = table(spark, sf_dir, "ingested_documents").where("raw_content is not null")
    files = every.where("source_type <> 'web'").select(F.coalesce("file_path", ingest.note_file(F.col("title"))).alias("file_path"), "mime_type", F.encode("raw_content", "UTF-8").alias("content"), "source_type", "doc_metadata", "created_at")
    documents, _ = ingest.ingest(files, every.where("source_type = 'web'").select(F.sha2("raw_content", 256).alias("sha256")))
    return documents.select("sha256", "title", "source_type", "file_path", "parser", "file_size_bytes", F.length("raw_content").alias("n_chars"), F.size("doc_metadata").alias("entries"))


@query()
def ingest_chunks(spark, sf_dir):
    """The chunks of the same ingest."""
    every = table(spark, sf_dir, "ingested_documents").where("raw_content is not null")
    files = every.where("source_type <> 'web'").select(F.coalesce("file_path", ingest.note_file(F.col("title"))).alias("file_path"), "mime_type", F.encode("raw_content", "UTF-8").alias("content"), "source_type", "doc_metadata", "created_at")
    _, chunks = ingest.ingest(files, every.where("source_type = 'web'").select(F.sha2("raw_content", 256).alias("sha256")))
    return chunks.select("document_id", "chunk_index", "chunk_hash", "token_count", "anchor_label")


@query("select greatest(1, length(content) // 4) as token_count, count(*) as chunks from document_chunks where content is not null group by 1")
def token_count_histogram(spark, sf_dir):
    return table(spark, sf_dir, "document_chunks").where("content is not null").groupBy(F.greatest(F.lit(1), F.floor(F.length("content") / 4)).alias("token_count")).agg(F.count(F.lit(1)).alias("chunks"))


# Lexical retrieval


@query(f"with {HITS}, {LEXICAL} select chunk_id, title, score from lexical order by score desc, chunk_id limit {LIMIT}")
def lexical_term_count(spark, sf_dir):
    return lexical.term_count_search(hits(spark, sf_dir), TEXT, LIMIT).select("chunk_id", "title", "score")


@query(f"with {HITS}, {LEXICAL} select chunk_id, title, score from lexical where source_type = 'note' order by score desc, chunk_id limit {LIMIT} offset 5")
def lexical_filtered(spark, sf_dir):
    return lexical.term_count_search(hits(spark, sf_dir), TEXT, LIMIT, "note", 5).select("chunk_id", "title", "score")


def _terms(field: str) -> str:
    return f"""terms_{field} as (select chunk_id, list_filter(regexp_extract_all(lower({field}), '{WORD}'), lambda w: w not in ({STOP})) as terms from hits),
postings_{field} as (select chunk_id, term, dl, count(*) as tf from (select chunk_id, len(terms)::int as dl, unnest(terms) as term from terms_{field}) group by all),
lengths_{field} as (select count(*) as n, avg(dl) as avgdl from (select len(terms) as dl from terms_{field}) where dl > 0)"""


def _bm25(field: str, terms: list[str]) -> str:
    names = ", ".join(f"'{t}'" for t in terms)
    return f"""bm25_{field} as (select p.chunk_id, sum(ln(1.0::double + (s.n - d.df + 0.5::double) / (d.df + 0.5::double)) * (p.tf / (p.tf + 1.2::double * (0.25::double + 0.75::double * p.dl / s.avgdl)))) as score
from postings_{field} p join (select term, count(*) as df from postings_{field} group by term) d on d.term = p.term, lengths_{field} s where p.term in ({names}) group by p.chunk_id)"""


@query(f"with {HITS}, {_terms('content')} select term, count(*) as df, sum(tf)::bigint as cf from postings_content group by term")
def postings_df(spark, sf_dir):
    return lexical.postings(hits(spark, sf_dir), "content").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query(f"with {HITS}, {_terms('content')}, {_terms('title')} select 'content' as field, n, round(avgdl, 6) as avgdl from lengths_content union all select 'title', n, round(avgdl, 6) from lengths_title")
def corpus_stats(spark, sf_dir):
    parts = [lexical.lengths(hits(spark, sf_dir), f).select(F.lit(f).alias("field"), "n", F.round("avgdl", 6).alias("avgdl")) for f in ("content", "title")]
    return parts[0].unionByName(parts[1])


@query(f"with {HITS}, {_terms('content')}, {_bm25('content', WORDS)} select chunk_id, round(score, 6) as score from bm25_content order by round(score, 6) desc, chunk_id limit {LIMIT}")
def bm25_topk(spark, sf_dir):
    h = hits(spark, sf_dir)
    queries = spark.createDataFrame([(0, t) for t in WORDS], "query_id int, term string")
    found = lexical.bm25(lexical.postings(h, "content", WORDS), lexical.lengths(h, "content"), queries)
    return found.select("chunk_id", F.round("score", 6).alias("score")).orderBy(F.col("score").desc(), "chunk_id").limit(LIMIT)


@query(f"""with {HITS}, {_terms('content')}, {_bm25('content', WORDS)}, {_terms('title')}, {_bm25('title', WORDS)}
select chunk_id, round(max(s), 4) as score from (select chunk_id, score as s from bm25_content union all select chunk_id, 3.0::double * score from bm25_title) group by chunk_id order by 2 desc, 1 limit {LIMIT}""")
def bm25_multifield(spark, sf_dir):
    return lexical.bm25_multifield(hits(spark, sf_dir), TEXT, {"title": 3.0, "content": 1.0}).orderBy(F.col("score").desc(), "chunk_id").limit(LIMIT)


@query(SQL["bm25_multifield"])
def index_bm25_topk(spark, sf_dir):
    """The same search over indexes on disk: they are built, then the buckets of the query's terms are read."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}"
    indexed = hits(spark, sf_dir).withColumn("document_id", F.col("chunk_id"))
    buckets = sinks.build_indexes(indexed, path, "lexical")
    return sinks.search_index(spark, path, TEXT, {"title": 3.0, "content": 1.0}, buckets).orderBy(F.col("score").desc(), "chunk_id").limit(LIMIT)


def _fuzzy(t: str) -> str:
    k = 0 if len(t) < 3 else 1 if len(t) < 6 else 2
    swapped = [t[:i] + t[i + 1] + t[i] + t[i + 2 :] for i in range(len(t) - 1)]
    near = f"levenshtein(term, '{t}') <= {k}" + (f" or (term in ({', '.join(repr(x) for x in swapped)}) and term <> '{t}')" if k else "")
    return f"select '{t}' as query_term, term from vocabulary where {near}"


@query(f"with {HITS}, {_terms('content')}, vocabulary as (select distinct term from postings_content) " + " union all ".join(_fuzzy(t) for t in tx.query_terms(FUZZY)))
def fuzzy_term_expansion(spark, sf_dir):
    return lexical.fuzzy_terms(lexical.postings(hits(spark, sf_dir), "content").select("term").distinct(), FUZZY)


# Vector retrieval

_COSINE = "list_inner_product({a}::double[], {b}::double[]) / (sqrt(list_inner_product({a}::double[], {a}::double[])) * sqrt(list_inner_product({b}::double[], {b}::double[])))"
_BATCH = f"""with scored as (select q.vec_id as query_id, e.vec_id, round({_COSINE.format(a='q.embedding', b='e.embedding')}, 10) as s from embeddings q, embeddings e where q.vec_id % 20 = 0{{}}),
placed as (select *, (row_number() over (partition by query_id order by s desc, vec_id))::int as rank from scored)
select query_id, vec_id, round(s, 4) as score, rank from placed where rank <= 10"""


@query(_BATCH.format(""))
def vector_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return vector.batch_search(v, v.where("vec_id % 20 = 0"), 10)


@query(_BATCH.format(" and e.label = 3"))
def vector_topk_filtered(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return vector.batch_search(v.where("label = 3"), v.where("vec_id % 20 = 0"), 10)


@query("select vec_id, round(sqrt(list_inner_product(embedding::double[], embedding::double[])), 6) as norm from embeddings")
def vector_l2_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vector.norm(F.col("embedding")), 6).alias("norm"))


@query()
def hash_embed(spark, sf_dir):
    return vector.hash_embed(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text"), "doc_id", "text")


@query("""with c as (select distinct document_id || '_' || chunk_index as chunk_id from document_chunks), h as (select chunk_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(chunk_id)) as h from c)
select chunk_id, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || substring('89ab', ((strpos('0123456789abcdef', substring(h, 17, 1)) - 1) % 4 + 1)::int, 1) || substring(h, 18, 3) || '-' || substring(h, 21, 12) as point_id from h""")
def vector_point_ids(spark, sf_dir):
    return table(spark, sf_dir, "document_chunks").select(F.concat("document_id", F.lit("_"), "chunk_index").alias("chunk_id")).where("chunk_id is not null").distinct().withColumn("point_id", vector.point_id(F.col("chunk_id")))


# Fusion and search

POOL = search.candidate_limit(LIMIT)
_VECTOR = "(select embedding from embeddings order by vec_id limit 1)"
CANDIDATES = f"""{HITS}, {LEXICAL},
lex as (select chunk_id, score, row_number() over (order by score desc, chunk_id) as r from (select * from lexical order by score desc, chunk_id limit {POOL})),
near as (select e.vec_id as chunk_id, round({_COSINE.format(a='e.embedding', b=_VECTOR)}, 4) as score from embeddings e where e.vec_id in (select chunk_id from hits)),
sem as (select chunk_id, score, row_number() over (order by score desc, chunk_id) as r from (select * from near order by score desc, chunk_id limit {POOL})),
fused as (select coalesce(l.chunk_id, s.chunk_id) as chunk_id, l.r::int as lexical_rank, s.r::int as semantic_rank, l.score as lexical_score, s.score as semantic_score,
  coalesce(1.0::double / (60 + l.r), 0) + coalesce(1.0::double / (60 + s.r), 0) as rrf_score from lex l full join sem s on l.chunk_id = s.chunk_id)"""


@query(f"with {CANDIDATES} select chunk_id, lexical_rank, semantic_rank, round(rrf_score, 6) as rrf_score from fused")
def rrf_fusion(spark, sf_dir):
    h = hits(spark, sf_dir)
    lex = search.ranked(lexical.term_count_search(h, TEXT, POOL).select("chunk_id", "score"), "lexical_rank", F.col("score").desc(), "chunk_id")
    near = vector.cosine_search(vectors(spark, sf_dir).join(h.select("chunk_id"), "chunk_id", "left_semi"), query_vector(spark, sf_dir), POOL, "chunk_id")
    sem = search.ranked(near.select("chunk_id", "score"), "semantic_rank", F.col("score").desc(), "chunk_id")
    return search.rrf(lex, sem).select("chunk_id", "lexical_rank", "semantic_rank", F.round("rrf_score", 6).alias("rrf_score"))


_MATCHED = " + ".join(f"(case when contains(lower(title), '{t}') then 1 else 0 end)" for t in WORDS)
_AUTHORITY = "(case source_type when 'note' then 1.3::double when 'upload' then 1.2::double when 'code' then 1.15::double else 1.0::double end)"
_ROW = r"(^|[^\p{L}\p{N}_])" + r"[\s\x0B\x1C-\x1F\x85\p{Z}]+".join(WORDS) + r"([^\p{L}\p{N}_]|$)"
SIGNALS = f"""signals as (select *, greatest(0.1::double, round(case when score is null or score = 0 then 1.0::double else score end, 4)) as base,
 round(least(1.6::double, 1.0::double + case when contains(lower(title), '{TEXT}') then 0.5::double when ({_MATCHED}) = {len(WORDS)} then 0.3::double when ({_MATCHED}) > 0 then round(0.2::double * ({_MATCHED}) / {float(len(WORDS))}::double, 2) else 0.0::double end), 3) as title_boost,
 round({_AUTHORITY}, 3) as authority_boost,
 case when created_at is null then 0.9::double else round(greatest(0.5::double, least(1.0::double, 0.5::double + 0.5::double * exp(-ln(2.0::double) / 90 * greatest(0.0::double, ({int(AS_OF.timestamp() * 1_000_000)} - epoch_us(created_at)) / 86400000000.0::double)))), 3) end as freshness_boost,
 case when regexp_matches(lower(content), '{_ROW}') then 1.25::double
  when (select bool_or({' and '.join(f"list_contains(w[i:i + 14], '{t}')" for t in WORDS)}) from unnest(range(1, greatest(1, len(w) - 14) + 1)) as t(i)) then 1.1::double else 1.0::double end as phrase_boost
 from (select *, regexp_extract_all(lower(content), '{WORD}') as w from candidates)),
final as (select *, round(base * title_boost * authority_boost * freshness_boost * phrase_boost + 1e-9::double, 4) as final_score from signals)"""
_PAGE = f"""page as (select *, (row_number() over (order by final_score desc, chunk_id))::int as position from final)
select position, chunk_id, lexical_rank, semantic_rank, final_score from page where position <= {LIMIT}"""
_SHOWN = ["position", "chunk_id", "lexical_rank", "semantic_rank", "final_score"]


def _search(spark, sf_dir, mode, engine="term_count", **more):
    return search.search(hits(spark, sf_dir), vectors(spark, sf_dir).drop("label"), TEXT, query_vector(spark, sf_dir), AS_OF, mode, LIMIT, engine=engine, **more).select(*_SHOWN)


@query(f"with {CANDIDATES}, candidates as (select h.*, f.lexical_rank, f.semantic_rank, f.rrf_score * 100 as score from fused f join hits h on h.chunk_id = f.chunk_id), {SIGNALS}, {_PAGE}")
def search_hybrid(spark, sf_dir):
    return _search(spark, sf_dir, "hybrid")


@query(f"with {CANDIDATES}, candidates as (select h.*, l.r::int as lexical_rank, null::int as semantic_rank, l.score from lex l join hits h on h.chunk_id = l.chunk_id), {SIGNALS}, {_PAGE}")
def search_lexical(spark, sf_dir):
    return _search(spark, sf_dir, "lexical")


@query(f"with {CANDIDATES}, candidates as (select h.*, null::int as lexical_rank, s.r::int as semantic_rank, s.score from sem s join hits h on h.chunk_id = s.chunk_id), {SIGNALS}, {_PAGE}")
def search_semantic(spark, sf_dir):
    return _search(spark, sf_dir, "semantic")


_WEB = f"""{HITS}, {_terms('content')}, {_bm25('content', WORDS)}, {_terms('title')}, {_bm25('title', WORDS)},
scored as (select chunk_id, round(max(s), 4) as score from (select chunk_id, score as s from bm25_content union all select chunk_id, 3.0::double * score from bm25_title) group by chunk_id),
lex as (select chunk_id, score, row_number() over (order by score desc, chunk_id) as r from (select * from scored where chunk_id in (select chunk_id from hits where source_type = 'web') order by score desc, chunk_id limit {POOL})),
near as (select e.vec_id as chunk_id, round({_COSINE.format(a='e.embedding', b=_VECTOR)}, 4) as score from embeddings e where e.vec_id in (select chunk_id from hits where source_type = 'web')),
sem as (select chunk_id, score, row_number() over (order by score desc, chunk_id) as r from (select * from near order by score desc, chunk_id limit {POOL})),
fused as (select coalesce(l.chunk_id, s.chunk_id) as chunk_id, l.r::int as lexical_rank, s.r::int as semantic_rank, coalesce(1.0::double / (60 + l.r), 0) + coalesce(1.0::double / (60 + s.r), 0) as rrf_score from lex l full join sem s on l.chunk_id = s.chunk_id)"""


@query(f"with {_WEB}, candidates as (select h.*, f.lexical_rank, f.semantic_rank, f.rrf_score * 100 as score from fused f join hits h on h.chunk_id = f.chunk_id), {SIGNALS}, {_PAGE}")
def search_hybrid_bm25(spark, sf_dir):
    return _search(spark, sf_dir, "hybrid", "bm25", source_type="web")


@query()
def search_hybrid_text(spark, sf_dir):
    """Both engines search for the text: the semantic one by its vector among those of the contents."""
    h = hits(spark, sf_dir)
    return search.search(h, vector.hash_embed(h, "chunk_id", "content"), TEXT, vector.embed_query(TEXT), AS_OF, "hybrid", LIMIT, engine="bm25").select(*_SHOWN)


# Ranking signals over the whole corpus

_ALL = f"with {HITS}, candidates as (select *, 1.0::double as score from hits), {SIGNALS}"


def _reranked(spark, sf_dir):
    return ranking.rerank(hits(spark, sf_dir).withColumn("score", F.lit(1.0)), TEXT, AS_OF)


@query(f"{_ALL} select title_boost, count(*) as documents from signals group by title_boost")
def title_boost(spark, sf_dir):
    return hits(spark, sf_dir).groupBy(ranking.title_boost(F.col("title"), F.lit(None).cast("string"), TEXT).alias("title_boost")).agg(F.count(F.lit(1)).alias("documents"))


@query(f"""with {HITS}, hosts as (select d.source_type, coalesce(regexp_extract(lower(map_extract(d.doc_metadata, 'url')[1]), '^[a-z]+://([^/]+)', 1), '') as host from ingested_documents d)
select authority_boost, count(*) as documents from (select round({_AUTHORITY} + case when source_type = 'web' and (contains(host, 'docs.') or contains(host, 'wiki.') or contains(host, 'developer.') or contains(host, 'github.io')) then 0.1::double else 0.0::double end, 3) as authority_boost from hosts) group by 1""")
def authority_boost(spark, sf_dir):
    d = table(spark, sf_dir, "ingested_documents")
    return d.groupBy(ranking.authority_boost(F.col("source_type"), urls.url_domain(F.col("doc_metadata")["url"])).alias("authority_boost")).agg(F.count(F.lit(1)).alias("documents"))


@query(f"{_ALL} select chunk_id, freshness_boost from signals")
def freshness_boost(spark, sf_dir):
    return hits(spark, sf_dir).select("chunk_id", ranking.freshness_boost(F.col("created_at"), AS_OF).alias("freshness_boost"))


@query(f"{_ALL} select phrase_boost, count(*) as documents from signals group by phrase_boost")
def phrase_boost(spark, sf_dir):
    return hits(spark, sf_dir).groupBy(ranking.phrase_boost(F.col("content"), TEXT).alias("phrase_boost")).agg(F.count(F.lit(1)).alias("documents"))


@query(f"{_ALL}, kept as (select * from final) select chunk_id, base, title_boost, authority_boost, phrase_boost, final_score from kept")
def score_breakdown(spark, sf_dir):
    return _reranked(spark, sf_dir).select("chunk_id", "base", "title_boost", "authority_boost", "phrase_boost", "final_score")


_DAYS = f"greatest(0.0::double, ({int(AS_OF.timestamp() * 1_000_000)} - epoch_us(created_at)) / 86400000000.0::double)"
_AGE = f"case when created_at is null then 'unknown age' when {_DAYS} < 1 then 'today' when {_DAYS} < 30 then floor({_DAYS})::int || ' days' when {_DAYS} < 365 then floor({_DAYS} / 30)::int || ' months' else printf('%.1f', {_DAYS} / 365) || ' years' end"


@query(f"""{_ALL} select chunk_id, concat_ws('; ', 'Base: ' || printf('%.4f', base), case when title_boost > 1 then 'Title: x' || printf('%.2f', title_boost) end, 'Authority of ' || source_type || ': x' || printf('%.2f', authority_boost),
 'Freshness: x' || printf('%.3f', freshness_boost) || ' (' || {_AGE} || ')', case when phrase_boost > 1 then 'Phrase: x' || printf('%.2f', phrase_boost) end) as explanation from final""")
def score_explanations(spark, sf_dir):
    return _reranked(spark, sf_dir).select("chunk_id", F.array_join("explanation", "; ").alias("explanation"))


# Snippets

_PLACE = "list_min(list_filter([" + ", ".join(f"instr(lower(content), '{t}')" for t in WORDS) + "], lambda p: p > 0))"
_EITHER = "|".join(sorted(WORDS, key=lambda t: (-len(t), t)))


@query(f"""with {HITS}, placed as (select chunk_id, content, {_PLACE} as p from hits), cut as (select *, greatest(0, p - 81) as a, least(length(content), greatest(0, p - 81) + 240) as b from placed)
select chunk_id, case when p is null then case when length(content) > 240 then substring(content, 1, 240) || '...' else content end
 else regexp_replace((case when a > 0 then '...' else '' end) || substring(content, (a + 1)::int, (b - a)::int) || (case when b < length(content) then '...' else '' end), '({_EITHER})', '<mark>\\1</mark>', 'gi') end as snippet from cut""")
def snippets_around_terms(spark, sf_dir):
    return hits(spark, sf_dir).select("chunk_id", snippets.snippet(F.col("content"), WORDS).alias("snippet"))


@query(f"with {HITS} select chunk_id, case when length(content) > 240 then substring(content, 1, 240) || '...' else content end as snippet from hits")
def snippet_default(spark, sf_dir):
    return hits(spark, sf_dir).select("chunk_id", snippets.default_snippet(F.col("content")).alias("snippet"))


_ANY = lambda c: " or ".join(f"contains(lower({c}), '{t}')" for t in WORDS)


@query(f"""with {HITS}, f as (select chunk_id, title, content, list_filter(list_transform(range(0, greatest(0, length(content) - 1) + 1, 180), lambda i: substring(content, (i + 1)::int, 180)), lambda x: {_ANY('x')}) as x from hits)
select chunk_id, case when len(x) > 0 then regexp_replace(array_to_string(x[1:2], ' ... '), '({_EITHER})', '<mark>\\1</mark>', 'gi') when {_ANY('title')} then regexp_replace(title, '({_EITHER})', '<mark>\\1</mark>', 'gi') else substring(content, 1, 200) end as snippet from f""")
def snippet_fragments(spark, sf_dir):
    return hits(spark, sf_dir).select("chunk_id", snippets.fragments(F.col("content"), F.col("title"), WORDS).alias("snippet"))


# Evaluation in three modes: the documents whose id is divisible by 20 are the queries, by their titles (BM25 over titles)
# and by their vectors; documents of the same title, or whose vectors have the same label, are the relevant ones.

_EVAL = f"""{HITS}, {_terms('title')},
asked as (select chunk_id as query_id, unnest(list_distinct(terms)) as term from terms_title where chunk_id % 20 = 0),
lexical as (select a.query_id, p.chunk_id as item, round(sum(ln(1.0::double + (s.n - d.df + 0.5::double) / (d.df + 0.5::double)) * (p.tf / (p.tf + 1.2::double * (0.25::double + 0.75::double * p.dl / s.avgdl)))), 6) as score
  from asked a join postings_title p on p.term = a.term join (select term, count(*) as df from postings_title group by term) d on d.term = p.term, lengths_title s group by 1, 2),
semantic as (select q.vec_id as query_id, e.vec_id as item, round(round({_COSINE.format(a='q.embedding', b='e.embedding')}, 10), 4) as score, round({_COSINE.format(a='q.embedding', b='e.embedding')}, 10) as fine from embeddings q, embeddings e where q.vec_id % 20 = 0),
lex as (select *, row_number() over (partition by query_id order by score desc, item) as rank from lexical qualify rank <= 50),
sem as (select query_id, item, row_number() over (partition by query_id order by score desc, item) as rank from (select *, row_number() over (partition by query_id order by fine desc, item) as nth from semantic qualify nth <= 50)),
hyb as (select coalesce(l.query_id, s.query_id) as query_id, coalesce(l.item, s.item) as item, round(coalesce(1.0::double / (60.0::double + l.rank), 0) + coalesce(1.0::double / (60.0::double + s.rank), 0), 10) as score from lex l full join sem s on s.query_id = l.query_id and s.item = l.item),
retrieved as (select 'lexical' as mode, query_id, item, rank from lex where rank <= 10 union all select 'semantic', query_id, item, rank from sem where rank <= 10
  union all select 'hybrid', query_id, item, rank from (select *, row_number() over (partition by query_id order by score desc, item) as rank from hyb) where rank <= 10),
judged as (select q.chunk_id as query_id, h.chunk_id as item, 3.0::double as grade from hits q join hits h on lower(h.title) = lower(q.title) where q.chunk_id % 20 = 0 and q.title <> ''
  union all select q.vec_id, e.vec_id, 1.0::double from embeddings q join embeddings e on e.label = q.label where q.vec_id % 20 = 0),
one_grade as (select query_id, item, max(grade) as grade from judged group by 1, 2),
grades as (select m.mode, g.* from one_grade g, (values ('lexical'), ('semantic'), ('hybrid')) m(mode)),
of_hits as (select r.mode, r.query_id, {', '.join(f'sum((r.rank <= {k} and g.grade > 0)::int) / {k}.0::double as p{k}' for k in (1, 3, 5))}, sum((r.rank <= 5 and g.grade > 0)::int) as found, min(case when g.grade > 0 then r.rank end) as first,
  sum(case when r.rank <= 5 then (pow(2, coalesce(g.grade, 0)) - 1) / log2(r.rank + 1.0::double) end) as dcg, count(*) as items from retrieved r left join grades g on g.mode = r.mode and g.query_id = r.query_id and g.item = r.item group by 1, 2),
ideal as (select mode, query_id, count(*) as relevant, sum(case when rank <= 5 then (pow(2, grade) - 1) / log2(rank + 1.0::double) end) as idcg from (select *, row_number() over (partition by mode, query_id order by grade desc, item) as rank from grades) group by 1, 2),
per_query as (select coalesce(o.mode, i.mode) as mode, coalesce(o.query_id, i.query_id) as query_id, {', '.join(f'round(coalesce(p{k}, 0), 4) as p_at_{k}' for k in (1, 3, 5))}, round(case when relevant > 0 then coalesce(found, 0) / relevant else 0.0::double end, 4) as r_at_5,
  round(coalesce(1.0::double / first, 0), 4) as mrr, round(case when coalesce(idcg, 0) > 1e-9 then coalesce(dcg, 0) / idcg when coalesce(items, 0) > 0 then 1.0::double else 0.0::double end, 4) as ndcg_at_5 from of_hits o full join ideal i on i.mode = o.mode and i.query_id = o.query_id)"""


def _evaluated(spark, sf_dir):
    h = hits(spark, sf_dir)
    indexed = lexical.postings(h, "title")
    asked = indexed.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "term")
    scored = lexical.bm25(indexed, lexical.lengths(h, "title"), asked).select("query_id", F.col("chunk_id").alias("item"), F.round("score", 6).alias("score"))
    stored = table(spark, sf_dir, "embeddings")
    near = vector.batch_search(stored, stored.where("vec_id % 20 = 0"), 50).select("query_id", F.col("vec_id").alias("item"), "score")
    by_title = h.where("title <> ''").select("chunk_id", F.lower("title").alias("key"))
    same_title = by_title.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "key").join(by_title, "key").select("query_id", F.col("chunk_id").alias("item"), F.lit(3.0).alias("grade"))
    labels = stored.select("vec_id", "label")
    same_label = labels.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label").join(labels, "label").select("query_id", F.col("vec_id").alias("item"), F.lit(1.0).alias("grade"))
    return evaluate.metrics_by_mode(evaluate.by_mode(scored, near), same_title.unionByName(same_label))


@query(f"with {_EVAL} select * from per_query")
def retrieval_metrics(spark, sf_dir):
    return _evaluated(spark, sf_dir)


@query(f"with {_EVAL} select mode, count(*) as queries, {', '.join(f'round(avg({c}), 4) as {c}' for c in ('p_at_1', 'p_at_3', 'p_at_5', 'r_at_5', 'mrr', 'ndcg_at_5'))} from per_query group by mode")
def benchmark_report(spark, sf_dir):
    return evaluate.means(_evaluated(spark, sf_dir), "mode")


# Crawling and URLs


@query("select distinct url, regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1) as host from crawl_pages where url is not null")
def url_domain(spark, sf_dir):
    return table(spark, sf_dir, "crawl_pages").where("url is not null").select("url").distinct().withColumn("host", urls.url_domain(F.col("url")))


_CANONICAL = r"""u as (select distinct url, regexp_replace(trim(url), '#.*$', '') as x from crawl_pages where url is not null),
parts as (select url, lower(regexp_extract(x, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as s, lower(regexp_extract(x, '^[A-Za-z]+://([^/?]*)', 1)) as h, regexp_extract(x, '^[A-Za-z]+://[^/?]*([^?]*)', 1) as p,
  list_sort(list_filter(string_split(regexp_extract(x, '\?(.*)$', 1), '&'), lambda t: t <> '' and not regexp_matches(lower(t), '^(utm_|fbclid|gclid|ref)'))) as f from u),
canonical as (select url, s || '://' || case when s = 'http' then regexp_replace(h, ':80$', '') when s = 'https' then regexp_replace(h, ':443$', '') else h end
  || case when p = '' then '/' else regexp_replace(regexp_replace(p, '/[^/]+/\.\./', '/', 'g'), '/+', '/', 'g') end || case when len(f) > 0 then '?' || array_to_string(f, '&') else '' end as canonical from parts)"""


@query(f"with {_CANONICAL} select url, canonical from canonical")
def url_canonical(spark, sf_dir):
    return table(spark, sf_dir, "crawl_pages").where("url is not null").select("url").distinct().withColumn("canonical", urls.canonical_url(F.col("url")))


@query(f"""with {_CANONICAL} select c.canonical, count(distinct p.url) as spellings, count(distinct p.id) as visits from crawl_pages p join canonical c on c.url = p.url group by 1""")
def url_dedup(spark, sf_dir):
    pages = table(spark, sf_dir, "crawl_pages").where("url is not null").select("id", "url").distinct()
    return pages.groupBy(urls.canonical_url(F.col("url")).alias("canonical")).agg(F.countDistinct("url").alias("spellings"), F.countDistinct("id").alias("visits"))


@query("""with patterns as (select distinct lower(trim(domain)) as p from crawl_domains where enabled and domain is not null), seen as (select distinct url, regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1) as h from crawl_pages where url is not null)
select url from seen where exists (select 1 from patterns where h = p or ends_with(h, '.' || p) or h = 'www.' || p or p = 'www.' || h)""")
def url_allowed(spark, sf_dir):
    return crawl.allowed(table(spark, sf_dir, "crawl_pages").where("url is not null").select("url").distinct(), table(spark, sf_dir, "crawl_domains"))


@query(r"""with d as (select regexp_replace(lower(trim(domain)), ':.*$', '') as host, enabled, coalesce(ceil(rate_limit_delay), 1)::double as delay from crawl_domains where domain is not null),
u as (select distinct url, regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), ':.*$', '') as host, regexp_extract(trim(url), '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) as path from crawl_pages where url is not null)
select u.url, case when d.host is null then true when d.enabled is not true then false else not starts_with(u.path, '/draft') end as robots_ok, d.delay as crawl_delay from u left join d on d.host = u.host""")
def robots_verdicts(spark, sf_dir):
    """Every URL against robots rules that are derived from the allowlist: drafts are closed, and what isn't enabled."""
    d = table(spark, sf_dir, "crawl_domains")
    body = F.concat(F.lit("User-agent: *\nDisallow: /draft\nCrawl-delay: "), F.coalesce(F.ceil("rate_limit_delay"), F.lit(1)).cast("string"), F.when(F.col("enabled"), "").otherwise("\nDisallow: /"))
    robots = d.select(urls.normalize_domain(F.col("domain")).alias("domain"), F.lit(200).alias("status"), body.alias("body"))
    return crawl.robots_allowed(table(spark, sf_dir, "crawl_pages").where("url is not null").select("url").distinct(), robots, "corvathbot")


_REACHED = "select distinct l.target as url from l{n} s join links l on l.source = s.url where l.target not in (select url from seen{n})"


@query(_CANONICAL.replace("select distinct url, regexp_replace(trim(url), '#.*$', '') as x from crawl_pages where url is not null", "select distinct canonical_url as url, regexp_replace(trim(canonical_url), '#.*$', '') as x from crawl_pages where canonical_url is not null").join(["with ", f""", {_VISITED},
links as (select distinct s.canonical as source, t.canonical as target from visited v join canonical s on s.url = v.source join canonical t on t.url = v.target),
l0 as (select distinct c.canonical as url from (select distinct source from visited where source not in (select target from visited)) v join canonical c on c.url = v.source), seen0 as (select url from l0),
l1 as ({_REACHED.format(n=0)}), seen1 as (select * from seen0 union all select * from l1), l2 as ({_REACHED.format(n=1)}), seen2 as (select * from seen1 union all select * from l2), l3 as ({_REACHED.format(n=2)})
select url, 0 as depth from l0 union all select url, 1 from l1 union all select url, 2 from l2 union all select url, 3 from l3"""]))
def frontier_levels(spark, sf_dir):
    links = _visited_links(spark, sf_dir).select("source", F.lit(0).alias("link_no"), "target").distinct()
    seeds = links.join(links.select(F.col("target").alias("source")), "source", "left_anti").select(F.col("source").alias("url")).distinct()
    return crawl.frontier(links, seeds, 3)


@query("""with list as (select distinct lower(trim(domain)) as p, enabled, rate_limit_delay from crawl_domains where enabled and domain is not null),
asked as (select *, nullif(regexp_replace(regexp_extract(lower(seed_url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), ':.*$', ''), '') as h from (select distinct id, seed_url, max_depth, max_pages from crawl_jobs))
select a.id, a.h as domain, coalesce(min(case when l.p = a.h then l.rate_limit_delay end), 1.0::double) as rate_limit_delay,
  case when count(l.p) > 0 and a.max_depth between 1 and 5 and a.max_pages between 1 and 100 and coalesce(min(case when l.p = a.h then l.rate_limit_delay end), 1.0::double) between 0.1 and 10 then 'queued' else 'rejected' end as status
from asked a left join list l on a.h = l.p or ends_with(a.h, '.' || l.p) or a.h = 'www.' || l.p or l.p = 'www.' || a.h group by a.id, a.h, a.max_depth, a.max_pages""")
def crawl_jobs_created(spark, sf_dir):
    """Every job of the past, requested anew."""
    requests = table(spark, sf_dir, "crawl_jobs").select("id", "seed_url", "max_depth", "max_pages", F.lit(None).cast("double").alias("rate_limit_delay")).distinct()
    return catalog.create_jobs(requests, table(spark, sf_dir, "crawl_domains")).select("id", "domain", "rate_limit_delay", "status")


@query("select job_id, sum((status_code = 200)::int)::bigint as pages_crawled, sum((status_code is null or status_code <> 200)::int)::bigint as pages_failed from (select distinct id, job_id, status_code from crawl_pages) group by job_id")
def crawl_job_counters(spark, sf_dir):
    return catalog.job_counters(table(spark, sf_dir, "crawl_pages"))


@query("select id, regexp_replace(lower(trim(domain)), ':.*$', '') as domain, status, epoch_us(created_at) as created_us from crawl_jobs order by created_us desc, id limit 100")
def crawl_jobs_recent(spark, sf_dir):
    return catalog.recent_jobs(table(spark, sf_dir, "crawl_jobs"))


@query("""select lower(trim(j.domain)) as domain, count(distinct j.id) as jobs, count(distinct p.id) as visits, count(distinct p.canonical_url) as urls, count(distinct p.document_id) as documents
from crawl_jobs j left join crawl_pages p on p.job_id = j.id group by 1""")
def crawl_domain_totals(spark, sf_dir):
    jobs = table(spark, sf_dir, "crawl_jobs").select(F.col("id").alias("job_id"), F.lower(F.trim("domain")).alias("domain"))
    pages = table(spark, sf_dir, "crawl_pages").select(F.col("id").alias("page_id"), "job_id", "canonical_url", "document_id").distinct()
    return jobs.join(pages, "job_id", "left").groupBy("domain").agg(F.countDistinct("job_id").alias("jobs"), F.countDistinct("page_id").alias("visits"), F.countDistinct("canonical_url").alias("urls"), F.countDistinct("document_id").alias("documents"))


@query("""select distinct p.id, p.job_id from crawl_pages p join crawl_jobs j on j.id = p.job_id where p.depth > j.max_depth or p.crawled_at > j.completed_at""")
def crawl_visits_out_of_bounds(spark, sf_dir):
    jobs = table(spark, sf_dir, "crawl_jobs").select(F.col("id").alias("job_id"), F.col("max_depth"), "completed_at")
    return table(spark, sf_dir, "crawl_pages").join(jobs, "job_id").where("depth > max_depth or crawled_at > completed_at").select("id", "job_id").distinct()


@query("""select p.id, p.url, p.status_code, epoch_us(p.crawled_at) as crawled_us from (select distinct id, url, status_code, crawled_at from crawl_pages where job_id = (select arg_max(id, (created_at, id)) from crawl_jobs where created_at is not null)) p
order by crawled_us desc, p.id limit 100""")
def crawl_job_pages(spark, sf_dir):
    """The latest job's visits, latest first."""
    job = table(spark, sf_dir, "crawl_jobs").where("created_at is not null").agg(F.max_by("id", F.struct("created_at", "id")).alias("job_id"))
    own = table(spark, sf_dir, "crawl_pages").join(F.broadcast(job), "job_id", "left_semi").select("id", "url", "status_code", F.unix_micros("crawled_at").alias("crawled_us")).distinct()
    return own.orderBy(F.col("crawled_us").desc(), "id").limit(100)


@query(f"""with {HITS}, {_terms('content')}, {_terms('title')} select 'content' as store, count(*) as entries from postings_content union all select 'title', count(*) from postings_title
union all select 'vectors', count(*) from embeddings e where e.vec_id in (select chunk_id from hits)""")
def reindex_counts(spark, sf_dir):
    """What a full rebuild writes to each index."""
    h = hits(spark, sf_dir)
    count = lambda d, n: d.agg(F.count(F.lit(1)).alias("entries")).select(F.lit(n).alias("store"), "entries")
    stored = vectors(spark, sf_dir).join(h.select("chunk_id"), "chunk_id", "left_semi")
    return count(lexical.postings(h, "content"), "content").unionByName(count(lexical.postings(h, "title"), "title")).unionByName(count(stored, "vectors"))
