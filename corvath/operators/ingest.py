"""Ingest: from files to documents and chunks, each content once, by the parser that a file's name and type ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvath.functions.text import lines, stem_title
from corvath.operators.catalog import merge_metadata
from corvath.operators.chunk import describe, fold_blocks
from corvath.session import cut_lineage
from corvath.sources import parse

#: Characters of a document that are stored.
MAX_RAW = 100_000
_BLOCK = "document_id string, block_no int, text string, line_start int, line_end int, section string, page_number int"


def note_file(title: Column) -> Column:
    """The file name that a text without a file gets."""
    return F.concat(F.replace(F.lower(title), F.lit(" "), F.lit("_")), F.lit(".txt"))


def _blocks(files: DataFrame, kind: str) -> DataFrame:
    own = files.where(F.col("parser") == kind)
    if kind == "markdown":
        found = parse.markdown_blocks(own, "sha256", "text")
    elif kind == "code":
        found = parse.code_blocks(own, "sha256", "text", "name")
    elif kind == "html":
        found = parse.html_blocks(own, "sha256", "text").select("document_id", "block_no", "text")
    elif kind == "docx":
        found = parse.docx_blocks(own, "sha256", "content").select("document_id", "block_no", "section", "text")
    else:
        found = parse.text_blocks(own, "sha256", "text")
    have = set(found.columns)
    named = {c.split()[0]: c.split()[1] for c in _BLOCK.split(", ")}
    order = F.col("block_no") if "block_no" in have else F.col("line_start")
    return found.select(*[(order if c == "block_no" else F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in named.items()])


def ingest(files: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents (sha256, title, source_type, file_path, mime_type, parser, file_size_bytes, raw_content, doc_metadata,
    created_at) and chunks (document_id, chunk_index, content, token_count, chunk_hash, anchor_label, places).

    files: file_path, mime_type, content (bytes), source_type, doc_metadata, created_at; known: sha256 of the stored
    contents. Of equal contents the earliest file counts (ties by name), and none where the store has it. Entries that a
    parser makes win over given ones. The key of a document is its content's hash. Null contents are left out; PDF files
    come as page text (see parse.page_blocks), as nothing here reads them.
    """
    hashed = files.where("content is not null").withColumn("sha256", F.sha2("content", 256))
    one = hashed.groupBy("sha256").agg(F.min_by(F.struct(*files.columns), F.struct(F.col("created_at").isNull(), "created_at", "file_path")).alias("f")).select("sha256", "f.*")
    new = one.join(known.select("sha256").where("sha256 is not null").distinct(), "sha256", "left_anti")
    name = F.regexp_replace(F.coalesce("file_path", F.lit("")), "^.*/", "")
    parsed = cut_lineage(new.withColumns({"name": name, "text": parse.decode(F.col("content")), "parser": parse.parser_of(F.col("file_path"), F.col("mime_type"))}).where("parser <> 'pdf'"))
    blocks = None
    for kind in ("text", "markdown", "code", "html", "docx"):
        own = _blocks(parsed, kind)
        blocks = own if blocks is None else blocks.unionByName(own)
    blocks = cut_lineage(blocks)
    n_lines = F.size(lines(F.col("text"))) - F.when(F.col("text").endswith("\n") | (F.col("text") == ""), 1).otherwise(0)
    counted = blocks.groupBy(F.col("document_id").alias("sha256")).agg(F.count(F.lit(1)).alias("n_blocks"))
    html = parse.html_titles(parsed.where("parser = 'html'"), "sha256", "text")
    title = F.when(F.col("parser") == "markdown", parse.markdown_title(F.col("text"), F.col("name"))).when(F.col("parser") == "code", F.col("name")).when(F.col("parser") == "html", F.coalesce(F.nullif("html_title", F.lit("")), stem_title(F.col("name")))).otherwise(stem_title(F.col("name")))
    count = F.coalesce("n_blocks", F.lit(0)).cast("string")
    own_meta = F.create_map(F.lit("filename"), F.col("name"))
    entry = lambda k, v: F.create_map(F.lit(k), v)
    own_meta = (
        F.when(F.col("parser") == "docx", F.map_concat(own_meta, entry("total_paragraphs", count))).when(F.col("parser") == "html", F.map_concat(own_meta, entry("parsed_elements", count)))
        .when(F.col("parser") == "code", F.map_concat(own_meta, entry("language", parse.language_of(F.col("name"))), entry("total_lines", n_lines.cast("string"))))
        .otherwise(F.map_concat(own_meta, entry("total_lines", n_lines.cast("string"))))
    )
    documents = (
        parsed.join(counted, "sha256", "left").join(html, "sha256", "left").withColumn("own_meta", own_meta)
        .select("sha256", title.alias("title"), "source_type", "file_path", "mime_type", "parser", F.octet_length("content").alias("file_size_bytes"), F.left("text", F.lit(MAX_RAW)).alias("raw_content"), merge_metadata("doc_metadata", "own_meta").alias("doc_metadata"), "created_at")
    )
    return documents, describe(fold_blocks(blocks))
