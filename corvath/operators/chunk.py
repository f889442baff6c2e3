"""Chunks of documents: folding blocks up to a target size, or windows of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvath.functions.text import strip

TARGET, OVERLAP = 1500, 200


def plain_chunks(documents: DataFrame, id_col: str, text_col: str, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """document_id, chunk_index, content: windows of `target` characters, trimmed, blank ones left out and not counted."""
    texts = documents.where(F.length(text_col) > 0).select(F.col(id_col).alias("document_id"), F.col(text_col).alias("text"))
    cut = F.transform(F.sequence(F.lit(0), F.length("text") - 1, F.lit(target - overlap)), lambda i: strip(F.substring("text", i + 1, F.lit(target))))
    return texts.select("document_id", F.posexplode(F.filter(cut, lambda c: c != "")).alias("chunk_index", "content"))


def fold_blocks(blocks: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """document_id, chunk_index, content, line_start, line_end, sections, pages of blocks in their order.

    blocks: document_id, block_no, text, and optionally line_start, line_end, section, page_number. Blocks are gathered
    until they reach `target` characters; the last block is kept as overlap where it isn't the only one and is shorter
    than `overlap`, without its places. A fold with such resets is no window function: one aggregate() over a document's
    blocks, whose number the document's length bounds.
    """
    have = set(blocks.columns)
    field = lambda c, t: (F.col(c) if c in have else F.lit(None)).cast(t).alias(c)
    row = F.struct(F.col("block_no").cast("int").alias("block_no"), strip(F.col("text")).alias("text"), field("line_start", "int"), field("line_end", "int"), field("section", "string"), field("page_number", "int"))
    grouped = blocks.groupBy("document_id").agg(F.array_sort(F.collect_list(row)).alias("all")).select("document_id", F.filter("all", lambda b: b["text"] != "").alias("all"))
    chunk = "struct<content: string, line_start: int, line_end: int, sections: array<string>, pages: array<int>>"
    state = f"struct<parts: array<string>, n: int, a: int, b: int, s: array<string>, p: array<int>, out: array<{chunk}>>"

    def put(acc: Column) -> Column:
        return F.struct(F.array_join(acc["parts"], "\n\n").alias("content"), acc["a"].alias("line_start"), acc["b"].alias("line_end"), acc["s"].alias("sections"), F.array_sort(acc["p"]).alias("pages")).cast(chunk)

    def add(values: Column, value: Column) -> Column:
        return F.when(value.isNull() | F.array_contains(values, value), values).otherwise(F.concat(values, F.array(value)))

    def step(acc: Column, x: Column) -> Column:
        grown = F.struct(
            F.concat(acc["parts"], F.array(x["text"])).alias("parts"), (acc["n"] + F.length(x["text"])).alias("n"), F.least(acc["a"], x["line_start"]).alias("a"), F.greatest(acc["b"], x["line_end"]).alias("b"),
            add(acc["s"], x["section"]).alias("s"), add(acc["p"], x["page_number"]).alias("p"), acc["out"].alias("out"),
        ).cast(state)
        keep = (F.size(grown["parts"]) > 1) & (F.length(x["text"]) < overlap)
        none = F.array()
        emitted = F.struct(
            F.when(keep, F.array(x["text"])).otherwise(none.cast("array<string>")).alias("parts"), F.when(keep, F.length(x["text"])).otherwise(0).alias("n"), F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b"),
            none.cast("array<string>").alias("s"), none.cast("array<int>").alias("p"), F.concat(grown["out"], F.array(put(grown))).alias("out"),
        ).cast(state)
        return F.when(grown["n"] >= target, emitted).otherwise(grown)

    start = F.expr(f"cast(named_struct('parts', array(), 'n', 0, 'a', null, 'b', null, 's', array(), 'p', array(), 'out', array()) as {state})")
    done = F.aggregate("all", start, step, lambda acc: F.when(F.size(acc["parts"]) > 0, F.concat(acc["out"], F.array(put(acc)))).otherwise(acc["out"]))
    return grouped.select("document_id", F.posexplode(done).alias("chunk_index", "c")).select("document_id", "chunk_index", "c.*")


def describe(chunks: DataFrame, file_name: str | None = None) -> DataFrame:
    """token_count, chunk_hash and anchor_label added to document_id, chunk_index, content and the places there are."""
    have = set(chunks.columns)
    index = F.col("chunk_index").cast("string")
    number = F.concat(F.lit("Chunk #"), (F.col("chunk_index") + 1).cast("string"))
    label = number
    if "sections" in have:
        label = F.when(F.size("sections") > 0, F.concat(F.lit("Section: "), F.col("sections")[0])).otherwise(label)
    if "line_start" in have:
        span = F.concat_ws("-", "line_start", "line_end")
        prefix = F.coalesce(F.concat(F.col(file_name), F.lit(":")), F.lit("Lines ")) if file_name else F.lit("Lines ")
        label = F.when(F.col("line_start").isNotNull() & F.col("line_end").isNotNull(), F.concat(prefix, span)).otherwise(label)
    if "pages" in have:
        first, last = F.array_min("pages"), F.array_max("pages")
        label = F.when(F.size("pages") > 0, F.when(first == last, F.concat(F.lit("Page "), first)).otherwise(F.concat(F.lit("Pages "), first, F.lit("-"), last))).otherwise(label)
    return chunks.withColumns(
        {"token_count": F.greatest(F.lit(1), F.floor(F.length("content") / 4)).cast("int"), "chunk_hash": F.sha2(F.concat(index, F.lit(":"), "content"), 256), "anchor_label": label}
    )
