"""Cutting giant text files: byte ranges are read on their own, and no task ever holds a whole file.

Every range is first measured (its code points). Prefix sums of these, over one row per range, give each range its place
in the file. Then each range is read with a halo for its table of boundaries, the tables are stitched as
corvath.llm.splitting does, and the ranges in which pieces end are read once more to emit them by offset.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvath.session import cut_lineage

from . import splitting

RANGE_BYTES = 4 << 20
_CONTINUATION = [bytes([b]) for b in range(0x80, 0xC0)]


def _read(path: str, start: int, end: int) -> bytes:
    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with system.open_input_file(name) as f:
        f.seek(start)
        return f.read(end - start)


def file_ranges(spark: SparkSession, paths: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, size, range_no, byte_start, byte_end of files that all executors can read."""
    sizes = []
    for p in paths:
        system, name = fs.FileSystem.from_uri(p) if "://" in p else (fs.LocalFileSystem(), p)
        sizes.append((p, system.get_file_info(name).size))
    files = spark.createDataFrame(sizes, "path string, size bigint").where("size > 0")
    last = F.floor((F.col("size") - 1) / F.lit(range_bytes)).cast("bigint")
    each = files.withColumn("range_no", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return each.select("path", "size", "range_no", (F.col("range_no") * range_bytes).alias("byte_start"), F.least("size", (F.col("range_no") + 1) * range_bytes).alias("byte_end")).repartition("path", "range_no")


def _measure(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        chars = []
        for r in pdf.itertuples(index=False):
            data = _read(r.path, r.byte_start, r.byte_end)
            chars.append(len(data) - sum(map(data.count, _CONTINUATION)))
        yield pdf.assign(n_chars=chars)


def _load(halo: int):
    """The bytes of each range and its halo, as splitting.ranges_of has them of texts."""

    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                before = min(r.byte_start, halo)
                data = _read(r.path, r.byte_start - before, min(r.size, r.byte_end + halo))
                yield pd.DataFrame([(r.path.encode(), r.path, r.range_no, r.char_start, r.total_chars, data, before, r.byte_end - r.byte_start)], columns=[c.split()[0] for c in _RANGE.split(", ")])

    return rows


_RANGE = "key binary, record_id string, range_no bigint, char_start bigint, total_chars bigint, data binary, before int, own int"


def split_files(spark: SparkSession, paths: list[str], max_size: int, overlap: int, range_bytes: int = RANGE_BYTES, block_chars: int = splitting.BLOCK_CHARS) -> DataFrame:
    """path, piece_no, char_start, char_end, line_start, boundary, content of UTF-8 files.

    Pieces are at most max_size code points, overlap by `overlap`, and are the same whatever the size of the ranges. A
    file within the limit is one piece; an empty file has none.
    """
    if not 0 <= overlap < max_size:
        raise ValueError("overlap must be smaller than max_size, and not negative")
    range_bytes = max(range_bytes, 4)
    measured = file_ranges(spark, paths, range_bytes).mapInPandas(_measure, "path string, size bigint, range_no bigint, byte_start bigint, byte_end bigint, n_chars bigint")
    before = Window.partitionBy("path").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut_lineage(measured.select("*", F.coalesce(F.sum("n_chars").over(before), F.lit(0)).alias("char_start"), F.sum("n_chars").over(Window.partitionBy("path")).alias("total_chars"))).repartition("path", "range_no")
    limits = [("file", max_size, overlap)]
    long = placed.where(F.col("total_chars") > max_size)
    tables = long.mapInPandas(_load(splitting.HALO), _RANGE).mapInArrow(splitting._detect(limits), splitting._TABLE)
    cuts = splitting.stitched(tables, limits, block_chars)
    piece = F.struct("limit_name", "piece_no", "char_start", "char_end", "line_start", "line_end", "boundary")
    ending = cuts.groupBy(F.col("record_id").alias("path"), "range_no").agg(F.collect_list(piece).alias("pieces"))
    whole = placed.where((F.col("total_chars") <= max_size) & (F.col("byte_end") == F.col("size"))).select(
        "path", "range_no", F.array(F.struct(F.lit("file").alias("limit_name"), F.lit(0).cast("bigint").alias("piece_no"), F.lit(0).cast("bigint").alias("char_start"), F.col("total_chars").alias("char_end"), F.lit(1).cast("bigint").alias("line_start"), F.lit(1).cast("bigint").alias("line_end"), F.lit("end").alias("boundary"))).alias("pieces")
    )
    back = 4 * max_size

    def read(r: dict) -> tuple[bytes, int]:
        own = min(r["byte_start"], back)
        return _read(r["record_id"], r["byte_start"] - own, min(r["size"], r["byte_end"] + 4)), own

    joined = placed.join(ending.unionByName(whole), ["path", "range_no"]).select(F.col("path").alias("record_id"), "size", "byte_start", "byte_end", "char_start", "pieces")
    out = joined.mapInArrow(splitting.emit(read), f"record_id string, {splitting.PIECES}")
    return out.select(F.col("record_id").alias("path"), "piece_no", "char_start", "char_end", "line_start", "boundary", "content")
