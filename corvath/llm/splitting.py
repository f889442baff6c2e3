"""Cutting oversized texts into pieces of bounded length with a fixed overlap, at natural boundaries.

A text is worked on by byte ranges, each a row of its own with a halo on both sides. Workers detect the boundaries in
their range and give a table of them: places of line ends, and of each other kind the first and last in every cell of the
text. Character places come from prefix sums over the ranges' lengths. The tables are stitched by record (a giant one in
blocks of bounded length, which meet at a boundary that both can see), the cuts are chosen from them, and the pieces are
emitted by offset from the range they end in. Nothing but the first step, which slices its bytes, touches a whole text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_BYTES = 65_536
#: Bytes around a range in which a boundary's characters may lie.
HALO = 256
#: Characters whose boundaries are stitched in one task.
BLOCK_CHARS = 1 << 24
MAX_LIMITS = 1_000
#: Cells of the smallest limit.
CELLS = 16
KINDS = ("paragraph", "line", "sentence", "word", "none")  # best first
_PATTERNS = ((0, re.compile(r"\n[ \t\r]*\n\s*")), (2, re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]")))
_BLANKS = np.array([c for c in range(0x3001) if chr(c).isspace()], dtype=np.uint32)
_TABLE = "key binary, record_id string, range_no bigint, char_start bigint, n_chars bigint, total_chars bigint, breaks array<int>, at array<int>, kind array<int>"
_PIECE = "struct<char_start: bigint, char_end: bigint, line_start: bigint, line_end: bigint, boundary: string, range_no: bigint>"


def first_character(data: bytes, at: int) -> int:
    """The first byte at or after `at` that begins a character."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def _marks(c: str) -> bool:
    return category(c)[0] == "M" or c == "‍"


def _thin(places: np.ndarray, cell: int) -> np.ndarray:
    """Of sorted places, the first and last in every cell."""
    if not len(places):
        return places
    change = np.flatnonzero((places[1:] - 1) // cell != (places[:-1] - 1) // cell)
    return np.unique(np.concatenate([places[:1], places[change], places[change + 1], places[-1:]]))


def boundaries(text: str, low: int, high: int, base: int, cell: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line ends, and places and kinds of the other boundaries, in text[low:high], whose first character has the place `base`.

    All are relative to base. A boundary is the place at which a piece may begin, and belongs to the character before it.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    breaks = np.flatnonzero(codes[low:high] == 10)
    blank = np.isin(codes, _BLANKS)
    begins = np.flatnonzero(blank & np.append(~blank[1:], True)) + 1
    found = [(k, np.array([m.end() for m in p.finditer(text)], dtype=np.int64)) for k, p in _PATTERNS] + [(3, begins)]
    at, kinds = [], []
    for kind, ends in found:
        at.append(_thin(ends[(ends > low) & (ends <= high)] - low + base, cell) - base)
        kinds.append(np.full(len(at[-1]), kind))
    safe = []
    for p in range((base // cell + 1) * cell - base + low, high + 1, cell):
        while p > low and p < len(text) and (_marks(text[p]) or text[p - 1] == "‍"):
            p -= 1  # not between a letter and its marks
        if p > low:
            safe.append(p - low)
    at.append(np.unique(np.array(safe, dtype=np.int64)))
    kinds.append(np.full(len(at[-1]), 4))
    return breaks, np.concatenate(at), np.concatenate(kinds)


def cell_of(limits: list[tuple[str, int, int]]) -> int:
    return max(1, min((m - o for _, m, o in limits), default=1) // CELLS)


def _detect(limits: list[tuple[str, int, int]]):
    cell = cell_of(limits)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {c: batch.column(c) for c in ("key", "record_id", "range_no", "char_start", "total_chars")}
            found, chars = [], []
            for data, before, own, base in zip(batch.column("data"), batch.column("before").to_pylist(), batch.column("own").to_pylist(), cols["char_start"].to_pylist()):
                data = data.as_py()
                a, b = first_character(data, before), first_character(data, before + own)
                left, mid = data[first_character(data, 0) : a].decode("utf-8", "replace"), data[a:b].decode("utf-8", "replace")
                text = left + mid + data[b:].decode("utf-8", "ignore")
                found.append(boundaries(text, len(left), len(left) + len(mid), base, cell))
                chars.append(len(mid))
            lists = [pa.array([x[j].astype(np.int32) for x in found], pa.list_(pa.int32())) for j in range(3)]
            yield pa.RecordBatch.from_arrays([cols["key"], cols["record_id"], cols["range_no"], cols["char_start"], pa.array(chars, pa.int64()), cols["total_chars"], *lists], names=[c.split()[0] for c in _TABLE.split(", ")])

    return rows


def choose(start: int, stop: int, total: int, by_kind: list[list[int]], max_size: int, overlap: int) -> list[tuple[int, int, str]]:
    """The pieces (start, end, kind of their end) from the cut `start` to the cut `stop`.

    A piece ends at the last boundary of the best kind in the second half of its room, else at the last boundary of any
    kind in the first half, else, where its room holds none, at its end.
    """
    out, cut = [], start
    while True:
        begin = max(0, cut - overlap)
        limit = begin + max_size
        if stop <= limit:
            out.append((begin, stop, "end" if stop == total else ""))
            return out
        half = cut + (limit - cut) // 2
        last = [(places[k - 1] if (k := bisect_right(places, limit)) else -1) for places in by_kind]
        for kind, p in enumerate(last[:-1]):
            if p > half:
                break
        else:
            kind, p = max(((k, p) for k, p in enumerate(last[:-1])), key=lambda x: (x[1], -x[0]), default=(4, -1))
            if p <= cut:
                kind, p = 4, last[-1] if last[-1] > half else limit
        out.append((begin, p, KINDS[kind]))
        cut = p


def border(at: int, by_kind: list[list[int]], room: int) -> tuple[int, str]:
    """The cut between two blocks: the last boundary of the best kind within `room` before `at`, else `at` itself."""
    for kind, places in enumerate(by_kind):
        if (k := bisect_right(places, at)) and places[k - 1] > at - room:
            return places[k - 1], KINDS[kind]
    return at, KINDS[4]


def _cut(limits: list[tuple[str, int, int]], block_chars: int):
    cell, room = cell_of(limits), room_of(limits)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                ranges = sorted(r["ranges"], key=lambda x: x["range_no"])
                total, block = r["total_chars"], r["block"]
                starts = [x["char_start"] for x in ranges]
                place = np.concatenate([np.asarray(x["at"], dtype=np.int64) + x["char_start"] for x in ranges])
                kind = np.concatenate([np.asarray(x["kind"], dtype=np.int64) for x in ranges])
                breaks = np.concatenate([np.asarray(x["breaks"], dtype=np.int64) + x["char_start"] for x in ranges])
                # cells that two ranges share are thinned once more: the cuts don't depend on the ranges
                by_kind = [(_thin(np.sort(place[kind == k]), cell) if k != 1 else breaks + 1).tolist() for k in range(len(KINDS))]
                start = border(block * block_chars, by_kind, room)[0] if block else 0
                last = (block + 1) * block_chars >= total
                stop, stop_kind = (total, "end") if last else border((block + 1) * block_chars, by_kind, room)
                lines = lambda p: ranges[0]["lines_before"] + int(np.searchsorted(breaks, p)) + 1
                for name, max_size, overlap in limits:
                    if total > max_size:
                        pieces = choose(start, stop, total, by_kind, max_size, overlap)
                        out.append((r["key"], r["record_id"], name, block, [
                            {"char_start": s, "char_end": e, "line_start": lines(s), "line_end": lines(e), "boundary": k or stop_kind, "range_no": ranges[max(0, bisect_right(starts, e - 1) - 1)]["range_no"]} for s, e, k in pieces
                        ]))
            piece = pa.struct([("char_start", pa.int64()), ("char_end", pa.int64()), ("line_start", pa.int64()), ("line_end", pa.int64()), ("boundary", pa.string()), ("range_no", pa.int64())])
            types = (pa.binary(), pa.string(), pa.string(), pa.int64(), pa.list_(piece))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate(types)], names=["key", "record_id", "limit_name", "block", "pieces"])

    return rows


def room_of(limits: list[tuple[str, int, int]]) -> int:
    return min((m - o for _, m, o in limits), default=1)


def stitched(tables: DataFrame, limits: list[tuple[str, int, int]], block_chars: int = BLOCK_CHARS) -> DataFrame:
    """key, record_id, limit_name, piece_no, char_start, char_end, line_start, line_end, boundary, range_no from boundary tables."""
    reach = room_of(limits) + max((o for _, _, o in limits), default=0)  # what a block has to see before its own start
    by_range = Window.partitionBy("key").orderBy("range_no")
    once = tables.withColumn("before_no", F.lag("range_no").over(by_range)).where("before_no is null or before_no < range_no")  # a repeated row counts once
    placed = once.withColumn("lines_before", F.coalesce(F.sum(F.size("breaks")).over(by_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint"))
    end, last = F.col("char_start") + F.col("n_chars"), F.floor((F.col("total_chars") - 1) / F.lit(block_chars))
    of_blocks = placed.withColumn("block", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("char_start") - 1) / F.lit(block_chars))), F.least(last, F.floor((end + F.lit(reach)) / F.lit(block_chars))))))
    grouped = of_blocks.groupBy("key", "record_id", "total_chars", "block").agg(F.collect_list(F.struct("range_no", "char_start", "lines_before", "breaks", "at", "kind")).alias("ranges"))
    cuts = grouped.select("key", "record_id", "total_chars", "block", "ranges").mapInArrow(_cut(limits, block_chars), f"key binary, record_id string, limit_name string, block bigint, pieces array<{_PIECE}>")
    before = F.coalesce(F.sum(F.size("pieces")).over(Window.partitionBy("key", "limit_name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = cuts.withColumn("first", before).select("key", "record_id", "limit_name", "first", F.posexplode("pieces").alias("k", "p"))
    return numbered.select("key", "record_id", "limit_name", (F.col("first") + F.col("k")).alias("piece_no"), "p.*")


def emit(read: Callable[[dict], tuple[bytes, int]] | None = None):
    """Pieces with their content from rows of a range (data and before, or what `read` reads) and the pieces that end in it."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, out = [], []
            for i in range(len(batch)):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names if c not in ("carried",)}
                data, before = read(r) if read else (r["data"], r["before"])
                own = first_character(data, before)
                left = data[first_character(data, 0) : own].decode("utf-8", "replace")
                text, origin = left + data[own:].decode("utf-8", "ignore"), r["char_start"] - len(left)
                for p in r["pieces"]:
                    index.append(i)
                    out.append((p["limit_name"], p["piece_no"], p["char_start"], p["char_end"], p["line_start"], p["line_end"], p["boundary"], text[p["char_start"] - origin : p["char_end"] - origin]))
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["limit_name", "piece_no", "char_start", "char_end", "line_start", "line_end", "boundary", "content"]
            kept = [c for c in ("record_id", "carried") if c in batch.schema.names]
            at = pa.array(index, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in kept), *(pa.array([x[j] for x in out], t) for j, t in enumerate(types))], names=[*kept, *names])

    return rows


PIECES = "limit_name string, piece_no bigint, char_start bigint, char_end bigint, line_start bigint, line_end bigint, boundary string, content string"


def limits_of(size_limits: DataFrame, field_name: str, unit: str = "char") -> list[tuple[str, int, int]]:
    """The limits of one field: a configuration table, refused beyond MAX_LIMITS rows."""
    rows = size_limits.where((F.col("field_name") == field_name) & (F.col("unit") == unit)).select("limit_name", "max_size", F.coalesce("overlap", F.lit(0)).alias("overlap")).distinct().limit(MAX_LIMITS + 1).collect()
    if len(rows) > MAX_LIMITS:
        raise ValueError(f"more than {MAX_LIMITS} limits for {field_name}")
    for r in rows:
        if r.max_size is None or not 0 <= r.overlap < r.max_size:
            raise ValueError(f"{r.limit_name}: max_size must exceed overlap, and overlap must not be negative")
    return sorted((r.limit_name, r.max_size, r.overlap) for r in rows)


def ranges_of(records: DataFrame, id_col: str, text_col: str, limits: list[tuple[str, int, int]], range_bytes: int, halo: int, after: int, *carry: str) -> DataFrame:
    """key, record_id, range_no, char_start, total_chars, data, before, own: the byte ranges of each text beyond a limit.

    key tells records apart by id and text. A slice costs its own length, and the ranges' lengths are summed in the row.
    """
    least = min((m for _, m, _ in limits), default=None)
    text = F.col(text_col)
    long = records.where(F.length(text) > least if least is not None else F.lit(False)).select(
        F.unhex(F.sha2(F.concat(F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("")), F.lit("\n"), text), 256)).alias("key"),
        F.col(id_col).cast("string").alias("record_id"), text.cast("binary").alias("bytes"), F.length(text).cast("bigint").alias("total_chars"), *carry,
    )
    size = F.octet_length("bytes")
    part = lambda start, n: F.substring("bytes", (start + 1).cast("int"), n.cast("int") if isinstance(n, Column) else F.lit(n))
    # characters that begin in a range: what length() counts, without the bytes that continue one from before
    continued = lambda start: F.length(F.regexp_extract(F.hex(part(start, 3)), "^(?:[89AB].)*", 0)) / 2
    starts = F.sequence(F.lit(0), size - 1, F.lit(range_bytes))
    counts = F.transform(starts, lambda s: (F.length(part(s, range_bytes).cast("string")) - continued(s)).cast("bigint"))
    sums = F.aggregate(counts, F.array(F.lit(0).cast("bigint")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    each = long.select("*", sums.alias("sums")).select("*", F.explode(F.sequence(F.lit(0), F.size("sums") - 2)).alias("no"))
    start = F.col("no") * range_bytes
    before = F.least(start, F.lit(halo))
    own = F.least(size - start, F.lit(range_bytes))
    return each.select("key", "record_id", F.col("no").cast("bigint").alias("range_no"), F.element_at("sums", F.col("no") + 1).alias("char_start"), "total_chars", part(start - before, before + own + after).alias("data"), before.alias("before"), own.alias("own"), *carry)


def pieces(records: DataFrame, id_col: str, text_col: str, limits: list[tuple[str, int, int]], range_bytes: int = RANGE_BYTES, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """limit_name, record_id, piece_no, char_start, char_end, line_start, line_end, boundary.

    Characters are code points, places count from 0 and ends are exclusive; lines count from 1. Every piece is at most
    max_size long; piece n + 1 starts `overlap` before the end of piece n. A piece is cut inside a word only where its
    room holds no boundary at all. Texts that are null or within the limit give no rows, nor does an empty table. Rows
    that repeat an id and its text count once; texts of one id, or without an id, that differ are cut each on its own.
    """
    return _places(records, id_col, text_col, limits, range_bytes, block_chars).drop("key", "range_no")


def _places(records: DataFrame, id_col: str, text_col: str, limits: list[tuple[str, int, int]], range_bytes: int, block_chars: int) -> DataFrame:
    ranges = ranges_of(records, id_col, text_col, limits, range_bytes, HALO, HALO)
    return stitched(ranges.mapInArrow(_detect(limits), _TABLE), limits, block_chars)


def split_records(records: DataFrame, id_col: str, text_col: str, limits: list[tuple[str, int, int]], carry: str | None = None, range_bytes: int = RANGE_BYTES, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The pieces with their content and the carried column of their record, as `pieces` has them."""
    longest = max((m for _, m, _ in limits), default=1)
    range_bytes = max(range_bytes, 4 * longest)  # so that what a range needs of the one before is no more than its own length
    found = _places(records, id_col, text_col, limits, range_bytes, block_chars)
    ending = found.groupBy("key", "range_no").agg(F.collect_list(F.struct("limit_name", "piece_no", "char_start", "char_end", "line_start", "line_end", "boundary")).alias("pieces"))
    more = [carry] if carry else []
    ranges = ranges_of(records, id_col, text_col, limits, range_bytes, 4 * longest, 0, *more).dropDuplicates(["key", "range_no"])
    joined = ranges.join(ending, ["key", "range_no"]).select("record_id", "char_start", "data", "before", "pieces", *[F.col(c).alias("carried") for c in more])
    carried = f", carried {records.schema[carry].dataType.simpleString()}" if carry else ""
    out = joined.mapInArrow(emit(), f"record_id string{carried}, {PIECES}")
    return out.withColumnRenamed("carried", carry) if carry else out
