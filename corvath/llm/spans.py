"""Exact spans of at least a given length that stand in more than one record.

Blocks of BLOCK characters at fixed offsets are the index; every rolling window of that length probes it. A window is
represented by the place of its least seed (a min-hashed SEED-gram), so that equal windows have their seeds at equal
places and neighbouring windows share theirs: the probes of a text shrink to its few seeds without losing one. The key
of an anchor is the hash of the stretch from one seed to the end of the next; a span of two blocks' length always has
such a stretch whole, with a seed of an indexed block. An anchor also tells how far windows with its seeds reach: a run
can't leave these, so what can't be as long as asked for is dropped before any text is read. Stretches that occur in two
records are extended to maximal repeats: pairwise where few rows share a key, and by all windows of the full length,
grouped by hash, where many do. Rows of a key that is frequent in a batch go the second way at once, spread over all
tasks; two of them stand for the batch where the key's rows are counted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvath.session import cut_lineage

MIN_LENGTH = 200
SEED = 32
#: Up to so many rows of one key are compared in pairs; the rows of a larger group go by windows, which needs no pairs.
PAIR_ROWS = 64
#: Up to so many ids of copies (some 16 bytes each) are broadcast to leave the copies out; more of them are joined.
BROADCAST_IDS = 100_000
SEGMENT = 1_000_000
_MASK = (1 << 64) - 1
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, so that each has an inverse modulo 2^64
_POS_BITS = 28
_SPAN_BITS = 11  # of a stretch's length, and of how far its windows reach on either side
_HELD = 100_000  # anchors, or windows, of one batch


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of a base and of its inverse, as long as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 16)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(self.n - 1, b, dtype=np.uint64)])) for b in (self.base, self.inverse))
        return self.up, self.down


_POWERS = tuple(_Powers(b) for b in _BASES)


class Rolling:
    """Hashes of any stretch of a text from prefix sums: equal stretches have equal hashes."""

    def __init__(self, codes: np.ndarray, which: int = 0):
        n = len(codes)
        up, self.down = _POWERS[which].upto(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(77 + which)) * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _least(values: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w consecutive values, by running minima from both ends of blocks of w."""
    n = len(values)
    blocks = np.concatenate([values, np.full(-n % w, np.uint64(_MASK))]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    k = n - w + 1
    return np.minimum(back[:k], ahead[w - 1 : w - 1 + k])


def anchors(codes: np.ndarray, block: int, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """start, end, key, whether it is indexed, and the reach (low, high) of the windows with its seeds, of every anchor of a text."""
    parts, w = [], block - seed + 1
    for a in range(0, max(1, len(codes)), SEGMENT):
        origin = max(0, a - block)
        piece = codes[origin : a + SEGMENT + 3 * block]
        if len(piece) < block:
            continue
        rolling = Rolling(piece)
        at = np.arange(len(piece) - seed + 1)
        value = (rolling.of(at, at + seed) & np.uint64(_MASK ^ ((1 << _POS_BITS) - 1))) | at.astype(np.uint64)
        place = (_least(value, w) & np.uint64((1 << _POS_BITS) - 1)).astype(np.int64)  # of every window
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))  # the first window of every seed
        seeds = place[first]
        if len(seeds) < 2:
            continue
        last = np.concatenate([first[1:], [len(place)]]) - 1
        start, end = seeds[:-1], seeds[1:] + seed
        of_block = np.isin(seeds, place[-origin % block :: block])
        keep = (start + origin >= a) & (start + origin < a + SEGMENT)
        found = (start + origin, end + origin, rolling.of(start, end), of_block[:-1] | of_block[1:], first[:-1] + origin, last[1:] + block + origin)
        parts.append([x[keep] for x in found])
    if not parts:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.uint64, bool, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _anchor_rows(block: int, pair_rows: int):
    """key, doc_id, place and weight: 1, or the batch's count of a frequent key, or minus that (0 for the second) of a row that stands for the batch."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            index, found, held = [], [], 0
            for i in range(len(batch)):
                x = anchors(code_points(texts[i].as_py()), block)
                index.append(np.full(len(x[0]), i, dtype=np.int64))
                found.append(x)
                held += len(x[0])
                if held > _HELD or i == len(batch) - 1:
                    start, end, key, indexed, low, high = (np.concatenate(y) for y in zip(*found))
                    # one column for all places, as a shuffled row pays for each
                    place = (((start << _SPAN_BITS | (end - start)) << _SPAN_BITS | (start - low)) << _SPAN_BITS | (high - end)) << 1 | indexed
                    own = np.concatenate(index)
                    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
                    weight = np.where(counts[inverse] > pair_rows, counts[inverse], 1)
                    frequent: dict[int, list] = {}
                    for k in np.flatnonzero(weight > 1):
                        frequent.setdefault(int(inverse[k]), []).append((ids[own[k]].as_py(), int(k)))
                    stand = [(k, at, w) for v in frequent.values() for (_, k), at, w in zip((min(v), max(v)), (0, 1), (-len(v), 0))]
                    more = np.array([k for k, _, _ in stand], dtype=np.int64)
                    any_indexed = np.array([any(place[j] & 1 for _, j in frequent[int(inverse[k])]) for k in more], dtype=np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([key, key[more]]).view(np.int64)), ids.take(pa.array(np.concatenate([own, own[more]]))), pa.array(np.concatenate([place, place[more] | any_indexed])), pa.array(np.concatenate([weight, [w for _, _, w in stand]]).astype(np.int32))],
                        names=["key", "doc_id", "place", "weight"],
                    )
                    index, found, held = [], [], 0

    return rows


def equal_runs(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The maximal stretches [s, e) of at least `least` places in which two arrays of one length are equal."""
    same = np.concatenate([[False], a == b, [False]])
    edges = np.flatnonzero(same[1:] != same[:-1])
    return [(int(s), int(e)) for s, e in zip(edges[::2], edges[1::2]) if e - s >= least]


def _extend(least: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, start, end = [], [], []
            for r in batch.to_pylist():
                for s, e in equal_runs(code_points(r["x_text"]), code_points(r["y_text"]), least):
                    for d, o in ((r["x"], r["low"]), (r["y"], r["low"] + r["shift"])):
                        doc.append(d), start.append(o + s), end.append(o + e)
            yield pa.RecordBatch.from_arrays([pa.array(doc, batch.schema.field("x").type), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["doc_id", "start", "end"])

    return rows


def _windows(least: int):
    """doc_id, start, end, h1, h2, kind: windows by hash (0), two that stand for a batch's (1), stretches that two records of a batch share (2)."""

    def of_batch(ids: list, index: np.ndarray, at: np.ndarray, h: list[np.ndarray], id_type: pa.DataType) -> pa.RecordBatch:
        order = np.lexsort((h[1], h[0]))
        index, at, h1, h2 = index[order], at[order], h[0][order], h[1][order]
        group = np.concatenate([[0], np.cumsum((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))]) if len(at) else np.zeros(0, dtype=np.int64)
        number = np.unique(np.array(ids, dtype=object).astype(str), return_inverse=True)[1]  # equal ids in several rows are one
        doc = number[index]
        low, high = np.full(group.max(initial=-1) + 1, len(ids)), np.full(group.max(initial=-1) + 1, -1)
        np.minimum.at(low, group, doc), np.maximum.at(high, group, doc)
        shared = (low != high)[group]
        # one row of the group's least record and one of its last
        stands = [np.flatnonzero(shared & (doc == x[group])) for x in (low, high)]
        stands = np.concatenate([x[np.unique(group[x], return_index=True)[1]] for x in stands])
        runs = np.flatnonzero(shared)
        runs = runs[np.lexsort((at[runs], index[runs]))]
        breaks = np.concatenate([[True], (index[runs][1:] != index[runs][:-1]) | (at[runs][1:] > at[runs][:-1] + 1)]) if len(runs) else np.zeros(0, dtype=bool)
        ends = np.concatenate([breaks[1:], [True]]) if len(runs) else breaks
        first, last = runs[breaks], runs[ends]
        rest = np.flatnonzero(~shared)
        rows = np.concatenate([rest, stands, first])
        end = np.concatenate([at[rest], at[stands], at[last]]) + least
        kind = np.repeat([0, 1, 2], [len(rest), len(stands), len(first)])
        return pa.RecordBatch.from_arrays(
            [pa.array([ids[i] for i in index[rows]], id_type), pa.array(at[rows].astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(h1[rows]), pa.array(h2[rows]), pa.array(kind.astype(np.int32))],
            names=["doc_id", "start", "end", "h1", "h2", "kind"],
        )

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held, id_type = [], [], 0, None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for r in batch.to_pylist():
                codes, origin = code_points(r["text"]), r["from"]
                at = np.arange(max(0, len(codes) - least + 1))
                holds = np.zeros(len(at), dtype=bool)  # windows that hold a stretch of a large group
                for s, e in zip(r["starts"], r["ends"]):
                    holds[max(0, e - origin - least) : s - origin + 1] = True
                at = at[holds]
                if len(at):
                    parts.append((np.full(len(at), len(ids)), at + origin, *(Rolling(codes, k).of(at, at + least).view(np.int64) for k in (0, 1))))
                    ids.append(r["doc_id"])
                    held += len(at)
                if held > 5 * _HELD:
                    index, at, *h = (np.concatenate(x) for x in zip(*parts))
                    yield of_batch(ids, index, at, h, id_type)
                    ids, parts, held = [], [], 0
        if parts:
            index, at, *h = (np.concatenate(x) for x in zip(*parts))
            yield of_batch(ids, index, at, h, id_type)

    return rows


def _copies(texts: DataFrame) -> DataFrame:
    """doc_id and rep of the documents whose whole text other ids have too; rep is the least of these ids."""
    digests = texts.select("doc_id", F.sha2("text", 256).alias("digest"))
    shared = digests.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep <> last")
    return digests.join(shared, "digest").select("doc_id", "rep").distinct()


def shared_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, pair_rows: int = PAIR_ROWS, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """doc_id, start, end: stretches of min_length or more code points, as stored, that other records' texts hold too.

    Stretches of one record may overlap; together they cover exactly the places of its text that stand in a shared run.
    Records of equal text share it whole; one of them stands for all, so a text that a third of all rows have costs as
    much as one. Null, empty and shorter texts, null ids and repeated rows of one id give no rows, nor does an empty table.
    pair_rows and broadcast_ids choose between ways to the same result.
    """
    block = min_length // 2
    if not SEED <= block < (1 << _SPAN_BITS) - 1:
        raise ValueError(f"min_length must lie between {2 * SEED} and {(2 << _SPAN_BITS) - 4}")
    texts = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where((F.length(text_col) >= min_length) & F.col(id_col).isNotNull())
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def few(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() <= broadcast_ids else ids

    copies = cut_lineage(_copies(texts))
    single = texts.join(few(copies.where("doc_id <> rep").select("doc_id")), "doc_id", "left_anti")

    # Rows of a key that is frequent in their batch are spread, and need no count; two rows of the batch stand for them.
    by_key = Window.partitionBy("key", F.when(F.col("weight") > 1, F.xxhash64("doc_id", "place")).otherwise(F.lit(0)))
    found = single.mapInArrow(_anchor_rows(block, pair_rows), f"key bigint, doc_id {id_type}, place bigint, weight int")
    part = lambda k: F.shiftright("place", 1 + k * _SPAN_BITS).bitwiseAND((1 << _SPAN_BITS) - 1)
    start = F.shiftright("place", 1 + 3 * _SPAN_BITS)
    shared = (
        found.select("*", F.min("doc_id").over(by_key).alias("least"), F.max("doc_id").over(by_key).alias("last"), F.max(F.col("place").bitwiseAND(1)).over(by_key).alias("hit"), F.sum(F.abs("weight")).over(by_key).alias("n"))
        .where("weight > 1 or weight = 1 and least <> last")
        .select("key", "doc_id", "hit", start.cast("int").alias("start"), (start + part(2)).cast("int").alias("end"), (start - part(1)).cast("int").alias("low"), (start + part(2) + part(0)).cast("int").alias("high"), (F.col("n") > pair_rows).alias("many"))
    )

    # Neighbouring shared stretches of a record form a chain. All windows of a run have their seeds in shared stretches, so
    # it lies within the reach of one chain, in both records, and holds a block that is indexed in either; a chain that
    # reaches less far than min_length, or has no hit of the index, holds no run.
    in_order, of_chain = Window.partitionBy("doc_id").orderBy("start", "end"), Window.partitionBy("doc_id", "chain")
    chained = shared.withColumn("new", F.when(F.col("start") <= F.lag("end").over(in_order), 0).otherwise(1)).withColumn("chain", F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    chained = cut_lineage(
        chained.select("key", "doc_id", "start", "end", "low", "high", "many", "hit", "chain", F.min("low").over(of_chain).alias("from"), F.max("high").over(of_chain).alias("to"), F.max("hit").over(of_chain).alias("any_hit"))
        .where(F.col("to") - F.col("from") >= min_length).where("any_hit = 1 or many").drop("any_hit")
    )
    chains = chained.groupBy("doc_id", "chain", "from", "to").agg(F.collect_list(F.when(F.col("many"), F.col("start"))).alias("starts"), F.collect_list(F.when(F.col("many"), F.col("end"))).alias("ends"))
    wanted = single.join(few(chained.select("doc_id").distinct()), "doc_id", "left_semi")
    slices = cut_lineage(chains.join(wanted, "doc_id").select("doc_id", "chain", "from", "starts", "ends", F.expr("substring(text, from + 1, to - from)").alias("text")))

    # Few rows of one key: all its pairs, at most pair_rows squared; the hits of one diagonal of two chains are one row,
    # and are dropped where the reach of both isn't long enough.
    members = F.sort_array(F.collect_list(F.struct("doc_id", "chain", "start", "low", "high", "hit")))
    shift = F.col("y.start") - F.col("x.start")
    pairs = (
        chained.where("not many").groupBy("key").agg(members.alias("m"))
        .select(F.explode("m").alias("x"), "m").select("x", F.explode("m").alias("y")).where("x.doc_id < y.doc_id")
        .groupBy(F.col("x.doc_id").alias("x"), F.col("x.chain").alias("x_chain"), F.col("y.doc_id").alias("y"), F.col("y.chain").alias("y_chain"), shift.alias("shift"))
        .agg(F.min(F.greatest(F.col("x.low"), F.col("y.low") - shift)).alias("low"), F.max(F.least(F.col("x.high"), F.col("y.high") - shift)).alias("high"), F.max("x.hit").alias("hit"))
        .where((F.col("high") - F.col("low") >= min_length) & (F.col("hit") == 1))
    )
    sides = [slices.select(F.col("doc_id").alias(s), F.col("chain").alias(f"{s}_chain"), F.col("from").alias(f"{s}_from"), F.col("text").alias(f"{s}_text")) for s in "xy"]
    cut = lambda s, shift: F.expr(f"substring({s}_text, low {shift} - {s}_from + 1, high - low)").alias(f"{s}_text")
    of_x = pairs.join(sides[0], ["x", "x_chain"]).select("x", "y", "y_chain", "shift", "low", "high", cut("x", ""))
    runs = of_x.join(sides[1], ["y", "y_chain"]).select("x", "y", "shift", "low", "x_text", cut("y", "+ shift")).mapInArrow(_extend(min_length), f"doc_id {id_type}, start int, end int")

    # Many rows of one key: every window of the full length around the stretch, by its two hashes.
    by_window = Window.partitionBy("h1", "h2")
    windows = cut_lineage(slices.where(F.size("starts") > 0).select("doc_id", "from", "text", "starts", "ends").mapInArrow(_windows(min_length), f"doc_id {id_type}, start int, end int, h1 bigint, h2 bigint, kind int"))
    met = windows.where("kind < 2").select("doc_id", "start", "end", "kind", F.min("doc_id").over(by_window).alias("least"), F.max("doc_id").over(by_window).alias("last")).where("kind = 0 and least <> last")
    repeated = met.select("doc_id", "start", "end").unionByName(windows.where("kind = 2").select("doc_id", "start", "end"))

    of_singles = runs.unionByName(repeated).distinct()
    whole = texts.select("doc_id", F.lit(0).alias("start"), F.length("text").alias("end")).join(few(copies.select("doc_id")), "doc_id", "left_semi").distinct()
    return of_singles.unionByName(whole)


def merged(spans: DataFrame) -> DataFrame:
    """doc_id, start, end: overlapping and touching stretches made one."""
    in_order = Window.partitionBy("doc_id").orderBy("start", "end")
    before = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = spans.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("run", F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("doc_id", "start", "end")


def shares(documents: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, shared_chars, share: how much of each record's text stands elsewhere, for every row with an id.

    Null and empty texts have 0 characters and a share of 0.
    """
    covered = merged(spans).groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    every = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.coalesce(F.length(text_col), F.lit(0)).alias("n_chars")).distinct()
    n = F.coalesce("covered", F.lit(0))
    return every.join(covered, "doc_id", "left").select("doc_id", "n_chars", n.cast("bigint").alias("shared_chars"), F.when(F.col("n_chars") > 0, F.round(n / F.col("n_chars"), 6)).otherwise(F.lit(0.0)).alias("share"))
