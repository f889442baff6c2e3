"""Near-duplicate records by anchor-point covering.

A record's fingerprint is a word of four min-hash symbols (RECORD_TABLES such words in all). The anchors are the words whose
symbols add up to 0 modulo 2^64: a code that covers every word within radius 1, and in which a word has exactly four
anchors in that radius, one for each symbol that may be replaced. A fingerprint is replicated to these anchors, so two
fingerprints that differ in at most one symbol meet at one anchor. Those that meet are compared by longer sketches, and
what passes is compared exactly on the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvath import session

THRESHOLD = 0.8
SHINGLE = 5
TABLES = 8
#: Words of a record: a pair at a similarity of 0.6 meets at none of their anchors in 1 of 30,000 cases (8 words: 1 of 174).
RECORD_TABLES = 16
_SYMBOLS = 4
_MINS = RECORD_TABLES * _SYMBOLS
#: Bins of the sketch, two bits each: 256 of them fill eight bigints, four for each bit.
_BINS = 256
_SKETCH = [f"s{i}" for i in range(_BINS // 32)]
#: Rows of one anchor, or copies of one text, that are joined in one task; larger groups are salted over several.
SALT_ROWS = 512
#: Up to so many ids, digests or keys (some 10 to 50 bytes each) are broadcast; more of them are joined.
BROADCAST_ROWS = 200_000
MEMO_WORDS = 200_000
_MULTIPLIERS = np.array([xxhash.xxh64_intdigest(f"m{i}") | 1 for i in range(_MINS)], dtype=np.uint64)
_SEEDS = np.array([xxhash.xxh64_intdigest(f"s{i}") for i in range(_MINS)], dtype=np.uint64)
_ODD = [np.uint64(xxhash.xxh64_intdigest(f"w{i}") | 1) for i in range(16)]
_BLANK = re.compile(r"[ \t\r\n]+")

#: Each step is written and its shuffles are removed, so that disk holds one step's shuffles at a time.
cut_lineage = partial(session.cut_lineage, drop_shuffles=True)


def words_of(text: str) -> list[str]:
    return [w for w in _BLANK.split(text.lower()) if w]


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_HASHES = _WordHashes()


def shingle_hashes(words: list[str], size: int) -> np.ndarray:
    """Hashes of the distinct runs of `size` words."""
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(h) - size + 1
    x = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        x += h[i : i + n] * _ODD[i]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(x ^ (x >> np.uint64(32)))


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    least = np.full(_MINS, np.uint64((1 << 64) - 1))
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, ((hashes[at : at + 4096, None] ^ _SEEDS) * _MULTIPLIERS).min(axis=0))
    return least


def anchors_of(mins: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """The keys of the anchors within radius 1 of each fingerprint: tables * 4 of them."""
    words = mins[: tables * _SYMBOLS].reshape(tables, _SYMBOLS)
    out = np.empty((tables, _SYMBOLS), dtype=np.uint64)
    for i in range(_SYMBOLS):
        code = words.copy()
        code[:, i] = np.uint64(0) - (words.sum(axis=1, dtype=np.uint64) - words[:, i])
        key = np.arange(1, tables + 1, dtype=np.uint64) * _ODD[15]
        for j in range(_SYMBOLS):
            key = (key ^ code[:, j]) * _ODD[j]
            key ^= key >> np.uint64(29)
        out[:, i] = key
    return out.ravel()


def sketch_of(hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """Which bins are filled, a bit of the least of the ascending hashes in each, and the number of filled bins."""
    bins, first = np.unique(hashes & np.uint64(_BINS - 1), return_index=True)
    bits = np.zeros((2, _BINS), dtype=np.uint64)
    at = bins.astype(np.int64)
    bits[0, at] = 1
    bits[1, at] = (hashes[first] >> np.uint64(8)) & np.uint64(1)
    return np.bitwise_or.reduce(bits.reshape(-1, 64) << np.arange(64, dtype=np.uint64), axis=1).view(np.int64), len(bins)


def may_be_near(threshold: float) -> Column:
    """Whether the sketches of x and y leave room for a similarity of the threshold: sizes of sets allow it, and no fewer
    bins are equal than expected at the threshold less 5 standard deviations.

    Of the u bins that either fills, a share as large as the similarity has one least shingle for both; where both are
    filled (b bins), different ones are equal in 1 of 2 cases. Shingles are drawn into bins without being put back, hence
    the factor (f - u) / (f - 1): the bins of a small set hold nearly all of it, and the estimate is nearly exact.
    """
    half = len(_SKETCH) // 2
    filled = [f"x.{p} & y.{p}" for p in _SKETCH[:half]]
    b = "(" + " + ".join(f"bit_count({p})" for p in filled) + ")"
    equal = " + ".join(f"bit_count({p} & ~(x.{s} ^ y.{s}))" for p, s in zip(filled, _SKETCH[half:]))
    t, u, f = f"{threshold}D", f"(x.filled + y.filled - {b})", f"((x.size + y.size) / {1 + threshold}D)"
    variance = f"{u} * {t} * (1 - {t}) * least(1D, greatest(0D, ({f} - {u}) / greatest(1D, {f} - 1))) / 4 + greatest(0D, {b} - {t} * {u}) / 4"
    return F.expr(f"least(x.size, y.size) >= {t} * greatest(x.size, y.size) - 1e-6D and {equal} + 1 >= ({t} * {u} + {b}) / 2 - 5 * sqrt({variance})")


def _fingerprints(size: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests, keys, sketches, sizes, filled = [], [], [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                if len(words) < size:
                    continue
                hashes = shingle_hashes(words, size)
                sketch, n = sketch_of(hashes)
                ids.append(i), sketches.append(sketch), sizes.append(len(hashes)), filled.append(n), keys.append(anchors_of(min_hashes(hashes), RECORD_TABLES).view(np.int64))
                digests.append(blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest())
            flat = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
            offsets = np.arange(0, len(flat) + 1, RECORD_TABLES * _SYMBOLS, dtype=np.int32)
            places = np.array(sketches, dtype=np.int64).reshape(-1, len(_SKETCH))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(sizes, pa.int32()), pa.array(filled, pa.int32()), *(pa.array(np.ascontiguousarray(p)) for p in places.T)],
                names=["id", "digest", "keys", "size", "filled", *_SKETCH],
            )

    return rows


def similarity(a: set, b: set) -> float:
    common = len(a & b)
    return common / (len(a) + len(b) - common)


def _verify(size: int, threshold: float):
    def shingles(text: str) -> set:
        words = words_of(text)
        return set(zip(*[words[i:] for i in range(size)]))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, set()
        for batch in batches:
            x, y, s = [], [], []
            for r in batch.to_pylist():
                if r["x"] != last:
                    last, own = r["x"], shingles(r["x_text"])
                value = similarity(own, shingles(r["y_text"]))
                if value >= threshold:
                    x.append(r["x"]), y.append(r["y"]), s.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()), pa.array(y, pa.string()), pa.array(s, pa.float64())], names=["x", "y", "similarity"])

    return rows


def _meet(anchors: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """num_x, num_y of the fingerprints that meet at an anchor and whose sketches agree well enough.

    anchors: key, num; sketches: num, size, filled and the sketch. Keys are counted before anything else moves, by partial
    counts; most have one row and drop out. What pages of one site share makes pairs that meet grow with the square of
    its pages, so the sketches decide within the join, before a pair is written or a text moves.
    """
    counted = cut_lineage(anchors.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = anchors.join(_few(counted), "key")
    met = cut_lineage(met.join(sketches, "num").select("key", "num", "n", "size", "filled", *_SKETCH))
    near = (F.col("x.num") < F.col("y.num")) & may_be_near(threshold)
    left, right = salted(met, "n", "num")
    found = left.alias("x").join(right.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.salt") == F.col("y.salt")) & near)
    return found.select(F.col("x.num").alias("num_x"), F.col("y.num").alias("num_y")).distinct()


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def salted(rows: DataFrame, n: str, by: str) -> tuple[DataFrame, DataFrame]:
    """The two sides of a join of groups with themselves: a large group (n rows) is spread by a salt on one side and met by
    all salts on the other; a small one has the one salt 0."""
    salts = F.ceil(F.col(n) / F.lit(SALT_ROWS)).cast("int")
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), salts).cast("int")), rows.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))


def near_duplicates(records: DataFrame, id_col: str = "id", text_col: str = "raw_content", threshold: float = THRESHOLD, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """members (id, rep) and links (x, y, similarity) between representatives.

    Records of equal words in equal order are one class, whose representative is its least id; every pair of classes with
    a similarity of at least `threshold` that the anchors let meet is a link, x < y. Null texts and those of fewer words
    than a shingle are in no class; null ids don't count, a repeated row counts once; an empty table gives empty results.
    """
    texts = records.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    prints = cut_lineage(texts.mapInArrow(_fingerprints(shingle), "id string, digest binary, keys array<bigint>, size int, filled int, " + ", ".join(f"{s} bigint" for s in _SKETCH)))
    # Copies first, by digests alone: only they are left out of what follows, so that no fingerprint has to move for it.
    ids = prints.select("id", "digest").distinct()
    copied = cut_lineage(ids.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "rep"))
    members = cut_lineage(ids.join(_few(copied), "digest", "left").select("id", F.coalesce("rep", "id").alias("rep")))
    classes = prints.join(_few(members.where("id <> rep").select("id")), "id", "left_anti")

    num = F.xxhash64("id").alias("num")
    candidates = cut_lineage(_meet(classes.select(F.explode("keys").alias("key"), num), classes.select(num, "size", "filled", *_SKETCH), threshold))
    needed = candidates.select(F.col("num_x").alias("num")).union(candidates.select("num_y")).distinct()
    reps = cut_lineage(classes.select("id", F.xxhash64("id").alias("num")).join(needed, "num"))
    # Only the texts that a candidate needs go on; both sides of the pairs read them from one written copy.
    held = cut_lineage(texts.join(_few(reps), "id").dropDuplicates(["id"]).select("num", "id", "text"))
    side = [held.select(F.col("num").alias(f"num_{s}"), F.col("id").alias(s), F.col("text").alias(f"{s}_text")) for s in "xy"]
    pairs = candidates.join(side[0], "num_x").join(side[1], "num_y").select("x", "y", "x_text", "y_text")
    checked = cut_lineage(pairs.mapInArrow(_verify(shingle, threshold), "x string, y string, similarity double"))
    links = checked.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "similarity")
    return members, links


def all_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """id_a, id_b of every similar pair of records, smaller id first: links and classes expanded."""
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    left, right = salted(members.join(sizes, "rep"), "n", "id")
    within = left.alias("a").join(right.alias("b"), (F.col("a.rep") == F.col("b.rep")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
    of = [members.select(F.col("rep").alias(s), F.col("id").alias(f"{s}_id")) for s in "xy"]
    across = links.join(of[0], "x").join(of[1], "y").select(F.least("x_id", "y_id").alias("id_a"), F.greatest("x_id", "y_id").alias("id_b"))
    return within.unionByName(across)


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """rep, label of every linked representative: the least id of its connected component.

    Labels spread to neighbours and then jump to their label's label, so chains take a logarithmic number of rounds; each
    round is written, as the next reads it twice.
    """
    edges = cut_lineage(links.select("x", "y").union(links.select("y", "x")).toDF("a", "b").distinct())
    labels = cut_lineage(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "rep"))
    for _ in range(max_rounds):
        spread = edges.join(labels, F.col("b") == F.col("rep")).groupBy("a").agg(F.min("label").alias("near"))
        best = labels.join(spread, F.col("rep") == F.col("a")).select("rep", F.least("label", "near").alias("to"), F.col("label").alias("old"))
        jump = labels.select(F.col("rep").alias("to"), F.col("label").alias("far"))
        after = cut_lineage(best.join(jump, "to", "left").select("rep", F.least("to", F.coalesce("far", "to")).alias("label"), "old"))
        labels = after.select("rep", "label")
        if after.where("label <> old").isEmpty():
            return labels
    raise RuntimeError(f"components didn't settle in {max_rounds} rounds")


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """id, class_id, group_id, links: every record with words enough; group_id is the least representative it is linked to."""
    counted = links.select(F.explode(F.array("x", "y")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    return members.join(components(links), "rep", "left").join(counted, "rep", "left").select("id", F.col("rep").alias("class_id"), F.coalesce("label", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
