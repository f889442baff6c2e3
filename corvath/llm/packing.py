"""Filling containers of fixed capacity: best-fit decreasing per group of items, certified by lower bounds.

Items are spread over groups of bounded size. Every group is packed by best-fit decreasing, and a lower bound from dual
feasible functions certifies how many bins it needs at least. Groups whose bins exceed their bound, or that leave a
bin's worth of room because large items prevail in them, exchange their items: those of all such groups meet in fewer, newly mixed, larger groups and are packed again. A round that doesn't need fewer bins than the ones it took apart isn't kept.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvath.session import cut_lineage

#: Items of one group of the first round, on average; a later round's groups are GROWTH times as large as those before.
#: A group is one task's work in memory: at most 320,000 items of some 100 bytes.
GROUP_ITEMS = 20_000
GROWTH = 4
ROUNDS = 3
MAX_LIMITS = 100


def lower_bound(sizes: np.ndarray, capacity: int, items: np.ndarray | None = None) -> int:
    """The bins that these sizes need at least: the largest bound of two families of dual feasible functions.

    items: how often each size comes, where the sizes are those of a histogram.

    One family drops sizes below e and counts sizes above capacity - e as whole bins, for each e up to half the capacity;
    the other rounds (k + 1) x / capacity down, for small k.
    """
    if not len(sizes):
        return 0
    count = np.zeros(capacity + 1, dtype=np.int64)
    np.add.at(count, np.asarray(sizes, dtype=np.int64), 1 if items is None else np.asarray(items, dtype=np.int64))
    number, volume = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    best = math.ceil(volume[-1] / capacity)
    e = np.arange(1, capacity // 2 + 1)
    if len(e):
        whole = number[-1] - number[capacity - e]
        middle = volume[capacity - e] - volume[e - 1]
        best = max(best, int(np.max(whole + -(-middle // capacity))))
    x = np.flatnonzero(count)
    for k in range(1, 9):
        scaled = (k + 1) * x
        exact = scaled % capacity == 0
        # in units of 1 / (k * capacity), to stay with integers
        units = np.where(exact, x * k, (scaled // capacity) * capacity)
        best = max(best, -(-int(np.sum(units * count[x])) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of every item, and every bin's fill. Ties go by the items' order."""
    order = np.argsort(-sizes, kind="stable")
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r is set where some bin has r units of room
    bins, fill = np.empty(len(sizes), dtype=np.int64), []
    for i in order:
        s = int(sizes[i])
        fitting = open_rooms >> s
        if fitting:
            r = s + (fitting & -fitting).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms ^= 1 << r
        else:
            r, b = capacity, len(fill)
            fill.append(0)
        fill[b] += s
        bins[i] = b
        if r > s:
            room[r - s].append(b)
            open_rooms |= 1 << (r - s)
    return bins, np.asarray(fill, dtype=np.int64)


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "piece_no"], kind="stable", na_position="first").reset_index(drop=True)
    capacity, sizes = int(pdf["capacity"].iloc[0]), pdf["n_tokens"].to_numpy()
    bins, fill = best_fit_decreasing(sizes, capacity)
    return pdf.assign(bin=bins, bin_fill=fill[bins], gap=max(len(fill) - lower_bound(sizes, capacity), (len(fill) * capacity - int(sizes.sum())) // capacity))


_PACKED = "limit_name string, capacity int, doc_id {id}, piece_no int, token_start bigint, n_tokens bigint, round int, grp bigint, bin bigint, bin_fill bigint, gap bigint"


def _round(items: DataFrame, number: int, group_items: int) -> DataFrame:
    """Pack items (limit_name, capacity, doc_id, piece_no, token_start, n_tokens) in groups of about group_items."""
    id_type = items.schema["doc_id"].dataType.simpleString()
    groups = items.groupBy("limit_name").agg(F.ceil(F.count(F.lit(1)) / F.lit(group_items)).alias("n_groups"))
    placed = items.join(F.broadcast(groups), "limit_name").select(
        "limit_name", "capacity", "doc_id", "piece_no", "token_start", "n_tokens",
        F.lit(number).alias("round"),
        F.pmod(F.xxhash64(F.lit(number), "doc_id", "piece_no"), F.col("n_groups")).alias("grp"),
    )
    return placed.groupBy("limit_name", "grp").applyInPandas(_pack, _PACKED.format(id=id_type))


def pack(sizes: DataFrame, limits: DataFrame, group_items: int = GROUP_ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """limit_name, container_id, doc_id, piece_no, token_start, n_tokens, container_fill.

    sizes: doc_id, n_tokens; limits: limit_name, max_size (a configuration table: one row per limit, refused beyond MAX_LIMITS).
    Items of size 0 or null aren't placed. An item larger than the capacity is cut into full containers and a rest, and
    only such items are cut. Repeated rows of one doc_id and size count once. An empty table gives an empty result.
    """
    rows = limits.where("max_size > 0").select("limit_name", F.col("max_size").cast("int").alias("capacity")).distinct().limit(MAX_LIMITS + 1).collect()
    if not 0 < len(rows) <= MAX_LIMITS:
        raise ValueError(f"there must be 1 to {MAX_LIMITS} limits")
    each_limit = F.array(*[F.struct(F.lit(r.limit_name).alias("limit_name"), F.lit(r.capacity).alias("capacity")) for r in sorted(rows)])
    items = (
        sizes.where("n_tokens > 0").select("doc_id", F.col("n_tokens").cast("bigint").alias("whole")).distinct()
        .select("doc_id", "whole", F.explode(each_limit).alias("l")).select("l.limit_name", "l.capacity", "doc_id", "whole")
        .select("limit_name", "capacity", "doc_id", "whole", F.explode(F.sequence(F.lit(0), F.ceil(F.col("whole") / F.col("capacity")).cast("int") - 1)).alias("piece_no"))
        .select("limit_name", "capacity", "doc_id", "piece_no",
                (F.col("piece_no").cast("bigint") * F.col("capacity")).alias("token_start"),
                F.least(F.col("capacity").cast("bigint"), F.col("whole") - F.col("piece_no").cast("bigint") * F.col("capacity")).alias("n_tokens"))
    )
    packed = cut_lineage(_round(items, 0, group_items))
    for number in range(1, rounds):
        free = F.col("gap") > 0
        released = packed.where(free)
        if released.isEmpty():
            break
        keys = ["limit_name", "round", "grp", "bin"]
        before = released.select(*keys).distinct().groupBy("limit_name").agg(F.count(F.lit(1)).alias("old_bins"))
        again = cut_lineage(_round(released.select("limit_name", "capacity", "doc_id", "piece_no", "token_start", "n_tokens"), number, group_items * GROWTH**number))
        after = again.select(*keys).distinct().groupBy("limit_name").agg(F.count(F.lit(1)).alias("new_bins"))
        # one row per limit on the driver
        better = [r["limit_name"] for r in before.join(after, "limit_name").collect() if r["new_bins"] < r["old_bins"]]
        improved = F.col("limit_name").isin(better)
        packed = packed.where(~(free & improved)).unionByName(again.where(improved))
    return packed.select(
        "limit_name", F.concat_ws("-", "limit_name", "round", "grp", "bin").alias("container_id"),
        "doc_id", "piece_no", "token_start", "n_tokens", F.col("bin_fill").alias("container_fill"),
    )


def certificate(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """limit_name, capacity, items, containers, lower_bound, fill: the bins used against the bound over all items.

    The bound needs only the histogram of sizes, at most `capacity` rows per limit.
    """
    histogram = packed.groupBy("limit_name", "n_tokens").agg(F.count(F.lit(1)).alias("items"))
    capacity = limits.select("limit_name", F.col("max_size").cast("int").alias("capacity")).distinct()

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes, items = pdf["n_tokens"].to_numpy(), pdf["items"].to_numpy()
        c = int(pdf["capacity"].iloc[0])
        return pd.DataFrame({"limit_name": pdf["limit_name"].iloc[:1], "capacity": c, "items": int(items.sum()), "volume": int((sizes * items).sum()), "lower_bound": lower_bound(sizes, c, items)})

    bounds = histogram.join(F.broadcast(capacity), "limit_name").groupBy("limit_name").applyInPandas(bound, "limit_name string, capacity int, items bigint, volume bigint, lower_bound bigint")
    used = packed.select("limit_name", "container_id").distinct().groupBy("limit_name").agg(F.count(F.lit(1)).alias("containers"))
    return bounds.join(used, "limit_name").select(
        "limit_name", "capacity", "items", "containers", "lower_bound", F.round(F.col("volume") / (F.col("containers") * F.col("capacity")), 6).alias("fill")
    )
