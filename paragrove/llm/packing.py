"""Filling fixed-capacity containers with items, by bulk-synchronous best fit.

Items are spread over shards of bounded size, which work at the same time. In a shard, items and gaps are range-sorted as
runs: items of equal size, and containers of equal gap with consecutive numbers. In each round a successor sweep over both
sorted sides matches every gap with the largest item that fits, conflicts are resolved by rank (the j-th gap from the top
takes the j-th best item at most), gaps are updated and the next round begins; where no gap takes an item, containers are
opened for the largest items. What would only fill a shard's last few containers is left for the next superstep, in which an
eighth of the shards go on, down to one. So every superstep is one shuffle of (number, size), the first over all items, later
ones over a small part of them, and nothing is planned on the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paragrove.llm.tokens import n_tokens
from paragrove.runtime import Shelf, broadcast_if_small

SHARD_ROWS = 16_384  # items of a shard, on average
TAIL = 16            # containers' worth of items that a shard leaves to the next superstep, at most
FEWER = 8            # times fewer shards in every superstep


def sweep(gaps: np.ndarray, gap_n: np.ndarray, sizes: np.ndarray, size_n: np.ndarray):
    """Match gaps with items, one each, from the largest gap down: (gap run, item run, count).

    gaps ascending with their counts, sizes ascending with their counts. Every gap gets the largest item that fits and is
    not taken by a larger gap.
    """
    left, out = size_n.copy(), []
    at = len(sizes) - 1
    for g in range(len(gaps) - 1, -1, -1):
        want = int(gap_n[g])
        at = min(at, int(np.searchsorted(sizes, gaps[g], side="right")) - 1)
        while want and at >= 0:
            if not left[at]:
                at -= 1
                continue
            take = min(want, int(left[at]))
            out.append((g, at, take))
            left[at] -= take
            want -= take
        if at < 0:
            break
    return out


def plan(counts: dict[int, int], capacity: int, tail: int = 0) -> tuple[np.ndarray, int]:
    """Placements (size, first rank, count, first container) of items of 1..capacity units, and the number of containers.

    Rounds go on until no item is left, or at the opening of containers for less than `tail` units; those items stay unplaced.
    """
    sizes = np.array(sorted(s for s, n in counts.items() if n and 0 < s <= capacity), dtype=np.int64)
    left = np.array([counts[int(s)] for s in sizes], dtype=np.int64)
    rank = np.zeros(len(sizes), np.int64)
    runs: list[tuple[int, int, int]] = []  # gap, first container, count
    placed, opened = [], 0
    while left.sum():
        runs.sort()
        found = sweep(np.array([r[0] for r in runs], np.int64), np.array([r[2] for r in runs], np.int64), sizes, left) if runs else []
        if not found:
            # open containers for the largest items: as many as their half could fill, and all that need one of their own
            total = int((sizes * left).sum())
            if total < tail:
                break
            alone = int(left[sizes > capacity // 2].sum())
            want = max(alone, -(-total // (2 * capacity)), 1)
            runs = []
            for at in range(len(sizes) - 1, -1, -1):
                take = min(want, int(left[at]))
                if take:
                    placed.append((int(sizes[at]), int(rank[at]), take, opened))
                    runs.append((capacity - int(sizes[at]), opened, take))
                    rank[at] += take
                    left[at] -= take
                    opened += take
                    want -= take
                if not want:
                    break
            runs = [r for r in runs if r[0] > 0]
            continue
        used: dict[int, int] = {}
        fresh = []
        for g, at, take in found:
            gap, first, _ = runs[g]
            start = first + used.get(g, 0)
            used[g] = used.get(g, 0) + take
            placed.append((int(sizes[at]), int(rank[at]), take, start))
            rank[at] += take
            left[at] -= take
            if gap > sizes[at]:
                fresh.append((gap - int(sizes[at]), start, take))
        least = int(sizes[left > 0].min()) if left.sum() else capacity + 1
        # gaps below the smallest item left are closed
        runs = [r for r in fresh + [(gap, first + used.get(g, 0), n - used.get(g, 0)) for g, (gap, first, n) in enumerate(runs)] if r[2] and r[0] >= least]
    return np.array(sorted(placed), dtype=np.int64).reshape(-1, 4), opened


def place(rest: np.ndarray, full: np.ndarray, capacity: int, tail: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Container of the rest (-1: left over) and first container of the full pieces of every item of a shard, and how many containers it uses."""
    some = rest > 0
    size, n = np.unique(rest[some], return_counts=True)
    placed, opened = plan(dict(zip(size.tolist(), n.tolist())), capacity, tail)
    spot = np.full(len(rest), -1, np.int64)
    order = np.flatnonzero(some)[np.argsort(rest[some], kind="stable")]
    if len(order) and len(placed):
        sizes = rest[order]
        rank = np.arange(len(order)) - np.searchsorted(sizes, sizes, side="left")
        span = len(rest) + 1
        i = np.searchsorted(placed[:, 0] * span + placed[:, 1], sizes * span + rank, side="right") - 1
        run = placed[np.maximum(i, 0)]
        inside = (i >= 0) & (run[:, 0] == sizes) & (rank < run[:, 1] + run[:, 2])
        spot[order] = np.where(inside, run[:, 3] + rank - run[:, 1], -1)
    return spot, opened + np.cumsum(full) - full, opened + int(full.sum())


def superstep(items: DataFrame, shards: int, capacity: int) -> DataFrame:
    """uid, shard, spot (null: left over, or no size), full_at, used (containers of the shard) of all items: uid, full, rest."""
    tail = TAIL * capacity if shards > 1 else 0

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("uid")
        spot, full_at, used = place(np.asarray(t["rest"]), np.asarray(t["full"]), capacity, tail)
        return pa.table({"uid": t["uid"], "shard": t["shard"], "full": t["full"], "rest": t["rest"], "spot": pa.array(spot, mask=spot < 0), "full_at": pa.array(full_at), "used": pa.array(np.full(len(spot), used, np.int64))})

    keyed = items.select("uid", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int").alias("shard"), "full", "rest")
    return keyed.groupBy("shard").applyInArrow(run, "uid bigint, shard int, full bigint, rest bigint, spot bigint, full_at bigint, used bigint")


def pack(items: DataFrame, capacity: int = 1_024, key: str = "doc_id", size: str = "n_tokens", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """key, n_tokens, piece_no, piece_tokens, container: every item in a container of the given capacity.

    An item within the capacity is one whole piece. A larger one is cut into full pieces, each alone in a container, and a
    rest, which is packed like an item. Items of null or no size take no space and come out with a null container. Repeated
    keys are items of their own. An empty table gives an empty result. shard_rows: items that one task packs, about.
    """
    shelf = Shelf(items.sparkSession)
    src = items.select(F.col(key).alias("key"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("size"))
    full = F.when(F.col("size") > capacity, F.expr(f"size div {capacity}")).otherwise(F.lit(0)).cast("bigint")
    src = shelf.keep(src.select("key", "size", full.alias("full"), F.monotonically_increasing_id().alias("uid")), "sized").withColumn("rest", F.col("size") - F.col("full") * capacity)
    todo, done, base, step = src.where("size > 0").select("uid", "full", "rest"), None, 0, 0
    shards = max(1, -(-src.count() // shard_rows))
    while True:
        got = shelf.keep(superstep(todo, shards, capacity), f"step-{step}")
        used = shelf.keep(got.groupBy("shard").agg(F.max("used").alias("used")), f"used-{step}")  # one row per shard
        first = used.select("shard", (F.coalesce(F.sum("used").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + base).alias("base"))
        at = got.join(broadcast_if_small(first), "shard").select("uid", "rest", (F.col("base") + F.col("spot")).alias("spot"), F.when(F.lit(step == 0), F.col("base") + F.col("full_at")).alias("full_at"))
        at = at.where("spot IS NOT NULL OR full_at IS NOT NULL")
        done = at if done is None else done.unionByName(at)
        if shards == 1:
            break
        base += used.agg(F.sum("used")).head()[0] or 0
        todo = got.where("spot IS NULL AND rest > 0").select("uid", F.lit(0).cast("bigint").alias("full"), "rest")
        shards, step = max(1, shards // FEWER), step + 1
    where = done.groupBy("uid").agg(F.max("spot").alias("spot"), F.max("full_at").alias("full_at"))
    spots = src.join(where, "uid", "left")
    pieces = F.when((F.col("full") > 0) & (F.col("rest") == 0), F.col("full") - 1).otherwise(F.col("full"))
    rows = spots.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), pieces)).alias("piece_no"))
    whole_piece = F.col("piece_no") < F.col("full")
    return rows.select(F.col("key").alias(key), F.col("size").alias("n_tokens"), F.col("piece_no").cast("int").alias("piece_no"),
                       F.when(whole_piece, F.lit(capacity)).otherwise(F.col("rest")).cast("bigint").alias("piece_tokens"),
                       F.when(whole_piece, F.col("full_at") + F.col("piece_no")).otherwise(F.col("spot")).alias("container"))


def pack_documents(documents: DataFrame, capacity: int = 1_024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """pack() over the token counts of documents; a null text has no tokens."""
    return pack(documents.select(F.col(key).alias("doc_id"), n_tokens(F.col(text)).alias("n_tokens")), capacity)
