"""Mixing sources to target weights, by subset-sum budget fitting.

Documents are counted by exact token length. A source's budget is filled with whole passes over its documents; what is left
of it is filled with an even part of every length, and the last tokens by a bounded-knapsack dynamic programme over the
lengths still available, whose window is widened until the budget is met or the sum is the largest possible. The counts so chosen per length select documents by a seeded hash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paragrove.llm.tokens import n_tokens
from paragrove.runtime import Shelf

SALT_ROWS = 250_000        # documents of one length and salt that are ranked in one task, about
WINDOW = 16_384            # budget that the dynamic programme fits first, in tokens
MOST_WINDOW = 2_097_152    # budget up to which it is widened, in units of the lengths' common divisor


def normal_source(c: Column) -> Column:
    """A source name without case and outer blanks; blank is null."""
    return F.nullif(F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")), F.lit(""))


def knapsack(lengths: list[int], free: list[int], budget: int) -> list[int]:
    """How many of each length to take, at most free of each, for the largest sum within the budget (bounded subset sum).

    Numbers of equal lengths are split into powers of two; the sums reached are a bit set, and every sum keeps the part that
    reached it first, so the work space is one number per unit of budget.
    """
    unit = math.gcd(*lengths) if lengths else 1
    budget //= max(1, unit)
    reach, mask, parts = 1, (1 << (budget + 1)) - 1, []
    by = np.full(budget + 1, -1, np.int32)
    for i, (length, n) in enumerate(zip(lengths, free)):
        length //= unit
        left, step = min(n, budget // length if length else 0), 1
        while left > 0:
            take = min(step, left)
            new = (reach << (length * take)) & mask
            new ^= new & reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes((budget >> 3) + 1, "little"), np.uint8), bitorder="little")
                by[np.flatnonzero(bits)] = len(parts)
                reach |= new
            parts.append((i, take, length * take))
            left -= take
            step *= 2
        if reach >> budget & 1:
            break
    total, used = reach.bit_length() - 1, [0] * len(lengths)
    while total:
        i, take, weight = parts[by[total]]
        used[i] += take
        total -= weight
    return used


def prefilled(lengths: np.ndarray, counts: np.ndarray, budget: int, keep: int) -> np.ndarray:
    """An even part of every length, then the longest, so that at least `keep` of the budget (and little more, where lengths allow) stays free."""
    total = int((lengths * counts).sum())
    if budget <= keep:
        return np.zeros(len(lengths), np.int64)
    extra = np.array([int(c) * (budget - keep) // total for c in counts], np.int64) * (lengths > 0)
    left = budget - keep - int((extra * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if 0 < lengths[i] <= left:
            take = min(int(counts[i] - extra[i]), left // int(lengths[i]))
            extra[i] += take
            left -= take * int(lengths[i])
    return extra


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, max_repeats: int) -> tuple[int, np.ndarray]:
    """Whole passes over all documents, and how many documents of each length to take once more.

    The programme fits the last WINDOW tokens; where it cannot fill them, the window is widened, up to the whole budget (then
    the sum is the largest possible) or MOST_WINDOW.
    """
    total, none = int((lengths * counts).sum()), np.zeros(len(lengths), np.int64)
    if not total or budget <= 0 or max_repeats <= 0:
        return 0, none
    passes = min(max_repeats, budget // total)
    if passes == max_repeats:
        return passes, none
    want, window, best = budget - passes * total, WINDOW, None
    unit = math.gcd(*[int(x) for x in lengths if x > 0])
    while True:
        extra = prefilled(lengths, counts, want, window)
        left = want - int((extra * lengths).sum())
        open_ = [i for i in np.argsort(lengths, kind="stable") if 0 < lengths[i] <= left and counts[i] > extra[i]]
        for i, m in zip(open_, knapsack([int(lengths[i]) for i in open_], [int(counts[i] - extra[i]) for i in open_], left)):
            extra[i] += m
            left -= m * int(lengths[i])
        if best is None or left < best[0]:
            best = (left, extra)
        if left < unit or window >= want or window >= MOST_WINDOW * unit:
            return passes, best[1]
        window *= 8


def budgets(shares: list[float], capacity: list[int], total: int) -> list[int]:
    """Tokens per source: the target share of the total, at most what the source can give; what short sources cannot give goes to the others by share."""
    got, open_, left = [0] * len(shares), set(range(len(shares))), float(total)
    while open_:
        weight = sum(shares[i] for i in open_)
        if weight <= 0:
            break
        short = [i for i in open_ if capacity[i] < left * shares[i] / weight]
        if not short:
            for i in open_:
                got[i] = round(left * shares[i] / weight)
            break
        for i in short:
            got[i] = capacity[i]
            left -= capacity[i]
            open_.discard(i)
    return got


class Mix:
    """The plan and the selection of one mix of documents.

    Documents of null, blank or unlisted source and of no tokens are not selected; those with a source count in the total that decides
    which targets are short; the selection is as large in tokens as all documents.
    targets: source, target_share, max_repeats; one row per source to be mixed, so their number bounds the plan. An empty
    table of documents or targets selects nothing.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 11):
        self.spark, self.seed = documents.sparkSession, seed
        self.shelf = Shelf(self.spark)
        every = self.shelf.keep(documents.select(F.col(key).alias("doc_id"), normal_source(F.col(source)).alias("src"), n_tokens(F.col(text)).alias("n_tokens")), "sized")
        self.sized = every.where("src IS NOT NULL")
        goal = targets.select("source", normal_source(F.col("source")).alias("src"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).cast("int").alias("max_repeats")).where("src IS NOT NULL").dropDuplicates(["src"])
        per = self.sized.groupBy("src").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
        sums = every.agg(F.sum("n_tokens"), F.sum(F.when(F.col("src").isNotNull(), F.col("n_tokens"))), F.count("*")).head()
        self.size, self.total, self.rows = sums[0] or 0, sums[1] or 0, sums[2]
        self.goal = goal.join(per, "src", "left").fillna(0, ["tokens", "docs"]).withColumn("capacity", F.col("tokens") * F.col("max_repeats")).withColumn("wanted", F.col("target_share") * F.lit(float(self.total)))

    def plan(self) -> DataFrame:
        """source, tokens, capacity, target_share, wanted of every target."""
        return self.goal.select("source", "src", "tokens", "docs", "max_repeats", "capacity", "target_share", "wanted")

    def selection(self) -> DataFrame:
        """doc_id, source, n_tokens, copies of every selected document."""
        rows = self.goal.orderBy("src").collect()  # one row per target
        budget = budgets([r.target_share for r in rows], [r.capacity for r in rows], self.size)
        limit = self.spark.createDataFrame([(r.src, r.source, b, r.max_repeats) for r, b in zip(rows, budget)] or [("", "", 0, 0)], "src string, source string, budget bigint, max_repeats int")
        salts = max(32, self.rows // SALT_ROWS)
        docs = self.sized.join(F.broadcast(limit), "src").withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(self.seed)), F.lit(salts)).cast("int"))
        cells = docs.groupBy("src", "n_tokens", "salt", "budget", "max_repeats").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("src", "n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cells = cells.withColumn("before", before)

        def choose(pdf: pd.DataFrame) -> pd.DataFrame:
            by = pdf.sort_values("n_tokens")
            passes, extra = fit_budget(by.n_tokens.to_numpy(), by.n.to_numpy(), int(by.budget.iloc[0]), int(by.max_repeats.iloc[0]))
            return pd.DataFrame({"src": by.src, "n_tokens": by.n_tokens, "passes": passes, "extra": extra})

        # one row per source and length
        chosen = cells.groupBy("src", "n_tokens", "budget", "max_repeats").agg(F.sum("n").alias("n")).groupBy("src").applyInPandas(choose, "src string, n_tokens bigint, passes bigint, extra bigint")
        take = cells.join(chosen, ["src", "n_tokens"]).select("src", "n_tokens", "salt", "passes", F.greatest(F.lit(0), F.least("n", F.col("extra") - F.col("before"))).alias("take"))
        w = Window.partitionBy("src", "n_tokens", "salt").orderBy(F.xxhash64("doc_id", F.lit(self.seed + 1)), "doc_id")
        picked = docs.withColumn("rank", F.row_number().over(w)).join(take, ["src", "n_tokens", "salt"])
        copies = F.col("passes") + (F.col("rank") <= F.col("take")).cast("bigint")
        return picked.select("doc_id", "source", "n_tokens", copies.alias("copies")).where("copies > 0")

    def report(self) -> DataFrame:
        """source, target_share, actual_share, selected_tokens, selected_docs, most_copies, short for every target.

        short: the selection took all the source may give and still holds less than the target's part.
        """
        got = self.selection().groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("selected_tokens"), F.count("*").alias("selected_docs"), F.max("copies").alias("most_copies"))
        got = self.shelf.keep(got, "got")
        all_ = got.agg(F.sum("selected_tokens").alias("all_tokens"))
        short = (F.col("selected_tokens") >= F.col("capacity")) & (F.col("selected_tokens") < F.col("wanted"))
        return self.plan().join(got, "source", "left").join(F.broadcast(all_)).fillna(0, ["selected_tokens", "selected_docs", "most_copies"]).select(  # one row of sums
            "source", "target_share", F.round(F.col("selected_tokens") / F.col("all_tokens"), 6).alias("actual_share"), "selected_tokens", "selected_docs", "most_copies", short.alias("short"))
