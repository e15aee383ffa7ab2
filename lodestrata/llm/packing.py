"""Filling fixed-capacity containers with items.

Method: the histogram of item sizes (never the items) comes to the driver: it has at most as many
rows as the capacity has units. Shallow combinations that fill a window below the capacity are
enumerated: up to three items of any sizes, and up to four of one size with as many of a second as
fit; non-negative least squares solves how often each is used so that the
histogram is met; counts are rounded within what is left, and the residual sizes are packed greedily,
largest first, pattern by pattern. Where many sizes are small the solution spends items that the
greedy rest needs as fillers, so some shares of the solved counts are tried and the plan with the
fewest containers is taken. The plan is a list of patterns with repeat counts, bounded by the
capacity whatever the number of items. Items are ranked within their size by distributed counting
and look their container up in the plan.

Defined results: items of null or non-positive size are left out; an item above the capacity is
split into full pieces and a remainder, no other is; equal sizes are told apart by the id; repeated
ids are kept as items of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.session import checkpoint

MAX_CAPACITY = 1 << 17  # bound of the histogram that comes to the driver


@dataclass
class Plan:
    """Ranges of ranks within a size: from ``rank`` on, ``each`` items of the size go into each container from ``base`` on."""

    size: np.ndarray
    rank: np.ndarray
    each: np.ndarray
    base: np.ndarray
    containers: int

    def container(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Container of the item with this 0-based rank within its size."""
        key = self.size.astype(np.uint64) << np.uint64(44) | self.rank.astype(np.uint64)
        at = np.searchsorted(key, size.astype(np.uint64) << np.uint64(44) | rank.astype(np.uint64), side="right") - 1
        return self.base[at] + (rank - self.rank[at]) // self.each[at]


Combination = tuple[tuple[int, int], ...]  # (size, count), larger sizes first


def combinations(histogram: np.ndarray, window: int, per_size: int = 10, repeats: int = 4) -> list[Combination]:
    """Combinations whose sum lies within window below the capacity, from sizes that occur, larger sizes first."""
    capacity = len(histogram) - 1
    present = np.flatnonzero(histogram)
    if not len(present):
        return []
    rows: set[Combination] = set()
    low = max(0, capacity - window)

    def add(*sizes: int) -> None:
        rows.add(tuple((s, sizes.count(s)) for s in dict.fromkeys(sizes)))

    for a in present[::-1].tolist():
        if a >= low:
            add(a)
        i, j = np.searchsorted(present, [low - a, capacity - a + 1])
        seconds = present[max(i, 0) : j]
        for b in seconds[seconds <= a][-per_size:].tolist():
            add(a, b)
        rest = capacity - a
        middles = present[(present <= min(a, rest)) & (present * 2 >= low - a)]
        if len(middles):
            for b in middles[np.unique(np.linspace(0, len(middles) - 1, per_size).astype(int))].tolist():
                k = np.searchsorted(present, rest - b, side="right") - 1
                if k >= 0 and low <= a + b + present[k] and present[k] <= b:
                    add(a, b, int(present[k]))
        for m in range(2, min(repeats, capacity // a) + 1):
            rest = capacity - m * a
            if m * a >= low:
                rows.add(((a, m),))
            smaller = present[present < a]
            counts = rest // np.maximum(smaller, 1)
            fits = np.flatnonzero((counts > 0) & (m * a + counts * smaller >= low))
            for k in fits[-per_size:].tolist():
                rows.add(((a, m), (int(smaller[k]), int(counts[k]))))
    return sorted(rows, reverse=True)


def solve_repeats(combos: list[Combination], histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares: repeats x >= 0 that minimise |A x - histogram|, by accelerated projected gradients; A is kept sparse."""
    if not combos:
        return np.zeros(0)
    n = len(histogram)
    rows, counts = np.array([x for c in combos for x in c], np.int64).T
    cols = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    target = histogram.astype(float)
    apply = lambda x: np.bincount(rows, counts * x[cols], n)
    back = lambda r: np.bincount(cols, counts * r[rows], len(combos))
    v = np.ones(len(combos))
    for _ in range(30):  # largest eigenvalue
        w = back(apply(v))
        scale = np.linalg.norm(w)
        v = w / scale
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(apply(y) - target) / (1.01 * scale))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def _greedy(left: np.ndarray) -> Iterator[tuple[dict[int, int], int]]:
    """(pattern, repeats): the largest size left, then again and again the largest that fits; a pattern is repeated until one of its sizes runs out."""
    capacity = len(left) - 1
    below = np.zeros(capacity + 1, np.int64)  # candidates for the largest size with items left at or below each size

    def largest(limit: int) -> int:
        path = []
        while limit > 0 and not left[limit]:
            path.append(limit)
            limit = int(below[limit]) if below[limit] else limit - 1
        for p in path:
            below[p] = limit if limit > 0 else 0
        return limit

    while (top := largest(capacity)) > 0:
        pattern: dict[int, int] = {}
        gap = capacity
        while gap > 0 and (s := largest(min(gap, top))) > 0:
            while s > 0 and left[s] <= pattern.get(s, 0):  # all of it is in this pattern
                s = largest(s - 1)
            if s <= 0:
                break
            fit = min(gap // s, int(left[s]) - pattern.get(s, 0))
            pattern[s] = pattern.get(s, 0) + fit
            gap -= fit * s
        times = min(int(left[s]) // k for s, k in pattern.items())
        for s, k in pattern.items():
            left[s] -= times * k
        yield pattern, times


SHARES = (1.0, 0.5, 0.25, 0.0)  # of the solved repeats


def _patterns(histogram: np.ndarray, combos: list[Combination], x: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """(pattern, repeats): the rounded repeats of the combinations, then the greedy rest."""
    left, patterns = histogram.copy(), []
    for j in np.argsort(-x, kind="stable"):
        times = int(round(x[j]))
        if times < 1:
            break
        sizes, counts = np.array(combos[j], np.int64).T
        times = min(times, int((left[sizes] // counts).min()))
        if times > 0:
            left[sizes] -= times * counts
            patterns.append((dict(zip(sizes.tolist(), counts.tolist(), strict=True)), times))
    return [*patterns, *_greedy(left)]


def make_plan(histogram: np.ndarray, window: int | None = None, shares: tuple[float, ...] = SHARES) -> Plan:
    """histogram[s]: number of items of size s, up to the capacity."""
    capacity = len(histogram) - 1
    window = max(1, capacity // 512) if window is None else window
    whole = histogram.astype(np.int64).copy()
    whole[0] = 0
    combos = combinations(whole, window)
    x = solve_repeats(combos, whole)
    patterns = min((_patterns(whole, combos, s * x) for s in shares), key=lambda ps: sum(t for _, t in ps))
    used = np.zeros(capacity + 1, np.int64)
    ranges, base = [], 0
    for pattern, times in patterns:
        for s, k in pattern.items():
            ranges.append((s, int(used[s]), k, base))
            used[s] += times * k
        base += times
    table = np.array(sorted(ranges), np.int64).reshape(-1, 4)
    return Plan(*table.T, containers=base)


def pack(items: DataFrame, item_id: str, size: str, capacity: int, salts: int | None = None) -> DataFrame:
    """(item_id, piece_no, piece_size, container_id) of every piece of every item."""
    if not 1 <= capacity <= MAX_CAPACITY:
        raise ValueError(f"capacity must lie between 1 and {MAX_CAPACITY}")
    whole = items.select(F.col(item_id), F.col(size).cast("bigint").alias("_n")).where("_n > 0")
    full = F.floor((F.col("_n") - 1) / F.lit(capacity)).cast("bigint")
    pieces = whole.select(item_id, "_n", F.posexplode(F.sequence(F.lit(0).cast("bigint"), full)).alias("piece_no", "_k"))
    pieces = pieces.select(item_id, "piece_no", F.least(F.lit(capacity).cast("bigint"), F.col("_n") - F.col("_k") * capacity).alias("piece_size"))
    salts = salts or max(8, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # the salt splits a size that very many items share; ranks run on from salt to salt
    pieces = checkpoint(pieces.withColumn("_salt", F.pmod(F.xxhash64(item_id, "piece_no"), F.lit(salts))))
    counts = pieces.groupBy("piece_size", "_salt").agg(F.count(F.lit(1)).alias("_count"))
    before = W.partitionBy("piece_size").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = checkpoint(counts.withColumn("_offset", F.coalesce(F.sum("_count").over(before), F.lit(0))))
    histogram = np.zeros(capacity + 1, np.int64)
    for s, n in offsets.groupBy("piece_size").agg(F.sum("_count")).collect():  # at most capacity rows
        histogram[s] = n
    plan = items.sparkSession.sparkContext.broadcast(make_plan(histogram))

    @F.pandas_udf("bigint")
    def container(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for s, r in batches:
            yield pd.Series(plan.value.container(s.to_numpy(np.int64), r.to_numpy(np.int64)))

    within = W.partitionBy("piece_size", "_salt").orderBy(item_id, "piece_no")
    ranked = pieces.withColumn("_within", F.row_number().over(within) - 1).join(offsets.select("piece_size", "_salt", "_offset"), ["piece_size", "_salt"])
    return ranked.select(item_id, "piece_no", "piece_size", container(F.col("piece_size"), F.col("_within") + F.col("_offset")).alias("container_id"))
