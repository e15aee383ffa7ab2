"""Joins and lookups that hold when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hot_keys(rows: DataFrame, keys: list[str], hot_share: float = 0.01, min_hot: int = 50_000, total: int | None = None) -> list[tuple]:
    """The keys that own at least hot_share of the rows, and min_hot rows: at most 1 / hot_share of them, whatever the data size. Null keys never count."""
    total = rows.count() if total is None else total
    if total < min_hot:
        return []
    present = rows.select(*keys).dropna("any")
    found = present.groupBy(*keys).count().where(F.col("count") >= max(min_hot, hot_share * total))
    return [tuple(r)[:-1] for r in found.collect()]


def _among(keys: list[str], hot: list[tuple]) -> Column:
    if len(keys) == 1:
        return F.coalesce(F.col(keys[0]).isin([k[0] for k in hot]), F.lit(False))
    hit = F.lit(False)
    for k in hot:
        same = F.lit(True)
        for c, value in zip(keys, k, strict=True):
            same = same & (F.col(c) == F.lit(value))
        hit = hit | same
    return F.coalesce(hit, F.lit(False))


def skew_safe_lookup(rows: DataFrame, mapping: DataFrame, key: str, hot_share: float = 0.01, min_hot: int = 50_000, hot: list[tuple] | None = None) -> DataFrame:
    """rows left join mapping on key, where mapping has one row per key.

    Hot keys (see `hot_keys`; given as hot where the caller knows them) are joined by broadcast. All
    other keys go through an ordinary shuffle join. Null keys find nothing and are kept.
    An empty input gives an empty result. Columns other than ``key`` must not clash.
    """
    hot = hot_keys(rows, [key], hot_share, min_hot) if hot is None else hot
    if not hot:
        return rows.join(mapping, key, "left")
    is_hot = _among([key], hot)
    few = F.broadcast(mapping.where(is_hot))
    return rows.where(is_hot).join(few, key, "left").unionByName(rows.where(~is_hot).join(mapping, key, "left"))


def skew_safe_join(rows: DataFrame, other: DataFrame, keys: list[str], hot_share: float = 0.01, min_hot: int = 50_000, salts: int = 64, max_broadcast: int = 100_000, total: int | None = None) -> DataFrame:
    """rows inner join other on keys, where some keys own a large share of rows.

    The rows of other that hold a hot key of rows are broadcast if there are at most max_broadcast of
    them; else they are repeated for each of salts parts into which the hot rows are cut.
    """
    hot = hot_keys(rows, keys, hot_share, min_hot, total)
    if not hot:
        return rows.join(other, keys)
    is_hot = _among(keys, hot)
    mine, few = rows.where(is_hot), other.where(is_hot)
    if few.limit(max_broadcast + 1).count() <= max_broadcast:
        split = mine.join(F.broadcast(few), keys)
    else:
        repeated = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        split = mine.withColumn("_salt", F.pmod(F.xxhash64(*mine.columns), F.lit(salts)).cast("int")).join(repeated, [*keys, "_salt"]).drop("_salt")
    return split.unionByName(rows.where(~is_hot).join(other.where(~is_hot), keys))
