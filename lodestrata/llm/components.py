"""Consolidating pairwise matches into groups.

Method: minimum labels are propagated across the edges and pointer jumping shortens the label
chains; each round is checkpointed (as a table in the shared checkpoint folder) and the rounds end
when no label changes. Edges between equal labels fall away and the others are carried on between
labels. Of two neighbours at most one keeps its label in a round, so the labels with edges nearly
halve: the rounds grow as the logarithm of the rows, and their sizes fall so fast that all of them
together are of the size of the first. At the end the rounds' labels are put together, last to first.

What ends a loop and what tells hot keys apart (rows, changes, degrees) is observed while a table is
written, so no table is computed twice and no job only counts.

Defined results: null ends of an edge are ignored, repeated edges and loops count once, an empty
table gives an empty result. The label of a group is its smallest member.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.skew import hot_keys, skew_safe_lookup
from lodestrata.session import checkpoint, scratch

HOT_SHARE, MIN_HOT = 0.01, 50_000
OPEN_SHARE = 0.05  # of the nodes that need not have reached their root when a round goes on


def _rows() -> Column:
    return F.count(F.lit(1))


def star_edges(members: DataFrame, node: str, key: str, keep: Callable, rows: int) -> DataFrame:
    """(a, b) with a < b: each member of a key linked to the key's smallest member.

    A key of n members gives n - 1 edges, never all pairs; the minimum is pre-aggregated before
    the shuffle, and a hot key's members find it through a broadcast of hot keys.
    """
    links = members.select(F.col(node).alias("b"), F.col(key).alias("_k"))
    least = keep(links.groupBy("_k").agg(F.min("b").alias("a"), _rows().alias("_n")).where("_n > 1"))
    hot = _hot(least.select("_k", "_n"), rows)
    return skew_safe_lookup(links, least.select("_k", "a"), "_k", hot=hot).where("a < b").select("a", "b").distinct()


def _hot(counts: DataFrame, rows: int) -> list[tuple]:
    """Keys of a (key, number of rows) table that own a large share of the rows: at most 1 / HOT_SHARE."""
    return [(r[0],) for r in counts.where(F.col(counts.columns[1]) >= max(MIN_HOT, HOT_SHARE * rows)).collect()] if rows >= MIN_HOT else []


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """(node, label) of every node of an edge that is no loop."""
    with scratch(edges.sparkSession) as keep:
        return checkpoint(_components(edges, a, b, max_rounds, keep))


def _flat(parent: DataFrame, hot: list[tuple], keep: Callable) -> tuple[DataFrame, list[tuple]]:
    """(node, up) with all but OPEN_SHARE of the nodes pointing at the root of their tree, and the hot ones of up: pointers reach three times as far with each stored table.

    A node that points at another ancestor does no harm: edges are carried on between whatever the
    nodes point at, so its tree is joined in the next round.
    """
    while True:
        above = parent.where("node <> up").select(F.col("node").alias("up"), F.col("up").alias("_up2"))
        once = skew_safe_lookup(parent, above, "up", hot=hot).select("node", "up", F.coalesce("_up2", "up").alias("_mid"))
        more = above.select(F.col("up").alias("_mid"), F.col("_up2").alias("_up3"))
        jumped = skew_safe_lookup(once, more, "_mid", hot=hot).select("node", F.col("_mid"), F.coalesce("_up3", "_mid").alias("up"))
        jumped, seen = keep(jumped, rows=_rows(), open=F.count_if(F.col("_mid") != F.col("up")))
        parent = jumped.select("node", "up")
        hot = hot_keys(parent, ["up"], HOT_SHARE, MIN_HOT, seen["rows"])
        if seen["open"] <= OPEN_SHARE * seen["rows"]:
            return parent, hot


def _components(edges: DataFrame, a: str, b: str, max_rounds: int, keep: Callable) -> DataFrame:
    low, high = F.least(a, b), F.greatest(a, b)
    edges, seen = keep(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(low.alias("a"), high.alias("b")).where("a < b").distinct(), rows=_rows())
    rounds: list[tuple[DataFrame, list[tuple]]] = []
    for _ in range(max_rounds):
        if not seen["rows"]:
            break
        # the smallest neighbour of each label that still has an edge
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("next")).union(edges.select("b", "a"))
        parent, hot = both.groupBy("node").agg(F.min("next").alias("_n"), _rows().alias("_degree")).select("node", F.least("node", "_n").alias("up"), "_degree"), []
        if seen["rows"] >= MIN_HOT:
            parent = keep(parent)
            hot = _hot(parent.select("node", "_degree"), seen["rows"])
        flat, heavy = _flat(parent.select("node", "up"), hot, keep)
        rounds.append((flat, heavy))
        moved = flat.where("node <> up").select(F.col("node").alias("_old"), F.col("up").alias("_new"))
        step = lambda df, c, m=moved, h=hot: skew_safe_lookup(df.withColumnRenamed(c, "_old"), m, "_old", hot=h).withColumn(c, F.coalesce("_new", "_old")).drop("_old", "_new")
        once = step(edges, "a")
        if hot:  # stored: with hot keys each step is a union, whose parts would read the step before twice
            once = keep(once)
        edges, seen = keep(step(once, "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), rows=_rows())
    else:
        raise RuntimeError(f"labels still change after {max_rounds} rounds")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = rounds.pop()[0].withColumnRenamed("up", "label")
    while rounds:
        before, hot = rounds.pop()
        last = labels.where("node <> label").select(F.col("node").alias("up"), F.col("label").alias("_last"))
        labels = skew_safe_lookup(before, keep(last) if hot else last, "up", hot=hot).select("node", F.coalesce("_last", "up").alias("label"))
    return labels


def groups_by_shared_keys(rows: DataFrame, node: str, keys: Column) -> DataFrame:
    """(group_id, node) of the rows that share a key of the array ``keys``, directly or through further rows, in groups of two or more."""
    with scratch(rows.sparkSession) as keep:
        exploded = rows.where(F.col(node).isNotNull()).select(F.col(node), F.explode(keys).alias("_key")).where("_key is not null").distinct()
        members, seen = keep(exploded, rows=_rows())
        found = checkpoint(_components(star_edges(members, node, "_key", keep, seen["rows"]), "a", "b", 200, keep))
    return found.select(F.col("label").alias("group_id"), F.col("node").alias(node))
