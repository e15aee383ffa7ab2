import random

from pyspark.sql import functions as F

from conftest import rows
from lodestrata.llm import components
from lodestrata.llm.components import connected_components, groups_by_shared_keys, star_edges
from lodestrata.llm.identifiers import identifiers
from lodestrata.session import scratch


def union_find(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return sorted((n, find(n)) for n in up)


def frame(spark, edges):
    return spark.createDataFrame(edges, "a long, b long")


def test_components_against_union_find(spark):
    rng = random.Random(1)
    chain = [(n, n + 1) for n in range(0, 60)]
    rng.shuffle(chain)
    star = [(1000, 1000 + n) for n in range(1, 80)]
    noise = [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(120)]
    edges = chain + star + noise + [(5, 5), (None, 3), (4, None), (1000, 1001), (1001, 1000)]
    assert rows(connected_components(frame(spark, edges)), "node", "label") == sorted(union_find(edges), key=repr)


def test_components_empty(spark):
    assert connected_components(frame(spark, [])).count() == 0
    assert connected_components(frame(spark, [(1, 1)])).count() == 0


def test_star_edges_are_no_pairs(spark):
    m = spark.createDataFrame([(n, "k") for n in range(50)] + [(None, "k"), (7, None), (99, "alone")], "id long, key string")
    with scratch(spark) as keep:
        e = star_edges(m.dropna(), "id", "key", keep, 52)
        assert e.count() == 49 and {r.a for r in e.collect()} == {0}


def test_hot_keys_take_the_same_way(spark, monkeypatch):
    """With a threshold that makes many nodes hot, the labels are the same."""
    monkeypatch.setattr(components, "MIN_HOT", 5)
    rng = random.Random(4)
    edges = [(1, n) for n in range(2, 300)] + [(n, n + 1) for n in range(400, 440)] + [(rng.randrange(500, 700), rng.randrange(500, 700)) for _ in range(150)] + [(440, 300), (299, 700)]
    assert rows(connected_components(frame(spark, edges)), "node", "label") == sorted(union_find(edges), key=repr)
    df = spark.createDataFrame([(n, ["a", f"k{n % 7}"] if n % 2 else [f"x{n}"]) for n in range(200)], "id long, keys array<string>")
    assert rows(groups_by_shared_keys(df, "id", F.col("keys")), "group_id", "id") == sorted(((1, n) for n in range(1, 200, 2)), key=repr)


def test_identifiers(spark):
    cases = {
        "cve-2023-6468530": ["CVE-2023-6468530"], " CVE_2016_6393397 ": ["CVE-2016-6393397"], "CVE‑2015‑6004150": ["CVE-2015-6004150"], "CVE 2015 3398278": ["CVE-2015-3398278"], "CVE-2019-6898770​": ["CVE-2019-6898770"],
        "https://t.example/?id=GHSA-9qm2-g9cj-hpgf#notes": ["GHSA-9QM2-G9CJ-HPGF"], '["GO-2020-1", "DLA-2019-22"]': ["GO-2020-1", "DLA-2019-22"], "PYSEC-2018-1 / id:PYSEC-2018-12 (same issue)": ["PYSEC-2018-1", "PYSEC-2018-12"],
        "CVE-2024-XXXXX": [], "CVE-PENDING": [], "GHSA-xxxx-xxxx-xxxx": [], "CVE-0000-0000": [], "n/a": [], "": [], "XCVE-2020-1a": [], "see advisory": [], None: [],
    }
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", identifiers(F.col("t")).alias("i")).collect()
    for r in got:
        assert r.i == cases[r.t], r.t


def test_rows_in_groups(spark):
    df = spark.createDataFrame([(1, ["a"], 0), (2, ["b", "a", None], 0), (3, ["b"], 0), (4, ["z"], 0), (5, None, 0), (6, [], 0), (7, ["q"], 0), (8, ["q"], 0)], "id long, keys array<string>, label int")
    assert rows(groups_by_shared_keys(df, "id", F.col("keys")), "group_id", "id") == [(1, 1), (1, 2), (1, 3), (7, 7), (7, 8)]
