import random
from datetime import datetime, timezone

from conftest import rows
from pyspark.sql import functions as F

from lodestrata.llm.survivorship import analyzer_key, confidence_rank, filled, normalised_rule, repository_path, survivors

SCHEMA = "id string, file_path string, rule_id string, line_start int, confidence string, analyzer string, detected_at timestamp, cwe_id string, recommendation string, extra int"
T = datetime(2020, 1, 1, tzinfo=timezone.utc)


def test_brute_force(spark):
    rng = random.Random(5)
    data = []
    for n in range(400):
        f = f"r-{rng.randrange(3):07}/a.py"
        data.append((f"F{n:04}", rng.choice([f, "./" + f, "/srv/ws/" + f, "D:\\b\\" + f.replace("/", "\\"), f.replace("/", "//")]), rng.choice(["R1", "ts-r1", "R1-IP", "R2", None, "n/a"]), rng.choice([None, *range(1, 120)]), rng.choice(["high", "HI", " med", "low", None, "x"]), rng.choice(["A-b", "a_B ", "a-b/3.1", "zz", None]), rng.choice([None, T, T.replace(month=2)]), rng.choice([None, "CWE-1", "-", " "]), rng.choice(["none", "do it", ""]), n))
    trust = spark.createDataFrame([("a-b", 2), ("zz", 1), ("zz", 0), (None, 9)], "analyzer string, trust int")
    got = set(rows(survivors(spark.createDataFrame(data, SCHEMA), trust), "group_id", "field_name", "winner_id"))
    groups = {}
    for r in data:
        rule = (r[2] or "").upper().removeprefix("TS-").removesuffix("-IP")
        if rule not in ("", "N/A") and r[3] is not None:
            groups.setdefault((r[1].replace("\\", "/").replace("//", "/").rpartition("r-")[2], rule), []).append(r)
    rank = lambda r: ({"high": 0, "hi": 0, "med": 1, "low": 2}.get((r[4] or "").strip().lower(), 3), -{"ab": 2, "zz": 1}.get((r[5] or "").lower().strip().replace("_", "-").split("/")[0].replace("-", ""), 0), r[6] is None, -(r[6].timestamp() if r[6] else 0), r[0])
    want = set()
    for g in groups.values():
        g.sort(key=lambda r: r[3])
        islands, last = [], None
        for r in g:
            if last is None or r[3] - last > 5:
                islands.append([])
            islands[-1].append(r)
            last = r[3]
        for i in islands:
            if len(i) > 1:
                gid, best = min(r[0] for r in i), sorted(i, key=rank)
                want.add((gid, "record", best[0][0]))
                for f, at in (("cwe_id", 7), ("recommendation", 8)):
                    if w := [r[0] for r in best if (r[at] or "").strip().lower() not in ("", "-", "none", "n/a")]:
                        want.add((gid, f, w[0]))
    assert got == want and want


def test_edges(spark):
    trust = spark.createDataFrame([], "analyzer string, trust int")
    empty = spark.createDataFrame([], SCHEMA)
    assert survivors(empty, trust).count() == 0
    same = ("a", "r-0000001/x", "R", 1, None, None, None, None, None, 0)
    df = spark.createDataFrame([same, ("b", *same[1:]), ("c", None, *same[2:]), ("d", "nowhere/x", *same[2:])], SCHEMA)
    assert rows(survivors(df, trust), "group_id", "field_name", "winner_id") == [("a", "record", "a")]


def test_expressions(spark):
    df = spark.createDataFrame([("/srv/ws/x-0000012/a/./b/../c.py", "Ts-Qx-1-ip", "Ext-Lintel/3.3", " HI", "N/A"), ("x-00000123/a", None, None, None, None)], "p string, r string, a string, c string, v string")
    r = df.select(repository_path(F.col("p")).alias("p"), normalised_rule(F.col("r")).alias("r"), analyzer_key(F.col("a")).alias("a"), confidence_rank(F.col("c")).alias("c"), filled(F.col("v")).alias("v")).collect()
    assert tuple(r[0]) == ("x-0000012/a/c.py", "QX-1", "extlintel", 3, False) and tuple(r[1]) == (None, None, None, 0, False)


def test_paths_fold_at_any_depth(spark):
    for path, want in [
        ("repo1234567/a/b/c/../../../src/f.py", "repo1234567/src/f.py"), ("repo1234567/a/../b/../../repo1234567/x/./y//F.py", "repo1234567/x/y/f.py"), ("/srv/x/../repo1234567/" + "d/" * 9 + "../" * 9 + "f.py", "repo1234567/f.py"),
        ("C:\\w\\repo1234567\\a\\..\\f.py", "repo1234567/f.py"), ("a/b.py", None), (None, None), ("", None), ("repo1234567/..", None),
    ]:
        assert spark.createDataFrame([(path,)], "p string").select(repository_path(F.col("p"))).first()[0] == want, path
