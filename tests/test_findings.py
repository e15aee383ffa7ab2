import random

from pyspark.sql import functions as F

from conftest import rows
from lodestrata.functions import findings as fx
from lodestrata.operators import findings as op
from lodestrata.operators.ranking import global_rank
from lodestrata.operators.skew import skew_safe_join, skew_safe_lookup

SCHEMA = "id string, finding_type string, analyzer string, severity string, confidence string, title string, file_path string, line_start int, rule_id string, evidence string, taint_path array<string>"


def frame(spark, items):
    full = [{"finding_type": "sast", "analyzer": "a", "severity": "high", "confidence": "high", "title": "t", "file_path": "x/f.py", "evidence": ""} | i for i in items]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(i.get(n) for n in names) for i in full], SCHEMA)


def fold(items, prio):
    """The greedy fold over rows in order, by hand."""
    best, at = {}, {}
    for i in items:
        key = None
        for off in range(6):
            for sign in (1, -1):
                k = (i["file_path"], i["rule_id"], i["line_start"] + sign * off)
                if k in best:
                    key = k
                    break
            if key:
                break
        key = key or (i["file_path"], i["rule_id"], i["line_start"])
        at[i["id"]] = key
        old = best.get(key)
        rank = {"high": 3, "medium": 2, "low": 1}
        if old is None or rank[i["confidence"]] > rank[old["confidence"]] or i["confidence"] == old["confidence"] and prio.get(i["analyzer"], 0) > prio.get(old["analyzer"], 0):
            best[key] = i
    return sorted((i, best[k]["id"]) for i, k in at.items())


def test_proximity_is_not_transitive(spark):
    f = frame(spark, [{"id": str(n), "line_start": n, "rule_id": "R"} for n in (1, 6, 11)])
    assert rows(op.proximity_dedup(f, [F.col("line_start"), F.col("id")]), "id", "kept_id") == [("1", "1"), ("11", "11"), ("6", "1")]


def test_proximity_against_fold(spark):
    rng = random.Random(3)
    items = [{"id": f"{n:03}", "line_start": rng.randrange(1, 40), "rule_id": rng.choice("AB"), "file_path": rng.choice(["x/f.py", "x/g.py"]), "confidence": rng.choice(["high", "medium", "low"]), "analyzer": rng.choice("pq")} for n in range(150)]
    prio = {"p": 1, "q": 2}
    assert rows(op.proximity_dedup(frame(spark, items), [F.col("id")], priority=prio), "id", "kept_id") == fold(items, prio)


def test_semantic_dedup_keeps_empty(spark):
    f = frame(spark, [{"id": "1", "line_start": 1, "rule_id": "R", "evidence": " e "}, {"id": "2", "line_start": 9, "rule_id": "TS-R", "evidence": "e"}, {"id": "3", "line_start": 9, "rule_id": "R"}, {"id": "4", "line_start": 9, "rule_id": "R"}])
    assert rows(op.semantic_dedup(f, [F.col("id")]), "id") == [("1",), ("3",), ("4",)]


def test_suppression_and_twins(spark):
    f = frame(spark, [{"id": str(n), "line_start": n, "rule_id": "R"} for n in (1, 2, 3)] + [{"id": "ip", "line_start": 1, "rule_id": "R-IP"}])
    d = spark.createDataFrame([("X/f.py", 2, "R")], "path string, line_no int, rule_id string")
    assert rows(op.unsuppressed(f, d), "id") == [("1",), ("ip",)]
    blanket = spark.createDataFrame([("x/f.py", 1, None)], "path string, line_no int, rule_id string")
    assert rows(op.unsuppressed(f, blanket), "id") == [("3",)]
    assert rows(op.without_base_twins(f), "id") == [("2",), ("3",), ("ip",)]


def test_baseline_idempotent_and_line_shift(spark):
    f = frame(spark, [{"id": "1", "line_start": 1, "rule_id": "R", "evidence": "x"}, {"id": "2", "line_start": 5, "rule_id": "S", "evidence": "y"}]).withColumn("fp", fx.semantic_fingerprint())
    assert {r.state for r in op.baseline_compare(f, f, "fp").collect()} == {"unchanged"}
    moved = f.drop("fp").withColumn("line_start", F.col("line_start") + 7).withColumn("fp", fx.semantic_fingerprint())
    assert {r.state for r in op.baseline_compare(moved, f, "fp").collect()} == {"unchanged"}
    assert rows(op.baseline_compare(f.where("id='1'"), f.where("id='2'"), "fp"), "id", "state") == [("1", "new"), ("2", "resolved")]


def test_risk_points(spark):
    f = frame(spark, [{"id": str(n), "line_start": 1, "rule_id": "R", "finding_type": "secret"} for n in range(2)])
    r = op.risk_points(f, F.lit("high")).first()
    assert (r.secret_points, r.score, r.level) == (20, 20, "low")
    e = op.risk_points(f.limit(0), F.lit("high")).first()
    assert e.score == 0 and e.level == "minimal"
    sca = frame(spark, [{"id": str(n), "line_start": 1, "rule_id": "R", "finding_type": "sca", "severity": s} for n, s in enumerate(["critical", "high"])])
    r = op.risk_points(sca, F.lit("high")).first()
    assert (r.vulnerability_points, r.reachability_bonus) == (30 + 22, 6) or (r.vulnerability_points, r.reachability_bonus) == (50, 6)


def test_enclosing_function_and_hunks(spark):
    f = frame(spark, [{"id": str(n), "line_start": n, "rule_id": "R"} for n in (1, 5, 9)])
    b = spark.createDataFrame([("x/f.py", 2, "g"), ("x/f.py", 9, "h")], "path string, line_no int, name string")
    assert rows(op.enclosing_function(f, b), "id", "function") == [("1", None), ("5", "g@2"), ("9", "h@9")]
    h = spark.createDataFrame([("x/f.py", 4, 2)], "path string, new_start int, new_count int")
    assert rows(op.placed_in_hunks(f, h), "id", "in_hunk") == [("1", False), ("5", True), ("9", False)]


def test_global_rank_and_skew(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    got = global_rank(df, [F.col("v").desc(), F.col("id")]).collect()
    want = {i: p for p, i in enumerate(sorted(range(1000), key=lambda i: (-(i % 7), i)), 1)}
    assert {r.id: r.place for r in got} == want
    left = spark.createDataFrame([(1,)] * 500 + [(n,) for n in range(100)] + [(None,)], "k int")
    m = spark.createDataFrame([(n, n * 2) for n in range(50)], "k int, v int")
    a = skew_safe_lookup(left, m, "k", hot_share=0.1, min_hot=10)
    assert rows(a, "k", "v") == rows(left.join(m, "k", "left"), "k", "v")


def grouped(items):
    """The grouping over rows in order, by hand: every finding looks at all earlier ones."""
    items = sorted(items, key=lambda i: (i["line_start"], i["id"]))
    group = {}
    for n, i in enumerate(items):
        name = i["title"].split(" in ")[1] if " in " in i["title"] else ""
        i["key"] = (i["rule_id"].removesuffix("-IP"), i["file_path"].lower(), name)
        near = [j for j in items[:n] if j["key"][:2] == i["key"][:2] and (j["key"] == i["key"] if name else abs(j["line_start"] - i["line_start"]) <= 10)]
        group[i["id"]] = group[near[0]["id"]] if near else i["id"]
    members = {}
    for i in items:
        members.setdefault(group[i["id"]], []).append(i)
    return sorted((i["id"], len(m), min(m, key=lambda j: (j["line_start"], j["id"]))["id"]) for m in members.values() for i in m)


def test_issue_groups(spark):
    one = lambda *lines, title="t": [{"id": str(n), "line_start": n, "rule_id": "R", "title": title} for n in lines]
    got = lambda items: rows(op.issue_groups(frame(spark, items)), "id", "occurrence_count", "primary_id")
    assert got(one(141, 148, 167)) == [("141", 2, "141"), ("148", 2, "141"), ("167", 1, "167")]
    assert got(one(141, 148, title="IDOR in editpaste.mutate")) == [("141", 2, "141"), ("148", 2, "141")]
    assert got([*one(141, title="IDOR in a.mutate"), *one(143, title="IDOR in b.mutate"), *one(145)]) == [("141", 2, "141"), ("143", 1, "143"), ("145", 2, "141")]
    ids = {r.id: r.issue_group_id for r in op.issue_groups(frame(spark, one(141, 148, 167))).collect()}
    assert ids["141"] == ids["148"] != ids["167"] and ids["141"].endswith("-L141")
    b = spark.createDataFrame([("x/f.py", 2, "g"), ("x/f.py", 9, "h")], "path string, line_no int, name string")
    assert rows(op.issue_groups(frame(spark, one(4, 5, 9)), b), "id", "occurrence_count") == [("4", 2), ("5", 2), ("9", 1)]
    assert op.issue_groups(frame(spark, one(1)).limit(0)).count() == 0


def test_issue_groups_against_all_pairs(spark):
    rng = random.Random(6)
    items = [{"id": f"{n:03}", "line_start": rng.randrange(1, 150), "rule_id": rng.choice(["A", "A-IP", "B"]), "file_path": rng.choice(["x/f.py", "x/G.py"]), "title": rng.choice(["t", "t", "t", "t in one", "t in two"])} for n in range(160)]
    got = op.issue_groups(frame(spark, items)).collect()
    assert sorted((r.id, r.occurrence_count, r.primary_id) for r in got) == grouped(items)
    assert all(r.location.split(":")[1] == str(next(i["line_start"] for i in items if i["id"] == r.id)) for r in got)


def test_hot_key_folds(spark):
    """One file and rule holds an eighth of a million rows; nothing is gathered for the folds."""
    n = F.col("id")
    f = spark.range(1_000_000).select(
        n.cast("string").alias("id"), F.lit("sast").alias("finding_type"), F.lit("a").alias("analyzer"), F.lit("high").alias("severity"), F.lit("high").alias("confidence"), F.lit("t").alias("title"),
        F.when(n % 8 == 0, "x/hot.py").otherwise(F.concat(F.lit("x/f"), (n % 5000).cast("string"), F.lit(".py"))).alias("file_path"), (n % 40_009 + 1).cast("int").alias("line_start"), F.lit("R").alias("rule_id"), F.lit("").alias("evidence"), F.lit(None).cast("array<string>").alias("taint_path"),
    )
    kept = op.proximity_dedup(f, [F.col("line_start"), F.col("id")])
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "FlatMapGroups" not in plan
    hot = f.where("file_path = 'x/hot.py'").select("id", "line_start").join(kept, "id").select("kept_id").distinct().count()
    assert hot == 40_009 // 6 + 1
    groups = op.issue_groups(f)
    assert "collect_list" not in groups._jdf.queryExecution().optimizedPlan().toString()
    assert groups.count() == 1_000_000 and groups.where("location like 'x/hot.py:%'").select("issue_group_id").distinct().count() == 1


def test_skew_safe_join(spark):
    left = spark.createDataFrame([("e", "hot", n) for n in range(300)] + [("e", f"k{n}", n) for n in range(60)] + [(None, "hot", 1), ("e", None, 2)], "e string, k string, v int")
    right = spark.createDataFrame([("e", "hot", w) for w in range(4)] + [("e", f"k{n}", n) for n in range(0, 60, 2)] + [("e", None, 9)], "e string, k string, w int")
    want = rows(left.join(right, ["e", "k"]), "e", "k", "v", "w")
    for most in (100, 2):
        assert rows(skew_safe_join(left, right, ["e", "k"], hot_share=0.1, min_hot=10, max_broadcast=most, salts=7), "e", "k", "v", "w") == want
