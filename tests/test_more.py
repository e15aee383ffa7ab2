import json
import subprocess

import pytest
from pyspark.sql import functions as F

from conftest import rows
from lodestrata.functions import findings as fx
from lodestrata.functions.text import import_candidates
from lodestrata.operators import findings as op
from lodestrata.operators import taint
from lodestrata.sources import feeds


def test_points_and_scope(spark):
    df = spark.createDataFrame([(1001, 21), (11, 6), (0, 0)], "l int, f int").select(fx.change_points(F.col("l"), F.col("f")).alias("p")).collect()
    assert [r.p for r in df] == [15, 4, 0]
    assert spark.range(1).select(fx.sensitivity_points(F.lit(True), F.lit(True), F.lit(True)).alias("p")).first().p == 15
    s = spark.createDataFrame([(None,), ("cwe-89",), ("SQL",), ("x",)], "s string").select(fx.in_scope(F.col("s"), F.lit("CWE-89"), F.lit("sql")).alias("i")).collect()
    assert [r.i for r in s] == [True, True, True, False]
    names = spark.createDataFrame([("PyYAML",), ("my-pkg",)], "p string").select(import_candidates(F.col("p")).alias("c")).collect()
    assert names[0].c == ["PyYAML", "pyyaml", "yaml"] and names[1].c == ["my-pkg", "my_pkg"]


def test_safe_functions(spark):
    f = spark.createDataFrame([("1", "a.py", 3, "R"), ("2", "a.py", 8, "R"), ("3", "a.py", 3, "S"), ("4", "a.py", 0, "R")], "id string, file_path string, line_start int, rule_id string")
    b = spark.createDataFrame([("a.py", 1, "f"), ("a.py", 6, "g")], "path string, line_no int, name string")
    l = spark.createDataFrame([("a.py", 2, "x = clean(y)"), ("a.py", 0, "clean(")], "path string, line_no int, line string")
    assert rows(op.without_safe_functions(f, b, l, {"R": r"clean\("}), "id") == [("2",), ("3",), ("4",)]


def test_python_nodes(spark):
    df = spark.createDataFrame([("a.py", "x = f(1)\n"), ("b.py", "def (")], "path string, content string")
    assert rows(taint.python_nodes(df).where("kind = 'Call'"), "path", "name", "line") == [("a.py", "f", 1)]


def test_folders(spark, tmp_path):
    for s in "ab":
        (tmp_path / "r" / s).mkdir(parents=True)
        (tmp_path / "r" / s / "summary.json").write_text(json.dumps({"total": 1}, indent=1))
    assert rows(feeds.suite_summaries(spark, str(tmp_path / "r")), "suite", "total") == [("a", 1), ("b", 1)]
    g = lambda *a: subprocess.run(["git", "-C", str(tmp_path / "g"), "-c", "user.name=x", "-c", "user.email=x@x.example", *a], check=True, capture_output=True)
    (tmp_path / "g").mkdir()
    g("init", "-q")
    (tmp_path / "g" / "a.py").write_text("1")
    (tmp_path / "g" / "gone.py").write_text("1")
    g("add", "-A")
    g("commit", "-qm", "1")
    (tmp_path / "g" / "a.py").write_text("2")
    (tmp_path / "g" / "p.png").write_text("2")
    (tmp_path / "g" / "gone.py").unlink()
    g("add", "-A")
    g("commit", "-qm", "2")
    assert rows(feeds.git_changed(spark, str(tmp_path / "g")), "path") == [("a.py",)]
    assert feeds.inside(str(tmp_path), "r/a").endswith("r/a")
    with pytest.raises(ValueError):
        feeds.inside(str(tmp_path), "../x")


def test_backward_reach_cycles_and_cuts(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (5, 3), (None, 3), (6, 4)], "node long, next long")
    n = lambda *x: spark.createDataFrame([(i,) for i in x], "node long")
    got = taint.backward_reach(e, n(3), n(1, 4, 6), n(5))
    assert rows(got, "sink", "source", "depth") == [(3, 1, 2)]
    assert rows(taint.backward_reach(e, n(3), n(1, 4, 6), n(99)), "source", "depth") == [(1, 2), (4, 2), (6, 3)]
    assert taint.backward_reach(e, n(3).limit(0), n(1), n(5)).count() == 0


def test_language_packages(spark):
    from lodestrata.sources import images

    f = spark.createDataFrame([("a/node_modules/@s/x/package.json", '{"name":"@s/x","version":"1"}'), ("p/y-2.dist-info/METADATA", "Metadata-Version: 2\nName: y\nVersion: 2\n"), ("z.jar/META-INF/maven/g/a/pom.properties", "version=3\ngroupId=g\nartifactId=a\n"), ("a/package.json", '{"name":"top"}')], "path string, content string")
    assert rows(images.language_packages(f), "ecosystem", "name", "version") == [("maven", "g:a", "3"), ("npm", "@s/x", "1"), ("pypi", "y", "2")]


def test_extended_taint_rules(spark):
    more = taint.extended(taint.RULES, "TP-PY-EVAL", sources=("environ",), sanitizers=("clean",))
    assert more[0] == taint.RULES[0] and more[2].sources[-1] == "environ" and taint.extended(more, "TP-PY-EVAL", sources=("environ",)) == more
    df = spark.createDataFrame([("a.py", "def f():\n    q = environ['x']\n    eval(q)\n    q = clean(q)\n    eval(q)\n")], "path string, content string")
    assert rows(taint.taint_findings(df, more), "line") == [(3,)] and taint.taint_findings(df).count() == 0


def test_ubuntu_feed(spark):
    from lodestrata.sources import feeds

    xml = """<oval><definition id="1" class="vulnerability"><metadata><title>CVE-2020-1 on Ubuntu - low.</title></metadata>
    <criteria><criterion comment="(jammy) p1 package in jammy was vulnerable but has been fixed (note: '1.2-1')."/><criteria><criterion comment="p2 package in jammy is related; fixed (note: '3')"/><criterion comment="p1 package in jammy was vulnerable but has been fixed (note: '1.2-1')."/></criteria></criteria></definition>
    <definition id="2" class="inventory"><title>CVE-2020-2</title><criterion comment="p9 package in jammy fixed (note: '9')"/></definition></oval>"""
    df = spark.createDataFrame([(xml,)], "body string")
    assert rows(feeds.ubuntu(df), "vuln_id", "package_name", "fixed_version") == [("CVE-2020-1", "p1", "1.2-1"), ("CVE-2020-1", "p2", "3")]


def test_backward_reach_of_long_chains(spark):
    e = spark.range(52).coalesce(1).select(F.col("id").alias("node"), (F.col("id") + 1).alias("next"))
    n = lambda *x: spark.createDataFrame([(i,) for i in x], "node long")
    assert rows(taint.backward_reach(e, n(52), n(0, 1, 2, 36), n(-1)), "source", "depth") == [(0, 52), (1, 51), (2, 50), (36, 16)]


def test_advisory_extractors(spark):
    from pyspark.sql import functions as F

    from lodestrata.operators import advisories as op

    v = spark.createDataFrame([("CVSS:3.1/AV:N/C:H/I:H/A:H",), ("CVSS:3.1/C:N/I:H/A:N",), ("CVSS:3.1/C:L/I:N/A:N",), ("CVSS:3.1/C:N/I:N/A:N",), (None,), ("",)], "v string")
    assert [r.s for r in v.select(op.severity_of_vector(F.col("v")).alias("s")).collect()] == ["critical", "high", "medium", "low", "unknown", "unknown"]
    w = spark.createDataFrame([('{"cwe":"89"}',), ('{"cwe":["CWE-1","CWE-2"]}',), ('{"cwe_ids":["CWE-3"]}',), ('{"cweId":"4"}',), ("{}",), ("{",), (None,), ('{"cwe":[]}',)], "j string")
    assert [r.s for r in w.select(op.weakness_of(F.col("j")).alias("s")).collect()] == ["CWE-89", "CWE-1", "CWE-3", "CWE-4", "", "", "", ""]
    refs = spark.createDataFrame([([("FIX", "a"), ("WEB", "b")],), ([("FIX", "a")],), ([],), (None,)], "r array<struct<type:string,url:string>>")
    assert [r.u for r in refs.select(op.advisory_url(F.col("r")).alias("u")).collect()] == ["b", "a", "", ""]
    n = spark.createDataFrame([("CVSS_V3/8.1",), ("9",), ("CVSS:3.1/AV:N",), (None,)], "t string")
    assert [r.x for r in n.select(op.numeric_score(F.col("t")).alias("x")).collect()] == [8.1, 9.0, None, None]
