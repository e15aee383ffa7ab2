import hashlib
import math
import posixpath

from pyspark.sql import functions as F

from lodestrata.functions import findings as fx
from lodestrata.functions import text as tx


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first().r


def test_normalize_path(spark):
    for p in ["a/b/../c", "./a//b/", "../a/../../b", "/a/../../b", "/", "A\\B\\c.py", ".", "", "a/..", "/x/./y"]:
        want = posixpath.normpath(p.replace("\\", "/")).lower() if p else ""
        assert one(spark, p, tx.normalize_path) == want, p


def test_snippet_hash_redact(spark):
    assert one(spark, "  A\t b\n\nC ", tx.normalize_snippet) == "a b c"
    assert one(spark, "xy", tx.short_hash) == hashlib.sha256(b"xy").hexdigest()[:16]
    assert one(spark, "k = 'abcdefghijklmnopqrstuvwx'", tx.redact) == "k = 'a[REDACTED]x'"
    assert one(spark, "k = 'short'", tx.redact) == "k = 'short'"


def test_entropy_dice(spark):
    s = "aabbcdef"
    want = -sum(n / 8 * math.log2(n / 8) for n in (2, 2, 1, 1, 1, 1))
    assert abs(one(spark, s, tx.shannon_entropy) - want) < 1e-12
    assert one(spark, "aaaa", tx.shannon_entropy) == 0
    df = spark.createDataFrame([("night", "nacht"), ("", ""), ("a", "a")], "a string, b string").select(tx.dice(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r.d for r in df] == [0.25, 0.0, 0.0]


def test_lines(spark):
    df = spark.createDataFrame([(1, "a\r\nb\n"), (2, ""), (3, None), (4, "\n\nx")], "k int, t string")
    got = sorted((r.k, r.line_no, r.line) for r in tx.lines(df, "k", "t").collect())
    assert got == [(1, 1, "a"), (1, 2, "b"), (4, 1, ""), (4, 2, ""), (4, 3, "x")]


def test_predicates(spark):
    assert one(spark, "x/tests/a.py", tx.is_test_path) and one(spark, "a_test.go", tx.is_test_path) and not one(spark, "src/latest.py", tx.is_test_path)
    assert one(spark, "x = 1", tx.is_assignment) and not one(spark, "if x == 1 {", tx.is_assignment) and one(spark, "key: value", tx.is_assignment)
    assert one(spark, "Dockerfile.dev", tx.language) == "dockerfile" and one(spark, "a.TSX", tx.language) == "typescript" and one(spark, "a.xyz", tx.language) == "unknown"
    assert one(spark, "a.min.js", tx.is_third_party) and one(spark, "poetry.lock", tx.is_lockfile) and one(spark, ".env.example", tx.is_example_file)
    assert not one(spark, "x.png", tx.is_text_file)


def test_fingerprints_match_hashlib(spark):
    row = ("sast", "A-1", "R-IP", "a\\b/../c.py", " x  Y ", "t", 3)
    df = spark.createDataFrame([row, ("sca", "an", "", "p", "", "title in Foo", 0)], "finding_type string, analyzer string, rule_id string, file_path string, evidence string, title string, line_start int")
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()[:16]
    got = df.select(fx.semantic_fingerprint().alias("s"), fx.location_fingerprint().alias("l"), fx.dedup_fingerprint().alias("d")).collect()
    assert got[0].s == h("R-IP|A-1|a/c.py|x y") and got[0].l == h("R-IP|a/c.py|x y|A-1|L3") and got[0].d == h("R|a/c.py|L3|x y")
    assert got[1].s == h("sca:an|an|p|title in foo") and got[1].l == h("sca:an|p||an") and got[1].d == h("|p|")
    dep = df.select(fx.semantic_fingerprint(package=F.lit("x@1"), advisory=F.lit("CVE-1")).alias("s")).collect()
    assert dep[1].s == h("sca:an|an|p|x@1|CVE-1")
