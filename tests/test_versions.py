"""The native sort keys against pairwise comparisons written from the public specifications, over known and over random versions."""

import random
import re
from itertools import zip_longest

import pytest
from packaging.version import InvalidVersion, Version
from pyspark.sql import functions as F

from lodestrata.functions import versions as v

KNOWN = [
    ("alpine", "3.18.0-r0", "3.18.0-r1", -1), ("alpine", "3.18.0", "3.18.1", -1), ("alpine", "3.19.0-r0", "3.18.9-r9", 1), ("alpine", "1.2.3_pre1", "1.2.3", -1), ("alpine", "1.2.3_rc1", "1.2.3", -1), ("alpine", "1.2.3_p1", "1.2.3", 1),
    ("alpine", "1.2.3_alpha1", "1.2.3_beta1", -1), ("alpine", "2:1.0-r0", "1:99.0-r0", 1), ("Alpine:v3.19", "1.2a", "1.2", 1), ("alpine", "1.2a", "1.2.1", -1), ("alpine", "1.05", "1.1", -1), ("alpine", "1.005", "1.05", -1), ("alpine", "1.2.3-r1", "1.2.3-r0", 1),
    ("debian", "1.0-1", "1.0-2", -1), ("debian", "1.2.3", "1.2.4", -1), ("debian", "2:1.0-1", "1:99.0-1", 1), ("debian", "1.0~rc1", "1.0", -1), ("debian", "1.0+deb12u1", "1.0", 1), ("debian", "1.0-1+deb12u2", "1.0-1+deb12u1", 1), ("debian", "3.1.4-1+deb12u4", "3.1.4-1", 1),
    ("ubuntu", "1.0a", "1.0+b", -1), ("debian", "1.0", "1.0-0", 0), ("debian", "007", "7", 0), ("debian", "1~~a", "1~", -1),
    ("npm", "1.2.3", "1.2.4", -1), ("npm", "1.0.0-alpha", "1.0.0", -1), ("npm", "1.0.0-alpha.1", "1.0.0-alpha.2", -1), ("npm", "1.0.0-alpha.1", "1.0.0-1", 1), ("npm", "1.0.0-alpha.2", "1.0.0-alpha.10", -1), ("npm", "1.0.0-alpha", "1.0.0-alpha.1", -1), ("npm", "v1.2.3", "1.2.3", 0), ("npm", "1.0.0+x", "1.0.0+y", 0),
    ("go", "v1.10.0", "v1.9.0", 1), ("cargo", "1.2", "1.2.0", 0), ("npm", "1.2.3.4.5.6.7", "1.2.3.4.5.6.8", -1), ("npm", "99999999999999999999.1", "100000000000000000000.0", -1), (None, "1.10", "1.9", 1),
    ("pypi", "1.0.0", "1.0.1", -1), ("pypi", "1.0.0a1", "1.0.0", -1), ("pypi", "1.0.0b1", "1.0.0rc1", -1), ("pypi", "1.0.0rc1", "1.0.0", -1), ("pypi", "1.0.0.post1", "1.0.0", 1), ("pypi", "1.0.0.dev1", "1.0.0a1", -1), ("pypi", "1!0.0.0", "999.0.0", 1), ("pypi", "1.0", "1.0.0", 0), ("pypi", "1.0rc1", "1.0c1", 0),
    ("pypi", "1.0+a", "1.0", 1), ("pypi", "nonsense", "0.dev0", -1),
    ("maven", "1.0", "1.1", -1), ("maven", "2.0-SNAPSHOT", "2.0", -1), ("maven", "1.0-alpha1", "1.0-beta1", -1), ("maven", "1.0-rc1", "1.0", -1), ("maven", "1.0-sp1", "1.0", 1), ("maven", "1.0.0.0", "1.0", 0), ("maven", "1-ga", "1", 0), ("maven", "1.0.RC2", "1.0-RC3", -1), ("maven", "1-1.foo-bar1baz-.1", "1-1.foo-bar-1-baz-0.1", 0), ("maven", "1-foo2", "1-foo10", -1),
    ("maven", "1-1", "1.1", -1), ("maven", "1-foo", "1-1", -1), ("maven", "1-a1", "1-alpha-1", 0), ("maven", "1.0.1", "1-sp", 1), ("maven", "1-cr2", "1-rc2", 0),
]


def sign(a, b):
    return (a > b) - (a < b)


def compared(spark, triples):
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(triples)], "i long, e string, a string, b string")
    return [r.c for r in df.select("i", v.version_compare(F.col("e"), F.col("a"), F.col("b")).alias("c")).orderBy("i").collect()]


def test_known_pairs(spark):
    pairs = [(e, a, b) for e, a, b, _ in KNOWN] + [(e, b, a) for e, a, b, _ in KNOWN]
    want = [w for *_, w in KNOWN] + [-w for *_, w in KNOWN]
    assert [(p, g, w) for p, g, w in zip(pairs, compared(spark, pairs), want, strict=True) if g != w] == []


def dpkg(a, b):
    """Debian policy 5.6.12, character by character."""

    def parts(x):
        epoch, rest = x.split(":", 1) if re.match("[0-9]+:", x) else ("0", x)
        upstream, dash, revision = rest.rpartition("-")
        return (int(epoch), upstream, revision or "0") if dash else (int(epoch), rest, "0")

    def weight(c):
        return -1 if c == "~" else 0 if c == "" else ord(c) if c.isalpha() else ord(c) + 256

    def one(x, y):
        while x or y:
            p, q = re.match("[^0-9]*", x)[0], re.match("[^0-9]*", y)[0]
            for c, d in zip_longest(p, q, fillvalue=""):
                if weight(c) != weight(d):
                    return sign(weight(c), weight(d))
            x, y = x[len(p) :], y[len(q) :]
            p, q = re.match("[0-9]*", x)[0], re.match("[0-9]*", y)[0]
            if int(p or 0) != int(q or 0):
                return sign(int(p or 0), int(q or 0))
            x, y = x[len(p) :], y[len(q) :]
        return 0

    (e, u, r), (f, w, s) = parts(a), parts(b)
    return sign(e, f) or one(u, w) or one(r, s)


def semver(a, b):
    """Semantic Versioning 11."""

    def parts(x):
        core, dash, pre = re.sub(r"\+.*", "", x.lstrip("v")).partition("-")
        return [int(n) for n in core.split(".")], pre.split(".") if dash else None

    (c, p), (d, q) = parts(a), parts(b)
    for x, y in zip_longest(c, d, fillvalue=0):
        if x != y:
            return sign(x, y)
    if p is None or q is None:
        return sign(p is None, q is None)
    for x, y in zip_longest(p, q):
        if x is None or y is None:
            return -1 if x is None else 1
        if x != y:
            n, m = x.isdigit(), y.isdigit()
            if n and m and int(x) == int(y):
                continue
            return sign(int(x), int(y)) if n and m else sign(m, n) if n != m else sign(x, y)
    return 0


def pep440(a, b):
    return sign(Version(a), Version(b))


def random_versions(rng, kind, n):
    out = []
    number = lambda: str(rng.choice([0, 1, 2, 9, 10, 11, 2**70]))
    while len(out) < n:
        core = ".".join(number() for _ in range(rng.randrange(1, 5)))
        if kind == "debian":
            x = rng.choice(["", "", "1:", "2:"]) + core + "".join(rng.choice(["~", "+", "a", "z", "deb", ".", "~~", "1", "007"]) for _ in range(rng.randrange(4))) + rng.choice(["", "-1", "-0", "-1~a", "-2+b1"])
        elif kind == "pypi":
            x = rng.choice(["", "", "1!"]) + core + rng.choice(["", "", "a1", "b2", "rc1", "-alpha.3", "_preview_2", "c"]) + rng.choice(["", "", ".post1", "-2", "r3", ".post"]) + rng.choice(["", "", ".dev1", "dev"]) + rng.choice(["", "", "+abc.1", "+2", "+abc.x"])
            try:
                Version(x)
            except InvalidVersion:
                continue
        else:
            x = rng.choice(["", "v"]) + core + rng.choice(["", "", "-alpha", "-alpha.1", "-1", "-a.b.3", "-01x", "-rc.10"]) + rng.choice(["", "+b1"])
        out.append(x)
    return out


@pytest.mark.parametrize(("kind", "oracle"), [("debian", dpkg), ("pypi", pep440), ("npm", semver)])
def test_all_pairs_of_random_versions(spark, kind, oracle):
    versions = sorted(set(random_versions(random.Random(11), kind, 70)))
    triples = [(kind, a, b) for a in versions for b in versions]
    wrong = [(a, b, g, oracle(a, b)) for (_, a, b), g in zip(triples, compared(spark, triples), strict=True) if g != oracle(a, b)]
    assert wrong == []


@pytest.mark.parametrize("kind", ["alpine", "maven"])
def test_keys_are_total(spark, kind):
    rng = random.Random(3)
    tails = {"alpine": ["", "a", "_rc1", "_p2", "_alpha", "_git20", "-r0", "-r12", "b_rc2-r1", "_rc1_p2"], "maven": ["", "-sp", ".Final", "-rc-1", "a2", "-SNAPSHOT", "-foo", ".x", "-1", "b1-jre"]}[kind]
    versions = sorted({".".join(str(rng.choice([0, 1, 2, 10])) for _ in range(rng.randrange(1, 4))) + rng.choice(tails) for _ in range(60)})
    triples = [(kind, a, b) for a in versions for b in versions]
    c = dict(zip([(a, b) for _, a, b in triples], compared(spark, triples), strict=True))
    for a in versions:
        assert c[a, a] == 0
        for b in versions:
            assert c[a, b] == -c[b, a]


def test_ranges(spark):
    cases = [
        ("1.5.0", "[1.0.0, 2.0.0)", True), ("2.0.0", "[1.0.0,2.0.0)", False), ("1.0.0", "(1.0.0,2.0.0)", False), ("0.1", "(,2.0]", True), ("1.0", "[1.0]", True), ("1.1", "[1.0]", False), ("1.5", ">= 1.0, < 2.0", True), ("3", "[1,)", True),
        ("2.0", ">= 1.0, < 2.0", False), ("1.0", "", True), ("1.0", "1.0.0", True), ("1.0", "!= 1.0", False), ("1.0", "<", False), ("1.0", "[", False), ("1.0", None, True), (None, "< 2", None), (None, None, True), ("1.2", "==1.2.0", True), ("2", "> 1,,", True),
    ]
    df = spark.createDataFrame([(i, a, e) for i, (a, e, _) in enumerate(cases)], "i int, a string, e string")
    assert [r.c for r in df.select("i", v.version_in_range(F.lit("npm"), F.col("a"), F.col("e")).alias("c")).orderBy("i").collect()] == [w for *_, w in cases]


def test_affected_priority(spark):
    cases = [("1.0.0", "affected", "9.0.0", "2.0.0", "", True), ("1.0.0", "not-affected", "", "2.0.0", "", False), ("1.0.0", "affected", "", "0", "", True), ("1.0.0", "affected", "2.0.0", "", "", False), ("1.0.0", None, None, None, None, True), (None, "x", None, "2", None, None), ("1", "x", "0.5", "", ">= 2", False)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a string, s string, n string, f string, e string, want boolean")
    got = df.select("i", v.version_affected(F.lit("npm"), F.col("a"), F.col("s"), F.col("n"), F.col("f"), F.col("e")).alias("c")).orderBy("i")
    assert [r.c for r in got.collect()] == [c[-1] for c in cases]


def test_dotted_and_nulls(spark):
    df = spark.createDataFrame([("npm", "1.10.0", "1.9.0"), (None, None, "1"), ("x", "1.2.3.4.5.6.7", "1.2.3.4.5.6.8"), ("x", "1.0.0", "v1"), ("x", "", "0.0")], "e string, a string, b string")
    got = [tuple(r) for r in df.select(v.version_compare(F.col("e"), F.col("a"), F.col("b")), v.dotted_key(F.col("a")) < v.dotted_key(F.col("b")), v.dotted_key(F.col("a")) == v.dotted_key(F.col("b"))).collect()]
    assert got == [(1, False, False), (None, None, None), (-1, True, False), (0, False, True), (0, False, True)]
