"""Package version orders of seven ecosystems as native sort keys, and range expressions over them.

`version_key` turns a version into an array of texts whose element-by-element order is the order of
the versions: of Debian policy, of the package tools of Alpine, of PEP 440, of Maven's version order
specification and of Semantic Versioning. Numbers are written with their count of digits first, so
they have no largest value, and versions may have any number of parts. Everything is a Column of
built-in functions; no Python runs on a row.

Defined results: a null version gives a null key and null comparisons; the empty version is the
smallest of its ecosystem; an unknown or missing ecosystem is read as Semantic Versioning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = 9  # digits of a count of digits


def _number(digits: Column) -> Column:
    """A run of digits as a text that sorts by value: the count of digits without leading zeros, then these."""
    bare = F.regexp_replace(digits, "^0+", "")
    return F.concat(F.lpad(F.length(bare).cast("string"), _DIGITS, "0"), bare)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _texts(*parts: Column | str) -> Column:
    return F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _epoch(v: Column, mark: str) -> tuple[Column, Column]:
    """(epoch, rest) of a version with an epoch in front of a mark."""
    return F.regexp_extract(v, rf"^([0-9]+){mark}", 1), F.regexp_replace(v, rf"^[0-9]+{mark}", "")


# -- Debian policy: non-digits and digits in turn; ~ before the end, the end before letters, letters before the rest
def _debian_part(s: Column) -> Column:
    chunks = F.filter(F.regexp_extract_all(s, F.lit("[^0-9]*[0-9]*"), F.lit(0)), lambda c: c != "")
    text = lambda c: F.concat(F.translate(F.regexp_extract(c, "^([^0-9]*)", 1), "~+-.:", "\u0001{|}~"), F.lit("\u0002"))
    return F.concat(F.flatten(F.transform(chunks, lambda c: F.array(text(c), _number(F.regexp_extract(c, "([0-9]*)$", 1))))), _texts("\u0002", "0" * _DIGITS))


def debian_key(version: Column) -> Column:
    epoch, rest = _epoch(version, ":")
    revision = F.regexp_extract(rest, r"-([^-]*)$", 1)
    return F.concat(F.array(_number(epoch)), _debian_part(F.regexp_replace(rest, r"-[^-]*$", "")), _debian_part(F.when(revision == "", "0").otherwise(revision)))


# -- Alpine: numbers, a letter, suffixes and a revision
_ALPINE_SUFFIXES = {"alpha": "1", "beta": "2", "pre": "3", "rc": "4", "": "5", "cvs": "6", "svn": "7", "git": "8", "hg": "9", "p": "a"}


def alpine_key(version: Column) -> Column:
    epoch, rest = _epoch(version, ":")
    numbers = F.split(F.regexp_extract(rest, r"^([0-9]+(?:\.[0-9]+)*)", 1), r"\.")
    # after the first, a number with leading zeros is a fraction and sorts before all others
    fraction = lambda x: F.concat(F.lit("4"), F.lpad((F.lit(10**_DIGITS - 1) - F.length(F.regexp_extract(x, "^(0+)", 1))).cast("string"), _DIGITS, "0"), _number(x))
    part = lambda x, i: F.when((i > 0) & x.rlike("^0[0-9]"), fraction(x)).otherwise(F.concat(F.lit("5"), _number(x)))
    suffixes = F.regexp_extract_all(rest, F.lit("_[a-z]+[0-9]*"), F.lit(0))
    ranks = F.create_map(*[F.lit(x) for pair in _ALPINE_SUFFIXES.items() for x in pair])
    rank = lambda s: F.coalesce(F.try_element_at(ranks, F.regexp_extract(s, "_([a-z]+)", 1)), F.concat(F.lit("b"), s))
    revision = F.regexp_extract(rest, "-r([0-9]+)$", 1)
    return F.concat(
        F.array(_number(epoch)), F.transform(numbers, part), F.array(F.lit("1"), F.regexp_extract(rest, r"^[0-9.]*([a-z]?)(?:[_~-]|$)", 1)),
        F.flatten(F.transform(suffixes, lambda s: F.array(rank(s), _number(F.regexp_extract(s, "([0-9]*)$", 1))))), F.array(F.lit("5"), F.when(revision == "", "").otherwise(F.concat(F.lit("1"), _number(revision)))),
    )


# -- PEP 440
_PEP = (
    r"^v?(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?([0-9]*))?"
    r"(-[0-9]+|[-_.]?(?:post|rev|r)[-_.]?[0-9]*)?([-_.]?dev[-_.]?[0-9]*)?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?$"
)


def pep440_key(version: Column) -> Column:
    """A text that is no version of PEP 440 sorts before all that are, by itself."""

    def key(v: Column) -> Column:
        group = lambda i: F.regexp_extract(v, _PEP, i)
        stage, post, dev, local = group(3), group(5), group(6), group(7)
        release = F.split(F.regexp_replace(group(2), r"(?:\.0+)+$", ""), r"\.")
        pre = F.when(stage.isin("a", "alpha"), "1").when(stage.isin("b", "beta"), "2").when(stage != "", "3").when((dev != "") & (post == ""), "0").otherwise("4")
        tail = lambda s: _number(F.regexp_extract(s, "([0-9]*)$", 1))
        piece = lambda x: F.when(x.rlike("^[0-9]+$"), F.concat(F.lit("2"), _number(x))).otherwise(F.concat(F.lit("1"), x))
        whole = F.concat(
            F.array(F.lit("1"), _number(group(1))), F.transform(release, lambda x: F.concat(F.lit("1"), _number(x))),
            F.array(F.lit("0"), pre, _number(group(4)), F.when(post == "", "0").otherwise(F.concat(F.lit("1"), tail(post))), F.when(dev == "", "1").otherwise(F.concat(F.lit("0"), tail(dev)))),
            F.when(local == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(local, "[-_.]"), piece)), _texts("0"),
        )
        return F.when(v.rlike(_PEP), whole).otherwise(F.array(F.lit("0"), v))

    return _let(F.lower(F.trim(version)), key)


# -- Maven: numbers and qualifiers behind dots, dashes or changes between digits and letters; what says nothing is cut off at the end and before dashes and qualifiers
_MAVEN = {"alpha": "1", "beta": "2", "milestone": "3", "rc": "4", "cr": "4", "snapshot": "5", "": "6", "sp": "7"}
_MAVEN_NOTHING = r"(?:[.-](?:0+|final|ga|release)(?![0-9a-z]))+(?=-|$|\.[a-z])"


def maven_key(version: Column) -> Column:
    low = F.regexp_replace(F.lower(version), "_", "-")
    for short, long in (("a", "alpha"), ("b", "beta"), ("m", "milestone")):
        low = F.regexp_replace(low, rf"(?<![a-z]){short}(?=[0-9])", f"{long}-")
    split = F.regexp_replace(F.regexp_replace(low, "(?<=[0-9])(?=[a-z])|(?<=[a-z])(?=[0-9])", "-"), r"(?<=[.-])(?=[.-])|^(?=[.-])", "0")
    tokens = F.regexp_extract_all(F.regexp_replace(F.concat(F.lit("."), split), _MAVEN_NOTHING, ""), F.lit(r"[.-][^.-]+"), F.lit(0))
    ranks = F.create_map(*[F.lit(x) for pair in _MAVEN.items() for x in pair])

    def token(t: Column) -> Column:
        word = F.substring(t, 2, F.lit(1 << 30))
        number = F.concat(F.when(t.startswith("-"), "9").otherwise("a"), _number(word))
        return F.when(word.rlike("^[0-9]+$"), number).otherwise(F.coalesce(F.try_element_at(ranks, word), F.concat(F.lit("8"), word)))

    return F.concat(F.transform(tokens, token), _texts("6"))


# -- Semantic Versioning, with any number of parts and absent ones as zero
def semver_key(version: Column) -> Column:
    v = F.regexp_replace(F.regexp_replace(version, "^[vV]", ""), r"\+.*$", "")
    core = F.split(F.regexp_replace(F.regexp_replace(v, "-.*$", ""), r"(?:\.0*)+$", ""), r"\.")
    field = lambda x: F.when(x.rlike("^[0-9]+$"), F.concat(F.lit("1"), _number(x))).otherwise(F.concat(F.lit("2"), x))
    pre = F.when(v.contains("-"), F.concat(F.transform(F.split(F.regexp_replace(v, "^[^-]*-", ""), r"\."), field), _texts("0"))).otherwise(_texts("3"))
    return F.concat(F.transform(core, lambda x: F.concat(F.lit("1"), _number(F.regexp_extract(x, "^([0-9]*)", 1)))), _texts("0"), pre)


def _kind(ecosystem: Column) -> Column:
    """The ecosystem without a release suffix such as in Alpine:v3.19."""
    return F.coalesce(F.lower(F.trim(F.regexp_replace(ecosystem, ":.*$", ""))), F.lit(""))


def version_key(ecosystem: Column, version: Column) -> Column:
    kind = _kind(ecosystem)
    return (
        F.when(version.isNull(), F.lit(None))
        .when(kind.isin("debian", "ubuntu", "deb", "dpkg"), debian_key(version))
        .when(kind.isin("alpine", "apk"), alpine_key(version))
        .when(kind.isin("pypi", "python"), pep440_key(version))
        .when(kind == "maven", maven_key(version))
        .otherwise(semver_key(version))
    )


def version_compare(ecosystem: Column, a: Column, b: Column) -> Column:
    """-1, 0 or 1; null if one of the versions is null."""
    order = lambda pair: F.when(pair["a"] < pair["b"], -1).when(pair["a"] > pair["b"], 1).when(pair["a"].isNotNull() & pair["b"].isNotNull(), 0)
    return _let(F.struct(version_key(ecosystem, a).alias("a"), version_key(ecosystem, b).alias("b")), order)


def version_in_range(ecosystem: Column, version: Column, expression: Column, key: Column | None = None) -> Column:
    """Comma-joined operator clauses, or one interval in brackets; an empty or missing expression always holds, a clause without version never.

    key: the version's key, where it is at hand.
    """
    mine = version_key(ecosystem, version) if key is None else key
    text = F.coalesce(F.trim(expression), F.lit(""))

    def clause(k: Column):
        def holds(c: Column) -> Column:
            op, bound = F.regexp_extract(c, "^(<=|>=|!=|<|>|==|=)?", 1), F.trim(F.regexp_replace(c, "^(<=|>=|!=|<|>|==|=)", ""))
            test = lambda b: F.when(op == "<", k < b).when(op == "<=", k <= b).when(op == ">", k > b).when(op == ">=", k >= b).when(op == "!=", k != b).otherwise(k == b)
            return F.when(bound == "", False).otherwise(_let(version_key(ecosystem, bound), test))

        return holds

    def interval(k: Column) -> Column:
        inner = F.regexp_replace(text, r"^.|.$", "")
        single = ~inner.contains(",")
        low, high = F.trim(F.regexp_extract(inner, "^([^,]*)", 1)), F.when(single, F.trim(inner)).otherwise(F.trim(F.regexp_replace(inner, "^[^,]*,", "")))
        above = _let(version_key(ecosystem, low), lambda b: F.when(single | text.startswith("["), k >= b).otherwise(k > b))
        below = _let(version_key(ecosystem, high), lambda b: F.when(single | text.endswith("]"), k <= b).otherwise(k < b))
        return ((low == "") | above) & ((high == "") | below)

    def inside(k: Column) -> Column:
        clauses = F.filter(F.transform(F.split(text, ","), lambda c: F.trim(c)), lambda c: c != "")
        return F.when(text == "", True).when(k.isNull(), F.lit(None)).when(text.rlike(r"^[\[(]"), (F.length(text) > 1) & interval(k)).otherwise(F.forall(clauses, clause(k)))

    return _let(mine, inside)


def version_affected(ecosystem: Column, version: Column, status: Column, introduced: Column, fixed: Column, expression: Column) -> Column:
    """Fixed bound, else range, else introduced bound, else true; a status of not-affected is false and a missing version null."""
    given = lambda c: F.coalesce((c != "") & (c != "0"), F.lit(False))

    def decide(k: Column) -> Column:
        return (
            F.when(F.coalesce(status == "not-affected", F.lit(False)), False)
            .when(k.isNull(), F.lit(None))
            .when(given(fixed), k < version_key(ecosystem, fixed))
            .when(F.coalesce(expression != "", F.lit(False)), version_in_range(ecosystem, version, expression, k))
            .when(given(introduced), k >= version_key(ecosystem, introduced))
            .otherwise(True)
        )

    return _let(version_key(ecosystem, version), decide)


def dotted_key(version: Column, strip_v: bool = True) -> Column:
    """The numbers that begin the dot-separated parts, as texts that sort by value, without zeros at the end; keys compare part by part."""
    v = F.regexp_replace(version, "^[vV]", "") if strip_v else version
    numbers = F.transform(F.split(v, r"\."), lambda x: _number(F.regexp_extract(x, "^([0-9]*)", 1)))
    last = lambda a: F.array_max(F.transform(a, lambda x, i: F.when(x != "0" * _DIGITS, i + 1).otherwise(0)))
    return F.when(version.isNotNull(), _let(numbers, lambda a: F.slice(a, F.lit(1), last(a))))
