"""Derived columns of findings: fingerprints, ranks, labels. Missing text counts as empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import normalize_path, normalize_snippet, short_hash


def text(name: str | Column) -> Column:
    return F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(""))


def _subject(rule: Column, kind: Column, analyzer: Column) -> Column:
    return F.when(rule != "", rule).otherwise(F.concat(kind, F.lit(":"), analyzer))


def semantic_fingerprint(kind="finding_type", analyzer="analyzer", rule="rule_id", path="file_path", evidence="evidence", title="title", package: Column | None = None, advisory: Column | None = None) -> Column:
    """Independent of lines: rule, analyzer, path, then package and advisory of dependencies or else the snippet."""
    snippet = F.when(text(evidence) != "", text(evidence)).otherwise(text(title))
    head = [_subject(text(rule), text(kind), text(analyzer)), text(analyzer), normalize_path(text(path))]
    plain = F.concat_ws("|", *head, normalize_snippet(snippet))
    if package is None:
        return short_hash(plain)
    sca = F.concat_ws("|", *head, F.nullif(package, F.lit("")), F.nullif(advisory, F.lit("")) if advisory is not None else F.lit(None).cast("string"))
    return short_hash(F.when(text(kind) == "sca", sca).otherwise(plain))


def location_fingerprint(kind="finding_type", analyzer="analyzer", rule="rule_id", path="file_path", evidence="evidence", line="line_start") -> Column:
    return short_hash(F.concat_ws("|", _subject(text(rule), text(kind), text(analyzer)), normalize_path(text(path)), normalize_snippet(text(evidence)), text(analyzer), F.when(F.col(line) > 0, F.concat(F.lit("L"), F.col(line).cast("string")))))


def dedup_fingerprint(rule="rule_id", path="file_path", evidence="evidence", line="line_start") -> Column:
    return short_hash(F.concat_ws("|", F.regexp_replace(text(rule), "-IP$", ""), normalize_path(text(path)), F.when(F.col(line) > 0, F.concat(F.lit("L"), F.col(line).cast("string"))), normalize_snippet(text(evidence))))


def function_name(title: Column) -> Column:
    """The word after the first `` in `` of a title, lower case; empty if there is none."""
    return F.regexp_extract(F.lower(text(title)), r" in ([a-z_][\w.]*)", 1)


def issue_group_id(rule="rule_id", path="file_path", title="title", taint="taint_path") -> Column:
    return short_hash(F.concat_ws("|", F.regexp_replace(text(rule), "-IP$", ""), normalize_path(text(path)), F.nullif(function_name(F.col(title)), F.lit("")), F.try_element_at(F.col(taint), F.lit(1))))


def fill_fingerprints(findings: DataFrame) -> DataFrame:
    """Sets semantic_fingerprint, location_fingerprint, dedup_fingerprint and issue_group_id where they are missing or empty."""
    made = {"semantic_fingerprint": semantic_fingerprint(), "location_fingerprint": location_fingerprint(), "dedup_fingerprint": dedup_fingerprint(), "issue_group_id": issue_group_id()}
    return findings.withColumns({k: F.coalesce(F.nullif(F.col(k), F.lit("")), v) if k in findings.columns else v for k, v in made.items()})


def _labelled(value: Column, table: dict, default) -> Column:
    out = F.lit(default)
    for k, v in reversed(table.items()):
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


SEVERITY_WEIGHT = {"critical": 100, "high": 75, "medium": 50, "low": 25, "info": 10}
SEVERITY_ORDER = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}
CONFIDENCE_RANK = {"high": 3, "medium": 2, "low": 1}
REACHABILITY_WEIGHT = {"high": 1.0, "medium": 0.7, "low": 0.3, "none": 0.0, "unknown": 0.5}


def severity_weight(c: Column) -> Column:
    return _labelled(c, SEVERITY_WEIGHT, 0)


def severity_order(c: Column) -> Column:
    """The scale for sorting, 5 to 1."""
    return _labelled(c, SEVERITY_ORDER, 0)


def severity_rank(c: Column) -> Column:
    """The scale for thresholds, 4 to 0."""
    return _labelled(c, SEVERITY_RANK, 0)


def confidence_order(c: Column) -> Column:
    return _labelled(c, CONFIDENCE_RANK, 0)


def reachability_weight(c: Column) -> Column:
    return _labelled(c, REACHABILITY_WEIGHT, 0.5)


def cvss_bucket(score: Column) -> Column:
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score > 0, "low").otherwise("unknown")


def severity_label(label: Column) -> Column:
    """Feed labels to the five severities; unknown for all else."""
    low = F.lower(F.trim(text(label)))
    return (
        F.when(low.isin("critical", "crit"), "critical").when(low.isin("high", "important", "severe", "error"), "high").when(low.isin("medium", "moderate", "med", "warning"), "medium")
        .when(low.isin("low", "minor", "note"), "low").when(low.isin("info", "informational", "negligible", "none"), "info").otherwise("unknown")
    )


def score_level(score: Column) -> Column:
    return F.when(score >= 80, "critical").when(score >= 60, "high").when(score >= 40, "medium").when(score >= 20, "low").otherwise("minimal")


#: OWASP classes of weaknesses (fixed values).
OWASP_OF_CWE = {
    "CWE-22": "A01", "CWE-79": "A03", "CWE-78": "A03", "CWE-89": "A03", "CWE-94": "A03", "CWE-90": "A03", "CWE-643": "A03", "CWE-352": "A01", "CWE-601": "A01", "CWE-284": "A01", "CWE-862": "A01", "CWE-863": "A01",
    "CWE-639": "A01", "CWE-327": "A02", "CWE-326": "A02", "CWE-328": "A02", "CWE-330": "A02", "CWE-295": "A02", "CWE-319": "A02", "CWE-611": "A05", "CWE-16": "A05", "CWE-489": "A05", "CWE-732": "A05",
    "CWE-1104": "A06", "CWE-287": "A07", "CWE-798": "A07", "CWE-384": "A07", "CWE-502": "A08", "CWE-829": "A08", "CWE-532": "A09", "CWE-778": "A09", "CWE-918": "A10",
}


#: Names of the OWASP classes of 2021 (fixed values).
OWASP_LABELS = {
    "A01": "Broken Access Control", "A02": "Cryptographic Failures", "A03": "Injection", "A04": "Insecure Design", "A05": "Security Misconfiguration", "A06": "Vulnerable and Outdated Components",
    "A07": "Identification and Authentication Failures", "A08": "Software and Data Integrity Failures", "A09": "Security Logging and Monitoring Failures", "A10": "Server-Side Request Forgery",
}


def owasp_label(code: Column) -> Column:
    """A03 as A03:2021 - Injection; other texts stay."""
    name = F.try_element_at(F.create_map(*[F.lit(x) for pair in OWASP_LABELS.items() for x in pair]), code)
    return F.when(name.isNotNull(), F.concat(code, F.lit(":2021 - "), name)).otherwise(code)


#: Reachability from the surest to none.
REACHABILITY_ORDER = {"high": 4, "medium": 3, "low": 2, "unknown": 1, "none": 0}


def reachability_order(c: Column) -> Column:
    return _labelled(c, REACHABILITY_ORDER, 1)


def change_points(lines: Column, files: Column) -> Column:
    """Points of a change by its lines, with a bonus for many files, at most 15."""
    base = F.when(lines > 1000, 15).when(lines > 500, 12).when(lines > 200, 8).when(lines > 50, 5).when(lines > 10, 3).when(lines > 0, 1).otherwise(0)
    bonus = F.when(files > 20, 5).when(files > 10, 3).when(files > 5, 1).otherwise(0)
    return F.least(base + bonus, F.lit(15))


def sensitivity_points(auth: Column, pipeline: Column, dependencies: Column) -> Column:
    """Points of touched areas (booleans), at most 15."""
    return F.least(F.when(auth, 8).otherwise(0) + F.when(pipeline, 5).otherwise(0) + F.when(dependencies, 4).otherwise(0), F.lit(15))


def in_scope(scope: Column, cwe: Column, category: Column) -> Column:
    """Whether a scoped source, sink or sanitizer applies: no scope fits all, else an equal weakness or category in any letter case."""
    s = F.upper(F.trim(text(scope)))
    return (s == "") | (s == F.upper(text(cwe))) | (s == F.upper(text(category)))


#: Beginnings of rule ids by category, in this order (fixed values).
RULE_CATEGORIES = (
    ("secrets", "SECRET- G101"), ("injection", "G701 G702 G703 G704 G705 G706 G707 G708 G709 G710 G201 G202 G204 PY001 PY002 PY003 PY004 PY005 JS001 JS002 TP-"), ("unsafe", "G103"),
    ("error-handling", "G104 G108 G109 G110 G111 G112"), ("crypto", "G115 G116 G117 G501 G601 G602"), ("file-permissions", "G301 G302 G306 G307"), ("tls", "G402"),
)
#: Beginnings of rule ids by weakness, in this order (fixed values).
RULE_WEAKNESSES = (
    ("CWE-95", "PY001 PY002 JS001 JS002"), ("CWE-78", "PY003 PY004"), ("CWE-502", "PY005 G710"), ("CWE-89", "G201 G202 G701 TP-PY001 TP-JS001"), ("CWE-78", "G204 G702 TP-PY002 TP-JS002"), ("CWE-22", "G703 G304 TP-PY003 TP-JS004"),
    ("CWE-918", "G704 TP-PY004 TP-JS005"), ("CWE-601", "G705 TP-JS006"), ("CWE-79", "G709 TP-PY006 TP-JS003"), ("CWE-1336", "G708"), ("CWE-117", "G706"), ("CWE-93", "G707"), ("CWE-798", "G101 SECRET-"),
    ("CWE-327", "G115 G116 G501 G601"), ("CWE-755", "G104"), ("CWE-732", "G301 G302 G306"), ("CWE-295", "G402"), ("CWE-1321", "TP-JS007"), ("CWE-758", "G103"),
)
#: What to do about a weakness.
ADVICE = {
    "CWE-95": "Parse data instead of running it.", "CWE-78": "Pass arguments as a list, without a shell.", "CWE-89": "Bind parameters; don't join input into SQL.", "CWE-22": "Resolve the path and keep it below its root.", "CWE-918": "Call listed hosts only.", "CWE-79": "Escape what is rendered.",
    "CWE-798": "Keep secrets outside the code and rotate this one.", "CWE-327": "Use a current algorithm.", "CWE-295": "Verify certificates.", "CWE-502": "Read untrusted data in a format without objects.", "CWE-755": "Handle the error.", "CWE-732": "Give files and folders to their owner only.",
    "CWE-601": "Redirect to listed targets only.", "CWE-117": "Strip line breaks from what is logged.", "CWE-1321": "Don't merge foreign keys into objects.", "CWE-758": "Do without unsafe memory access.",
}


def _by_beginning(rule: Column, table: tuple[tuple[str, str], ...], default: str) -> Column:
    bare = F.regexp_replace(text(rule), "^TS-", "")
    out = F.lit(default)
    for value, starts in reversed(table):
        out = F.when(bare.rlike("^(" + "|".join(starts.split()) + ")"), value).otherwise(out)
    return out


def rule_category(rule: Column) -> Column:
    """The category of a rule by the beginning of its id; general for all else."""
    return _by_beginning(rule, RULE_CATEGORIES, "general")


def rule_weakness(rule: Column) -> Column:
    """The weakness of a rule by the beginning of its id; empty for all else."""
    return _by_beginning(rule, RULE_WEAKNESSES, "")


def advice(weakness: Column) -> Column:
    return _labelled(weakness, ADVICE, "Review the finding.")


def profile_mode(profile: str, maturity: Column, severity: Column, category: Column) -> Column:
    """The mode that a profile gives a rule: block, inform or off, null where it gives none."""
    grave, stable = F.lower(severity).isin("high", "critical"), maturity.isin("stable", "enterprise")
    block = F.when(stable & grave, "block")
    if profile == "audit":
        return F.lit("inform")
    if profile == "strict":
        return block.when((maturity == "beta") & grave & category.isin("injection", "auth"), "block")
    if profile == "ci-blocking":
        return F.when(maturity == "experimental", "off").when(grave, "block").otherwise("inform")
    if profile == "enterprise":
        return F.when(maturity == "experimental", "off").when(stable & grave, "block").when(stable, "inform")
    if profile in ("starter", "framework-heavy"):
        return block
    raise ValueError(f"no profile {profile}")
