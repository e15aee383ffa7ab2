"""Filters, joins, reductions and rankings over findings.

Findings are rows of F3-like columns; `base` makes missing text empty so that the expressions
need no null handling. Every operator works on keys and pre-aggregates. The ordered folds
(`proximity_dedup`, `issue_groups`) run over the distinct lines of a file and rule, cut into
islands at gaps that nothing reaches across; islands are spread over the tasks and streamed
through in order, so none is gathered.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions import findings as fx
from lodestrata.functions.text import is_test_path, last_two_steps, normalize_path

_TEXTS = ("finding_type", "analyzer", "severity", "confidence", "title", "file_path", "cwe_id", "rule_id", "evidence", "recommendation", "owasp_category", "enforcement", "maturity")


def base(findings: DataFrame) -> DataFrame:
    """Missing text as empty, confidence and analyzer tidied."""
    texts = {c: F.coalesce(F.col(c), F.lit("")) for c in _TEXTS if c in findings.columns}
    out = findings.withColumns(texts)
    if "confidence" in out.columns:
        c = F.lower(F.trim("confidence"))
        out = out.withColumn("confidence", F.when(c.isin("hi", "high"), "high").when(c.isin("med", "medium"), "medium").when(c.isin("lo", "low"), "low").otherwise(""))
    if "analyzer" in out.columns:
        out = out.withColumn("analyzer", F.regexp_replace(F.regexp_replace(F.lower(F.trim("analyzer")), "_", "-"), "/.*$", ""))
    return out


def rule_key(rule: Column, title: Column) -> Column:
    """Rule without the TS- prefix; the title where there is none."""
    bare = F.regexp_replace(rule, "^TS-", "")
    return F.when(bare != "", bare).otherwise(title)


# -- filters ---------------------------------------------------------------------------------------
def changed_only(findings: DataFrame, changed: DataFrame, path: str = "file_path") -> DataFrame:
    """Rows whose path is in the set of changed paths; dependency findings pass on purpose."""
    keep = findings.where(F.col("finding_type") == "sca")
    return keep.unionByName(findings.where(F.col("finding_type") != "sca").join(changed.select(path).distinct(), path, "left_semi"))


def non_test(findings: DataFrame) -> DataFrame:
    return findings.where(~is_test_path(F.col("file_path")))


def without_overlaps(findings: DataFrame, owned: DataFrame, external: str = "ext-") -> DataFrame:
    """Drops rows of external analyzers whose rule the embedded engine owns."""
    ours, theirs = findings.where(~F.col("analyzer").startswith(external)), findings.where(F.col("analyzer").startswith(external))
    return ours.unionByName(theirs.join(owned.select("rule_id").distinct(), "rule_id", "left_anti"))


def active_in_profile(findings: DataFrame, governance: DataFrame, profile: str, floor: int) -> DataFrame:
    """Rules of at least a maturity that list the profile; unknown rules and dependency, secret and licence findings pass."""
    dim = governance.select("rule_id", ((F.col("maturity_rank") >= floor) & F.array_contains("profiles", profile)).alias("_active")).dropDuplicates(["rule_id"])
    exempt = F.col("finding_type").isin("sca", "secret", "iac", "license")
    return findings.join(dim, "rule_id", "left").where(exempt | F.coalesce("_active", F.lit(True))).drop("_active")


def downgraded(findings: DataFrame, ceilings: dict[str, str]) -> DataFrame:
    """Lowers, never raises, the severity of some rules."""
    severity = F.col("severity")
    for rule, ceiling in ceilings.items():
        lower = (F.col("rule_id") == rule) & (fx.severity_order(F.col("severity")) > fx.SEVERITY_ORDER[ceiling])
        severity = F.when(lower, ceiling).otherwise(severity)
    return findings.withColumn("severity", severity)


def not_withdrawn(advisories: DataFrame, summary: str = "summary", withdrawn: Column | None = None) -> DataFrame:
    low = F.lower(fx.text(summary))
    gone = low.rlike(r"^(withdrawn advisory|rejected)|\*\* reject \*\*")
    return advisories.where(~(gone | ((withdrawn.isNotNull() & (withdrawn != "")) if withdrawn is not None else F.lit(False))))


# -- joins -----------------------------------------------------------------------------------------
def resolved_modes(findings: DataFrame, overrides: DataFrame, project: DataFrame, maturity_modes: dict[str, str]) -> DataFrame:
    """Adds mode and mode_source: command line, else project, else the default of the maturity, else inform."""
    o = overrides.select("rule_id", F.col("mode").alias("_o")).dropDuplicates(["rule_id"])
    p = project.select("rule_id", F.col("mode").alias("_p")).dropDuplicates(["rule_id"])
    m = F.lit(None).cast("string")
    for k, v in maturity_modes.items():
        m = F.when(F.col("maturity") == k, v).otherwise(m)
    out = findings.join(o, "rule_id", "left").join(p, "rule_id", "left")
    source = F.when(F.col("_o").isNotNull(), "cli").when(F.col("_p").isNotNull(), "project").when(m.isNotNull(), "maturity").otherwise("default")
    return out.withColumns({"mode": F.coalesce("_o", "_p", m, F.lit("inform")), "mode_source": source}).drop("_o", "_p")


def unsuppressed(findings: DataFrame, directives: DataFrame) -> DataFrame:
    """Drops findings with a directive (path, line_no, rule_id or null for all rules) on their line or the one before."""
    d = directives.select(normalize_path(F.col("path")).alias("_path"), F.col("line_no").alias("_at"), F.col("rule_id").alias("_rule")).distinct()
    # two equality keys instead of an interval: each directive serves its line and the next
    d = d.select("_path", "_rule", F.explode(F.array(F.col("_at"), F.col("_at") + 1)).alias("_line")).distinct()
    f = findings.withColumn("_path", normalize_path(F.col("file_path")))
    hit = (f["_path"] == d["_path"]) & (f["line_start"] == d["_line"]) & (d["_rule"].isNull() | (d["_rule"] == f["rule_id"]))
    return f.join(d, hit, "left_anti").drop("_path")


def without_base_twins(findings: DataFrame) -> DataFrame:
    """Drops a finding when its rule with the suffix -IP reports the same place."""
    f = findings.withColumn("_file", last_two_steps(F.col("file_path")))
    ip = f.where(F.col("rule_id").endswith("-IP")).select(F.regexp_replace("rule_id", "-IP$", "").alias("rule_id"), "_file", "line_start").distinct()
    base_rows = f.where(~F.col("rule_id").endswith("-IP")).join(ip, ["rule_id", "_file", "line_start"], "left_anti")
    return base_rows.unionByName(f.where(F.col("rule_id").endswith("-IP"))).drop("_file")


def baseline_compare(current: DataFrame, baseline: DataFrame, fingerprint: str) -> DataFrame:
    """Current rows marked new or unchanged and baseline rows marked resolved; duplicates keep their number."""
    old, new = baseline.select(fingerprint).distinct(), current.select(fingerprint).distinct()
    marked = current.join(old.withColumn("_old", F.lit(True)), fingerprint, "left").withColumn("state", F.when(F.col("_old"), "unchanged").otherwise("new")).drop("_old")
    return marked.unionByName(baseline.join(new, fingerprint, "left_anti").withColumn("state", F.lit("resolved")), allowMissingColumns=True)


def placed_in_hunks(findings: DataFrame, hunks: DataFrame, bucket: int = 64) -> DataFrame:
    """Adds in_diff (any file hit) and in_hunk (new_start <= line < new_start + count); hunks: path, new_start, new_count.

    Hunks are cut into the buckets of lines they touch and joined on (file, bucket) with the distinct
    lines of the findings, so that a file with many of both isn't one task.
    """
    files = hunks.select(F.col("path").alias("file_path")).distinct().withColumn("in_diff", F.lit(True))
    first, last = F.col("new_start"), F.col("new_start") + F.col("new_count") - 1
    cut = hunks.where("new_count > 0").select(F.col("path").alias("file_path"), first.alias("_a"), last.alias("_b"), F.explode(F.sequence(F.floor(first / bucket), F.floor(last / bucket))).alias("_k"))
    lines = findings.where("line_start is not null").select("file_path", "line_start", F.floor(F.col("line_start") / bucket).alias("_k")).distinct()
    hit = lines.join(cut, ["file_path", "_k"]).where("line_start between _a and _b").select("file_path", "line_start").distinct().withColumn("in_hunk", F.lit(True))
    return findings.join(files, "file_path", "left").join(hit, ["file_path", "line_start"], "left").fillna(False, ["in_diff", "in_hunk"])


def enclosing_function(findings: DataFrame, boundaries: DataFrame) -> DataFrame:
    """As-of join: the last boundary (path, line_no, name) at or before each finding's line, by one sort per path."""
    events = findings.select(F.col("file_path").alias("_p"), F.col("line_start").alias("_l"), F.lit(1).alias("_k"), F.col("id"), F.lit(None).cast("string").alias("_name"))
    marks = boundaries.select(F.col("path").alias("_p"), F.col("line_no").alias("_l"), F.lit(0).alias("_k"), F.lit(None).cast(findings.schema["id"].dataType).alias("id"), F.concat("name", F.lit("@"), F.col("line_no").cast("string")).alias("_name"))
    w = W.partitionBy("_p").orderBy("_l", "_k").rowsBetween(W.unboundedPreceding, 0)
    seen = events.unionByName(marks).withColumn("function", F.last("_name", ignorenulls=True).over(w)).where("_k = 1")
    return findings.join(seen.select("id", "function"), "id", "left")


# -- reductions ------------------------------------------------------------------------------------
def semantic_dedup(findings: DataFrame, order: list[Column]) -> DataFrame:
    """The first row of each (rule, file, trimmed evidence) in the ascending order; rows without evidence all stay."""
    f = findings.withColumns({"_r": rule_key(F.col("rule_id"), F.col("title")), "_f": last_two_steps(F.col("file_path")), "_e": F.trim("evidence")})
    # the engine keeps the first row of each group in every task before the shuffle; rows without evidence aren't shuffled by it
    first = F.row_number().over(W.partitionBy("_r", "_f", "_e").orderBy(*order))
    return f.where("_e <> ''").withColumn("_n", first).where("_n = 1").drop("_n").unionByName(f.where("_e = ''")).drop("_r", "_f", "_e")


def _islands(lines: DataFrame, keys: list[str], line: str, reach: int) -> DataFrame:
    """Adds _island: lines of a key that no chain of steps of at most reach lines links are in different ones."""
    w = W.partitionBy(*keys).orderBy(line)
    opens = F.coalesce((F.col(line) - F.lag(line).over(w) > reach).cast("int"), F.lit(0))
    return lines.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_opens")


def _streamed(rows: DataFrame, keys: list[str], order: list[str], names: list[str], fold, schema: str) -> DataFrame:
    """Runs a function made by fold() for each island over its rows (tuples of the columns names) in order; tasks hold whole islands and stream them."""
    at = [names.index(k) for k in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                key = tuple(row[i] for i in at)
                if key != current:
                    current, state = key, fold()
                out.append(state(row))
            yield pd.DataFrame(out, columns=[c.split()[0].strip("`") for c in schema.split(", ")])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).select(*names).mapInPandas(run, schema)


def proximity_dedup(findings: DataFrame, order: list[Column], window: int = 5, priority: dict[str, int] | None = None) -> DataFrame:
    """(id, kept_id): greedy merging of reports of one file and rule within window lines of the first report's line.

    In the given order a row joins the nearest key line within the window (the smaller offset wins,
    later lines before earlier) or opens its own; the survivor of a key line has the higher
    confidence, then the analyzer of higher priority, then comes first.

    Key lines never vanish, so one can open only with the first row of its line. The ordered fold
    therefore runs over the distinct lines of an island, never over its rows, and a row then picks
    among the at most one key line on either side that had opened by its turn: key lines lie more
    than a window apart.
    """
    prio = F.lit(0)
    for k, v in (priority or {}).items():
        prio = F.when(F.col("analyzer") == k, v).otherwise(prio)
    f = findings.withColumn("line_start", F.coalesce("line_start", F.lit(0)))  # a missing line counts as 0
    f = f.withColumns({"_r": rule_key(F.col("rule_id"), F.col("title")), "_f": last_two_steps(F.col("file_path")), "_c": fx.confidence_order(F.col("confidence")), "_p": prio, "_o": F.struct(*order)})
    firsts = f.groupBy("_f", "_r", "line_start").agg(F.min("_o").alias("_first"))
    lines = _islands(firsts, ["_f", "_r"], "line_start", window)
    def fold():
        keys: set[int] = set()

        def step(row):
            line = row[3]
            is_key = not any(line + d in keys for d in range(-window, window + 1))
            if is_key:
                keys.add(line)
            return row[0], row[1], line, is_key

        return step

    opened = _streamed(lines, ["_f", "_r", "_island"], ["_first"], ["_f", "_r", "_island", "line_start"], fold, "_f string, _r string, line_start int, _is_key boolean")
    lines = lines.join(opened, ["_f", "_r", "line_start"])
    near = W.partitionBy("_f", "_r", "_island").orderBy("line_start")
    key = F.when(F.col("_is_key"), F.struct(F.col("line_start").alias("line"), F.col("_first").alias("first")))
    lines = lines.withColumns({"_below": F.max(key).over(near.rangeBetween(-window, 0)), "_above": F.max(key).over(near.rangeBetween(1, window))}).select("_f", "_r", "line_start", "_below", "_above")
    down = F.when(F.col("_below.first") <= F.col("_o"), F.col("line_start") - F.col("_below.line"))
    up = F.when(F.col("_above.first") <= F.col("_o"), F.col("_above.line") - F.col("line_start"))
    chosen = F.when(down.isNull() | (up <= down), F.col("_above.line")).otherwise(F.col("_below.line"))
    joined = f.join(lines, ["_f", "_r", "line_start"]).withColumn("_key", chosen).select("id", "_f", "_r", "_key", "_c", "_p", "_o")
    # the earliest of the best reports stays: later ones must be strictly better
    best = joined.groupBy("_f", "_r", "_key").agg(F.min(F.struct((-F.col("_c")).alias("c"), (-F.col("_p")).alias("p"), F.col("_o").alias("o"), F.col("id"))).alias("_b"))
    return joined.join(best.select("_f", "_r", "_key", F.col("_b.id").alias("kept_id")), ["_f", "_r", "_key"]).select("id", "kept_id")


def issue_groups(findings: DataFrame, boundaries: DataFrame | None = None, window: int = 10) -> DataFrame:
    """(id, issue_group_id, occurrence_count, primary_id, location): every finding and its group.

    A group holds the findings of one rule without -IP, path and function: the function named in the
    title, else the one of boundaries (path, line_no, name) that encloses the line. A finding without
    a function joins the group of the first finding of its rule and path, in the order of line and id,
    that lies at most window lines before it, else it opens one. The primary has the smallest line,
    then id; the other rows of a group are its related locations.
    """
    f = findings.withColumns({"_r": F.regexp_replace("rule_id", "-IP$", ""), "_f": normalize_path(F.col("file_path")), "_l": F.coalesce("line_start", F.lit(0)), "_fn": F.nullif(fx.function_name(F.col("title")), F.lit(""))})
    if boundaries is not None:
        f = enclosing_function(f, boundaries).withColumn("_fn", F.coalesce("_fn", "function")).drop("function")
    # the first row of each line decides which group later lines meet there
    lines = f.groupBy("_r", "_f", "_l").agg(F.min(F.struct("id", "_fn")).alias("_first"), F.count_if(F.col("_fn").isNull()).alias("_loose"))
    lines = _islands(lines, ["_r", "_f"], "_l", window).select("_r", "_f", "_island", "_l", F.col("_first._fn").alias("_fn"))

    def fold():
        held: deque = deque()  # (line, function of its first row, group of its rows without function)

        def step(row):
            line, name = row[3], row[4]
            while held and held[0][0] < line - window:
                held.popleft()
            group = (held[0][1] or held[0][2]) if held else (name or f"#{line}")
            held.append((line, name, group))
            return row[0], row[1], line, group

        return step

    groups = _streamed(lines, ["_r", "_f", "_island"], ["_l"], lines.columns, fold, "_r string, _f string, _l int, _near string")
    placed = f.join(groups, ["_r", "_f", "_l"], "left").withColumn("_g", F.coalesce("_fn", "_near"))
    every = placed.select("id", "_r", "_f", "_g", "_l", fx.issue_group_id().alias("_own"), F.concat(F.col("file_path"), F.lit(":"), F.col("_l").cast("string")).alias("location"))
    best = every.groupBy("_r", "_f", "_g").agg(F.count(F.lit(1)).alias("occurrence_count"), F.min(F.struct("_l", "id", "_own")).alias("_p"))
    group_id = F.when(F.col("_p._l") > 0, F.concat("_p._own", F.lit("-L"), F.col("_p._l").cast("string"))).otherwise(F.col("_p._own"))
    best = best.select("_r", "_f", "_g", group_id.alias("issue_group_id"), "occurrence_count", F.col("_p.id").alias("primary_id"))
    return every.join(best, ["_r", "_f", "_g"]).select("id", "issue_group_id", "occurrence_count", "primary_id", "location")


# -- aggregates ------------------------------------------------------------------------------------
def risk_points(findings: DataFrame, reachability: Column, *by: str, change: Column | None = None, sensitivity: Column | None = None) -> DataFrame:
    """Capped point sums and their score by the given keys (none: one row); each row's points are truncated before summing.

    change and sensitivity are points of the change, as aggregates (`change_points`, `sensitivity_points`); 0 without them.
    """
    kind, weight = F.col("finding_type"), fx.severity_weight(F.col("severity"))
    cut = lambda x: F.floor(x).cast("bigint")
    vuln = F.sum(F.when(kind == "sca", cut(weight * fx.reachability_weight(reachability) * F.lit(0.3))).otherwise(0))
    sast = F.sum(F.when(kind == "sast", cut(weight * F.lit(0.15))).otherwise(0))
    secret = F.sum(F.when(kind == "secret", 15).otherwise(0))
    bonus = F.sum(F.when((kind == "sca") & (reachability == "high"), 3).otherwise(0))
    capped = lambda x, most: F.least(F.coalesce(x, F.lit(0)), F.lit(most)).cast("bigint")
    out = findings.groupBy(*by).agg(capped(vuln, 50).alias("vulnerability_points"), capped(sast, 25).alias("sast_points"), capped(secret, 20).alias("secret_points"), capped(bonus, 10).alias("reachability_bonus"), capped(F.lit(0) if change is None else change, 15).alias("change_points"), capped(F.lit(0) if sensitivity is None else sensitivity, 15).alias("sensitivity_points"))
    total = F.col("vulnerability_points") + F.col("sast_points") + F.col("secret_points") + F.col("reachability_bonus") + F.col("change_points") + F.col("sensitivity_points")
    return out.withColumn("score", F.least(total, F.lit(100)).cast("bigint")).withColumn("level", fx.score_level(F.col("score")))


def finding_order(*tie: str, reachability: Column | None = None) -> list[Column]:
    """Severity, confidence and reachability downwards, then path and what else breaks ties."""
    reach = [fx.reachability_order(reachability).desc()] if reachability is not None else []
    return [fx.severity_order(F.col("severity")).desc(), fx.confidence_order(F.col("confidence")).desc(), *reach, F.col("file_path"), *map(F.col, tie)]


def sort_findings(findings: DataFrame, *tie: str, reachability: Column | None = None) -> DataFrame:
    return findings.orderBy(*finding_order(*tie, reachability=reachability))


def without_safe_functions(findings: DataFrame, boundaries: DataFrame, lines: DataFrame, safe: dict[str, str], path: str = "file_path") -> DataFrame:
    """Drops a taint finding when a line of its function matches the safe pattern of its rule.

    Boundaries (path, line_no, name) give each line and finding its function by an as-of lookup, so the
    interval join becomes an equality join on path, function and rule. Findings outside of functions stay.
    """
    marked = lines.select(F.monotonically_increasing_id().alias("id"), F.col("path").alias("file_path"), F.col("line_no").alias("line_start"), "line")
    rules = F.filter(F.array(*[F.when(F.col("line").rlike(p), F.lit(r)) for r, p in safe.items()]), lambda x: x.isNotNull())
    hits = marked.withColumn("rule_id", F.explode(rules))
    hits = enclosing_function(hits.withColumn("id", F.concat_ws(":", F.col("id").cast("string"), "rule_id")), boundaries).where("function is not null")
    f = enclosing_function(findings, boundaries)
    return f.join(hits.select("file_path", "function", "rule_id").distinct(), ["file_path", "function", "rule_id"], "left_anti").drop("function")
