"""Queries over findings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions import findings as fx
from lodestrata.functions.text import is_test_path, language, last_two_steps, normalize_path, normalize_snippet, redact, short_hash, slug
from lodestrata.operators import findings as op
from lodestrata.operators.ranking import global_rank
from lodestrata.session import table
from lodestrata.sinks import reports

QUERIES: dict = {}

#: Findings as the operators see them, for the SQL.
BASE = r"""f AS (SELECT id, coalesce(finding_type,'') finding_type, regexp_replace(replace(lower(trim(coalesce(analyzer,''))),'_','-'),'/.*$','') analyzer, coalesce(severity,'') severity,
 CASE WHEN lower(trim(confidence)) IN ('hi','high') THEN 'high' WHEN lower(trim(confidence)) IN ('med','medium') THEN 'medium' WHEN lower(trim(confidence)) IN ('lo','low') THEN 'low' ELSE '' END confidence,
 coalesce(title,'') title, coalesce(file_path,'') file_path, line_start, line_end, coalesce(cwe_id,'') cwe_id, coalesce(rule_id,'') rule_id, coalesce(evidence,'') evidence, coalesce(owasp_category,'') owasp_category,
 coalesce(enforcement,'') enforcement, coalesce(maturity,'') maturity, taint_path, detected_at FROM findings)"""
_PATH = r"lower(regexp_replace(regexp_replace(replace({0},'\','/'),'/(\.?/)+','/','g'),'^\./',''))"
_SNIPPET = r"lower(regexp_replace(regexp_replace({0},'^\s+|\s+$','','g'),'[ \t\n\r]+',' ','g'))"
_LAST2 = r"array_to_string(string_split(replace({0},'\','/'),'/')[-2:],'/')"
PATH, SNIPPET, EVIDENCE, LAST2 = _PATH.format("file_path"), _SNIPPET.format("coalesce(nullif(evidence,''),title)"), _SNIPPET.format("evidence"), _LAST2.format("file_path")
SUBJECT = "CASE WHEN rule_id<>'' THEN rule_id ELSE finding_type||':'||analyzer END"
LINE = "CASE WHEN line_start>0 THEN 'L'||line_start END"
HASH = "substr(sha256({0}),1,16)"
ORDER = "CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END"
WEIGHT = "CASE severity WHEN 'critical' THEN 100 WHEN 'high' THEN 75 WHEN 'medium' THEN 50 WHEN 'low' THEN 25 WHEN 'info' THEN 10 ELSE 0 END"
CONFIDENCE = "CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
TEST = r"(regexp_matches(replace(file_path,'\','/'),'(?i)(^|/)(tests?|__tests__|specs?)/') OR regexp_matches(replace(file_path,'\','/'),'(^|/)(test_[^/]*|[^/]*_test|[^/]*\.(test|spec))\.[a-z]+$'))"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = (f, sql)
        return f

    return register


def _f(spark, d):
    return op.base(table(spark, d, "findings"))


def _with(sql: str) -> str:
    return f"WITH {BASE} {sql}"


@query("o044_normalize_path", _with(f"SELECT id, {PATH} AS path FROM f"))
def _(spark, d):
    return _f(spark, d).select("id", normalize_path(F.col("file_path")).alias("path"))


@query("o045_normalize_snippet", _with(f"SELECT id, {SNIPPET} AS snippet FROM f"))
def _(spark, d):
    return _f(spark, d).select("id", normalize_snippet(F.when(F.col("evidence") != "", F.col("evidence")).otherwise(F.col("title"))).alias("snippet"))


@query("o046_short_hash", _with(f"SELECT id, {HASH.format('title')} AS hash FROM f"))
def _(spark, d):
    return _f(spark, d).select("id", short_hash(F.col("title")).alias("hash"))


@query("o047_semantic_fingerprint", _with(f"SELECT id, {HASH.format(f'concat_ws(chr(124),{SUBJECT},analyzer,{PATH},{SNIPPET})')} AS fingerprint FROM f"))
def _(spark, d):
    return _f(spark, d).select("id", fx.semantic_fingerprint().alias("fingerprint"))


@query("o048_location_fingerprint", _with(f"SELECT id, {HASH.format(f'concat_ws(chr(124),{SUBJECT},{PATH},{EVIDENCE},analyzer,{LINE})')} AS fingerprint FROM f"))
def _(spark, d):
    return _f(spark, d).select("id", fx.location_fingerprint().alias("fingerprint"))


_DEDUP = HASH.format(rf"concat_ws(chr(124),regexp_replace(rule_id,'-IP$',''),{PATH},{LINE},{EVIDENCE})")


@query("o049_dedup_fingerprint", _with(f"SELECT id, {_DEDUP} AS fingerprint FROM f"))
def _(spark, d):
    return _f(spark, d).select("id", fx.dedup_fingerprint().alias("fingerprint"))


_FN = r"regexp_extract(lower(title),' in ([a-z_][\w.]*)',1)"


@query("o050_issue_group_id", _with(f"SELECT id, {HASH.format(f'concat_ws(chr(124),regexp_replace(rule_id,{chr(39)}-IP${chr(39)},{chr(39)}{chr(39)}),{PATH},nullif({_FN},{chr(39)}{chr(39)}),taint_path[1])')} AS group_key FROM f"))
def _(spark, d):
    return _f(spark, d).select("id", fx.issue_group_id().alias("group_key"))


_SEMANTIC, _LOCATION = HASH.format(f"concat_ws(chr(124),{SUBJECT},analyzer,{PATH},{SNIPPET})"), HASH.format(f"concat_ws(chr(124),{SUBJECT},{PATH},{EVIDENCE},analyzer,{LINE})")
_OWN = HASH.format(f"concat_ws(chr(124),regexp_replace(rule_id,'-IP$',''),{PATH},nullif({_FN},''),taint_path[1])")


@query("o051_fill_fingerprints", _with(f"SELECT id, CASE WHEN severity='low' THEN 's'||id ELSE {_SEMANTIC} END AS semantic_fingerprint, {_LOCATION} AS location_fingerprint, CASE WHEN severity='high' THEN 'd'||id ELSE {_DEDUP} END AS dedup_fingerprint, {_OWN} AS issue_group_id FROM f"))
def _(spark, d):
    """Some rows come with a fingerprint, others with an empty one or none."""
    f = _f(spark, d).withColumns({"semantic_fingerprint": F.when(F.col("severity") == "low", F.concat(F.lit("s"), "id")).when(F.col("severity") == "info", ""), "dedup_fingerprint": F.when(F.col("severity") == "high", F.concat(F.lit("d"), "id"))})
    return fx.fill_fingerprints(f).select("id", "semantic_fingerprint", "location_fingerprint", "dedup_fingerprint", "issue_group_id")


@query("o052_ranks", _with(f"SELECT severity, confidence, {WEIGHT} AS weight, {ORDER} AS sort_order, {CONFIDENCE} AS confidence_rank, count(*) AS n FROM f GROUP BY 1,2,3,4,5"))
def _(spark, d):
    g = _f(spark, d).groupBy("severity", "confidence").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumns({"weight": fx.severity_weight(F.col("severity")), "sort_order": fx.severity_order(F.col("severity")), "confidence_rank": fx.confidence_order(F.col("confidence"))})


_DIM = ",".join(f"('{k}','{v}')" for k, v in fx.OWASP_OF_CWE.items())


_LABELS = ",".join(f"('{k}','{v}')" for k, v in {"A01": "Broken Access Control", "A02": "Cryptographic Failures", "A03": "Injection", "A04": "Insecure Design", "A05": "Security Misconfiguration", "A06": "Vulnerable and Outdated Components", "A07": "Identification and Authentication Failures", "A08": "Software and Data Integrity Failures", "A09": "Security Logging and Monitoring Failures", "A10": "Server-Side Request Forgery"}.items())


@query("o053_cwe_to_owasp", _with(f", g AS (SELECT coalesce(nullif(o.owasp,''), nullif(owasp_category,''), 'unmapped') AS owasp, count(*) AS n FROM f LEFT JOIN (VALUES {_DIM}) o(cwe, owasp) ON f.cwe_id=o.cwe GROUP BY 1) SELECT owasp, CASE WHEN l.name IS NULL THEN owasp ELSE owasp||':2021 - '||l.name END AS label, n FROM g LEFT JOIN (VALUES {_LABELS}) l(code, name) ON l.code=g.owasp"))
def _(spark, d):
    dim = spark.createDataFrame(list(fx.OWASP_OF_CWE.items()), "cwe_id string, _o string")  # a fixed table of some thirty rows
    g = _f(spark, d).join(F.broadcast(dim), "cwe_id", "left").groupBy(F.coalesce("_o", F.nullif("owasp_category", F.lit("")), F.lit("unmapped")).alias("owasp")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("owasp", fx.owasp_label(F.col("owasp")).alias("label"), "n")


@query("o056_slug", _with("SELECT DISTINCT title, regexp_replace(title,'[^a-zA-Z0-9]','-','g') AS slug FROM f"))
def _(spark, d):
    return _f(spark, d).select("title", slug(F.col("title")).alias("slug")).distinct()


_EXT = r"lower(regexp_extract(file_path,'(\.[^./\\]*)$',1))"


@query("o057_language", _with("SELECT language, count(*) AS n FROM (SELECT CASE " + _EXT + " " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in {".go": "go", ".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".rb": "ruby", ".php": "php", ".cs": "csharp"}.items()) + " ELSE 'unknown' END AS language FROM f) GROUP BY 1"))
def _(spark, d):
    return _f(spark, d).groupBy(language(F.col("file_path")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


@query("o077_score_level", _with(f"SELECT id, CASE WHEN w>=80 THEN 'critical' WHEN w>=60 THEN 'high' WHEN w>=40 THEN 'medium' WHEN w>=20 THEN 'low' ELSE 'minimal' END AS level FROM (SELECT id, {WEIGHT} AS w FROM f)"))
def _(spark, d):
    return _f(spark, d).select("id", fx.score_level(fx.severity_weight(F.col("severity"))).alias("level"))


# -- filters
@query("o078_changed_only", _with("SELECT id FROM f WHERE finding_type='sca' OR file_path IN (SELECT coalesce(file_path,'') FROM findings WHERE severity='critical')"))
def _(spark, d):
    f = _f(spark, d)
    return op.changed_only(f, f.where("severity = 'critical'").select("file_path")).select("id")


@query("o079_non_test", _with(f"SELECT count(*) AS kept FROM f WHERE NOT {TEST}"))
def _(spark, d):
    return op.non_test(_f(spark, d)).agg(F.count(F.lit(1)).alias("kept"))


@query("o004_test_paths", _with(f"SELECT id, {TEST} AS is_test FROM f"))
def _(spark, d):
    return _f(spark, d).select("id", is_test_path(F.col("file_path")).alias("is_test"))


@query("o080_without_overlaps", _with("SELECT id FROM f WHERE NOT (analyzer LIKE 'ext-%' AND rule_id IN (SELECT rule_id FROM f WHERE analyzer='gosast-embedded'))"))
def _(spark, d):
    f = _f(spark, d)
    return op.without_overlaps(f, f.where("analyzer = 'gosast-embedded'")).select("id")


@query("o081_min_confidence", _with(f"SELECT id FROM f WHERE {CONFIDENCE}>=2"))
def _(spark, d):
    return _f(spark, d).where(fx.confidence_order(F.col("confidence")) >= 2).select("id")


@query("o082_select", _with("SELECT id, rule_id, file_path FROM f WHERE severity IN ('high','critical') AND rule_id LIKE 'QX-PY%' AND file_path LIKE '%.py'"))
def _(spark, d):
    return _f(spark, d).where("severity in ('high','critical') and rule_id like 'QX-PY%' and file_path like '%.py'").select("id", "rule_id", "file_path")


_GOV = "g AS (SELECT rule_id, max(CASE maturity WHEN 'stable' THEN 3 WHEN 'beta' THEN 2 WHEN 'experimental' THEN 1 ELSE 0 END) AS mr, list(DISTINCT severity) AS profiles FROM f WHERE rule_id<>'' GROUP BY 1)"


@query("o083_profile", f"WITH {BASE}, {_GOV} SELECT f.id FROM f LEFT JOIN g USING (rule_id) WHERE finding_type IN ('sca','secret','iac','license') OR g.rule_id IS NULL OR (mr>=2 AND list_contains(profiles,'high'))")
def _(spark, d):
    f = _f(spark, d)
    rank = F.when(F.col("maturity") == "stable", 3).when(F.col("maturity") == "beta", 2).when(F.col("maturity") == "experimental", 1).otherwise(0)
    gov = f.where("rule_id <> ''").groupBy("rule_id").agg(F.max(rank).alias("maturity_rank"), F.collect_set("severity").alias("profiles"))
    return op.active_in_profile(f, gov, "high", 2).select("id")


@query("o084_mode_not_off", _with("SELECT enforcement, count(*) AS n FROM f WHERE enforcement<>'off' GROUP BY 1"))
def _(spark, d):
    return _f(spark, d).where("enforcement <> 'off'").groupBy("enforcement").agg(F.count(F.lit(1)).alias("n"))


@query("o085_fail_on", _with(f"SELECT count(*) FILTER ({ORDER}>=4) AS at_threshold, count(*) FILTER (enforcement='block') AS blocking, count(*) FILTER ({ORDER}>=4)>0 AS failed FROM f"))
def _(spark, d):
    hit = fx.severity_order(F.col("severity")) >= 4
    return _f(spark, d).agg(F.count_if(hit).alias("at_threshold"), F.count_if(F.col("enforcement") == "block").alias("blocking"), (F.count_if(hit) > 0).alias("failed"))


@query("o087_downgrade", _with("SELECT CASE WHEN rule_id='QX-JS031' AND severity IN ('critical','high','medium') THEN 'low' WHEN rule_id='QX-PY182' AND severity IN ('critical','high','medium','low') THEN 'info' ELSE severity END AS severity, count(*) AS n FROM f GROUP BY 1"))
def _(spark, d):
    return op.downgraded(_f(spark, d), {"QX-JS031": "low", "QX-PY182": "info"}).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


# -- joins
_MODES = "o AS (SELECT rule_id, 'block' AS m FROM f WHERE rule_id LIKE 'QX-GO%' GROUP BY 1), p AS (SELECT rule_id, 'off' AS m FROM f WHERE rule_id LIKE '%1' GROUP BY 1)"


@query("o114_mode_cascade", f"WITH {BASE}, {_MODES} SELECT coalesce(o.m, p.m, CASE maturity WHEN 'stable' THEN 'block' WHEN 'beta' THEN 'inform' END, 'inform') AS mode, CASE WHEN o.m IS NOT NULL THEN 'cli' WHEN p.m IS NOT NULL THEN 'project' WHEN maturity IN ('stable','beta') THEN 'maturity' ELSE 'default' END AS mode_source, count(*) AS n FROM f LEFT JOIN o USING (rule_id) LEFT JOIN p USING (rule_id) GROUP BY 1,2")
def _(spark, d):
    f = _f(spark, d)
    out = op.resolved_modes(f, f.where("rule_id like 'QX-GO%'").select("rule_id", F.lit("block").alias("mode")), f.where("rule_id like '%1'").select("rule_id", F.lit("off").alias("mode")), {"stable": "block", "beta": "inform"})
    return out.groupBy("mode", "mode_source").agg(F.count(F.lit(1)).alias("n"))


@query("o115_suppression", f"WITH {BASE}, s AS (SELECT DISTINCT {PATH} AS path, line_start-1 AS line_no, CASE WHEN severity='low' THEN NULL ELSE rule_id END AS rule_id FROM f WHERE confidence='low') SELECT f.id FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.path={_PATH.format('f.file_path')} AND s.line_no BETWEEN f.line_start-1 AND f.line_start AND (s.rule_id IS NULL OR s.rule_id=f.rule_id))")
def _(spark, d):
    f = _f(spark, d)
    s = f.where("confidence = 'low'").select(F.col("file_path").alias("path"), (F.col("line_start") - 1).alias("line_no"), F.when(F.col("severity") != "low", F.col("rule_id")).alias("rule_id"))
    return op.unsuppressed(f, s).select("id")


@query("o119_base_twins", f"WITH {BASE}, k AS (SELECT *, {LAST2} AS p2 FROM f) SELECT id FROM k WHERE rule_id LIKE '%-IP' OR NOT EXISTS (SELECT 1 FROM k i WHERE i.rule_id=k.rule_id||'-IP' AND i.p2=k.p2 AND i.line_start=k.line_start)")
def _(spark, d):
    return op.without_base_twins(_f(spark, d)).select("id")


_SEM = HASH.format(f"concat_ws(chr(124),{SUBJECT},analyzer,{PATH},{SNIPPET})")


@query("o120_baseline", f"WITH {BASE}, k AS (SELECT *, {_SEM} AS fp FROM f), cur AS (SELECT * FROM k WHERE severity<>'low'), old AS (SELECT * FROM k WHERE confidence<>'high') SELECT state, count(*) AS n FROM (SELECT CASE WHEN fp IN (SELECT fp FROM old) THEN 'unchanged' ELSE 'new' END AS state FROM cur UNION ALL SELECT 'resolved' FROM old WHERE fp NOT IN (SELECT fp FROM cur)) GROUP BY 1")
def _(spark, d):
    k = _f(spark, d).withColumn("fp", fx.semantic_fingerprint())
    return op.baseline_compare(k.where("severity <> 'low'"), k.where("confidence <> 'high'"), "fp").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("o117_hunks", f"WITH {BASE}, h AS (SELECT DISTINCT file_path AS path, (line_start//50)*50 AS new_start, 20 AS new_count FROM f WHERE severity='high') SELECT f.id, f.file_path IN (SELECT path FROM h) AS in_diff, EXISTS (SELECT 1 FROM h WHERE h.path=f.file_path AND f.line_start>=new_start AND f.line_start<new_start+new_count) AS in_hunk FROM f")
def _(spark, d):
    f = _f(spark, d)
    h = f.where("severity = 'high'").select(F.col("file_path").alias("path"), (F.floor(F.col("line_start") / 50) * 50).cast("int").alias("new_start"), F.lit(20).alias("new_count")).distinct()
    return op.placed_in_hunks(f, h).select("id", "in_diff", "in_hunk")


@query("o104_enclosing_function", f"WITH {BASE}, b AS (SELECT file_path AS path, line_start AS line_no, min({_FN}) AS name FROM f WHERE {_FN}<>'' AND confidence='high' GROUP BY 1,2) SELECT f.id, b.name||'@'||b.line_no AS function FROM f ASOF LEFT JOIN b ON f.file_path=b.path AND f.line_start>=b.line_no")
def _(spark, d):
    f = _f(spark, d)
    b = f.withColumn("n", fx.function_name(F.col("title"))).where("n <> '' and confidence = 'high'").groupBy(F.col("file_path").alias("path"), F.col("line_start").alias("line_no")).agg(F.min("n").alias("name"))
    return op.enclosing_function(f, b).select("id", "function")


@query("o116_safe_functions", f"WITH {BASE}, b AS (SELECT file_path AS path, line_start AS line_no, min({_FN}) AS name FROM f WHERE {_FN}<>'' AND confidence='high' AND line_start IS NOT NULL GROUP BY 1,2), p AS (SELECT f.id, f.rule_id, f.file_path, f.evidence, b.name||'@'||b.line_no AS fn FROM f ASOF LEFT JOIN b ON f.file_path=b.path AND f.line_start>=b.line_no), h AS (SELECT DISTINCT file_path, fn, r FROM p, (VALUES ('QX-JS031'),('QX-PY182')) v(r) WHERE fn IS NOT NULL AND (r='QX-JS031' AND contains(evidence,'(') OR r='QX-PY182' AND contains(evidence,'a'))) SELECT id FROM p WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.file_path=p.file_path AND h.fn=p.fn AND h.r=p.rule_id)")
def _(spark, d):
    """Findings of two rules go where any line of their function, here the evidence of some finding in it, holds a safe pattern."""
    f = _f(spark, d)
    b = f.withColumn("n", fx.function_name(F.col("title"))).where("n <> '' and confidence = 'high' and line_start is not null").groupBy(F.col("file_path").alias("path"), F.col("line_start").alias("line_no")).agg(F.min("n").alias("name"))
    l = f.select(F.col("file_path").alias("path"), F.col("line_start").alias("line_no"), F.col("evidence").alias("line"))
    return op.without_safe_functions(f, b, l, {"QX-JS031": r"\(", "QX-PY182": "a"}).select("id")


@query("o086_annotations", _with("SELECT id, file_path, line_start, severity FROM f WHERE line_start>0 AND file_path<>'' AND file_path IN (SELECT file_path FROM f WHERE severity='high')"))
def _(spark, d):
    f = _f(spark, d)
    return f.where("line_start > 0 and file_path <> ''").join(f.where("severity = 'high'").select("file_path").distinct(), "file_path", "left_semi").select("id", "file_path", "line_start", "severity")


@query("o123_expected_match", f"WITH {BASE}, e(exp) AS (VALUES ('QX-JS031'),('CWE-9001'),('cwe-9002'),('cwe-injection'),('missing')) SELECT e.exp AS expected, count(f.id) AS hits FROM e LEFT JOIN f ON f.rule_id=e.exp OR f.cwe_id=e.exp OR (starts_with(lower(e.exp),'cwe-') AND lower(f.cwe_id)=lower(e.exp)) GROUP BY 1")
def _(spark, d):
    """An expectation names a rule, or a weakness in any letter case."""
    e = spark.createDataFrame([(x,) for x in ("QX-JS031", "CWE-9001", "cwe-9002", "cwe-injection", "missing")], "expected string")
    folded = lambda c: F.when(F.lower(c).startswith("cwe-"), F.lower(c)).otherwise(c)
    keys = _f(spark, d).select(F.explode(F.array_distinct(F.array(F.col("rule_id"), folded(F.col("cwe_id"))))).alias("_k")).groupBy("_k").agg(F.count(F.lit(1)).alias("n"))
    return e.withColumn("_k", folded(F.col("expected"))).join(keys, "_k", "left").select("expected", F.coalesce("n", F.lit(0)).alias("hits"))


# -- aggregates
@query("o125_counts", _with("SELECT finding_type, severity, confidence, file_path, grouping(finding_type)*8+grouping(severity)*4+grouping(confidence)*2+grouping(file_path) AS level, count(*) AS n FROM f GROUP BY GROUPING SETS ((finding_type),(severity),(confidence),(file_path),())"))
def _(spark, d):
    # one pass with GROUPING SETS instead of a counter for each key
    f = _f(spark, d).select("finding_type", "severity", "confidence", "file_path")
    return f.groupingSets([["finding_type"], ["severity"], ["confidence"], ["file_path"], []], "finding_type", "severity", "confidence", "file_path").agg(F.grouping_id().cast("bigint").alias("level"), F.count(F.lit(1)).alias("n"))


_REACH = "CASE WHEN len(coalesce(taint_path,[]))>1 THEN 'high' WHEN len(coalesce(taint_path,[]))=1 THEN 'low' ELSE 'unknown' END"


_POINTS = f"""k AS (SELECT *, {WEIGHT} AS w, CASE finding_type WHEN 'sca' THEN 'sca' WHEN 'secret' THEN 'secret' ELSE 'sast' END AS t, {_REACH} AS reach FROM f),
 s AS (SELECT file_path, least(sum(CASE WHEN t='sca' THEN CAST(floor(CAST(w AS DOUBLE)*(CASE reach WHEN 'high' THEN 1.0::DOUBLE WHEN 'low' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END)*0.3::DOUBLE) AS BIGINT) ELSE 0 END),50)::BIGINT AS vulnerability_points,
 least(sum(CASE WHEN t='sast' THEN CAST(floor(CAST(w AS DOUBLE)*0.15::DOUBLE) AS BIGINT) ELSE 0 END),25)::BIGINT AS sast_points, least(sum(CASE WHEN t='secret' THEN 15 ELSE 0 END),20)::BIGINT AS secret_points,
 least(sum(CASE WHEN t='sca' AND reach='high' THEN 3 ELSE 0 END),10)::BIGINT AS reachability_bonus,
 (CASE WHEN sum(greatest(line_end-line_start+1,0))>1000 THEN 15 WHEN sum(greatest(line_end-line_start+1,0))>500 THEN 12 WHEN sum(greatest(line_end-line_start+1,0))>200 THEN 8 WHEN sum(greatest(line_end-line_start+1,0))>50 THEN 5 WHEN sum(greatest(line_end-line_start+1,0))>10 THEN 3 WHEN sum(greatest(line_end-line_start+1,0))>0 THEN 1 ELSE 0 END)::BIGINT AS change_points,
 (CASE WHEN contains(lower(file_path),'auth') OR contains(lower(file_path),'session') THEN 8 ELSE 0 END + CASE WHEN contains(file_path,'.yml') OR contains(file_path,'.yaml') THEN 5 ELSE 0 END)::BIGINT AS sensitivity_points FROM k GROUP BY file_path)"""


@query("o126_risk_score", f"WITH {BASE}, {_POINTS} SELECT *, least(vulnerability_points+sast_points+secret_points+reachability_bonus+change_points+sensitivity_points,100)::BIGINT AS score, CASE WHEN score>=80 THEN 'critical' WHEN score>=60 THEN 'high' WHEN score>=40 THEN 'medium' WHEN score>=20 THEN 'low' ELSE 'minimal' END AS level FROM s")
def _(spark, d):
    """By file; `risk_points` without keys gives one row for the whole table."""
    f = _f(spark, d).withColumn("finding_type", F.when(F.col("finding_type").isin("sca", "secret"), F.col("finding_type")).otherwise("sast"))
    n = F.size(F.coalesce("taint_path", F.array().cast("array<string>")))
    changed = fx.change_points(F.sum(F.greatest(F.col("line_end") - F.col("line_start") + 1, F.lit(0))), F.lit(1))
    touched = F.max(fx.sensitivity_points(F.lower("file_path").rlike("auth|session"), F.col("file_path").rlike(r"[.]ya?ml"), F.lit(False)))
    return op.risk_points(f, F.when(n > 1, "high").when(n == 1, "low").otherwise("unknown"), "file_path", change=changed, sensitivity=touched)


@query("o129_owasp_summary", _with("SELECT owasp_category, count(*) AS n, count(*) FILTER (severity='critical') AS critical, count(*) FILTER (severity='high') AS high, count(*) FILTER (severity='medium') AS medium, count(*) FILTER (severity='low') AS low FROM f WHERE owasp_category<>'' GROUP BY 1"))
def _(spark, d):
    n = lambda s: F.count_if(F.col("severity") == s).alias(s)
    return _f(spark, d).where("owasp_category <> ''").groupBy("owasp_category").agg(F.count(F.lit(1)).alias("n"), n("critical"), n("high"), n("medium"), n("low"))


@query("o132_rule_files", _with("SELECT rule_id, count(DISTINCT file_path) AS n_files, list_sort(list(DISTINCT substr(file_path,1,3))) AS heads FROM f GROUP BY 1"))
def _(spark, d):
    return _f(spark, d).groupBy("rule_id").agg(F.countDistinct("file_path").alias("n_files"), F.sort_array(F.collect_set(F.substring("file_path", 1, 3))).alias("heads"))


@query("o133_coverage", _with("SELECT maturity, analyzer, enforcement, grouping(maturity)*4+grouping(analyzer)*2+grouping(enforcement) AS level, count(DISTINCT rule_id) AS rules, count(*) AS n FROM f GROUP BY GROUPING SETS ((maturity),(analyzer),(enforcement),(maturity,enforcement),())"))
def _(spark, d):
    f = _f(spark, d).select("maturity", "analyzer", "enforcement", "rule_id")
    return f.groupingSets([["maturity"], ["analyzer"], ["enforcement"], ["maturity", "enforcement"], []], "maturity", "analyzer", "enforcement").agg(F.grouping_id().cast("bigint").alias("level"), F.countDistinct("rule_id").alias("rules"), F.count(F.lit(1)).alias("n"))


@query("o134_benchmark", _with("SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, CASE WHEN sum(tp)+sum(fp)=0 THEN 0 ELSE sum(tp)/(sum(tp)+sum(fp))::DOUBLE END AS precision, coalesce(avg(CASE WHEN tp+fp>0 THEN tp/(tp+fp)::DOUBLE END),0) AS mean_precision FROM (SELECT analyzer, count(*) FILTER (confidence='high') AS tp, count(*) FILTER (confidence='low') AS fp FROM f GROUP BY 1)"))
def _(spark, d):
    repo = _f(spark, d).groupBy("analyzer").agg(F.count_if(F.col("confidence") == "high").alias("tp"), F.count_if(F.col("confidence") == "low").alias("fp"))
    total = F.sum("tp") + F.sum("fp")
    return repo.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.when(total == 0, 0.0).otherwise(F.sum("tp") / total).alias("precision"), F.coalesce(F.avg(F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp")))), F.lit(0.0)).alias("mean_precision"))


@query("o137_reviewer_score", _with(f"SELECT reviewer, (10*count(DISTINCT file_path)+sum(lines))::BIGINT AS score, bool_or(owner) AS owner FROM (SELECT analyzer AS reviewer, file_path, count(*) AS lines, bool_or(severity='critical') AS owner FROM f WHERE analyzer<>'' GROUP BY 1,2) GROUP BY 1"))
def _(spark, d):
    blame = _f(spark, d).where("analyzer <> ''").groupBy(F.col("analyzer").alias("reviewer"), "file_path").agg(F.count(F.lit(1)).alias("lines"), F.bool_or(F.col("severity") == "critical").alias("owner"))
    return blame.groupBy("reviewer").agg((10 * F.count(F.lit(1)) + F.sum("lines")).alias("score"), F.bool_or("owner").alias("owner"))


# -- deduplication, ranking, grouping
_RULE = "CASE WHEN regexp_replace(rule_id,'^TS-','')<>'' THEN regexp_replace(rule_id,'^TS-','') ELSE title END"


_PRIORITY = "CASE WHEN analyzer IN ('treesitter-ast','taint-ssa','taint-patterns') THEN 3 WHEN analyzer IN ('gosast-embedded','secrets-embedded','patterns-embedded') THEN 2 ELSE 0 END"
#: The fold, line by line: the turns of an island's lines follow their first reports, and the key lines opened so far are carried on.
_FOLD = f"""x AS (SELECT id, {LAST2} AS p2, {_RULE} AS rule, coalesce(line_start,0) AS l, (file_path, coalesce(line_start,0), id) AS o, {CONFIDENCE} AS c, {_PRIORITY} AS pr FROM f),
 d AS (SELECT p2, rule, l, min(o) AS o FROM x GROUP BY 1,2,3), g AS (SELECT *, CASE WHEN l-lag(l) OVER (PARTITION BY p2, rule ORDER BY l)>5 THEN 1 ELSE 0 END AS opens FROM d), i AS (SELECT *, sum(opens) OVER (PARTITION BY p2, rule ORDER BY l) AS isl FROM g),
 t AS (SELECT *, row_number() OVER (PARTITION BY p2, rule, isl ORDER BY o) AS turn, count(*) OVER (PARTITION BY p2, rule, isl) AS n FROM i),
 k AS (SELECT p2, rule, isl, turn, n, [l] AS keys FROM t WHERE turn=1 UNION ALL SELECT t.p2, t.rule, t.isl, t.turn, t.n, CASE WHEN len(list_filter(k.keys, lambda y: abs(y-t.l)<=5))>0 THEN k.keys ELSE list_append(k.keys, t.l) END FROM k JOIN t ON t.p2=k.p2 AND t.rule=k.rule AND t.isl=k.isl AND t.turn=k.turn+1),
 e AS (SELECT p2, rule, unnest(keys) AS l FROM k WHERE turn=n), ef AS (SELECT e.*, d.o FROM e JOIN d USING (p2, rule, l)),
 m AS (SELECT x.*, ef.l AS key FROM x JOIN ef ON ef.p2=x.p2 AND ef.rule=x.rule AND abs(ef.l-x.l)<=5 AND ef.o<=x.o QUALIFY row_number() OVER (PARTITION BY x.id ORDER BY abs(ef.l-x.l), ef.l<x.l)=1)"""


@query("o140_proximity_dedup", f"WITH RECURSIVE {BASE}, {_FOLD} SELECT id, first_value(id) OVER (PARTITION BY p2, rule, key ORDER BY c DESC, pr DESC, o) AS kept_id FROM m")
def _(spark, d):
    f = _f(spark, d)
    order = [F.col("file_path"), F.coalesce("line_start", F.lit(0)), F.col("id")]
    return op.proximity_dedup(f, order, priority={"treesitter-ast": 3, "taint-ssa": 3, "taint-patterns": 3, "gosast-embedded": 2, "secrets-embedded": 2, "patterns-embedded": 2})


@query("o141_semantic_dedup", f"WITH {BASE}, k AS (SELECT id, trim(evidence) AS e, row_number() OVER (PARTITION BY {_RULE}, {LAST2}, trim(evidence) ORDER BY file_path, line_start, id) AS n FROM f) SELECT id FROM k WHERE e='' OR n=1")
def _(spark, d):
    return op.semantic_dedup(_f(spark, d), [F.col("file_path"), F.col("line_start"), F.col("id")]).select("id")


@query("o142_rule_normalise", _with(f"SELECT DISTINCT rule_id, regexp_replace(regexp_replace(rule_id,'^TS-',''),'-IP$','') AS bare, {LAST2} AS tail FROM f WHERE rule_id LIKE 'TS-%' OR rule_id LIKE '%-IP'"))
def _(spark, d):
    return _f(spark, d).where("rule_id like 'TS-%' or rule_id like '%-IP'").select("rule_id", F.regexp_replace("rule_id", "^TS-|-IP$", "").alias("bare"), last_two_steps(F.col("file_path")).alias("tail")).distinct()


_GROUPS = f"""k AS (SELECT id, regexp_replace(rule_id,'-IP$','') AS r, {PATH} AS p, nullif({_FN},'') AS fn, coalesce(line_start,0) AS l, file_path||':'||coalesce(line_start,0) AS location, {HASH.format(f"concat_ws(chr(124),regexp_replace(rule_id,'-IP$',''),{PATH},nullif({_FN},''),taint_path[1])")} AS own FROM f),
 lines AS (SELECT r, p, l, arg_min(coalesce(fn,''), id) AS first_fn, min(l) OVER (PARTITION BY r, p ORDER BY l RANGE BETWEEN 10 PRECEDING AND CURRENT ROW) AS near FROM k GROUP BY r, p, l),
 g AS (SELECT r, p, l, CASE WHEN first_fn<>'' THEN first_fn ELSE '#'||l END AS g FROM lines WHERE near=l UNION ALL SELECT x.r, x.p, x.l, CASE WHEN y.first_fn<>'' THEN y.first_fn ELSE g.g END FROM g JOIN lines x ON x.r=g.r AND x.p=g.p AND x.near=g.l AND x.near<x.l JOIN lines y ON y.r=g.r AND y.p=g.p AND y.l=g.l),
 e AS (SELECT k.*, coalesce(k.fn, g.g) AS grp FROM k LEFT JOIN g ON g.r=k.r AND g.p=k.p AND g.l=k.l),
 b AS (SELECT r, p, grp, count(*) AS occurrence_count, arg_min(own, (l, id)) AS own, min(l) AS l, arg_min(id, (l, id)) AS primary_id FROM e GROUP BY 1,2,3)"""


@query("o143_issue_groups", f"WITH RECURSIVE {BASE}, {_GROUPS} SELECT e.id, CASE WHEN b.l>0 THEN b.own||'-L'||b.l ELSE b.own END AS issue_group_id, b.occurrence_count, b.primary_id, e.location FROM e JOIN b ON b.r=e.r AND b.p=e.p AND b.grp=e.grp")
def _(spark, d):
    return op.issue_groups(_f(spark, d))


# -- sorts and top-k
_REACH_ORDER = f"CASE {_REACH} WHEN 'high' THEN 4 WHEN 'low' THEN 2 ELSE 1 END"


def _reach() -> Column:
    n = F.size(F.coalesce("taint_path", F.array().cast("array<string>")))
    return F.when(n > 1, "high").when(n == 1, "low").otherwise("unknown")


@query("o148_sorted", _with(f"SELECT id, row_number() OVER (ORDER BY {ORDER} DESC, {CONFIDENCE} DESC, {_REACH_ORDER} DESC, file_path, id) AS place FROM f"))
def _(spark, d):
    f = _f(spark, d).select("id", "severity", "confidence", "file_path", _reach().alias("reach"))
    return global_rank(f, op.finding_order("id", reachability=F.col("reach"))).select("id", "place")


@query("o149_top10", _with(f"SELECT id, severity FROM f ORDER BY {ORDER} DESC, {_REACH_ORDER} DESC, id LIMIT 10"))
def _(spark, d):
    return _f(spark, d).orderBy(fx.severity_order(F.col("severity")).desc(), fx.reachability_order(_reach()).desc(), "id").limit(10).select("id", "severity")


@query("o150_pr_top10", _with(f"SELECT id, severity, file_path FROM f WHERE enforcement='block' ORDER BY {ORDER} DESC, id LIMIT 10"))
def _(spark, d):
    return _f(spark, d).where("enforcement = 'block'").orderBy(fx.severity_order(F.col("severity")).desc(), "id").limit(10).select("id", "severity", "file_path")


@query("o151_top_reviewers", _with("SELECT analyzer AS name, count(*) AS score FROM f WHERE analyzer<>'' GROUP BY 1 ORDER BY score DESC, name LIMIT 3"))
def _(spark, d):
    return _f(spark, d).where("analyzer <> ''").groupBy(F.col("analyzer").alias("name")).agg(F.count(F.lit(1)).alias("score")).orderBy(F.desc("score"), "name").limit(3)


@query("o154_rule_search", _with("SELECT DISTINCT rule_id, title FROM f WHERE contains(lower(rule_id||chr(10)||title||chr(10)||severity||chr(10)||cwe_id||chr(10)||owasp_category),'xss') OR contains(lower(rule_id||chr(10)||title||chr(10)||severity||chr(10)||cwe_id||chr(10)||owasp_category),'a03')"))
def _(spark, d):
    """Rules whose id, title, severity, weakness or class holds one of two texts."""
    low = F.lower(F.concat_ws("\n", "rule_id", "title", "severity", "cwe_id", "owasp_category"))
    return _f(spark, d).where(low.contains("xss") | low.contains("a03")).select("rule_id", "title").distinct()


_STARTS = lambda t, default: "CASE " + " ".join(f"WHEN regexp_matches(b,'^({'|'.join(s.split())})') THEN '{v}'" for v, s in t) + f" ELSE '{default}' END"
_MADE = "r AS (SELECT DISTINCT rule_id AS rule, CASE id_no%9 WHEN 0 THEN 'TS-PY003' WHEN 1 THEN 'G201' WHEN 2 THEN 'SECRET-X' WHEN 3 THEN 'TP-JS004' WHEN 4 THEN 'G402' WHEN 5 THEN 'TS-G104' WHEN 6 THEN 'JS001' WHEN 7 THEN 'G306' ELSE rule_id END AS id, maturity, severity FROM (SELECT *, length(rule_id) + line_start AS id_no FROM f WHERE line_start IS NOT NULL))"


@query("o076_rule_metadata", f"WITH {BASE}, {_MADE}, c AS (SELECT DISTINCT id, regexp_replace(id,'^TS-','') AS b FROM r) SELECT id, {_STARTS((('secrets', 'SECRET-'), ('injection', 'G201 PY003 JS001 TP-'), ('error-handling', 'G104'), ('file-permissions', 'G306'), ('tls', 'G402')), 'general')} AS category, {_STARTS((('CWE-95', 'JS001'), ('CWE-78', 'PY003'), ('CWE-89', 'G201'), ('CWE-22', 'TP-JS004'), ('CWE-798', 'SECRET-'), ('CWE-755', 'G104'), ('CWE-732', 'G306'), ('CWE-295', 'G402')), '')} AS weakness FROM c")
def _(spark, d):
    """Category and weakness of rule ids; some rows get ids of the known kinds."""
    return _rules(spark, d).select("id").distinct().select("id", fx.rule_category(F.col("id")).alias("category"), fx.rule_weakness(F.col("id")).alias("weakness"))


def _rules(spark, d):
    k = (F.length("rule_id") + F.col("line_start")) % 9
    made = F.col("rule_id")
    for i, x in enumerate(("TS-PY003", "G201", "SECRET-X", "TP-JS004", "G402", "TS-G104", "JS001", "G306")):
        made = F.when(k == i, x).otherwise(made)
    return _f(spark, d).where("line_start is not null").select(made.alias("id"), "maturity", "severity").distinct()


_GRAVE, _FIRM = "severity IN ('high','critical')", "maturity IN ('stable','enterprise')"


@query("o167_profile_modes", f"WITH {BASE}, {_MADE}, m AS (SELECT DISTINCT id, maturity, severity, regexp_matches(regexp_replace(id,'^TS-',''),'^(G201|PY003|JS001|TP-)') AS inj FROM r) SELECT id, maturity, severity, p AS profile, CASE p WHEN 'audit' THEN 'inform' WHEN 'starter' THEN CASE WHEN {_FIRM} AND {_GRAVE} THEN 'block' END WHEN 'strict' THEN CASE WHEN {_FIRM} AND {_GRAVE} OR maturity='beta' AND {_GRAVE} AND inj THEN 'block' END WHEN 'ci-blocking' THEN CASE WHEN maturity='experimental' THEN 'off' WHEN {_GRAVE} THEN 'block' ELSE 'inform' END ELSE CASE WHEN maturity='experimental' THEN 'off' WHEN {_FIRM} AND {_GRAVE} THEN 'block' WHEN {_FIRM} THEN 'inform' END END AS mode FROM m, (VALUES ('audit'),('starter'),('strict'),('ci-blocking'),('enterprise')) x(p)")
def _(spark, d):
    mode = lambda p: F.struct(F.lit(p).alias("profile"), fx.profile_mode(p, F.col("maturity"), F.col("severity"), fx.rule_category(F.col("id"))).alias("mode"))
    return _rules(spark, d).select("id", "maturity", "severity", F.explode(F.array(*[mode(p) for p in ("audit", "starter", "strict", "ci-blocking", "enterprise")])).alias("x")).select("id", "maturity", "severity", "x.*")


# -- set operations
@query("o156_union_all", "SELECT origin, count(*) AS n FROM (SELECT 'sast' AS origin FROM findings UNION ALL SELECT 'raw' FROM raw_findings) GROUP BY 1")
def _(spark, d):
    a = table(spark, d, "findings").select(F.col("id"), F.lit("sast").alias("origin"))
    b = table(spark, d, "raw_findings").select(F.col("finding_id").cast("string").alias("id"), F.lit("raw").alias("origin"), "line_no")
    return a.unionByName(b, allowMissingColumns=True).groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


@query("o157_union_distinct", "SELECT rule_id FROM findings WHERE rule_id IS NOT NULL UNION SELECT rule_id FROM raw_findings WHERE rule_id IS NOT NULL")
def _(spark, d):
    return table(spark, d, "findings").select("rule_id").union(table(spark, d, "raw_findings").select("rule_id")).where("rule_id is not null").distinct()


@query("o158_except", "SELECT rule_id FROM findings WHERE rule_id IS NOT NULL EXCEPT SELECT rule_id FROM raw_findings")
def _(spark, d):
    return table(spark, d, "findings").select("rule_id").where("rule_id is not null").subtract(table(spark, d, "raw_findings").select("rule_id"))


@query("o158_intersect", "SELECT rule_id FROM findings WHERE rule_id IS NOT NULL INTERSECT SELECT rule_id FROM raw_findings WHERE rule_id IS NOT NULL")
def _(spark, d):
    return table(spark, d, "findings").select("rule_id").where("rule_id is not null").intersect(table(spark, d, "raw_findings").select("rule_id"))


@query("o097_pack_selection", "WITH det AS (SELECT DISTINCT split_part(rule_id,'-',2) AS pack FROM findings WHERE rule_id LIKE 'QF-%'), reg AS (SELECT DISTINCT split_part(rule_id,'-',2) AS pack FROM raw_findings WHERE rule_id LIKE 'QF-%') SELECT pack FROM (SELECT pack FROM det UNION SELECT 'EXTRA') WHERE pack NOT IN ('FLASK') INTERSECT SELECT pack FROM reg")
def _(spark, d):
    pack = F.split("rule_id", "-")[1].alias("pack")
    detected = table(spark, d, "findings").where("rule_id like 'QF-%'").select(pack).distinct()
    registered = table(spark, d, "raw_findings").where("rule_id like 'QF-%'").select(pack).distinct()
    enabled, disabled = spark.createDataFrame([("EXTRA",)], "pack string"), spark.createDataFrame([("FLASK",)], "pack string")
    return detected.union(enabled).distinct().join(F.broadcast(disabled), "pack", "left_anti").join(registered, "pack", "left_semi")


@query("o055_redact", r"""SELECT finding_id, regexp_replace(code, '([''"][a-zA-Z0-9+/=_\-])[a-zA-Z0-9+/=_\-]{18,}([a-zA-Z0-9+/=_\-][''"])', '\1[REDACTED]\2', 'g') AS evidence FROM raw_findings WHERE code IS NOT NULL""")
def _(spark, d):
    return table(spark, d, "raw_findings").where("code is not null").select("finding_id", redact(F.col("code")).alias("evidence"))


_REPO = "regexp_extract(replace(file_path,chr(92),'/'),'([^/]*[0-9]{7})/',1)"


@query("o127_change_points", _with(f"SELECT repo, least(CASE WHEN n>1000 THEN 15 WHEN n>500 THEN 12 WHEN n>200 THEN 8 WHEN n>50 THEN 5 WHEN n>10 THEN 3 WHEN n>0 THEN 1 ELSE 0 END + CASE WHEN files>20 THEN 5 WHEN files>10 THEN 3 WHEN files>5 THEN 1 ELSE 0 END, 15)::INTEGER AS points FROM (SELECT {_REPO} AS repo, sum(greatest(line_end-line_start+1,0)) AS n, count(DISTINCT file_path) AS files FROM f GROUP BY 1)"))
def _(spark, d):
    repo = F.regexp_extract(F.regexp_replace("file_path", r"\\", "/"), "([^/]*[0-9]{7})/", 1)
    g = _f(spark, d).groupBy(repo.alias("repo")).agg(F.sum(F.greatest(F.col("line_end") - F.col("line_start") + 1, F.lit(0))).alias("n"), F.countDistinct("file_path").alias("files"))
    return g.select("repo", fx.change_points(F.col("n"), F.col("files")).alias("points"))


@query("o043_text_table", _with("c AS (SELECT CASE WHEN severity IN ('critical','high','medium','low','info') THEN severity ELSE 'other' END AS severity, count(*) AS n FROM f GROUP BY 1), w AS (SELECT greatest(max(length(severity)), 8) AS w FROM c), o AS (SELECT row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 WHEN 'info' THEN 5 ELSE 6 END)+2 AS line_no, severity, n::VARCHAR AS n FROM c) SELECT line_no, rtrim(rpad(severity, w::INTEGER, ' ')||'  '||n) AS line FROM (SELECT * FROM o UNION ALL SELECT 1, 'severity', 'findings' UNION ALL SELECT 2, repeat('-', w::INTEGER), repeat('-', greatest(8, (SELECT max(length(n)) FROM o))::INTEGER) FROM w) CROSS JOIN w").replace("SELECT id", "SELECT id", 1).replace(" c AS", ", c AS", 1))
def _(spark, d):
    """The lines of the terminal table of the counts by severity."""
    text = reports.text_table(reports.severity_counts(_f(spark, d)))
    return spark.createDataFrame(list(enumerate(text.split("\n"), 1)), "line_no bigint, line string")
