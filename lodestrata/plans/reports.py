"""Queries of sinks, state, streams and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions.text import lines
from lodestrata.operators import findings as fop
from lodestrata.operators import rules as rop
from lodestrata.operators import taint
from lodestrata.operators.advisories import package_url
from lodestrata.plans import findings as fq
from lodestrata.session import table
from lodestrata.sinks import reports as rp
from lodestrata.streaming import state as st

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = (f, sql)
        return f

    return register


def _f(spark, d):
    return fop.base(table(spark, d, "findings"))


def _case(column: str, table_: dict, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + f" ELSE '{default}' END"


def _json(**fields: str) -> str:
    """SQL for a JSON object as text; a null field is left out. A name ending in _ holds JSON already."""
    parts = [f"""CASE WHEN ({v}) IS NOT NULL THEN ',"{k.rstrip('_')}":'||{f'({v})' if k.endswith('_') else f'to_json({v})::VARCHAR'} ELSE '' END""" for k, v in fields.items()]
    return "'{'||substr(" + "||".join(parts) + ",2)||'}'"


_RULE = "CASE WHEN rule_id<>'' THEN rule_id ELSE concat_ws('-',finding_type,analyzer) END"
_SEMANTIC, _LOCATION = (fq.HASH.format(x) for x in (f"concat_ws(chr(124),{fq.SUBJECT},analyzer,{fq.PATH},{fq.SNIPPET})", f"concat_ws(chr(124),{fq.SUBJECT},{fq.PATH},{fq.EVIDENCE},analyzer,{fq.LINE})"))
_REGION = f"CASE WHEN line_start>0 THEN {_json(startLine='line_start', endLine='CASE WHEN line_end>=line_start THEN line_end END')} END"
_PLACE = _json(physicalLocation_=_json(artifactLocation_=_json(uri="file_path"), region_=_REGION))
_PRINTS = f"""'{{"semantic/v1":"'||{_SEMANTIC}||'","location/v1":"'||{_LOCATION}||'"}}'"""
_SARIF = _json(ruleId=_RULE, level=_case("severity", rp.SARIF_LEVEL, "none"), message_=_json(text="title"), locations_=f"'['||{_PLACE}||']'", partialFingerprints_=_PRINTS)


def _documents(rows: str, item: str, order: str, head: str, tail: str) -> str:
    """SQL of (document_no, n, digest) of documents of 5,000 items."""
    return f"q AS (SELECT row_number() OVER (ORDER BY {order})-1 AS k, {item} AS item FROM {rows}) SELECT k//5000 AS document_no, count(*)::INTEGER AS n, sha256('{head}'||string_agg(item,',' ORDER BY k)||'{tail}') AS digest FROM q GROUP BY 1"


@query("o032_sarif_results", f"WITH {fq.BASE} SELECT id, {_RULE} AS rule, {_SARIF} AS result FROM f")
def _(spark, d):
    return rp.sarif_results(_f(spark, d))


@query("o032_sarif_documents", f"WITH {fq.BASE}, " + _documents("f", _SARIF, "id", '{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":"lodestrata","version":"1"}},"invocations":[{"executionSuccessful":true}],"results":[', "]}]}"))
def _(spark, d):
    """Each document by its number of results, parsed back, and its digest."""
    return rp.digests(rp.sarif_documents(_f(spark, d)), "$.runs[0].results")


_ENTRY = _json(id="id", finding_type="finding_type", analyzer="analyzer", severity="severity", confidence="confidence", title="title", file_path="file_path", line_start="line_start", rule_id="rule_id", cwe_id="cwe_id")


@query("o033_json_report", f"WITH {fq.BASE}, " + _documents("f", _ENTRY, "id", '{"findings":[', "]}"))
def _(spark, d):
    return rp.digests(rp.json_documents(_f(spark, d)), "$.findings")


@query("o033_markdown_report", f"WITH {fq.BASE}, c AS (SELECT CASE WHEN severity IN ('critical','high','medium','low','info') THEN severity ELSE 'other' END AS severity, count(*) AS n, min(CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 WHEN 'info' THEN 5 ELSE 6 END) AS o FROM f GROUP BY 1) SELECT '| severity | findings |'||chr(10)||'|-|-|'||chr(10)||string_agg('| '||severity||' | '||n||' |'||chr(10), '' ORDER BY o) AS report FROM c")
def _(spark, d):
    return spark.createDataFrame([(rp.markdown_summary(_f(spark, d)),)], "report string")


_QUALITY = _json(description="title", check_name=_RULE, fingerprint=_LOCATION, severity=_case("severity", rp.QUALITY_SEVERITY, "info"), location_=_json(path="file_path", lines_=_json(begin="greatest(coalesce(line_start,1),1)")))


@query("o034_code_quality", f"WITH {fq.BASE} SELECT id, {_QUALITY} AS entry FROM f")
def _(spark, d):
    return rp.code_quality(_f(spark, d))


_PURLS = "p AS (SELECT DISTINCT 'pkg:'||lower(split_part(ecosystem,':',1))||'/'||replace(package_name,'@','%40')||CASE WHEN coalesce(fixed_version,'')<>'' THEN '@'||fixed_version ELSE '' END AS purl, package_name AS name, nullif(fixed_version,'') AS version FROM affected_packages WHERE package_name IS NOT NULL)"


def _packages(spark, d):
    a = table(spark, d, "affected_packages").where("package_name is not null")
    return a.select(package_url(F.split("ecosystem", ":")[0], F.lit(""), F.col("package_name"), F.col("fixed_version")).alias("purl"), F.col("package_name").alias("name"), F.nullif("fixed_version", F.lit("")).alias("version"), F.lit("").alias("license"))


_COMPONENT = "'{\"type\":\"library\",\"bom-ref\":'||to_json(purl)::VARCHAR||',\"name\":'||to_json(name)::VARCHAR||CASE WHEN version IS NOT NULL THEN ',\"version\":'||to_json(version)::VARCHAR ELSE '' END||',\"purl\":'||to_json(purl)::VARCHAR||'}'"
_SPDX_ID = f"'SPDXRef-Package-'||{fq.HASH.format('purl')}"
_SPDX = _json(SPDXID=_SPDX_ID, name="name", versionInfo="version", downloadLocation="'NOASSERTION'", licenseConcluded="'NOASSERTION'", externalRefs_="'['||" + _json(referenceCategory="'PACKAGE-MANAGER'", referenceType="'purl'", referenceLocator="purl") + "||']'")


@query("o035_cyclonedx", f"WITH {_PURLS} SELECT purl AS bom_ref, {_COMPONENT} AS component FROM p")
def _(spark, d):
    return rp.components(_packages(spark, d))


@query("o035_cyclonedx_documents", f"WITH {_PURLS}, " + _documents("p", _COMPONENT, "purl", '{"bomFormat":"CycloneDX","specVersion":"1.5","version":1,"components":[', "]}"))
def _(spark, d):
    return rp.digests(rp.cyclonedx(_packages(spark, d)), "$.components")


@query("o036_spdx", f"WITH {_PURLS} SELECT {_SPDX_ID} AS spdx_id, {_SPDX} AS package FROM p")
def _(spark, d):
    return rp.spdx_packages(_packages(spark, d))


_STATE = "CASE status WHEN 'affected' THEN 'exploitable' WHEN 'not-affected' THEN 'not_affected' ELSE 'in_triage' END"
_VEX = _json(id="vuln_id", analysis_=_json(state=_STATE, justification="CASE WHEN status='not-affected' THEN 'code_not_reachable' END"), affects_="CASE WHEN package_name IS NULL THEN '[{}]' ELSE '['||" + _json(ref="package_name") + "||']' END")


@query("o037_vex", f"SELECT vuln_id, package_name AS purl, {_STATE} AS state, {_VEX} AS statement FROM affected_packages a JOIN vulnerabilities v ON v.id=a.vulnerability_id")
def _(spark, d):
    v = table(spark, d, "vulnerabilities").select(F.col("id").alias("vulnerability_id"), "vuln_id")
    reach = F.when(F.col("status") == "affected", "high").when(F.col("status") == "not-affected", "none").otherwise("unknown")
    a = table(spark, d, "affected_packages").join(v, "vulnerability_id").select("vuln_id", F.col("package_name").alias("purl"), reach.alias("reachability"))
    return rp.vex_statements(a)


_NOTE = _json(path="file_path", start_line="line_start", end_line="coalesce(line_end,line_start)", annotation_level=_case("severity", {"critical": "failure", "high": "failure", "medium": "warning"}, "notice"), message="title")


@query("o038_annotations", f"WITH {fq.BASE} SELECT id, {_NOTE} AS annotation FROM f WHERE severity IN ('critical','high') AND line_start>0 AND file_path<>''")
def _(spark, d):
    return rp.annotations(_f(spark, d).withColumn("in_diff", F.col("severity").isin("critical", "high")))


@query("o159_change_detection", "WITH s AS (SELECT finding_id AS path, coalesce(code,'') AS content FROM raw_findings WHERE severity<>'low'), f AS (SELECT finding_id AS path, CASE WHEN confidence='high' THEN coalesce(code,'')||'x' ELSE coalesce(code,'') END AS content FROM raw_findings) SELECT f.path, s.path IS NULL OR sha256(f.content)<>sha256(s.content) AS changed FROM f LEFT JOIN s USING (path)")
def _(spark, d):
    raw = table(spark, d, "raw_findings").select(F.col("finding_id").alias("path"), F.coalesce("code", F.lit("")).alias("content"), "severity", "confidence")
    old = raw.where("severity <> 'low'").select("path", F.sha2("content", 256).alias("sha256"), F.length("content").cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("mtime_ns"))
    new = raw.withColumn("content", F.when(F.col("confidence") == "high", F.concat("content", F.lit("x"))).otherwise(F.col("content")))
    files = new.select("path", "content", F.length("content").cast("bigint").alias("size"), F.lit(1).cast("bigint").alias("mtime_ns"))
    return st.detect_changes(files, old).select("path", "changed")


@query("o160_next_state", "SELECT finding_id AS path, sha256(coalesce(code,'')) AS sha256, 1::BIGINT AS size, 1::BIGINT AS mtime_ns FROM raw_findings")
def _(spark, d):
    raw = table(spark, d, "raw_findings")
    files = raw.select(F.col("finding_id").alias("path"), F.coalesce("code", F.lit("")).alias("content"), F.lit(1).cast("bigint").alias("size"), F.lit(1).cast("bigint").alias("mtime_ns"))
    return st.next_state(st.detect_changes(files, spark.createDataFrame([], "path long, sha256 string, size bigint, mtime_ns bigint"))).select("path", "sha256", "size", "mtime_ns")


@query("o161_ttl_cache", "SELECT event_type, count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOURS GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events")
    latest = e.agg(F.max("ts")).first()[0]
    return st.live_entries(e, F.lit(latest), 24, "ts").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("windowed_events", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1,2")
def _(spark, d):
    return st.windowed_counts(table(spark, d, "events"), "ts", "event_type")


@query("session_events", "WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTES OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTES AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, k")
def _(spark, d):
    return st.sessions(table(spark, d, "events"), "ts", "user_id")


@query("o168_rule_registry", "SELECT * FROM (VALUES ('SECRET-AWS-Access-Key-ID','high','CWE-798'),('SECRET-JWT-Token','high','CWE-798'),('SECRET-Heroku-API-Key','high','CWE-798'),('LS-PY-EVAL','high','CWE-94'),('LS-PY-PICKLE','high','CWE-502'),('LS-PY-SHELL','high','CWE-78'),('LS-ANY-LOG','low','CWE-532'),('CUSTOM-1','low','')) t(rule_id, severity, cwe)")
def _(spark, d):
    """Single rules of the registry, one of them added."""
    known = ("SECRET-AWS-Access-Key-ID", "SECRET-JWT-Token", "SECRET-Heroku-API-Key", "LS-PY-EVAL", "LS-PY-PICKLE", "LS-PY-SHELL", "LS-ANY-LOG", "CUSTOM-1")
    return rop.registry(spark, rop.custom_rules([{"id": "CUSTOM-1", "pattern": "x", "severity": "low"}])).where(F.col("rule_id").isin(*known)).select("rule_id", "severity", "cwe")


@query("o164_custom_rules", r"WITH l0 AS (SELECT finding_id, string_split_regex(code, '\r?\n') AS parts FROM raw_findings WHERE code IS NOT NULL), l AS (SELECT finding_id, unnest(parts) AS line FROM l0) SELECT finding_id, count(*) AS n FROM l WHERE regexp_matches(line,'timeout_seconds:\s*[5-9]\d\d') AND NOT regexp_matches(ltrim(line),'^(//|#|/\*|\*)') GROUP BY 1")
def _(spark, d):
    from lodestrata.operators.scan import pattern_scan

    rules = rop.custom_rules([{"id": "LONG-TIMEOUT", "pattern": r"timeout_seconds:\s*[5-9]\d\d"}])
    l = lines(table(spark, d, "raw_findings").where("code is not null"), "finding_id", "code").withColumn("language", F.lit(""))
    return pattern_scan(l, rules).groupBy("finding_id").agg(F.count(F.lit(1)).alias("n"))


def _python_files(spark, d):
    """A file for each row, whose names, line and flow follow from the row: a direct flow, a sanitized one, one through a call, or none, behind as many comment lines as id % 5."""
    i = F.col("finding_id").cast("string")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    direct = say("def f", i, "():\n    q", i, " = request.args['", i, "']\n    r = q", i, "\n    eval(r)\n")
    clean = say("def f", i, "():\n    q", i, " = literal_eval(input())\n    eval(q", i, ")\n")
    called = say("def g", i, "(x", i, "):\n    eval(x", i, ")\n\ndef f", i, "():\n    g", i, "(input())\n")
    code = F.when(F.col("severity") == "high", direct).when(F.col("severity") == "medium", clean).when(F.col("severity") == "low", called).otherwise(say("x", i, " = 1\n"))
    return table(spark, d, "raw_findings").select(F.concat(i, F.lit(".py")).alias("path"), F.concat(F.repeat(F.lit("# note\n"), (F.col("finding_id") % 5).cast("int")), code).alias("content"))


@query("o101_taint", "SELECT finding_id||'.py' AS path, (4+finding_id%5)::INTEGER AS line, 'TP-PY-EVAL' AS rule_id, 'medium' AS confidence FROM raw_findings WHERE severity='high' UNION ALL SELECT finding_id||'.py', (2+finding_id%5)::INTEGER, 'TP-PY-EVAL-IP', 'high' FROM raw_findings WHERE severity='low'")
def _(spark, d):
    """O103's hits through a call carry the suffix -IP."""
    return taint.taint_findings(_python_files(spark, d)).select("path", "line", "rule_id", "confidence")


@query("o098_python_nodes")
def _(spark, d):
    files = table(spark, d, "raw_findings").where("code is not null").select(F.col("finding_id").cast("string").alias("path"), F.col("code").alias("content"))
    return taint.python_nodes(files).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("o102_call_graph", "SELECT finding_id||'.py' AS path, 'f'||finding_id AS caller, 'eval' AS callee FROM raw_findings WHERE severity='high' UNION ALL SELECT finding_id||'.py', 'g'||finding_id, 'eval' FROM raw_findings WHERE severity='low' UNION ALL SELECT finding_id||'.py', 'f'||finding_id, 'g'||finding_id FROM raw_findings WHERE severity='low' UNION ALL SELECT finding_id||'.py', 'f'||finding_id, 'literal_eval' FROM raw_findings WHERE severity='medium'")
def _(spark, d):
    """Calls that a source or a parameter reaches."""
    return taint.call_graph(_python_files(spark, d))


_LINES = r"l0 AS (SELECT finding_id, string_split_regex(code, '\r?\n') AS parts FROM raw_findings WHERE code IS NOT NULL), l AS (SELECT finding_id, i AS line_no, parts[i] AS line FROM (SELECT finding_id, parts, unnest(range(1, len(parts)+1)) AS i FROM l0) WHERE NOT (i=len(parts) AND parts[i]=''))"
_FIXED = "CASE WHEN regexp_matches(line,'\\blog\\.debug\\(') THEN regexp_replace(line,'\\blog\\.debug\\(','log.trace(','g') WHEN contains(line,'.trim()') THEN replace(line,'.trim()','.strip()') WHEN regexp_matches(line,'\\bhttp://') THEN regexp_replace(line,'\\bhttp://','https://','g') END"


@query("o169_fixes", f"WITH {_LINES} SELECT finding_id, line_no::INTEGER AS line_no, line, {_FIXED} AS fixed_line FROM l WHERE {_FIXED} IS NOT NULL")
def _(spark, d):
    """The patches of three rules, the first that applies to a line."""
    l = lines(table(spark, d, "raw_findings").where("code is not null"), "finding_id", "code")
    rule = F.when(F.col("line").rlike(r"\blog\.debug\("), "LS-ANY-LOG").when(F.col("line").contains(".trim()"), "LS-ANY-TRIM").when(F.col("line").rlike(r"\bhttp://"), "LS-ANY-HTTP")
    return rop.proposed_fixes(l.withColumn("rule_id", rule)).where("fixed_line is not null").select("finding_id", "line_no", "line", "fixed_line")
