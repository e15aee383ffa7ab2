"""Queries over code lines and texts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import text as tx
from lodestrata.operators import scan
from lodestrata.operators.advisories import best_licence, normalise_licence_text
from lodestrata.session import table

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = (f, sql)
        return f

    return register


_Q = chr(39)
LINES = r"""l0 AS (SELECT finding_id, file_path, string_split_regex(code, '\r?\n') AS parts FROM raw_findings WHERE code IS NOT NULL), l1 AS (SELECT finding_id, file_path, unnest(parts) AS line, generate_subscripts(parts,1) AS line_no, len(parts) AS n FROM l0),
 l AS (SELECT finding_id, file_path, line, line_no FROM l1 WHERE NOT (line_no=n AND line=''))"""
_COMMENT = r"regexp_matches(ltrim(line),'^(//|#|/\*|\*)')"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _lines(spark, d):
    rows = table(spark, d, "raw_findings").where("code is not null")
    return tx.lines(rows, "finding_id", "code")


@query("o006_lines", f"WITH {LINES} SELECT finding_id, line_no::INTEGER AS line_no, line FROM l")
def _(spark, d):
    return _lines(spark, d)


@query("o135_line_counts", f"WITH {LINES} SELECT regexp_extract(file_path,'(\\.[^./]*)$',1) AS ext, count(*) AS lines, count(*) FILTER (trim(line)<>'') AS code_lines FROM l GROUP BY 1")
def _(spark, d):
    raw = table(spark, d, "raw_findings").where("code is not null").select("finding_id", tx.extension(F.col("file_path")).alias("ext"), "code")
    parts = F.split("code", r"\r?\n", -1)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    # counted within each row: no explode, no shuffle but for the sums
    return raw.select("ext", F.size(kept).alias("n"), F.size(F.filter(kept, lambda x: F.trim(x) != "")).alias("c")).groupBy("ext").agg(F.sum("n").alias("lines"), F.sum("c").alias("code_lines"))


_VALUE = "regexp_replace(trim(substr(m, CASE WHEN contains(m,'=') THEN instr(m,'=') ELSE instr(m,':') END+1)), '^[\"'']+|[\"'']+$', '', 'g')"
_FALSE = (
    "(regexp_matches(lower(m),'example|placeholder|your-|xxx|yyy|zzz|test-key|dummy|sample|changeme|todo') OR ((contains(m,'=') OR contains(m,':')) AND (starts_with(" + _VALUE + ",'$') OR regexp_replace(lower(" + _VALUE + "),'[•* ]','','g')='' OR regexp_matches(lower(" + _VALUE + "),'password|passwort|mot de passe|كلمة المرور|كلمة مرور|at least|confirm|current|new |forgot|nouveau|caracteres|caractères|characters|zeichen|أحرف'))))"
)
_SECRETS = " UNION ALL ".join(
    f"SELECT finding_id, line_no::INTEGER AS line_no, '{r.rule_id}' AS rule_id, m FROM (SELECT finding_id, line_no, " + (f"CASE WHEN {_COMMENT} THEN 1 ELSE 0 END AS c, unnest(CASE WHEN {_COMMENT} THEN regexp_extract_all(line,{_quoted(r.pattern)})[1:1] ELSE regexp_extract_all(line,{_quoted(r.pattern)}) END) AS m FROM l) WHERE c=1 OR NOT {_FALSE}" if "Private-Key" in r.rule_id else f"unnest(regexp_extract_all(line,{_quoted(r.pattern)})) AS m FROM l WHERE NOT {_COMMENT}) WHERE NOT {_FALSE}")
    for r in scan.secret_rules()
)


@query("o090_secret_scan", f"WITH {LINES} SELECT finding_id, line_no, rule_id, m AS match FROM ({_SECRETS})")
def _(spark, d):
    return scan.secret_scan(_lines(spark, d)).select("finding_id", "line_no", "rule_id", "match")


_KEYWORD = "regexp_matches(lower(line),'" + "|".join(tx.SECRET_KEYWORDS) + "')"
_STRINGS = f"""SELECT finding_id, line_no::INTEGER AS line_no, value, list_aggregate(string_split(value,''),'entropy') AS entropy FROM (SELECT finding_id, line_no, unnest(regexp_extract_all(line, '[''"]([a-zA-Z0-9+/=_\\-]{{20,}})[''"]', 1)) AS value FROM l WHERE {_KEYWORD} AND NOT {_COMMENT})"""


@query("o091_entropy_scan", f"WITH {LINES}, s AS ({_STRINGS}) SELECT finding_id, line_no, value FROM s WHERE entropy>=4.5")
def _(spark, d):
    return scan.entropy_scan(_lines(spark, d)).select("finding_id", "line_no", "value")


@query("o054_entropy", f"WITH {LINES}, s AS ({_STRINGS}) SELECT finding_id, line_no, value, round(entropy,6) AS entropy FROM s")
def _(spark, d):
    return scan.entropy_scan(_lines(spark, d), threshold=0.0).select("finding_id", "line_no", "value", F.round("entropy", 6).alias("entropy"))


@query("o060_comments", f"WITH {LINES} SELECT finding_id, line_no::INTEGER AS line_no FROM l WHERE {_COMMENT}")
def _(spark, d):
    return _lines(spark, d).where(tx.is_comment(F.col("line"))).select("finding_id", "line_no")


_ASSIGN = r"""(regexp_matches(line,'(^|[^=!<>:+\-*/])=([^=>]|$)') OR regexp_matches(line,'^\s*["'']?[A-Za-z_][\w.-]*["'']?\s*:\s+\S'))"""


@query("o061_assignments", f"WITH {LINES} SELECT finding_id, line_no::INTEGER AS line_no FROM l WHERE {_ASSIGN}")
def _(spark, d):
    return _lines(spark, d).where(tx.is_assignment(F.col("line"))).select("finding_id", "line_no")


@query("o062_secret_keywords", f"WITH {LINES} SELECT count(*) AS n, count(DISTINCT finding_id) AS files FROM l WHERE {_KEYWORD}")
def _(spark, d):
    return _lines(spark, d).where(tx.has_secret_keyword(F.col("line"))).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("finding_id").alias("files"))


_BARE = r"""regexp_replace(line, '''(?:[^''\\]|\\.)*''|"(?:[^"\\]|\\.)*"|`(?:[^`\\]|\\.)*`', '', 'g')"""
_EXTENSION = {".py": "python", ".js": "javascript", ".ts": "typescript", ".go": "go", ".java": "java"}
_LANGUAGE = "CASE regexp_extract(file_path,'(\\.[^./]*)$',1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _EXTENSION.items()) + " ELSE 'other' END"


def _rule_sql(r: scan.Rule) -> str:
    tests = [f"NOT {_COMMENT}", "NOT inside", f"regexp_matches(line,{_quoted(r.pattern)})"]
    tests += ["(" + " OR ".join(f"regexp_matches(file_path,{_quoted(scan.glob_pattern(g))})" for g in r.globs) + ")"] if r.globs else []
    tests += [f"language IN ({','.join(map(_quoted, r.languages))})"] if r.languages else []
    tests += [_ASSIGN] if r.requires_assignment else []
    tests += [f"regexp_matches({_BARE},{_quoted(r.pattern)})"] if r.skip_quotes else []
    tests += [f"NOT regexp_matches(line,{_quoted(c)})" for c in (*r.safe, *r.sanitizers)]
    return f"SELECT finding_id, line_no::INTEGER AS line_no, '{r.rule_id}' AS rule_id FROM g WHERE " + " AND ".join(tests)


def _with_language(spark, d):
    lang = F.lit("other")
    for k, v in _EXTENSION.items():
        lang = F.when(tx.extension(F.col("file_path")) == k, v).otherwise(lang)
    raw = table(spark, d, "raw_findings").where("code is not null").select(F.struct("finding_id", "file_path").alias("k"), lang.alias("_language"), "code")
    return scan.code_lines(raw, "k", "code", F.col("_language")).select("k.finding_id", "k.file_path", "language", "line_no", "line", "inside")


#: Lines inside a multi-line string: behind an odd number of lines with an odd number of its marks, and without one themselves.
_CONTEXT = """c0 AS (SELECT *, CASE WHEN language='python' THEN '\"\"\"' WHEN language IN ('javascript','typescript','go') THEN '`' END AS mark FROM g0), c1 AS (SELECT *, coalesce(((length(line)-length(replace(line,mark,'')))/length(mark))::INTEGER,0) AS marks FROM c0),
 g AS (SELECT *, marks=0 AND coalesce(sum(marks%2) OVER (PARTITION BY finding_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)%2=1 AS inside FROM c1)"""
_GL = f"WITH {LINES}, g0 AS (SELECT *, {_LANGUAGE} AS language FROM l), {_CONTEXT} "


@query("o092_pattern_scan", _GL + " UNION ALL ".join(_rule_sql(r) for r in scan.LINE_RULES))
def _(spark, d):
    return scan.pattern_scan(_with_language(spark, d), scan.LINE_RULES).select("finding_id", "line_no", "rule_id")


#: Lines for each suppression: what matches and what it cancels (fixed values of the query).
_SUPPRESSED = {
    "safe-loader": r"regexp_matches(line,'SafeLoader|safe_load')", "insecure-off": r"regexp_matches(line,'insecure ?= ?False')", "package-file": r"regexp_matches(line,'__init__\.py|__pycache__|conftest\.py')",
    "no-query": r"(contains(lower(line),'import') AND contains(lower(line),' from')) OR NOT regexp_matches(lower(line),'query|execute|sql|statement|sequelize|knex|prisma|db\.')",
    "static-command": r"""NOT contains(line,'+') AND NOT contains(line,'${') AND regexp_matches(line,'(?i)\bexec\s*\(\s*[''"][^''"]+[''"]\s*\)')""",
    "key-name": r"""contains(regexp_extract(line,'=\s*[rbuf]?[''"]([^''"]*)[''"]',1),'%(') OR regexp_matches(regexp_extract(line,'=\s*[rbuf]?[''"]([^''"]*)[''"]',1),'^[a-z_\- ]+$')""",
    "label": r"""regexp_matches(line,'(?i)(?:password|passwd|pwd|secret|api_key|apikey)\s*[:=]\s*[''"][^''"]*[''"]') AND (regexp_replace(lower(trim(regexp_extract(line,'(?i)(?:password|passwd|pwd|secret|api_key|apikey)\s*[:=]\s*[''"]([^''"]*)[''"]',1))),'[•* ]','','g')='' OR regexp_matches(lower(trim(regexp_extract(line,'(?i)(?:password|passwd|pwd|secret|api_key|apikey)\s*[:=]\s*[''"]([^''"]*)[''"]',1))),'password|passwort|mot de passe|كلمة المرور|كلمة مرور|at least|confirm|current|new |forgot|nouveau|caracteres|caractères|characters|zeichen|أحرف'))""",
}


@query("o063_suppressions", f"WITH {LINES} " + " UNION ALL ".join(f"SELECT '{k}' AS suppression, count(*) FILTER ({v}) AS n FROM l" for k, v in _SUPPRESSED.items()))
def _(spark, d):
    l = _lines(spark, d)
    counts = l.agg(*[F.count_if(scan.SUPPRESSIONS[k](F.col("line"))).alias(k) for k in _SUPPRESSED])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("suppression"), F.col(f"`{k}`").alias("n")) for k in _SUPPRESSED])).alias("x")).select("x.*")


@query("o059_quote_mask", f"WITH {LINES} SELECT finding_id, line_no::INTEGER AS line_no, length(line)::INTEGER AS n, (length(line)-length({_BARE}))::INTEGER AS quoted FROM l")
def _(spark, d):
    """Length of each line and its quoted characters; the mask keeps all offsets."""
    mask = scan.quote_mask(F.col("line"))
    return _lines(spark, d).select("finding_id", "line_no", F.length(mask).alias("n"), (F.length(mask) - F.length(F.replace(mask, F.lit("\u0000")))).alias("quoted"))


_FRAMEWORK = [scan.Rule("FW-SQL-CONCAT", r"\bexec\w*\(.*\+", "high", "medium", languages=("java", "go"), safe=(r"\?",), sanitizers=(r"escape\(",)), scan.Rule("FW-CORE", r"\w+\(", "low", "low", globs=("core/**", "*.rb")), scan.Rule("FW-COUNT", r"count=\d+", "low", "low", skip_quotes=False, safe=(r"count=1\d\b",), sanitizers=(r"\bparses\b",))]


@query("o095_framework_matcher", _GL + " UNION ALL ".join(_rule_sql(r) for r in _FRAMEWORK))
def _(spark, d):
    return scan.pattern_scan(_with_language(spark, d), _FRAMEWORK).select("finding_id", "line_no", "rule_id")


_SIGNALS = [("spring", "file", "store.java"), ("spring", "contains", "throw new Error"), ("flask", "file", "store.py"), ("flask", "contains", "import handlers"), ("rails", "contains", "no such text"), ("rails", "glob", "core/*.rb"), ("rails", "glob", "none/**"), ("next", "contains", "require(\"./server")]


@query("o096_framework_detection", "WITH s(framework, kind, value) AS (VALUES " + ",".join(f"({','.join(map(_quoted, x))})" for x in _SIGNALS) + """), h AS (SELECT framework, kind, value FROM s WHERE (kind='file' AND value IN (SELECT string_split(file_path,'/')[-1] FROM raw_findings)) OR (kind='contains' AND EXISTS (SELECT 1 FROM raw_findings r WHERE contains(r.code, s.value))) OR (value='core/*.rb' AND EXISTS (SELECT 1 FROM raw_findings r WHERE regexp_matches(r.file_path,'^core/[^/]*\\.rb(/|$)'))))
 SELECT h.framework, count(*) AS matched, greatest(0.1, least(1.0, count(*)/any_value(t.n)::DOUBLE)) AS confidence FROM h JOIN (SELECT framework, count(*) AS n FROM s GROUP BY 1) t USING (framework) GROUP BY 1""")
def _(spark, d):
    files = table(spark, d, "raw_findings").select(F.col("file_path").alias("path"), F.coalesce("code", F.lit("")).alias("content"))
    return scan.framework_detection(files, spark.createDataFrame(_SIGNALS, "framework string, kind string, value string"))


@query("o107_suppression_directives", f"WITH {LINES} SELECT finding_id, line_no::INTEGER AS line_no, nullif(regexp_extract(line,'(?://|#|--|/\\*|<!--)\\s*audit\\ logger\\b:?\\s*([A-Z][A-Z0-9-]+)?',1),'') AS rule_id FROM l WHERE regexp_matches(line,'(?://|#|--|/\\*|<!--)\\s*audit\\ logger\\b')")
def _(spark, d):
    return scan.suppression_directives(_lines(spark, d), "audit logger").select("finding_id", "line_no", "rule_id")


_NAME = "coalesce(" + ",".join(f"nullif(regexp_extract(ltrim(line),{_quoted(p)},1),'')" for p in scan.FUNCTION_STARTS) + ")"


@query("o104_function_boundaries", f"WITH {LINES} SELECT finding_id, line_no::INTEGER AS line_no, {_NAME} AS name FROM l WHERE {_NAME} IS NOT NULL AND {_NAME} NOT IN ('if','for','while','switch','catch','return','else','new','throw')")
def _(spark, d):
    return scan.function_boundaries(_lines(spark, d)).select("finding_id", "line_no", "name")


_SCRIPT = """regexp_extract(ltrim(line),'(?:\\brequire\\s*\\(\\s*|\\bfrom\\s+|^import\\s+)["'']([^"'']+)["'']',1)"""
_PACKAGE = f"coalesce(nullif(CASE WHEN regexp_matches({_SCRIPT},'^\\.{{0,2}}/') THEN {_SCRIPT} WHEN starts_with({_SCRIPT},'@') THEN regexp_extract({_SCRIPT},'^(@[^/]+/[^/]+)',1) ELSE regexp_extract({_SCRIPT},'^([^/]+)',1) END,''), nullif(regexp_extract(regexp_extract(ltrim(line),'^(?:import|from)\\s+([A-Za-z_][\\w.]*)',1),'^([A-Za-z_]\\w*)',1),''))"


@query("o018_imports", f"WITH {LINES} SELECT package, count(DISTINCT finding_id) AS files FROM (SELECT finding_id, {_PACKAGE} AS package FROM l) WHERE package IS NOT NULL GROUP BY 1")
def _(spark, d):
    return scan.imports(_lines(spark, d)).groupBy("package").agg(F.countDistinct("finding_id").alias("files"))


_GLOBS = ["modules/", "*.rb", "!core/**", "/src/*.go", "server/**/feed.*"]
_IGNORED = "false"
for _g in _GLOBS:
    _IGNORED = f"CASE WHEN regexp_matches(file_path,{_quoted(scan.glob_pattern(_g.lstrip('!')))}) THEN {str(not _g.startswith('!')).lower()} ELSE {_IGNORED} END"


@query("o007_ignored_paths", f"SELECT finding_id, {_IGNORED} AS ignored FROM raw_findings WHERE file_path IS NOT NULL")
def _(spark, d):
    return table(spark, d, "raw_findings").where("file_path is not null").select("finding_id", scan.ignored(F.col("file_path"), _GLOBS).alias("ignored"))


_OWNERS = [("*.py", ["@py"]), ("core/", ["@core", "@leads"]), ("/server/", ["@leads"])]


@query("o122_codeowners", "SELECT DISTINCT file_path, owner FROM (" + " UNION ALL ".join(f"SELECT file_path, '{o}' AS owner FROM raw_findings WHERE regexp_matches(file_path,{_quoted(scan.glob_pattern(g))})" for g, who in _OWNERS for o in who) + ")")
def _(spark, d):
    return scan.owners(table(spark, d, "raw_findings").select("file_path").distinct(), _OWNERS)


@query("o002_text_files", "SELECT ext, count(*) AS n, bool_and(ext NOT IN ('.lock','.svg','.png')) AS is_text FROM (SELECT lower(regexp_extract(file_path,'(\\.[^./]*)$',1)) AS ext FROM raw_findings) GROUP BY 1")
def _(spark, d):
    return table(spark, d, "raw_findings").groupBy(tx.extension(F.col("file_path")).alias("ext")).agg(F.count(F.lit(1)).alias("n"), F.bool_and(tx.is_text_file(F.col("file_path"))).alias("is_text"))


_BIGRAMS = "list_distinct(list_transform(generate_series(1,greatest(length({0})-1,0)), lambda i: substr({0},i,2)))"


@query("o065_bigrams", f"SELECT title, len({_BIGRAMS.format('title')})::INTEGER AS n FROM (SELECT DISTINCT title FROM raw_findings WHERE title IS NOT NULL)")
def _(spark, d):
    return table(spark, d, "raw_findings").where("title is not null").select("title").distinct().select("title", F.size(tx.bigrams(F.col("title"))).alias("n"))


@query("o066_dice", f"SELECT item_id, CASE WHEN len(a)+len(b)=0 THEN 0 ELSE round(2.0*len(list_intersect(a,b))/(len(a)+len(b)),9) END AS dice FROM (SELECT item_id, {_BIGRAMS.format('passage')} AS a, {_BIGRAMS.format('answer')} AS b FROM eval_items WHERE answer IS NOT NULL)")
def _(spark, d):
    return table(spark, d, "eval_items").where("answer is not null").select("item_id", F.round(tx.dice(F.col("passage"), F.col("answer")), 9).alias("dice"))


@query("o064_licence_text", r"SELECT doc_id, trim(regexp_replace(regexp_replace(array_to_string(list_filter(string_split_regex(lower(coalesce(text,'')),'\r?\n'), lambda x: NOT regexp_matches(x,'^\s*(copyright|\(c\)|©)')),' '),'[^\p{L}\p{Nd}\s]','','g'),'\s+',' ','g')) AS plain FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", normalise_licence_text(F.col("text")).alias("plain"))


_EVERY = "CASE regexp_extract(file_path,'(\\.[^./]*)$',1) WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.go' THEN 'go' ELSE 'other' END"


@query("o058_string_context", f"WITH {LINES}, g0 AS (SELECT *, {_EVERY} AS language FROM l), {_CONTEXT} SELECT finding_id, line_no::INTEGER AS line_no FROM g WHERE inside")
def _(spark, d):
    """The lines inside multi-line strings and comments."""
    raw = table(spark, d, "raw_findings").where("code is not null").withColumn("_language", tx.language(F.col("file_path")))
    return scan.code_lines(raw, "finding_id", "code", F.col("_language")).where("inside").select("finding_id", "line_no")


@query("o059_unquoted", f"WITH {LINES} SELECT finding_id, line_no::INTEGER AS line_no, {_BARE} AS bare FROM l")
def _(spark, d):
    return _lines(spark, d).select("finding_id", "line_no", scan.unquoted(F.col("line")).alias("bare"))


@query("o003_third_party", r"SELECT finding_id, regexp_matches(lower(regexp_extract(file_path,'([^/]*)$',1)),'\.min\.|_min\.js$|-min\.js$|\.bundle\.|^(jquery|bootstrap|angular|react|vue|lodash|underscore|moment|d3|backbone|ember)[.-]|^(vendor|bundle|chunk)[.-]') AS third_party FROM raw_findings")
def _(spark, d):
    return table(spark, d, "raw_findings").select("finding_id", tx.is_third_party(F.col("file_path")).alias("third_party"))


@query("o005_admission", r"SELECT finding_id, regexp_extract(file_path,'([^/]*)$',1) LIKE '%.lock' AS lockfile, regexp_matches(file_path,'\.(example|sample|template|dist)$') AS example, regexp_matches(lower(file_path),'\.(png|jpg|lock|svg|jar|so|zip|sum)$') AS is_binary, regexp_matches(lower(file_path),'\.(md|markdown|rst|adoc|txt)$|(^|/)(docs?|documentation|man)/|(^|/)(readme|changelog|license|contributing)[^/]*$') AS doc FROM raw_findings")
def _(spark, d):
    p = F.col("file_path")
    return table(spark, d, "raw_findings").select("finding_id", tx.is_lockfile(p).alias("lockfile"), tx.is_example_file(p).alias("example"), tx.is_binary_path(p).alias("is_binary"), tx.is_doc_path(p).alias("doc"))


#: The first words of some licences (fixed values of the query).
_LICENCES = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
_BIG = "list_distinct(list_transform(generate_series(1,greatest(length({0})-1,0)), lambda i: substr({0},i,2)))"
_PLAIN_SQL = r"trim(regexp_replace(regexp_replace(array_to_string(list_filter(string_split_regex(lower({0}),'\r?\n'), lambda x: NOT regexp_matches(x,'^\s*(copyright|\(c\)|©)')),' '),'[^\p{{L}}\p{{Nd}}\s]','','g'),'\s+',' ','g'))"
_LICENCE_ROWS = ", ".join(f"({i},'{n}','{t}')" for i, (n, t) in enumerate(_LICENCES))


@query("o153_best_licence", f"WITH k(i, name, body) AS (VALUES {_LICENCE_ROWS}), t AS (SELECT finding_id, 'Copyright (c) '||finding_id||chr(10)||CASE WHEN finding_id%6=5 THEN coalesce(title,'') ELSE replace(k.body, CASE WHEN finding_id%2=0 THEN ' the ' ELSE ' of ' END, ' ') END AS text FROM raw_findings LEFT JOIN k ON k.i=finding_id%6), b AS (SELECT finding_id, {_BIG.format('p')} AS g FROM (SELECT finding_id, {_PLAIN_SQL.format('text')} AS p FROM t)), kb AS (SELECT name, {_BIG.format('p')} AS g FROM (SELECT name, {_PLAIN_SQL.format('body')} AS p FROM k)), d AS (SELECT finding_id, name, round(2.0*len(list_intersect(b.g,kb.g))/(len(b.g)+len(kb.g)),9) AS score FROM b CROSS JOIN kb) SELECT finding_id, CASE WHEN max(score)>=0.8 THEN arg_max(name,(score,name)) END AS licence FROM d GROUP BY 1")
def _(spark, d):
    """The licence whose text is nearest to a text made from each row: a copyright line and a licence with a word left out, or something else."""
    raw, k = table(spark, d, "raw_findings"), F.col("finding_id") % 6
    body = F.coalesce("title", F.lit(""))
    for i, (_, t) in enumerate(_LICENCES):
        body = F.when(k == i, F.replace(F.lit(t), F.when(F.col("finding_id") % 2 == 0, " the ").otherwise(" of "), F.lit(" "))).otherwise(body)
    texts = raw.select("finding_id", F.concat(F.lit("Copyright (c) "), F.col("finding_id").cast("string"), F.lit("\n"), body).alias("text"))
    return texts.select("finding_id", best_licence(F.col("text"), dict(_LICENCES)).alias("licence"))
