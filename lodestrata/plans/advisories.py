"""Queries over advisories and packages, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import findings as fx
from lodestrata.functions.versions import dotted_key, version_compare, version_in_range
from lodestrata.operators import advisories as op
from lodestrata.operators import findings as fop
from lodestrata.operators.nested import shred
from lodestrata.operators.ranking import global_rank
from lodestrata.session import bounded_broadcast, table
from lodestrata.sinks import reports

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = (f, sql)
        return f

    return register


def _dotted(v: str) -> str:
    """The numbers of a dotted version without zeros at the end."""
    numbers = f"list_transform(string_split(regexp_replace({v},'^[vV]',''),'.'), lambda x: coalesce(try_cast(regexp_extract(x,'^([0-9]*)',1) AS HUGEINT),0))"
    return f"(({numbers})[1:coalesce(list_max(list_transform(range(1,len({numbers})+1), lambda i: CASE WHEN ({numbers})[i]<>0 THEN i ELSE 0 END)),0)])"


_INSTALLED = f"inst AS (SELECT ecosystem, package_name, max(distro_name) AS distro, arg_max(fixed_version, ({_dotted('fixed_version')}, fixed_version)) AS version FROM affected_packages WHERE fixed_version IS NOT NULL AND fixed_version<>'' AND package_name IS NOT NULL GROUP BY 1,2)"
_MATCH = f"""{_INSTALLED}, a AS (SELECT vulnerability_id, ecosystem, package_name AS name, coalesce(source_package,'') AS source_package, coalesce(distro_name,'') AS distro_name, coalesce(status,'') AS status, coalesce(introduced_version,'') AS introduced_version, coalesce(fixed_version,'') AS fixed_version, coalesce(affected_range,'') AS affected_range FROM affected_packages),
 hit AS (SELECT i.*, a.* EXCLUDE (ecosystem), 1 AS tier FROM inst i JOIN a ON a.ecosystem=i.ecosystem AND a.name=i.package_name WHERE distro_name='' OR distro_name=coalesce(i.distro,'')
  UNION ALL SELECT i.*, a.* EXCLUDE (ecosystem), 2 AS tier FROM inst i JOIN a ON a.ecosystem=i.ecosystem AND a.source_package=i.package_name WHERE a.source_package<>'' AND a.source_package<>a.name AND (distro_name='' OR distro_name=coalesce(i.distro,''))),
 m AS (SELECT hit.*, v.vuln_id, v.severity, v.cvss_score, s.source_name FROM hit JOIN vulnerabilities v ON v.id=hit.vulnerability_id JOIN vulnerability_sources s ON s.id=v.source_id)"""


def _installed(spark, d):
    """The newest fixed version of each package stands for the installed one."""
    a = table(spark, d, "affected_packages").where("fixed_version is not null and fixed_version <> '' and package_name is not null")
    return a.groupBy("ecosystem", "package_name").agg(F.max("distro_name").alias("distro"), F.max(F.struct(dotted_key(F.col("fixed_version")).alias("k"), F.col("fixed_version").alias("v"))).alias("_v")).select("ecosystem", "package_name", "distro", F.col("_v.v").alias("version"))


def _matches(spark, d):
    return op.lookup(_installed(spark, d), table(spark, d, "affected_packages"), table(spark, d, "vulnerabilities"), table(spark, d, "vulnerability_sources"))


@query("o108_package_lookup", f"WITH {_MATCH} SELECT ecosystem, package_name, count(*) AS n, count(DISTINCT vuln_id) AS advisories FROM m WHERE tier=1 GROUP BY 1,2")
def _(spark, d):
    return _matches(spark, d).where("tier = 1").groupBy("ecosystem", "package_name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("vuln_id").alias("advisories"))


@query("o109_source_package_tier", f"WITH {_MATCH} SELECT tier, count(*) AS n FROM m GROUP BY 1")
def _(spark, d):
    return _matches(spark, d).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query("o110_id_or_alias", "SELECT id, vuln_id FROM vulnerabilities WHERE vuln_id LIKE 'CVE-2024-%' OR len(list_filter(coalesce(aliases,[]), lambda x: x LIKE '%CVE-2024-%'))>0")
def _(spark, d):
    hit = F.col("vuln_id").like("CVE-2024-%") | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda x: F.coalesce(x.like("%CVE-2024-%"), F.lit(False)))
    return table(spark, d, "vulnerabilities").where(hit).select("id", "vuln_id")


_AFFECTED = f"CASE WHEN status='not-affected' THEN false WHEN fixed_version NOT IN ('','0') THEN {_dotted('version')} < {_dotted('fixed_version')} WHEN introduced_version NOT IN ('','0') THEN {_dotted('version')} >= {_dotted('introduced_version')} ELSE true END"


@query("o111_version_range", f"WITH {_MATCH} SELECT ecosystem, count(*) AS n, count(*) FILTER ({_AFFECTED}) AS affected FROM m GROUP BY 1")
def _(spark, d):
    hit = op.affected_by_dotted(F.col("version"), F.col("status"), F.col("introduced_version"), F.col("fixed_version"))
    return _matches(spark, d).groupBy("ecosystem").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("affected"))


_PLAIN = "regexp_full_match({0},'[0-9]+([.][0-9]+)*')"
_EXACT = f"CASE WHEN status='not-affected' THEN false WHEN fixed_version NOT IN ('','0') THEN {_dotted('version')} < {_dotted('fixed_version')} WHEN starts_with(affected_range,'<= ') THEN {_dotted('version')} <= {_dotted('substr(affected_range,4)')} WHEN affected_range<>'' THEN error('no SQL for this range') WHEN introduced_version NOT IN ('','0') THEN {_dotted('version')} >= {_dotted('introduced_version')} ELSE true END"


@query("o111_version_range_exact", f"WITH {_MATCH} SELECT ecosystem, count(*) FILTER ({_EXACT}) AS affected FROM m GROUP BY 1 HAVING count(*) FILTER ({_EXACT})>0")
def _(spark, d):
    """In each ecosystem's own order; on plain numbers, which the SQL knows, all of them agree."""
    return op.affected_exact(_matches(spark, d)).groupBy("ecosystem").agg(F.count(F.lit(1)).alias("affected"))


@query("o144_best_match", f"WITH {_MATCH}, c AS (SELECT *, CASE WHEN source_name IN ('alpine-secdb','debian-security','ubuntu-oval') THEN CASE WHEN distro_name<>'' THEN 100 ELSE 95 END WHEN source_name='nvd' THEN 70 ELSE 95 END AS confidence FROM m) SELECT vuln_id, package_name, confidence, tier FROM c QUALIFY row_number() OVER (PARTITION BY vuln_id, package_name ORDER BY confidence DESC, tier, ecosystem, vulnerability_id)=1")
def _(spark, d):
    m = _matches(spark, d).withColumn("confidence", op.match_confidence(F.col("source_name"), F.col("distro_name")))
    return op.best_matches(m, [F.col("tier"), F.col("ecosystem"), F.col("vulnerability_id")]).select("vuln_id", "package_name", "confidence", "tier")


@query("o152_ordered_result", "SELECT id, row_number() OVER (ORDER BY cvss_score DESC NULLS LAST, vuln_id, id) AS place FROM vulnerabilities WHERE vuln_id IS NOT NULL")
def _(spark, d):
    v = table(spark, d, "vulnerabilities").where("vuln_id is not null").select("id", "cvss_score", "vuln_id")
    return global_rank(v, [F.col("cvss_score").desc_nulls_last(), F.col("vuln_id"), F.col("id")]).select("id", "place")


_CATEGORY = """CASE WHEN rank=4 THEN 'proprietary' WHEN rank=3 THEN 'copyleft' WHEN rank=2 THEN 'weak-copyleft' WHEN rank=1 THEN 'permissive' ELSE 'unknown' END"""


def _has(words) -> str:
    return "(" + " OR ".join(f"contains(p,'{w}')" for w in words) + ")"


_LICENCE = f"""SELECT id, {_CATEGORY} AS category FROM (SELECT id, max(CASE WHEN p='' THEN 0 WHEN contains(p,'PROPRIETARY') OR contains(p,'COMMERCIAL') OR p='UNLICENSED' THEN 4 WHEN {_has(op.WEAK_COPYLEFT)} THEN 2 WHEN {_has(op.STRONG_COPYLEFT)} THEN 3 WHEN {_has(op.PERMISSIVE)} THEN 1 ELSE 0 END) AS rank FROM (SELECT id, trim(unnest(string_split_regex(upper(trim(coalesce(license,''))),' OR | AND | WITH |,'))) AS p FROM vulnerability_sources) GROUP BY 1)"""


@query("o067_licence_category", _LICENCE)
def _(spark, d):
    return table(spark, d, "vulnerability_sources").select("id", op.licence_category(F.col("license")).alias("category"))


@query("o130_licence_summary", f"WITH l AS ({_LICENCE}) SELECT category, count(*) AS sources, coalesce(sum(n),0)::BIGINT AS advisories FROM l LEFT JOIN (SELECT source_id, count(*) AS n FROM vulnerabilities GROUP BY 1) v ON v.source_id=l.id GROUP BY 1")
def _(spark, d):
    l = table(spark, d, "vulnerability_sources").select("id", op.licence_category(F.col("license")).alias("category"))
    n = table(spark, d, "vulnerabilities").groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return l.join(n, "id", "left").groupBy("category").agg(F.count(F.lit(1)).alias("sources"), F.coalesce(F.sum("n"), F.lit(0)).alias("advisories"))


@query("o131_licence_policy", f"WITH l AS ({_LICENCE}) SELECT v.id, category, category IN ('copyleft','proprietary') AS violation FROM vulnerabilities v JOIN l ON l.id=v.source_id")
def _(spark, d):
    l = table(spark, d, "vulnerability_sources").select(F.col("id").alias("source_id"), op.licence_category(F.col("license")).alias("category"))
    return table(spark, d, "vulnerabilities").join(bounded_broadcast(l), "source_id").select("id", "category", F.col("category").isin("copyleft", "proprietary").alias("violation"))


@query("o113_licence_enrichment", "SELECT a.id, coalesce(nullif(nullif(trim(s.license),''),'-'),'none') AS license FROM affected_packages a JOIN vulnerabilities v ON v.id=a.vulnerability_id JOIN vulnerability_sources s ON s.id=v.source_id")
def _(spark, d):
    v = table(spark, d, "vulnerabilities").select(F.col("id").alias("vulnerability_id"), "source_id")
    s = table(spark, d, "vulnerability_sources").select(F.col("id").alias("source_id"), "license")
    clean = F.coalesce(F.nullif(F.nullif(F.trim("license"), F.lit("")), F.lit("-")), F.lit("none"))
    return table(spark, d, "affected_packages").join(v, "vulnerability_id").join(bounded_broadcast(s), "source_id").select("id", clean.alias("license"))


_ORDERED = "CASE WHEN {a} < {b} THEN -1 WHEN {a} > {b} THEN 1 ELSE 0 END"


@query("o068_version_order", f"SELECT id, ecosystem, {_ORDERED.format(a=_dotted('introduced_version'), b=_dotted('fixed_version'))} AS c FROM affected_packages WHERE introduced_version<>'' AND fixed_version<>''")
def _(spark, d):
    """introduced against fixed in the ecosystem's own order; on plain numbers, which the SQL knows, all of them agree."""
    a = table(spark, d, "affected_packages").where("introduced_version <> '' and fixed_version <> ''")
    return a.select("id", "ecosystem", version_compare(F.col("ecosystem"), F.col("introduced_version"), F.col("fixed_version")).alias("c"))


#: A release candidate of each ecosystem, by the row's number (fixed values).
_CANDIDATES = {"npm": "-rc.2", "RubyGems": "-rc.2", "Maven": "-rc2", "Packagist": "-RC2", "crates.io": "-rc.2", "Go": "-rc.2", "Debian:12": "~rc2", "PyPI": "rc2", "Alpine:v3.19": "_rc2"}


@query("o068_candidates", f"WITH k(ecosystem, mark) AS (VALUES {', '.join(f'({chr(39)}{e}{chr(39)},{chr(39)}{m}{chr(39)})' for e, m in _CANDIDATES.items())}) SELECT id, {_ORDERED.format(a='list_concat(' + _dotted('a.fixed_version') + ', [-1])', b='CASE WHEN id%2=0 THEN list_concat(' + _dotted('a.fixed_version') + ', [-1]) ELSE ' + _dotted('a.fixed_version') + ' END')}-CASE WHEN id%2=0 THEN 0 ELSE 2 END AS c FROM affected_packages a JOIN k USING (ecosystem) WHERE fixed_version<>''")
def _(spark, d):
    """A release candidate of each fixed version against itself or its release: always before the release."""
    a = table(spark, d, "affected_packages").where("fixed_version <> ''")
    mark = F.create_map(*[F.lit(x) for pair in _CANDIDATES.items() for x in pair])
    candidate = F.concat("fixed_version", F.try_element_at(mark, F.col("ecosystem")))
    other = F.when(F.col("id") % 2 == 0, candidate).otherwise(F.col("fixed_version"))
    return a.where(candidate.isNotNull()).select("id", version_compare(F.col("ecosystem"), candidate, other).alias("c"))


@query("o069_dotted_compare", f"SELECT id, {_dotted('introduced_version')} < {_dotted('fixed_version')} AS before FROM affected_packages WHERE introduced_version<>'' AND fixed_version<>''")
def _(spark, d):
    return table(spark, d, "affected_packages").where("introduced_version <> '' and fixed_version <> ''").select("id", (dotted_key(F.col("introduced_version")) < dotted_key(F.col("fixed_version"))).alias("before"))


@query("o070_range_expression", f"SELECT id, CASE WHEN coalesce(affected_range,'')='' THEN true WHEN introduced_version IS NULL THEN NULL WHEN starts_with(affected_range,'<= ') THEN {_dotted('introduced_version')} <= {_dotted('substr(affected_range,4)')} ELSE error('no SQL for this range') END AS inside FROM affected_packages")
def _(spark, d):
    """Whether the introduced version lies in the range expression, in the ecosystem's own order."""
    a = table(spark, d, "affected_packages")
    return a.select("id", version_in_range(F.col("ecosystem"), F.col("introduced_version"), F.col("affected_range")).alias("inside"))


_SEVERITY = "CASE WHEN cvss_score>=9 THEN 'critical' WHEN cvss_score>=7 THEN 'high' WHEN cvss_score>=4 THEN 'medium' WHEN cvss_score>0 THEN 'low' ELSE CASE lower(trim(coalesce(severity,''))) WHEN 'moderate' THEN 'medium' WHEN 'important' THEN 'high' WHEN 'critical' THEN 'critical' WHEN 'high' THEN 'high' WHEN 'medium' THEN 'medium' WHEN 'low' THEN 'low' ELSE 'unknown' END END"


@query("o071_severity", f"SELECT id, {_SEVERITY} AS severity FROM vulnerabilities")
def _(spark, d):
    return table(spark, d, "vulnerabilities").select("id", op.severity_of(F.col("cvss_score"), F.col("severity")).alias("severity"))


_KNOWN = "list_transform(list_filter(list_concat([vuln_id], coalesce(aliases,[])), lambda x: x IS NOT NULL), lambda x: upper(trim(x)))"


@query("o071_vector_severity", r"""SELECT id, CASE WHEN coalesce(cvss_vector,'')='' THEN 'unknown' WHEN contains(cvss_vector,'/C:H') AND contains(cvss_vector,'/I:H') AND contains(cvss_vector,'/A:H') THEN 'critical' WHEN regexp_matches(cvss_vector,'/[CIA]:H') THEN 'high' WHEN regexp_matches(cvss_vector,'/[CIA]:L') THEN 'medium' ELSE 'low' END AS by_vector, CASE WHEN contains(lower(coalesce(summary,'')),'critical') THEN 'critical' WHEN contains(lower(coalesce(summary,'')),'high') THEN 'high' WHEN regexp_matches(lower(coalesce(summary,'')),'moderate|medium') THEN 'medium' WHEN contains(lower(coalesce(summary,'')),'low') THEN 'low' ELSE 'medium' END AS by_words, CASE WHEN id%2=0 THEN cvss_score END AS by_number FROM vulnerabilities""")
def _(spark, d):
    """By a vector's impacts, by words, and by a number in a text such as CVSS_V3/8.1."""
    scores = F.when(F.col("id") % 2 == 0, F.concat(F.lit("CVSS_V3/"), F.col("cvss_score").cast("string"))).otherwise(F.col("cvss_vector"))
    return table(spark, d, "vulnerabilities").select("id", op.severity_of_vector(F.col("cvss_vector")).alias("by_vector"), op.severity_in_words(F.col("summary")).alias("by_words"), op.numeric_score(scores).alias("by_number"))


@query("o072_extractors", "SELECT id, CASE id%5 WHEN 0 THEN 'CWE-'||id WHEN 1 THEN 'CWE-'||id WHEN 2 THEN 'CWE-'||id WHEN 3 THEN 'CWE-'||id ELSE '' END AS weakness, CASE id%4 WHEN 3 THEN '' WHEN 2 THEN 'x'||id ELSE 'w'||id END AS url FROM vulnerabilities")
def _(spark, d):
    """Weakness and link out of the forms in which feeds give them."""
    i, k = F.col("id").cast("string"), F.col("id") % 5
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    specific = F.when(k == 0, say('{"cwe":"', i, '"}')).when(k == 1, say('{"cwe":["CWE-', i, '","CWE-1"]}')).when(k == 2, say('{"cwe_ids":["CWE-', i, '"]}')).when(k == 3, say('{"cweId":"', i, '"}')).otherwise('{"severity":"LOW"}')
    ref = lambda kind, u: F.struct(F.lit(kind).alias("type"), F.concat(F.lit(u), i).alias("url"))
    m = F.col("id") % 4
    refs = F.when(m == 3, F.array().cast("array<struct<type:string,url:string>>")).when(m == 2, F.array(ref("FIX", "x"), ref("REPORT", "y"))).when(m == 1, F.array(ref("FIX", "x"), ref("WEB", "w"))).otherwise(F.array(ref("ADVISORY", "w"), ref("WEB", "y")))
    return table(spark, d, "vulnerabilities").select("id", op.weakness_of(specific).alias("weakness"), op.advisory_url(refs).alias("url"))


@query("o072_preferred_id", f"SELECT id, coalesce(list_filter({_KNOWN}, lambda x: x LIKE 'CVE-%')[1], list_filter({_KNOWN}, lambda x: x LIKE 'GHSA-%')[1], vuln_id) AS best_id FROM vulnerabilities")
def _(spark, d):
    return table(spark, d, "vulnerabilities").select("id", op.preferred_id(F.col("vuln_id"), F.col("aliases")).alias("best_id"))


@query("o088_not_withdrawn", "SELECT id FROM vulnerabilities WHERE NOT (starts_with(lower(coalesce(summary,'')),'withdrawn advisory') OR starts_with(lower(coalesce(summary,'')),'rejected') OR contains(lower(coalesce(summary,'')),'** reject **'))")
def _(spark, d):
    return fop.not_withdrawn(table(spark, d, "vulnerabilities")).select("id")


_IMPORTS = "imp AS (SELECT DISTINCT package_name AS package FROM affected_packages WHERE confidence=100 AND package_name IS NOT NULL)"


@query("o112_reachability", f"WITH {_IMPORTS}, n AS (SELECT DISTINCT package_name AS name FROM affected_packages WHERE package_name IS NOT NULL), t AS (SELECT name, CASE WHEN name IN (SELECT package FROM imp) THEN 1 WHEN lower(name) IN (SELECT lower(package) FROM imp) THEN 2 WHEN EXISTS (SELECT 1 FROM imp WHERE starts_with(name, package||'/') OR starts_with(package, name||'/')) THEN 3 WHEN string_split(name,'/')[-1] IN (SELECT string_split(package,'/')[-1] FROM imp) THEN 4 ELSE 5 END AS reach_tier FROM n) SELECT reach_tier, count(*) AS n FROM affected_packages a LEFT JOIN t ON a.package_name=t.name WHERE a.package_name IS NOT NULL GROUP BY 1")
def _(spark, d):
    a = table(spark, d, "affected_packages").where("package_name is not null")
    return op.reachability(a, a.where("confidence = 100").select(F.col("package_name").alias("package"))).groupBy("reach_tier").agg(F.count(F.lit(1)).alias("n"))


#: Packages that are imported under other names, by id % 40, with the name they are imported by (fixed values).
_RENAMED = (("PyYAML", "yaml"), ("Pillow", "pil"), ("scikit-learn", "sklearn"), ("google-cloud-storage", "google"), ("azure-core", "azure"), ("psycopg2-binary", "psycopg2"), ("python-jose", "never"))
_RENAMED_SQL = ", ".join(f"({k},'{n}','{i}')" for k, (n, i) in enumerate(_RENAMED))


@query("o112_reachability_cascade", f"WITH r(k, name, package) AS (VALUES {_RENAMED_SQL}), aliases(low, package) AS (VALUES ('pyyaml','yaml'), ('pillow','pil'), ('beautifulsoup4','bs4'), ('scikit-learn','sklearn'), ('python-dateutil','dateutil'), ('opencv-python','cv2'), ('pyjwt','jwt'), ('python-dotenv','dotenv'), ('psycopg2-binary','psycopg2'), ('python-jose','jose')), f AS (SELECT coalesce(r.name, a.package_name) AS name, coalesce(r.package, a.package_name) AS package, confidence=100 AS imported, a.id%3=0 AS is_direct FROM affected_packages a LEFT JOIN r ON r.k=a.id%40 WHERE package_name IS NOT NULL), imp AS (SELECT DISTINCT package FROM f WHERE imported), n AS (SELECT DISTINCT name, lower(trim(name)) AS low FROM f), t AS (SELECT name, CASE WHEN name IN (SELECT package FROM imp) THEN 1 WHEN low IN (SELECT lower(package) FROM imp) OR low IN (SELECT low FROM aliases JOIN imp ON lower(imp.package)=aliases.package) OR starts_with(low,'google-cloud-') AND EXISTS (SELECT 1 FROM imp WHERE lower(package) IN ('google','google.cloud')) OR starts_with(low,'azure-') AND EXISTS (SELECT 1 FROM imp WHERE lower(package)='azure') THEN 2 WHEN EXISTS (SELECT 1 FROM imp WHERE starts_with(name, package||'/') OR starts_with(package, name||'/')) THEN 3 WHEN string_split(name,'/')[-1] IN (SELECT string_split(package,'/')[-1] FROM imp) THEN 4 WHEN name IN (SELECT name FROM f WHERE is_direct) THEN 6 ELSE 5 END AS reach_tier FROM n) SELECT name, reach_tier FROM t")
def _(spark, d):
    """The whole cascade: some packages are imported under other names, and every third row is a direct dependency."""
    a, k = table(spark, d, "affected_packages").where("package_name is not null"), F.col("id") % 40
    name = package = F.col("package_name")
    for i, (n, p) in enumerate(_RENAMED):
        name, package = F.when(k == i, n).otherwise(name), F.when(k == i, p).otherwise(package)
    f = a.select(name.alias("name"), package.alias("package"), (F.col("confidence") == 100).alias("imported"), (F.col("id") % 3 == 0).alias("is_direct"))
    return op.reachability(f.select("name").distinct(), f.where("imported").select("package"), "name", f.select("name", "is_direct")).select("name", "reach_tier")


@query("o128_package_groups", f"WITH s AS (SELECT a.ecosystem, a.package_name, v.vuln_id, a.id, a.status, CASE {_SEVERITY} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS r, a.fixed_version FROM affected_packages a JOIN vulnerabilities v ON v.id=a.vulnerability_id) SELECT ecosystem, package_name, max(r) AS worst, count(DISTINCT vuln_id) AS advisories, arg_min(vuln_id, id) AS first_advisory, arg_min(coalesce(status,''), id) AS first_status, CASE WHEN count(DISTINCT coalesce(fixed_version,''))=1 THEN min(coalesce(fixed_version,'')) ELSE '' END AS fixed FROM s GROUP BY 1,2")
def _(spark, d):
    v = table(spark, d, "vulnerabilities").select(F.col("id").alias("vulnerability_id"), "vuln_id", fx.severity_rank(op.severity_of(F.col("cvss_score"), F.col("severity"))).alias("r"))
    s = table(spark, d, "affected_packages").join(v, "vulnerability_id")
    fixed = F.coalesce("fixed_version", F.lit(""))
    return s.groupBy("ecosystem", "package_name").agg(F.max("r").alias("worst"), F.countDistinct("vuln_id").alias("advisories"), F.min_by("vuln_id", "id").alias("first_advisory"), F.min_by(F.coalesce("status", F.lit("")), "id").alias("first_status"), F.when(F.min(fixed) == F.max(fixed), F.min(fixed)).otherwise("").alias("fixed"))


@query("o136_distinct_packages", "SELECT ecosystem, count(DISTINCT package_name) AS packages FROM affected_packages GROUP BY 1")
def _(spark, d):
    return table(spark, d, "affected_packages").groupBy("ecosystem").agg(F.countDistinct("package_name").alias("packages"))


@query("o136_approx_packages")
def _(spark, d):
    return table(spark, d, "affected_packages").groupBy("ecosystem").agg(F.approx_count_distinct("package_name", 0.02).alias("packages"))


@query("o138_db_stats", "SELECT s.source_name, count(*) AS n, count(*) FILTER (cvss_score IS NULL) AS unscored FROM vulnerabilities v JOIN vulnerability_sources s ON s.id=v.source_id GROUP BY 1")
def _(spark, d):
    n = table(spark, d, "vulnerabilities").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cvss_score").isNull()).alias("unscored"))
    return n.join(bounded_broadcast(table(spark, d, "vulnerability_sources").select(F.col("id").alias("source_id"), "source_name")), "source_id").select("source_name", "n", "unscored")


@query("o139_location_merge", "SELECT vulnerability_id, package_name, package_type, max(confidence) AS confidence, list_sort(list(DISTINCT coalesce(architecture,''))) AS places FROM affected_packages GROUP BY 1,2,3")
def _(spark, d):
    return table(spark, d, "affected_packages").groupBy("vulnerability_id", "package_name", "package_type").agg(F.max("confidence").alias("confidence"), F.sort_array(F.collect_set(F.coalesce("architecture", F.lit("")))).alias("places"))


@query("o145_first_wins", "SELECT package_name, fixed_version, min(id) AS id FROM affected_packages GROUP BY 1,2")
def _(spark, d):
    return op.latest_wins(table(spark, d, "affected_packages"), ["package_name", "fixed_version"], [F.col("id")], first=True).select("package_name", "fixed_version", "id")


@query("o042_upsert", "SELECT source_id, vuln_id, id FROM vulnerabilities QUALIFY row_number() OVER (PARTITION BY source_id, vuln_id ORDER BY id DESC)=1")
def _(spark, d):
    return op.latest_wins(table(spark, d, "vulnerabilities"), ["source_id", "vuln_id"], [F.col("id")]).select("source_id", "vuln_id", "id")


_PURL = f"'pkg:'||lower(split_part(ecosystem,':',1))||'/'||CASE WHEN contains(package_name,'/') THEN replace(regexp_replace(package_name,'/[^/]*$',''),'@','%40')||'/' ELSE '' END||replace(regexp_extract(package_name,'([^/]*)$',1),'@','%40')||CASE WHEN coalesce(fixed_version,'')<>'' THEN '@'||fixed_version ELSE '' END"


@query("o026_package_url", f"SELECT id, {_PURL} AS purl FROM affected_packages WHERE package_name IS NOT NULL")
def _(spark, d):
    a = table(spark, d, "affected_packages").where("package_name is not null")
    name = F.col("package_name")
    return a.select("id", op.package_url(F.split("ecosystem", ":")[0], F.when(name.contains("/"), F.regexp_replace(name, "/[^/]*$", "")).otherwise(""), F.regexp_extract(name, "([^/]*)$", 1), F.col("fixed_version")).alias("purl"))


@query("o147_components", f"SELECT DISTINCT {_PURL} AS purl, ecosystem FROM affected_packages WHERE package_name IS NOT NULL")
def _(spark, d):
    a = table(spark, d, "affected_packages").where("package_name is not null")
    name = F.col("package_name")
    purl = op.package_url(F.split("ecosystem", ":")[0], F.when(name.contains("/"), F.regexp_replace(name, "/[^/]*$", "")).otherwise(""), F.regexp_extract(name, "([^/]*)$", 1), F.col("fixed_version"))
    return a.select(purl.alias("purl"), "ecosystem").dropDuplicates()


@query("o027_advisory_import")
def _(spark, d):
    """Ranges (introduced, fixed, last_affected) of every range of the raw records; a record's own events are folded, so a fold is bounded by one record."""
    leaves = shred(table(spark, d, "osv_records"), "record_id", "body").where("path like '%events%'")
    at = lambda i: F.try_element_at("dewey", F.lit(i))
    e = leaves.select("record_id", at(2).alias("affected_no"), at(4).alias("range_no"), at(6).alias("event_no"), F.element_at(F.split("path", r"\."), -1).alias("kind"), "text")
    one = lambda k: F.max(F.when(F.col("kind") == k, F.col("text"))).alias(k)
    events = e.groupBy("record_id", "affected_no", "range_no", "event_no").agg(one("introduced"), one("fixed"), one("last_affected"))
    ranges = events.groupBy("record_id", "affected_no", "range_no").agg(F.sort_array(F.collect_list(F.struct("event_no", "introduced", "fixed", "last_affected"))).alias("events"))
    pairs = ranges.select("record_id", "affected_no", "range_no", F.explode(op.event_pairs(F.col("events"))).alias("p"))
    return pairs.select("record_id", "affected_no", "range_no", "p.introduced", "p.fixed", "p.last_affected")


@query("o121_lock_over_manifest", "WITH l AS (SELECT DISTINCT package_name, fixed_version FROM affected_packages WHERE package_type='library'), m AS (SELECT * FROM affected_packages WHERE package_type IS NULL) SELECT id FROM m WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.package_name=m.package_name AND l.fixed_version=m.fixed_version) UNION ALL SELECT id FROM affected_packages WHERE package_type='library'")
def _(spark, d):
    a = table(spark, d, "affected_packages")
    lock = a.where("package_type = 'library'")
    manifest = a.where("package_type is null").join(lock.select("package_name", "fixed_version").distinct(), ["package_name", "fixed_version"], "left_anti")
    return manifest.select("id").union(lock.select("id"))


@query("o155_package_order", f"WITH g AS (SELECT a.package_name, max(CASE {_SEVERITY} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) AS worst, max(CASE WHEN a.confidence=100 THEN 1 ELSE 0 END) AS reached, count(*) AS n FROM affected_packages a JOIN vulnerabilities v ON v.id=a.vulnerability_id WHERE package_name IS NOT NULL GROUP BY 1) SELECT package_name, row_number() OVER (ORDER BY worst DESC, reached DESC, package_name) AS place FROM g")
def _(spark, d):
    """By the worst severity, then whether it is reached, then name."""
    v = table(spark, d, "vulnerabilities").select(F.col("id").alias("vulnerability_id"), fx.severity_rank(op.severity_of(F.col("cvss_score"), F.col("severity"))).alias("r"))
    a = table(spark, d, "affected_packages").where("package_name is not null").join(v, "vulnerability_id")
    g = a.groupBy("package_name").agg(F.max("r").alias("worst"), F.max((F.col("confidence") == 100).cast("int")).alias("reached"))
    return global_rank(g, [F.desc("worst"), F.coalesce("reached", F.lit(0)).desc(), F.col("package_name")]).select("package_name", "place")


@query("o172_explain", f"WITH {_MATCH}, c AS (SELECT *, CASE WHEN source_name IN ('alpine-secdb','debian-security','ubuntu-oval') THEN CASE WHEN distro_name<>'' THEN 100 ELSE 95 END WHEN source_name='nvd' THEN 70 ELSE 95 END AS confidence, {_EXACT} AS affected FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY vuln_id, package_name, affected AND confidence>=80 ORDER BY confidence DESC, tier, ecosystem, vulnerability_id, status, introduced_version, fixed_version, affected_range, distro_name, source_package) AS k FROM c) SELECT vuln_id, package_name, vulnerability_id, tier, confidence, CASE WHEN NOT affected THEN 'version' WHEN confidence<80 THEN 'confidence' WHEN k>1 THEN 'duplicate' ELSE 'reported' END AS verdict FROM r")
def _(spark, d):
    """Every match of every tier with what becomes of it."""
    m = _matches(spark, d).withColumn("confidence", op.match_confidence(F.col("source_name"), F.col("distro_name")))
    return op.explained(m, 80).select("vuln_id", "package_name", "vulnerability_id", "tier", "confidence", "verdict")


def _tree(spark, d):
    return table(spark, d, "affected_packages").where("package_name is not null").select(F.lower(F.split("ecosystem", ":")[0]).alias("ecosystem"), "package_name")


_EDGES = "t AS (SELECT DISTINCT lower(split_part(ecosystem,':',1)) AS ecosystem, package_name FROM affected_packages WHERE package_name IS NOT NULL), e AS (SELECT DISTINCT 1::INTEGER AS depth, 'root' AS parent, ecosystem AS child FROM t UNION ALL SELECT 2, ecosystem, package_name FROM t)"


@query("o039_dependency_tree", "SELECT lower(split_part(ecosystem,':',1)) AS ecosystem, count(DISTINCT package_name) AS packages, min(package_name) AS first_package FROM affected_packages WHERE package_name IS NOT NULL GROUP BY 1")
def _(spark, d):
    edges = reports.dependency_edges(_tree(spark, d)).where("depth = 2")
    return edges.groupBy(F.col("parent").alias("ecosystem")).agg(F.count("child").alias("packages"), F.min("child").alias("first_package"))


@query("o039_dependency_edges", f"WITH {_EDGES} SELECT depth, parent, child FROM e")
def _(spark, d):
    return reports.dependency_edges(_tree(spark, d))


@query("o039_dependency_dot", f"WITH {_EDGES}, q AS (SELECT row_number() OVER (ORDER BY depth, parent NULLS FIRST, child NULLS FIRST)-1 AS k, '  \"'||replace(replace(coalesce(parent,''),'\\','\\\\'),'\"','\\\"')||'\" -> \"'||replace(replace(coalesce(child,''),'\\','\\\\'),'\"','\\\"')||'\";'||chr(10) AS line FROM e) SELECT k//5000 AS document_no, 'digraph deps {{'||chr(10)||string_agg(line,'' ORDER BY k)||'}}'||chr(10) AS document FROM q GROUP BY 1")
def _(spark, d):
    return reports.dependency_dot_documents(_tree(spark, d))
