"""Advisory matching: package lookups in tiers, version ranges, best matches, severities, licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.findings import text
from lodestrata.functions.text import bigrams, import_names
from lodestrata.functions.versions import dotted_key, version_affected
from lodestrata.operators.skew import skew_safe_join
from lodestrata.session import bounded_broadcast

VENDOR_FEEDS = ("alpine-secdb", "debian-security", "ubuntu-oval")


def lookup(packages: DataFrame, affected: DataFrame, vulnerabilities: DataFrame, sources: DataFrame) -> DataFrame:
    """Equality lookup of packages (ecosystem, package_name, version, distro) in the advisories, in two tiers.

    Tier 1 joins on the name, tier 2 on a source package that differs from the name; a distribution
    of the advisory must be empty or that of the package. Joins on (ecosystem, name) from the side of
    the advisories, whose hot packages are split; sources is a dimension.
    """
    a = affected.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("distro_name", "source_package", "status", "introduced_version", "fixed_version", "affected_range")})
    a = a.select("vulnerability_id", "ecosystem", F.col("package_name").alias("_name"), "source_package", "distro_name", "status", "introduced_version", "fixed_version", "affected_range")
    p = packages.select("ecosystem", "package_name", "version", F.coalesce("distro", F.lit("")).alias("distro"))
    distro_ok = (F.col("distro_name") == "") | (F.col("distro_name") == F.col("distro"))
    total = affected.count()
    by_name = skew_safe_join(a.withColumnRenamed("_name", "package_name"), p, ["ecosystem", "package_name"], total=total).where(distro_ok).withColumn("tier", F.lit(1))
    sourced = a.where("source_package <> '' and source_package <> _name").drop("_name").withColumn("package_name", F.col("source_package"))
    by_source = skew_safe_join(sourced, p, ["ecosystem", "package_name"], total=total).where(distro_ok).withColumn("tier", F.lit(2))
    found = by_name.unionByName(by_source)
    v = vulnerabilities.select(F.col("id").alias("vulnerability_id"), "vuln_id", "source_id", "severity", "cvss_score")
    s = sources.select(F.col("id").alias("source_id"), "source_name")
    return found.join(v, "vulnerability_id").join(bounded_broadcast(s), "source_id")


def match_confidence(source: Column, distro: Column) -> Column:
    return F.when(source.isin(*VENDOR_FEEDS), F.when(distro != "", 100).otherwise(95)).when(source == "nvd", 70).otherwise(95)


def affected_by_dotted(version: Column, status: Column, introduced: Column, fixed: Column) -> Column:
    """The variant for dotted numbers: fixed bound, else introduced bound, else true."""
    key = dotted_key(version)
    return (
        F.when(status == "not-affected", False)
        .when((fixed != "") & (fixed != "0"), key < dotted_key(fixed))
        .when((introduced != "") & (introduced != "0"), key >= dotted_key(introduced))
        .otherwise(True)
    )


def affected_exact(matches: DataFrame) -> DataFrame:
    """Keeps the matches whose version the advisory affects, in the ecosystem's own order."""
    return matches.where(version_affected(F.col("ecosystem"), F.col("version"), F.col("status"), F.col("introduced_version"), F.col("fixed_version"), F.col("affected_range")))


def best_matches(matches: DataFrame, order: list[Column]) -> DataFrame:
    """One row for each (vuln_id, package_name): the highest confidence, then the given order. The engine keeps the first row of each group in every task before the shuffle."""
    w = W.partitionBy("vuln_id", "package_name").orderBy(F.col("confidence").desc(), *order)
    return matches.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def explained(matches: DataFrame, min_confidence: int) -> DataFrame:
    """Adds verdict to every match: version (not affected), confidence (below the bound), duplicate (a better match of the advisory and package is reported) or reported."""
    affected = version_affected(F.col("ecosystem"), F.col("version"), F.col("status"), F.col("introduced_version"), F.col("fixed_version"), F.col("affected_range"))
    m = matches.withColumn("_a", F.coalesce(affected, F.lit(False))).withColumn("_ok", F.col("_a") & (F.col("confidence") >= min_confidence))
    order = ["tier", "ecosystem", "vulnerability_id", "status", "introduced_version", "fixed_version", "affected_range", "distro_name", "source_package"]
    place = F.row_number().over(W.partitionBy("vuln_id", "package_name", "_ok").orderBy(F.col("confidence").desc(), *order))
    verdict = F.when(~F.col("_a"), "version").when(~F.col("_ok"), "confidence").when(F.col("_k") > 1, "duplicate").otherwise("reported")
    return m.withColumn("_k", place).withColumn("verdict", verdict).drop("_a", "_ok", "_k")


def preferred_id(vuln_id: Column, aliases: Column) -> Column:
    """A CVE among the id and aliases, else a GHSA, else the id."""
    known = F.transform(F.filter(F.concat(F.array(vuln_id), F.coalesce(aliases, F.array().cast("array<string>"))), lambda x: x.isNotNull()), lambda x: F.upper(F.trim(x)))
    first = lambda p: F.try_element_at(F.filter(known, lambda x: x.startswith(p)), F.lit(1))
    return F.coalesce(first("CVE-"), first("GHSA-"), vuln_id)


def severity_of(score: Column, label: Column) -> Column:
    """The score's bucket, else the label's severity."""
    low = F.lower(F.trim(text(label)))
    named = F.when(low == "moderate", "medium").when(low == "important", "high").when(low.isin("critical", "high", "medium", "low"), low).otherwise("unknown")
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score > 0, "low").otherwise(named)


def severity_of_vector(vector: Column) -> Column:
    """A severity by the impacts of a CVSS vector: all three high is critical, one is high, a low one medium, none low; unknown without a vector."""
    v = text(vector)
    high = [v.contains(f"/{x}:H") for x in "CIA"]
    return F.when(v == "", "unknown").when(high[0] & high[1] & high[2], "critical").when(high[0] | high[1] | high[2], "high").when(v.rlike("/[CIA]:L"), "medium").otherwise("low")


def severity_in_words(summary: Column) -> Column:
    """The gravest-first severity word of a summary; medium where there is none."""
    low = F.lower(text(summary))
    return F.when(low.contains("critical"), "critical").when(low.contains("high"), "high").when(low.rlike("moderate|medium"), "medium").when(low.contains("low"), "low").otherwise("medium")


def numeric_score(scores: Column) -> Column:
    """The first part of a text such as CVSS_V3/8.1 that is a number; null in plain vectors."""
    parts = F.filter(F.split(text(scores), "/"), lambda p: p.rlike(r"^[0-9]+(?:\.[0-9]+)?$"))
    return F.try_element_at(parts, F.lit(1)).cast("double")


def weakness_of(specific: Column) -> Column:
    """The first weakness in a JSON text of feed fields: cwe (a text or a list), cwe_ids or cweId, with its CWE- prefix; empty if there is none."""
    first = F.coalesce(*[F.nullif(F.get_json_object(specific, p), F.lit("")) for p in ("$.cwe[0]", "$.cwe", "$.cwe_ids[0]", "$.cweId")])
    return F.coalesce(F.when(first.startswith("CWE-"), first).when(first.startswith("["), F.lit("")).otherwise(F.concat(F.lit("CWE-"), first)), F.lit(""))


def advisory_url(references: Column) -> Column:
    """The url of the first reference (array of structs type, url) of type ADVISORY or WEB, else of the first; empty if there is none."""
    best = F.try_element_at(F.filter(references, lambda r: r["type"].isin("ADVISORY", "WEB")), F.lit(1))
    return F.coalesce(best["url"], F.try_element_at(references, F.lit(1))["url"], F.lit(""))


def reachability(findings: DataFrame, imports: DataFrame, name: str = "package_name", dependencies: DataFrame | None = None) -> DataFrame:
    """Adds reach_tier: 1 imported by this name, 2 in another letter case or under another known name, 3 by a path below or above it, 4 by its name without scope, 6 not imported but a direct one of dependencies (name, is_direct), 5 none of these.

    The tiers are tried in this order, 6 before 5. The path tier joins on exploded path prefixes and
    the second on exploded names, so every tier is an equality join.
    """
    i = imports.select(F.col("package").alias("_i")).where("_i is not null").distinct()

    def prefixes(c: Column) -> Column:
        steps = F.split(c, "/")
        return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))

    f = findings.select(F.col(name).alias("_n")).where("_n is not null").distinct()
    exact = f.join(i, f["_n"] == i["_i"], "left_semi").select("_n", F.lit(1).alias("t"))
    other = f.select("_n", F.explode(import_names(F.col("_n"))).alias("_l")).withColumn("_l", F.lower("_l")).join(i.select(F.lower("_i").alias("_l")).distinct(), "_l", "left_semi").select("_n", F.lit(2).alias("t"))
    below = f.select("_n", F.explode(prefixes(F.col("_n"))).alias("_i")).join(i, "_i", "left_semi").select("_n", F.lit(3).alias("t"))
    above = f.join(i.select(F.explode(prefixes(F.col("_i"))).alias("_n")).distinct(), "_n", "left_semi").select("_n", F.lit(3).alias("t"))
    bare = lambda c: F.element_at(F.split(c, "/"), -1)
    scoped = f.withColumn("_b", bare(F.col("_n"))).join(i.select(bare(F.col("_i")).alias("_b")).distinct(), "_b", "left_semi").select("_n", F.lit(4).alias("t"))
    found = exact.union(other).union(below).union(above).union(scoped)
    if dependencies is not None:
        found = found.union(f.join(dependencies.where("is_direct").select(F.col("name").alias("_n")).distinct(), "_n", "left_semi").select("_n", F.lit(6).alias("t")))
    tiers = found.groupBy("_n").agg(F.min("t").alias("_t"))
    return findings.join(tiers, findings[name] == tiers["_n"], "left").withColumn("reach_tier", F.coalesce("_t", F.lit(5))).drop("_n", "_t")


#: Markers of licence families in upper case, tried in this order within a family (fixed values).
PERMISSIVE = ("MIT", "APACHE", "BSD", "ISC", "ZLIB", "UNLICENSE", "CC0", "WTFPL", "0BSD", "PYTHON", "POSTGRESQL", "BOOST", "BSL-1.0", "NCSA", "X11", "CC-BY-4.0", "CC BY 4.0", "ODC-BY", "PUBLIC DOMAIN")
WEAK_COPYLEFT = ("LGPL", "MPL", "EPL", "CDDL", "CPL", "EUPL", "OSL", "MS-RL")
STRONG_COPYLEFT = ("AGPL", "GPL", "SSPL", "CC-BY-SA", "CC BY-SA", "ODBL")


def licence_category(licence: Column) -> Column:
    """proprietary, permissive, weak-copyleft, copyleft or unknown; of a compound the most restrictive part."""
    up = F.upper(F.trim(text(licence)))

    def single(c: Column) -> Column:
        has = lambda words: F.greatest(*[c.contains(w) for w in words])
        return (
            F.when(c == "", 0).when(c.contains("PROPRIETARY") | c.contains("COMMERCIAL") | (c == "UNLICENSED"), 4).when(has(WEAK_COPYLEFT), 2).when(has(STRONG_COPYLEFT), 3).when(has(PERMISSIVE), 1).otherwise(0)
        )

    rank = F.array_max(F.transform(F.split(up, r" OR | AND | WITH |,"), lambda x: single(F.trim(x))))
    return F.when(rank == 4, "proprietary").when(rank == 3, "copyleft").when(rank == 2, "weak-copyleft").when(rank == 1, "permissive").otherwise("unknown")


def normalise_licence_text(body: Column) -> Column:
    """Lower case without copyright lines, punctuation and repeated white space."""
    kept = F.array_join(F.filter(F.split(F.lower(text(body)), r"\r?\n"), lambda x: ~x.rlike(r"^\s*(copyright|\(c\)|©)")), " ")
    return F.trim(F.regexp_replace(F.regexp_replace(kept, r"[^\p{L}\p{Nd}\s]", ""), r"\s+", " "))


def best_licence(body: Column, known: dict[str, str], threshold: float = 0.8) -> Column:
    """The known licence (name: text) whose character bigrams are nearest to the text's by Dice, null below the threshold; of equal ones the last name."""
    # the known texts' bigrams are made once, not in every row
    made = SparkSession.active().range(1).select(*[bigrams(normalise_licence_text(F.lit(t))) for t in known.values()]).first()
    theirs = [(name, F.lit(list(b)), len(b)) for name, b in zip(known, made, strict=True)]

    def nearest(mine: Column) -> Column:
        score = lambda b, n: F.round(2.0 * F.size(F.array_intersect(mine, b)) / (F.size(mine) + n), 9)
        return F.array_max(F.array(*[F.struct(score(b, n).alias("score"), F.lit(name).alias("name")) for name, b, n in theirs]))

    best = F.transform(F.array(bigrams(normalise_licence_text(body))), nearest)[0]
    return F.when(best["score"] >= threshold, best["name"])


def event_pairs(events: Column) -> Column:
    """Folds an ordered event list into (introduced, fixed, last_affected) ranges: a fixed or last_affected event closes the open introduction; an open one at the end stays unbounded. A closing event without an opening one closes a range from the start on."""
    kind = "array<struct<introduced:string,fixed:string,last_affected:string>>"
    start = F.struct(F.lit(None).cast("string").alias("open"), F.array().cast(kind).alias("done"))
    made = lambda a, f, l: F.array(F.struct(a.cast("string").alias("introduced"), f.cast("string").alias("fixed"), l.cast("string").alias("last_affected")))
    none = F.lit(None)

    def step(state: Column, e: Column) -> Column:
        opened, closes = e["introduced"].isNotNull(), e["fixed"].isNotNull() | e["last_affected"].isNotNull()
        before = F.when(opened & state["open"].isNotNull(), F.concat(state["done"], made(state["open"], none, none))).otherwise(state["done"])
        begin = F.when(opened, e["introduced"]).otherwise(F.coalesce(state["open"], F.lit("0")))
        done = F.when(closes, F.concat(before, made(begin, e["fixed"], F.when(e["fixed"].isNull(), e["last_affected"])))).otherwise(before)
        return F.struct(F.when(closes, none).when(opened, e["introduced"]).otherwise(state["open"]).alias("open"), done.alias("done"))

    finish = lambda state: F.when(state["open"].isNotNull(), F.concat(state["done"], made(state["open"], none, none))).otherwise(state["done"])
    return F.aggregate(events, start, step, finish)


def latest_wins(rows: DataFrame, keys: list[str], order: list[Column], first: bool = False) -> DataFrame:
    """Upsert: the last row of each key in the ascending order, or the first; by partial aggregation."""
    pick = F.min_by if first else F.max_by
    groups = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    return groups.agg(pick(F.struct(*rows.columns), F.struct(*order)).alias("_row")).select("_row.*")


def package_url(kind: Column, namespace: Column, name: Column, version: Column) -> Column:
    """pkg:type/namespace/name@version; empty parts are left out."""
    return F.concat(F.lit("pkg:"), F.lower(kind), F.lit("/"), F.when(text(namespace) != "", F.concat(F.regexp_replace(namespace, "@", "%40"), F.lit("/"))).otherwise(""), F.regexp_replace(name, "@", "%40"), F.when(text(version) != "", F.concat(F.lit("@"), version)).otherwise(""))
