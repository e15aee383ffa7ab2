"""Report formats as JSON columns and chunked documents.

A report of findings has one JSON object a finding, made where the row lies. Documents that nest
them (`documents`) are cut into chunks of a fixed number of rows, numbered by a global order, so no
document gathers an unbounded group; every row is in exactly one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import findings as fx
from lodestrata.functions.text import short_hash
from lodestrata.operators.ranking import global_rank

SARIF_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
QUALITY_SEVERITY = {"critical": "blocker", "high": "critical", "medium": "major", "low": "minor", "info": "info"}
#: Exploitability states by reachability (fixed values).
VEX_STATE = {"high": "exploitable", "medium": "exploitable", "low": "in_triage", "none": "not_affected", "unknown": "in_triage"}


def _label(c: Column, table: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def rule_or_kind(f: DataFrame) -> Column:
    return F.when(fx.text("rule_id") != "", F.col("rule_id")).otherwise(F.concat_ws("-", fx.text("finding_type"), fx.text("analyzer")))


def sarif_results(findings: DataFrame) -> DataFrame:
    """(id, rule, result): one SARIF 2.1.0 result a finding; a region only where the line is positive, fingerprints as partial fingerprints."""
    region = F.when(F.col("line_start") > 0, F.struct(F.col("line_start").alias("startLine"), F.when(F.col("line_end") >= F.col("line_start"), F.col("line_end")).alias("endLine")))
    place = F.struct(F.struct(F.struct(fx.text("file_path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    prints = F.struct(fx.semantic_fingerprint().alias("semantic/v1"), fx.location_fingerprint().alias("location/v1"))
    rule = rule_or_kind(findings)
    result = F.struct(rule.alias("ruleId"), _label(F.col("severity"), SARIF_LEVEL, "none").alias("level"), F.struct(fx.text("title").alias("text")).alias("message"), F.array(place).alias("locations"), prints.alias("partialFingerprints"))
    return findings.select("id", rule.alias("rule"), F.to_json(result).alias("result"))


def documents(rows: DataFrame, item: str, order: list[Column], envelope: tuple[str, str], per_document: int = 5000, separator: str = ",") -> DataFrame:
    """(document_no, document): items of a column joined in order between the two halves of an envelope, at most per_document a document."""
    placed = global_rank(rows.select(item, *[o.alias(f"_o{i}") for i, o in enumerate(order)]), [F.col(f"_o{i}") for i in range(len(order))])
    chunk = placed.withColumn("document_no", F.floor((F.col("place") - 1) / per_document))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", item))), lambda x: x[item]), separator)
    return chunk.groupBy("document_no").agg(F.concat(F.lit(envelope[0]), joined, F.lit(envelope[1])).alias("document"))


def sarif_documents(findings: DataFrame, tool: str = "lodestrata", version: str = "1", per_document: int = 5000) -> DataFrame:
    head = f'{{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{tool}","version":"{version}"}}}},"invocations":[{{"executionSuccessful":true}}],"results":['
    return documents(sarif_results(findings), "result", [F.col("id")], (head, "]}]}"), per_document)


def code_quality(findings: DataFrame) -> DataFrame:
    """(id, entry): one code-quality entry a finding."""
    entry = F.struct(
        fx.text("title").alias("description"), rule_or_kind(findings).alias("check_name"), fx.location_fingerprint().alias("fingerprint"), _label(F.col("severity"), QUALITY_SEVERITY, "info").alias("severity"),
        F.struct(fx.text("file_path").alias("path"), F.struct(F.greatest(F.coalesce("line_start", F.lit(1)), F.lit(1)).alias("begin")).alias("lines")).alias("location"),
    )
    return findings.select("id", F.to_json(entry).alias("entry"))


def components(packages: DataFrame) -> DataFrame:
    """(bom_ref, component): distinct CycloneDX components of (purl, name, version, license)."""
    one = packages.dropDuplicates(["purl"])
    licences = F.when(fx.text("license") != "", F.array(F.struct(F.struct(F.col("license").alias("id")).alias("license"))))
    return one.select(F.col("purl").alias("bom_ref"), F.to_json(F.struct(F.lit("library").alias("type"), F.col("purl").alias("bom-ref"), "name", "version", "purl", licences.alias("licenses"))).alias("component"))


def cyclonedx(packages: DataFrame, per_document: int = 5000) -> DataFrame:
    return documents(components(packages), "component", [F.col("bom_ref")], ('{"bomFormat":"CycloneDX","specVersion":"1.5","version":1,"components":[', "]}"), per_document)


def spdx_packages(packages: DataFrame) -> DataFrame:
    """(spdx_id, package): distinct SPDX packages."""
    one = packages.dropDuplicates(["purl"])
    spdx_id = F.concat(F.lit("SPDXRef-Package-"), short_hash(F.col("purl")))
    licence = F.coalesce(F.nullif("license", F.lit("")), F.lit("NOASSERTION"))
    ref = F.array(F.struct(F.lit("PACKAGE-MANAGER").alias("referenceCategory"), F.lit("purl").alias("referenceType"), F.col("purl").alias("referenceLocator")))
    return one.select(spdx_id.alias("spdx_id"), F.to_json(F.struct(spdx_id.alias("SPDXID"), "name", F.col("version").alias("versionInfo"), F.lit("NOASSERTION").alias("downloadLocation"), licence.alias("licenseConcluded"), ref.alias("externalRefs"))).alias("package"))


def spdx(packages: DataFrame, name: str = "scan", per_document: int = 5000) -> DataFrame:
    head = f'{{"spdxVersion":"SPDX-2.3","dataLicense":"CC0-1.0","SPDXID":"SPDXRef-DOCUMENT","name":"{name}","packages":['
    return documents(spdx_packages(packages), "package", [F.col("spdx_id")], (head, "]}"), per_document)


def vex_statements(findings: DataFrame) -> DataFrame:
    """(vuln_id, purl, state, statement) of dependency findings by their reachability."""
    state = _label(F.col("reachability"), VEX_STATE, "in_triage")
    why = F.when(F.col("reachability") == "none", "code_not_reachable")
    return findings.select("vuln_id", "purl", state.alias("state"), F.to_json(F.struct(F.col("vuln_id").alias("id"), F.struct(state.alias("state"), why.alias("justification")).alias("analysis"), F.array(F.struct(F.col("purl").alias("ref"))).alias("affects"))).alias("statement"))


def annotations(placed: DataFrame) -> DataFrame:
    """(id, annotation): findings inside the diff that have a file and a line."""
    level = _label(F.col("severity"), {"critical": "failure", "high": "failure", "medium": "warning"}, "notice")
    keep = placed.where("in_diff and line_start > 0 and coalesce(file_path, '') <> ''")
    return keep.select("id", F.to_json(F.struct(F.col("file_path").alias("path"), F.col("line_start").alias("start_line"), F.coalesce("line_end", "line_start").alias("end_line"), level.alias("annotation_level"), fx.text("title").alias("message"))).alias("annotation"))


def severity_counts(findings: DataFrame) -> DataFrame:
    """(severity, findings), worst first; unknown severities count together, so there are at most six rows."""
    known = F.when(F.col("severity").isin(*fx.SEVERITY_ORDER), F.col("severity")).otherwise("other")
    n = findings.groupBy(known.alias("severity")).agg(F.count(F.lit(1)).alias("findings"))
    return n.orderBy(fx.severity_order(F.col("severity")).desc())


def markdown_summary(findings: DataFrame) -> str:
    """A small Markdown table of counts by severity; every finding is counted."""
    return "| severity | findings |\n|-|-|\n" + "".join(f"| {r.severity} | {r.findings} |\n" for r in severity_counts(findings).collect())


_REPORT = ("id", "finding_type", "analyzer", "severity", "confidence", "title", "file_path", "line_start", "rule_id", "cwe_id")


def json_entries(findings: DataFrame) -> DataFrame:
    """(id, entry): one JSON object a finding; missing values are left out."""
    return findings.select("id", F.to_json(F.struct(*_REPORT)).alias("entry"))


def json_documents(findings: DataFrame, per_document: int = 5000) -> DataFrame:
    """(document_no, document): JSON reports of at most per_document findings in the order of their ids."""
    return documents(json_entries(findings), "entry", [F.col("id")], ('{"findings":[', "]}"), per_document)


def digests(docs: DataFrame, items: str) -> DataFrame:
    """(document_no, n, digest) of JSON documents: the items counted after parsing them back, and the text's SHA-256."""
    return docs.select("document_no", F.size(F.from_json(F.get_json_object("document", items), "array<string>")).alias("n"), F.sha2("document", 256).alias("digest"))


def dependency_edges(tree: DataFrame) -> DataFrame:
    """(depth, parent, child): the distinct edges root -> ecosystem (depth 1) and ecosystem -> package (2) of a table (ecosystem, package_name)."""
    top = tree.select(F.lit(1).alias("depth"), F.lit("root").alias("parent"), F.col("ecosystem").alias("child")).distinct()
    return top.unionByName(tree.select(F.lit(2).alias("depth"), F.col("ecosystem").alias("parent"), F.col("package_name").alias("child")).distinct())


def _dot_lines(tree: DataFrame) -> DataFrame:
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(fx.text(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return dependency_edges(tree).withColumn("line", F.concat(F.lit("  "), quoted("parent"), F.lit(" -> "), quoted("child"), F.lit(";\n")))


_DOT = ("digraph deps {\n", "}\n")


def dependency_dot_documents(tree: DataFrame, per_document: int = 5000) -> DataFrame:
    """(document_no, document): DOT graphs of at most per_document edges; every edge of dependency_edges is in one."""
    return documents(_dot_lines(tree), "line", [F.col("depth"), F.col("parent"), F.col("child")], _DOT, per_document, "")


def dependency_dot(tree: DataFrame) -> str:
    """One DOT graph root -> ecosystem -> package of a table (ecosystem, package_name), with every edge; the text is made on the driver, which dependency_dot_documents avoids."""
    return _DOT[0] + "".join(r.line for r in _dot_lines(tree).orderBy("depth", "parent", "child").select("line").toLocalIterator()) + _DOT[1]


def text_table(df: DataFrame, limit: int = 20) -> str:
    """The first rows as an aligned table for a terminal."""
    rows = [[str(x) if x is not None else "" for x in r] for r in df.limit(limit).collect()]
    widths = [max([len(c), *(len(r[i]) for r in rows)]) for i, c in enumerate(df.columns)]
    line = lambda r: "  ".join(x.ljust(w) for x, w in zip(r, widths, strict=True)).rstrip()
    return "\n".join([line(df.columns), line(["-" * w for w in widths]), *map(line, rows)])


def write_baseline(findings: DataFrame, folder: str, name: str) -> None:
    """Overwrites one named baseline; other names stay."""
    spark = findings.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        findings.withColumn("baseline", F.lit(name)).write.mode("overwrite").partitionBy("baseline").parquet(folder)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
