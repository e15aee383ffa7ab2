"""Advisory feeds, tool outputs and diffs as rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.findings import severity_label

_ALPINE = "struct<distroversion:string,packages:array<struct<pkg:struct<name:string,secfixes:map<string,array<string>>>>>>"
_NVD = "struct<vulnerabilities:array<struct<cve:struct<id:string,descriptions:array<struct<lang:string,value:string>>,metrics:struct<cvssMetricV31:array<struct<cvssData:struct<baseScore:double,vectorString:string>>>,cvssMetricV30:array<struct<cvssData:struct<baseScore:double,vectorString:string>>>,cvssMetricV2:array<struct<cvssData:struct<baseScore:double,vectorString:string>>>>,configurations:array<struct<nodes:array<struct<cpeMatch:array<struct<vulnerable:boolean,criteria:string,versionStartIncluding:string,versionEndExcluding:string>>>>>>>>>>"


def alpine(rows: DataFrame, body: str = "body") -> DataFrame:
    """Fixes of an Alpine feed: key 0 means not affected, the first token of an entry is the id."""
    r = rows.select(F.from_json(body, _ALPINE).alias("j")).select(F.regexp_replace("j.distroversion", "^v", "").alias("distro_version"), F.explode("j.packages").alias("p"))
    fixes = r.select("distro_version", F.col("p.pkg.name").alias("package_name"), F.explode("p.pkg.secfixes").alias("version", "ids"))
    e = fixes.select("distro_version", "package_name", "version", F.explode("ids").alias("id"))
    zero = F.col("version") == "0"
    return e.select(F.split(F.trim("id"), r"\s+")[0].alias("vuln_id"), "package_name", "distro_version", F.when(zero, "").otherwise(F.col("version")).alias("fixed_version"), F.when(zero, "not-affected").otherwise("fixed").alias("status"))


def debian(rows: DataFrame, releases: dict[str, str], body: str = "body") -> DataFrame:
    """Tracker rows: resolved gives a fix, open an unbounded row, undetermined and unknown releases none. All packages and releases of an id stay."""
    kind = "map<string,map<string,struct<releases:map<string,struct<status:string,fixed_version:string>>>>>"
    r = rows.select(F.explode(F.from_json(body, kind)).alias("package_name", "v")).select("package_name", F.explode("v").alias("vuln_id", "x")).select("package_name", "vuln_id", F.explode("x.releases").alias("release", "s"))
    number = F.create_map(*[F.lit(x) for kv in releases.items() for x in kv])
    out = r.select("vuln_id", "package_name", F.try_element_at(number, F.col("release")).alias("distro_version"), F.when(F.col("s.status") == "resolved", F.coalesce("s.fixed_version", F.lit(""))).otherwise("").alias("fixed_version"), F.when(F.col("s.status") == "resolved", "fixed").when(F.col("s.status") == "open", "affected").alias("status"))
    return out.where("status is not null and distro_version is not null")


def nvd(rows: DataFrame, body: str = "body") -> DataFrame:
    """Vulnerable products of NVD pages with start-including and end-excluding bounds; hardware and empty products are skipped; CVSS 3.1 before 3.0 before 2."""
    c = rows.select(F.explode(F.from_json(body, _NVD)["vulnerabilities"]).alias("v")).select("v.cve.*")
    score = lambda m: F.try_element_at(F.col(f"metrics.{m}"), F.lit(1))["cvssData"]["baseScore"]
    matches = F.flatten(F.flatten(F.transform("configurations", lambda x: F.transform(x["nodes"], lambda n: n["cpeMatch"]))))
    e = c.select("id", F.coalesce(score("cvssMetricV31"), score("cvssMetricV30"), score("cvssMetricV2")).alias("cvss_score"), F.explode(matches).alias("m")).where("m.vulnerable")
    part, vendor, product = (F.split("m.criteria", ":")[i] for i in (2, 3, 4))
    return e.where((part != "h") & ~product.isin("", "*", "-")).select(F.col("id").alias("vuln_id"), "cvss_score", vendor.alias("vendor"), product.alias("package_name"), F.col("m.versionStartIncluding").alias("introduced_version"), F.col("m.versionEndExcluding").alias("fixed_version"))


def ubuntu(rows: DataFrame, body: str = "body") -> DataFrame:
    """Fixes of an OVAL document: vulnerability definitions, the id from the title, distinct (package, version) from the criteria's comments, at any depth. All packages of an id stay."""
    definitions = F.explode(F.regexp_extract_all(body, F.lit(r'(?s)<definition\b[^>]*class="vulnerability".*?</definition>'), F.lit(0)))
    d = rows.select(definitions.alias("d")).select(F.regexp_extract("d", r"<title>[^<]*?(CVE-[0-9]{4}-[0-9]+)", 1).alias("vuln_id"), F.explode(F.array_distinct(F.regexp_extract_all("d", F.lit(r'<criterion\b[^>]*comment="([^"]*)"'), F.lit(1)))).alias("comment"))
    package = F.regexp_extract("comment", r"^(?:\(.*?\)\s*)?([a-z0-9][a-z0-9+.-]*)\s+(?:package in|was|source package)", 1)
    version = F.regexp_extract("comment", r"(?:note:\s*'?|fixed\)?\s*\(?(?:note:\s*)?'?|version\s+'?)([0-9][^'\s)]*)", 1)
    return d.where("vuln_id <> ''").select("vuln_id", package.alias("package_name"), version.alias("fixed_version")).where("package_name <> '' and fixed_version <> ''").distinct()


def write_mirror(affected: DataFrame, folder: str) -> None:
    """The local mirror: partitioned by ecosystem and sorted by package, so a lookup prunes partitions and row groups."""
    affected.repartition("ecosystem").sortWithinPartitions("package_name").write.mode("overwrite").partitionBy("ecosystem").parquet(folder)


def tool_findings(rows: DataFrame, analyzer: str, fields: dict[str, str], body: str = "body", items: str | None = None) -> DataFrame:
    """Findings of an external tool's JSON: fields name -> JSON path within an item; severities by the tools' labels."""
    item = F.explode(F.from_json(F.get_json_object(body, items), "array<string>")) if items else F.col(body)
    r = rows.select(item.alias("_i"))
    out = r.select(F.lit(analyzer).alias("analyzer"), *[F.get_json_object("_i", p).alias(n) for n, p in fields.items()])
    return out.withColumn("severity", severity_label(F.col("severity"))) if "severity" in fields else out


def unified_diff(rows: DataFrame, key: str, diff: str) -> DataFrame:
    """(key, path, hunk_no, new_start, new_count, kind, content, old_line, new_line) of each line of a unified diff.

    Files and hunks are numbered by running sums over the diff's lines and line numbers by running
    counts, partitioned by diff.
    """
    lines = rows.select(key, F.posexplode(F.split(diff, r"\r?\n")).alias("pos", "line"))
    w = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    head = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    is_file, is_hunk = F.col("line").startswith("diff --git "), F.col("line").rlike(head)
    l = lines.withColumns({"file_no": F.sum(is_file.cast("int")).over(w), "hunk_no": F.sum(is_hunk.cast("int")).over(w), "_h": is_hunk})
    number = lambda i: F.when(F.col("_h"), F.regexp_extract("line", head, i))
    l = l.withColumns({"_o": number(1).cast("int"), "_s": number(3).cast("int"), "_c": F.when(F.col("_h"), F.coalesce(F.nullif(F.regexp_extract("line", head, 4), F.lit("")).cast("int"), F.lit(1)))})
    start = W.partitionBy(key, "file_no", "hunk_no")
    l = l.withColumns({"old_start": F.max("_o").over(start), "new_start": F.max("_s").over(start), "new_count": F.max("_c").over(start)})
    # behind a "diff" line the file's header ends with its first hunk; without such lines any header line counts
    heading = F.col("line").rlike("^(---|[+][+][+]) ") & (F.col("new_start").isNull() | (F.col("file_no") == 0))
    path = F.when(heading & F.col("line").startswith("+++ "), F.regexp_replace("line", r"^\+\+\+ (?:b/)?", ""))
    l = l.withColumn("path", F.last(path, ignorenulls=True).over(W.partitionBy(key, "file_no").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))
    body = l.where(F.col("new_start").isNotNull() & ~F.col("_h") & F.col("line").rlike("^[ +-]") & ~heading)
    mark = F.substring("line", 1, 1)
    bw = W.partitionBy(key, "file_no", "hunk_no").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    new_line = F.col("new_start") - 1 + F.sum((mark != "-").cast("int")).over(bw)
    old_line = F.col("old_start") - 1 + F.sum((mark != "+").cast("int")).over(bw)
    kind = F.when(mark == "+", "added").when(mark == "-", "deleted").otherwise("context")
    return body.select(key, "path", "hunk_no", "new_start", "new_count", kind.alias("kind"), F.substring("line", 2, 1 << 30).alias("content"), F.when(mark != "+", old_line).alias("old_line"), F.when(mark != "-", new_line).alias("new_line"))


def files(spark, folder: str, glob: str = "*", max_bytes: int = 2 << 20) -> DataFrame:
    """(path, content, size) of the text files under a folder; names are filtered before contents are read."""
    from lodestrata.functions.text import is_text_file, is_third_party

    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    keep = is_text_file(F.col("path")) & ~is_third_party(F.col("path")) & (F.col("length") <= max_bytes)
    return f.where(keep).select("path", F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))


def suite_summaries(spark, folder: str) -> DataFrame:
    """(suite, ...): one summary.json of each result folder, keyed by the folder's name."""
    return spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "summary.json").json(folder).withColumn("suite", F.element_at(F.split(F.input_file_name(), "/"), -2))


def scan_files(spark, folder: str, max_bytes: int = 2 << 20, tests: bool = False, more_ignored: tuple[str, ...] = ()) -> DataFrame:
    """(path, language, content, size) of a folder's text files, paths relative to it.

    Left out by name, before any content is read: what the folder's .gitignore or more_ignored match,
    version control and dependency folders, third-party and minified files and, unless tests, test files.
    """
    import os

    from lodestrata.functions.text import is_test_path, is_third_party, language
    from lodestrata.operators.scan import ignored

    globs = [f"{d}/" for d in (".git", ".hg", ".svn", "node_modules", "vendor", ".venv", "venv", "__pycache__", "dist", "build", "target")]
    if os.path.isfile(own := os.path.join(folder, ".gitignore")):
        with open(own, encoding="utf-8", errors="replace") as f:
            globs += f.read().splitlines()
    found = files(spark, folder, max_bytes=max_bytes)
    root = os.path.abspath(folder).rstrip("/") + "/"
    found = found.withColumn("path", F.regexp_replace("path", "^.*?" + re.escape(root), ""))
    keep = ~ignored(F.col("path"), [*globs, *more_ignored]) & ~is_third_party(F.col("path"))
    out = found.where(keep if tests else keep & ~is_test_path(F.col("path")))
    return out.select("path", language(F.col("path")).alias("language"), "content", "size")


def _git(repository: str, *arguments: str) -> str:
    import subprocess

    return subprocess.run(["git", "-C", repository, *arguments], capture_output=True, check=True, text=True).stdout


def _kept(spark, repository: str, names: list[str], max_bytes: int) -> DataFrame:
    import os

    from lodestrata.functions.text import BINARY_EXTENSIONS

    texts = [n for n in names if n and not n.lower().endswith(BINARY_EXTENSIONS)]
    keep = [(n,) for n in texts if os.path.isfile(os.path.join(repository, n)) and os.path.getsize(os.path.join(repository, n)) <= max_bytes]
    return spark.createDataFrame(keep, "path string")


def git_changed(spark, repository: str, since: str = "HEAD~1", max_bytes: int = 2 << 20) -> DataFrame:
    """(path): files that a local repository changed since a reference and that are still there, text by name and not too large."""
    return _kept(spark, repository, _git(repository, "diff", "--name-only", "--diff-filter=d", "-z", since).split("\0"), max_bytes)


def git_staged(spark, repository: str, max_bytes: int = 2 << 20) -> DataFrame:
    """(path): the same of what is staged for the next commit."""
    return _kept(spark, repository, _git(repository, "diff", "--cached", "--name-only", "--diff-filter=d", "-z").split("\0"), max_bytes)


def git_stats(spark, repository: str, since: str = "HEAD~1") -> DataFrame:
    """(path, added, deleted): lines changed since a reference; null for binary files."""
    rows = []
    for entry in _git(repository, "diff", "--numstat", "--no-renames", "-z", since).split("\0"):
        if entry:
            added, deleted, path = entry.split("\t", 2)
            rows.append((path, None if added == "-" else int(added), None if deleted == "-" else int(deleted)))
    return spark.createDataFrame(rows, "path string, added int, deleted int")


def git_blame(spark, repository: str, paths: list[str]) -> DataFrame:
    """(path, author, lines): whose lines the given files hold; one process a file, so paths are those of a change."""
    rows = []
    for path in paths:
        authors = [line[7:] for line in _git(repository, "blame", "--line-porcelain", "--", path).splitlines() if line.startswith("author ")]
        rows += [(path, a, authors.count(a)) for a in dict.fromkeys(authors)]
    return spark.createDataFrame(rows, "path string, author string, lines int")


def inside(root: str, path: str) -> str:
    """The absolute path, an error if it leaves root."""
    import os

    full = os.path.realpath(os.path.join(root, path))
    if os.path.commonpath([os.path.realpath(root), full]) != os.path.realpath(root):
        raise ValueError("the path leaves its root")
    return full
