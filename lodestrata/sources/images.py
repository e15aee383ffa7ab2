"""Container layers, operating systems and package databases as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.session import bounded_broadcast


def overlay(entries: DataFrame) -> DataFrame:
    """The visible file system of ordered layers: entries (layer_idx, tar_ordinal, path, ...) with is_deleted.

    A later entry overwrites a path; ``dir/.wh.name`` deletes dir/name and all below it, and
    ``dir/.wh..wh..opq`` deletes all that was below dir before it. Deletions find their targets by
    equality on exploded path prefixes; deleted rows stay with is_deleted.
    """
    at = F.struct("layer_idx", "tar_ordinal")
    base = F.element_at(F.split("path", "/"), -1)
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    mark, name = base.startswith(".wh."), F.regexp_replace(base, r"^[.]wh[.]", "")
    target = F.when(base == ".wh..wh..opq", folder).otherwise(F.when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name)))
    marks = entries.where(mark).select(target.alias("_target"), (base == ".wh..wh..opq").alias("_opaque"), at.alias("_at"))
    files = entries.where(~mark)
    latest = files.withColumn("_n", F.row_number().over(W.partitionBy("path").orderBy(F.col("layer_idx").desc(), F.col("tar_ordinal").desc()))).where("_n = 1").drop("_n")
    steps = F.split("path", "/")
    prefixes = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/")))
    reach = latest.select("path", at.alias("_mine"), F.explode(prefixes).alias("_target")).join(marks, "_target").where((F.col("_at") > F.col("_mine")) & ~(F.col("_opaque") & (F.col("_target") == F.col("path"))))
    gone = reach.select("path").distinct().withColumn("is_deleted", F.lit(True))
    return latest.join(gone, "path", "left").fillna(False, ["is_deleted"])


def layer_blame(packages: DataFrame, layers: DataFrame) -> DataFrame:
    """packages (layer_digest) with the layer's command and whether all layers up to it look like a base image.

    A layer list is one image's: a few hundred rows.
    """
    w = W.orderBy("layer_idx").rowsBetween(W.unboundedPreceding, 0)
    base_like = F.col("created_by").rlike(r"(?i)ADD file:|/bin/sh -c #\(nop\)|CMD|ENV PATH")
    marked = layers.withColumn("is_base", F.bool_and(base_like).over(w)).select(F.col("layer_digest"), "layer_idx", "created_by", "is_base")
    return packages.join(bounded_broadcast(marked), "layer_digest", "left")


def os_release(content: Column) -> Column:
    """struct(id, version, name) of an os-release text."""
    lines = F.filter(F.transform(F.split(content, r"\r?\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^[A-Z_]+="))
    entries = F.map_from_entries(F.transform(F.array_distinct(lines), lambda x: F.struct(F.regexp_extract(x, r"^([A-Z_]+)=", 1).alias("k"), F.regexp_replace(F.regexp_extract(x, r"^[A-Z_]+=(.*)$", 1), r"""^["']|["']$""", "").alias("v"))))
    return F.struct(F.try_element_at(entries, F.lit("ID")).alias("id"), F.try_element_at(entries, F.lit("VERSION_ID")).alias("version"), F.try_element_at(entries, F.lit("PRETTY_NAME")).alias("name"))


def _records(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(key, record): blank-line separated records."""
    return rows.select(key, F.explode(F.split(F.regexp_replace(content, r"\r", ""), r"\n[ \t]*\n+")).alias("record")).where(F.trim("record") != "")


def _value(name: str) -> Column:
    return F.trim(F.regexp_extract("record", rf"(?m)^{name}:[ \t]*(.*)$", 1))


def dpkg_packages(rows: DataFrame, key: str, content: str) -> DataFrame:
    """Installed packages of a dpkg status text; the source may carry a version in parentheses."""
    r = _records(rows, key, content).where(_value("Status") == "install ok installed")
    source = F.regexp_replace(_value("Source"), r"\s*\(.*\)$", "")
    return r.select(key, _value("Package").alias("name"), _value("Version").alias("version"), _value("Architecture").alias("architecture"), F.when(source != "", source).otherwise(_value("Package")).alias("source_package")).where("name <> ''")


def apk_packages(rows: DataFrame, key: str, content: str) -> DataFrame:
    """Packages of an apk installed database."""
    r = _records(rows, key, content)
    return r.select(key, _value("P").alias("name"), _value("V").alias("version"), _value("A").alias("architecture"), _value("o").alias("source_package")).where("name <> ''")


def language_packages(files: DataFrame) -> DataFrame:
    """(path, ecosystem, name, version) of installed language packages in a table (path, content): node modules, Python metadata, jar properties."""
    path, text = F.col("path"), F.col("content")
    field = lambda p: F.trim(F.regexp_extract(text, p, 1))
    npm, python, jar = path.rlike(r"(^|/)node_modules/(@[^/]+/)?[^/]+/package\.json$"), path.rlike(r"\.(dist-info/METADATA|egg-info/PKG-INFO)$"), path.rlike(r"META-INF/maven/.*/pom\.properties$")
    name = F.when(npm, F.get_json_object(text, "$.name")).when(python, field(r"(?m)^Name:[ \t]*(.*)$")).when(jar, F.concat_ws(":", field(r"(?m)^groupId=(.*)$"), field(r"(?m)^artifactId=(.*)$")))
    version = F.when(npm, F.get_json_object(text, "$.version")).when(python, field(r"(?m)^Version:[ \t]*(.*)$")).when(jar, field(r"(?m)^version=(.*)$"))
    kind = F.when(npm, "npm").when(python, "pypi").when(jar, "maven")
    return files.select("path", kind.alias("ecosystem"), name.alias("name"), version.alias("version")).where("ecosystem is not null and name <> ''")


def catalog(frames: list[DataFrame]) -> DataFrame:
    """Union of package frames; missing columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


_LABEL = "coalesce(try_element_at(labels, 'org.opencontainers.image.{0}'), '') = ''"
_PORT = "try_cast(split(p, '/')[0] as int)"
#: Hardening checks of an image configuration row: id, severity, condition (SQL over user, env, exposed_ports, labels, has_healthcheck).
HARDENING_CHECKS = (
    ("IMG-ROOT-USER", "high", "coalesce(user, '') in ('', 'root', '0')"),
    ("IMG-NO-USER", "medium", "coalesce(user, '') = ''"),
    ("IMG-SECRET-ENV", "high", "exists(env, e -> e rlike '(?i)^[A-Z_]*(password|secret|token|api_?key)[A-Z_]*=.+')"),
    ("IMG-SSH-PORT", "medium", f"exists(exposed_ports, p -> {_PORT} = 22)"),
    ("IMG-NO-HEALTHCHECK", "low", "not has_healthcheck"),
    ("IMG-NO-MAINTAINER", "low", f"{_LABEL.format('authors')} or {_LABEL.format('vendor')}"),
    ("IMG-NO-SOURCE", "low", _LABEL.format("source")),
)
#: Misconfigurations of an image configuration row, which also has tag, working_dir and stop_signal.
CONFIG_CHECKS = (
    ("CFG-LATEST-TAG", "high", "coalesce(tag, '') in ('', 'latest')"),
    *((f"CFG-NO-LABEL-{x.upper()}", "medium", f"not coalesce(map_contains_key(labels, 'org.opencontainers.image.{x}'), false)") for x in ("title", "version", "description", "licenses", "source", "vendor", "documentation")),
    ("CFG-ADMIN-PORT", "high", f"exists(exposed_ports, p -> {_PORT} in (21, 22, 23, 3389, 5900))"),
    ("CFG-NO-HEALTHCHECK", "medium", "not has_healthcheck"),
    ("CFG-ROOT-FOLDER", "low", "coalesce(working_dir, '') in ('', '/')"),
    ("CFG-NO-STOP-SIGNAL", "low", "coalesce(stop_signal, '') = ''"),
)
#: Hardening checks of file entries: id, severity, condition (SQL over path with a leading slash, mode, size, is_dir).
FILE_CHECKS = (
    ("IMG-SETUID", "high", "not is_dir and (mode & 2048) <> 0"),
    ("IMG-SETGID", "medium", "not is_dir and (mode & 1024) <> 0"),
    ("IMG-WORLD-WRITABLE", "medium", "is_dir and (mode & 2) <> 0 and (mode & 511) <> 511"),
    ("IMG-PRIVATE-KEY", "high", "path rlike '(^|/)(id_rsa|id_dsa|id_ed25519|.*[.]pem|.*[.]key)$'"),
    ("IMG-LARGE-BINARY", "low", "not is_dir and size > 104857600 and path rlike '^/?(usr/bin|usr/local/bin|bin|sbin)/'"),
    ("IMG-SHELL-HISTORY", "medium", "path rlike '(^|/)[.](bash|zsh|sh)_history$'"),
    ("IMG-PACKAGE-CACHE", "low", "path rlike '^/?(var/cache/(apt|apk|yum|dnf)|var/lib/apt/lists|root/[.]cache/pip|root/[.]npm)(/|$)'"),
    ("IMG-SHELL", "low", "not is_dir and path rlike '^/?(usr/)?bin/(sh|bash|ash|dash|zsh|ksh)$'"),
    ("IMG-NETWORK-TOOL", "medium", "not is_dir and path rlike '(^|/)(curl|wget|nc|ncat|netcat|nmap|telnet|tcpdump)$'"),
    ("IMG-SUDO", "medium", "not is_dir and path rlike '^/?(usr/)?bin/sudo$'"),
)


def run_checks(rows: DataFrame, checks: tuple = CONFIG_CHECKS) -> DataFrame:
    """One row for each row and check that holds; one pass, no union."""
    hits = F.filter(F.array(*[F.when(F.expr(sql), F.struct(F.lit(i).alias("rule_id"), F.lit(s).alias("severity"))) for i, s, sql in checks]), lambda x: x.isNotNull())
    return rows.withColumn("_h", F.explode(hits)).select("*", "_h.*").drop("_h")
