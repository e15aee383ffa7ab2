"""Dependency manifests and lockfiles as rows.

`dependencies(files)` parses a table of (path, content) with `mapInPandas`, one parser for each file
name; `problems(files)` names the files that can't be parsed, which give no rows. Maven parents,
discovery, union, coverage of workspace members and deduplication are relational.
"""

from __future__ import annotations

import configparser
import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.text import basename, normalize_path
from lodestrata.session import checkpoint, scratch

SCHEMA = "manifest_path string, name string, version string, ecosystem string, is_direct boolean, is_dev boolean, license string"
Dep = tuple[str, str, bool, bool, str]  # name, version, direct, dev, licence
_PARSERS: dict[str, tuple[str, Callable[[str], Iterator[Dep]]]] = {}


def parser(ecosystem: str, *names: str):
    def register(f):
        for n in names:
            _PARSERS[n] = (ecosystem, f)
        return f

    return register


@parser("go", "go.mod")
def _go_mod(text: str) -> Iterator[Dep]:
    block = False
    for line in text.splitlines():
        bare = line.split("//")[0].strip()
        if bare.startswith("require ("):
            block = True
        elif block and bare == ")":
            block = False
        elif m := re.match(r"(?:require\s+)?(\S+)\s+(v\S+)$", bare) if block or bare.startswith("require ") else None:
            yield m[1], m[2], "// indirect" not in line, False, ""


@parser("npm", "package.json")
def _package_json(text: str) -> Iterator[Dep]:
    top = json.loads(text)
    for key, dev in (("dependencies", False), ("devDependencies", True), ("optionalDependencies", False), ("peerDependencies", False)):
        for name, version in (top.get(key) or {}).items():
            yield name, str(version), True, dev, ""


@parser("npm", "package-lock.json", "npm-shrinkwrap.json")
def _package_lock(text: str) -> Iterator[Dep]:
    top = json.loads(text)
    packages = top.get("packages")
    if packages:
        root = packages.get("", {})
        direct = {*(root.get("dependencies") or {}), *(root.get("devDependencies") or {})}
        for path, p in packages.items():
            if path and "node_modules/" in path and not p.get("link"):
                name = path.rpartition("node_modules/")[2]
                yield name, str(p.get("version", "")), name in direct, bool(p.get("dev")), p.get("license") if isinstance(p.get("license"), str) else ""
        return
    stack = list((top.get("dependencies") or {}).items())
    first = len(stack)
    for i, (name, p) in enumerate(stack):
        yield name, str(p.get("version", "")), i < first, bool(p.get("dev")), ""
        stack += list((p.get("dependencies") or {}).items())


@parser("npm", "yarn.lock")
def _yarn_lock(text: str) -> Iterator[Dep]:
    name = None
    for line in text.splitlines():
        if line and not line[0].isspace() and not line.startswith("#"):
            m = re.match(r'"?(@?[^@"\s]+)@', line)
            name = m[1] if m and not line.startswith("__metadata") else None
        elif name and (m := re.match(r'\s+version:?\s+"?([^"\s]+)"?', line)):
            yield name, m[1], False, False, ""
            name = None


@parser("npm", "pnpm-lock.yaml")
def _pnpm_lock(text: str) -> Iterator[Dep]:
    inside = False
    for line in text.splitlines():
        if line and not line[0].isspace():
            inside = line.startswith("packages:")
        elif inside and (m := re.match(r"  ['\"]?/?(@?[^@'\"\s(]+?)[@/](\d[^'\"(:]*)(?:\([^)]*\))*['\"]?:", line)):
            yield m[1], m[2], False, False, ""


@parser("pypi", "requirements.txt", "requirements-dev.txt")
def _requirements(text: str) -> Iterator[Dep]:
    for line in text.splitlines():
        if m := re.match(r"\s*([A-Za-z0-9][\w.-]*)(?:\[[^\]]*\])?\s*(?:(==|>=|<=|~=|!=|>|<)\s*([^\s;,#]+))?", line.split("#")[0]):
            yield m[1], m[3] or "", True, False, ""


def _requirement(text: str, dev: bool) -> Dep | None:
    m = re.match(r"\s*([A-Za-z0-9][\w.-]*)(?:\[[^\]]*\])?\s*(?:[=<>~!]=?\s*([^\s;,]+))?", text)
    return (m[1], m[2] or "", True, dev, "") if m else None


@parser("pypi", "pyproject.toml")
def _pyproject(text: str) -> Iterator[Dep]:
    top = tomllib.loads(text)
    project = top.get("project", {})
    for r in project.get("dependencies", []):
        if d := _requirement(r, False):
            yield d
    for group in (project.get("optional-dependencies") or {}).values():
        for r in group:
            if d := _requirement(r, True):
                yield d
    poetry = top.get("tool", {}).get("poetry", {})
    groups = [(poetry.get("dependencies") or {}, False), (poetry.get("dev-dependencies") or {}, True)]
    groups += [(g.get("dependencies") or {}, True) for g in (poetry.get("group") or {}).values()]
    for table, dev in groups:
        for name, v in table.items():
            if name != "python":
                yield name, re.sub(r"^[\^~=<>! ]+", "", v if isinstance(v, str) else str(v.get("version", "")) if isinstance(v, dict) else ""), True, dev, ""


@parser("pypi", "poetry.lock", "uv.lock")
def _poetry_lock(text: str) -> Iterator[Dep]:
    for p in tomllib.loads(text).get("package", []):
        yield p["name"], str(p.get("version", "")), False, p.get("category") == "dev", ""


@parser("pypi", "Pipfile.lock")
def _pipfile_lock(text: str) -> Iterator[Dep]:
    top = json.loads(text)
    for key, dev in (("default", False), ("develop", True)):
        for name, p in (top.get(key) or {}).items():
            yield name, str(p.get("version", "")).lstrip("="), False, dev, ""


@parser("pypi", "setup.py")
def _setup_py(text: str) -> Iterator[Dep]:
    for m in re.finditer(r"install_requires\s*=\s*\[(.*?)\]", text, re.S):
        for r in re.findall(r"""["']([^"']+)["']""", m[1]):
            if d := _requirement(r, False):
                yield d


@parser("pypi", "setup.cfg")
def _setup_cfg(text: str) -> Iterator[Dep]:
    c = configparser.ConfigParser(interpolation=None, strict=False)
    c.read_string(text)
    groups = [(c.get("options", "install_requires", fallback=""), False), *((v, True) for v in (dict(c["options.extras_require"]) if c.has_section("options.extras_require") else {}).values())]
    for lines, dev in groups:
        for line in lines.splitlines():
            if line.strip() and (d := _requirement(line, dev)):
                yield d


@parser("cargo", "Cargo.toml")
def _cargo_toml(text: str) -> Iterator[Dep]:
    top = tomllib.loads(text)
    for key, dev in (("dependencies", False), ("dev-dependencies", True), ("build-dependencies", True)):
        for name, v in (top.get(key) or {}).items():
            yield name, v if isinstance(v, str) else str(v.get("version", "")), True, dev, ""


@parser("cargo", "Cargo.lock")
def _cargo_lock(text: str) -> Iterator[Dep]:
    for p in tomllib.loads(text).get("package", []):
        if "source" in p:
            yield p["name"], p.get("version", ""), False, False, ""


@parser("rubygems", "Gemfile.lock")
def _gemfile_lock(text: str) -> Iterator[Dep]:
    direct = set(re.findall(r"^  (\S+?)!?(?:\s|$)", text.partition("DEPENDENCIES")[2], re.M))
    for m in re.finditer(r"^    ([A-Za-z0-9][\w.-]*) \(([^)]+)\)", text, re.M):
        yield m[1], m[2], m[1] in direct, False, ""


@parser("rubygems", "Gemfile")
def _gemfile(text: str) -> Iterator[Dep]:
    for m in re.finditer(r"""^\s*gem\s+["']([^"']+)["'](?:\s*,\s*["'][~><= ]*([\d.]+)["'])?""", text, re.M):
        yield m[1], m[2] or "", True, False, ""


@parser("packagist", "composer.json")
def _composer(text: str) -> Iterator[Dep]:
    top = json.loads(text)
    for key, dev in (("require", False), ("require-dev", True)):
        for name, v in (top.get(key) or {}).items():
            if "/" in name:
                yield name, str(v), True, dev, ""


@parser("packagist", "composer.lock")
def _composer_lock(text: str) -> Iterator[Dep]:
    top = json.loads(text)
    for key, dev in (("packages", False), ("packages-dev", True)):
        for p in top.get(key) or []:
            yield p["name"], str(p.get("version", "")).lstrip("v"), False, dev, (p.get("license") or [""])[0]


def _filled(text: str | None, props: dict[str, str]) -> str:
    """A text with its ${properties}, whatever they refer to in turn; one that refers to itself stays."""
    out, seen = (text or "").strip(), set()
    while out not in seen:
        seen.add(out)
        out = re.sub(r"\$\{([^}]+)\}", lambda m: props.get(m[1], m[0]), out)
        if len(out) > 10_000:  # grows without end
            break
    return out


def _pom_parts(text: str) -> dict:
    """group, artifact, version, parent (path of the parent's file or null), props, managed {name: version}, deps [(name, version, scope)] of one pom as written."""
    root = ET.fromstring(re.sub(r'\sxmlns="[^"]+"', "", text, count=1))
    read = lambda node, tag: (node.findtext(tag) or "").strip()
    name = lambda d: f"{read(d, 'groupId')}:{read(d, 'artifactId')}"
    parent = root.find("parent")
    props = {p.tag: (p.text or "").strip() for p in root.iterfind("properties/*") if isinstance(p.tag, str)}
    group, version = read(root, "groupId") or read(root, "parent/groupId"), read(root, "version") or read(root, "parent/version")
    props |= {k: v for k, v in (("project.groupId", group), ("project.version", version), ("project.artifactId", read(root, "artifactId"))) if v}
    return {
        "parent": None if parent is None else parent.findtext("relativePath", "../pom.xml").strip() or None, "props": props, "modules": [(m.text or "").strip() for m in root.iterfind("modules/module")],
        "managed": {name(d): read(d, "version") for d in root.iterfind("dependencyManagement/dependencies/dependency")}, "deps": [(name(d), read(d, "version"), read(d, "scope")) for d in root.iterfind("dependencies/dependency")],
    }


def _pom_rows(parts: dict, props: dict[str, str], managed: dict[str, str]) -> Iterator[Dep]:
    versions = {_filled(k, props): v for k, v in managed.items()}
    for key, version, scope in parts["deps"]:
        name = _filled(key, props)
        yield name, _filled(version or versions.get(name, ""), props), True, scope == "test", ""


@parser("maven", "pom.xml")
def _pom(text: str) -> Iterator[Dep]:
    parts = _pom_parts(text)
    yield from _pom_rows(parts, parts["props"], parts["managed"])


@parser("maven", "build.gradle", "build.gradle.kts")
def _gradle(text: str) -> Iterator[Dep]:
    for m in re.finditer(r"""^\s*(\w*(?:mplementation|pi|ompile|untimeOnly|ompileOnly))\s*\(?\s*["']([^:"']+):([^:"']+):([^"']+)["']""", text, re.M):
        yield f"{m[2]}:{m[3]}", m[4], True, m[1].lower().startswith("test"), ""


@parser("helm", "Chart.yaml")
def _chart(text: str) -> Iterator[Dep]:
    inside, name = False, None
    for line in text.splitlines():
        if re.match(r"\S", line):
            inside = line.startswith("dependencies:")
        elif inside and (m := re.match(r"\s*(-\s*)?(name|version):\s*[\"']?([^\"'\s]+)", line)):
            if m[2] == "name":
                name = m[3]
            elif name:
                yield name, m[3], True, False, ""
                name = None


KNOWN = tuple(_PARSERS)


def _parsed(path: str, content: str) -> tuple[list[tuple], str | None]:
    """The rows of one manifest and what is wrong with it."""
    found = _PARSERS.get(path.replace("\\", "/").rpartition("/")[2])
    if not found:
        return [], None
    try:
        return [(path, n, v, found[0], direct, dev, lic or "") for n, v, direct, dev, lic in found[1](content or "")], None
    except (ValueError, KeyError, AttributeError, TypeError, ET.ParseError, configparser.Error, RecursionError) as e:
        return [], f"{type(e).__name__}: {e}"[:200]


def parse(path: str, content: str) -> list[tuple]:
    """Rows of one manifest; none for unknown names and broken files."""
    return _parsed(path, content)[0]


def discover(files: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Known manifests, up to a depth where one is given; the filter comes before any content is read."""
    known = files.where(basename(F.col("path")).isin(*KNOWN))
    return known if max_depth is None else known.where(F.size(F.split(F.regexp_replace("path", r"\\", "/"), "/")) - 1 <= max_depth)


def dependencies(files: DataFrame) -> DataFrame:
    """Dependency rows of a table (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            yield pd.DataFrame([r for p, c in zip(batch["path"], batch["content"], strict=True) for r in parse(p, c)], columns=names)

    return discover(files).select("path", "content").mapInPandas(run, SCHEMA)


def problems(files: DataFrame) -> DataFrame:
    """(manifest_path, problem) of each known manifest that can't be parsed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(p, _parsed(p, c)[1]) for p, c in zip(batch["path"], batch["content"], strict=True)]
            yield pd.DataFrame([x for x in found if x[1]], columns=["manifest_path", "problem"], dtype=object)

    return discover(files).select("path", "content").mapInPandas(run, "manifest_path string, problem string")


_MODEL = "path string, parent string, body string"


def maven_dependencies(files: DataFrame) -> DataFrame:
    """Dependency rows of all pom.xml files (path, content), each with the properties and managed versions of its parents.

    A parent is found by its relative path among the files, level by level with a join, until no file
    has an open parent; a file doesn't take up the same parent twice, which ends cycles. Properties
    and versions of a child go before those of its parent.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    parts = _pom_parts(content or "")
                except (ValueError, ET.ParseError):
                    continue
                out.append((path, parts["parent"], json.dumps(parts)))
            yield pd.DataFrame(out, columns=["path", "parent", "body"], dtype=object)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            out = []
            for path, bodies in zip(batch["path"], batch["bodies"], strict=True):
                chain = [json.loads(b) for b in bodies]
                props, managed = {}, {}
                for parts in reversed(chain):
                    props |= parts["props"]
                    managed |= parts["managed"]
                out += [(path, n, v, "maven", d, dev, lic) for n, v, d, dev, lic in _pom_rows(chain[0], props, managed)]
            yield pd.DataFrame(out, columns=names)

    poms = files.where(basename(F.col("path")) == "pom.xml").select("path", "content").mapInPandas(read, _MODEL)
    folder = F.regexp_replace("path", "[^/]*$", "")
    named = F.when(F.col("parent").rlike("[.]xml$"), F.col("parent")).otherwise(F.concat(F.regexp_replace("parent", "/$", ""), F.lit("/pom.xml")))
    poms = poms.withColumn("parent", F.when(F.col("parent").isNotNull(), normalize_path(F.concat(folder, named)))).withColumn("_key", normalize_path(F.col("path")))
    with scratch(files.sparkSession) as keep:
        poms = keep(poms)
        above = poms.select(F.col("_key").alias("_open"), F.col("parent").alias("_next"), F.col("body").alias("_body"))
        chains, done = poms.select("path", F.col("parent").alias("_open"), F.array("body").alias("bodies"), F.array("_key").alias("_seen")), []
        while True:
            chains, seen = keep(chains, open=F.count_if(F.col("_open").isNotNull()))
            done.append(chains.where("_open is null").select("path", "bodies"))
            if not seen["open"]:
                break
            step = chains.where("_open is not null").join(above, "_open", "left")
            fresh = F.col("_body").isNotNull() & ~F.array_contains("_seen", F.col("_open"))
            chains = step.select("path", F.when(fresh, F.col("_next")).alias("_new"), F.when(fresh, F.concat("bodies", F.array("_body"))).otherwise(F.col("bodies")).alias("bodies"), F.concat("_seen", F.array("_open")).alias("_seen")).withColumnRenamed("_new", "_open")
        out = done[0]
        for d in done[1:]:
            out = out.unionByName(d)
        return checkpoint(out.mapInPandas(rows, SCHEMA))


def workspace_members(files: DataFrame) -> DataFrame:
    """(root_path, kind, member): the member folders or globs that go.work, package.json, pnpm-workspace.yaml, pom.xml, Cargo.toml, settings.gradle and pyproject.toml name, relative to their folder."""

    def of(path: str, text: str) -> list[tuple[str, str]]:
        name = path.replace("\\", "/").rpartition("/")[2]
        if name == "go.work":
            bare = re.sub(r"//.*", "", text)
            return [("go", m) for block in re.findall(r"^use\s*\(([^)]*)\)", bare, re.M) for m in block.split()] + [("go", m) for m in re.findall(r"^use\s+([^\s(]+)", bare, re.M)]
        if name == "package.json":
            w = json.loads(text).get("workspaces") or []
            return [("npm", m) for m in (w.get("packages") or [] if isinstance(w, dict) else w)]
        if name == "pnpm-workspace.yaml":
            return [("npm", m) for m in re.findall(r"^\s*-\s*['\"]?([^'\"\s#]+)", text.partition("packages:")[2], re.M)]
        if name == "pom.xml":
            return [("maven", m) for m in _pom_parts(text)["modules"]]
        if name == "Cargo.toml":
            return [("cargo", m) for m in tomllib.loads(text).get("workspace", {}).get("members", [])]
        if name in ("settings.gradle", "settings.gradle.kts"):
            return [("gradle", m.lstrip(":").replace(":", "/")) for line in re.findall(r"^\s*include\b\s*\(?([^)\n]*)", text, re.M) for m in re.findall(r"""["']([^"']+)["']""", line)]
        if name == "pyproject.toml":
            return [("uv", m) for m in tomllib.loads(text).get("tool", {}).get("uv", {}).get("workspace", {}).get("members", [])]
        return []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, text in zip(batch["path"], batch["content"], strict=True):
                try:
                    out += [(path, k, m[2:] if m.startswith("./") else m) for k, m in of(path, text or "")]
                except (ValueError, AttributeError, TypeError, ET.ParseError):
                    continue
            yield pd.DataFrame(out, columns=["root_path", "kind", "member"], dtype=object)

    roots = ("go.work", "package.json", "pnpm-workspace.yaml", "pom.xml", "Cargo.toml", "settings.gradle", "settings.gradle.kts", "pyproject.toml")
    return files.where(basename(F.col("path")).isin(*roots)).select("path", "content").mapInPandas(run, "root_path string, kind string, member string")


def merged(deps: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """Union of all manifests: without covered paths, first of each name and version wins, and a lockfile's row beats a manifest's (which lends it the direct flag)."""
    if covered is not None:
        deps = deps.join(covered.select("manifest_path").distinct(), "manifest_path", "left_anti")
    lock = basename(F.col("manifest_path")).rlike(r"lock|shrinkwrap")
    direct = deps.where(~lock).groupBy("ecosystem", "name").agg(F.max("is_direct").alias("_d"))
    w = W.partitionBy("ecosystem", "name", "version").orderBy(lock.desc(), "manifest_path")
    firsts = deps.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    out = firsts.join(direct, ["ecosystem", "name"], "left").withColumn("is_direct", F.col("is_direct") | F.coalesce("_d", F.lit(False))).drop("_d")
    has_lock = F.max(lock.cast("int")).over(W.partitionBy("ecosystem", "name"))
    return out.withColumn("_l", has_lock).where(lock | (F.col("_l") == 0)).drop("_l")


def monorepo(files: DataFrame) -> DataFrame:
    """(kind): go.work, pnpm, yarn, bazel, maven, gradle or uv in this order; nx always overwrites, turbo overwrites none, pnpm and yarn."""
    base, top = basename(F.col("path")), ~F.regexp_replace("path", r"\\", "/").contains("/")
    has = lambda name, text=None: F.coalesce(F.bool_or(top & (base == name) & (F.col("content").contains(text) if text else F.lit(True))), F.lit(False))
    first = (
        F.when(has("go.work"), "go").when(has("pnpm-workspace.yaml"), "pnpm").when(has("package.json", '"workspaces"'), "yarn").when(has("WORKSPACE") | has("MODULE.bazel"), "bazel")
        .when(has("pom.xml", "<modules>"), "maven").when(has("settings.gradle", "include") | has("settings.gradle.kts", "include"), "gradle").when(has("pyproject.toml", "[tool.uv.workspace]"), "uv").otherwise("none")
    )
    return files.agg(F.when(has("nx.json"), "nx").when(has("turbo.json") & first.isin("none", "pnpm", "yarn"), "turbo").otherwise(first).alias("kind"))


def workspace_coverage(deps_paths: DataFrame, member_globs: list[str]) -> DataFrame:
    """manifest_path of members that a workspace root covers."""
    from lodestrata.operators.scan import glob_pattern

    folder = F.regexp_replace("manifest_path", r"/?[^/]*$", "")
    hit = F.lit(False)
    for g in member_globs:
        hit = hit | folder.rlike(glob_pattern("/" + g.strip("./").rstrip("/")) + "$")
    return deps_paths.where(hit & (folder != "")).select("manifest_path").distinct()


def transitive(direct: DataFrame, poms: DataFrame, max_depth: int = 5) -> DataFrame:
    """(name, version, depth): closure over a table of POM edges (name, version, dep_name, dep_version, scope, optional).

    A frontier join a level; test, provided and optional edges are skipped, seen artifacts aren't
    walked again (which also breaks cycles), and the first version met wins.
    """
    edges = poms.where("coalesce(scope, 'compile') not in ('test', 'provided') and not coalesce(optional, false)").select("name", "version", "dep_name", "dep_version")
    with scratch(direct.sparkSession) as keep:
        seen = frontier = keep(direct.select("name", "version").dropDuplicates(["name"]).withColumn("depth", F.lit(0)))
        for depth in range(1, max_depth + 1):
            step = frontier.select("name", "version").join(edges, ["name", "version"]).groupBy(F.col("dep_name").alias("name")).agg(F.min("dep_version").alias("version"))
            frontier = keep(step.join(seen.select("name"), "name", "left_anti").withColumn("depth", F.lit(depth)))
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier)
        return checkpoint(seen)
