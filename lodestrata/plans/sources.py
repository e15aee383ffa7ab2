"""Queries of sources whose inputs the tables don't hold as such: their texts and rows are made from the tables, so every parser and closure still has its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import rules, taint
from lodestrata.session import table
from lodestrata.sources import feeds, images, manifests

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = (f, sql)
        return f

    return register


#: A name without anything that a format would quote, and a version or 0: of every row of affected_packages.
_NAME_SQL, _VERSION_SQL = "'x'||regexp_replace(lower(coalesce(package_name,'none')),'[^a-z0-9_-]','-','g')", "coalesce(nullif(trim(fixed_version),''),'0')"


def _named(spark, d):
    name = F.concat(F.lit("x"), F.regexp_replace(F.lower(F.coalesce("package_name", F.lit("none"))), "[^a-z0-9_-]", "-"))
    return table(spark, d, "affected_packages").select("id", name.alias("n"), F.coalesce(F.nullif(F.trim("fixed_version"), F.lit("")), F.lit("0")).alias("v"), F.coalesce(F.nullif(F.trim("source_package"), F.lit("")), F.lit("")).alias("source"))


#: Manifests of one package {n} in version {v}: file, text, ecosystem, what comes before the name and the version, direct, dev (fixed values).
_FORMATS = (
    ("go.mod", "module m\nrequire (\n\t{n} v{v} // indirect\n)\n", "go", "", "v", False, False),
    ("package.json", '{"devDependencies":{"{n}":"{v}"}}', "npm", "", "", True, True),
    ("package-lock.json", '{"packages":{"":{"dependencies":{"{n}":"1"}},"node_modules/{n}":{"version":"{v}"}}}', "npm", "", "", True, False),
    ("yarn.lock", '"@s/{n}@^1":\n  version "{v}"\n', "npm", "@s/", "", False, False),
    ("pnpm-lock.yaml", "lockfileVersion: 6\npackages:\n  /{n}@{v}:\n    dev: false\n", "npm", "", "", False, False),
    ("requirements.txt", "# c\n{n}[x]=={v} ; python_version>'3'\n", "pypi", "", "", True, False),
    ("pyproject.toml", '[project]\ndependencies=["{n}>={v}"]\n', "pypi", "", "", True, False),
    ("poetry.lock", '[[package]]\nname="{n}"\nversion="{v}"\n', "pypi", "", "", False, False),
    ("Pipfile.lock", '{"develop":{"{n}":{"version":"=={v}"}}}', "pypi", "", "", False, True),
    ("setup.py", "setup(install_requires=['{n}>={v}'])", "pypi", "", "", True, False),
    ("setup.cfg", "[options]\ninstall_requires =\n    {n}>={v}\n", "pypi", "", "", True, False),
    ("Cargo.toml", '[dev-dependencies]\n{n}="{v}"\n', "cargo", "", "", True, True),
    ("Cargo.lock", '[[package]]\nname="{n}"\nversion="{v}"\nsource="registry"\n', "cargo", "", "", False, False),
    ("Gemfile", "gem '{n}', '~> {v}'\n", "rubygems", "", "", True, False),
    ("Gemfile.lock", "GEM\n  specs:\n    {n} ({v})\n\nDEPENDENCIES\n  {n}\n", "rubygems", "", "", True, False),
    ("composer.json", '{"require":{"php":"8","v/{n}":"{v}"}}', "packagist", "v/", "", True, False),
    ("composer.lock", '{"packages-dev":[{"name":"v/{n}","version":"v{v}"}]}', "packagist", "v/", "", False, True),
    ("pom.xml", "<project><properties><p>{v}</p></properties><dependencies><dependency><groupId>g</groupId><artifactId>{n}</artifactId><version>${p}</version><scope>test</scope></dependency></dependencies></project>", "maven", "g:", "", True, True),
    ("build.gradle", "dependencies {\n  implementation 'g:{n}:{v}'\n}\n", "maven", "g:", "", True, False),
    ("Chart.yaml", "name: c\ndependencies:\n  - name: {n}\n    version: {v}\n", "helm", "", "", True, False),
)


def _manifest_query(name: str, kinds: tuple[str, ...], doc: str) -> None:
    """A query in which each row of affected_packages becomes a manifest of one of the formats, by its id, and is parsed again."""
    formats = [f for f in _FORMATS if f[2] in kinds]
    n = len(formats)
    values = ", ".join(f"({i},'{f[0]}','{f[2]}','{f[3]}','{f[4]}',{f[5]},{f[6]})" for i, f in enumerate(formats))
    sql = f"WITH k(i, file, ecosystem, np, vp, d, e) AS (VALUES {values}) SELECT a.id||'/'||k.file AS manifest_path, k.np||{_NAME_SQL} AS name, k.vp||{_VERSION_SQL} AS version, k.ecosystem, k.d AS is_direct, k.e AS is_dev FROM affected_packages a JOIN k ON k.i=a.id%{n}"

    def run(spark, d):
        rows = _named(spark, d)
        text = file = F.lit(None).cast("string")
        for i, f in enumerate(formats):
            here = F.col("id") % n == i
            text = F.when(here, F.replace(F.replace(F.lit(f[1]), F.lit("{n}"), F.col("n")), F.lit("{v}"), F.col("v"))).otherwise(text)
            file = F.when(here, f[0]).otherwise(file)
        files = rows.select(F.concat(F.col("id").cast("string"), F.lit("/"), file).alias("path"), text.alias("content"))
        return manifests.dependencies(files).select("manifest_path", "name", "version", "ecosystem", "is_direct", "is_dev")

    run.__doc__ = doc
    QUERIES[name] = (run, sql)


for _query, _kinds in {"o009_manifests": ("go", "npm", "pypi", "cargo", "rubygems", "packagist", "maven", "helm"), "o011_go_mod": ("go",), "o012_npm": ("npm",), "o013_python": ("pypi",), "o014_rust_ruby_php": ("cargo", "rubygems", "packagist"), "o015_jvm_helm": ("maven", "helm")}.items():
    _manifest_query(_query, _kinds, f"Every row as a manifest of {', '.join(_kinds)}.")


def _projects(spark, d):
    """(path, content, ...) of a manifest and a lockfile for each tenth id of affected_packages."""
    a = _named(spark, d).select(F.floor(F.col("id") / 10).alias("p"), "id", "n", "v")
    folder = F.concat(F.lit("p"), F.col("p").cast("string"), F.lit("/m"), (F.col("id") % 3).cast("string"))
    lock = F.col("id") % 2 == 0
    return a.select(F.concat(folder, F.when(lock, "/package-lock.json").otherwise("/package.json")).alias("manifest_path"), F.col("n").alias("name"), F.col("v").alias("version"), F.lit("npm").alias("ecosystem"), (F.col("id") % 5 == 0).alias("is_direct"), F.lit(False).alias("is_dev"), F.lit("").alias("license"))


_PROJECTS = f"d AS (SELECT 'p'||(id//10)||'/m'||(id%3)||CASE WHEN id%2=0 THEN '/package-lock.json' ELSE '/package.json' END AS manifest_path, {_NAME_SQL} AS name, {_VERSION_SQL} AS version, id%5=0 AS is_direct, id%2=0 AS lock FROM affected_packages)"


@query("o010_merged", f"WITH {_PROJECTS}, c AS (SELECT * FROM d WHERE NOT regexp_matches(manifest_path,'^p[0-9]*7/m2/')), f AS (SELECT name, version, lock, arg_min(is_direct, (CASE WHEN lock THEN 0 ELSE 1 END, manifest_path, is_direct)) AS is_direct, min(manifest_path) AS p FROM (SELECT *, max(lock) OVER (PARTITION BY name, version) AS any_lock FROM c) WHERE lock=any_lock GROUP BY name, version, lock) SELECT name, version, f.is_direct OR coalesce((SELECT max(c.is_direct) FROM c WHERE NOT c.lock AND c.name=f.name), false) AS is_direct FROM f WHERE lock OR NOT EXISTS (SELECT 1 FROM f g WHERE g.name=f.name AND g.lock)")
def _(spark, d):
    """Manifests and lockfiles of made projects: members p..7/m2 are covered by a workspace."""
    deps = _projects(spark, d)
    covered = deps.where(F.col("manifest_path").rlike("^p[0-9]*7/m2/")).select("manifest_path")
    return manifests.merged(deps, covered).select("name", "version", "is_direct")


@query("o146_workspace_coverage", f"WITH {_PROJECTS} SELECT DISTINCT manifest_path FROM d WHERE regexp_matches(manifest_path,'^p[0-9]*1/m[^/]*/') OR regexp_matches(manifest_path,'^p33/')")
def _(spark, d):
    return manifests.workspace_coverage(_projects(spark, d).select("manifest_path"), ["p*1/m*", "./p33/**"])


@query("o017_workspace_members", f"SELECT id||CASE id%3 WHEN 0 THEN '/go.work' WHEN 1 THEN '/package.json' ELSE '/Cargo.toml' END AS root_path, CASE id%3 WHEN 0 THEN 'go' WHEN 1 THEN 'npm' ELSE 'cargo' END AS kind, m.p||{_NAME_SQL} AS member FROM affected_packages, (VALUES ('a/'),('b/')) m(p)")
def _(spark, d):
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("go 1.21\nuse (\n\t./a/"), "n", F.lit("\n)\nuse ./b/"), "n", F.lit("\n"))).when(F.col("id") % 3 == 1, F.concat(F.lit('{"workspaces":["a/'), "n", F.lit('","./b/'), "n", F.lit('"]}'))).otherwise(F.concat(F.lit('[workspace]\nmembers=["a/'), "n", F.lit('","b/'), "n", F.lit('"]\n')))
    file = F.when(F.col("id") % 3 == 0, "/go.work").when(F.col("id") % 3 == 1, "/package.json").otherwise("/Cargo.toml")
    return manifests.workspace_members(_named(spark, d).select(F.concat(F.col("id").cast("string"), file).alias("path"), text.alias("content")))


@query("o015_maven_parents", f"SELECT id||'/app/pom.xml' AS manifest_path, 'g:'||{_NAME_SQL} AS name, CASE WHEN id%2=0 THEN {_VERSION_SQL} ELSE '9' END AS version FROM affected_packages")
def _(spark, d):
    """The version stands in a parent's managed dependencies or property; every second child has a property of its own."""
    a = _named(spark, d)
    top = F.concat(F.lit("<project><properties><p>"), "v", F.lit("</p></properties><dependencyManagement><dependencies><dependency><groupId>g</groupId><artifactId>"), "n", F.lit("</artifactId><version>${p}</version></dependency></dependencies></dependencyManagement></project>"))
    app = F.concat(F.lit("<project><parent><groupId>g</groupId><artifactId>p</artifactId><version>1</version></parent>"), F.when(F.col("id") % 2 == 1, "<properties><p>9</p></properties>").otherwise(""), F.lit("<dependencies><dependency><groupId>g</groupId><artifactId>"), "n", F.lit("</artifactId></dependency></dependencies></project>"))
    place = lambda p: F.concat(F.col("id").cast("string"), F.lit(p)).alias("path")
    files = a.select(place("/pom.xml"), top.alias("content")).union(a.select(place("/app/pom.xml"), app.alias("content")))
    return manifests.maven_dependencies(files).select("manifest_path", "name", "version")


@query("o009_problems", "SELECT id||'/package.json' AS manifest_path FROM affected_packages WHERE id%3=1 UNION ALL SELECT id||'/pom.xml' FROM affected_packages WHERE id%3=2")
def _(spark, d):
    """Broken files are named, whole ones aren't."""
    text = F.when(F.col("id") % 3 == 1, '{"dependencies":').when(F.col("id") % 3 == 2, "<project>").otherwise("{}")
    file = F.when(F.col("id") % 3 == 2, "/pom.xml").otherwise("/package.json")
    return manifests.problems(_named(spark, d).select(F.concat(F.col("id").cast("string"), file).alias("path"), text.alias("content"))).select("manifest_path")


@query("o025_dpkg_packages", f"SELECT id, {_NAME_SQL} AS name, {_VERSION_SQL} AS version, coalesce(nullif(trim(source_package),''), {_NAME_SQL}) AS source_package FROM affected_packages WHERE id%4<>0")
def _(spark, d):
    """A status text for each row; each fourth package isn't installed."""
    status = F.when(F.col("id") % 4 == 0, "deinstall ok config-files").otherwise("install ok installed")
    text = F.concat(F.lit("Package: "), "n", F.lit("\nStatus: "), status, F.lit("\nVersion: "), "v", F.when(F.col("source") != "", F.concat(F.lit("\nSource: "), "source", F.lit(" (1.0)"))).otherwise(""), F.lit("\n\nPackage: gone\nStatus: purge\n"))
    return images.dpkg_packages(_named(spark, d).select("id", text.alias("t")), "id", "t").select("id", "name", "version", "source_package")


@query("o025_apk_packages", f"SELECT id, {_NAME_SQL} AS name, {_VERSION_SQL}||'-r1' AS version, trim(coalesce(source_package,'')) AS source_package FROM affected_packages UNION ALL SELECT id, 'musl', '1.2', 'musl' FROM affected_packages")
def _(spark, d):
    text = F.concat(F.lit("C:x\nP:"), "n", F.lit("\nV:"), "v", F.lit("-r1\nA:x86_64\no:"), "source", F.lit("\n\nP:musl\nV:1.2\no:musl\n"))
    return images.apk_packages(_named(spark, d).select("id", text.alias("t")), "id", "t").select("id", "name", "version", "source_package")


@query("o025_language_packages", f"SELECT CASE id%3 WHEN 0 THEN 'node_modules/@s/'||id||'/package.json' WHEN 1 THEN id||'-1.dist-info/METADATA' ELSE id||'/META-INF/maven/g/a/pom.properties' END AS path, CASE id%3 WHEN 0 THEN 'npm' WHEN 1 THEN 'pypi' ELSE 'maven' END AS ecosystem, CASE WHEN id%3=2 THEN 'g:' ELSE '' END||{_NAME_SQL} AS name, {_VERSION_SQL} AS version FROM affected_packages")
def _(spark, d):
    k, i = F.col("id") % 3, F.col("id").cast("string")
    path = F.when(k == 0, F.concat(F.lit("node_modules/@s/"), i, F.lit("/package.json"))).when(k == 1, F.concat(i, F.lit("-1.dist-info/METADATA"))).otherwise(F.concat(i, F.lit("/META-INF/maven/g/a/pom.properties")))
    text = F.when(k == 0, F.concat(F.lit('{"name":"'), "n", F.lit('","version":"'), "v", F.lit('"}'))).when(k == 1, F.concat(F.lit("Metadata-Version: 2.1\nName: "), "n", F.lit("\nVersion: "), "v", F.lit("\n"))).otherwise(F.concat(F.lit("groupId=g\nartifactId="), "n", F.lit("\nversion="), "v", F.lit("\n")))
    return images.language_packages(_named(spark, d).select(path.alias("path"), text.alias("content")))


@query("o020_unified_diff", r"WITH l0 AS (SELECT finding_id, file_path, string_split_regex(code, '\r?\n') AS parts FROM raw_findings WHERE code IS NOT NULL AND file_path IS NOT NULL), l AS (SELECT finding_id, file_path, unnest(parts) AS content, generate_subscripts(parts,1) AS new_line FROM l0) SELECT finding_id, file_path AS path, content, new_line::INTEGER AS new_line FROM l")
def _(spark, d):
    raw = table(spark, d, "raw_findings").where(F.col("code").isNotNull() & F.col("file_path").isNotNull())
    body = F.array_join(F.transform(F.split("code", "\n", -1), lambda x: F.concat(F.lit("+"), x)), "\n")
    p = F.col("file_path")
    text = F.concat(F.lit("diff --git a/"), p, F.lit(" b/"), p, F.lit("\n--- /dev/null\n+++ b/"), p, F.lit("\n@@ -0,0 +1,"), F.size(F.split("code", "\n", -1)).cast("string"), F.lit(" @@\n"), body)
    out = feeds.unified_diff(raw.select("finding_id", text.alias("t")), "finding_id", "t")
    return out.select("finding_id", "path", "content", F.col("new_line").cast("int").alias("new_line"))


_ENTRIES = "e AS (SELECT (finding_id%5)::INTEGER AS layer_idx, finding_id AS tar_ordinal, file_path AS path, coalesce(severity='low', false) AS gone FROM raw_findings WHERE file_path IS NOT NULL)"


@query("o022_layer_overlay", f"WITH {_ENTRIES}, top AS (SELECT * FROM e WHERE NOT gone QUALIFY row_number() OVER (PARTITION BY path ORDER BY layer_idx DESC, tar_ordinal DESC)=1) SELECT path, layer_idx, EXISTS (SELECT 1 FROM e w WHERE w.gone AND w.path=top.path AND (w.layer_idx>top.layer_idx OR (w.layer_idx=top.layer_idx AND w.tar_ordinal>top.tar_ordinal))) AS is_deleted FROM top")
def _(spark, d):
    marked = F.concat(F.regexp_replace("file_path", "[^/]*$", ""), F.lit(".wh."), F.regexp_extract("file_path", "([^/]*)$", 1))
    e = table(spark, d, "raw_findings").where("file_path is not null").select((F.col("finding_id") % 5).cast("int").alias("layer_idx"), F.col("finding_id").alias("tar_ordinal"), F.when(F.col("severity") == "low", marked).otherwise(F.col("file_path")).alias("path"))
    return images.overlay(e).select("path", "layer_idx", "is_deleted")


@query("o118_layer_blame", "WITH l AS (SELECT n_nationkey, 'd'||n_nationkey AS layer_digest, bool_and(n_regionkey<>4) OVER (ORDER BY n_nationkey) AS is_base FROM nation) SELECT s_suppkey, n_nationkey AS layer_idx, is_base FROM supplier LEFT JOIN l ON 'd'||s_nationkey=layer_digest")
def _(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("layer_idx"), F.concat(F.lit("d"), F.col("n_nationkey").cast("string")).alias("layer_digest"), F.when(F.col("n_regionkey") != 4, "CMD x").otherwise("RUN x").alias("created_by"))
    s = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("d"), F.col("s_nationkey").cast("string")).alias("layer_digest"))
    return images.layer_blame(s, n).select("s_suppkey", "layer_idx", "is_base")


_CONFIG = "SELECT c_custkey, CASE WHEN c_mktsegment='BUILDING' THEN '' ELSE lower(c_mktsegment) END AS u, c_acctbal>0 AS h, CASE WHEN c_nationkey%2=0 THEN 'latest' ELSE '1' END AS t, c_custkey%5=0 AS secret, CASE c_custkey%4 WHEN 0 THEN 22 WHEN 1 THEN 3389 ELSE 80 END AS port, c_custkey%3 AS labels, CASE c_custkey%3 WHEN 0 THEN '/' WHEN 1 THEN '/app' END AS folder FROM customer"


def _configs(spark, d):
    k = F.col("c_custkey")
    known = F.create_map(*[F.lit(x) for n in ("title", "version", "source", "authors", "vendor") for x in (f"org.opencontainers.image.{n}", "y")])
    labels = F.when(k % 3 == 0, F.create_map().cast("map<string,string>")).when(k % 3 == 1, known).otherwise(F.create_map(F.lit("org.opencontainers.image.source"), F.lit("")))
    return table(spark, d, "customer").select(
        "c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.lower("c_mktsegment")).alias("user"), F.array(F.when(k % 5 == 0, "DB_PASSWORD=x").otherwise("A=1")).alias("env"), F.array(F.concat(F.when(k % 4 == 0, "22").when(k % 4 == 1, "3389").otherwise("80"), F.lit("/tcp"))).alias("exposed_ports"),
        labels.alias("labels"), (F.col("c_acctbal") > 0).alias("has_healthcheck"), F.when(F.col("c_nationkey") % 2 == 0, "latest").otherwise("1").alias("tag"), F.when(k % 3 == 0, "/").when(k % 3 == 1, "/app").alias("working_dir"), F.when(k % 3 == 1, "SIGTERM").alias("stop_signal"),
    )


def _checked(*tests: tuple[str, str]) -> str:
    return "unnest(list_filter([" + ", ".join(f"CASE WHEN {w} THEN '{i}' END" for i, w in tests) + "], lambda x: x IS NOT NULL)) AS rule_id"


@query("o105_image_hardening", f"WITH c AS ({_CONFIG}) SELECT c_custkey, " + _checked(("IMG-ROOT-USER", "u IN ('','root','0')"), ("IMG-NO-USER", "u=''"), ("IMG-SECRET-ENV", "secret"), ("IMG-SSH-PORT", "port=22"), ("IMG-NO-HEALTHCHECK", "NOT h"), ("IMG-NO-MAINTAINER", "labels<>1"), ("IMG-NO-SOURCE", "labels<>1")) + " FROM c")
def _(spark, d):
    return images.run_checks(_configs(spark, d), images.HARDENING_CHECKS).select("c_custkey", "rule_id")


@query("o106_image_checks", f"WITH c AS ({_CONFIG}) SELECT c_custkey, " + _checked(("CFG-LATEST-TAG", "t IN ('','latest')"), ("CFG-NO-LABEL-TITLE", "labels<>1"), ("CFG-NO-LABEL-VERSION", "labels<>1"), ("CFG-NO-LABEL-DESCRIPTION", "true"), ("CFG-NO-LABEL-LICENSES", "true"), ("CFG-NO-LABEL-SOURCE", "labels=0"), ("CFG-NO-LABEL-VENDOR", "labels<>1"), ("CFG-NO-LABEL-DOCUMENTATION", "true"), ("CFG-ADMIN-PORT", "port IN (22,3389)"), ("CFG-NO-HEALTHCHECK", "NOT h"), ("CFG-ROOT-FOLDER", "coalesce(folder,'') IN ('','/')"), ("CFG-NO-STOP-SIGNAL", "labels<>1")) + " FROM c")
def _(spark, d):
    return images.run_checks(_configs(spark, d), images.CONFIG_CHECKS).select("c_custkey", "rule_id")


_PATHS = ("/usr/bin/sudo", "/bin/sh", "/var/cache/apt/archives/x.deb", "/opt/tools/nmap", "/root/.bash_history", "/etc/ssl/server.key", "/usr/local/bin/app", "/srv/data")


@query("o105_file_hardening", f"WITH p(i, path) AS (VALUES {', '.join(f'({i},{chr(39)}{x}{chr(39)})' for i, x in enumerate(_PATHS))}), e AS (SELECT finding_id, path, CASE finding_id%5 WHEN 0 THEN 2541 WHEN 1 THEN 1517 WHEN 2 THEN 506 ELSE 493 END AS mode, finding_id%7=0 AS big, i=7 AS is_dir FROM raw_findings JOIN p ON p.i=finding_id%8) SELECT finding_id, " + _checked(("IMG-SETUID", "NOT is_dir AND mode=2541"), ("IMG-SETGID", "NOT is_dir AND mode=1517"), ("IMG-WORLD-WRITABLE", "is_dir AND mode=506"), ("IMG-PRIVATE-KEY", "path LIKE '%.key'"), ("IMG-LARGE-BINARY", "big AND path IN ('/usr/bin/sudo','/bin/sh','/usr/local/bin/app')"), ("IMG-SHELL-HISTORY", "path LIKE '%_history'"), ("IMG-PACKAGE-CACHE", "path LIKE '/var/cache/%'"), ("IMG-SHELL", "path='/bin/sh'"), ("IMG-NETWORK-TOOL", "path LIKE '%nmap'"), ("IMG-SUDO", "path='/usr/bin/sudo'")) + " FROM e")
def _(spark, d):
    """File entries made from the rows: 2541 is setuid, 1517 setgid, 506 is writable for all but not for everybody's every use."""
    k = F.col("finding_id")
    path = F.element_at(F.array(*[F.lit(x) for x in _PATHS]), (k % 8 + 1).cast("int"))
    e = table(spark, d, "raw_findings").select("finding_id", path.alias("path"), F.when(k % 5 == 0, 2541).when(k % 5 == 1, 1517).when(k % 5 == 2, 506).otherwise(493).cast("bigint").alias("mode"), F.when(k % 7 == 0, 200 << 20).otherwise(10).cast("bigint").alias("size"), (k % 8 == 7).alias("is_dir"))
    return images.run_checks(e, images.FILE_CHECKS).select("finding_id", "rule_id")


@query("o016_transitive", "WITH RECURSIVE t(k, depth) AS (SELECT p_partkey, 0 FROM part WHERE p_size=50 UNION ALL SELECT k//2, depth+1 FROM t WHERE depth<5 AND k//2>0) SELECT CAST(k AS VARCHAR) AS name, min(depth)::INTEGER AS depth FROM t WHERE k IN (SELECT p_partkey FROM part) GROUP BY 1")
def _(spark, d):
    """Over a tree of parts: part k needs part k / 2."""
    p = table(spark, d, "part")
    text = lambda c: c.cast("string")
    half = F.floor(F.col("p_partkey") / 2)
    poms = p.where(half > 0).select(text(F.col("p_partkey")).alias("name"), F.lit("1").alias("version"), text(half).alias("dep_name"), F.lit("1").alias("dep_version"), F.lit(None).cast("string").alias("scope"), F.lit(False).alias("optional"))
    direct = p.where("p_size = 50").select(text(F.col("p_partkey")).alias("name"), F.lit("1").alias("version"))
    return manifests.transitive(direct, poms, 5).select("name", "depth")


@query("o100_backward_reach", "WITH RECURSIVE t(sink, k, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part WHERE p_size=50 UNION ALL SELECT sink, k//2, depth+1 FROM t WHERE k//2>0 AND (k//2)%7<>0) SELECT sink, k AS source, depth::INTEGER AS depth FROM t WHERE k IN (SELECT p_partkey FROM part WHERE p_size<10)")
def _(spark, d):
    """Over the same tree: data flows from part k / 2 to part k, and parts divisible by 7 cut it."""
    p = table(spark, d, "part")
    half = F.floor(F.col("p_partkey") / 2).cast("bigint")
    edges = p.where(half > 0).select(half.alias("node"), F.col("p_partkey").alias("next"))
    node = lambda w: p.where(w).select(F.col("p_partkey").alias("node"))
    return taint.backward_reach(edges, node("p_size = 50"), node("p_size < 10"), node("p_partkey % 7 = 0"))


@query("o023_os_release", "SELECT s_suppkey, lower(s_name) AS os_id, CAST(s_nationkey AS VARCHAR) AS os_version FROM supplier")
def _(spark, d):
    text = F.concat(F.lit('NAME="X"\nID='), F.lower("s_name"), F.lit('\nVERSION_ID="'), F.col("s_nationkey").cast("string"), F.lit('"\n'))
    s = table(spark, d, "supplier").select("s_suppkey", images.os_release(text).alias("o"))
    return s.select("s_suppkey", F.col("o.id").alias("os_id"), F.col("o.version").alias("os_version"))


@query("o093_terraform_blocks", "SELECT p_partkey, p_brand AS name, 1 AS first_line FROM part UNION ALL SELECT p_partkey, 'x' AS name, 4 AS first_line FROM part")
def _(spark, d):
    from lodestrata.functions.text import lines

    text = F.concat(F.lit('resource "bucket" "'), F.col("p_brand"), F.lit('" {\n  acl { a }\n}\nresource "bucket" "x" {\n}\n'))
    l = lines(table(spark, d, "part").select("p_partkey", text.alias("t")), "p_partkey", "t")
    return rules.terraform_blocks(l, "p_partkey").select("p_partkey", "name", "first_line")


@query("o094_bucket_posture", "SELECT p_partkey, replace(p_brand,'#','_') AS name FROM part WHERE p_partkey%3=0")
def _(spark, d):
    """Buckets without versioning: neither inline (every third part) nor by a companion block (every other third)."""
    from lodestrata.functions.text import lines

    k = F.col("p_partkey") % 3
    inline = F.when(k == 1, "  versioning { enabled = true }\n").otherwise("")
    companion = F.when(k == 2, F.concat(F.lit('resource "bucket_versioning" "v" {\n  bucket = bucket.'), F.translate("p_brand", "#", "_"), F.lit(".id\n}\n"))).otherwise(F.lit('resource "bucket_versioning" "v" {\n  bucket = bucket.other.id\n}\n'))
    text = F.concat(F.lit('resource "bucket" "'), F.translate("p_brand", "#", "_"), F.lit('" {\n  acl { a }\n'), inline, F.lit("}\n"), companion)
    l = lines(table(spark, d, "part").select("p_partkey", text.alias("t")), "p_partkey", "t")
    return rules.without_companion(rules.terraform_blocks(l, "p_partkey"), "p_partkey", "bucket", "bucket_versioning", "versioning").select("p_partkey", "name")
