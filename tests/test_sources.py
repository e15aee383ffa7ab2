import json

from pyspark.sql import functions as F

from conftest import rows
from lodestrata.operators.advisories import event_pairs, licence_category, package_url, reachability
from lodestrata.sources import feeds, images, manifests

FILES = {
    "a/go.mod": "module m\nrequire (\n\tx.example/y v1.2.3\n\tz.example/w v0.1.0 // indirect\n)\nrequire q.example/r v2.0.0\n",
    "a/package.json": json.dumps({"dependencies": {"left": "^1.0.0"}, "devDependencies": {"@s/right": "2"}}),
    "a/package-lock.json": json.dumps({"packages": {"": {"dependencies": {"left": "^1"}}, "node_modules/left": {"version": "1.0.1", "license": "MIT"}, "node_modules/left/node_modules/in": {"version": "3", "dev": True}}}),
    "b/yarn.lock": '"@s/right@^2":\n  version "2.1.0"\n\nleft@1:\n  version "1.0.0"\n',
    "b/pnpm-lock.yaml": "packages:\n  /left@1.0.0:\n    dev: false\n  '@s/right@2.0.0(peer@1)':\n    dev: true\n",
    "requirements.txt": "# c\nFlask==2.0\nrequests[socks]>=2,<3 ; python_version>'3'\n\nbare\n",
    "pyproject.toml": '[project]\ndependencies=["a>=1"]\n[project.optional-dependencies]\nt=["b"]\n[tool.poetry.dependencies]\npython="^3"\nc="^1.2"\n',
    "poetry.lock": '[[package]]\nname="c"\nversion="1.2.3"\n',
    "Pipfile.lock": json.dumps({"default": {"d": {"version": "==1"}}, "develop": {"e": {"version": "==2"}}}),
    "setup.py": "setup(install_requires=['f>=1', \"g\"])",
    "Cargo.toml": '[dependencies]\nserde="1"\ntokio={version="1.2"}\n[dev-dependencies]\nx="0"\n',
    "Cargo.lock": '[[package]]\nname="serde"\nversion="1.0.1"\nsource="registry"\n[[package]]\nname="self"\nversion="0"\n',
    "Gemfile.lock": "GEM\n  specs:\n    rails (7.0)\n    rack (2.2)\n\nDEPENDENCIES\n  rails\n",
    "Gemfile": "gem 'rails', '~> 7.0'\n",
    "composer.json": json.dumps({"require": {"php": "8", "v/p": "1"}, "require-dev": {"v/q": "2"}}),
    "composer.lock": json.dumps({"packages": [{"name": "v/p", "version": "v1.1", "license": ["MIT"]}]}),
    "pom.xml": '<project xmlns="http://m"><groupId>g</groupId><version>9</version><properties><x.v>1.1</x.v></properties><dependencyManagement><dependencies><dependency><groupId>g</groupId><artifactId>m</artifactId><version>5</version></dependency></dependencies></dependencyManagement><dependencies><dependency><groupId>${project.groupId}</groupId><artifactId>x</artifactId><version>${x.v}</version></dependency><dependency><groupId>g</groupId><artifactId>m</artifactId><scope>test</scope></dependency></dependencies></project>',
    "build.gradle": "dependencies {\n  implementation 'g:a:1'\n  testImplementation(\"g:b:2\")\n}\n",
    "Chart.yaml": "name: c\ndependencies:\n  - name: redis\n    version: \"17\"\n",
    "broken/pom.xml": "<project",
    "broken/package.json": "[1",
    "other.txt": "x",
}


def test_manifests(spark):
    df = manifests.dependencies(spark.createDataFrame(list(FILES.items()), "path string, content string"))
    got = {(r.manifest_path, r.name, r.version, r.is_direct, r.is_dev) for r in df.collect()}
    for want in [
        ("a/go.mod", "x.example/y", "v1.2.3", True, False), ("a/go.mod", "z.example/w", "v0.1.0", False, False), ("a/go.mod", "q.example/r", "v2.0.0", True, False), ("a/package.json", "@s/right", "2", True, True),
        ("a/package-lock.json", "left", "1.0.1", True, False), ("a/package-lock.json", "in", "3", False, True), ("b/yarn.lock", "@s/right", "2.1.0", False, False), ("b/pnpm-lock.yaml", "left", "1.0.0", False, False),
        ("b/pnpm-lock.yaml", "@s/right", "2.0.0", False, False), ("requirements.txt", "requests", "2", True, False), ("requirements.txt", "bare", "", True, False), ("pyproject.toml", "c", "1.2", True, False), ("pyproject.toml", "b", "", True, True),
        ("poetry.lock", "c", "1.2.3", False, False), ("Pipfile.lock", "e", "2", False, True), ("setup.py", "f", "1", True, False), ("Cargo.toml", "tokio", "1.2", True, False), ("Cargo.lock", "serde", "1.0.1", False, False),
        ("Gemfile.lock", "rails", "7.0", True, False), ("Gemfile.lock", "rack", "2.2", False, False), ("Gemfile", "rails", "7.0", True, False), ("composer.json", "v/q", "2", True, True), ("composer.lock", "v/p", "1.1", False, False),
        ("pom.xml", "g:x", "1.1", True, False), ("pom.xml", "g:m", "5", True, True), ("build.gradle", "g:b", "2", True, True), ("Chart.yaml", "redis", "17", True, False),
    ]:
        assert want in got, want
    assert not any(p.startswith("broken") or p == "other.txt" for p, *_ in got) and len({n for _, n, *_ in got if n == "self"}) == 0


def test_problems_and_setup_cfg(spark):
    df = spark.createDataFrame([("setup.cfg", "[options]\ninstall_requires =\n    flask>=2\n    six\n[options.extras_require]\ntest = pytest\n"), ("x/pom.xml", "<project"), ("y/package.json", "[1"), ("z/setup.cfg", "no section"), ("other.txt", "<"), ("ok/Cargo.toml", "")], "path string, content string")
    assert rows(manifests.dependencies(df), "name", "version", "is_dev") == [("flask", "2", False), ("pytest", "", True), ("six", "", False)]
    assert [p for p, in rows(manifests.problems(df), "manifest_path")] == ["x/pom.xml", "y/package.json", "z/setup.cfg"]


def test_maven_parents(spark):
    dep = lambda a, v="", g="g": f"<dependency><groupId>{g}</groupId><artifactId>{a}</artifactId>{f'<version>{v}</version>' if v else ''}</dependency>"
    parent = lambda path: f"<parent><groupId>g</groupId><artifactId>p</artifactId><version>1</version>{path}</parent>"
    poms = {
        "pom.xml": "<project><groupId>g</groupId><version>1</version><modules><module>api</module></modules><properties><j.v>5.9</j.v><k.v>${k2.v}</k.v><k2.v>${k3.v}</k2.v><k3.v>${k4.v}</k3.v><k4.v>${k5.v}</k4.v><k5.v>${k6.v}</k5.v><k6.v>7</k6.v><loop>${loop}</loop></properties><dependencyManagement><dependencies>" + dep("junit", "${j.v}") + dep("deep", "${k.v}") + "</dependencies></dependencyManagement></project>",
        "api/pom.xml": "<project>" + parent("") + "<properties><own.v>3</own.v></properties><dependencies>" + dep("junit") + dep("deep") + dep("own", "${own.v}") + dep("l", "${loop}") + "</dependencies></project>",
        "api/sub/pom.xml": "<project>" + parent("<relativePath>../</relativePath>") + "<properties><j.v>6</j.v></properties><dependencies>" + dep("junit") + dep("own", "${own.v}", "${project.groupId}") + "</dependencies></project>",
        "far/pom.xml": "<project>" + parent("<relativePath>../gone/pom.xml</relativePath>") + "<dependencies>" + dep("junit") + "</dependencies></project>",
        "cycle/pom.xml": "<project>" + parent("<relativePath>pom.xml</relativePath>") + "<dependencies>" + dep("c", "1") + "</dependencies></project>",
        "bad/pom.xml": "<project",
    }
    got = manifests.maven_dependencies(spark.createDataFrame(list(poms.items()), "path string, content string"))
    assert rows(got, "manifest_path", "name", "version") == sorted([("api/pom.xml", "g:junit", "5.9"), ("api/pom.xml", "g:deep", "7"), ("api/pom.xml", "g:own", "3"), ("api/pom.xml", "g:l", "${loop}"), ("api/sub/pom.xml", "g:junit", "6"), ("api/sub/pom.xml", "g:own", "3"), ("far/pom.xml", "g:junit", ""), ("cycle/pom.xml", "g:c", "1")])


def test_workspace_members(spark):
    files = {
        "go.work": "go 1.21\n\nuse (\n\t./services/api // x\n\t./services/worker\n)\nuse ./tools\n", "package.json": json.dumps({"workspaces": ["packages/*"]}), "w/package.json": json.dumps({"workspaces": {"packages": ["apps/a"]}}), "pnpm-workspace.yaml": "packages:\n  - 'lib/*'\n  - app\n",
        "pom.xml": "<project><modules><module>api</module></modules></project>", "Cargo.toml": '[workspace]\nmembers=["crates/x"]\n', "settings.gradle": "include ':core', ':web:ui'\n", "pyproject.toml": '[tool.uv.workspace]\nmembers=["py/*"]\n', "bad/package.json": "[1", "x.txt": "use ./y",
    }
    got = rows(manifests.workspace_members(spark.createDataFrame(list(files.items()), "path string, content string")), "root_path", "kind", "member")
    assert got == sorted([("go.work", "go", "services/api"), ("go.work", "go", "services/worker"), ("go.work", "go", "tools"), ("package.json", "npm", "packages/*"), ("w/package.json", "npm", "apps/a"), ("pnpm-workspace.yaml", "npm", "lib/*"), ("pnpm-workspace.yaml", "npm", "app"), ("pom.xml", "maven", "api"), ("Cargo.toml", "cargo", "crates/x"), ("settings.gradle", "gradle", "core"), ("settings.gradle", "gradle", "web/ui"), ("pyproject.toml", "uv", "py/*")])


def test_merge_and_workspace(spark):
    d = spark.createDataFrame([("package.json", "left", "^1", "npm", True, False, ""), ("package-lock.json", "left", "1.0", "npm", False, False, ""), ("w/a/package.json", "x", "1", "npm", True, False, "")], manifests.SCHEMA)
    covered = manifests.workspace_coverage(d.select("manifest_path"), ["w/*"])
    assert rows(covered, "manifest_path") == [("w/a/package.json",)]
    assert rows(manifests.merged(d, covered), "name", "version", "is_direct") == [("left", "1.0", True)]


def test_transitive_and_monorepo(spark):
    poms = spark.createDataFrame([("a", "1", "b", "1", None, None), ("b", "1", "a", "1", None, None), ("b", "1", "c", "2", "compile", False), ("c", "2", "d", "1", "test", None), ("c", "2", "e", "1", None, True)], "name string, version string, dep_name string, dep_version string, scope string, optional boolean")
    assert rows(manifests.transitive(spark.createDataFrame([("a", "1")], "name string, version string"), poms), "name", "version", "depth") == [("a", "1", 0), ("b", "1", 1), ("c", "2", 2)]
    kind = lambda *fs: manifests.monorepo(spark.createDataFrame(list(fs), "path string, content string")).first().kind
    assert kind(("go.work", ""), ("pnpm-workspace.yaml", "")) == "go" and kind(("nx.json", ""), ("go.work", "")) == "nx" and kind(("turbo.json", ""), ("pom.xml", "<modules>")) == "maven" and kind(("x", "")) == "none"


def test_layers(spark):
    e = spark.createDataFrame([(0, 0, "a/x"), (0, 1, "a/y"), (0, 2, "b"), (1, 0, "a/.wh.x"), (1, 1, "b"), (2, 0, "a/x"), (3, 0, "c/d"), (3, 1, "c/.wh..wh..opq"), (3, 2, "c/e"), (4, 0, ".wh.b")], "layer_idx int, tar_ordinal int, path string")
    assert rows(images.overlay(e), "path", "layer_idx", "is_deleted") == [("a/x", 2, False), ("a/y", 0, False), ("b", 1, True), ("c/d", 3, True), ("c/e", 3, False)]


def test_packages_and_os(spark):
    dpkg = "Package: a\nStatus: install ok installed\nVersion: 1.0-1\nSource: src (2)\nArchitecture: amd64\n\nPackage: gone\nStatus: deinstall ok config-files\nVersion: 1\n\nPackage: b\nStatus: install ok installed\nVersion: 2\n"
    df = spark.createDataFrame([(1, dpkg)], "k int, c string")
    assert rows(images.dpkg_packages(df, "k", "c"), "name", "version", "source_package") == [("a", "1.0-1", "src"), ("b", "2", "b")]
    apk = spark.createDataFrame([(1, "P:musl\nV:1.2-r0\nA:x86\no:musl\n\nP:zlib\nV:1.3\no:zlib-src\n")], "k int, c string")
    assert rows(images.apk_packages(apk, "k", "c"), "name", "version", "source_package") == [("musl", "1.2-r0", "musl"), ("zlib", "1.3", "zlib-src")]
    os_ = spark.createDataFrame([('NAME="X"\nID=alpine\nVERSION_ID="3.19"\n',)], "c string").select(images.os_release(F.col("c")).alias("o")).first().o
    assert (os_.id, os_.version, os_.name) == ("alpine", "3.19", None)


def test_image_checks(spark):
    c = spark.createDataFrame([("", ["DB_PASSWORD=x"], ["2222/tcp"], {}, False, "latest", None, None), ("app", ["A=b"], ["80/tcp", "22/udp"], {f"org.opencontainers.image.{x}": "y" for x in ("title", "version", "description", "licenses", "source", "vendor", "documentation", "authors")}, True, "1.2", "/app", "SIGTERM")], "user string, env array<string>, exposed_ports array<string>, labels map<string,string>, has_healthcheck boolean, tag string, working_dir string, stop_signal string")
    hit = lambda checks, user: {r.rule_id for r in images.run_checks(c, checks).collect() if r.user == user}
    assert hit(images.HARDENING_CHECKS, "") == {i for i, *_ in images.HARDENING_CHECKS} - {"IMG-SSH-PORT"} and hit(images.HARDENING_CHECKS, "app") == {"IMG-SSH-PORT"}
    assert hit(images.CONFIG_CHECKS, "") == {i for i, *_ in images.CONFIG_CHECKS} - {"CFG-ADMIN-PORT"} and hit(images.CONFIG_CHECKS, "app") == {"CFG-ADMIN-PORT"}
    f = spark.createDataFrame([("bin/su", 0o4755, 1, False), ("tmp/x", 0o0777, 1, True), ("tmp/y", 0o0772, 1, True), ("usr/bin/big", 0o755, 200 << 20, False), ("/usr/bin/sudo", 0o755, 1, False), ("var/cache/apt/p", 0o644, 1, False), ("opt/nmap", 0o755, 1, False), ("bin/sh", 0o755, 1, False)], "path string, mode bigint, size bigint, is_dir boolean")
    assert rows(images.run_checks(f, images.FILE_CHECKS), "path", "rule_id") == sorted([("bin/su", "IMG-SETUID"), ("tmp/y", "IMG-WORLD-WRITABLE"), ("usr/bin/big", "IMG-LARGE-BINARY"), ("/usr/bin/sudo", "IMG-SUDO"), ("var/cache/apt/p", "IMG-PACKAGE-CACHE"), ("opt/nmap", "IMG-NETWORK-TOOL"), ("bin/sh", "IMG-SHELL")])
    layers = spark.createDataFrame([(0, "d0", "ADD file:x"), (1, "d1", "RUN make"), (2, "d2", "CMD x")], "layer_idx int, layer_digest string, created_by string")
    assert rows(images.layer_blame(spark.createDataFrame([("p", "d0"), ("q", "d2")], "name string, layer_digest string"), layers), "name", "is_base") == [("p", True), ("q", False)]


def test_feeds(spark):
    one = lambda j: spark.createDataFrame([(json.dumps(j),)], "body string")
    a = feeds.alpine(one({"distroversion": "v3.19", "packages": [{"pkg": {"name": "p", "secfixes": {"0": ["CVE-1"], "1.2-r0": ["CVE-2 GHSA-x"]}}}]}))
    assert rows(a, "vuln_id", "fixed_version", "status", "distro_version") == [("CVE-1", "", "not-affected", "3.19"), ("CVE-2", "1.2-r0", "fixed", "3.19")]
    d = feeds.debian(one({"p": {"CVE-1": {"releases": {"bookworm": {"status": "resolved", "fixed_version": "1"}, "sid": {"status": "open"}, "x": {"status": "open"}}}}, "q": {"CVE-1": {"releases": {"bookworm": {"status": "undetermined"}}}}}), {"bookworm": "12", "sid": "sid"})
    assert rows(d, "package_name", "distro_version", "fixed_version", "status") == [("p", "12", "1", "fixed"), ("p", "sid", "", "affected")]
    cpe = lambda s, v=True, **k: {"vulnerable": v, "criteria": s, **k}
    n = feeds.nvd(one({"vulnerabilities": [{"cve": {"id": "CVE-3", "metrics": {"cvssMetricV30": [{"cvssData": {"baseScore": 7.5}}], "cvssMetricV2": [{"cvssData": {"baseScore": 5}}]}, "configurations": [{"nodes": [{"cpeMatch": [cpe("cpe:2.3:a:v:p:*", versionEndExcluding="2"), cpe("cpe:2.3:h:v:hw:*"), cpe("cpe:2.3:a:v:no:*", False)]}]}]}}]}))
    assert rows(n, "vuln_id", "package_name", "fixed_version", "cvss_score") == [("CVE-3", "p", "2", 7.5)]
    t = feeds.tool_findings(one({"results": [{"id": "R", "sev": "ERROR", "at": {"line": 3}}]}), "ext", {"rule_id": "$.id", "severity": "$.sev", "line": "$.at.line"}, items="$.results")
    assert rows(t, "rule_id", "severity", "line") == [("R", "high", "3")]


def test_unified_diff(spark):
    diff = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,3 @@\n a\n-b\n+c\n+d\n@@ -9 +10 @@\n-z\n+y\ndiff --git a/k b/k\n--- a/k\n+++ b/k\n@@ -0,0 +1 @@\n+n\n"
    got = rows(feeds.unified_diff(spark.createDataFrame([(1, diff)], "k int, d string"), "k", "d"), "path", "new_start", "kind", "content", "old_line", "new_line")
    assert got == sorted([("x", 1, "context", "a", 1, 1), ("x", 1, "deleted", "b", 2, None), ("x", 1, "added", "c", None, 2), ("x", 1, "added", "d", None, 3), ("x", 10, "deleted", "z", 9, None), ("x", 10, "added", "y", None, 10), ("k", 1, "added", "n", None, 1)], key=repr)


def test_files_and_mirror(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "src" / "b.png").write_bytes(b"\x89")
    assert [r.content for r in feeds.files(spark, str(tmp_path / "src")).collect()] == ["x = 1\n"]
    feeds.write_mirror(spark.createDataFrame([("npm", "b"), ("npm", "a"), ("go", "c")], "ecosystem string, package_name string"), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).where("ecosystem = 'npm'").count() == 2


def test_advisory_expressions(spark):
    ev = [("0", None, None), (None, "1", None), ("2", None, None), ("3", None, None), (None, "4", None), (None, "9", None), ("5", None, None), (None, None, "6"), ("7", "8", None), ("10", None, None)]
    df = spark.createDataFrame([(ev,)], "e array<struct<introduced:string,fixed:string,last_affected:string>>")
    want = [("0", "1", None), ("2", None, None), ("3", "4", None), ("0", "9", None), ("5", None, "6"), ("7", "8", None), ("10", None, None)]
    assert [tuple(x) for x in df.select(event_pairs(F.col("e")).alias("p")).first().p] == want
    lic = spark.createDataFrame([(x,) for x in ("MIT", "Apache-2.0 OR GPL-3.0", "LGPL-2.1", None, "Proprietary", "weird")], "l string").select(licence_category(F.col("l")).alias("c")).collect()
    assert [r.c for r in lic] == ["permissive", "copyleft", "weak-copyleft", "unknown", "proprietary", "unknown"]
    assert spark.range(1).select(package_url(F.lit("NPM"), F.lit("@s"), F.lit("x"), F.lit("1")).alias("p")).first().p == "pkg:npm/%40s/x@1"
    f = spark.createDataFrame([(x,) for x in ("a/b", "A/b", "a/b/c", "q", "z/b", None)], "package_name string")
    got = reachability(f, spark.createDataFrame([("a/b",)], "package string"))
    assert rows(got, "package_name", "reach_tier") == sorted([("a/b", 1), ("A/b", 2), ("a/b/c", 3), ("z/b", 4), ("q", 5), (None, 5)], key=repr)


def test_reachability_by_other_names_and_dependencies(spark):
    f = spark.createDataFrame([(x,) for x in ("PyYAML", "pillow", "scikit-learn", "google-cloud-storage", "azure-core", "psycopg2-binary", "python-jose", "direct", "indirect", "my-pkg", "yaml")], "package_name string")
    imports = spark.createDataFrame([(x,) for x in ("yaml", "PIL", "sklearn", "google", "azure", "psycopg2", "jose", "my_pkg")], "package string")
    deps = spark.createDataFrame([("direct", True), ("indirect", False), ("pillow", True), ("direct", True)], "name string, is_direct boolean")
    got = {r.package_name: r.reach_tier for r in reachability(f, imports, dependencies=deps).collect()}
    assert got == dict.fromkeys(("PyYAML", "pillow", "scikit-learn", "google-cloud-storage", "azure-core", "psycopg2-binary", "python-jose"), 2) | {"direct": 6, "indirect": 5, "my-pkg": 5, "yaml": 1}
    assert reachability(f, imports).where("reach_tier = 5").count() == 3


def test_git_and_folders(spark, tmp_path):
    import subprocess

    repo = tmp_path / "repo"
    (repo / "core").mkdir(parents=True)
    (repo / "node_modules" / "x").mkdir(parents=True)
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=Ann", "-c", "user.email=a@b.test", *a], check=True, capture_output=True)
    git("init", "-q")
    (repo / "core" / "a.py").write_text("x = 1\ny = 2\n")
    (repo / "b.png").write_bytes(b"\x89")
    git("add", ".")
    git("commit", "-qm", "one")
    (repo / "core" / "a.py").write_text("x = 1\nz = 3\nw = 4\n")
    (repo / "core" / "test_a.py").write_text("t = 1\n")
    git("add", ".")
    assert rows(feeds.git_staged(spark, str(repo)), "path") == [("core/a.py",), ("core/test_a.py",)]
    git("-c", "user.name=Bo", "commit", "-qm", "two")
    assert rows(feeds.git_changed(spark, str(repo)), "path") == [("core/a.py",), ("core/test_a.py",)]
    assert rows(feeds.git_stats(spark, str(repo)), "path", "added", "deleted") == [("core/a.py", 2, 1), ("core/test_a.py", 1, 0)]
    assert rows(feeds.git_blame(spark, str(repo), ["core/a.py"]), "path", "author", "lines") == [("core/a.py", "Ann", 1), ("core/a.py", "Bo", 2)]
    (repo / "node_modules" / "x" / "i.js").write_text("1")
    (repo / "core" / "gen.go").write_text("package x")
    (repo / "app.min.js").write_text("1")
    (repo / ".gitignore").write_text("*.go\n")
    assert rows(feeds.scan_files(spark, str(repo), more_ignored=(".gitignore",)), "path", "language") == [("core/a.py", "python")]
    assert rows(feeds.scan_files(spark, str(repo), tests=True, more_ignored=(".gitignore",)), "path") == [("core/a.py",), ("core/test_a.py",)]
