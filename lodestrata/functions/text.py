"""Text, path and snippet expressions over code lines; all of them native Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line) with numbers from 1; a last empty line doesn't count, null texts give none."""
    parts = F.split(F.col(text), r"\r?\n", -1)
    out = rows.select(key, F.posexplode(parts).alias("_pos", "line"), F.size(parts).alias("_n"))
    return out.where(~((F.col("_pos") == F.col("_n") - 1) & (F.col("line") == ""))).select(key, (F.col("_pos") + 1).alias("line_no"), "line")


def normalize_path(path: Column) -> Column:
    """Forward slashes, folded ``.``, ``..`` and empty steps, lower case; empty stays empty."""
    slashed = F.regexp_replace(path, r"\\", "/")
    rooted = slashed.startswith("/")

    def fold(done: Column, step: Column) -> Column:
        up = (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != "..")
        return (
            F.when(step.isin("", "."), done)
            .when((step == "..") & up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .when((step == "..") & rooted, done)
            .otherwise(F.concat(done, F.array(step)))
        )

    steps = F.aggregate(F.split(slashed, "/", -1), F.array().cast("array<string>"), fold)
    # the fold is done once a row, however often its outcome is named
    cleaned = F.transform(F.array(F.array_join(steps, "/")), lambda body: F.when(rooted, F.concat(F.lit("/"), body)).when(body == "", F.lit(".")).otherwise(body))[0]
    # most paths have no such steps, and then nothing is folded
    return F.when(path == "", F.lit("")).otherwise(F.lower(F.when(slashed.rlike(r"(?:^|/)\.{0,2}(?:/|$)"), cleaned).otherwise(slashed)))


def normalize_snippet(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"[ \t\n\r]+", " "))


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def last_two_steps(path: Column) -> Column:
    """The last two steps of a path."""
    return F.array_join(F.slice(F.split(F.regexp_replace(path, r"\\", "/"), "/"), F.greatest(F.lit(-2), -F.size(F.split(F.regexp_replace(path, r"\\", "/"), "/"))), F.lit(2)), "/")


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)


def extension(path: Column) -> Column:
    """The lower-case extension with its dot, empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]*)$", 1))


def shannon_entropy(text: Column) -> Column:
    """Bits a character, counted over characters (for ASCII as over bytes)."""
    n = F.length(text).cast("double")
    chars = F.split(text, "")
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double"))
    return F.aggregate(counts, F.lit(0.0), lambda acc, k: acc - k / n * F.log2(k / n))


QUOTED_RUN = r"""['"][a-zA-Z0-9+/=_\-]{20,}['"]"""


def redact(line: Column) -> Column:
    """Each quoted run of 20 or more secret characters keeps its first and last two characters, quotes included."""
    return F.regexp_replace(line, r"""(['"][a-zA-Z0-9+/=_\-])[a-zA-Z0-9+/=_\-]{18,}([a-zA-Z0-9+/=_\-]['"])""", "$1[REDACTED]$2")


def slug(text: Column) -> Column:
    return F.regexp_replace(text, r"[^a-zA-Z0-9]", "-")


#: Languages by extension (fixed values).
LANGUAGES = {
    ".go": "go", ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".rb": "ruby",
    ".php": "php", ".cs": "csharp", ".rs": "rust", ".kt": "kotlin", ".swift": "swift", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".scala": "scala", ".sh": "shell", ".bash": "shell", ".tf": "terraform",
    ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".xml": "xml", ".html": "html", ".sql": "sql",
}


def language(path: Column) -> Column:
    """The language of a path by its extension, or by the file name Dockerfile; unknown otherwise."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.when(F.lower(basename(path)).startswith("dockerfile"), F.lit("dockerfile")).otherwise(F.coalesce(F.try_element_at(table, extension(path)), F.lit("unknown")))


def is_comment(line: Column) -> Column:
    return F.ltrim(line).rlike(r"^(//|#|/\*|\*)")


def is_assignment(line: Column) -> Column:
    """A single equals sign (no comparison), or a leading ``key: value``."""
    return line.rlike(r"(^|[^=!<>:+\-*/])=([^=>]|$)") | line.rlike(r"""^\s*["']?[A-Za-z_][\w.-]*["']?\s*:\s+\S""")


SECRET_KEYWORDS = ("secret", "password", "token", "key", "credential", "auth", "api")


def has_secret_keyword(line: Column) -> Column:
    return F.lower(line).rlike("|".join(SECRET_KEYWORDS))


def bigrams(text: Column) -> Column:
    """The set of two-character windows."""
    n = F.length(text)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of the bigram sets; 0 if both are empty."""
    x, y = bigrams(a), bigrams(b)
    total = F.size(x) + F.size(y)
    return F.when(total == 0, F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(x, y)) / total)


TEST_PATH = r"(?i)(^|/)(tests?|__tests__|specs?)/|(^|/)(test_[^/]*|[^/]*_test|[^/]*\.(test|spec))\.[a-z]+$|(^|/)(setup\.py|conftest\.py|setup\.cfg)$"


def is_test_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/").rlike(TEST_PATH)


#: Extensions of files that hold no text (fixed values).
BINARY_EXTENSIONS = tuple(".png .jpg .jpeg .gif .ico .pdf .zip .tar .gz .bz2 .woff .woff2 .ttf .eot .mp4 .mp3 .avi .mov .lock .sum .pyc .pyo .so .dll .dylib .wasm .o .a .class .jar .svg .exe .bin .dat .db .sqlite".split())


def is_text_file(path: Column) -> Column:
    return ~extension(path).isin(*BINARY_EXTENSIONS)


def is_third_party(path: Column) -> Column:
    """Minified or bundled files and well-known library names."""
    return F.lower(basename(path)).rlike(r"\.min\.|_min\.js$|-min\.js$|\.bundle\.|^(jquery|bootstrap|angular|react|vue|lodash|underscore|moment|d3|backbone|ember)[.-]|^(vendor|bundle|chunk)[.-]")


def is_lockfile(path: Column) -> Column:
    base = F.lower(basename(path))
    return base.isin("package-lock.json", "npm-shrinkwrap.json", "pnpm-lock.yaml", "go.sum") | base.endswith(".lock")


def is_example_file(path: Column) -> Column:
    base = basename(path)
    return (base.startswith(".env.") & base.contains("example")) | base.rlike(r"\.(example|sample|template|dist)$")


def is_doc_path(path: Column) -> Column:
    """Documentation: text formats of prose, and what lies in a folder of documents."""
    plain = F.lower(F.regexp_replace(path, r"\\", "/"))
    return plain.rlike(r"\.(md|markdown|rst|adoc|txt)$|(^|/)(docs?|documentation|man)/|(^|/)(readme|changelog|license|contributing)[^/]*$")


def is_binary_path(path: Column) -> Column:
    return extension(path).isin(*BINARY_EXTENSIONS)


#: Packages that are imported under other names (fixed values); reachability leaves out the second table.
IMPORT_NAMES = {
    "pyyaml": ("yaml",), "pillow": ("PIL",), "beautifulsoup4": ("bs4",), "scikit-learn": ("sklearn",), "python-dateutil": ("dateutil",), "opencv-python": ("cv2",), "pyjwt": ("jwt",),
    "python-dotenv": ("dotenv",), "psycopg2-binary": ("psycopg2",), "python-jose": ("jose",),
}
MORE_IMPORT_NAMES = {"protobuf": ("google",), "attrs": ("attr",), "msgpack-python": ("msgpack",), "mysqlclient": ("MySQLdb",)}
#: Packages with these prefixes are imported under a common name (fixed values).
IMPORT_PREFIXES = {"google-cloud-": ("google", "google.cloud"), "azure-": ("azure",)}


def _other_names(low: Column, names: dict[str, tuple[str, ...]]) -> list[Column]:
    none = F.array().cast("array<string>")
    known = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))])
    return [*[F.when(low.startswith(k), F.array(*[F.lit(n) for n in v])).otherwise(none) for k, v in IMPORT_PREFIXES.items()], F.coalesce(F.try_element_at(known, low), none)]


def import_names(package: Column) -> Column:
    """Names under which reachability looks for a package: itself, lower case, the common name of its prefix, and known other names."""
    low = F.lower(F.trim(package))
    return F.array_distinct(F.concat(F.array(package, low), *_other_names(low, IMPORT_NAMES)))


def import_candidates(package: Column) -> Column:
    """Names under which a package may be imported: those of import_names, with underscores, and some more known names."""
    low = F.lower(F.trim(package))
    return F.array_distinct(F.concat(F.array(package, low, F.regexp_replace(low, "-", "_")), *_other_names(low, IMPORT_NAMES | MORE_IMPORT_NAMES)))
