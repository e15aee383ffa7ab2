"""Rule matching over code lines.

Rule tables are small dimensions that are compiled into one projection: every rule is a literal
pattern inside whole-stage code, so a line is matched where it is read and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import has_secret_keyword, is_assignment, is_comment, redact, shannon_entropy, slug


@dataclass(frozen=True)
class Rule:
    """A line rule. languages and globs (over paths): empty for all. suppress: a name in SUPPRESSIONS."""

    rule_id: str
    pattern: str
    severity: str = "medium"
    confidence: str = "medium"
    title: str = ""
    languages: tuple[str, ...] = ()
    requires_assignment: bool = False
    skip_quotes: bool = True
    safe: tuple[str, ...] = ()
    sanitizers: tuple[str, ...] = ()
    cwe: str = ""
    globs: tuple[str, ...] = ()
    suppress: str = ""


#: Secret formats: name, pattern, severity, confidence (fixed values).
SECRET_FORMATS = (
    ("AWS Access Key ID", r"AKIA[0-9A-Z]{16}", "high", "high"),
    ("AWS Secret Access Key", r"""(?i)aws(.{0,20})?(secret|sk)[^\w]{0,5}['"=][0-9a-zA-Z/+]{40}['"]""", "high", "high"),
    ("Google API Key", r"AIza[0-9A-Za-z\-_]{35}", "high", "high"),
    ("Google OAuth Access Token", r"ya29\.[0-9A-Za-z\-_]+", "high", "high"),
    ("Google Cloud Service Account", r'"type":\s*"service_account"', "high", "high"),
    ("Azure Storage Key", r"AccountKey=[a-zA-Z0-9+/=]{88}", "high", "high"),
    ("GitHub Personal Access Token", r"ghp_[a-zA-Z0-9]{36}", "high", "high"),
    ("GitHub Fine-grained Token", r"github_pat_[a-zA-Z0-9]{22}_[a-zA-Z0-9]{59}", "high", "high"),
    ("GitHub Action Token", r"ghs_[a-zA-Z0-9]{36}", "high", "high"),
    ("GitHub OAuth Token", r"gho_[a-zA-Z0-9]{36}", "high", "high"),
    ("GitHub Refresh Token", r"ghr_[a-zA-Z0-9]{76}", "high", "high"),
    ("GitLab Personal Access Token", r"glpat-[a-zA-Z0-9\-_]{20}", "high", "high"),
    ("Slack Token", r"xox[pborsa]-[0-9]{12}-[0-9]{12}-[0-9]{12}-[a-z0-9]{32}", "high", "high"),
    ("Slack Webhook", r"https://hooks\.slack\.com/services/T[a-zA-Z0-9_]{8}/B[a-zA-Z0-9_]{8}/[a-zA-Z0-9_]{24}", "high", "high"),
    ("Stripe Live API Key", r"sk_live_[0-9a-zA-Z]{24}", "high", "high"),
    ("Stripe Restricted Key", r"rk_live_[0-9a-zA-Z]{24}", "high", "high"),
    ("Twilio API Key", r"SK[0-9a-fA-F]{32}", "high", "high"),
    ("Square Access Token", r"sq0atp-[0-9A-Za-z\-_]{22}", "high", "high"),
    ("Square OAuth Secret", r"sq0csp-[0-9A-Za-z\-_]{43}", "high", "high"),
    ("Heroku API Key", r"(?i)heroku.{0,20}[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "high", "medium"),
    ("Mailgun API Key", r"key-[0-9a-zA-Z]{32}", "high", "high"),
    ("MailChimp API Key", r"[0-9a-f]{32}-us[0-9]{1,2}", "medium", "medium"),
    ("Telegram Bot Token", r"[0-9]+:AA[0-9A-Za-z\-_]{33}", "high", "high"),
    ("RSA Private-Key", r"-----BEGIN RSA PRIVATE KEY-----", "high", "high"),
    ("EC Private-Key", r"-----BEGIN EC PRIVATE KEY-----", "high", "high"),
    ("DSA Private-Key", r"-----BEGIN DSA PRIVATE KEY-----", "high", "high"),
    ("OpenSSH Private-Key", r"-----BEGIN OPENSSH PRIVATE KEY-----", "high", "high"),
    ("PGP Private-Key", r"-----BEGIN PGP PRIVATE KEY BLOCK-----", "high", "high"),
    ("Database Connection URL", r"(postgres|postgresql|mysql|mongodb|redis|amqp)://\S+:\S+@\S+", "high", "high"),
    ("Password in URL", r"[a-zA-Z]{3,10}://[^/\s:@]+:[^/\s:@]+@[a-zA-Z0-9\.\-]+", "medium", "medium"),
    ("JWT Token", r"eyJ[a-zA-Z0-9_-]{10,}\.eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}", "high", "high"),
    ("Generic API Key assignment", r"""(?i)(api[_-]?key|apikey)\s*[:=]\s*['"][a-zA-Z0-9]{32,}['"]""", "medium", "medium"),
    ("Generic Secret assignment", r"""(?i)(secret|client[_-]?secret)\s*[:=]\s*['"][a-zA-Z0-9]{32,}['"]""", "medium", "medium"),
    ("Generic Password assignment", r"""(?i)(password|passwd|pwd)\s*[:=]\s*['"][^\s'"]{8,}['"]""", "medium", "medium"),
    ("Generic Token assignment", r"""(?i)(token|auth[_-]?token|access[_-]?token)\s*[:=]\s*['"][a-zA-Z0-9]{32,}['"]""", "medium", "medium"),
)
#: Parts of a match that mark an example value, and labels of input fields (fixed values).
EXAMPLE_MARKS = ("example", "placeholder", "your-", "xxx", "yyy", "zzz", "test-key", "dummy", "sample", "changeme", "todo")
LABEL_TERMS = ("password", "passwort", "mot de passe", "كلمة المرور", "كلمة مرور", "at least", "confirm", "current", "new ", "forgot", "nouveau", "caracteres", "caractères", "characters", "zeichen", "أحرف")
#: What a line must hold for any of the secret formats to match: tested once before all of them.
SECRET_HINT = r"(?i)akia|aws|aiza|ya29|service_account|accountkey|gh[porsu]_|github_pat|glpat|xox|slack|_live_|sk[0-9a-f]{32}|sq0|heroku|key|-us[0-9]|:aa|-----begin|://|eyj|secret|passw|pwd|token"


def secret_rules() -> list[Rule]:
    return [Rule("SECRET-" + re.sub(r"[^a-zA-Z0-9]", "-", name), pattern, severity, confidence, name, cwe="CWE-798") for name, pattern, severity, confidence in SECRET_FORMATS]


def false_positive(match: Column) -> Column:
    """Example values, values that come from a variable, and labels of input fields."""
    low = F.lower(match)
    at = F.when(match.contains("="), F.instr(match, "=")).when(match.contains(":"), F.instr(match, ":")).otherwise(0)
    value = F.when(at > 0, F.regexp_replace(F.trim(F.substring(match, at + 1, F.lit(1 << 30))), r"""^["']+|["']+$""", ""))
    variable = F.coalesce(value.startswith("$"), F.lit(False))
    label = F.coalesce((F.regexp_replace(F.lower(value), r"[•* ]", "") == "") | F.lower(value).rlike("|".join(re.escape(t) for t in LABEL_TERMS)), F.lit(False))
    return low.rlike("|".join(re.escape(m) for m in EXAMPLE_MARKS)) | variable | label


def _hit_of(r: Rule):
    return lambda m: F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.confidence).alias("confidence"), m.alias("match"))


def secret_scan(lines: DataFrame, rules: list[Rule] | None = None, line: str = "line") -> DataFrame:
    """lines with (rule_id, severity, confidence, match): one row for each match of each rule.

    Comment lines are tested for armour rules alone, once a rule; lines that define a detection rule
    themselves give nothing.
    """
    comment = is_comment(F.col(line))
    lines = lines.where(~(F.col(line).contains("regexp.MustCompile(") & F.col(line).contains("Pattern:")))
    if rules is None:
        lines = lines.where(F.col(line).rlike(SECRET_HINT))
    parts = []
    for r in rules or secret_rules():
        found = F.filter(F.regexp_extract_all(F.col(line), F.lit(r.pattern), F.lit(0)), lambda m: ~false_positive(m))
        found = F.when(comment, F.slice(F.regexp_extract_all(F.col(line), F.lit(r.pattern), F.lit(0)), 1, 1) if "Private-Key" in r.rule_id else F.array().cast("array<string>")).otherwise(found)
        parts.append(F.transform(found, _hit_of(r)))
    return lines.withColumn("_m", F.explode(F.flatten(F.array(*parts)))).select("*", "_m.*").drop("_m")


def entropy_scan(lines: DataFrame, threshold: float = 4.5, line: str = "line") -> DataFrame:
    """Quoted strings of 20 or more secret characters whose entropy reaches the threshold, on lines with a secret keyword."""
    hit = lines.where(has_secret_keyword(F.col(line)) & ~is_comment(F.col(line)))
    found = hit.withColumn("value", F.explode(F.regexp_extract_all(F.col(line), F.lit(r"""['"]([a-zA-Z0-9+/=_\-]{20,})['"]"""), F.lit(1))))
    return found.withColumn("entropy", shannon_entropy(F.col("value"))).where(F.col("entropy") >= threshold)


QUOTED = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`(?:[^`\\]|\\.)*`"""


def unquoted(line: Column) -> Column:
    """The line without its quoted spans."""
    return F.regexp_replace(line, QUOTED, "")


def quote_mask(line: Column) -> Column:
    """The line with every character of a quoted span, the quotes included, as a null character: offsets stay."""
    spans = F.regexp_extract_all(line, F.lit(f"(?:{QUOTED})|[^'\"`]+|."), F.lit(0))
    return F.array_join(F.transform(spans, lambda x: F.when((F.length(x) > 1) & x.rlike("^['\"`]"), F.repeat(F.lit("\u0000"), F.length(x))).otherwise(x)), "")


def matches_outside_quotes(line: Column, pattern: str) -> Column:
    """Whether a match of the pattern begins outside quotes; it may go on into them.

    A mark is set where a match can begin, and must be left when the quoted spans are taken out.
    """
    marked = F.regexp_replace(line, f"(?={pattern})", "\u0001")
    return F.when(~line.rlike(pattern), False).when(~line.rlike("['\"`]"), True).otherwise(unquoted(marked).contains("\u0001"))


def _value(line: Column) -> Column:
    """The first quoted value of a line."""
    return F.regexp_extract(line, r"""=\s*[rbuf]?['"]([^'"]*)['"]""", 1)


def _key_name(value: Column) -> Column:
    return value.rlike(r"^[a-z_\- ]+$")


#: Predicates over a line on which a rule matched: true where the match is none (constants are fixed values).
SUPPRESSIONS = {
    "static-command": lambda l: ~l.contains("+") & ~l.contains("${") & l.rlike(r"""(?i)\bexec\s*\(\s*['"][^'"]+['"]\s*\)"""),
    "library-markup": lambda l: l.rlike(r"Calendar\._TT|cal\.convertNumbers|cal\.date|Calendar\._DN|cal\.minYear|cal\.maxYear") | (l.contains("jQuery") & l.contains("innerHTML")),
    "password-default": lambda l: l.rlike(r"(?i)setPassword\s*\(") | l.rlike(r"""(?i)this\.\w+\s*=\s*\w+\s*[;{][^"']*$""") | l.rlike(r"""(?i)\bpassword\s*=\s*[^"'\s][^;]*;""") | l.rlike(r"""\bpassword\s*=\s*["'](?:|xxx|changeme|placeholder|todo|YOUR_PASSWORD|[a-z_\- ]+)["']\s*;"""),
    "key-name": lambda l: _value(l).contains("%(") | _key_name(_value(l)),
    "safe-loader": lambda l: l.rlike("SafeLoader|safe_load"),
    "insecure-off": lambda l: l.rlike(r"insecure ?= ?False"),
    "package-file": lambda l: l.rlike(r"__init__\.py|__pycache__|conftest\.py"),
    "label": lambda l: _label_value(F.lower(F.trim(F.regexp_extract(l, r"""(?i)(?:password|passwd|pwd|secret|api_key|apikey)\s*[:=]\s*['"]([^'"]*)['"]""", 1))), l.rlike(r"""(?i)(?:password|passwd|pwd|secret|api_key|apikey)\s*[:=]\s*['"][^'"]*['"]""")),
    "no-query": lambda l: (F.lower(l).contains("import") & F.lower(l).contains(" from")) | ~F.lower(l).rlike(r"query|execute|sql|statement|sequelize|knex|prisma|db\."),
    "escaped": lambda l: l.rlike(r"mysqli_real_escape_string|htmlspecialchars|htmlentities|intval|addslashes|filter_var|escapeshellarg|escapeshellcmd|strip_tags|->quote\("),
}


def _label_value(value: Column, found: Column) -> Column:
    return found & ((F.regexp_replace(value, "[•* ]", "") == "") | value.rlike("|".join(re.escape(t) for t in LABEL_TERMS)))


def pattern_scan(lines: DataFrame, rules: list[Rule], language: str = "language", line: str = "line", path: str = "file_path", inside: str = "inside") -> DataFrame:
    """lines with (rule_id, severity, confidence): one row for each line and rule.

    The language must be one of the rule's and the path match one of its globs; comment lines and,
    where the lines have such a column, lines inside a multi-line string are out; an assignment is
    needed where the rule says so; safe patterns, sanitizers and the rule's suppression cancel it; and
    a match must begin outside quotes.
    """
    text = F.col(line)
    tests = []
    for r in rules:
        ok = matches_outside_quotes(text, r.pattern) if r.skip_quotes else text.rlike(r.pattern)
        if r.globs:
            ok = F.col(path).rlike("|".join(f"(?:{glob_pattern(g)})" for g in r.globs)) & ok
        if r.languages:
            ok = F.col(language).isin(*r.languages) & ok
        if r.requires_assignment:
            ok = ok & is_assignment(text)
        for cancel in (*r.safe, *r.sanitizers):
            ok = ok & ~text.rlike(cancel)
        if r.suppress:
            ok = ok & ~SUPPRESSIONS[r.suppress](text)
        tests.append(F.when(ok, F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.confidence).alias("confidence"))))
    rows = lines.where(~is_comment(text))
    if inside in lines.columns:
        rows = rows.where(~F.col(inside))
    return rows.withColumn("_m", F.explode(F.filter(F.array(*tests), lambda m: m.isNotNull()))).select("*", "_m.*").drop("_m")


#: A small rule table over lines; `pattern_scan` takes any.
LINE_RULES = [
    Rule("LS-PY-EVAL", r"\beval\s*\(", "high", "medium", "code evaluation", ("python",), cwe="CWE-94"),
    Rule("LS-PY-PICKLE", r"\bpickle\.loads?\s*\(", "high", "high", "unsafe deserialization", ("python",), cwe="CWE-502"),
    Rule("LS-PY-SHELL", r"\bsubprocess\.\w+\(.*shell\s*=\s*True", "high", "high", "shell command", ("python",), cwe="CWE-78"),
    Rule("LS-PY-ASSERT", r"^\s*assert\s+\w", "info", "low", "assertion in code", ("python", "go", "java", "javascript"), cwe="CWE-617"),
    Rule("LS-JS-REQUIRE", r"\brequire\s*\(", "info", "low", "dynamic import", ("javascript", "typescript", "python", "go"), cwe="CWE-829"),
    Rule("LS-ANY-THROW", r"\bthrow new \w+\(", "info", "low", "thrown error", (), cwe="CWE-755"),
    Rule("LS-ANY-LOG", r"\blog\.debug\(", "low", "medium", "debug log", (), safe=(r"count=0\b",), cwe="CWE-532"),
    Rule("LS-ANY-ASSIGN-TRIM", r"\.trim\(\)", "info", "low", "trimmed input", (), requires_assignment=True),
    Rule("LS-ANY-DSN", r"://\S+:\S+@", "high", "high", "login in a link", (), skip_quotes=False, safe=(r"\$\{",), cwe="CWE-798"),
]


def finding_id(prefix: str, rule: Column, path: Column, line: Column) -> Column:
    return F.concat_ws("-", F.lit(prefix), slug(rule), F.element_at(F.split(path, "/"), -1), line.cast("string"))


def evidence(line: Column) -> Column:
    return redact(line)


def suppression_directives(lines: DataFrame, word: str = "scan-ignore", line: str = "line") -> DataFrame:
    """lines with rule_id (null for all rules) of each line that carries a directive such as ``# scan-ignore: RULE-1``."""
    mark = rf"(?://|#|--|/\*|<!--)\s*{re.escape(word)}\b"
    rule = F.regexp_extract(F.col(line), mark + r":?\s*([A-Z][A-Z0-9-]+)?", 1)
    return lines.where(F.col(line).rlike(mark)).withColumn("rule_id", F.nullif(rule, F.lit("")))


#: Openings of functions (fixed values).
FUNCTION_STARTS = (r"^def\s+([A-Za-z_]\w*)", r"^(?:async\s+)?function\s+([A-Za-z_$][\w$]*)", r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)", r"^(?:public|private|protected|static|\s)*[\w<>\[\]]+\s+([A-Za-z_]\w*)\s*\([^;]*\)\s*\{")
_NO_NAMES = ("if", "for", "while", "switch", "catch", "return", "else", "new", "throw")


def function_boundaries(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with name: the function that begins on the line, by the first pattern that matches."""
    trimmed = F.ltrim(F.col(line))
    name = F.coalesce(*[F.nullif(F.regexp_extract(trimmed, p, 1), F.lit("")) for p in FUNCTION_STARTS])
    return lines.withColumn("name", name).where(F.col("name").isNotNull() & ~F.col("name").isin(*_NO_NAMES))


def imports(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with package: what the line imports, by language form; names reduced to the package or @scope/package."""
    text = F.ltrim(F.col(line))
    python = F.regexp_extract(text, r"^(?:import|from)\s+([A-Za-z_][\w.]*)", 1)
    script = F.regexp_extract(text, r"""(?:\brequire\s*\(\s*|\bfrom\s+|^import\s+)["']([^"']+)["']""", 1)
    reduced = F.when(script.rlike(r"^\.{0,2}/"), script).when(script.startswith("@"), F.regexp_extract(script, r"^(@[^/]+/[^/]+)", 1)).otherwise(F.regexp_extract(script, r"^([^/]+)", 1))
    return lines.withColumn("package", F.coalesce(F.nullif(reduced, F.lit("")), F.nullif(F.regexp_extract(python, r"^([A-Za-z_]\w*)", 1), F.lit("")))).where("package is not null")


def framework_detection(files: DataFrame, signals: DataFrame, min_signals: int = 1) -> DataFrame:
    """(framework, matched, confidence): signals (framework, kind file|glob|contains, value) found in files (path, content)."""
    total = signals.groupBy("framework").agg(F.count(F.lit(1)).alias("_total"))
    by_name = files.select(F.element_at(F.split("path", "/"), -1).alias("value")).distinct().join(signals.where("kind = 'file'"), "value").select("framework", "value")
    wanted = [r.value for r in signals.where("kind = 'contains'").select("value").distinct().limit(2001).collect()]  # a rule dimension
    if len(wanted) > 2000:
        raise ValueError("at most 2,000 content signals")
    tests = F.filter(F.array(*[F.when(F.col("content").contains(w), F.lit(w)) for w in wanted]), lambda x: x.isNotNull()) if wanted else F.array().cast("array<string>")
    by_text = files.select(F.explode(tests).alias("value")).distinct().join(signals.where("kind = 'contains'"), "value").select("framework", "value")
    globs = [r.value for r in signals.where("kind = 'glob'").select("value").distinct().limit(2001).collect()]  # as above
    if len(globs) > 2000:
        raise ValueError("at most 2,000 glob signals")
    if globs:
        placed = F.filter(F.array(*[F.when(F.col("path").rlike(glob_pattern(g)), F.lit(g)) for g in globs]), lambda x: x.isNotNull())
        by_name = by_name.union(files.select(F.explode(placed).alias("value")).distinct().join(signals.where("kind = 'glob'"), "value").select("framework", "value"))
    hits = by_name.union(by_text).distinct().groupBy("framework").agg(F.count(F.lit(1)).alias("matched")).where(F.col("matched") >= min_signals)
    return hits.join(total, "framework").select("framework", "matched", F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.col("matched") / F.col("_total"))).alias("confidence"))


_OPENERS = {"python": ('"""', "'''"), "go": ("`",), "javascript": ("`",), "typescript": ("`",), "ruby": ("=begin",)}


def string_context(text: str | None, language: str | None) -> list[bool]:
    """For each line whether it lies inside a multi-line string or comment; a line on which one closes is code in full."""
    out, closing, heredoc = [], None, None
    for line in re.split(r"\r?\n", text or ""):
        if heredoc is not None:
            out.append(line.strip() != heredoc)
            heredoc = None if line.strip() == heredoc else heredoc
            continue
        if closing is not None:
            if closing == "=end":
                out.append(True)
                closing = None if line.startswith("=end") else closing
            elif closing in line:
                out.append(False)
                closing = None
            else:
                out.append(True)
            continue
        out.append(False)
        for opener in _OPENERS.get(language or "", ()):
            if opener == "=begin":
                if line.startswith("=begin"):
                    closing, out[-1] = "=end", True
            elif line.count(opener) % 2 == 1:
                closing = opener
                break
        if closing is None and language in ("ruby", "php", "shell") and (m := re.search(r"<<[-~<]?\s*[\"']?([A-Z_]{2,})[\"']?", line)):
            heredoc = m[1]
    return out


#: What can open a multi-line string or comment; a text without it needs no fold.
_MAY_OPEN = r'"""|\x27\x27\x27|`|<<|=begin'


def code_lines(rows: DataFrame, key: str, text: str, language: Column) -> DataFrame:
    """(key, language, line_no, line, inside): the lines of each text, numbered from 1, and whether each lies inside a multi-line string or comment."""
    flags = string_contexts(F.when(F.col(text).rlike(_MAY_OPEN), F.col(text)), language)
    parts = F.split(F.col(text), r"\r?\n", -1)
    out = rows.where(F.col(text).isNotNull()).select(key, language.alias("language"), flags.alias("_flags"), F.posexplode(parts).alias("_pos", "line"), F.size(parts).alias("_n"))
    out = out.where(~((F.col("_pos") == F.col("_n") - 1) & (F.col("line") == "")))
    return out.select(key, "language", (F.col("_pos") + 1).alias("line_no"), "line", F.coalesce(F.try_element_at("_flags", F.col("_pos") + 1), F.lit(False)).alias("inside"))


def string_contexts(text: Column, language: Column) -> Column:
    """`string_context` in Arrow batches."""

    @F.pandas_udf("array<boolean>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for t, l in batches:
            yield pd.Series([string_context(x, y) for x, y in zip(t, l, strict=True)])

    return run(text, language)


def glob_pattern(glob: str) -> str:
    """An ignore-file glob as a regular expression over relative paths: ``*`` within a step, ``**`` across steps, a leading or inner slash anchors, a trailing one means directories."""
    directory, body = glob.endswith("/"), glob.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    out, i = [], 0
    while i < len(body):
        if body.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
        elif body.startswith("**", i):
            out.append(".*")
            i += 2
        elif body[i] == "*":
            out.append("[^/]*")
            i += 1
        elif body[i] == "?":
            out.append("[^/]")
            i += 1
        else:
            out.append(re.escape(body[i]))
            i += 1
    return ("^" if anchored else "(?:^|/)") + "".join(out) + ("/" if directory else "(?:/|$)")


def ignored(path: Column, globs: list[str]) -> Column:
    """Whether a path is ignored: the last matching glob decides, ``!`` turns it round; blanks and # lines don't count."""
    state = F.lit(False)
    for g in (x.strip() for x in globs):
        if g and not g.startswith("#"):
            state = F.when(path.rlike(glob_pattern(g.lstrip("!"))), F.lit(not g.startswith("!"))).otherwise(state)
    return state


def owners(paths: DataFrame, rules: list[tuple[str, list[str]]], path: str = "file_path") -> DataFrame:
    """(path, owner): the distinct owners of all matching rules."""
    hits = F.flatten(F.array(*[F.when(F.col(path).rlike(glob_pattern(g)), F.array(*[F.lit(o) for o in who])).otherwise(F.array().cast("array<string>")) for g, who in rules]))
    return paths.select(path, F.explode(F.array_distinct(hits)).alias("owner"))
