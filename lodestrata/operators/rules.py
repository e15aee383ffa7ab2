"""The rule dimension and its extension: custom rules, modes, presets, terraform blocks and fixes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.operators.scan import LINE_RULES, Rule, secret_rules

REGISTRY = "rule_ord int, rule_id string, title string, severity string, confidence string, languages array<string>, pattern string, cwe string"


def registry(spark: SparkSession, extra: list[Rule] | None = None) -> DataFrame:
    """All rules as rows; (rule_id, rule_ord) is the key, as an id may occur twice."""
    rules = [*secret_rules(), *LINE_RULES, *(extra or [])]
    return spark.createDataFrame([(i, r.rule_id, r.title, r.severity, r.confidence, list(r.languages), r.pattern, r.cwe) for i, r in enumerate(rules)], REGISTRY)


def custom_rules(items: list[dict]) -> list[Rule]:
    """Rules from configuration entries (id, title, languages, pattern, severity, confidence); a bad pattern or a missing id is an error here, not in a task."""
    out = []
    for i in items:
        if not i.get("id"):
            raise ValueError("a rule needs an id")
        try:
            re.compile(i["pattern"])
        except (re.error, KeyError) as e:
            raise ValueError(f"rule {i['id']}: bad pattern") from e
        out.append(Rule(i["id"], i["pattern"], i.get("severity", "medium"), i.get("confidence", "medium"), i.get("title", i["id"]), tuple(i.get("languages", ()))))
    return out


MODES = ("block", "inform", "off")


def load_modes(text: str) -> dict[str, str]:
    """Modes of single rules from a configuration's mapping ``rules:`` (lines of ``id: mode``); a list under that key holds custom rules and gives none. An unknown mode is an error."""
    out, inside = {}, False
    for line in text.splitlines():
        bare = re.sub(r"(^|\s)#.*", "", line).rstrip()
        if not bare:
            continue
        if not bare[0].isspace():
            inside = bare == "rules:"
        elif inside and (m := re.fullmatch(r"""\s+["']?([\w.-]+)["']?:\s*["']?(\w+)["']?""", bare)):
            if m[2] not in MODES:
                raise ValueError(f"rule {m[1]}: mode {m[2]} is none of {', '.join(MODES)}")
            out[m[1]] = m[2]
        elif inside and bare.lstrip().startswith("-"):
            return {}
    return out


def search(rules: DataFrame, text: str) -> DataFrame:
    """Rules whose id, title, severity, pattern or weakness holds the text, by id."""
    low = F.lower(F.lit(text))
    return rules.where(F.lower(F.concat_ws("\n", "rule_id", "title", "severity", "pattern", "cwe")).contains(low)).orderBy("rule_id", "rule_ord")


def maturity_counts(rules: DataFrame, maturity: Column, profiles: Column) -> DataFrame:
    """Rules by maturity and profile in one pass of grouping sets."""
    r = rules.select("rule_id", maturity.alias("maturity"), F.explode_outer(profiles).alias("profile"))
    return r.groupingSets([["maturity"], ["profile"], []], "maturity", "profile").agg(F.countDistinct("rule_id").alias("rules"))


def terraform_blocks(lines: DataFrame, key: str, line: str = "line") -> DataFrame:
    """(key, kind, name, first_line, body): resource blocks by the running balance of braces within each file."""
    opens = F.length(F.regexp_replace(line, r"[^{]", ""))
    closes = F.length(F.regexp_replace(line, r"[^}]", ""))
    w = W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    head = r'^\s*resource\s+"([^"]+)"\s+"([^"]+)"'
    l = lines.withColumns({"_after": F.sum(opens - closes).over(w), "_start": F.col(line).rlike(head).cast("int")}).withColumn("_before", F.col("_after") - (opens - closes))
    l = l.withColumn("_block", F.sum(F.when((F.col("_before") == 0) & (F.col("_start") == 1), 1).otherwise(0)).over(w))
    inside = l.where("_block > 0 and (_before > 0 or _start = 1)")
    first = F.min(F.struct("line_no", F.col(line).alias("t")))
    g = inside.groupBy(key, "_block").agg(first.alias("f"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", F.col(line).alias("t")))), lambda x: x["t"]), "\n").alias("body"))
    return g.select(key, F.regexp_extract("f.t", head, 1).alias("kind"), F.regexp_extract("f.t", head, 2).alias("name"), F.col("f.line_no").alias("first_line"), "body")


def without_companion(blocks: DataFrame, key: str, kind: str, companion: str, inline: str) -> DataFrame:
    """Blocks of a kind that neither hold the inline setting nor have, in the same file, a companion block that refers to them."""
    bare = blocks.where((F.col("kind") == kind) & ~F.col("body").rlike(inline))
    refs = blocks.where(F.col("kind") == companion).select(key, F.explode(F.regexp_extract_all("body", F.lit(re.escape(kind) + r"\.([A-Za-z_][\w-]*)"), F.lit(1))).alias("name")).distinct()
    return bare.join(refs, [key, "name"], "left_anti")


#: Line fixes: rule id, pattern, replacement (Java replacement syntax).
FIXES = (
    ("LS-PY-EVAL", r"\beval\(", "ast.literal_eval("),
    ("LS-PY-SHELL", r"shell\s*=\s*True", "shell=False"),
    ("LS-PY-PICKLE", r"\bpickle\.(loads?)\(", "json.$1("),
    ("LS-PY-YAML", r"\byaml\.load\(", "yaml.safe_load("),
    ("LS-PY-HASH", r"\bhashlib\.(?:md5|sha1)\(", "hashlib.sha256("),
    ("LS-PY-VERIFY", r"verify\s*=\s*False", "verify=True"),
    ("LS-PY-DEBUG", r"debug\s*=\s*True", "debug=False"),
    ("LS-PY-TEMPFILE", r"\btempfile\.mktemp\(", "tempfile.mkstemp("),
    ("LS-PY-CONTEXT", r"\bssl\._create_unverified_context\(", "ssl.create_default_context("),
    ("LS-GO-VERIFY", r"InsecureSkipVerify:\s*true", "InsecureSkipVerify: false"),
    ("LS-GO-HASH", r"\b(?:md5|sha1)\.New\(\)", "sha256.New()"),
    ("LS-JS-HTML", r"\.innerHTML\s*=(?!=)", ".textContent ="),
    ("LS-JS-TLS", r"rejectUnauthorized:\s*false", "rejectUnauthorized: true"),
    ("LS-JS-COOKIE", r"httpOnly:\s*false", "httpOnly: true"),
    ("LS-JAVA-HASH", r'MessageDigest\.getInstance\("(?:MD5|SHA-?1)"\)', 'MessageDigest.getInstance("SHA-256")'),
    ("LS-JAVA-RANDOM", r"\bnew Random\(\)", "new SecureRandom()"),
    ("LS-RB-YAML", r"\bYAML\.load\(", "YAML.safe_load("),
    ("LS-PHP-HASH", r"\bmd5\(", "hash('sha256', "),
    ("LS-ANY-LOG", r"\blog\.debug\(", "log.trace("),
    ("LS-ANY-TRIM", r"\.trim\(\)", ".strip()"),
    ("LS-ANY-HTTP", r"\bhttp://", "https://"),
    ("LS-DOCKER-USER", r"^USER root\s*$", "USER app"),
)


def proposed_fixes(findings: DataFrame, line: str = "line", fixes: tuple = FIXES) -> DataFrame:
    """Adds fixed_line where a fix is bound to the rule and changes the line; dependency findings with a fixed version get an upgrade text."""
    new = F.lit(None).cast("string")
    for rule, pattern, replacement in fixes:
        new = F.when(F.col("rule_id") == rule, F.regexp_replace(line, pattern, replacement)).otherwise(new)
    return findings.withColumn("fixed_line", F.when(new != F.col(line), new))


def with_suppression(content: Column, line_no: int, rule_id: str, word: str = "scan-ignore", mark: str = "#") -> Column:
    """The content with a directive at the end of a line."""
    parts = F.split(content, "\n")
    return F.array_join(F.transform(parts, lambda x, i: F.when(i == line_no - 1, F.concat(x, F.lit(f"  {mark} {word}: {rule_id}"))).otherwise(x)), "\n")
