"""Best representative of each duplicate group, field by field.

Method: one aggregation takes, for each attribute, the maximum of a composite struct (non-null,
ranks..., value), so a group's winner of every field comes out of the same pass. Reports are first
folded by their exact place (file, rule, line), with map-side partial aggregation, so a hot issue is
never gathered in a task; only distinct lines of a file and rule are then put in order.

Defined results: rows without file, rule or line belong to no group; groups of one are left out;
equal reports are told apart by the smaller id; a field that no member fills has no row; an
empty table gives an empty result. Extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.text import normalize_path

#: Texts that stand for a missing value, in lower case.
STAND_INS = ("", "-", "--", "?", "n/a", "na", "none", "null", "nil", "unknown", "tbd", "n.a.", "not available")


def filled(value: Column) -> Column:
    return F.coalesce(~F.lower(F.trim(F.regexp_replace(value, r"\s+", " "))).isin(*STAND_INS), F.lit(False))


def repository_path(path: Column) -> Column:
    """The path from the repository directory on (its name ends in seven digits), in lower case, with forward slashes and without empty, ``.`` and ``..`` steps; null if there is none."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(path)), r"\\", "/"), r"/(?:\.?/)+", "/")
    folded = F.when(plain.rlike(r"/\.{1,2}(?:/|$)"), normalize_path(plain)).otherwise(plain)
    out = F.regexp_extract(folded, r"(?:^|/)([^/]*(?<![0-9])[0-9]{7}/.*)$", 1)
    return F.when(out != "", out)


def normalised_rule(rule: Column) -> Column:
    """Upper case without the TS- prefix and the -IP suffix; null for missing ones."""
    out = F.regexp_replace(F.upper(F.trim(rule)), r"^TS-|-IP$", "")
    return F.when(filled(rule) & (out != ""), out)


def confidence_rank(confidence: Column) -> Column:
    c = F.lower(F.trim(confidence))
    return F.when(c.isin("high", "hi", "h"), 3).when(c.isin("medium", "med", "mid", "m"), 2).when(c.isin("low", "lo", "l"), 1).otherwise(0)


def analyzer_key(analyzer: Column) -> Column:
    """An analyzer's name without letter case, separators and version marks."""
    bare = F.regexp_replace(F.lower(F.trim(analyzer)), r"(?:[\s/@:_\-]*\bv?[0-9]+(?:\.[0-9]+)+.*|[/@:].*|[\s_\-]+v[0-9]+)$", "")
    return F.regexp_replace(bare, r"[^\p{L}\p{N}]", "")


def survivors(findings: DataFrame, trust: DataFrame, fields: tuple[str, ...] = ("cwe_id", "recommendation"), gap: int = 5, max_trust_rows: int = 10_000) -> DataFrame:
    """(group_id, field_name, winner_id), field_name ``record`` for the surviving report and each of fields for the report that fills it."""
    dim = trust.select(analyzer_key(F.col("analyzer")).alias("_a"), F.col("trust").alias("_t")).where("_a is not null").groupBy("_a").agg(F.max("_t").alias("_t"))
    dim = F.broadcast(dim) if dim.limit(max_trust_rows + 1).count() <= max_trust_rows else dim
    rows = findings.select(
        F.col("id"),
        repository_path(F.col("file_path")).alias("_file"),
        normalised_rule(F.col("rule_id")).alias("_rule"),
        F.col("line_start").alias("_line"),
        confidence_rank(F.col("confidence")).alias("_c"),
        analyzer_key(F.col("analyzer")).alias("_a"),
        F.col("detected_at").alias("_at"),
        *[filled(F.col(f)).alias(f"_has_{f}") for f in fields],
    ).where("_file is not null and _rule is not null and _line is not null and id is not null")
    # ordered so that min() over the struct is the best member: every rank is negated, a missing time last
    rank = F.struct((-F.col("_c")).alias("c"), (-F.coalesce("_t", F.lit(0))).alias("t"), F.col("_at").isNull().alias("n"), (-F.coalesce(F.unix_micros("_at"), F.lit(0))).alias("at"), F.col("id"))
    rows = rows.join(dim, "_a", "left").select("id", "_file", "_rule", "_line", rank.alias("_rank"), *[f"_has_{f}" for f in fields])
    best = {"record": F.lit(True), **{f: F.col(f"_has_{f}") for f in fields}}
    places = rows.groupBy("_file", "_rule", "_line").agg(
        F.count(F.lit(1)).alias("_n"), F.min("id").alias("_least"), *[F.min(F.when(has, F.col("_rank"))).alias(f"_best_{f}") for f, has in best.items()]
    )
    place = W.partitionBy("_file", "_rule").orderBy("_line")
    opens = F.coalesce((F.col("_line") - F.lag("_line").over(place) > gap).cast("int"), F.lit(0))
    islands = places.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(place.rowsBetween(W.unboundedPreceding, 0)))
    groups = (
        islands.groupBy("_file", "_rule", "_island")
        .agg(F.sum("_n").alias("_n"), F.min("_least").alias("group_id"), *[F.min(f"_best_{f}").alias(f"_best_{f}") for f in best])
        .where("_n > 1")
    )
    out = groups.select("group_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"_best_{f}.id").alias("winner_id")) for f in best])).alias("_w"))
    return out.select("group_id", "_w.field_name", "_w.winner_id").where("winner_id is not null")
