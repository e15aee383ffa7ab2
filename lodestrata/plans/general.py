"""Queries of the general training-data operators (timestamps, nested records)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.nested import ADVISORY_PARENTS, advisory_leaves, advisory_parents, shred
from lodestrata.operators.timestamps import normalise_timestamps
from lodestrata.session import table

CANONICAL = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z\z"


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, field_name, utc_us): each timestamp text that isn't already canonical, as one instant."""
    rows = table(spark, sf_dir, "vulnerabilities").select("id", "source_id", *[F.when(~F.col(f).rlike(CANONICAL), F.col(f)).alias(f) for f in ("published_at", "modified_at")])
    out = normalise_timestamps(rows, table(spark, sf_dir, "vulnerability_sources"), "id", "source_id", ["published_at", "modified_at"])
    return out.where(F.col("utc_us").isNotNull()).select("id", "field_name", "utc_us")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, affected_no, leaf_kind, range_no, leaf_no, leaf) of every event bound and version."""
    return advisory_leaves(shred(table(spark, sf_dir, "osv_records"), "record_id", "body"), "record_id")


def p3_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, affected_no) of every affected entry, also of those without any bound or version."""
    nodes = shred(table(spark, sf_dir, "osv_records"), "record_id", "body", (), parents=ADVISORY_PARENTS[:1])
    return advisory_parents(nodes, "record_id").select("record_id", "affected_no")


def p3_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, affected_no, range_no) of every range, also of those without events."""
    nodes = shred(table(spark, sf_dir, "osv_records"), "record_id", "body", (), parents=ADVISORY_PARENTS[1:])
    return advisory_parents(nodes, "record_id")


QUERIES = {f.__name__: (f, None) for f in (p2_found, p3_found, p3_affected, p3_ranges)}
