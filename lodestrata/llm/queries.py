"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.components import groups_by_shared_keys
from lodestrata.llm.identifiers import identifiers
from lodestrata.llm.leakage import leaked_items
from lodestrata.llm.packing import pack
from lodestrata.llm.pii import find_pii, redact_pii
from lodestrata.llm.secrets import find_secrets, mask_secrets
from lodestrata.llm.survivorship import survivors
from lodestrata.llm.tokens import token_count
from lodestrata.session import table

CAPACITY = 2048


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_id, id) of advisories that share an identifier, directly or through further rows."""
    rows = table(spark, sf_dir, "vulnerabilities").select("id", F.concat_ws("|", F.col("vuln_id"), F.concat_ws("|", "aliases")).alias("_text"))
    return groups_by_shared_keys(rows, "id", identifiers(F.col("_text")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_id, field_name, winner_id) of each issue that is reported more than once."""
    return survivors(table(spark, sf_dir, "findings"), table(spark, sf_dir, "analyzers"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(finding_id, start_pos, n_chars) of each literal secret in a code snippet."""
    return find_secrets(table(spark, sf_dir, "raw_findings"), "finding_id", "code").select("finding_id", "start_pos", "n_chars")


def p5_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(finding_id, code): the snippets with their secrets masked."""
    return table(spark, sf_dir, "raw_findings").select("finding_id", mask_secrets(F.col("code")).alias("code"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, piece_no, n_tokens, container_id): every non-blank text, in tokens, in a container of 2,048."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"[^\s\p{Z}]")).select("doc_id", token_count(F.col("text")).alias("n_tokens"))
    return pack(docs, "doc_id", "n_tokens", CAPACITY).withColumnRenamed("piece_size", "n_tokens")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) of documents that hold an evaluation passage or a third of it."""
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pii_kind, start_pos, n_chars) of names, mail addresses, phone and identity numbers and street addresses."""
    return find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): the texts with typed placeholders."""
    return table(spark, sf_dir, "documents").select("doc_id", redact_pii(F.col("text")).alias("text"))


#: None has SQL: clean-up of spellings, closures, grammars, tokenizers and models are tested against brute force, round trips and held-out rows.
QUERIES = {f.__name__: (f, None) for f in (p1_found, p4_found, p5_found, p5_masked, p6_containers, p7_found, p8_found, p8_redacted)}
