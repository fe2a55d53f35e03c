"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vexarium.llm import decontam, exactdedup, htmltext, lmscore, mixing, neardup, pii, secretscan, tokenout, toxicity
from vexarium.llm.common import shared_dir, table


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings in all versions, over a ledger of this run's own in the shared folder: the rules that were known first are scanned and
    recorded, then all the rules, of which the ledger leaves the new ones to scan."""
    versions, ledger = table(spark, sf_dir, "documents"), secretscan.Ledger(spark, os.path.join(shared_dir(spark), f"vexarium-ledger-{uuid.uuid4().hex}"))
    secretscan.record(versions, ledger, secretscan.RULES[: secretscan.FIRST])
    return secretscan.scan_versions(versions, ledger)


def op5_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenout.token_blocks(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(table(spark, sf_dir, "documents"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.lm_scores(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_decontaminate, op3_toxicity, op4_secrets, op5_token_blocks, op6_mixing, op7_html, op8_exact_dedup, op9_near_dedup, op10_lm_score)}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": decontam.ORACLE, "op8_exact_dedup": exactdedup.ORACLE}
