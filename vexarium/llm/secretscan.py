"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed by the SHA-256 of its text, its blob. The ledger says which (blob, rule, rule
version) have been scanned; it lies in the shared folder as appended Parquet. A scan reads the texts of one representative of each
blob with unseen pairs, applies the unseen rules only, appends findings and ledger rows, and joins the findings back to all
paths that hold the blob. A changed rule gets a new version and is run again; a blob that reappears under another path isn't.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexarium.llm.common import materialise, rows_within


@dataclass(frozen=True)
class Rule:
    """`literal` must occur in the text (in lower case if `fold`) before the pattern is tried; group 1 is the secret."""

    rule_id: str
    version: int
    literal: tuple[str, ...]
    pattern: str
    fold: bool = False
    min_entropy: float = 0.0


RULES = (
    Rule("aws_access_key", 1, ("AKIA", "ASIA"), r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[A-Za-z0-9]{16})(?![A-Za-z0-9])"),
    Rule("github_token", 1, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"), r"(?<![A-Za-z0-9_])(gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{50,})"),
    Rule("slack_token", 1, ("xox",), r"(?<![A-Za-z0-9])(xox[abprs]-[A-Za-z0-9-]{10,})"),
    Rule("google_api_key", 1, ("AIza",), r"(?<![A-Za-z0-9_-])(AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9_-])"),
    Rule("private_key", 1, ("-----BEGIN",), r"(-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----)"),
    Rule("jwt", 1, ("eyJ",), r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"),
    Rule("token_assignment", 1, ("token", "secret", "api_key", "apikey", "api-key"), r"(?i)(?<![a-z0-9])(?:token|secret|api[_-]?key)[\"']? ?[:=] ?[\"']?([A-Za-z0-9+/_=-]{16,})", True, 3.0),
    Rule("password_assignment", 1, ("password", "passwd", "pwd"), r"(?i)(?<![a-z0-9])(?:password|passwd|pwd)[\"']? ?[:=] ?[\"']?([^\s\"']{6,})", True),
)
#: So many of the rules were known first; the registered query records them before it scans by all.
FIRST = 6


def entropy(s: str) -> float:
    """Shannon entropy in bits a character."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def scan_text(text: str, rules: list[Rule]) -> list[tuple[str, int, int, int, str]]:
    """(rule_id, version, start, end, digest of the secret) for each finding."""
    out, folded = [], None
    for r in rules:
        if r.fold:
            folded = text.lower() if folded is None else folded
        if any(x in (folded if r.fold else text) for x in r.literal):
            for m in re.compile(r.pattern).finditer(text):
                if r.min_entropy <= 0 or entropy(m.group(1)) >= r.min_entropy:
                    out.append((r.rule_id, r.version, m.start(1), m.end(1), hashlib.sha256(m.group(1).encode("utf-8", "replace")).hexdigest()[:16]))
    return out


FINDING = "blob_id string, rule_id string, rule_version int, start int, end int, secret_digest string"
LEDGER = "blob_id string, rule_id string, rule_version int"


class Ledger:
    """The scanned pairs and the findings, as two appended Parquet folders under `path`. A missing folder is an empty table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str, schema: str) -> DataFrame:
        at = os.path.join(self.path, name)
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        if hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.read.schema(schema).parquet(at)
        return self.spark.createDataFrame([], T._parse_datatype_string(schema))

    def scanned(self) -> DataFrame:
        return self._read("scanned", LEDGER).distinct()

    def findings(self) -> DataFrame:
        """Distinct, so a scan that was repeated after a failure between the two appends does no harm."""
        return self._read("findings", FINDING).distinct()

    def append(self, findings: DataFrame, scanned: DataFrame) -> None:
        """Findings first: a pair counts as scanned only once its findings are there."""
        findings.write.mode("append").parquet(os.path.join(self.path, "findings"))
        scanned.write.mode("append").parquet(os.path.join(self.path, "scanned"))


def _named(versions: DataFrame, id_col: str, path_col: str, text_col: str) -> DataFrame:
    return versions.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text")).filter("text is not null")


def _scan(named: DataFrame, blobs: DataFrame, ledger: Ledger | None, rules: tuple[Rule, ...]) -> tuple[DataFrame, DataFrame]:
    """The findings of the unseen pairs of the blobs, and those pairs as (blob_id, rule_id, rule_version); both are tables."""
    spark = named.sparkSession
    current = spark.createDataFrame([(r.rule_id, r.version) for r in rules], "rule_id string, rule_version int")
    everything = sorted(r.rule_id for r in rules)
    # The head of a blob is its least id; only the head's text is scanned.
    heads = blobs.groupBy("blob_id").agg(F.min("doc_id").alias("head"))
    if ledger is None:
        todo = heads.withColumn("todo", F.array(*map(F.lit, everything)))
    else:
        # One row for each blob on both sides: what is seen is folded to an array of rules first.
        seen = ledger.scanned().join(F.broadcast(current), ["rule_id", "rule_version"], "left_semi").groupBy("blob_id").agg(F.collect_set("rule_id").alias("seen"))
        left = F.array_except(F.array(*map(F.lit, everything)), F.coalesce("seen", F.array().cast("array<string>")))
        todo = heads.join(seen, "blob_id", "left").select("blob_id", "head", F.sort_array(left).alias("todo")).filter("size(todo) > 0")
    todo = materialise(todo, "blob-todo")

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = {r.rule_id: r for r in rules}
        for pdf in batches:
            rows = [(b, *x) for b, t, todo in zip(pdf["blob_id"], pdf["text"], pdf["todo"]) for x in scan_text(t, [by[k] for k in todo])]
            yield pd.DataFrame(rows, columns=["blob_id", "rule_id", "rule_version", "start", "end", "secret_digest"])

    texts = named.withColumn("blob_id", F.sha2("text", 256))
    if rows_within(todo, 400):  # little is unseen
        source = texts.join(F.broadcast(todo), "blob_id").filter(F.col("doc_id").eqNullSafe(F.col("head")))
    else:
        skip = materialise(blobs.join(todo, "blob_id", "left").filter("todo is null OR doc_id <> head").select("doc_id", "blob_id").distinct(), "blob-skip")
        sets = todo.select("todo").distinct().limit(2).collect()
        if len(sets) == 1 and rows_within(skip, 120):  # nearly every blob is unseen, by the same rules
            source = texts.join(F.broadcast(skip), ["doc_id", "blob_id"], "left_anti").withColumn("todo", F.array(*map(F.lit, sets[0]["todo"])))
        else:
            source = texts.join(todo.hint("shuffle_hash"), "blob_id").filter(F.col("doc_id").eqNullSafe(F.col("head")))
    fresh = materialise(source.select("blob_id", "todo", "text").mapInPandas(f, FINDING).distinct(), "blob-findings")
    return fresh, todo.select("blob_id", F.explode("todo").alias("rule_id")).join(F.broadcast(current), "rule_id").select("blob_id", "rule_id", "rule_version")


def record(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", path_col: str = "source", text_col: str = "text") -> None:
    """Scan what the ledger hasn't seen of `versions` and append it; the rows of scan_versions hold here too."""
    named = _named(versions, id_col, path_col, text_col)
    blobs = materialise(named.select("doc_id", "path", F.sha2("text", 256).alias("blob_id")), "blob-paths")
    ledger.append(*_scan(named, blobs, ledger, rules))


def scan_versions(versions: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", path_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, path, blob_id, rule_id, rule_version, start, end, secret_digest) for every version that holds a finding.

    Null texts have no blob; empty texts have one, without findings. Repeated rows give repeated rows. Null ids and paths are
    carried along. Extra columns aren't read. An empty table gives an empty result. Offsets are in characters; texts are scanned
    whole. Without a ledger everything is unseen; with one, unseen pairs are scanned and appended, and known findings are joined."""
    named = _named(versions, id_col, path_col, text_col)
    blobs = materialise(named.select("doc_id", "path", F.sha2("text", 256).alias("blob_id")), "blob-paths")
    fresh, pairs = _scan(named, blobs, ledger, rules)
    if ledger is not None:
        ledger.append(fresh, pairs)
        current = versions.sparkSession.createDataFrame([(r.rule_id, r.version) for r in rules], "rule_id string, rule_version int")
        fresh = ledger.findings().join(F.broadcast(current), ["rule_id", "rule_version"], "left_semi")
    return blobs.join(fresh, "blob_id").select("doc_id", "path", "blob_id", "rule_id", "rule_version", "start", "end", "secret_digest")
