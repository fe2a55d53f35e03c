"""Quality filters of raw descriptions: predicates, their state machine, equivalence classes and the two waves."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vexarium.functions.text import jtrim
from vexarium.schema import FAILED, HIGH_PRIORITY, NEW, PASSED, UNEVALUATED

_ID = r"CVE-\d{4}-\d{4,5}"
_GHSA = r"GHSA-\w{4}-\w{4}-\w{4}"
MULTI_CVE = rf"^(?:{_ID}, {_GHSA}|{_ID}, (?:{_GHSA}|{_ID}), and \d more)$"

REMOTE_TOKENS = 4097

#: A filter's name -> predicate that a good row fulfils; all read `raw_description` and `cve_id`.
FILTERS: dict[str, Callable[[], Column]] = {
    "BLANK": lambda: jtrim("raw_description") != "",
    "SELF_ID": lambda: F.col("raw_description") != F.col("cve_id"),
    "INTEGER": lambda: ~F.col("raw_description").rlike(r"^\d+$"),
    "MULTI_CVE": lambda: ~jtrim("raw_description").rlike(MULTI_CVE),
    "SIZE": lambda: F.char_length(jtrim("raw_description")) <= 1000,
    "SIMPLE": lambda: F.lit(True),
    # The verdict of a remote model, joined in as a column by the caller beside the text's number of tokens: too long a text fails, and no verdict passes.
    "REMOTE": lambda: (F.coalesce(F.col("remote_tokens"), F.lit(0)) <= REMOTE_TOKENS) & F.coalesce(F.col("remote_verdict"), F.lit(True)),
}
LOCAL = ("BLANK", "SELF_ID", "INTEGER", "MULTI_CVE", "SIZE")
SCOPES = {"LOCAL": LOCAL, "REMOTE": ("REMOTE",), "ALL": (*LOCAL, "REMOTE")}


def predicate(name: str) -> Column:
    """An unknown name is the pass-through filter."""
    return F.coalesce(FILTERS.get(name, FILTERS["SIMPLE"])(), F.lit(False))


def choose(scope: str, custom: Sequence[str] = ()) -> tuple[str, ...]:
    return tuple(custom) if scope == "CUSTOM" else SCOPES[scope]


def is_high_priority() -> Column:
    return F.col("source_type").isin(*HIGH_PRIORITY)


def is_filtered(status: str = "status") -> Column:
    return F.col(status).isin(PASSED, FAILED)


def next_status(names: Sequence[str]) -> Column:
    """FAILED stays, user sources pass, others pass if they fulfil all filters."""
    good = F.lit(True)
    for n in names:
        good = good & predicate(n)
    return F.when(F.col("status") == FAILED, FAILED).when(F.col("source_type") == "user", PASSED).when(good, PASSED).otherwise(FAILED)


def mark_unevaluated(raw: DataFrame) -> DataFrame:
    return raw.withColumn("status", F.when(F.col("status") == NEW, UNEVALUATED).otherwise(F.col("status")))


def filter_classes(raw: DataFrame, names: Sequence[str] = LOCAL, by_cve: bool = False) -> DataFrame:
    """`raw` with `new_status`: the verdict on one sample of each class of equal trimmed descriptions holds for all of it.

    The sample is the row of the least id. by_cve keeps classes within a vulnerability. A row's verdict needs nothing but the row, so each
    class takes the verdict of its sample by one aggregate, combined before the shuffle; of a blank or template text that a third of the rows
    share, a task sends one row. The verdicts are joined back by the class, a hash, which adaptive execution broadcasts if they are few and
    splits where a class is large."""
    keyed = raw.withColumn("_class", F.sha2(jtrim("raw_description"), 256))
    key = ["_class", "cve_id"] if by_cve else ["_class"]
    verdicts = keyed.groupBy(*key).agg(F.min_by(next_status(names), "raw_description_id").alias("new_status"))
    return keyed.alias("r").join(verdicts.alias("v"), [F.col(f"r.{k}").eqNullSafe(F.col(f"v.{k}")) for k in key], "left").select("r.*", "v.new_status").drop("_class")


def run_counts(filtered: DataFrame) -> DataFrame:
    """How many rows went in, how many distinct descriptions, how many passed."""
    return filtered.agg(F.count("*").alias("num_in"), F.count_distinct(F.sha2(jtrim("raw_description"), 256)).alias("num_distinct"), F.count_if(F.col("new_status") == PASSED).alias("num_passed"))


def first_wave(raw: DataFrame) -> DataFrame:
    return raw.filter(~is_filtered() & is_high_priority())


def second_wave(raw: DataFrame) -> DataFrame:
    """What is left to filter of the vulnerabilities where no high-priority source has passed."""
    passed = F.max((F.col("status") == PASSED) & is_high_priority()).over(Window.partitionBy("cve_id"))
    return raw.withColumn("_any", passed).filter(~F.col("_any") & ~is_filtered()).drop("_any")


def run_waves(raw: DataFrame, names: Sequence[str] = LOCAL) -> DataFrame:
    """`raw` with `status_before`, `wave` (0: not filtered) and the status after both waves; one shuffle by vulnerability."""
    start = mark_unevaluated(raw).withColumn("status_before", F.col("status"))
    todo = ~is_filtered()
    one = start.withColumn("wave", F.when(todo & is_high_priority(), 1).otherwise(0)).withColumn("status", F.when(F.col("wave") == 1, next_status(names)).otherwise(F.col("status")))
    passed = F.max((F.col("status") == PASSED) & is_high_priority()).over(Window.partitionBy("cve_id"))
    two = one.withColumn("_any", passed).withColumn("wave", F.when((F.col("wave") == 0) & todo & ~F.col("_any"), 2).otherwise(F.col("wave")))
    return two.withColumn("status", F.when(F.col("wave") == 2, next_status(names)).otherwise(F.col("status"))).drop("_any")


def to_reconcile(after: DataFrame) -> DataFrame:
    """Rows that passed in this run."""
    return after.filter((F.col("status") == PASSED) & (F.col("status_before") != PASSED))


def distinct_malformed(raw: DataFrame) -> DataFrame:
    """Rows whose id holds a semicolon or a bracket."""
    return raw.filter(F.col("cve_id").contains(";") | F.col("cve_id").contains("("))
