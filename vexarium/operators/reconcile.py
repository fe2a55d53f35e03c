"""Merging competing descriptions, version rows, upserts and the pointers to the current version."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexarium.operators.filters import is_high_priority

_ORDER = ("created_date", "raw_description_id")


def simple_prefers(old: Column, new: Column) -> Column:
    """The simple rule: a strictly longer description wins."""
    return old.isNull() | (F.char_length(new) > F.char_length(old))


def nlp_prefers(old: Column, new: Column) -> Column:
    """The linguistic rule over features (sentences, tags, unknown): two of not fewer sentences, more tags, fewer unknown."""
    wins = (new["sentences"] >= old["sentences"]).cast("int") + (new["tags"] > old["tags"]).cast("int") + (new["unknown"] < old["unknown"]).cast("int")
    return old.isNull() | (wins >= 2)


def reconcile_simple(raw: DataFrame) -> DataFrame:
    """(cve_id, description, n_sources): the fold of the simple rule, which equals the first longest description, by one aggregate."""
    best = F.max_by("raw_description", F.struct(F.char_length("raw_description"), -F.unix_micros(F.col("created_date").cast("timestamp")), -F.col("raw_description_id")))
    return raw.filter("source_type <> 'user'").groupBy("cve_id").agg(best.alias("description"), F.count("*").alias("n_sources"))


def merge_fold(raw: DataFrame, strategy: str = "ONE_BY_ONE") -> DataFrame:
    """(cve_id, description, build) by an ordered fold over (created_date, raw_description_id).

    ONE_BY_ONE nests, ((1,2),3); RESYNTH is flat, (1,2,3). The order is explicit, so the result is the same in every run."""
    item = F.struct(*_ORDER, F.col("raw_description").alias("d"), F.col("raw_description_id").cast("string").alias("i"))
    rows = raw.filter("source_type <> 'user'").groupBy("cve_id").agg(F.sort_array(F.collect_list(item)).alias("xs"))
    first = F.col("xs")[0]
    start = F.struct(first["d"].alias("d"), first["i"].alias("b"))
    if strategy == "ONE_BY_ONE":
        step = lambda acc, x: F.struct(F.when(simple_prefers(acc["d"], x["d"]), x["d"]).otherwise(acc["d"]).alias("d"), F.concat(F.lit("("), acc["b"], F.lit(","), x["i"], F.lit(")")).alias("b"))
        end = lambda acc: acc
    elif strategy == "RESYNTH":
        step = lambda acc, x: F.struct(F.when(simple_prefers(acc["d"], x["d"]), x["d"]).otherwise(acc["d"]).alias("d"), F.concat(acc["b"], F.lit(","), x["i"]).alias("b"))
        end = lambda acc: F.struct(acc["d"].alias("d"), F.when(acc["b"].contains(","), F.concat(F.lit("("), acc["b"], F.lit(")"))).otherwise(acc["b"]).alias("b"))
    else:
        raise ValueError(f"unknown strategy {strategy}")
    folded = rows.select("cve_id", F.aggregate(F.slice("xs", 2, F.greatest(F.size("xs") - 1, F.lit(0))), start, step, end).alias("f"))
    return folded.select("cve_id", F.col("f.d").alias("description"), F.col("f.b").alias("build"))


def bulk_update(existing: DataFrame, new: DataFrame) -> DataFrame:
    """(cve_id, description, build) of existing (cve_id, description, build) after all of `new` at once: (E,4,5)."""
    item = F.struct(*_ORDER, F.col("raw_description").alias("d"), F.col("raw_description_id").cast("string").alias("i"))
    xs = new.groupBy("cve_id").agg(F.sort_array(F.collect_list(item)).alias("xs"))
    step = lambda acc, x: F.struct(F.when(simple_prefers(acc["d"], x["d"]), x["d"]).otherwise(acc["d"]).alias("d"), F.concat(acc["b"], F.lit(","), x["i"]).alias("b"))
    j = existing.join(xs, "cve_id", "left")
    f = F.aggregate("xs", F.struct(F.col("description").alias("d"), F.col("build").alias("b")), step)
    return j.select("cve_id", F.when(F.col("xs").isNull(), F.col("description")).otherwise(f["d"]).alias("description"), F.when(F.col("xs").isNull(), F.col("build")).otherwise(F.concat(F.lit("("), f["b"], F.lit(")"))).alias("build"))


def _canonical(build: str | None) -> str | None:
    """A build string with the children of every node in sorted order."""
    if build is None:
        return None
    stack: list[list[str]] = [[]]
    for t in re.findall(r"[(),]|\d+", build):
        if t == "(":
            stack.append([])
        elif t == ")":
            node = stack.pop()
            stack[-1].append("(" + ",".join(sorted(node)) + ")")
        elif t != ",":
            stack[-1].append(t)
    return ",".join(stack[0])


@F.pandas_udf(T.StringType())
def canonical_build(build: pd.Series) -> pd.Series:
    """Equal for build strings that differ only in the order of sources; a recursive grammar, so it runs in Python."""
    return build.map(_canonical)


def latest_user_edit(raw: DataFrame) -> DataFrame:
    w = Window.partitionBy("cve_id").orderBy(F.desc("created_date"), F.desc("raw_description_id"))
    return raw.filter("source_type = 'user'").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def priority_reset(used: DataFrame, new: DataFrame) -> DataFrame:
    """(cve_id, reset): whether low-priority sources alone are used while new high-priority ones are there."""
    a = used.groupBy("cve_id").agg(F.bool_or(is_high_priority()).alias("old_high"))
    b = new.groupBy("cve_id").agg(F.bool_or(is_high_priority()).alias("new_high"))
    return a.join(b, "cve_id").select("cve_id", (~F.col("old_high") & F.col("new_high")).alias("reset"))


def date_bounds(raw: DataFrame) -> DataFrame:
    """Earliest publication and latest modification by vulnerability; a modification falls back to the creation."""
    return raw.groupBy("cve_id").agg(F.min("published_date").alias("published_date"), F.coalesce(F.max("last_modified_date"), F.min("created_date")).alias("last_modified_date"))


def upsert(old: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    """The table after new (cve_id, status) meets old (cve_id, status, last_modified); `touched` marks inserted and changed rows."""
    j = old.select("cve_id", F.col("status").alias("was"), "last_modified").join(new.select("cve_id", F.col("status").alias("now")), "cve_id", "full_outer")
    inserted = F.col("was").isNull() & F.col("now").isNotNull()
    changed = F.col("now").isNotNull() & (F.col("was") != F.col("now"))
    touched = inserted | F.coalesce(changed, F.lit(False))
    return j.select("cve_id", F.coalesce("now", "was").alias("status"), F.when(touched, as_of).otherwise(F.col("last_modified")).alias("last_modified"), touched.alias("touched"))


def replace_rows(old: DataFrame, new: DataFrame, key: str = "cve_id") -> DataFrame:
    """Delete then insert: the rows of `new`, and those of `old` whose key `new` hasn't."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def previous_version(version: DataFrame) -> DataFrame:
    """The version before the newest of each vulnerability."""
    w = Window.partitionBy("cve_id").orderBy(F.desc("created_date"), F.desc("vuln_version_id"))
    return version.withColumn("_r", F.row_number().over(w)).filter("_r = 2").drop("_r")


def current_pointer(version: DataFrame) -> DataFrame:
    return version.groupBy("cve_id").agg(F.max_by("vuln_version_id", F.struct("created_date", "vuln_version_id")).alias("vuln_version_id"))


def version_write(raw_used: DataFrame, merged: DataFrame, vulnerability: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """The tables that a new version writes: descriptions, bridge, versions, pointers and finished jobs; one plan for all ids."""
    ids = merged.withColumn("description_id", F.xxhash64("cve_id", "build"))
    bounds = date_bounds(raw_used)
    versions = ids.join(bounds, "cve_id").select(F.xxhash64("cve_id", "build", F.lit("v")).alias("vuln_version_id"), "cve_id", "description_id", as_of.alias("created_date"), "published_date", "last_modified_date")
    known = vulnerability.select("cve_id", F.col("created_date").alias("first"))
    pointers = versions.join(known, "cve_id", "left").select("cve_id", F.coalesce("first", "created_date").alias("created_date"), "vuln_version_id")
    return {
        "description": ids.select("description_id", "cve_id", "description", as_of.alias("created_date"), F.col("build").alias("gpt_func"), F.lit(False).alias("is_user_generated")),
        "raw_description_jt": raw_used.join(ids.select("cve_id", "description_id"), "cve_id").select("description_id", "raw_description_id"),
        "vulnerability_version": versions,
        "vulnerability": replace_rows(vulnerability.select("cve_id", "created_date", "vuln_version_id"), pointers),
        "cve_job_done": merged.select("cve_id"),
    }
