"""Severity of vulnerabilities: partial vectors from labels, score lookup, and medians of matching full vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexarium.functions.cvss import matches, partial_vector, severity_class


def vectors(labels: DataFrame) -> DataFrame:
    """(cve_id, vector) with the vector as joined text."""
    return labels.groupBy("cve_id").agg(F.array_join(partial_vector(F.collect_set("label")), ",").alias("vector"))


def lookup(vectors_: DataFrame, scores: DataFrame) -> DataFrame:
    """`vectors_` with score (-1 where the map has none) and severity. scores (vector, score) has a row for each partial vector."""
    j = vectors_.join(F.broadcast(scores), "vector", "left").withColumn("score", F.coalesce("score", F.lit(-1.0)))
    return j.withColumn("severity", F.when(F.col("score") < 0, "n/a").otherwise(severity_class("score")))


def match_median(partials: DataFrame, dataset: DataFrame) -> DataFrame:
    """(vector, median_score, n): over the dataset's (full, score) that fit each partial vector; -1 without any.

    Both sides are reduced to distinct vectors first, the only place where a theta join is needed: the number of possible vectors
    is bounded by their alphabet, whatever the number of rows."""
    a = F.broadcast(partials.select("vector").distinct())
    d = dataset.select("full").distinct()
    hit = d.join(a, matches(F.split(a["vector"], ","), F.split(d["full"], ",")))
    scored = dataset.join(hit, "full").groupBy("vector").agg(F.round(F.median("score"), 4).alias("median_score"), F.count("*").alias("n"))
    return a.join(scored, "vector", "left").select("vector", F.coalesce("median_score", F.lit(-1.0)).alias("median_score"), F.coalesce("n", F.lit(0)).alias("n"))
