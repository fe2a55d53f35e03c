"""Label classification by information divergence between word histograms, and selection among scored labels.

Histograms are long tables (id, term, cnt). All labels are compared in one pass: the model has a row for each term with the counts of all
labels side by side, joined to the instances on the term, and a document's sums for all labels come from one aggregate."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(rows: DataFrame, key: str, term: str = "term", value: str | None = None) -> DataFrame:
    """(key, term, cnt): counts, or sums of the whole part of `value`, of the terms of each key."""
    n = F.count("*") if value is None else F.sum(F.col(value).cast("int"))
    return rows.groupBy(key, term).agg(n.cast("bigint").alias("cnt")).filter("cnt <> 0")


def entropy(h: DataFrame, key: str) -> DataFrame:
    """(key, total, entropy): normalised by the log of the total; 0 where the total is 1."""
    t = h.withColumn("_t", F.sum("cnt").over(Window.partitionBy(key)))
    p = F.col("cnt") / F.col("_t")
    return t.groupBy(key).agg(F.first("_t").alias("total"), F.when(F.first("_t") > 1, -F.sum(p * F.log(p)) / F.log(F.first("_t"))).otherwise(0.0).alias("entropy"))


def label_totals(model: DataFrame) -> list[tuple[str, float, float]]:
    """(label, total, entropy) of a model, on the driver: as many rows as labels, from one aggregate that is combined before its shuffle."""
    c = F.col("cnt")
    rows = model.groupBy("label").agg(F.sum(c).alias("t"), F.sum(c * F.log(c)).alias("s")).orderBy("label").collect()
    return [(r["label"], float(r["t"]), (math.log(r["t"]) - r["s"] / r["t"]) / math.log(r["t"]) if r["t"] > 1 else 0.0) for r in rows]


#: Terms of a model, the most frequent ones, that are sent to every executor; the others are joined by shuffle.
FREQUENT = 200_000
#: Characters of text in a partition of documents' histograms, so that it is counted in memory.
PARTITION_CHARS = 8_000_000


def document_histogram(docs: DataFrame, split: Callable[[Column], Column]) -> DataFrame:
    """(doc, term, cnt, ti) of texts (doc, text): counts of each document's terms beside their total. Texts are shuffled by document, terms are not."""
    parts = 1 + (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // PARTITION_CHARS
    t = docs.select("doc", "text").filter("text is not null").repartition(parts, "doc")
    t = t.withColumn("ti", F.sum(F.size(split(F.col("text")))).over(Window.partitionBy("doc")))
    return t.select("doc", "ti", F.explode(split(F.col("text"))).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("cnt"), F.max("ti").alias("ti"))


def _compared(inst: DataFrame, model: DataFrame, name: str, each: Callable[[Column, Column, float, float], Column], whole: Callable[[Column, Column, Column, float], Column], frequent: int | None = None) -> DataFrame:
    """(doc, label, name): for each label `whole` of the sum over a document's terms of `each`, which takes the instance's share p, the model's share q,
    and the label's total and entropy; `whole` takes that sum, the instance's total, its sum of cnt ln cnt, and the label's total.

    Frequent terms are looked up and summed where a document's terms lie, one row a document. Only the others meet the model by shuffle."""
    model = model.persist(StorageLevel.DISK_ONLY)
    labels = label_totals(model)
    if not labels:
        return inst.select("doc", F.lit("").alias("label"), F.lit(0.0).alias(name)).filter(F.lit(False))
    ms = [f"m{i}" for i in range(len(labels))]
    side = model.groupBy("term").agg(*[F.coalesce(F.sum(F.when(F.col("label") == x, F.col("cnt"))), F.lit(0)).alias(m) for m, (x, _, _) in zip(ms, labels)], F.sum("cnt").alias("n"))
    most = FREQUENT if frequent is None else frequent
    least = side.select("n").orderBy(F.desc("n")).offset(most).limit(1).first()
    least = 0 if least is None else least["n"]
    if "ti" not in inst.columns:
        inst = inst.withColumn("ti", F.sum("cnt").over(Window.partitionBy("doc")))
    p = F.col("cnt") / F.col("ti")
    terms = lambda: [each(p, F.coalesce(F.col(m), F.lit(0)) / t, t, h) for m, (_, t, h) in zip(ms, labels)]
    c = F.col("cnt")
    x = inst.select("doc", "term", "cnt", "ti").join(F.broadcast(side.filter(F.col("n") > least).select("term", *ms, F.lit(True).alias("_hit"))), "term", "left")
    # A document's hits are one row with a salt that no term of the model has.
    hit = F.coalesce("_hit", F.lit(False))
    x = x.select("doc", "ti", "cnt", (c * F.log(c)).alias("_cc"), hit.alias("_hit"), *[F.when(hit, v).otherwise(0.0).alias(f"s{i}") for i, v in enumerate(terms())], F.when(hit, "").otherwise(F.col("term")).alias("_term"), F.when(hit, 1 + F.pmod(F.xxhash64("doc"), F.lit(1 << 20))).otherwise(F.lit(0)).alias("_salt"))
    x = x.groupBy("doc", "_term", "_salt").agg(F.max("ti").alias("ti"), F.sum("cnt").alias("cnt"), F.sum("_cc").alias("_cc"), F.max("_hit").alias("_hit"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(labels))])
    rare = side.filter(F.col("n") <= least).select(F.col("term").alias("_term"), F.lit(0).cast("bigint").alias("_salt"), *ms)
    x = x.join(rare, ["_term", "_salt"], "left")
    x = x.groupBy("doc").agg(F.max("ti").alias("ti"), F.sum("_cc").alias("_cc"), *[F.sum(F.when(F.col("_hit"), F.col(f"s{i}")).otherwise(v)).alias(f"s{i}") for i, v in enumerate(terms())])
    out = [F.struct(F.lit(n).alias("label"), whole(F.col(f"s{i}"), F.col("ti"), F.col("_cc"), t).alias(name)) for i, (n, t, _) in enumerate(labels)]
    return x.select("doc", F.explode(F.array(*out)).alias("x")).select("doc", "x.label", f"x.{name}")


def _smooth(q: Column, h: float, base: int | Column) -> Column:
    return q * (1 - h) + F.lit(h) / base


def cross_entropy(inst: DataFrame, model: DataFrame, base: int | Column, frequent: int | None = None) -> DataFrame:
    """(doc, label, cross_entropy) with smoothed model shares; `base` is the number of features."""
    return _compared(inst, model, "cross_entropy", lambda p, q, tm, h: p * F.log(_smooth(q, h, base)), lambda s, ti, cc, tm: -s, frequent)


def kl_divergence(inst: DataFrame, model: DataFrame, base: int | Column, frequent: int | None = None) -> DataFrame:
    """(doc, label, kl): cross entropy less the instance's entropy under the combined count."""

    def whole(s: Column, ti: Column, cc: Column, tm: float) -> Column:
        both = ti + tm
        return -s + (cc - ti * F.log(both)) / both / F.log(both)

    return _compared(inst, model, "kl", lambda p, q, tm, h: p * F.log(_smooth(q, h, base)), whole, frequent)


def js_divergence(inst: DataFrame, model: DataFrame, base: int | Column, frequent: int | None = None) -> DataFrame:
    """(doc, label, js) in bits; only the instance's half is smoothed.

    Of the model's half, a term that the instance lacks adds its share times log2(2), so that part is the share not joined."""

    def each(p: Column, q: Column, tm: float, h: float) -> Column:
        shared = F.when(q > 0, q * F.log2(q / (0.5 * (p + q)))).otherwise(0.0)
        return shared - q + p * F.log2(p / (0.5 * (p + _smooth(q, h, base))))

    return _compared(inst, model, "js", each, lambda s, ti, cc, tm: 0.5 * (1 + s), frequent)


def confidences(scores: DataFrame, value: str) -> DataFrame:
    """(doc, label, confidence): (max + min/100 - d) over its sum, to three digits; of equal divergences the last label stays.

    A document with one label has confidence 1."""
    d = scores.groupBy("doc", value).agg(F.max("label").alias("label"))
    w = Window.partitionBy("doc")
    x = F.max(value).over(w) + F.min(value).over(w) / 100 - F.col(value)
    y = d.withColumn("_x", x).withColumn("_n", F.count("*").over(w))
    return y.select("doc", "label", F.when(F.col("_n") == 1, 1.0).otherwise(F.round(F.col("_x") / F.sum("_x").over(w), 3)).alias("confidence"))


def until_threshold(scores: DataFrame, p: str, threshold: float = 0.6, order: str = "label") -> DataFrame:
    """Labels by falling probability until their sum reaches the threshold; ties by label."""
    w = Window.partitionBy("doc").orderBy(F.desc(p), order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return scores.withColumn("_c", F.sum(p).over(w)).filter(F.round(F.col("_c") - F.col(p), 9) < threshold).drop("_c")


def close_call(scores: DataFrame, c: str = "confidence", percent: int = 20) -> DataFrame:
    """(doc, first, second, close): the two best labels, and whether they are less than `percent` apart."""
    w = Window.partitionBy("doc").orderBy(F.desc(c), "label")
    x = scores.withColumn("_r", F.row_number().over(w)).filter("_r <= 2").groupBy("doc").agg(F.max(F.when(F.col("_r") == 1, F.struct("label", c))).alias("a"), F.max(F.when(F.col("_r") == 2, F.struct("label", c))).alias("b"))
    gap = F.floor(100 * F.abs(F.col("a")[c] - F.col("b")[c]) / F.col("b")[c])
    return x.select("doc", F.col("a")["label"].alias("first"), F.col("b")["label"].alias("second"), F.coalesce((F.col("b")[c] > 0) & (gap < percent), F.lit(False)).alias("close"))
