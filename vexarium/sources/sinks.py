"""Sinks: appends of accepted rows, grouped JSON, tab-separated text, queue messages. Writes are committed by task, and keyed writes can be repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vexarium.functions import cpe
from vexarium.functions.text import tsv_safe


def append_accepted(incoming: DataFrame, existing: DataFrame, key: list[str], path: str) -> None:
    """Append the rows whose key isn't there yet."""
    incoming.dropDuplicates(key).join(existing.select(*key), key, "left_anti").write.mode("append").parquet(path)


def snapshot(df: DataFrame, path: str) -> None:
    """Replace a table by its new image."""
    df.write.mode("overwrite").parquet(path)


def tables(frames: dict[str, DataFrame], folder: str) -> None:
    for name, df in frames.items():
        df.write.mode("append").parquet(f"{folder}/{name}")


def valid_products(products: DataFrame) -> DataFrame:
    return products.filter(cpe.is_cpe("cpe"))


def crawl_tsv(raw: DataFrame, path: str) -> None:
    raw.select(*[tsv_safe(F.col(c).cast("string")).alias(c) for c in raw.columns]).write.mode("overwrite").csv(path, sep="\t", quote="")


def grouped_json(raw: DataFrame, path: str | None = None) -> DataFrame:
    """(value): a JSON object for each id with its raw rows in the order of their ids."""
    rest = [c for c in raw.columns if c != "cve_id"]
    g = raw.groupBy("cve_id").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("rows"))
    out = g.select(F.to_json(F.create_map("cve_id", "rows")).alias("value"))
    if path:
        out.write.mode("overwrite").text(path)
    return out


def version_messages(versions: DataFrame) -> DataFrame:
    """(value): a queue message for each new or updated version."""
    return versions.filter(F.col("status").isin("NEW", "UPDATED")).select(F.to_json(F.struct(F.col("vuln_version_id").alias("vulnVersionId"))).alias("value"))


def id_messages(ids: DataFrame, per_message: int = 1000) -> DataFrame:
    """(value): JSON arrays of ids; the ids of a message share a hash, so messages stay small however many ids there are."""
    n = ids.select("cve_id").distinct()
    bucket: Column = F.pmod(F.xxhash64("cve_id"), F.lit(max(1, per_message)))
    return n.groupBy(bucket.alias("b")).agg(F.to_json(F.array_sort(F.collect_list("cve_id"))).alias("value")).select("value")


def product_dictionary(entries: DataFrame, path: str, computed: str, parts: int = 8) -> None:
    """Dictionary files of (group_id, vendor, product_name, common_title, version, title, update, cpe, platform), in `parts` shares of the groups."""
    v = F.struct("title", "version", "update", F.col("cpe").alias("cpeID"), "platform")
    g = entries.groupBy("group_id", "vendor", "product_name", "common_title").agg(F.map_from_entries(F.collect_list(F.struct("version", v))).alias("versions"))
    entry = F.struct("vendor", F.col("product_name").alias("product"), F.col("group_id").alias("groupID"), F.col("common_title").alias("commonTitle"), "versions")
    documents(g.select("group_id", entry.alias("e")), path, parts, "group_id", lambda: F.struct(F.lit(computed).alias("compTime"), F.lit(computed).alias("refreshTime"), F.map_from_entries(F.collect_list(F.struct("group_id", "e"))).alias("products")))


#: Bytes of JSON that a document holds on average, whatever the number of rows.
DOCUMENT_BYTES = 8 << 20


def documents(rows: DataFrame, path: str, parts: int, key: str, whole: Callable[[], Column], most: int = DOCUMENT_BYTES) -> None:
    """One JSON document a file, of shares of the rows by a hash of `key`; `whole` folds a share into its document.

    There are `parts` shares, or as many as keep a share at `most` bytes on average: the rows are measured first, so no task that writes or reads a
    document holds more of a larger table."""
    size = rows.agg(F.sum(F.octet_length(F.to_json(F.struct(*rows.columns))))).first()[0] or 0
    parts = max(parts, -(-size // most))
    share = F.pmod(F.xxhash64(key), F.lit(parts)).alias("share")
    x = rows.select("*", share).repartition(parts, "share")
    x.groupBy("share").agg(F.to_json(whole()).alias("value")).write.mode("overwrite").partitionBy("share").text(path)


def arff(features: DataFrame, path: str, relation: str = "features") -> None:
    """(doc_id, label, terms map of counts) as a sparse ARFF matrix: the header in `path`/header, the rows in `path`/data.

    Attributes are numbered by their order; their list, which the format puts before the rows, is a sorted table and not one of the driver's."""
    names = features.select(F.explode(F.map_keys("terms")).alias("term")).distinct()
    numbered = names.select("term", F.row_number().over(Window.orderBy("term")).alias("k"))
    labels = features.groupBy().agg(F.array_sort(F.collect_set("label")).alias("x")).select(F.concat(F.lit("@attribute Label {"), F.array_join("x", ","), F.lit("}")).alias("value"), F.lit(0).alias("k"))
    head = labels.unionByName(numbered.select(F.concat(F.lit("@attribute "), "term", F.lit(" numeric")).alias("value"), "k")).unionByName(features.sparkSession.range(1).select(F.lit(f"@relation {relation}").alias("value"), F.lit(-1).alias("k")))
    head.orderBy("k").select("value").write.mode("overwrite").text(f"{path}/header")
    cells = features.select("doc_id", "label", F.explode("terms").alias("term", "n")).join(numbered, "term")
    sparse = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "n"))), lambda c: F.concat_ws(" ", c["k"].cast("string"), c["n"].cast("string"))), ",")
    cells.groupBy("doc_id", "label").agg(sparse.alias("s")).select(F.concat(F.lit("{0 "), "label", F.lit(","), "s", F.lit("}")).alias("value")).write.mode("overwrite").text(f"{path}/data")
