"""Joins between descriptions, versions, registries, products and exploits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vexarium.functions.dates import hour_gap
from vexarium.functions.text import host


def used_raw_rows(vulnerability: DataFrame, version: DataFrame, bridge: DataFrame, raw: DataFrame) -> DataFrame:
    """Raw rows behind the current version of each vulnerability."""
    current = vulnerability.select("vuln_version_id").join(version.select("vuln_version_id"), "vuln_version_id").withColumnRenamed("vuln_version_id", "description_id")
    return current.join(bridge, "description_id").join(raw, "raw_description_id")


def composite(vulnerability: DataFrame, version: DataFrame) -> DataFrame:
    return vulnerability.select("vuln_id", "vuln_version_id").join(version, "vuln_version_id")


def version_products(product: DataFrame, version: DataFrame) -> DataFrame:
    """Products of each version, by its (id, run)."""
    p = product.withColumnRenamed("cpe_set_run", "run_id").withColumnRenamed("version", "product_version")
    return p.join(version.select("cve_id", "run_id", "vuln_version_id"), ["cve_id", "run_id"])


def nvd_attach(ids: DataFrame, nvd: DataFrame, urls: DataFrame) -> DataFrame:
    """Registry rows of the wanted ids with the list of their sources; one row for each id."""
    u = urls.groupBy("cve_id").agg(F.array_sort(F.collect_set("source_url")).alias("sources"))
    return nvd.join(ids.select("cve_id"), "cve_id", "left_semi").join(u, "cve_id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))


def mitre_attach(ids: DataFrame, mitre: DataFrame) -> DataFrame:
    return mitre.join(ids.select("cve_id"), "cve_id", "left_semi")


def in_nvd() -> Column:
    return F.col("status") == "Analyzed"


def in_mitre() -> Column:
    return F.lower("status") == "public"


def time_gaps(vulnerability: DataFrame, registry: DataFrame, at: str) -> DataFrame:
    """(cve_id, timegap): whole hours from our creation to the registry's date."""
    return vulnerability.select("cve_id", "created_date").join(registry.select("cve_id", F.col(at).alias("_at")), "cve_id").select("cve_id", hour_gap("created_date", "_at").alias("timegap"))


def attach_verdicts(rows: DataFrame, verdicts: DataFrame, column: str, default: str | None = None) -> DataFrame:
    """`rows` (cve_id, ...) with the verdict of an outside service from (cve_id, `column`), a row an id at most; else the default."""
    j = rows.join(verdicts.select("cve_id", column), "cve_id", "left")
    return j if default is None else j.fillna(default, [column])


def assign_weaknesses(rows: DataFrame, verdicts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cve_id, node): the weaknesses that an outside service named for each id in `verdicts` (cve_id, node), as far as the forest has them."""
    return verdicts.join(rows.select("cve_id").distinct(), "cve_id", "left_semi").join(nodes.select("node"), "node", "left_semi").select("cve_id", "node").distinct()


def pages_to_read(pages: DataFrame) -> DataFrame:
    """(site, page) of the listing pages that are read, from (site, page, ids): paging stops at a page without ids, and before one that shares an id
    with an earlier page. Where each id occurs first decides, so pages are never compared with each other."""
    seen = Window.partitionBy("site", "id").orderBy("page")
    ids = pages.select("site", "page", F.explode("ids").alias("id")).distinct().withColumn("_again", F.row_number().over(seen) > 1)
    again = ids.groupBy("site", "page").agg(F.bool_or("_again").alias("_again"))
    stop = pages.select("site", "page").join(again, ["site", "page"], "left").filter(F.coalesce("_again", F.lit(True))).groupBy("site").agg(F.min("page").alias("_stop"))
    return pages.join(stop, "site", "left").filter("_stop is null OR page < _stop").select("site", "page")


def ordered_products(products: DataFrame) -> DataFrame:
    """Products by falling id, then by platform id; a range sort, not a single task."""
    return products.orderBy(F.desc("cve_id"), F.asc("cpe"))


def source_types(rows: DataFrame, types: DataFrame, url: str = "source_url") -> DataFrame:
    """`rows` with the type of their host from (host, type), else other. Whether the types are broadcast is left to their measured size."""
    return rows.withColumn("_host", host(url)).join(types.select(F.col("host").alias("_host"), F.col("type").alias("looked_up_type")), "_host", "left").withColumn("looked_up_type", F.coalesce("looked_up_type", F.lit("other"))).drop("_host")


def admit_urls(pages: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Pages that aren't media files and begin with a prefix of the whitelist (prefix)."""
    ok = pages.filter(~F.lower("url").rlike(r"\.(css|js|gif|jpg|png|mp3|mp4|zip|gz)$"))
    w = whitelist.select(F.lower("prefix").alias("_prefix")).filter("_prefix is not null").distinct()
    # By equality: each address with its beginnings of the lengths that prefixes have, a few dozen at most, gathered from the whitelist alone.
    sizes = F.array_sort(F.collect_set(F.length("_prefix")))
    lengths = w.agg(sizes.alias("x")).first()["x"]
    low, own = F.lower("url"), F.col("_own")
    if not lengths:
        return ok.filter(F.lit(False))
    heads = ok.withColumn("_own", F.array_distinct(F.transform(F.array(*map(F.lit, lengths)), lambda n: F.when(F.length(low) >= n, F.substring(low, F.lit(1), n)))))
    hit = heads.select("url", F.explode(own).alias("_prefix")).join(w, "_prefix", "left_semi").select("url").distinct()
    return ok.join(hit, "url", "left_semi")


def sourceless(vulnerability: DataFrame, urls: DataFrame) -> DataFrame:
    return vulnerability.join(urls.select("cve_id"), "cve_id", "left_anti")


def new_exploits(exploit: DataFrame, version: DataFrame, stored: DataFrame) -> DataFrame:
    """Exploits of ids with exactly one version row that aren't stored yet."""
    single = version.groupBy("cve_id").agg(F.count("*").alias("n")).filter("n = 1").select("cve_id")
    return exploit.join(single, "cve_id").join(stored.select("exploit_id"), "exploit_id", "left_anti")


def exploit_status(vulnerability: DataFrame, exploit: DataFrame) -> DataFrame:
    """(cve_id, exploit_status): POC where an exploit is known, else NONE."""
    known = exploit.select("cve_id", F.lit("POC").alias("exploit_status")).distinct()
    return vulnerability.select("cve_id").join(known, "cve_id", "left").fillna("NONE", ["exploit_status"])


def append_new(existing: DataFrame, incoming: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, one row with counts of inserted and existing)."""
    accepted = incoming.dropDuplicates(key).join(existing.select(*key), key, "left_anti")
    counts = incoming.join(existing.select(*key).distinct().withColumn("_old", F.lit(1)), key, "left").agg(F.count_distinct(F.when(F.col("_old").isNull(), F.struct(*key))).alias("inserted"), F.count_if(F.col("_old").isNotNull()).alias("existing"))
    return accepted, counts


def merge_maps(*sides: DataFrame) -> DataFrame:
    """(cve_id, urls): the lists of several crawlers appended by id."""
    x = sides[0]
    for s in sides[1:]:
        x = x.unionByName(s)
    return x.groupBy("cve_id").agg(F.array_sort(F.collect_list("source_url")).alias("urls"))


def roots(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that are no one's child. edges (child, parent), nodes (node)."""
    return nodes.join(edges.select(F.col("child").alias("node")), "node", "left_anti")


def max_children(spark, edges: DataFrame, start: DataFrame) -> DataFrame:
    """(root, max_children): the largest number of children of any node under each root, the root included; a recursive query."""
    edges.createOrReplaceTempView("_tree_edges")
    start.createOrReplaceTempView("_tree_roots")
    return spark.sql("""
        WITH RECURSIVE under(root, node) AS (SELECT node, node FROM _tree_roots UNION ALL SELECT u.root, e.child FROM under u JOIN _tree_edges e ON e.parent = u.node),
        fan AS (SELECT parent, count(*) AS c FROM _tree_edges GROUP BY parent)
        SELECT u.root, max(coalesce(f.c, 0)) AS max_children FROM under u LEFT JOIN fan f ON f.parent = u.node GROUP BY u.root""")
