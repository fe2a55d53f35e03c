"""Queries over commits, listing pages, run histories and verdicts of outside services."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexarium.functions.text import platform_versions, strip_tags
from vexarium.operators import catalog, patches, reports
from vexarium.plans.bindings import Domain
from vexarium.plans.registry import query

_NEW = "n.sha IS NOT NULL"


@query("commit_upsert", f"""SELECT coalesce(o.sha, n.sha) AS sha, coalesce(o.cve_id, n.cve_id) AS cve_id, coalesce(o.repo, n.repo) AS repo,
 CASE WHEN {_NEW} THEN n.commit_date ELSE o.commit_date END AS commit_date, CASE WHEN {_NEW} THEN n.message ELSE o.message END AS message
 FROM (SELECT * FROM d_commit WHERE repo % 3 <> 0) o FULL JOIN (SELECT sha, concat(cve_id, '0') AS cve_id, repo, commit_date, concat(message, ' again') AS message FROM d_commit WHERE repo % 2 = 0) n ON o.sha = n.sha""")  # fmt: skip
def commit_upsert(d: Domain) -> DataFrame:
    c = d.commit.select("sha", "cve_id", "repo", "commit_date", "message")
    incoming = c.filter("repo % 2 = 0").withColumns({"cve_id": F.concat("cve_id", F.lit("0")), "message": F.concat("message", F.lit(" again"))})
    return patches.upsert_commits(c.filter("repo % 3 <> 0"), incoming)


@query("commit_elapsed", "SELECT repo, count(*) AS n_commits, string_agg(sha, ';' ORDER BY commit_date DESC, sha DESC) FILTER (WHERE r <= 7 OR r = c) AS timeline FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY commit_date DESC, sha DESC) AS r, count(*) OVER (PARTITION BY repo) AS c FROM d_commit) GROUP BY repo")
def commit_elapsed(d: Domain) -> DataFrame:
    return patches.commit_timeline(d.commit, 8, newest_first=True).withColumn("n_commits", F.col("n_commits").cast("bigint"))


_LISTED = "(SELECT DISTINCT source AS site, raw_description_id // 37 AS page, cve_id AS id FROM d_raw)"


@query("listing_pages", f"""SELECT DISTINCT site, page FROM {_LISTED} LEFT JOIN (SELECT site, min(page) AS stop FROM
 (SELECT *, row_number() OVER (PARTITION BY site, id ORDER BY page) AS nth FROM {_LISTED}) WHERE nth > 1 GROUP BY site) USING (site) WHERE stop IS NULL OR page < stop""")  # fmt: skip
def listing_pages(d: Domain) -> DataFrame:
    pages = d.raw.groupBy(F.col("source").alias("site"), F.expr("raw_description_id DIV 37").alias("page")).agg(F.collect_set("cve_id").alias("ids"))
    return catalog.pages_to_read(pages)


@query("run_averages", """SELECT round(avg(added), 2) AS avg_added, round(avg(updated), 2) AS avg_updated, round(avg(nvd_gap), 2) AS avg_nvd_gap, round(avg(mitre_gap), 2) AS avg_mitre_gap, max_by(total, run_id) AS total
 FROM (SELECT run_id, count(*) AS total, count(DISTINCT cve_id) AS added, count(last_modified_date) AS updated, max(n_chars) AS nvd_gap, min(n_chars) AS mitre_gap FROM d_raw GROUP BY run_id)""")  # fmt: skip
def run_averages(d: Domain) -> DataFrame:
    history = d.raw.groupBy("run_id").agg(F.count("*").alias("total"), F.count_distinct("cve_id").alias("added"), F.count("last_modified_date").alias("updated"), F.max("n_chars").alias("nvd_gap"), F.min("n_chars").alias("mitre_gap"))
    return reports.run_averages(history)


@query("weakness_verdicts", "SELECT DISTINCT v.cve_id, v.vuln_id % 40 AS node FROM d_vuln v JOIN d_nvd USING (cve_id) WHERE v.vuln_id % 40 < 30")
def weakness_verdicts(d: Domain) -> DataFrame:
    verdicts = d.vulnerability.select("cve_id", (F.col("vuln_id") % 40).alias("node"))
    return catalog.assign_weaknesses(d.nvd, verdicts, d.spark.range(30).withColumnRenamed("id", "node"))


@query("service_verdicts", "SELECT v.cve_id, coalesce(m.status, 'none') AS status FROM d_vuln v LEFT JOIN d_mitre m USING (cve_id)")
def service_verdicts(d: Domain) -> DataFrame:
    return catalog.attach_verdicts(d.vulnerability.select("cve_id"), d.mitre, "status", "none")


@query("products_ordered", "SELECT cve_id, cpe FROM d_product ORDER BY cve_id DESC, cpe")
def products_ordered(d: Domain) -> DataFrame:
    return catalog.ordered_products(d.product.select("cve_id", "cpe"))


@query("platform_versions")
def platforms(d: Domain) -> DataFrame:
    """A backward scan, without SQL; a test holds it against worked examples."""
    return d.page.select("page_id", platform_versions(strip_tags("html")).alias("platforms"))
