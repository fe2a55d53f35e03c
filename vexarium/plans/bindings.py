"""The domain tables, derived from the supplied ones: a DataFrame each, and the same table as DuckDB SQL for the oracles.

The supplied tables hold no vulnerability ids, so every domain table is a deterministic function of them (see SURVEY 7.3).
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexarium.schema import LABELS, SEVERITIES, SOURCE_TYPES

#: The as-of instant that replaces the clock in every query.
AS_OF = "2023-06-01 00:00:00"

_N = "CAST(floor(doc_id / 4) AS BIGINT)"


def _cve(n: str) -> str:
    """The id of the n-th vulnerability; the same text in both dialects."""
    return f"concat('CVE-', CAST(2015 + {n} % 10 AS STRING), '-', lpad(CAST({n} AS STRING), CAST(greatest(5, length(CAST({n} AS STRING))) AS INT), '0'))"


_DESCRIPTION = """CASE doc_id % 20 WHEN 0 THEN '  ' WHEN 1 THEN cve_id WHEN 2 THEN '12345' WHEN 3 THEN concat(cve_id, ', GHSA-abcd-efgh-ijkl')
 WHEN 4 THEN concat('Duplicate advisory text for ', cve_id) WHEN 5 THEN concat('Duplicate advisory text for ', cve_id) ELSE text END"""
_TYPE = "CASE CAST(substring(source, 4) AS INT) % 6 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SOURCE_TYPES)) + " END"


class Domain:
    """Lazily built domain tables over the Parquet tables in `sf_dir`."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def size(self) -> DataFrame:
        """One row: the number of vulnerabilities."""
        return F.broadcast(self.base("documents").select(F.expr(_N).alias("n")).agg(F.count_distinct("n").alias("n_cves")))

    @cached_property
    def raw(self) -> DataFrame:
        d = self.base("documents").withColumn("n", F.expr(_N)).withColumn("cve_id", F.expr(_cve("n")))
        published = F.expr("timestampadd(HOUR, doc_id, TIMESTAMP_NTZ'2023-01-01 00:00:00')")
        return d.select(
            F.col("doc_id").alias("raw_description_id"), "n", "cve_id", F.expr(_DESCRIPTION).alias("raw_description"),
            F.concat(F.lit("https://"), "source", F.lit(".example.org/adv/"), F.col("doc_id").cast("string")).alias("source_url"),
            F.expr(_TYPE).alias("source_type"), published.alias("published_date"), "n_chars",
            (F.col("doc_id") % 5).alias("run_id"), F.lit(0).alias("is_garbage"), "source",
        ).withColumns({
            "last_modified_date": F.expr("CASE WHEN raw_description_id % 5 = 0 THEN NULL ELSE timestampadd(HOUR, n_chars % 72, published_date) END"),
            "created_date": F.expr("timestampadd(HOUR, raw_description_id % 48, published_date)"),
        })

    @cached_property
    def nvd(self) -> DataFrame:
        status = F.expr("CASE n % 5 WHEN 0 THEN 'Analyzed' WHEN 1 THEN 'Awaiting Analysis' WHEN 2 THEN 'Undergoing Analysis' WHEN 3 THEN 'Received' ELSE 'Not in NVD' END")
        return self.raw.filter("n % 7 <> 0").select("n", "cve_id").distinct().select("cve_id", F.expr("timestampadd(HOUR, n, TIMESTAMP_NTZ'2023-01-10 00:00:00')").alias("published_date"), status.alias("status"), F.expr("timestampadd(HOUR, n, TIMESTAMP_NTZ'2023-02-10 00:00:00')").alias("last_modified"))

    @cached_property
    def nvd_url(self) -> DataFrame:
        return self.raw.filter("n % 7 <> 0 AND raw_description_id % 2 = 0").select("cve_id", "source_url")

    @cached_property
    def mitre(self) -> DataFrame:
        status = F.expr("CASE n % 4 WHEN 0 THEN 'Public' WHEN 1 THEN 'Reserved' WHEN 2 THEN 'PUBLIC' ELSE 'unknown' END")
        return self.raw.filter("n % 5 <> 0").select("n", "cve_id").distinct().select("cve_id", status.alias("status"), F.expr("timestampadd(HOUR, n, TIMESTAMP_NTZ'2023-02-01 00:00:00')").alias("last_modified"))

    @cached_property
    def label(self) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame(LABELS, "label_id int, label string, noun_group string"))

    @cached_property
    def vdo(self) -> DataFrame:
        x = self.base("lineitem").crossJoin(self.size).select((F.col("l_orderkey") % F.col("n_cves")).alias("n"), (F.col("l_partkey") % len(LABELS) + 1).cast("int").alias("label_id"), F.col("l_discount").alias("confidence"))
        return x.join(self.label, "label_id").select("n", F.expr(_cve("n")).alias("cve_id"), "label_id", "label", "noun_group", "confidence")

    @cached_property
    def severity_dim(self) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame(list(enumerate(SEVERITIES, 1)), "severity_id int, severity string"))

    @cached_property
    def cvss(self) -> DataFrame:
        x = self.base("orders").crossJoin(self.size).select((F.col("o_orderkey") % F.col("n_cves")).alias("n"), (F.col("o_custkey") % 5 + 1).cast("int").alias("severity_id"), (F.floor(F.col("o_totalprice") * 10) / 10).alias("impact_score"), (F.col("o_orderkey") % 100 / 100).alias("severity_confidence"))
        return x.join(self.severity_dim, "severity_id").select("n", F.expr(_cve("n")).alias("cve_id"), "severity", "severity_confidence", "impact_score")

    @cached_property
    def product(self) -> DataFrame:
        part = self.base("part").select("p_partkey", F.lower(F.regexp_replace("p_brand", "#", "")).alias("vendor"), F.regexp_replace("p_name", " ", "_").alias("product_name"))
        x = self.base("lineitem").crossJoin(self.size).join(part, F.col("l_partkey") == F.col("p_partkey"))
        version = F.concat_ws(".", F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"), (F.col("l_suppkey") % 10).cast("string"))
        x = x.select((F.col("l_orderkey") % F.col("n_cves")).alias("n"), F.col("l_partkey").alias("product_id"), "vendor", "product_name", version.alias("version"), (F.col("l_orderkey") % 5).alias("cpe_set_run"))
        return x.select("*", F.expr(_cve("n")).alias("cve_id"), F.concat(F.lit("cpe:2.3:a:"), "vendor", F.lit(":"), "product_name", F.lit(":"), "version", F.lit(":*:*:*:*:*:*:*")).alias("cpe"))

    @cached_property
    def dictionary(self) -> DataFrame:
        """Distinct (vendor, product, version) with its title."""
        title = F.concat_ws(" ", "vendor", F.regexp_replace("product_name", "_", " "), "version")
        return self.product.select("vendor", "product_name", "version").distinct().select("*", F.concat_ws(":", "vendor", "product_name").alias("group_id"), title.alias("title"))

    @cached_property
    def version(self) -> DataFrame:
        """One version of a vulnerability for each run that touched it."""
        g = self.raw.groupBy("n", "cve_id", "run_id").agg(F.min("created_date").alias("created_date"), F.min("published_date").alias("published_date"), F.max("last_modified_date").alias("last_modified_date"), F.max("raw_description").alias("description"))
        return g.select((F.col("n") * 5 + F.col("run_id")).alias("vuln_version_id"), "*")

    @cached_property
    def vulnerability(self) -> DataFrame:
        """The current version of each vulnerability is that of its last run."""
        return self.version.groupBy("n", "cve_id").agg(F.min("created_date").alias("created_date"), F.max("vuln_version_id").alias("vuln_version_id")).withColumnRenamed("n", "vuln_id")

    @cached_property
    def bridge(self) -> DataFrame:
        return self.raw.select((F.col("n") * 5 + F.col("run_id")).alias("description_id"), "raw_description_id")

    @cached_property
    def run(self) -> DataFrame:
        return self.spark.range(5).select(F.col("id").alias("run_id"), F.expr("timestampadd(DAY, id, TIMESTAMP_NTZ'2023-04-20 00:00:00')").alias("run_date_time"))

    @cached_property
    def exploit(self) -> DataFrame:
        return self.base("events").filter("event_type = 'purchase'").crossJoin(self.size).select((F.col("event_id") % F.col("n_cves")).alias("n"), F.col("event_id").alias("exploit_id"), F.col("ts").alias("exploit_date"), F.concat(F.lit("https://exploits.example.net/"), F.col("event_id").cast("string")).alias("exploit_source")).withColumn("cve_id", F.expr(_cve("n")))

    @cached_property
    def commit(self) -> DataFrame:
        x = self.base("events").filter("event_type = 'click'").crossJoin(self.size).select((F.col("event_id") % F.col("n_cves")).alias("n"), "event_id", "user_id", "ts").withColumn("cve_id", F.expr(_cve("n")))
        diff = F.expr("concat('diff --git a/x b/x\\n@@ -', event_id % 50 + 1, ',3 +', event_id % 50 + 1, ',', event_id % 9 + 1, ' @@ void f()\\n+line\\n@@ -200,2 +200,', event_id % 4 + 1, ' @@ end\\n-old')")
        return x.select("cve_id", F.col("user_id").alias("repo"), F.md5(F.col("event_id").cast("string")).alias("sha"), F.col("ts").alias("commit_date"), F.concat(F.lit("Fix "), "cve_id", F.lit(" in build "), F.col("event_id").cast("string")).alias("message"), diff.alias("diff"))

    @cached_property
    def page(self) -> DataFrame:
        tail = F.concat(F.lit("<p>CVE-2021-"), F.lpad(F.col("page_id").cast("string"), 7, "0"), F.lit(" affects widget 1.2.3 Published 2021-03-04</p>"))
        return self.base("pages").select("page_id", "url", F.concat("html", tail).alias("html"))


_SQL = {
    "d_size": f"SELECT count(DISTINCT {_N}) AS n_cves FROM documents",
    "d_raw0": f"SELECT *, {_N} AS n FROM documents",
    "d_raw1": f"SELECT *, {_cve('n')} AS cve_id, TIMESTAMP '2023-01-01' + to_hours(doc_id) AS published_date FROM d_raw0",
    "d_raw": f"""SELECT doc_id AS raw_description_id, n, cve_id, {_DESCRIPTION} AS raw_description, concat('https://', source, '.example.org/adv/', doc_id) AS source_url,
 {_TYPE} AS source_type, published_date, n_chars, doc_id % 5 AS run_id, 0 AS is_garbage, source,
 CASE WHEN doc_id % 5 = 0 THEN NULL ELSE published_date + to_hours(n_chars % 72) END AS last_modified_date, published_date + to_hours(doc_id % 48) AS created_date FROM d_raw1""",
    "d_nvd": """SELECT DISTINCT cve_id, TIMESTAMP '2023-01-10' + to_hours(n) AS published_date, CASE n % 5 WHEN 0 THEN 'Analyzed' WHEN 1 THEN 'Awaiting Analysis' WHEN 2 THEN 'Undergoing Analysis' WHEN 3 THEN 'Received' ELSE 'Not in NVD' END AS status,
 TIMESTAMP '2023-02-10' + to_hours(n) AS last_modified FROM d_raw WHERE n % 7 <> 0""",
    "d_nvd_url": "SELECT cve_id, source_url FROM d_raw WHERE n % 7 <> 0 AND raw_description_id % 2 = 0",
    "d_mitre": "SELECT DISTINCT cve_id, CASE n % 4 WHEN 0 THEN 'Public' WHEN 1 THEN 'Reserved' WHEN 2 THEN 'PUBLIC' ELSE 'unknown' END AS status, TIMESTAMP '2023-02-01' + to_hours(n) AS last_modified FROM d_raw WHERE n % 5 <> 0",
    "d_label": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{a}', '{b}')" for i, a, b in LABELS) + ") AS t(label_id, label, noun_group)",
    "d_vdo": f"""SELECT n, {_cve('n')} AS cve_id, label_id, label, noun_group, confidence
 FROM (SELECT l_orderkey % n_cves AS n, CAST(l_partkey % {len(LABELS)} + 1 AS INT) AS label_id, l_discount AS confidence FROM lineitem, d_size) JOIN d_label USING (label_id)""",
    "d_sev": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(SEVERITIES, 1)) + ") AS t(severity_id, severity)",
    "d_cvss": f"""SELECT n, {_cve('n')} AS cve_id, severity, severity_confidence, impact_score
 FROM (SELECT o_orderkey % n_cves AS n, CAST(o_custkey % 5 + 1 AS INT) AS severity_id, floor(o_totalprice * 10) / 10 AS impact_score, o_orderkey % 100 / 100 AS severity_confidence FROM orders, d_size) JOIN d_sev USING (severity_id)""",
    "d_product": f"""SELECT *, {_cve('n')} AS cve_id, concat('cpe:2.3:a:', vendor, ':', product_name, ':', version, ':*:*:*:*:*:*:*') AS cpe
 FROM (SELECT l_orderkey % n_cves AS n, l_partkey AS product_id, lower(replace(p_brand, '#', '')) AS vendor, replace(p_name, ' ', '_') AS product_name,
  concat(l_linenumber, '.', CAST(trunc(l_quantity) AS INT), '.', l_suppkey % 10) AS version, l_orderkey % 5 AS cpe_set_run FROM lineitem JOIN part ON l_partkey = p_partkey, d_size)""",
    "d_dict": "SELECT DISTINCT vendor, product_name, version, concat(vendor, ':', product_name) AS group_id, concat(vendor, ' ', replace(product_name, '_', ' '), ' ', version) AS title FROM d_product",
    "d_version": """SELECT n * 5 + run_id AS vuln_version_id, n, cve_id, run_id, min(created_date) AS created_date, min(published_date) AS published_date, max(last_modified_date) AS last_modified_date, max(raw_description) AS description
 FROM d_raw GROUP BY n, cve_id, run_id""",
    "d_vuln": "SELECT n AS vuln_id, cve_id, min(created_date) AS created_date, max(vuln_version_id) AS vuln_version_id FROM d_version GROUP BY n, cve_id",
    "d_bridge": "SELECT n * 5 + run_id AS description_id, raw_description_id FROM d_raw",
    "d_run": "SELECT i AS run_id, TIMESTAMP '2023-04-20' + to_days(CAST(i AS INT)) AS run_date_time FROM range(5) t(i)",
    "d_exploit": f"""SELECT *, {_cve('n')} AS cve_id FROM (SELECT event_id % n_cves AS n, event_id AS exploit_id, ts AS exploit_date, concat('https://exploits.example.net/', event_id) AS exploit_source
 FROM events, d_size WHERE event_type = 'purchase')""",
    "d_commit": f"""SELECT {_cve('n')} AS cve_id, user_id AS repo, md5(CAST(event_id AS STRING)) AS sha, ts AS commit_date, concat('Fix ', {_cve('n')}, ' in build ', event_id) AS message,
 concat('diff --git a/x b/x', chr(10), '@@ -', event_id % 50 + 1, ',3 +', event_id % 50 + 1, ',', event_id % 9 + 1, ' @@ void f()', chr(10), '+line', chr(10), '@@ -200,2 +200,', event_id % 4 + 1, ' @@ end', chr(10), '-old') AS diff
 FROM (SELECT event_id % n_cves AS n, event_id, user_id, ts FROM events, d_size WHERE event_type = 'click')""",
    "d_page": "SELECT page_id, url, concat(html, '<p>CVE-2021-', lpad(CAST(page_id AS STRING), 7, '0'), ' affects widget 1.2.3 Published 2021-03-04</p>') AS html FROM pages",
}


def oracle(body: str) -> str:
    """`body` behind the domain tables that it names, and those that they name."""
    need: set[str] = set()
    todo = [body]
    while todo:
        for name in set(re.findall(r"\bd_[a-z0-9_]+\b", todo.pop())) & _SQL.keys() - need:
            need.add(name)
            todo.append(_SQL[name])
    ctes = ",\n".join(f"{k} AS ({v})" for k, v in _SQL.items() if k in need)
    return (f"WITH {ctes}\n" if ctes else "") + body.strip()
