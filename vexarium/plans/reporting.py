"""Queries over the aggregate and search reports and the run metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexarium.operators import catalog, filters, reports
from vexarium.plans.bindings import Domain
from vexarium.plans.quality import _ALL, _TRIM
from vexarium.plans.registry import query

START, END = "2023-04-21 00:00:00", "2023-04-30 00:00:00"


def _list(x: str) -> str:
    return f"string_agg(DISTINCT {x}, ';' ORDER BY {x})"


def _num(x: str) -> str:
    return f"CAST(CAST({x} AS DECIMAL(12,3)) AS STRING)"


_LATEST = f"SELECT vuln_id, max(run_id) AS run_id, max(run_date_time) AS run_date_time FROM (SELECT v.n AS vuln_id, r.run_id, r.run_date_time FROM d_version v JOIN d_run r USING (run_id)) WHERE run_date_time BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' GROUP BY vuln_id"
_REPORTABLE = "description IS NOT NULL AND description NOT LIKE '%** RESERVED ** This candidate%' AND description NOT LIKE '%** REJECT ** DO NOT USE%' AND strlen(description) >= 50"
_AGG = f"""SELECT l.run_id, l.vuln_id, c.cve_id, c.description, c.published_date, c.last_modified_date, l.run_date_time, c.in_nvd, c.in_mitre,
 u.urls, s.base_severities, s.severity_confidences, s.impact_scores, w.vdo_labels, w.vdo_noun_groups, w.vdo_label_confidences, p.cpes, p.versions, p.product_ids
FROM ({_LATEST}) l
JOIN (SELECT v.vuln_id, x.cve_id, x.description, x.published_date, x.last_modified_date, coalesce(n.status = 'Analyzed', false) AS in_nvd, coalesce(lower(m.status) = 'public', false) AS in_mitre
  FROM d_vuln v JOIN d_version x USING (vuln_version_id) LEFT JOIN d_nvd n ON n.cve_id = v.cve_id LEFT JOIN d_mitre m ON m.cve_id = v.cve_id) c ON c.vuln_id = l.vuln_id
LEFT JOIN (SELECT cve_id, {_list('source_url')} AS urls FROM d_nvd_url GROUP BY 1) u ON u.cve_id = c.cve_id
LEFT JOIN (SELECT cve_id, {_list('severity')} AS base_severities, {_list(_num('severity_confidence'))} AS severity_confidences, {_list(_num('impact_score'))} AS impact_scores FROM d_cvss GROUP BY 1) s ON s.cve_id = c.cve_id
LEFT JOIN (SELECT cve_id, {_list('label')} AS vdo_labels, {_list('noun_group')} AS vdo_noun_groups, {_list(_num('confidence'))} AS vdo_label_confidences FROM d_vdo GROUP BY 1) w ON w.cve_id = c.cve_id
LEFT JOIN (SELECT cve_id, {_list('cpe')} AS cpes, {_list('version')} AS versions, {_list('CAST(product_id AS STRING)')} AS product_ids FROM d_product GROUP BY 1) p ON p.cve_id = c.cve_id
WHERE {_REPORTABLE} AND w.vdo_labels IS NOT NULL"""
_EXPLOITS = "SELECT cve_id AS ecve, exploit_date AS exploit_publish_date, exploit_source AS exploit_url FROM d_exploit"
_FULL = f"SELECT a.*, exploit_publish_date, exploit_url FROM ({_AGG}) a LEFT JOIN ({_EXPLOITS}) e ON e.ecve = a.cve_id"


def inputs(d: Domain, exploits: DataFrame | None = None) -> reports.AggregateInputs:
    runs = d.version.select(F.col("n").alias("vuln_id"), "run_id").join(d.run, "run_id")
    v = catalog.composite(d.vulnerability, d.version).select("vuln_id", "cve_id", "description", "published_date", "last_modified_date")
    v = v.join(d.nvd.select("cve_id", catalog.in_nvd().alias("in_nvd")), "cve_id", "left").join(d.mitre.select("cve_id", catalog.in_mitre().alias("in_mitre")), "cve_id", "left").fillna(False, ["in_nvd", "in_mitre"])
    return reports.AggregateInputs(runs, v, d.vdo, d.nvd_url, d.cvss, d.product, d.exploit if exploits is None else exploits)


def aggregate(d: Domain) -> DataFrame:
    """One row for each vulnerability, without exploits."""
    none = d.exploit.filter(F.lit(False))
    return reports.daily_aggregate(inputs(d, none), START, END).drop("exploit_publish_date", "exploit_url")


@query("daily_aggregate", _FULL)
def daily_aggregate(d: Domain) -> DataFrame:
    return reports.daily_aggregate(inputs(d), START, END)


@query("daily_aggregate_incremental", f"SELECT vuln_id, cve_id, exploit_url FROM ({_FULL}) WHERE vuln_id NOT IN (SELECT vuln_id FROM d_vuln WHERE vuln_id % 3 = 0)")
def daily_aggregate_incremental(d: Domain) -> DataFrame:
    return reports.incremental(reports.daily_aggregate(inputs(d), START, END), d.vulnerability.filter("vuln_id % 3 = 0")).select("vuln_id", "cve_id", "exploit_url")


_PAIRED = "label, CAST(CAST(confidence AS DECIMAL(12,3)) AS STRING), noun_group"


@query("paired_label_lists", f"SELECT cve_id, string_agg(label, ';' ORDER BY {_PAIRED}) AS vdo_labels, string_agg({_num('confidence')}, ';' ORDER BY {_PAIRED}) AS vdo_label_confidences, string_agg(noun_group, ';' ORDER BY {_PAIRED}) AS vdo_noun_groups FROM d_vdo GROUP BY cve_id")
def paired_label_lists(d: Domain) -> DataFrame:
    return reports.paired_lists(d.vdo)


@query("latest_run_per_vuln", _LATEST)
def latest_run_per_vuln(d: Domain) -> DataFrame:
    return reports.latest_run(d.version.select(F.col("n").alias("vuln_id"), "run_id").join(d.run, "run_id"), START, END)


@query("search_form_info", f"""SELECT (SELECT {_list('severity')} FROM d_cvss WHERE severity <> 'n/a') AS severities,
 (SELECT string_agg(concat(noun_group, ':', ls), '|' ORDER BY noun_group) FROM (SELECT noun_group, {_list('label')} AS ls FROM d_vdo GROUP BY 1)) AS labels""")
def search_form_info(d: Domain) -> DataFrame:
    return reports.search_form(d.cvss, d.vdo)


_HITS = "SELECT vuln_id, cve_id, base_severities, vdo_labels FROM ({agg}) WHERE {where}"


def _search_sql(where: str, limit: int) -> str:
    return f"WITH h AS ({_HITS.format(agg=_AGG, where=where)}) SELECT *, (SELECT count(*) FROM (SELECT 1 FROM h LIMIT 10000)) AS total_matches FROM h ORDER BY vuln_id DESC LIMIT {limit}"


@query("search_by_criteria", f"SELECT * FROM ({_search_sql('''list_has_any(string_split(base_severities, ';'), ['HIGH', 'CRITICAL']) AND list_has_any(string_split(vdo_labels, ';'), ['Remote', 'Write']) AND contains(lower(description), 'an') AND NOT in_nvd''', 50)})")
def search_by_criteria(d: Domain) -> DataFrame:
    c = reports.Criteria(keyword="an", in_nvd=False, severities=("HIGH", "CRITICAL"), labels=("Remote", "Write"), limit=50)
    return reports.search(aggregate(d), c).select("vuln_id", "cve_id", "base_severities", "vdo_labels", "total_matches")


@query("search_page_before", f"SELECT * FROM ({_search_sql('vuln_id < 200', 20)})")
def search_page_before(d: Domain) -> DataFrame:
    return reports.search(aggregate(d), reports.Criteria(before=200, limit=20)).select("vuln_id", "cve_id", "base_severities", "vdo_labels", "total_matches")


@query("search_by_id", f"SELECT * FROM ({_search_sql('''lower(cve_id) = 'cve-2022-00007' ''', 20)})")
def search_by_id(d: Domain) -> DataFrame:
    return reports.search(aggregate(d), reports.Criteria(keyword="CVE-2022-00007", limit=20)).select("vuln_id", "cve_id", "base_severities", "vdo_labels", "total_matches")


_COMP = """SELECT v.cve_id, CASE v.vuln_id % 3 WHEN 0 THEN 'NEW' WHEN 1 THEN 'UPDATED' ELSE 'UNCHANGED' END AS status, coalesce(n.status = 'Analyzed', false) AS in_nvd, coalesce(lower(m.status) = 'public', false) AS in_mitre,
 datesub('hour', v.created_date, n.published_date) AS nvd_gap, datesub('hour', v.created_date, m.last_modified) AS mitre_gap FROM d_vuln v LEFT JOIN d_nvd n USING (cve_id) LEFT JOIN d_mitre m USING (cve_id)"""


def composites(d: Domain) -> DataFrame:
    n = d.nvd.select("cve_id", catalog.in_nvd().alias("in_nvd"), F.col("published_date").alias("a"))
    m = d.mitre.select("cve_id", catalog.in_mitre().alias("in_mitre"), F.col("last_modified").alias("b"))
    status = F.expr("CASE vuln_id % 3 WHEN 0 THEN 'NEW' WHEN 1 THEN 'UPDATED' ELSE 'UNCHANGED' END").alias("status")
    x = d.vulnerability.join(n, "cve_id", "left").join(m, "cve_id", "left").fillna(False, ["in_nvd", "in_mitre"])
    return x.select("cve_id", status, "in_nvd", "in_mitre", F.timestamp_diff("HOUR", F.col("created_date"), F.col("a")).alias("nvd_gap"), F.timestamp_diff("HOUR", F.col("created_date"), F.col("b")).alias("mitre_gap"))


def _stats(updated: str, gap: str) -> str:
    c = lambda x: f"count(*) FILTER (WHERE {x})"
    return f"SELECT count(*) AS total_cve_count, {c('status = ' + repr('NEW'))} AS new_cve_count, {c('status = ' + repr(updated))} AS updated_cve_count, {c('NOT in_nvd')} AS not_in_nvd_count, {c('NOT in_mitre')} AS not_in_mitre_count, {c('NOT in_nvd AND NOT in_mitre')} AS not_in_both_count, {gap.format('nvd_gap')} AS avg_gap_nvd, {gap.format('mitre_gap')} AS avg_gap_mitre FROM ({_COMP})"


@query("run_stats", _stats("UPDATED", "coalesce(round(avg({}), 6), 0.0)"))
def run_stats(d: Domain) -> DataFrame:
    return reports.run_stats(composites(d))


@query("run_stats_compat", _stats("UNCHANGED", "CAST(0.0 AS DOUBLE)"))
def run_stats_compat(d: Domain) -> DataFrame:
    return reports.run_stats(composites(d), compat=True)


@query("new_vulns_per_run", "SELECT run_id, count(*) AS n_total, count(DISTINCT (cve_id, raw_description, source_url)) FILTER (WHERE first = run_id) AS n_new FROM (SELECT *, min(run_id) OVER (PARTITION BY cve_id, raw_description, source_url) AS first FROM d_raw) GROUP BY run_id")
def new_vulns_per_run(d: Domain) -> DataFrame:
    return reports.new_per_run(d.raw)


@query("source_type_distribution", "SELECT run_id, " + ", ".join(f"count(*) FILTER (WHERE source_type = '{k}') AS n_{k}" for k in ("cna", "security_advisory", "third_party", "bug_bounty", "other")) + " FROM d_raw GROUP BY run_id")
def source_type_distribution(d: Domain) -> DataFrame:
    return reports.source_type_distribution(d.raw)


@query("filter_stats", f"SELECT run_id, count(*) FILTER (WHERE s = 0) AS not_filtered, count(*) FILTER (WHERE s = 2) AS passed, count(*) FILTER (WHERE s = 3) AS failed, count(*) AS total, count(*) FILTER (WHERE s IN (2, 3)) AS total_filtered, coalesce(round(count(*) FILTER (WHERE s = 2) / nullif(count(*) FILTER (WHERE s IN (2, 3)), 0), 6), 0.0) AS proportion_passed FROM (SELECT run_id, CASE WHEN raw_description_id % 4 = 3 THEN 0 WHEN source_type = 'user' OR ({_ALL}) THEN 2 ELSE 3 END AS s FROM d_raw) GROUP BY run_id")
def filter_stats(d: Domain) -> DataFrame:
    x = d.raw.withColumn("status", F.lit(0))
    return reports.filter_stats(x.withColumn("new_status", F.when(F.col("raw_description_id") % 4 == 3, 0).otherwise(filters.next_status(filters.LOCAL))))


@query("migration_description", "SELECT cve_id, max(raw_description) AS description, concat('(', string_agg(raw_description_id, ',' ORDER BY raw_description_id), ')') AS build, min(created_date) AS created_date, min(published_date) AS published_date, max(last_modified_date) AS last_modified_date FROM d_raw GROUP BY cve_id")
def migration_description(d: Domain) -> DataFrame:
    return reports.migrated(d.raw)


@query("distinct_cast", f"SELECT DISTINCT cve_id, sha256({_TRIM}) AS digest FROM d_raw")
def distinct_cast(d: Domain) -> DataFrame:
    return reports.distinct_descriptions(d.raw)


@query("published_map", "SELECT cve_id, max(published_date) AS published_date FROM d_raw GROUP BY cve_id")
def published_map(d: Domain) -> DataFrame:
    return d.raw.select("cve_id", "published_date").distinct().groupBy("cve_id").agg(F.max("published_date").alias("published_date"))


@query("raw_row_exists", "SELECT raw_description_id FROM d_raw a WHERE EXISTS (SELECT 1 FROM d_raw b WHERE b.cve_id = a.cve_id AND b.raw_description = a.raw_description AND b.run_id = 0)")
def raw_row_exists(d: Domain) -> DataFrame:
    return d.raw.join(d.raw.filter("run_id = 0").select("cve_id", "raw_description"), ["cve_id", "raw_description"], "left_semi").select("raw_description_id")


@query("score_stats", "SELECT cve_id, coalesce(round(median(impact_score), 4), -1.0) AS median, round(min(impact_score), 4) AS min, round(max(impact_score), 4) AS max, round(stddev_pop(impact_score), 4) AS std, round(avg(impact_score), 4) AS mean FROM d_cvss GROUP BY cve_id")
def score_stats(d: Domain) -> DataFrame:
    return reports.score_stats(d.cvss, "cve_id", "impact_score")


@query("grouped_messages", "SELECT cve_id, count(*) AS n FROM d_raw GROUP BY cve_id")
def grouped_messages(d: Domain) -> DataFrame:
    from vexarium.sources.sinks import grouped_json

    x = grouped_json(d.raw.select("cve_id", "raw_description_id", "source_url"))
    return x.select(F.explode(F.from_json("value", "map<string, array<struct<raw_description_id: bigint>>>")).alias("cve_id", "rows")).select("cve_id", F.size("rows").cast("bigint").alias("n"))


@query("version_messages", "SELECT concat('{\"vulnVersionId\":', vuln_version_id, '}') AS value FROM d_version WHERE run_id IN (0, 1)")
def version_messages(d: Domain) -> DataFrame:
    from vexarium.sources.sinks import version_messages as messages

    return messages(d.version.withColumn("status", F.expr("CASE run_id WHEN 0 THEN 'NEW' WHEN 1 THEN 'UPDATED' ELSE 'UNCHANGED' END")))


@query("windowed_events", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_events(d: Domain) -> DataFrame:
    from vexarium.streaming.jobs import windowed_events as windows

    return windows(d.base("events"))


@query("session_events", """SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (
 SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s
 FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events)) GROUP BY user_id, s""")
def session_events(d: Domain) -> DataFrame:
    from vexarium.streaming.jobs import session_events as sessions

    return sessions(d.base("events"))
