"""Queries over merging, versions, upserts and joins of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexarium.operators import catalog, reconcile, reports
from vexarium.plans.bindings import AS_OF, Domain
from vexarium.plans.registry import query



def _now() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")

_LONGEST = "length(raw_description) DESC, created_date, raw_description_id"


@query("reconcile_simple", f"SELECT cve_id, first(raw_description ORDER BY {_LONGEST}) AS description, count(*) AS n_sources FROM d_raw WHERE source_type <> 'user' GROUP BY cve_id")
def reconcile_simple(d: Domain) -> DataFrame:
    return reconcile.reconcile_simple(d.raw)


_NEST = "repeat('(', CAST(count(*) - 1 AS INT)) || first(CAST(raw_description_id AS STRING) ORDER BY created_date, raw_description_id) || coalesce(string_agg(CASE WHEN r > 1 THEN ',' || raw_description_id || ')' END, '' ORDER BY created_date, raw_description_id), '')"


@query("reconcile_build_string", f"SELECT cve_id, first(raw_description ORDER BY {_LONGEST}) AS description, {_NEST} AS build FROM (SELECT *, row_number() OVER (PARTITION BY cve_id ORDER BY created_date, raw_description_id) AS r FROM d_raw WHERE source_type <> 'user') GROUP BY cve_id")
def reconcile_build_string(d: Domain) -> DataFrame:
    return reconcile.merge_fold(d.raw)


@query("reconcile_resynth", f"SELECT cve_id, first(raw_description ORDER BY {_LONGEST}) AS description, CASE WHEN count(*) > 1 THEN concat('(', string_agg(raw_description_id, ',' ORDER BY created_date, raw_description_id), ')') ELSE CAST(min(raw_description_id) AS STRING) END AS build FROM d_raw WHERE source_type <> 'user' GROUP BY cve_id")
def reconcile_resynth(d: Domain) -> DataFrame:
    return reconcile.merge_fold(d.raw, "RESYNTH")


@query("reconcile_bulk", """SELECT cve_id, CASE WHEN e.cve_id IS NOT NULL THEN concat('(', e.raw_description_id, coalesce(n.ids, ''), ')') END AS build
FROM (SELECT cve_id, min(raw_description_id) AS raw_description_id FROM d_raw GROUP BY cve_id) e
JOIN (SELECT cve_id, string_agg(concat(',', raw_description_id), '' ORDER BY created_date, raw_description_id) AS ids FROM d_raw WHERE raw_description_id % 4 <> 0 GROUP BY cve_id) n USING (cve_id)""")
def reconcile_bulk(d: Domain) -> DataFrame:
    have = d.raw.groupBy("cve_id").agg(F.min_by("raw_description", "raw_description_id").alias("description"), F.min("raw_description_id").cast("string").alias("build"))
    return reconcile.bulk_update(have, d.raw.filter("raw_description_id % 4 <> 0")).filter(F.col("build").contains(",")).select("cve_id", "build")


@query("build_string_leaves", "SELECT cve_id, count(*) AS leaves FROM d_raw WHERE source_type <> 'user' GROUP BY cve_id")
def build_string_leaves(d: Domain) -> DataFrame:
    from vexarium.functions.text import build_leaves

    return reconcile.merge_fold(d.raw).select("cve_id", build_leaves("build").cast("bigint").alias("leaves"))


@query("build_string_canonical")
def build_string_canonical(d: Domain) -> DataFrame:
    return reconcile.merge_fold(d.raw).select("cve_id", reconcile.canonical_build("build").alias("canonical"))


@query("user_edit_latest", "SELECT cve_id, raw_description_id FROM d_raw WHERE source_type = 'user' QUALIFY row_number() OVER (PARTITION BY cve_id ORDER BY created_date DESC, raw_description_id DESC) = 1")
def user_edit_latest(d: Domain) -> DataFrame:
    return reconcile.latest_user_edit(d.raw).select("cve_id", "raw_description_id")


_HIGH = "source_type IN ('cna', 'security_advisory', 'user')"


@query("priority_reset", f"SELECT cve_id, NOT a.h AND b.h AS reset FROM (SELECT cve_id, bool_or({_HIGH}) AS h FROM d_raw WHERE raw_description_id % 4 < 2 GROUP BY cve_id) a JOIN (SELECT cve_id, bool_or({_HIGH}) AS h FROM d_raw WHERE raw_description_id % 4 >= 2 GROUP BY cve_id) b USING (cve_id)")
def priority_reset(d: Domain) -> DataFrame:
    return reconcile.priority_reset(d.raw.filter("raw_description_id % 4 < 2"), d.raw.filter("raw_description_id % 4 >= 2"))


@query("date_bounds", "SELECT cve_id, min(published_date) AS published_date, coalesce(max(last_modified_date), min(created_date)) AS last_modified_date FROM d_raw GROUP BY cve_id")
def date_bounds(d: Domain) -> DataFrame:
    return reconcile.date_bounds(d.raw)


_FRESH = "SELECT DISTINCT cve_id, CASE WHEN n % 3 = 0 THEN 'Analyzed' ELSE 'Received' END AS status FROM d_raw WHERE n % 2 = 0"
_UPSERT = f"SELECT cve_id, coalesce(f.status, o.status) AS status, CASE WHEN f.status IS NOT NULL AND (o.status IS NULL OR o.status <> f.status) THEN TIMESTAMP '{AS_OF}' ELSE o.last_modified END AS last_modified, coalesce(f.status IS NOT NULL AND (o.status IS NULL OR o.status <> f.status), false) AS touched FROM d_nvd o FULL JOIN ({_FRESH}) f USING (cve_id)"


def _upserted(d: Domain) -> DataFrame:
    fresh = d.raw.filter("n % 2 = 0").select("cve_id", F.expr("CASE WHEN n % 3 = 0 THEN 'Analyzed' ELSE 'Received' END").alias("status")).distinct()
    return reconcile.upsert(d.nvd, fresh, _now())


@query("upsert_nvd", _UPSERT)
def upsert_nvd(d: Domain) -> DataFrame:
    return _upserted(d)


@query("upsert_touched", f"SELECT cve_id FROM ({_UPSERT}) WHERE touched AND status = 'Analyzed'")
def upsert_touched(d: Domain) -> DataFrame:
    return _upserted(d).filter(F.col("touched") & catalog.in_nvd()).select("cve_id")


@query("replace_rows", "SELECT cve_id, last_modified FROM d_mitre WHERE cve_id NOT IN (SELECT cve_id FROM d_nvd) UNION ALL SELECT cve_id, last_modified FROM d_nvd")
def replace_rows(d: Domain) -> DataFrame:
    return reconcile.replace_rows(d.mitre.select("cve_id", "last_modified"), d.nvd.select("cve_id", "last_modified"))


@query("previous_version_keys", "SELECT cve_id, vuln_version_id FROM d_version QUALIFY row_number() OVER (PARTITION BY cve_id ORDER BY created_date DESC, vuln_version_id DESC) = 2")
def previous_version_keys(d: Domain) -> DataFrame:
    return reconcile.previous_version(d.version).select("cve_id", "vuln_version_id")


@query("pointer_switch", "SELECT cve_id, arg_max(vuln_version_id, (created_date, vuln_version_id)) AS vuln_version_id FROM d_version GROUP BY cve_id")
def pointer_switch(d: Domain) -> DataFrame:
    return reconcile.current_pointer(d.version)


@query("version_write_bridge", "SELECT cve_id, count(*) AS sources FROM d_raw WHERE source_type <> 'user' GROUP BY cve_id")
def version_write_bridge(d: Domain) -> DataFrame:
    used = d.raw.filter("source_type <> 'user'")
    out = reconcile.version_write(used, reconcile.merge_fold(d.raw), d.vulnerability, _now())
    return out["raw_description_jt"].join(out["description"].select("description_id", "cve_id"), "description_id").groupBy("cve_id").agg(F.count("*").alias("sources"))


@query("used_raw_rows", "SELECT r.raw_description_id, r.cve_id FROM d_vuln v JOIN d_version x USING (vuln_version_id) JOIN d_bridge b ON b.description_id = x.vuln_version_id JOIN d_raw r ON r.raw_description_id = b.raw_description_id")
def used_raw_rows(d: Domain) -> DataFrame:
    return catalog.used_raw_rows(d.vulnerability, d.version, d.bridge, d.raw).select("raw_description_id", "cve_id")


@query("composite_current", "SELECT v.vuln_id, x.cve_id, x.description, x.created_date FROM d_vuln v JOIN d_version x USING (vuln_version_id)")
def composite_current(d: Domain) -> DataFrame:
    return catalog.composite(d.vulnerability, d.version).select("vuln_id", "cve_id", "description", "created_date")


@query("composite_lookup", "SELECT v.vuln_id, x.cve_id, x.created_date FROM d_vuln v JOIN d_version x USING (vuln_version_id) WHERE v.vuln_id = 7")
def composite_lookup(d: Domain) -> DataFrame:
    return catalog.composite(d.vulnerability, d.version).filter("vuln_id = 7").select("vuln_id", "cve_id", "created_date")


@query("version_products", "SELECT v.vuln_version_id, p.cve_id, p.cpe FROM d_product p JOIN d_version v ON p.cve_id = v.cve_id AND p.cpe_set_run = v.run_id")
def version_products(d: Domain) -> DataFrame:
    return catalog.version_products(d.product, d.version).select("vuln_version_id", "cve_id", "cpe")


@query("nvd_attach", f"SELECT n.cve_id, n.status, coalesce(u.s, '') AS sources FROM d_nvd n LEFT JOIN (SELECT cve_id, string_agg(DISTINCT source_url, ';' ORDER BY source_url) AS s FROM d_nvd_url GROUP BY 1) u ON n.cve_id = u.cve_id WHERE n.cve_id IN (SELECT cve_id FROM d_vuln)")
def nvd_attach(d: Domain) -> DataFrame:
    return catalog.nvd_attach(d.vulnerability, d.nvd, d.nvd_url).select("cve_id", "status", F.array_join("sources", ";").alias("sources"))


@query("mitre_attach", "SELECT cve_id, status, last_modified FROM d_mitre WHERE cve_id IN (SELECT cve_id FROM d_vuln)")
def mitre_attach(d: Domain) -> DataFrame:
    return catalog.mitre_attach(d.vulnerability, d.mitre)


@query("nvd_compare_counts", "SELECT coalesce(status, 'absent') AS status, coalesce(status = 'Analyzed', false) AS in_registry, count(*) AS n FROM d_vuln LEFT JOIN d_nvd USING (cve_id) GROUP BY 1, 2")
def nvd_compare_counts(d: Domain) -> DataFrame:
    return reports.registry_counts(d.vulnerability, d.nvd, catalog.in_nvd())


@query("mitre_compare_counts", "SELECT coalesce(status, 'absent') AS status, coalesce(lower(status) = 'public', false) AS in_registry, count(*) AS n FROM d_vuln LEFT JOIN d_mitre USING (cve_id) GROUP BY 1, 2")
def mitre_compare_counts(d: Domain) -> DataFrame:
    return reports.registry_counts(d.vulnerability, d.mitre, catalog.in_mitre())


@query("time_gap_nvd", "SELECT cve_id, datesub('hour', v.created_date, n.published_date) AS timegap FROM d_vuln v JOIN d_nvd n USING (cve_id)")
def time_gap_nvd(d: Domain) -> DataFrame:
    return catalog.time_gaps(d.vulnerability, d.nvd, "published_date")


@query("time_gap_mitre", "SELECT cve_id, datesub('hour', v.created_date, n.last_modified) AS timegap FROM d_vuln v JOIN d_mitre n USING (cve_id)")
def time_gap_mitre(d: Domain) -> DataFrame:
    return catalog.time_gaps(d.vulnerability, d.mitre, "last_modified")


@query("time_gap_exact", "SELECT cve_id, round(epoch_us(n.published_date - v.created_date) / 3.6e9, 4) AS timegap FROM d_vuln v JOIN d_nvd n USING (cve_id)")
def time_gap_exact(d: Domain) -> DataFrame:
    from vexarium.functions.dates import hour_gap_exact

    return d.vulnerability.select("cve_id", "created_date").join(d.nvd.select("cve_id", "published_date"), "cve_id").select("cve_id", F.round(hour_gap_exact("created_date", "published_date"), 4).alias("timegap"))


@query("sourceless_rows", "SELECT vuln_id, cve_id FROM d_vuln WHERE cve_id NOT IN (SELECT cve_id FROM d_nvd_url)")
def sourceless_rows(d: Domain) -> DataFrame:
    return catalog.sourceless(d.vulnerability, d.nvd_url).select("vuln_id", "cve_id")


# A vulnerability has one row for each registry that knows it: none, one or two.
_KNOWN = "SELECT cve_id FROM d_nvd UNION ALL SELECT cve_id FROM d_mitre"


@query("exploit_new", f"SELECT exploit_id, cve_id FROM d_exploit WHERE cve_id IN (SELECT cve_id FROM ({_KNOWN}) GROUP BY cve_id HAVING count(*) = 1) AND exploit_source NOT IN (SELECT source_url FROM d_stored)".replace("d_stored", "(SELECT exploit_source AS source_url FROM d_exploit WHERE contains(exploit_source, '7'))"))
def exploit_new(d: Domain) -> DataFrame:
    rows = d.nvd.select("cve_id").unionByName(d.mitre.select("cve_id"))
    return catalog.new_exploits(d.exploit, rows, d.exploit.filter("contains(exploit_source, '7')")).select("exploit_id", "cve_id")


@query("exploit_status", "SELECT cve_id, CASE WHEN cve_id IN (SELECT cve_id FROM d_exploit) THEN 'POC' ELSE 'NONE' END AS exploit_status FROM d_vuln")
def exploit_status(d: Domain) -> DataFrame:
    return catalog.exploit_status(d.vulnerability, d.exploit)


@query("fix_insert_counts", "SELECT count(DISTINCT source_url) FILTER (WHERE NOT old) AS inserted, count(*) FILTER (WHERE old) AS existing FROM (SELECT source_url, raw_description_id % 3 = 0 AS old FROM d_raw)")
def fix_insert_counts(d: Domain) -> DataFrame:
    rows = d.raw.select("source_url", "cve_id")
    return catalog.append_new(d.raw.filter("raw_description_id % 3 = 0").select("source_url"), rows, ["source_url"])[1]


@query("insert_accepted", "SELECT source_url, cve_id FROM d_raw WHERE raw_description_id % 3 <> 0")
def insert_accepted(d: Domain) -> DataFrame:
    return catalog.append_new(d.raw.filter("raw_description_id % 3 = 0").select("source_url"), d.raw.select("source_url", "cve_id"), ["source_url"])[0]


@query("merge_url_maps", "SELECT cve_id, string_agg(source_url, ';' ORDER BY source_url) AS urls FROM (SELECT cve_id, source_url FROM d_raw UNION ALL SELECT cve_id, source_url FROM d_nvd_url) GROUP BY cve_id")
def merge_url_maps(d: Domain) -> DataFrame:
    return catalog.merge_maps(d.raw.select("cve_id", "source_url"), d.nvd_url).select("cve_id", F.array_join("urls", ";").alias("urls"))


@query("url_counts", "SELECT cve_id, count(*) AS n_urls FROM d_nvd_url GROUP BY cve_id")
def url_counts(d: Domain) -> DataFrame:
    return catalog.merge_maps(d.nvd_url).select("cve_id", F.size("urls").cast("bigint").alias("n_urls"))


@query("affected_union", "SELECT cve_id FROM d_nvd UNION SELECT cve_id FROM d_mitre")
def affected_union(d: Domain) -> DataFrame:
    return d.nvd.select("cve_id").union(d.mitre.select("cve_id")).distinct()


@query("migration_vdo", "SELECT r.cve_id, v.label, v.noun_group, count(*) AS n FROM d_vuln r JOIN d_vdo v USING (cve_id) JOIN d_label l USING (label_id) GROUP BY ALL")
def migration_vdo(d: Domain) -> DataFrame:
    return d.vulnerability.select("cve_id").join(d.vdo, "cve_id").join(d.label.select("label_id"), "label_id").groupBy("cve_id", "label", "noun_group").agg(F.count("*").alias("n"))
