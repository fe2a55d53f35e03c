"""Readers and sinks: each query writes domain rows in a source's format into the shared folder and reads them again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexarium.functions.cpe import is_cpe
from vexarium.operators import cvss
from vexarium.plans.bindings import AS_OF, Domain
from vexarium.plans.products import _MEDIANS, _VECTOR, _vectors, cvss_match_median
from vexarium.plans.registry import query
from vexarium.session import shared_folder
from vexarium.sources import readers, sinks

PARTS = 8


def _pages(rows: DataFrame, key: str, field: str, at: str, wrap: str | None = None) -> str:
    """JSON pages with an array of the column `item` under `field`; of the items themselves if `field` is empty."""
    items = lambda: F.collect_list("item") if not field else F.struct(F.collect_list("item").alias(field))
    sinks.documents(rows.select(key, F.struct(F.col("item").alias(wrap)).alias("item") if wrap else "item"), at, PARTS, key, items)
    return at


# ---------------------------------------------------------------- lists


@query("seed_urls", "SELECT DISTINCT source_url AS value FROM d_raw")
def seed_urls(d: Domain) -> DataFrame:
    at = shared_folder(d.spark, "seeds")
    d.raw.select(F.concat(F.lit("  "), "source_url").alias("value")).distinct().write.text(at)
    return readers.lines(d.spark, at)


_HOSTS = "SELECT DISTINCT CASE WHEN raw_description_id % 2 = 0 THEN source ELSE concat(source, '.example.org') END AS value FROM d_raw"


@query("domain_whitelist", f"SELECT value FROM ({_HOSTS}) WHERE length(value) > 5")
def domain_whitelist(d: Domain) -> DataFrame:
    at = shared_folder(d.spark, "whitelist")
    d.raw.select(F.expr("CASE WHEN raw_description_id % 2 = 0 THEN source ELSE concat(source, '.example.org') END").alias("value")).distinct().write.text(at)
    return readers.lines(d.spark, at, longer_than=5)


@query("source_type_file", "SELECT DISTINCT concat(source, '.example.org') AS host, source_type AS type FROM d_raw WHERE source_type <> 'other'")
def source_type_file(d: Domain) -> DataFrame:
    at = shared_folder(d.spark, "types")
    line = F.when(F.col("source_type") == "other", F.col("source")).otherwise(F.concat("source", F.lit(".example.org "), "source_type"))
    d.raw.select(line.alias("value")).distinct().write.text(at)
    return readers.source_types(d.spark, at)


# ---------------------------------------------------------------- registries


_FEED = """SELECT r.raw_description_id AS id, r.cve_id, r.raw_description, r.published_date, r.source_url, r.n_chars % 100 / 10 AS score, r.raw_description_id % 3 AS kind,
 concat('CVSS:3.1/AV:', ['N','L','P'][1 + r.raw_description_id % 3], '/AC:L/PR:N/UI:R/S:U/C:H/I:N/A:', ['N','H'][1 + r.n_chars % 2]) AS vector FROM d_raw r"""


def _feed(d: Domain) -> str:
    """A record for each raw row: every third has a metric of version 3.1, every third of 3.0, the others none."""
    i, n = F.col("raw_description_id"), F.col("n_chars")
    vector = F.concat(F.lit("CVSS:3.1/AV:"), F.get(F.array(*map(F.lit, "NLP")), (i % 3).cast("int")), F.lit("/AC:L/PR:N/UI:R/S:U/C:H/I:N/A:"), F.get(F.array(*map(F.lit, "NH")), (n % 2).cast("int")))
    metric = F.array(F.struct(F.struct(vector.alias("vectorString"), (n % 100 / 10).alias("baseScore"), F.lit("HIGH").alias("baseSeverity")).alias("cvssData"), F.lit(5.9).alias("impactScore"), F.lit(1.6).alias("exploitabilityScore")))
    none = F.lit(None).cast("array<struct<cvssData: struct<vectorString:string, baseScore:double, baseSeverity:string>, impactScore:double, exploitabilityScore:double>>")
    text = lambda x: F.struct(F.lit("en").alias("lang"), x.alias("value"))
    cve = F.struct(
        F.col("cve_id").alias("id"), F.date_format("published_date", "yyyy-MM-dd'T'HH:mm:ss").alias("published"), F.date_format("created_date", "yyyy-MM-dd'T'HH:mm:ss").alias("lastModified"), F.lit("Analyzed").alias("vulnStatus"),
        F.array(text(F.col("raw_description")), text(F.lit("second"))).alias("descriptions"), F.struct(F.when(i % 3 == 0, metric).otherwise(none).alias("cvssMetricV31"), F.when(i % 3 == 1, metric).otherwise(none).alias("cvssMetricV30")).alias("metrics"),
        F.array(F.struct(F.array(text(F.concat(F.lit("CWE-"), (i % 7).cast("string"))), text(F.lit("CWE-x"))).alias("description"))).alias("weaknesses"), F.array(F.struct(F.col("source_url").alias("url")), F.struct(F.col("source_url").alias("url"))).alias("references"),
    )
    return _pages(d.raw.select("source_url", cve.alias("item")), "source_url", "vulnerabilities", shared_folder(d.spark, "feed"), "cve")


_STAMP = "strftime({}, '%Y-%m-%dT%H:%M:%S')"


@query("nvd_feed", f"SELECT cve_id, {_STAMP.format('published_date')} AS published, 'Analyzed' AS status, source_url AS sources FROM ({_FEED})")
def nvd_feed(d: Domain) -> DataFrame:
    return readers.nvd_feed(d.spark, _feed(d)).select("cve_id", "published", "status", F.array_join("sources", ";").alias("sources"))


@query("nvd_details", f"""SELECT cve_id, replace(raw_description, chr(10), '') AS description, {_STAMP.format('published_date')} AS published, CASE WHEN kind < 2 THEN CAST(CAST(score AS DOUBLE) AS STRING) ELSE '' END AS score, CASE WHEN kind < 2 THEN 'HIGH' ELSE '' END AS severity,
 CASE WHEN kind < 2 THEN '5.9' ELSE '' END AS impact_score, CASE WHEN kind < 2 THEN '1.6' ELSE '' END AS exploitability_score, concat('CWE-', id % 7) AS weakness, '' AS advisory, '' AS patch, '' AS exploit FROM ({_FEED})""")
def nvd_details(d: Domain) -> DataFrame:
    return readers.nvd_details(d.spark, _feed(d)).drop("last_modified", "vector", "weaknesses")


@query("nvd_vectors", f"""SELECT cve_id, CAST(CASE WHEN year(published_date) > CAST(substring(cve_id, 5, 4) AS INT) THEN make_date(CAST(substring(cve_id, 5, 4) AS INT), 12, 31) ELSE CAST(published_date AS DATE) END AS STRING) AS published, CAST(CAST(score AS DOUBLE) AS STRING) AS score,
 concat('CWE-', id % 7, ';CWE-x') AS weaknesses, array_to_string(regexp_extract_all(vector, ':([A-Z])', 1), '') AS metrics FROM ({_FEED}) WHERE kind < 2""")
def nvd_vectors(d: Domain) -> DataFrame:
    x = readers.vector_rows(readers.nvd_details(d.spark, _feed(d)))
    return x.select("cve_id", F.col("published").cast("string").alias("published"), "score", F.array_join("weaknesses", ";").alias("weaknesses"), F.array_join("metrics", "").alias("metrics"))


@query("nvd_sources", "SELECT DISTINCT cve_id, source_url FROM d_raw")
def nvd_sources(d: Domain) -> DataFrame:
    return readers.nvd_sources(d.spark, _feed(d))


@query("legacy_sources", "SELECT DISTINCT source_url FROM d_raw")
def legacy_sources(d: Domain) -> DataFrame:
    urls = F.array(F.struct(F.col("source_url").alias("url")), F.struct(F.col("source_url").alias("url")))
    item = F.struct(F.struct(F.struct(urls.alias("reference_data")).alias("references")).alias("cve"))
    return readers.legacy_sources(d.spark, _pages(d.raw.select("source_url", item.alias("item")), "source_url", "CVE_Items", shared_folder(d.spark, "legacy")))


@query("mitre_records", "SELECT cve_id, status AS state FROM d_mitre WHERE substring(cve_id, 5, 4) IN ('2019', '2020', '2021')")
def mitre_records(d: Domain) -> DataFrame:
    """Records of both forms in a tree of folders, of the wanted years."""
    new = F.struct(F.struct(F.col("cve_id").alias("cveId"), F.col("status").alias("state")).alias("cveMetaData"))
    old = F.struct(F.struct(F.col("cve_id").alias("ID"), F.col("status").alias("STATE")).alias("CVE_data_meta"))
    at, late = shared_folder(d.spark, "records"), F.col("last_modified") >= F.lit("2023-02-03").cast("timestamp_ntz")
    for name, form, rows in (("new", new, d.mitre.filter(late)), ("old", old, d.mitre.filter(~late))):
        _pages(rows.select("cve_id", form.alias("item")), "cve_id", "", f"{at}/{name}")
    return readers.mitre_records(d.spark, at, [2019, 2020, 2021])


# ---------------------------------------------------------------- products


@query("product_dictionary_file", "SELECT group_id, vendor, product_name, concat(vendor, ' ', product_name) AS common_title, version, title, '*' AS \"update\", concat('cpe:', group_id, ':', version) AS cpe, '*' AS platform FROM d_dict")
def product_dictionary_file(d: Domain) -> DataFrame:
    x = d.dictionary.select("group_id", "vendor", "product_name", F.concat_ws(" ", "vendor", "product_name").alias("common_title"), "version", "title", F.lit("*").alias("update"), F.concat_ws(":", F.lit("cpe"), "group_id", "version").alias("cpe"), F.lit("*").alias("platform"))
    at = shared_folder(d.spark, "dictionary")
    sinks.product_dictionary(x, at, AS_OF, PARTS)
    return readers.product_dictionary(d.spark, at)


@query("cpe_pages", "SELECT DISTINCT cpe, concat(vendor, ' ', product_name) AS title, vendor, product_name, version FROM d_product")
def cpe_pages(d: Domain) -> DataFrame:
    titles = F.array(F.struct(F.concat_ws(" ", "vendor", "product_name").alias("title"), F.lit("en").alias("lang")), F.struct(F.lit("x").alias("title"), F.lit("ja").alias("lang")))
    x = d.product.select("cpe", "vendor", "product_name").distinct()
    item = F.struct(F.col("cpe").alias("cpeName"), titles.alias("titles"))
    return readers.cpe_pages(d.spark, _pages(x.select("cpe", item.alias("item")), "cpe", "products", shared_folder(d.spark, "platforms"), "cpe"))


@query("valid_products", "SELECT DISTINCT c AS cpe FROM (SELECT CASE product_id % 4 WHEN 0 THEN replace(cpe, 'cpe:2.3:', 'cpe:/') WHEN 1 THEN vendor ELSE cpe END AS c FROM d_product) WHERE c LIKE 'cpe:2.3:%'")
def valid_products(d: Domain) -> DataFrame:
    """Appended in two writes and read back: rows whose platform id fails the pattern are never stored."""
    c = F.expr("CASE product_id % 4 WHEN 0 THEN replace(cpe, 'cpe:2.3:', 'cpe:/') WHEN 1 THEN vendor ELSE cpe END")
    x, at = sinks.valid_products(d.product.select(c.alias("cpe")).distinct()), shared_folder(d.spark, "affected")
    sinks.tables({"product": x.filter(is_cpe("cpe") & F.col("cpe").contains("1"))}, at)
    sinks.tables({"product": x.filter(~F.col("cpe").contains("1"))}, at)
    return d.spark.read.schema("cpe string").parquet(f"{at}/product")


# ---------------------------------------------------------------- exploits, advisories, weaknesses


@query("exploit_file", "SELECT CAST(exploit_id AS STRING) AS exploit_id, concat('A \"flaw\", in ', cve_id) AS description, CAST(CAST(exploit_date AS DATE) AS STRING) AS published, cve_id FROM d_exploit WHERE exploit_id % 3 <> 0")
def exploit_file(d: Domain) -> DataFrame:
    """Rows whose codes are another catalogue's give nothing; of the others one code is a vulnerability's, with dashes of several kinds."""
    code = F.when(F.col("exploit_id") % 3 == 0, "OSVDB-12").when(F.col("exploit_id") % 3 == 1, F.concat(F.lit("OSVDB-1; "), "cve_id")).otherwise(F.translate("cve_id", "-", "–"))
    cells = {"c0": F.col("exploit_id").cast("string"), "c2": F.concat(F.lit('A "flaw", in '), "cve_id"), "c3": F.date_format("exploit_date", "yyyy-MM-dd"), "c11": code}
    at = shared_folder(d.spark, "exploits")
    d.exploit.select(*[cells.get(f"c{i}", F.lit("")).alias(f"c{i}") for i in range(17)]).write.csv(at, header=True, quote='"', escape='"')
    return readers.exploit_csv(d.spark, at)


@query("exploit_store", "SELECT cve_id, exploit_date, exploit_source FROM d_exploit")
def exploit_store(d: Domain) -> DataFrame:
    at = shared_folder(d.spark, "stored")
    sinks.append_accepted(d.exploit, d.exploit.filter("exploit_id % 2 = 1"), ["exploit_id"], at)
    sinks.append_accepted(d.exploit, d.spark.read.parquet(at), ["exploit_id"], at)
    return d.spark.read.parquet(at).select("cve_id", "exploit_date", "exploit_source")


@query("advisory_files", "SELECT cve_id, concat('ADV-', max(raw_description_id)) AS id, any_value('A flaw in ' || cve_id || '. Upgrade.') AS details FROM d_raw GROUP BY cve_id")
def advisory_files(d: Domain) -> DataFrame:
    """Advisories with an alias that is no vulnerability's; block text over two lines."""
    x = d.raw.groupBy("cve_id").agg(F.max("raw_description_id").cast("string").alias("i"))
    lines = [F.lit("---"), F.concat(F.lit("id: ADV-"), "i"), F.lit("details: |"), F.concat(F.lit("  A flaw in "), "cve_id", F.lit(".")), F.lit("  Upgrade."), F.lit("aliases:"), F.concat(F.lit("- "), "cve_id"), F.lit("- GHSA-aaaa-bbbb-cccc"), F.lit('published: "2023-01-02T03:04:05Z"'), F.lit("modified: 2023-02-03")]
    at = shared_folder(d.spark, "advisories")
    x.select(F.concat_ws("\n", *lines).alias("value")).write.text(at)
    return readers.advisories(d.spark, at, "*.txt").select("cve_id", "id", "details")


@query("weakness_edges", "SELECT DISTINCT CAST(raw_description_id AS STRING) AS child, CAST(raw_description_id // 3 AS STRING) AS parent FROM d_raw WHERE raw_description_id % 5 <> 0")
def weakness_edges(d: Domain) -> DataFrame:
    """Every fifth weakness is deprecated; each has a parent and a relation of another nature."""
    i = F.col("raw_description_id")
    related = F.array(F.struct(F.lit("ChildOf").alias("_Nature"), F.expr("CAST(raw_description_id DIV 3 AS STRING)").alias("_CWE_ID")), F.struct(F.lit("PeerOf").alias("_Nature"), F.lit("7").alias("_CWE_ID")))
    x = d.raw.select(i.cast("string").alias("_ID"), F.when(i % 5 == 0, "DEPRECATED: old").otherwise("Weakness").alias("_Name"), F.lit("text").alias("Extended_Description"), F.struct(related.alias("Related_Weakness")).alias("Related_Weaknesses"))
    at = shared_folder(d.spark, "weaknesses")
    x.write.format("xml").option("rootTag", "Weaknesses").option("rowTag", "Weakness").save(at)
    return readers.weaknesses(d.spark, at)[1]


# ---------------------------------------------------------------- crawls, caches, maps


@query("crawl_dumps", "SELECT r.run_date_time AS run_date, cve_id, source_url, source_type FROM d_raw JOIN d_run r USING (run_id)")
def crawl_dumps(d: Domain) -> DataFrame:
    """A folder for each of the five runs, named by its time."""
    at = shared_folder(d.spark, "crawls")
    row = F.struct(F.col("source_url").alias("sourceURL"), F.col("source_type").alias("sourceType"), F.col("raw_description").alias("description"), F.col("published_date").cast("string").alias("publishDate"))
    for k in range(5):
        one = d.raw.filter(F.col("run_id") == k).groupBy("cve_id").agg(F.collect_list(row).alias("rows"))
        sinks.documents(one, f"{at}/run_2023-04-{20 + k}T000000.000001.json", PARTS, "cve_id", lambda: F.map_from_entries(F.collect_list(F.struct("cve_id", "rows"))))
    return readers.crawl_runs(d.spark, f"{at}/*/*").select(F.col("run_date").cast("timestamp_ntz").alias("run_date"), "cve_id", "source_url", "source_type")


@query("patch_url_cache", "SELECT cve_id, string_agg(DISTINCT source_url, ';' ORDER BY source_url) AS urls FROM d_nvd_url GROUP BY cve_id")
def patch_url_cache(d: Domain) -> DataFrame:
    x = d.nvd_url.groupBy("cve_id").agg(F.struct(F.lit(AS_OF).alias("comptime"), F.array_sort(F.collect_set("source_url")).alias("urls")).alias("e"))
    at = shared_folder(d.spark, "cache")
    sinks.documents(x, at, PARTS, "cve_id", lambda: F.map_from_entries(F.collect_list(F.struct("cve_id", "e"))))
    return readers.patch_url_cache(d.spark, at).select("cve_id", F.array_join("urls", ";").alias("urls"))


@query("piped_rows", "SELECT raw_description_id, cve_id, source_url FROM d_raw")
def piped_rows(d: Domain) -> DataFrame:
    at = shared_folder(d.spark, "piped")
    d.raw.select("raw_description_id", "cve_id", "source_url").write.csv(at, sep="|")
    return readers.piped_csv(d.spark, at, "raw_description_id bigint, cve_id string, source_url string")


@query("cvss_map_file", f"SELECT cve_id, vector, coalesce(score, -1.0) AS score FROM ({_VECTOR}) LEFT JOIN ({_MEDIANS}) USING (vector)")
def cvss_map_file(d: Domain) -> DataFrame:
    """Scores looked up in a map that was written as a file of quoted vectors."""
    at = shared_folder(d.spark, "scores")
    cvss_match_median(d).filter("n > 0").select("vector", "median_score").write.csv(at, quote='"', quoteAll=True)
    return cvss.lookup(_vectors(d), readers.cvss_map(d.spark, at)).select("cve_id", "vector", "score")


def _safe(c: str) -> str:
    return f"replace(replace({c}, chr(10), '. '), chr(9), ' ')"


@query("crawl_tsv", f"SELECT CAST(raw_description_id AS STRING) AS raw_description_id, {_safe('raw_description')} AS raw_description, source_url FROM d_raw WHERE trim(raw_description) <> ''")
def crawl_tsv(d: Domain) -> DataFrame:
    at = shared_folder(d.spark, "tsv")
    sinks.crawl_tsv(d.raw.filter("trim(raw_description) <> ''").select("raw_description_id", "raw_description", "source_url"), at)
    line = F.split("value", "\t")
    return d.spark.read.text(at).select(line[0].alias("raw_description_id"), line[1].alias("raw_description"), line[2].alias("source_url"))


@query("run_stats_store", "SELECT run_id, count(*) AS n FROM d_raw GROUP BY run_id")
def run_stats_store(d: Domain) -> DataFrame:
    at = shared_folder(d.spark, "runs")
    for k in (0, 1):
        sinks.tables({"run_history": d.raw.filter(F.col("run_id") % 2 == k).groupBy("run_id").agg(F.count("*").alias("n"))}, at)
    return d.spark.read.parquet(f"{at}/run_history")


@query("arff_rows", """SELECT concat('{0 ', label, ',', string_agg(concat(k, ' ', n), ',' ORDER BY k), '}') AS value FROM (SELECT n AS doc, label, noun_group, count(*) AS n FROM d_vdo GROUP BY ALL) x
 JOIN (SELECT noun_group, row_number() OVER (ORDER BY noun_group) AS k FROM (SELECT DISTINCT noun_group FROM d_vdo)) USING (noun_group) GROUP BY doc, label""")
def arff_rows(d: Domain) -> DataFrame:
    at = shared_folder(d.spark, "matrix")
    counts = d.vdo.groupBy("n", "label", "noun_group").agg(F.count("*").alias("c"))
    x = counts.groupBy("n", "label").agg(F.map_from_entries(F.collect_list(F.struct("noun_group", "c"))).alias("terms")).withColumnRenamed("n", "doc_id")
    sinks.arff(x, at)
    return d.spark.read.text(f"{at}/data")


@query("summary_pages", f"""SELECT 'seclists' AS site, concat('https://seclists.org/fulldisclosure/', y, '/q', q) AS url FROM range(2002, 2024) a(y), range(1, 5) b(q) WHERE y < 2023 OR q <= 2
UNION ALL SELECT 'packetstorm', concat('https://packetstormsecurity.com/files/date/', strftime(DATE '{AS_OF[:10]}' - CAST(k AS INT), '%Y-%m-%d')) FROM range(7) c(k)""")
def summary_pages(d: Domain) -> DataFrame:
    return readers.summary_pages(AS_OF, d.spark)
