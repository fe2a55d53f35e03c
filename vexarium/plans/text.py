"""Queries over the text, identifier and date functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexarium.functions import cpe, dates, text
from vexarium.operators import catalog, pages
from vexarium.plans.bindings import AS_OF, Domain
from vexarium.plans.registry import query

_PLAIN = "trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("url_whitelist", "SELECT page_id, url FROM pages WHERE NOT regexp_matches(lower(url), '\\.(css|js|gif|jpg|png|mp3|mp4|zip|gz)$') AND (starts_with(lower(url), 'https://www') OR starts_with(lower(url), 'https://blog'))")
def url_whitelist(d: Domain) -> DataFrame:
    allowed = d.spark.createDataFrame([("https://www",), ("https://blog",)], "prefix string")
    return catalog.admit_urls(d.base("pages"), allowed).select("page_id", "url")


@query("source_type_lookup", "SELECT raw_description_id, CASE source WHEN 'src1' THEN 'cna' WHEN 'src2' THEN 'third_party' ELSE 'other' END AS looked_up_type FROM d_raw")
def source_type_lookup(d: Domain) -> DataFrame:
    types = d.spark.createDataFrame([("src1.example.org", "cna"), ("src2.example.org", "third_party")], "host string, type string")
    return catalog.source_types(d.raw, types).select("raw_description_id", "looked_up_type")


@query("cve_extract", f"SELECT page_id, list_aggregate(list_sort(list_distinct(regexp_extract_all({_PLAIN}, '(CVE-[0-9]+-[0-9]+)', 1))), 'string_agg', ';') AS ids, regexp_extract({_PLAIN}, 'CVE-[0-9]+-[0-9]+') AS first_id FROM d_page")
def cve_extract(d: Domain) -> DataFrame:
    t = d.page.select("page_id", text.strip_tags("html").alias("t"))
    return t.select("page_id", F.array_join(F.array_sort(text.all_cve_ids("t")), ";").alias("ids"), text.first_cve_id("t").alias("first_id"))


_BLOCK = "concat(cve_id, CASE doc % 3 WHEN 0 THEN ', ' WHEN 1 THEN ' is followed by ' ELSE ';' END, cve_id, ' and ', cve_id, ' later')"


@query("cve_block_distance", f"SELECT doc AS raw_description_id, len(p) > 2 AND len(list_filter(p[2:len(p) - 1], lambda x: length(x) >= 10)) = 0 AS is_block FROM (SELECT doc, string_split_regex({_BLOCK}, 'CVE-[0-9]+-[0-9]+') AS p FROM (SELECT raw_description_id AS doc, cve_id FROM d_raw))")
def cve_block_distance(d: Domain) -> DataFrame:
    t = F.expr(_BLOCK.replace("doc", "raw_description_id"))
    return d.raw.select("raw_description_id", text.ids_are_block(t).alias("is_block"))


@query("strict_exploit_ids", "SELECT raw_description_id, CASE WHEN regexp_full_match(c, 'CVE-\\d{4}-\\d{4,}') THEN c END AS cve_id FROM (SELECT raw_description_id, trim(replace(replace(CASE raw_description_id % 3 WHEN 0 THEN replace(cve_id, '-', '–') WHEN 1 THEN concat('\"', cve_id, '\" ') ELSE concat('x', cve_id) END, '–', '-'), '\"', '')) AS c FROM d_raw)")
def strict_exploit_ids(d: Domain) -> DataFrame:
    dirty = F.expr("CASE raw_description_id % 3 WHEN 0 THEN replace(cve_id, '-', '–') WHEN 1 THEN concat('\"', cve_id, '\" ') ELSE concat('x', cve_id) END")
    return d.raw.select("raw_description_id", text.strict_exploit_id(dirty).alias("cve_id"))


@query("bulletin_context", f"SELECT page_id, id AS cve_id, substring(t, CAST(greatest(p - 300, 1) AS INT), CAST(p + 300 - greatest(p - 300, 1) AS INT)) AS context FROM (SELECT page_id, t, id, strpos(t, id) AS p FROM (SELECT page_id, t, unnest(list_distinct(regexp_extract_all(t, '(CVE-[0-9]+-[0-9]+)', 1))) AS id FROM (SELECT page_id, {_PLAIN} AS t FROM d_page)))")
def bulletin_context(d: Domain) -> DataFrame:
    return pages.bulletin(d.page).select("page_id", "cve_id", "context")


_DATES = [r"[12]\d{3}-(?:1[0-2]|0[1-9])-(?:3[01]|0[1-9]|[12]\d)"]
_NEAR = "substring(t, strpos(lower(t), 'published'), 40)"


@query("published_date_keyword", f"SELECT page_id, regexp_extract({_NEAR}, '{_DATES[0]}') AS raw_date FROM (SELECT page_id, {_PLAIN} AS t FROM d_page) WHERE strpos(lower(t), 'published') = strpos(lower(t), 'published 2021')")
def published_date_keyword(d: Domain) -> DataFrame:
    t = d.page.select("page_id", text.strip_tags("html").alias("t"))
    return t.filter(F.position(F.lit("published"), F.lower("t")) == F.position(F.lit("published 2021"), F.lower("t"))).select("page_id", dates.publish_date("t").alias("raw_date"))


_FORMS = ["%Y-%m-%dT%H:%M:%SZ", "%b %d, %Y", "%Y/%m/%d %H:%M:%S", "%-d %B %Y", "%m/%d/%Y", "%B %Y", "%d.%m.%Y"]
_JAVA = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "MMM dd, yyyy", "yyyy/MM/dd HH:mm:ss", "d MMMM yyyy", "MM/dd/yyyy", "MMMM yyyy", "dd.MM.yyyy"]
_ROUND = "CASE raw_description_id % 7 WHEN 0 THEN published_date WHEN 2 THEN published_date WHEN 5 THEN date_trunc('month', published_date) ELSE date_trunc('day', published_date) END"


@query("date_multi_format", f"SELECT raw_description_id, {_ROUND} AS parsed FROM d_raw")
def date_multi_format(d: Domain) -> DataFrame:
    k = F.col("raw_description_id") % 7
    written: Column = F.lit(None).cast("string")
    for i, f in enumerate(_JAVA):
        written = F.when(k == i, F.date_format("published_date", f)).otherwise(written)
    return d.raw.select("raw_description_id", dates.parse_timestamp(written).alias("parsed"))


@query("publish_default", f"SELECT raw_description_id, CASE WHEN raw_description_id % 2 = 0 THEN date_trunc('day', published_date) ELSE TIMESTAMP '{AS_OF}' END AS published FROM d_raw")
def publish_default(d: Domain) -> DataFrame:
    t = F.when(F.col("raw_description_id") % 2 == 0, F.date_format("published_date", "MMMM d, yyyy")).otherwise("soon")
    return d.raw.select("raw_description_id", dates.published(t, F.lit(AS_OF).cast("timestamp_ntz")).alias("published"))


@query("relevance_language", "SELECT raw_description_id, regexp_matches(raw_description, 'affect|attack|bypass|cve|execut|fix|flaw|permission|vulnerab|CVE|Mitigat|\\d+\\.(?:\\d+\\.)*\\d+') AS relevant, regexp_matches(t, '\\p{Han}') AS foreign_text FROM (SELECT *, CASE raw_description_id % 5 WHEN 2 THEN concat(raw_description, ' 漏洞') ELSE raw_description END AS t FROM d_raw)")
def relevance_language(d: Domain) -> DataFrame:
    t = F.when(F.col("raw_description_id") % 5 == 2, F.concat("raw_description", F.lit(" 漏洞"))).otherwise(F.col("raw_description"))
    return d.raw.select("raw_description_id", text.is_relevant("raw_description").alias("relevant"), text.has_han(t).alias("foreign_text"))


@query("text_cleanup", "SELECT raw_description_id, lower(regexp_replace(raw_description, '\\s+', '', 'g')) AS squeezed, trim(regexp_replace(regexp_replace(raw_description, '[^\\p{L}]', ' ', 'g'), '\\s+', ' ', 'g')) AS letters FROM d_raw")
def text_cleanup(d: Domain) -> DataFrame:
    return d.raw.select("raw_description_id", text.without_space("raw_description").alias("squeezed"), text.letters_only("raw_description").alias("letters"))


@query("identifier_split", "SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_type, '([A-Z][a-z]+|[a-z]+|[A-Z]+)', 1), lambda x: lower(x)), ' ') AS words FROM part")
def identifier_split(d: Domain) -> DataFrame:
    return d.base("part").select("p_partkey", F.array_join(text.identifier_words("p_type"), " ").alias("words"))


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query("stop_words_removed", f"SELECT raw_description_id, array_to_string(list_filter(string_split(lower(raw_description), ' '), lambda w: w NOT IN ({_STOP})), ' ') AS words FROM d_raw")
def stop_words_removed(d: Domain) -> DataFrame:
    return d.raw.select("raw_description_id", F.array_join(text.remove_words(F.split(F.lower("raw_description"), " "), text.STOP_WORDS), " ").alias("words"))


@query("keyword_window", "SELECT raw_description_id, CASE WHEN strpos(lower(raw_description), 'the') > 0 THEN substring(raw_description, strpos(lower(raw_description), 'the'), 40) ELSE '' END AS near FROM d_raw")
def keyword_window(d: Domain) -> DataFrame:
    return d.raw.select("raw_description_id", text.keyword_window("raw_description", "the").alias("near"))


@query("url_host", "SELECT raw_description_id, regexp_extract(source_url, '^https://([^/]+)/', 1) AS host FROM d_raw")
def url_host(d: Domain) -> DataFrame:
    return d.raw.select("raw_description_id", text.host("source_url").alias("host"))


@query("clamp_year", "SELECT raw_description_id, CAST(CASE WHEN year(published_date) > CAST(substring(cve_id, 5, 4) AS INT) THEN make_date(CAST(substring(cve_id, 5, 4) AS INT), 12, 31) ELSE CAST(published_date AS DATE) END AS STRING) AS published FROM d_raw")
def clamp_year(d: Domain) -> DataFrame:
    return d.raw.select("raw_description_id", dates.clamp_to_id_year("published_date", "cve_id").cast("string").alias("published"))


@query("first_real_date", "SELECT raw_description_id, CAST(CAST(coalesce(last_modified_date, published_date) AS DATE) AS STRING) AS first_date FROM d_raw")
def first_real_date(d: Domain) -> DataFrame:
    zero = F.when(F.col("raw_description_id") % 2 == 0, "0000-00-00 00:00:00")
    return d.raw.select("raw_description_id", dates.first_date(zero, F.col("last_modified_date").cast("string"), F.col("published_date").cast("string")).cast("string").alias("first_date"))


@query("run_end", "SELECT run_id, run_date_time + to_minutes(CAST(run_id * 7 AS INT)) AS run_end, year(run_date_time) AS y, quarter(run_date_time) AS q FROM d_run")
def run_end(d: Domain) -> DataFrame:
    return d.run.select("run_id", F.timestamp_add("MINUTE", F.col("run_id") * 7, F.col("run_date_time")).alias("run_end"), F.year("run_date_time").cast("bigint").alias("y"), F.quarter("run_date_time").cast("bigint").alias("q"))


@query("cache_stale", f"SELECT raw_description_id, date_diff('day', CAST(published_date AS DATE), DATE '{AS_OF[:10]}') >= 14 AS stale FROM d_raw")
def cache_stale(d: Domain) -> DataFrame:
    return d.raw.select("raw_description_id", dates.is_stale("published_date", F.lit(AS_OF[:10]).cast("date"), 14).alias("stale"))


@query("cpe_parse", "SELECT DISTINCT cpe, regexp_extract(cpe, 'cpe:2\\.3:[aho*-]:([^:]*):([^:]*):([^:]*):', 1) AS vendor, regexp_extract(cpe, 'cpe:2\\.3:[aho*-]:([^:]*):([^:]*):([^:]*):', 2) AS product, regexp_extract(cpe, 'cpe:2\\.3:[aho*-]:([^:]*):([^:]*):([^:]*):', 3) AS version FROM d_product")
def cpe_parse(d: Domain) -> DataFrame:
    return d.product.select("cpe").distinct().select("cpe", cpe.vendor("cpe").alias("vendor"), cpe.product("cpe").alias("product"), cpe.version("cpe").alias("version"))


@query("cpe_chunk", "SELECT DISTINCT cpe, string_split(cpe, ':')[5] AS c4, string_split(cpe, ':')[31] AS c30, CASE WHEN string_split(cpe, ':')[7] = '*' THEN '*' ELSE string_split(cpe, ':')[7] END AS c6 FROM d_product")
def cpe_chunk(d: Domain) -> DataFrame:
    return d.product.select("cpe").distinct().select("cpe", cpe.chunk("cpe", 4).alias("c4"), cpe.chunk("cpe", 30).alias("c30"), cpe.handle_dash(cpe.chunk("cpe", 6)).alias("c6"))


@query("purl", "SELECT DISTINCT concat('pkg:', vendor, '/', product_name, CASE WHEN v IN ('*', '') THEN '' ELSE concat('@', v) END) AS purl FROM (SELECT *, CASE product_id % 3 WHEN 0 THEN '*' WHEN 1 THEN '' ELSE version END AS v FROM d_product)")
def purl(d: Domain) -> DataFrame:
    v = F.expr("CASE product_id % 3 WHEN 0 THEN '*' WHEN 1 THEN '' ELSE version END")
    return d.product.select(cpe.purl("vendor", "product_name", v).alias("purl")).distinct()


@query("swid", f"""SELECT DISTINCT '<SoftwareIdentity xmlns="http://standards.iso.org/iso/19770/-2/2015/schema.xsd" name="' || p || '" tagId="' || vendor || '.' || replace(p, ' ', '') || CASE WHEN v IN ('*', '') THEN v ELSE '.' || v END
 || '" version="' || CASE WHEN v = '*' THEN '' ELSE v END || '"><Entity name="' || vendor || '" regid="com.' || vendor || '"><Meta product="' || p || '" colloquialVersion="' || v || '"/><Payload><File name="' || replace(p, ' ', '')
 || '.exe" size="532712" SHA256:hash="{cpe.PAYLOAD}"/></Payload></SoftwareIdentity>' AS swid
FROM (SELECT vendor, replace(product_name, '_', ' ') AS p, CASE product_id % 3 WHEN 0 THEN '*' WHEN 1 THEN '' ELSE version END AS v FROM d_product)""")
def swid(d: Domain) -> DataFrame:
    v, p = F.expr("CASE product_id % 3 WHEN 0 THEN '*' WHEN 1 THEN '' ELSE version END"), F.regexp_replace("product_name", "_", " ")
    return d.product.select(cpe.swid("vendor", p, v).alias("swid")).distinct()


@query("cpe_build", "SELECT DISTINCT cpe AS built FROM d_product")
def cpe_build(d: Domain) -> DataFrame:
    return d.product.select(cpe.build("vendor", "product_name", "version").alias("built")).distinct()


@query("lines_changed", "SELECT sha, list_sum(list_transform(regexp_extract_all(diff, '@@ -\\d+(?:,\\d+)? \\+\\d+,(\\d+) @@', 1), lambda x: CAST(x AS BIGINT)))::BIGINT AS lines_changed, substring(diff, strpos(diff, '@@'), 500) AS uni_diff FROM d_commit")
def lines_changed(d: Domain) -> DataFrame:
    from vexarium.operators.patches import commit_rows

    return commit_rows(d.commit).select("sha", "lines_changed", "uni_diff")


@query("version_token", "SELECT page_id, regexp_extract(t, '(\\d+\\.(?:\\d+\\.)*\\d+)', 1) AS version, length(t) > 3 * 17 * len(regexp_extract_all(t, '(CVE-[0-9]+-[0-9]+)', 1)) AS valuable FROM (SELECT page_id, " + _PLAIN + " AS t FROM d_page)")
def version_token(d: Domain) -> DataFrame:
    t = d.page.select("page_id", text.strip_tags("html").alias("t"))
    return t.select("page_id", F.regexp_extract("t", text.VERSION_TOKEN, 1).alias("version"), text.valuable_sentence("t", F.size(F.regexp_extract_all("t", F.lit(f"({text.CVE_ID})"), 1))).alias("valuable"))
