"""Readers for the source formats. Every schema is explicit; nothing is inferred and nothing is fetched."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexarium import schema
from vexarium.functions import cpe
from vexarium.functions.dates import clamp_to_id_year


def jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int = 50, **options: str) -> DataFrame:
    """A database table in `parts` ranges of `key`."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options).load()


def lines(spark: SparkSession, path: str, longer_than: int = 0) -> DataFrame:
    """Seed lists and whitelists: one value a line."""
    return spark.read.text(path).select(F.trim("value").alias("value")).filter(F.char_length("value") > longer_than)


def source_types(spark: SparkSession, path: str) -> DataFrame:
    """(host, type) from lines of two words; shorter lines are left out."""
    w = F.split("value", " +")
    return lines(spark, path).filter(F.size(w) >= 2).select(w[0].alias("host"), w[1].alias("type"))


def nvd_feed(spark: SparkSession, path: str) -> DataFrame:
    """(cve_id, published, last_modified, status, sources) from pages of the registry's feed."""
    c = spark.read.schema(schema.NVD_FEED).json(path, multiLine=True).select(F.explode("vulnerabilities.cve").alias("c"))
    return c.select(F.col("c.id").alias("cve_id"), F.col("c.published").alias("published"), F.col("c.lastModified").alias("last_modified"), F.col("c.vulnStatus").alias("status"), F.array_distinct("c.references.url").alias("sources"))


def nvd_details(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the feed: the twelve text columns of a detail row (description without line feeds, the first weakness, the first
    metric of version 3.1, else 3.0; what is missing is empty, and so are advisory, patch and exploit), with `vector` and `weaknesses` beside them."""
    c = spark.read.schema(schema.NVD_FEED).json(path, multiLine=True).select(F.explode("vulnerabilities.cve").alias("c"))
    m = F.coalesce(F.get("c.metrics.cvssMetricV31", F.lit(0)), F.get("c.metrics.cvssMetricV30", F.lit(0)))
    given = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    named = F.flatten("c.weaknesses.description")["value"]
    return c.select(
        F.col("c.id").alias("cve_id"), F.regexp_replace(F.get("c.descriptions.value", F.lit(0)), "\n", "").alias("description"), F.col("c.published").alias("published"), F.col("c.lastModified").alias("last_modified"),
        given(m["cvssData"]["baseScore"]).alias("score"), given(m["cvssData"]["baseSeverity"]).alias("severity"), given(m["impactScore"]).alias("impact_score"), given(m["exploitabilityScore"]).alias("exploitability_score"),
        given(F.get(F.get("c.weaknesses.description", F.lit(0))["value"], F.lit(0))).alias("weakness"), F.lit("").alias("advisory"), F.lit("").alias("patch"), F.lit("").alias("exploit"),
        m["cvssData"]["vectorString"].alias("vector"), F.coalesce(named, F.array().cast("array<string>")).alias("weaknesses"),
    )


def nvd_sources(spark: SparkSession, path: str) -> DataFrame:
    return nvd_feed(spark, path).select("cve_id", F.explode("sources").alias("source_url")).distinct()


def legacy_sources(spark: SparkSession, path: str) -> DataFrame:
    """(source_url): the distinct references of the feed's older form."""
    s = "CVE_Items array<struct<cve: struct<references: struct<reference_data: array<struct<url:string>>>>>>"
    r = spark.read.schema(s).json(path, multiLine=True).select(F.explode("CVE_Items").alias("i"))
    return r.select(F.explode("i.cve.references.reference_data.url").alias("source_url")).distinct()


def vector_rows(details: DataFrame) -> DataFrame:
    """(cve_id, published, score, weaknesses, metrics): the eight metric values of vectors such as CVSS:3.1/AV:N/…; rows without one are left out.

    A publication after the year in the id is set to that year's last day."""
    values = F.regexp_extract_all("vector", F.lit(r"(?:AV|AC|PR|UI|S|C|I|A):([A-Z])"), 1)
    at = clamp_to_id_year(F.col("published").cast("timestamp_ntz"), "cve_id")
    return details.filter("vector is not null").select("cve_id", at.alias("published"), "score", "weaknesses", values.alias("metrics")).filter(F.size("metrics") == 8)


def mitre_records(spark: SparkSession, path: str, years: list[int] | None = None) -> DataFrame:
    """(cve_id, state) from a tree of records in either form, of the years wanted only."""
    r = spark.read.schema(schema.MITRE_RECORD).option("recursiveFileLookup", True).option("multiLine", True).json(path)
    x = r.select(F.coalesce("cveMetaData.cveId", "CVE_data_meta.ID").alias("cve_id"), F.coalesce("cveMetaData.state", "CVE_data_meta.STATE").alias("state")).filter("cve_id is not null")
    return x if years is None else x.filter(F.regexp_extract("cve_id", r"CVE-(\d{4})-", 1).try_cast("int").isin(years))


def product_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(group_id, vendor, product_name, common_title, version, title, update, cpe, platform) from a dictionary file."""
    p = spark.read.schema(schema.PRODUCT_DICTIONARY).json(path, multiLine=True).select(F.explode("products").alias("group_id", "g"))
    return p.select("group_id", "g.vendor", F.col("g.product").alias("product_name"), F.col("g.commonTitle").alias("common_title"), F.explode("g.versions").alias("version", "v")).select("group_id", "vendor", "product_name", "common_title", "version", "v.title", "v.update", F.col("v.cpeID").alias("cpe"), "v.platform")


def exploit_csv(spark: SparkSession, path: str) -> DataFrame:
    """(exploit_id, description, published, cve_id): a row for each id among the codes of column 11. Quotes are honoured."""
    names = [f"c{i}" for i in range(17)]
    r = spark.read.csv(path, schema=", ".join(f"{n} string" for n in names), header=True, quote='"', escape='"', multiLine=True, enforceSchema=True)
    code = F.translate("code", "–‑\"", "--")
    return r.select(F.col("c0").alias("exploit_id"), F.col("c2").alias("description"), F.col("c3").alias("published"), F.explode(F.split("c11", ";")).alias("code")).select("exploit_id", "description", "published", F.trim(code).alias("cve_id")).filter(F.col("cve_id").rlike(r"^CVE-\d{4}-\d{4,}$"))


def _advisory(text: str) -> dict[str, list[str] | str]:
    """The few keys of an advisory file: scalars, block texts and lists of scalars at the top level."""
    out: dict[str, list[str] | str] = {}
    key = None
    for line in text.splitlines():
        if line and line[0] not in " -#" and ":" in line:
            key, _, value = line.partition(":")
            value = value.strip()
            out[key] = "" if value in ("", "|", "|-", ">", ">-") else value.strip("'\"")
        elif key and line.lstrip().startswith("- ") and (not out[key] or isinstance(out[key], list)):
            out[key] = [*out[key], line.lstrip()[2:].strip().strip("'\"")]
        elif key and isinstance(out[key], str) and line.strip():
            out[key] = (out[key] + " " + line.strip()).strip()
    return out


def advisories(spark: SparkSession, path: str, glob: str = "*.yaml") -> DataFrame:
    """(cve_id, id, details, published, modified, path): a row for each id among the aliases; of an id's files the last path stays.

    A file may hold several documents, parted by lines of three hyphens."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for at, raw in zip(pdf["path"], pdf["content"]):
                for text in re.split(r"(?m)^---\s*$", bytes(raw).decode("utf-8", "replace")):
                    a = _advisory(text)
                    get = lambda k, a=a: str(a.get(k, ""))
                    aliases = a.get("aliases", [])
                    rows += [(c, get("id"), get("details"), get("published"), get("modified"), at) for c in (aliases if isinstance(aliases, list) else [aliases]) if "CVE-" in c]
            yield pd.DataFrame(rows, columns=["cve_id", "id", "details", "published", "modified", "path"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "content")
    x = files.mapInPandas(parse, "cve_id string, id string, details string, published string, modified string, path string")
    return x.groupBy("cve_id").agg(*[F.max_by(c, "path").alias(c) for c in ("id", "details", "published", "modified")], F.max("path").alias("path"))


def weaknesses(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a weakness catalogue in XML: (node, name, description) and (child, parent); deprecated ones are left out."""
    s = "_ID string, _Name string, Extended_Description string, Related_Weaknesses struct<Related_Weakness: array<struct<_Nature:string, _CWE_ID:string>>>"
    w = spark.read.format("xml").option("rowTag", "Weakness").schema(s).load(path).filter(~F.col("_Name").startswith("DEPRECATED"))
    nodes = w.select(F.col("_ID").alias("node"), F.col("_Name").alias("name"), F.col("Extended_Description").alias("description"))
    edges = w.select(F.col("_ID").alias("child"), F.explode("Related_Weaknesses.Related_Weakness").alias("r")).filter("r._Nature = 'ChildOf'").select("child", F.col("r._CWE_ID").alias("parent")).distinct()
    return nodes, edges


def crawl_runs(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows of crawl dumps with run_date from the file name's ending."""
    r = spark.read.text(path, wholetext=True).select(F.from_json("value", schema.CRAWL_DUMP).alias("m"), F.input_file_name().alias("f"))
    when = F.try_to_timestamp(F.regexp_extract("f", r"_(\d{4}-\d{2}-\d{2}T\d{6})\.\d+\.json", 1), F.lit("yyyy-MM-dd'T'HHmmss"))
    return r.select(when.alias("run_date"), F.explode("m").alias("cve_id", "rows")).select("run_date", "cve_id", F.explode("rows").alias("r")).select("run_date", "cve_id", F.col("r.sourceURL").alias("source_url"), F.col("r.sourceType").alias("source_type"), F.col("r.description").alias("raw_description"), F.col("r.publishDate").alias("published"))


def piped_csv(spark: SparkSession, path: str, schema_: str) -> DataFrame:
    return spark.read.csv(path, schema=schema_, sep="|")


def cvss_map(spark: SparkSession, path: str) -> DataFrame:
    """(vector, score) from quoted vectors."""
    return spark.read.csv(path, schema="vector string, score double", quote='"')


def patch_url_cache(spark: SparkSession, path: str) -> DataFrame:
    r = spark.read.text(path, wholetext=True).select(F.from_json("value", schema.PATCH_URL_CACHE).alias("m"))
    return r.select(F.explode("m").alias("cve_id", "e")).select("cve_id", F.col("e.comptime").alias("computed"), "e.urls")


def cpe_pages(spark: SparkSession, path: str) -> DataFrame:
    """(cpe, title, vendor, product_name, version) from pages of the platform dictionary."""
    s = "products array<struct<cpe: struct<cpeName:string, titles: array<struct<title:string, lang:string>>>>>"
    r = spark.read.schema(s).json(path, multiLine=True).select(F.explode("products.cpe").alias("c"))
    return r.select(F.col("c.cpeName").alias("cpe"), F.get("c.titles.title", F.lit(0)).alias("title")).select("*", cpe.vendor("cpe").alias("vendor"), cpe.product("cpe").alias("product_name"), cpe.version("cpe").alias("version"))


def summary_pages(as_of: str, spark: SparkSession, days: int = 7, since: int = 2002) -> DataFrame:
    """(site, url) of the known summary pages: mailing-list quarters by year, and the last `days` days."""
    day = F.lit(as_of).cast("date")
    one = spark.range(1)
    quarters = one.select(F.explode(F.sequence(F.lit(since), F.year(day))).alias("y")).select("y", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("q")).filter((F.col("y") < F.year(day)) | (F.col("q") <= F.quarter(day))).select(F.lit("seclists").alias("site"), F.format_string("https://seclists.org/fulldisclosure/%d/q%d", "y", "q").alias("url"))
    daily = one.select(F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("k")).select(F.lit("packetstorm").alias("site"), F.concat(F.lit("https://packetstormsecurity.com/files/date/"), F.date_format(F.date_sub(day, F.col("k")), "yyyy-MM-dd")).alias("url"))
    return quarters.unionByName(daily)
