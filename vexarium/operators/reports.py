"""Aggregate and search reports. Grouped sides are aggregated before they are joined, so no join multiplies rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vexarium.functions.text import jtrim
from vexarium.schema import FAILED, PASSED


def distinct_list(x: Column | str, sep: str = ";") -> Column:
    return F.array_join(F.array_sort(F.collect_set(x)), sep)


def number_text(x: Column | str) -> Column:
    return F.col(x).cast("decimal(12,3)").cast("string") if isinstance(x, str) else x.cast("decimal(12,3)").cast("string")


def latest_run(update: DataFrame, start: str, end: str) -> DataFrame:
    """(vuln_id, run_id, run_date_time): the last run of each vulnerability in the range."""
    inside = F.col("run_date_time").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    return update.filter(inside).groupBy("vuln_id").agg(F.max("run_id").alias("run_id"), F.max("run_date_time").alias("run_date_time"))


def plain_list(x: Column | str, sep: str = ";") -> Column:
    """As distinct_list, but an item for each row."""
    return F.array_join(F.array_sort(F.collect_list(x)), sep)


def is_reportable(description: str = "description", labels: str | None = "vdo_labels", status: str | None = None) -> Column:
    """Neither reserved nor rejected, by text and by status (2), at least 50 bytes long, and characterised."""
    d = F.col(description)
    if status:
        return is_reportable(description, labels) & (F.col(status) != 2)
    ok = d.isNotNull() & ~d.like("%** RESERVED ** This candidate%") & ~d.like("%** REJECT ** DO NOT USE%") & (F.octet_length(d) >= 50)
    return ok & F.col(labels).isNotNull() if labels else ok


@dataclass
class AggregateInputs:
    """The tables of the daily aggregate, all keyed by vuln_id or cve_id."""

    runs: DataFrame
    vulnerabilities: DataFrame
    vdo: DataFrame
    urls: DataFrame
    cvss: DataFrame
    products: DataFrame
    exploits: DataFrame


def daily_aggregate(t: AggregateInputs, start: str, end: str, require_labels: bool = True, distinct: bool = True) -> DataFrame:
    """One row for each vulnerability of the range and each of its exploits, with its lists of labels, links, scores and products.

    Every list is distinct and ordered by itself, so items of two lists don't pair; with distinct=False all lists but the links have an item a row.
    Only the rows of the range's reportable vulnerabilities are gathered: their ids reduce every side first. Where vulnerabilities have a status_id, 2 is left out."""
    wanted = latest_run(t.runs, start, end).join(t.vulnerabilities, "vuln_id").filter(is_reportable(labels=None, status="status_id" if "status_id" in t.vulnerabilities.columns else None))
    ids = wanted.select("cve_id").distinct()
    t = replace(t, **{k: getattr(t, k).join(ids, "cve_id", "left_semi") for k in ("vdo", "urls", "cvss", "products")})
    return _aggregate(t, wanted, require_labels, distinct_list if distinct else plain_list)


_links = distinct_list


def _aggregate(t: AggregateInputs, wanted: DataFrame, require_labels: bool, distinct_list: Callable[..., Column]) -> DataFrame:
    vdo = t.vdo.groupBy("cve_id").agg(distinct_list("label").alias("vdo_labels"), distinct_list(number_text("confidence")).alias("vdo_label_confidences"), distinct_list("noun_group").alias("vdo_noun_groups"))
    urls = t.urls.groupBy("cve_id").agg(_links("source_url").alias("urls"))
    cvss = t.cvss.groupBy("cve_id").agg(distinct_list("severity").alias("base_severities"), distinct_list(number_text("severity_confidence")).alias("severity_confidences"), distinct_list(number_text("impact_score")).alias("impact_scores"))
    products = t.products.groupBy("cve_id").agg(distinct_list(F.col("product_id").cast("string")).alias("product_ids"), distinct_list("cpe").alias("cpes"), distinct_list("version").alias("versions"))
    x = wanted
    for side in (vdo, urls, cvss, products):
        x = x.join(side, "cve_id", "left")
    exploits = t.exploits.select("cve_id", F.col("exploit_date").alias("exploit_publish_date"), F.col("exploit_source").alias("exploit_url"))
    if require_labels:
        x = x.filter("vdo_labels is not null")
    return x.join(exploits, "cve_id", "left")


def run_averages(history: DataFrame) -> DataFrame:
    """One row over run_history (total, added, updated, nvd_gap, mitre_gap): averages to two digits, and the last run's total."""
    mean = lambda c: F.round(F.avg(c), 2).alias(f"avg_{c}")
    return history.agg(*map(mean, ("added", "updated", "nvd_gap", "mitre_gap")), F.max_by("total", "run_id").alias("total"))


def incremental(aggregate: DataFrame, seen: DataFrame) -> DataFrame:
    """Only vulnerabilities that an earlier aggregate hasn't."""
    return aggregate.join(seen.select("vuln_id").distinct(), "vuln_id", "left_anti")


def paired_lists(vdo: DataFrame) -> DataFrame:
    """Label, confidence and group lists of one order, so that their items pair."""
    xs = F.array_sort(F.collect_list(F.struct("label", number_text("confidence").alias("confidence"), "noun_group")))
    g = vdo.groupBy("cve_id").agg(xs.alias("xs"))
    return g.select("cve_id", *[F.array_join(F.col("xs")[k], ";").alias(a) for k, a in (("label", "vdo_labels"), ("confidence", "vdo_label_confidences"), ("noun_group", "vdo_noun_groups"))])


def search_form(cvss: DataFrame, vdo: DataFrame) -> DataFrame:
    """One row: the known severities, and the labels of each noun group."""
    severities = cvss.filter("severity <> 'n/a'").agg(distinct_list("severity").alias("severities"))
    groups = vdo.groupBy("noun_group").agg(distinct_list("label").alias("labels")).agg(F.array_join(F.array_sort(F.collect_list(F.concat("noun_group", F.lit(":"), "labels"))), "|").alias("labels"))
    return severities.crossJoin(groups)


@dataclass
class Criteria:
    """What a search asks for; None and empty mean no condition."""

    before: int | None = None
    after: int | None = None
    keyword: str | None = None
    in_nvd: bool | None = None
    in_mitre: bool | None = None
    severities: tuple[str, ...] = field(default_factory=tuple)
    noun_groups: tuple[str, ...] = field(default_factory=tuple)
    labels: tuple[str, ...] = field(default_factory=tuple)
    start: str | None = None
    end: str | None = None
    limit: int = 100


def _overlaps(column: str, wanted: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.split(F.col(column), ";"), F.array(*map(F.lit, wanted)))


def conditions(c: Criteria) -> list[Column]:
    out = []
    if c.before is not None:
        out.append(F.col("vuln_id") < c.before)
    if c.after is not None:
        out.append(F.col("vuln_id") > c.after)
    if c.keyword:
        word = c.keyword.lower()
        out.append(F.lower("cve_id") == word if "cve-" in word else F.contains(F.lower("description"), F.lit(word)))
    for name in ("in_nvd", "in_mitre"):
        if getattr(c, name) is not None:
            out.append(F.col(name) == getattr(c, name))
    for column, wanted in (("base_severities", c.severities), ("vdo_noun_groups", c.noun_groups), ("vdo_labels", c.labels)):
        if wanted:
            out.append(_overlaps(column, wanted))
    if c.start:
        out.append(F.col("run_date_time") >= F.lit(c.start).cast("timestamp_ntz"))
    if c.end:
        out.append(F.col("run_date_time") <= F.lit(c.end).cast("timestamp_ntz"))
    return out


def search(aggregate: DataFrame, c: Criteria, counted: int = 10_000) -> DataFrame:
    """The `limit` matches of the highest vuln_id (keyset paging by before and after), each with the count of up to `counted` matches."""
    found = aggregate
    for x in conditions(c):
        found = found.filter(x)
    found = found.orderBy(F.desc("vuln_id")).limit(counted)
    n = found.agg(F.count("*").alias("total_matches"))
    return found.orderBy(F.desc("vuln_id")).limit(c.limit).crossJoin(F.broadcast(n))


def registry_counts(ids: DataFrame, registry: DataFrame, inside: Column) -> DataFrame:
    """(status, n, in_registry): how many ids have each status; ids that the registry lacks have the status `absent`."""
    j = ids.select("cve_id").join(registry.select("cve_id", "status", F.lit(True).alias("_there")), "cve_id", "left")
    s = j.select(F.coalesce("status", F.lit("absent")).alias("status"), F.coalesce(inside, F.lit(False)).alias("in_registry"))
    return s.groupBy("status", "in_registry").agg(F.count("*").alias("n"))


def run_stats(composites: DataFrame, compat: bool = False) -> DataFrame:
    """One row over (status, in_nvd, in_mitre, nvd_gap, mitre_gap). compat counts unchanged as updated and averages as 0."""
    n = lambda x: F.count_if(x)
    gap = (lambda c: F.lit(0.0)) if compat else (lambda c: F.coalesce(F.round(F.avg(c), 6), F.lit(0.0)))
    return composites.agg(
        F.count("*").alias("total_cve_count"),
        n(F.col("status") == "NEW").alias("new_cve_count"),
        n(F.col("status") == ("UNCHANGED" if compat else "UPDATED")).alias("updated_cve_count"),
        n(~F.col("in_nvd")).alias("not_in_nvd_count"),
        n(~F.col("in_mitre")).alias("not_in_mitre_count"),
        n(~F.col("in_nvd") & ~F.col("in_mitre")).alias("not_in_both_count"),
        gap("nvd_gap").alias("avg_gap_nvd"),
        gap("mitre_gap").alias("avg_gap_mitre"),
    )


def new_per_run(raw: DataFrame) -> DataFrame:
    """(run_id, n_total, n_new): new are (id, description, url) that no earlier run has; one shuffle by that key."""
    key = F.sha2(F.concat_ws("\x1f", "cve_id", "raw_description", "source_url"), 256)
    first = F.min("run_id").over(Window.partitionBy("_key"))
    x = raw.select("run_id", key.alias("_key")).withColumn("_first", first)
    # Rows repeated within a run count once as new.
    d = x.groupBy("run_id", "_key", "_first").agg(F.count("*").alias("c"))
    return d.groupBy("run_id").agg(F.sum("c").alias("n_total"), F.count_if(F.col("_first") == F.col("run_id")).alias("n_new"))


def source_type_distribution(raw: DataFrame) -> DataFrame:
    """(run_id, a count for each type), user sources apart; absent types are 0."""
    kinds = ["cna", "security_advisory", "third_party", "bug_bounty", "other"]
    return raw.groupBy("run_id").agg(*[F.count_if(F.col("source_type") == k).alias(f"n_{k}") for k in kinds])


def filter_stats(filtered: DataFrame, status: str = "new_status") -> DataFrame:
    """(run_id, counts by outcome, proportion that passed of the filtered)."""
    s = F.col(status)
    x = filtered.groupBy("run_id").agg(F.count_if(~s.isin(PASSED, FAILED)).alias("not_filtered"), F.count_if(s == PASSED).alias("passed"), F.count_if(s == FAILED).alias("failed"), F.count("*").alias("total"))
    done = F.col("passed") + F.col("failed")
    return x.select("*", done.alias("total_filtered"), F.when(done > 0, F.round(F.col("passed") / done, 6)).otherwise(0.0).alias("proportion_passed"))


def score_stats(scores: DataFrame, key: str, value: str) -> DataFrame:
    """Median, extremes, population deviation and mean; -1 for a key without a value."""
    v = F.col(value)
    stats = {"median": F.median(v), "min": F.min(v), "max": F.max(v), "std": F.stddev_pop(v), "mean": F.avg(v)}
    return scores.groupBy(key).agg(*[F.coalesce(F.round(x, 4), F.lit(-1.0)).alias(k) for k, x in stats.items()])


def tag_features(tagged: DataFrame) -> DataFrame:
    """(id, sentences, tags, unknown) from a tagger's words (id, sentence, tag)."""
    return tagged.groupBy("id").agg(F.count_distinct("sentence").alias("sentences"), F.count_distinct("tag").alias("tags"), F.count_if(F.col("tag") == "").alias("unknown"))


def migrated(raw: DataFrame) -> DataFrame:
    """One description of each vulnerability with the flat build string of its sources and its date bounds."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("raw_description_id")), lambda x: x.cast("string")), ",")
    return raw.groupBy("cve_id").agg(F.max("raw_description").alias("description"), F.concat(F.lit("("), ids, F.lit(")")).alias("build"), F.min("created_date").alias("created_date"), F.min("published_date").alias("published_date"), F.max("last_modified_date").alias("last_modified_date"))


def keep_least(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the one of the least `order`, with the number of rows."""
    return df.groupBy(*key).agg(F.min(order).alias(order), F.count("*").alias("n")).filter("n > 1")


def distinct_descriptions(raw: DataFrame) -> DataFrame:
    return raw.select("cve_id", F.sha2(jtrim("raw_description"), 256).alias("digest")).distinct()
