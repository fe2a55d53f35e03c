"""The engine's surface: whole jobs over tables, each returning DataFrames. Settings are in EngineConf; nothing is read from the environment."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexarium.functions.versions import ranges
from vexarium.operators import catalog, cvss, divergence, features, filters, pages, patches, products, reconcile, reports

aggregate = reports.daily_aggregate
search = reports.search
parse_pages = pages.parse_pages
run_stats = reports.run_stats


@dataclass(frozen=True)
class EngineConf:
    """as_of stands for the clock. `filters_` are the names of the filters; an unknown name passes everything."""

    as_of: str
    filters_: tuple[str, ...] = filters.LOCAL
    strategy: str = "ONE_BY_ONE"
    method: tuple[str, ...] = ("NB", "LR", "RF")
    approach: str = "ML"
    limit: int = 5000
    min_length: int = 50
    tokens: int = 100
    bases: tuple[str, ...] = field(default=("https://github.com/", "https://gitlab.com/"))


def reconcile_jobs(jobs: DataFrame, raw: DataFrame, vulnerability: DataFrame, conf: EngineConf) -> dict[str, DataFrame]:
    """Filters the raw rows of the jobs' ids in two waves, merges what passed and gives the tables that the new versions write.

    One plan for all ids: both waves, the fold and the date bounds share the partitioning by id."""
    mine = raw.join(jobs.select("cve_id").distinct(), "cve_id", "left_semi")
    done = filters.run_waves(mine, conf.filters_)
    used = filters.to_reconcile(done)
    out = reconcile.version_write(used, reconcile.merge_fold(used, conf.strategy), vulnerability, F.lit(conf.as_of).cast("timestamp_ntz"))
    return out | {"raw_description": done.drop("status_before", "wave")}


def _label_models(docs: DataFrame, training: DataFrame, conf: EngineConf) -> DataFrame:
    """(doc_id, label, p) by supervised models, or by divergence, or by one and then the other where the two best are close."""
    supervised = lambda rows: features.VotingClassifier.fit(rows, conf.method).predict(docs)
    if conf.approach == "ML":
        return supervised(training)
    term = lambda df, key: divergence.histogram(df.select(F.col(key), F.explode(F.split(F.lower("text"), r"\s+")).alias("term")), key)
    model = term(training, "label")
    size = model.select("term").distinct().count()
    by_words = divergence.confidences(divergence.kl_divergence(term(docs.withColumnRenamed("doc_id", "doc"), "doc"), model, size), "kl").select(F.col("doc").alias("doc_id"), "label", F.col("confidence").alias("p"))
    if conf.approach == "IT":
        return by_words
    first, second = (by_words, supervised(training)) if conf.approach == "IT-ML" else (supervised(training), by_words)
    # Where the first opinion's two best labels are close, the second decides between those two.
    close = divergence.close_call(first.withColumnRenamed("doc_id", "doc"), "p").filter("close").select(F.col("doc").alias("doc_id"), F.explode(F.array("first", "second")).alias("label"))
    return first.join(close.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(second.join(close, ["doc_id", "label"], "left_semi"))


def characterize(composites: DataFrame, training: dict[str, DataFrame], scores: DataFrame, exploits: DataFrame, conf: EngineConf) -> dict[str, DataFrame]:
    """Labels of each noun group, severity and exploit status of composites (cve_id, description, status).

    training has (text, label) for each noun group, scores (vector, score). Labels are taken by falling probability until 0.6."""
    chosen = composites.filter((F.char_length("description") >= conf.min_length) & (F.col("status") != "UNCHANGED")).orderBy("cve_id").limit(conf.limit)
    docs = chosen.select(F.col("cve_id").alias("doc_id"), F.col("description").alias("text"))
    parts = []
    for group, rows in sorted(training.items()):
        p = _label_models(docs, rows, conf).withColumnRenamed("doc_id", "doc")
        parts.append(divergence.until_threshold(p, "p").select(F.col("doc").alias("cve_id"), "label", F.lit(group).alias("noun_group"), F.col("p").alias("confidence")))
    labels = parts[0]
    for x in parts[1:]:
        labels = labels.unionByName(x)
    severity = cvss.lookup(cvss.vectors(labels), scores)
    return {"vdo_characteristic": labels, "vdo_set": severity, "ssvc": catalog.exploit_status(chosen, exploits)}


def compare_registry(composites: DataFrame, nvd: DataFrame, mitre: DataFrame) -> dict[str, DataFrame]:
    """Counts by status for both registries, and the time gaps of those that hold an id."""
    return {
        "nvd_counts": reports.registry_counts(composites, nvd, catalog.in_nvd()),
        "mitre_counts": reports.registry_counts(composites, mitre, catalog.in_mitre()),
        "nvd_gaps": catalog.time_gaps(composites, nvd.filter(catalog.in_nvd()), "published_date"),
        "mitre_gaps": catalog.time_gaps(composites, mitre.filter(catalog.in_mitre()), "last_modified"),
    }


def extract_products(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(doc_id, name, group_id, version) from classified words, as word_rules has them.

    Words become products by island, names meet dictionary groups by shared tokens, version words become ranges, and the dictionary
    says which versions they cover; a product without any gets *."""
    found = products.product_islands(products.word_rules(words, dictionary.select("title")))
    groups = products.match_groups(found.select("name"), products.common_title(dictionary))
    named = found.join(groups, "name").select("doc_id", "name", "group_id", F.split("versions", ";").alias("words"))
    r = named.select("doc_id", "name", "group_id", F.explode_outer(ranges("words")).alias("r")).select("doc_id", "name", "group_id", "r.kind", "r.a", "r.b")
    hit = r.filter("kind is not null").join(dictionary.select(F.col("group_id").alias("_g"), "version"), (F.col("group_id") == F.col("_g")) & products.in_range(products.parts("version"), F.col("kind"), products.parts("a"), products.parts("b")) & products.is_version("version"))
    some = hit.select("doc_id", "name", "group_id", "version").distinct()
    rest = named.select("doc_id", "name", "group_id").distinct().join(some, ["doc_id", "name", "group_id"], "left_anti").withColumn("version", F.lit("*"))
    return some.unionByName(rest)


def find_patches(affected: DataFrame, commits: DataFrame, ids: DataFrame, conf: EngineConf) -> dict[str, DataFrame]:
    """Addresses where patches may lie, and the stored form of commits that name a known id."""
    return {"candidates": patches.repository_candidates(affected, conf.bases), "commits": patches.commit_rows(patches.commit_mentions(commits, ids)), "timelines": patches.commit_timeline(commits)}


def find_fixes(stored: DataFrame, registry: DataFrame, fetched: DataFrame) -> dict[str, DataFrame]:
    """Addresses of fix pages, and the fixes on those that were fetched (page_id, url, html)."""
    return {"urls": patches.fix_urls(stored, registry), "fixes": pages.parse_fixes(fetched)}


def match_exploits(exploits: DataFrame, versions: DataFrame, stored: DataFrame) -> DataFrame:
    return catalog.new_exploits(exploits, versions, stored)


def filter_metrics(runs: DataFrame, conf: EngineConf) -> dict[str, DataFrame]:
    """New rows, source types and filter outcomes by crawl run, over raw rows with run_id and status."""
    done = filters.filter_classes(runs, conf.filters_)
    return {"new": reports.new_per_run(runs), "types": reports.source_type_distribution(runs), "filters": reports.filter_stats(done)}
