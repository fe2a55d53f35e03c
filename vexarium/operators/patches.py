"""Patch and fix evidence from commits and fix pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexarium.functions.text import abridge, all_cve_ids, diff_body, lines_changed


def commit_mentions(commits: DataFrame, ids: DataFrame) -> DataFrame:
    """Commits with each known id that their message names. Ids are extracted and joined by equality, not searched for one by one."""
    named = commits.withColumn("cve_id", F.explode(all_cve_ids("message")))
    return named.join(ids.select("cve_id"), "cve_id", "left_semi")


def commit_rows(commits: DataFrame) -> DataFrame:
    """Commits as they are stored: message and diff cut, changed lines counted."""
    return commits.select("cve_id", "repo", "sha", "commit_date", abridge("message").alias("message"), diff_body("diff").alias("uni_diff"), lines_changed("diff").alias("lines_changed"))


def upsert_commits(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """`stored` after `incoming` by sha: a known commit takes the new date, message, diff and counts and keeps its id and repository, an unknown one is
    added. Of several incoming rows of a commit the latest by (commit_date, message) counts. One join by sha; both sides have the same columns."""
    rest = [c for c in stored.columns if c != "sha"]
    latest = incoming.groupBy("sha").agg(F.max_by(F.struct(*rest), F.struct("commit_date", "message")).alias("_n"))
    j = stored.select("sha", F.struct(*rest).alias("_o")).join(latest, "sha", "full_outer")
    kept = {"cve_id", "repo"}
    return j.select("sha", *[(F.coalesce(F.col(f"_o.{c}"), F.col(f"_n.{c}")) if c in kept else F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}"))).alias(c) for c in rest])


def commit_timeline(commits: DataFrame, most: int = 11, newest_first: bool = False) -> DataFrame:
    """(repo, n_commits, timeline): all commits of a repository by time, or the first, the next most - 2, and the last.

    The elapsed form goes back from the newest: most=8, newest_first=True."""
    xs = commits.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("commit_date", "sha"))).alias("xs"))
    if newest_first:
        xs = xs.withColumn("xs", F.reverse("xs"))
    n = F.size("xs")
    chosen = F.when(n <= most, F.col("xs")).otherwise(F.concat(F.slice("xs", 1, most - 1), F.slice("xs", n, 1)))
    return xs.select("repo", n.alias("n_commits"), F.array_join(F.transform(chosen, lambda x: x["sha"]), ";").alias("timeline"))


def repository_route(n_commits: Column, scrape: int = 250, clone: int = 200_000) -> Column:
    return F.when(n_commits <= scrape, "scrape").when(n_commits <= clone, "clone").otherwise("reject")


def repository_candidates(products: DataFrame, bases: tuple[str, ...] = ("https://github.com/", "https://gitlab.com/")) -> DataFrame:
    """(cve_id, url): for each base the vendor's and product's address; a wildcard part is left out."""
    v, p = F.col("vendor"), F.col("product_name")
    path = F.when((v == "*") & (p == "*"), F.lit(None)).when(v == "*", p).when(p == "*", v).otherwise(F.concat(v, F.lit("/"), p))
    x = products.select("cve_id", path.alias("path")).filter("path is not null").distinct()
    return x.select("cve_id", "path", F.explode(F.array(*map(F.lit, bases))).alias("base")).select("cve_id", F.concat("base", "path").alias("url"))


def mentions_product(text: Column, vendor: Column, product: Column) -> Column:
    """Whether a repository's text names the vendor or the product in quotes, in any case."""
    low = F.lower(text)
    quoted = lambda x: F.concat(F.lit('"'), F.lower(x), F.lit('"'))
    return F.contains(low, quoted(vendor)) | F.contains(low, quoted(product))


def fix_urls(stored: DataFrame, registry: DataFrame, reachable: DataFrame | None = None) -> DataFrame:
    """(cve_id, source_url): stored and registry sources and the registry's own page, once each; only those known to be reachable."""
    detail = registry.select("cve_id").distinct().select("cve_id", F.concat(F.lit("https://nvd.nist.gov/vuln/detail/"), "cve_id").alias("source_url"))
    x = stored.select("cve_id", "source_url").unionByName(registry.select("cve_id", "source_url")).unionByName(detail)
    x = x.withColumn("source_url", F.regexp_replace("source_url", "^https?://cxsecurity\\.com/cveshow/", "https://cxsecurity.com/issue/")).filter(F.trim("source_url") != "").distinct()
    return x if reachable is None else x.join(reachable.select("source_url"), "source_url", "left_semi")
