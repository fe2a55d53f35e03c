"""Queries over the filters of raw descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexarium.functions.text import jtrim
from vexarium.operators import filters
from vexarium.plans.bindings import Domain
from vexarium.plans.registry import query

_TRIM = "regexp_replace(raw_description, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"
_ID, _GH = "CVE-\\d{4}-\\d{4,5}", "GHSA-\\w{4}-\\w{4}-\\w{4}"
_MULTI = f"regexp_full_match({_TRIM}, '{_ID}, {_GH}') OR regexp_full_match({_TRIM}, '{_ID}, ({_GH}|{_ID}), and \\d more')"
_GOOD = {
    "blank": f"{_TRIM} <> ''",
    "self_id": "raw_description <> cve_id",
    "integer": "NOT regexp_full_match(raw_description, '\\d+')",
    "multi_cve": f"NOT ({_MULTI})",
    "size": f"length({_TRIM}) <= 1000",
    "pass_through": "true",
}
_ALL = " AND ".join(f"coalesce({x}, false)" for x in _GOOD.values())
_HIGH = "source_type IN ('cna', 'security_advisory', 'user')"
#: A status carried over from an earlier run, so that every state occurs.
_STATUS = "CASE raw_description_id % 7 WHEN 5 THEN 2 WHEN 6 THEN 3 ELSE 0 END"
_NEXT = f"CASE WHEN status = 3 THEN 3 WHEN source_type = 'user' THEN 2 WHEN {_ALL} THEN 2 ELSE 3 END"

for _name, _sql in _GOOD.items():
    _key = {"pass_through": "SIMPLE"}.get(_name, _name.upper())
    query(f"filter_{_name}", f"SELECT raw_description_id, coalesce({_sql}, false) AS passed FROM d_raw")(lambda d, k=_key: d.raw.select("raw_description_id", filters.predicate(k).alias("passed")))


def with_status(d: Domain) -> DataFrame:
    return d.raw.withColumn("status", F.expr(_STATUS))


@query("filter_state", f"SELECT raw_description_id, CAST({_NEXT} AS INT) AS new_status FROM (SELECT *, {_STATUS} AS status FROM d_raw)")
def filter_state(d: Domain) -> DataFrame:
    return with_status(d).select("raw_description_id", filters.next_status(filters.LOCAL).alias("new_status"))


def _classes(part: str) -> str:
    return f"""SELECT raw_description_id, CAST(first_value(v) OVER (PARTITION BY {part} ORDER BY raw_description_id) AS INT) AS new_status
FROM (SELECT *, {_TRIM} AS t, {_NEXT} AS v FROM (SELECT *, {_STATUS} AS status FROM d_raw))"""


@query("filter_equiv_classes", _classes("t"))
def filter_equiv_classes(d: Domain) -> DataFrame:
    return filters.filter_classes(with_status(d)).select("raw_description_id", "new_status")


@query("filter_equiv_by_cve", _classes("t, cve_id"))
def filter_equiv_by_cve(d: Domain) -> DataFrame:
    return filters.filter_classes(with_status(d), by_cve=True).select("raw_description_id", "new_status")


@query("filter_custom_scope", f"SELECT raw_description_id, CAST(CASE WHEN source_type = 'user' OR ({_GOOD['blank']} AND {_GOOD['size']}) THEN 2 ELSE 3 END AS INT) AS new_status FROM d_raw")
def filter_custom_scope(d: Domain) -> DataFrame:
    names = filters.choose("CUSTOM", ("BLANK", "SIZE", "NO_SUCH_FILTER"))
    return d.raw.withColumn("status", F.lit(0)).select("raw_description_id", filters.next_status(names).alias("new_status"))


@query("filter_remote_verdict", "SELECT raw_description_id, CAST(CASE WHEN source_type = 'user' OR (raw_description_id % 11 <> 3 AND coalesce(n_chars // 4, 0) <= 4097) THEN 2 ELSE 3 END AS INT) AS new_status FROM d_raw")
def filter_remote_verdict(d: Domain) -> DataFrame:
    verdicts = F.when(F.col("raw_description_id") % 11 == 3, False).when(F.col("raw_description_id") % 11 == 4, True)
    return d.raw.withColumn("status", F.lit(0)).withColumn("remote_verdict", verdicts).withColumn("remote_tokens", F.expr("n_chars DIV 4")).select("raw_description_id", filters.next_status(filters.choose("REMOTE")).alias("new_status"))


@query("filter_run_counts", f"SELECT count(*) AS num_in, count(DISTINCT {_TRIM}) AS num_distinct, count(*) FILTER (WHERE source_type = 'user' OR ({_ALL})) AS num_passed FROM d_raw")
def filter_run_counts(d: Domain) -> DataFrame:
    x = d.raw.withColumn("status", F.lit(0))
    return filters.run_counts(x.withColumn("new_status", filters.next_status(filters.LOCAL)))


@query("mark_unevaluated", f"SELECT CAST(CASE WHEN status = 0 THEN 1 ELSE status END AS INT) AS status, count(*) AS n, count(*) FILTER (WHERE status = 0) AS changed FROM (SELECT {_STATUS} AS status FROM d_raw) GROUP BY 1")
def mark_unevaluated(d: Domain) -> DataFrame:
    x = with_status(d).withColumn("before", F.col("status"))
    return filters.mark_unevaluated(x).groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("before") != F.col("status")).alias("changed"))


_WAVES = f"""
s AS (SELECT *, CASE WHEN {_STATUS} = 0 THEN 1 ELSE {_STATUS} END AS status0 FROM d_raw),
w1 AS (SELECT *, {_NEXT.replace('status = 3', 'status0 = 3')} AS verdict, status0 NOT IN (2, 3) AND {_HIGH} AS first FROM s),
w2 AS (SELECT *, CASE WHEN first THEN verdict ELSE status0 END AS status1 FROM w1),
w3 AS (SELECT *, bool_or(status1 = 2 AND {_HIGH}) OVER (PARTITION BY cve_id) AS high_passed FROM w2),
w4 AS (SELECT *, NOT first AND status0 NOT IN (2, 3) AND NOT high_passed AS second FROM w3),
w5 AS (SELECT *, CASE WHEN second THEN verdict ELSE status1 END AS status2 FROM w4)"""


def _waves(body: str) -> str:
    # d_raw is named in the chain, so the chain follows the domain tables in one WITH.
    return f"SELECT * FROM (WITH {_WAVES.strip()} {body})"


@query("filter_wave_one", _waves("SELECT raw_description_id, source_type FROM w1 WHERE first"))
def filter_wave_one(d: Domain) -> DataFrame:
    return filters.first_wave(filters.mark_unevaluated(with_status(d))).select("raw_description_id", "source_type")


@query("filter_wave_two", _waves("SELECT raw_description_id, CAST(status2 AS INT) AS status FROM w5 WHERE second"))
def filter_wave_two(d: Domain) -> DataFrame:
    return filters.run_waves(with_status(d)).filter("wave = 2").select("raw_description_id", "status")


@query("to_reconcile", _waves("SELECT raw_description_id, cve_id FROM w5 WHERE status2 = 2 AND status0 <> 2"))
def to_reconcile(d: Domain) -> DataFrame:
    return filters.to_reconcile(filters.run_waves(with_status(d))).select("raw_description_id", "cve_id")


@query("dedupe_malformed", "SELECT cve_id, min(raw_description_id) AS raw_description_id, count(*) AS n FROM d_raw GROUP BY cve_id HAVING count(*) > 1")
def dedupe_malformed(d: Domain) -> DataFrame:
    from vexarium.operators.reports import keep_least

    return keep_least(d.raw, ["cve_id"], "raw_description_id")


@query("malformed_ids", "SELECT raw_description_id, bad_id FROM (SELECT raw_description_id, CASE raw_description_id % 9 WHEN 0 THEN concat(cve_id, ';x') WHEN 1 THEN concat('(', cve_id) ELSE cve_id END AS bad_id FROM d_raw) WHERE bad_id LIKE '%;%' OR bad_id LIKE '%(%'")
def malformed_ids(d: Domain) -> DataFrame:
    bad = F.expr("CASE raw_description_id % 9 WHEN 0 THEN concat(cve_id, ';x') WHEN 1 THEN concat('(', cve_id) ELSE cve_id END")
    return filters.distinct_malformed(d.raw.withColumn("cve_id", bad)).select("raw_description_id", F.col("cve_id").alias("bad_id"))


@query("characterisable", "SELECT cve_id, length(description) AS n FROM d_version WHERE description IS NOT NULL AND length(description) >= 50 AND run_id <> 3")
def characterisable(d: Domain) -> DataFrame:
    return d.version.filter((F.char_length("description") >= 50) & (F.col("run_id") != 3)).select("cve_id", F.char_length("description").cast("bigint").alias("n"))


@query("extractable_tokens", "SELECT vuln_version_id, len(w[1:100]) AS n_tokens, w[1] AS first_token FROM (SELECT vuln_version_id, string_split_regex(" + _TRIM.replace("raw_description", "description") + ", '\\s+') AS w FROM d_version WHERE run_id <> 3 AND " + _TRIM.replace("raw_description", "description") + " <> '')")
def extractable_tokens(d: Domain) -> DataFrame:
    w = F.slice(F.split(jtrim("description"), r"\s+"), 1, 100)
    return d.version.filter((F.col("run_id") != 3) & (jtrim("description") != "")).select("vuln_version_id", F.size(w).cast("bigint").alias("n_tokens"), w[0].alias("first_token"))
