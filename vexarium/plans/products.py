"""Queries over products, versions, patches and severity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexarium.functions import versions
from vexarium.functions.cvss import severity_class
from vexarium.operators import cvss, patches, products
from vexarium.plans.bindings import Domain
from vexarium.plans.models import THRESHOLD, labels_to_threshold
from vexarium.plans.registry import query

# ---------------------------------------------------------------- versions and dictionary

_WORDS = "CASE product_id % 6 WHEN 0 THEN concat('v', version, ',') WHEN 1 THEN concat('(', version, ')') WHEN 2 THEN concat(version, '.0') WHEN 3 THEN concat('<', version) WHEN 4 THEN 'before,' ELSE concat(version, 'x') END"
_JUNK = "translate(translate(replace(w, ',', ''), 'v)(abc:rhpltfom=/\\ed;g', ''), '_-', '..')"


@query("version_normalise", f"""SELECT DISTINCT w AS word, CASE WHEN replace(w, ',', '') IN ('after', 'and', 'before', 'between', 'earlier', 'later', 'prior', 'through', 'to', 'version', 'versions') THEN replace(w, ',', '')
 ELSE regexp_replace(regexp_replace(c, '\\.$', ''), '\\.0$', '') END AS normal
FROM (SELECT w, CASE WHEN b LIKE '%.x' THEN b ELSE replace(b, 'x', '') END AS c FROM (SELECT w, CASE WHEN a LIKE '<%' OR a LIKE '>%' THEN a ELSE translate(a, '<>', '') END AS b FROM (SELECT w, {_JUNK} AS a FROM (SELECT {_WORDS} AS w FROM d_product))))""")
def version_normalise(d: Domain) -> DataFrame:
    return d.product.select(F.expr(_WORDS).alias("word")).distinct().select("word", versions.normalise("word").alias("normal"))


_PARTS = "list_transform(string_split({}, '.'), lambda x: CAST(x AS INT))"


@query("version_compare", f"SELECT version, {_PARTS.format('version')} <= [3, 20] AS at_most, {_PARTS.format('version')} > [3] AS above FROM (SELECT DISTINCT version FROM d_product)")
def version_compare(d: Domain) -> DataFrame:
    p = versions.parts("version")
    return d.product.select("version").distinct().select("version", (p <= F.array(F.lit(3), F.lit(20))).alias("at_most"), (p > F.array(F.lit(3))).alias("above"))


@query("version_in_range", f"""SELECT vendor, product_name, version FROM (SELECT *, {_PARTS.format('version')} AS v FROM d_dict) WHERE
 CASE length(group_id) % 4 WHEN 0 THEN v <= [3, 10] WHEN 1 THEN v >= [5] WHEN 2 THEN v >= [2, 1] AND v <= [4, 5] ELSE v = [1, 7, 2] END""")
def version_in_range(d: Domain) -> DataFrame:
    k = F.length("group_id") % 4
    pick = lambda *xs: F.when(k == 0, xs[0]).when(k == 1, xs[1]).when(k == 2, xs[2]).otherwise(xs[3])
    r = d.dictionary.select("group_id").distinct().select("group_id", pick("BEFORE", "AFTER", "THROUGH", "EXACT").alias("kind"), pick("3.10", "5", "4.5", "1.7.2").alias("a"), pick("0", "0", "2.1", "0").alias("b"))
    return products.affected_versions(d.dictionary, r).select("vendor", "product_name", "version")


@query("version_grammar")
def version_grammar(d: Domain) -> DataFrame:
    """Phrases that use each production, over all versions of the dictionary."""
    v = F.col("version")
    k = F.length("group_id") % 8
    phrase = F.when(k == 0, F.concat(F.lit("before "), v)).when(k == 1, F.concat(v, F.lit(" and later"))).when(k == 2, F.concat(F.lit("1.2 through "), v)).when(k == 3, F.concat(F.lit("between 1.0.1 and "), v)).when(k == 4, F.concat(F.lit("< "), v)).when(k == 5, F.concat(v, F.lit("+"))).when(k == 6, F.concat(F.lit("prior to "), v)).otherwise(F.concat(v, F.lit(" and earlier")))
    x = d.dictionary.select("group_id", "version", F.split(phrase, " ").alias("words"))
    return x.select("group_id", "version", F.explode(versions.ranges("words")).alias("r")).select("group_id", "version", "r.kind", "r.a", "r.b")


@query("dictionary_first_entry", "SELECT vendor, product_name, version, concat(vendor, ' ', product_name, ' ', min(n)) AS title FROM d_product GROUP BY vendor, product_name, version")
def dictionary_first_entry(d: Domain) -> DataFrame:
    # One entry is the first of its cpe, so the title is that of the least number.
    x = d.product.groupBy("cpe", "vendor", "product_name").agg(F.min("n").alias("n")).select("cpe", F.concat_ws(" ", "vendor", "product_name", F.col("n").cast("string")).alias("title"))
    return products.dictionary_groups(x)


@query("cpe_common_title", "SELECT group_id, concat(vendor, ' ', replace(product_name, '_', ' ')) || CASE WHEN count(DISTINCT version) = 1 THEN concat(' ', min(version)) ELSE '' END AS common_title, count(DISTINCT version) AS n_versions FROM d_dict GROUP BY group_id, vendor, product_name")
def cpe_common_title(d: Domain) -> DataFrame:
    return products.common_title(d.dictionary)


_NORM = "regexp_replace(lower({}), '[^a-zA-Z0-9 ]', '', 'g')"


@query("cpe_group_match", f"""WITH g AS (SELECT DISTINCT group_id, list_distinct(regexp_split_to_array(trim({_NORM.format("concat(vendor, ' ', replace(product_name, '_', ' '))")}), ' +')) AS t FROM d_dict),
n AS (SELECT name, list_distinct(regexp_split_to_array(trim({_NORM.format('name')}), ' +')) AS t FROM (SELECT DISTINCT concat(upper(substring(p_name, 1, 1)), substring(p_name, 2), ' server') AS name FROM part)),
s AS (SELECT name, group_id, round(count(*) / greatest(any_value(na), any_value(nb)), 6) AS score FROM (SELECT name, len(t) AS na, unnest(t) AS tok FROM n) a JOIN (SELECT group_id, len(t) AS nb, unnest(t) AS tok FROM g) b USING (tok) GROUP BY name, group_id)
SELECT * FROM s QUALIFY rank() OVER (PARTITION BY name ORDER BY score DESC) = 1""".replace("WITH g AS", "SELECT * FROM (WITH g AS") + ")")
def cpe_group_match(d: Domain) -> DataFrame:
    names = d.base("part").select(F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 1000), F.lit(" server")).alias("name"))
    groups = d.dictionary.select("group_id", F.concat_ws(" ", "vendor", F.regexp_replace("product_name", "_", " ")).alias("common_title")).distinct()
    return products.match_groups(names, groups)


@query("cpe_fallback", """SELECT group_id, wanted, CASE WHEN wanted IS NULL THEN '*' ELSE wanted END AS version, CASE WHEN wanted IS NULL THEN 'any' WHEN wanted = '99.99' THEN 'words' ELSE 'dictionary' END AS how
FROM (SELECT DISTINCT group_id, CASE length(version) % 3 WHEN 0 THEN version WHEN 1 THEN '99.99' END AS wanted FROM d_dict)""")
def cpe_fallback(d: Domain) -> DataFrame:
    n = d.dictionary.select("group_id", F.expr("CASE length(version) % 3 WHEN 0 THEN version WHEN 1 THEN '99.99' END").alias("version")).distinct().withColumn("name", F.coalesce("version", F.lit("-")))
    return products.cpe_fallback(n, d.dictionary).select("group_id", F.nullif("name", F.lit("-")).alias("wanted"), "version", "how")


_KIND = "CASE WHEN length(word) % 5 = 1 THEN 'NAME' WHEN length(word) % 5 = 2 THEN 'VERSION' ELSE 'OTHER' END"
_TOK = f"""SELECT doc_id, pos, word, lower(word) AS low, {_KIND} AS kind, length(word) % 10 / 10 + 0.05 AS confidence, length(word) % 4 / 10 AS p_version, length(word) % 3 / 10 AS p_other, regexp_matches(word, '^[A-Z]') AS nnp
FROM (SELECT doc_id, CAST(i AS INT) AS pos, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)))"""


def _classified(d: Domain) -> DataFrame:
    t = d.base("documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    n = F.length("word")
    return t.select("doc_id", (F.col("pos") + 1).alias("pos"), "word", F.expr(_KIND).alias("kind"), (n % 10 / 10 + 0.05).alias("confidence"), (n % 4 / 10).alias("p_version"), (n % 3 / 10).alias("p_other"), F.col("word").rlike("^[A-Z]").alias("nnp"))


@query("product_islands", f"""SELECT doc_id, island, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE kind = 'NAME') AS name, coalesce(string_agg(word, ';' ORDER BY pos) FILTER (WHERE kind = 'VERSION'), '') AS versions
FROM (SELECT *, CAST(sum(CASE WHEN kind = 'NAME' AND coalesce(prev, '') <> 'NAME' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island
 FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM ({_TOK}))) WHERE island > 0 GROUP BY doc_id, island""")
def product_islands(d: Domain) -> DataFrame:
    return products.product_islands(_classified(d))


# The titles of the dictionary are the documents' first three words; their words and neighbours are looked up by position.
_TITLES = "SELECT DISTINCT array_to_string(string_split(text, ' ')[1:3], ' ') AS title FROM documents"
_SPOTS = f"SELECT t, k FROM (SELECT t, unnest(range(1, len(t) + 1)) AS k FROM (SELECT list_filter(string_split_regex(lower(title), '[ \\t\\n\\r]+'), lambda x: x <> '') AS t FROM ({_TITLES}))) WHERE list_position(t, t[k]) = k"
_PASS = {
    "w0": _TOK,
    "sp": _SPOTS,
    "w1": """SELECT *, lead(low) OVER w AS nxt, lag(low) OVER w AS prv FROM w0 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""",
    "w2": """SELECT *, (low, nxt) IN (SELECT t[k], t[k + 1] FROM sp WHERE k < len(t)) AS m_next, (prv, low) IN (SELECT t[k - 1], t[k] FROM sp WHERE k > 1) AS m_prev, low IN (SELECT t[1] FROM sp WHERE len(t) = 1) AS m_one,
 kind = 'NAME' AND confidence < 0.9 AS again, kind = 'OTHER' AND nnp AND low NOT IN ('the', 'a', 'http') AND low NOT LIKE '%http%' AND pos <= 41 AS fresh FROM w1""",
    "w3": "SELECT *, coalesce(m_next, false) AND (again OR fresh) AS c FROM w2",
    "w4": "SELECT *, pos - sum(CASE WHEN c THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS streak FROM w3",
    "w5": "SELECT *, c AND row_number() OVER (PARTITION BY doc_id, streak, c ORDER BY pos) % 2 = 1 AS gives FROM w4",
    "w6": "SELECT *, coalesce(lag(gives) OVER (PARTITION BY doc_id ORDER BY pos), false) AS got FROM w5",
    "w7": """SELECT *, (again OR fresh) AND NOT got AS looks, coalesce(m_next, false) OR coalesce(m_prev, false) OR m_one AS found FROM w6""",
    "w8": """SELECT *, CASE WHEN lead(looks AND coalesce(m_prev, false)) OVER (PARTITION BY doc_id ORDER BY pos) THEN 'NAME' WHEN got THEN CASE WHEN low LIKE '%http%' THEN 'OTHER' ELSE 'NAME' END
 WHEN again THEN CASE WHEN found THEN 'NAME' WHEN p_other >= p_version THEN 'OTHER' ELSE 'VERSION' END WHEN low LIKE '%http%' THEN 'OTHER' WHEN fresh AND found THEN 'NAME' ELSE kind END AS k1 FROM w7""",
    "w9": """SELECT *, CASE WHEN k1 <> 'NAME' AND length(word) > 1 AND lag(k1) OVER w = 'NAME' AND lead(k1) OVER w = 'NAME' THEN 'NAME' ELSE k1 END AS k2 FROM w8 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""",
    "v0": """SELECT doc_id, pos, word, low, CASE WHEN k2 = 'VERSION' AND CASE WHEN kind = 'VERSION' THEN confidence ELSE p_version END < 0.8 THEN 'OTHER' ELSE k2 END AS k FROM w9""",
    "v1": "SELECT *, k = 'OTHER' AND regexp_matches(low, '[0-9]|before|earlier|prior|between|after|newer|older|through|>|=|<|version|v\\.|build') AS cand FROM v0",
    "v2": """SELECT *, last_value(CASE WHEN k <> 'OTHER' OR cand THEN pos END IGNORE NULLS) OVER w AS lp, last_value(CASE WHEN k <> 'OTHER' OR cand THEN k END IGNORE NULLS) OVER w AS lk,
 sum(CASE WHEN k = 'OTHER' AND NOT cand THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM v1 WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "v3": "SELECT *, k = 'VERSION' OR (cand AND coalesce(lk = 'NAME' AND pos - lp <= 30, false)) AS seed FROM v2",
    "v4": "SELECT *, CASE WHEN seed OR (cand AND coalesce(bool_or(seed) OVER (PARTITION BY doc_id, run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)) THEN 'VERSION' ELSE k END AS k3 FROM v3",
}
_RULES = "SELECT * FROM (WITH " + ", ".join(f"{n} AS ({q})" for n, q in _PASS.items()) + """ SELECT doc_id, pos, CASE WHEN k3 <> 'VERSION' AND regexp_matches(low, 'and|or') AND lag(k3) OVER w = 'VERSION' AND lead(k3) OVER w = 'VERSION' THEN 'VERSION' ELSE k3 END AS kind
 FROM v4 WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"""


@query("product_word_rules", _RULES)
def product_word_rules(d: Domain) -> DataFrame:
    titles = d.base("documents").select(F.substring_index("text", " ", 3).alias("title")).distinct()
    return products.word_rules(_classified(d), titles, in_order=True, keep=("doc_id", "pos", "kind"))


@query("word_title_matches", f"SELECT DISTINCT low AS word, array_to_string(t, ' ') AS title FROM ({_TOK}) JOIN ({_SPOTS}) ON low = t[k]")
def word_title_matches(d: Domain) -> DataFrame:
    titles = d.base("documents").select(F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("title")).distinct()
    return products.title_matches(_classified(d), titles)


@query("dictionary_changes", "SELECT count(*) FILTER (WHERE o IS NULL) AS inserted, count(*) FILTER (WHERE o IS NOT NULL AND n IS NOT NULL) AS updated FROM (SELECT DISTINCT group_id, 1 AS o FROM d_dict WHERE length(group_id) % 3 <> 0) FULL JOIN (SELECT DISTINCT group_id, 1 AS n FROM d_dict WHERE length(group_id) % 2 = 0) USING (group_id)")
def dictionary_changes(d: Domain) -> DataFrame:
    g = d.dictionary.select("group_id").distinct()
    return products.dictionary_changes(g.filter("length(group_id) % 3 <> 0"), g.filter("length(group_id) % 2 = 0"))


# ---------------------------------------------------------------- patches


@query("commit_mentions", "SELECT sha, cve_id FROM d_commit WHERE cve_id IN (SELECT cve_id FROM d_nvd)")
def commit_mentions(d: Domain) -> DataFrame:
    return patches.commit_mentions(d.commit.drop("cve_id"), d.nvd).select("sha", "cve_id")


@query("commit_timeline", "SELECT repo, count(*) AS n_commits, string_agg(sha, ';' ORDER BY commit_date, sha) FILTER (WHERE r <= 10 OR r = c) AS timeline FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY commit_date, sha) AS r, count(*) OVER (PARTITION BY repo) AS c FROM d_commit) GROUP BY repo")
def commit_timeline(d: Domain) -> DataFrame:
    return patches.commit_timeline(d.commit).withColumn("n_commits", F.col("n_commits").cast("bigint"))


@query("repository_route", "SELECT repo, CASE WHEN count(*) <= 3 THEN 'scrape' WHEN count(*) <= 6 THEN 'clone' ELSE 'reject' END AS route FROM d_commit GROUP BY repo")
def repository_route(d: Domain) -> DataFrame:
    return d.commit.groupBy("repo").agg(F.count("*").alias("n")).select("repo", patches.repository_route(F.col("n"), 3, 6).alias("route"))


_HOURS = "abs(datesub('hour', n.published_date, c.commit_date))"


@query("time_to_patch", f"SELECT c.sha, concat({_HOURS} // 24, ' days ', {_HOURS} % 24, ' hours') AS time_to_patch FROM d_commit c JOIN d_nvd n USING (cve_id)")
def time_to_patch(d: Domain) -> DataFrame:
    from vexarium.functions.dates import time_to_patch as gap

    return d.commit.join(d.nvd.select("cve_id", "published_date"), "cve_id").select("sha", gap("published_date", "commit_date").alias("time_to_patch"))


@query("repo_candidates", """SELECT cve_id, concat(b, path) AS url FROM (SELECT DISTINCT cve_id, CASE WHEN v = '*' THEN product_name ELSE concat(v, '/', product_name) END AS path FROM (SELECT *, CASE product_id % 5 WHEN 0 THEN '*' ELSE vendor END AS v FROM d_product)),
 (SELECT unnest(['https://github.com/', 'https://gitlab.com/']) AS b)""")
def repo_candidates(d: Domain) -> DataFrame:
    return patches.repository_candidates(d.product.withColumn("vendor", F.expr("CASE product_id % 5 WHEN 0 THEN '*' ELSE vendor END")))


@query("fix_urls", "SELECT cve_id, source_url FROM d_raw UNION SELECT cve_id, source_url FROM d_nvd_url UNION SELECT cve_id, concat('https://nvd.nist.gov/vuln/detail/', cve_id) FROM d_nvd_url")
def fix_urls(d: Domain) -> DataFrame:
    return patches.fix_urls(d.raw, d.nvd_url)


@query("product_mentions", "SELECT product_id, cve_id, contains(lower(d), concat('\"', vendor, '\"')) OR contains(lower(d), concat('\"', product_name, '\"')) AS mentioned FROM (SELECT DISTINCT product_id, cve_id, vendor, product_name, CASE product_id % 3 WHEN 0 THEN concat('The \"', upper(vendor), '\" suite') WHEN 1 THEN concat('Uses \"', product_name, '\"') ELSE concat('For ', vendor) END AS d FROM d_product)")
def product_mentions(d: Domain) -> DataFrame:
    readme = F.expr("""CASE product_id % 3 WHEN 0 THEN concat('The "', upper(vendor), '" suite') WHEN 1 THEN concat('Uses "', product_name, '"') ELSE concat('For ', vendor) END""")
    x = d.product.select("product_id", "cve_id", "vendor", "product_name").distinct()
    return x.select("product_id", "cve_id", patches.mentions_product(readme, F.col("vendor"), F.col("product_name")).alias("mentioned"))


# ---------------------------------------------------------------- severity

_HAS = "list_contains(ls, '{}')"
_H = {k: _HAS.format(v) for k, v in {"pe": "Privilege Escalation", "re": "Read", "id": "Indirect Disclosure", "wr": "Write", "rr": "Resource Removal", "si": "Service Interrupt", "mm": "Man-in-the-Middle", "ce": "Context Escape", "sb": "Sandboxed"}.items()}
_LEVEL = f"""CASE WHEN {_H['pe']} AND (n_impact = 1 OR {_H['re']} OR {_H['id']}) THEN 'H,N,N' WHEN {_H['pe']} AND ({_H['wr']} OR {_H['rr']}) THEN 'N,H,N' WHEN {_H['pe']} AND {_H['si']} THEN 'N,N,H'
 WHEN {_H['re']} OR {_H['id']} THEN 'LH,N,N' WHEN {_H['wr']} OR {_H['rr']} THEN 'N,LH,N' WHEN {_H['si']} THEN 'N,N,LH' ELSE 'N,N,N' END"""
_VECTOR = f"""SELECT cve_id, concat(CASE WHEN {_HAS.format('Remote')} OR {_HAS.format('Limited Rmt')} THEN 'N' WHEN {_HAS.format('Local')} THEN 'L' WHEN {_HAS.format('Physical')} THEN 'P' ELSE 'X' END, ',', CASE WHEN {_H['mm']} THEN 'H' ELSE 'L' END, ',X,X,',
 CASE WHEN (NOT {_H['mm']} AND {_H['ce']}) OR {_H['sb']} THEN 'C' ELSE 'U' END, ',', {_LEVEL}) AS vector
FROM (SELECT cve_id, list(DISTINCT label) AS ls, count(DISTINCT label) FILTER (WHERE noun_group = 'LogicalImpact') AS n_impact FROM (SELECT cve_id, label, noun_group FROM d_vdo JOIN ({THRESHOLD}) t USING (label) WHERE t.doc = n) GROUP BY cve_id)"""


def _vectors(d: Domain) -> DataFrame:
    """Of the labels that are taken until their probabilities reach the threshold."""
    taken = labels_to_threshold(d).withColumnRenamed("doc", "n")
    return cvss.vectors(d.vdo.join(taken, ["n", "label"], "left_semi"))


@query("cvss_partial_vector", _VECTOR)
def cvss_partial_vector(d: Domain) -> DataFrame:
    return _vectors(d)


_DATASET = "SELECT concat_ws(',', ['N','L','P'][1 + o_orderkey % 3], ['L','H'][1 + o_custkey % 2], 'N', 'R', ['U','C'][1 + o_orderkey % 2], ['H','L','N'][1 + o_custkey % 3], ['N','L','H'][1 + o_orderkey % 3], ['N','H'][1 + o_custkey % 2]) AS \"full\", floor(o_totalprice / 1000) / 10 AS score FROM orders"
_POS = " AND ".join(f"(string_split(vector, ',')[{i}] = 'X' OR string_split(vector, ',')[{i}] = string_split(\"full\", ',')[{i}] OR (string_split(vector, ',')[{i}] = 'LH' AND string_split(\"full\", ',')[{i}] IN ('L', 'H')))" for i in range(1, 9))


@query("cvss_match_median", f"SELECT vector, coalesce(round(median(score), 4), -1.0) AS median_score, count(score) AS n FROM (SELECT DISTINCT vector FROM ({_VECTOR})) LEFT JOIN ({_DATASET}) ON {_POS} GROUP BY vector")
def cvss_match_median(d: Domain) -> DataFrame:
    pick = lambda xs, k, m: F.get(F.array(*map(F.lit, xs)), (F.col(k) % m).cast("int"))
    o, c = "o_orderkey", "o_custkey"
    full = F.concat_ws(",", pick("NLP", o, 3), pick("LH", c, 2), F.lit("N"), F.lit("R"), pick("UC", o, 2), pick("HLN", c, 3), pick("NLH", o, 3), pick("NH", c, 2))
    data = d.base("orders").select(full.alias("full"), (F.floor(F.col("o_totalprice") / 1000) / 10).alias("score"))
    return cvss.match_median(_vectors(d), data)


_MEDIANS = f"SELECT vector, round(median(score), 4) AS score FROM (SELECT DISTINCT vector FROM ({_VECTOR})) JOIN ({_DATASET}) ON {_POS} GROUP BY vector"


@query("cvss_lookup", f"SELECT cve_id, vector, coalesce(score, -1.0) AS score, CASE WHEN score IS NULL THEN 'n/a' WHEN score < 4 THEN 'LOW' WHEN score <= 6.5 THEN 'MEDIUM' WHEN score < 9 THEN 'HIGH' ELSE 'CRITICAL' END AS severity FROM ({_VECTOR}) LEFT JOIN ({_MEDIANS}) USING (vector)")
def cvss_lookup(d: Domain) -> DataFrame:
    """The map of vectors to scores is that of the medians of the known vectors that fit."""
    medians = cvss_match_median(d).filter("n > 0").select("vector", F.col("median_score").alias("score"))
    return cvss.lookup(_vectors(d), medians)


@query("severity_class", "SELECT cve_id, impact_score % 11 AS score, CASE WHEN impact_score % 11 < 4 THEN 'LOW' WHEN impact_score % 11 <= 6.5 THEN 'MEDIUM' WHEN impact_score % 11 < 9 THEN 'HIGH' ELSE 'CRITICAL' END AS severity FROM d_cvss")
def severity(d: Domain) -> DataFrame:
    s = F.col("impact_score") % 11
    return d.cvss.select("cve_id", s.alias("score"), severity_class(s).alias("severity"))
