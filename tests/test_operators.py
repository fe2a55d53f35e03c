"""Golden and randomised tests of single operators on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from vexarium.functions import cpe, dates, text, versions
from vexarium.functions.cvss import partial_vector
from vexarium.functions.dom import parse, section
from vexarium.operators import catalog, features, filters, pages, patches, products, reconcile
from vexarium.sources import readers, sinks
from vexarium.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# ---------------------------------------------------------------- versions


@pytest.mark.parametrize(
    "phrase,want",
    [
        ("1.2.3", [("EXACT", "1.2.3", None)]),
        ("before 1.8.9, 1.9 after 9.6", [("AFTER", "9.6", None), ("BEFORE", "1.8.9", None), ("EXACT", "1.9", None)]),
        ("1.1 through 1.5", [("EXACT", "1.1", None), ("THROUGH", "1.1", "1.5")]),
        ("prior to 2.4", [("BEFORE", "2.4", None)]),
        ("2.4 and earlier", [("BEFORE", "2.4", None), ("EXACT", "2.4", None)]),
        ("3.x and later", [("AFTER", "3", None), ("THROUGH", "3", "3.9")]),
        ("between 1.3 and 1.6", [("EXACT", "1.3", None), ("THROUGH", "1.3", "1.6")]),
        ("< 2.5", [("BEFORE", "2.5", None)]),
        ("<2.5 >3.1", [("AFTER", "3.1", None), ("BEFORE", "2.5", None)]),
        ("4.2+", [("AFTER", "4.2", None)]),
        ("through 7.1", [("BEFORE", "7.1", None)]),
        ("5.x", [("THROUGH", "5", "5.9")]),
        ("and", []),
        ("between", []),
        ("", []),
    ],
)
def test_range_grammar(phrase, want):
    assert versions.parse_ranges(phrase.split()) == want


def test_version_order_and_membership(spark):
    rng = random.Random(1)
    v = [[rng.randint(0, 3) for _ in range(rng.randint(1, 3))] for _ in range(120)]
    rows = [(".".join(map(str, a)), ".".join(map(str, b)), ".".join(map(str, c))) for a, b, c in zip(v[::3], v[1::3], v[2::3])]
    d = spark.createDataFrame(rows, "v string, a string, b string")
    p = [versions.parts(c) for c in ("v", "a", "b")]
    got = d.select(*[versions.in_range(p[0], F.lit(k), p[1], p[2]).alias(k) for k in ("BEFORE", "AFTER", "EXACT", "THROUGH")]).collect()
    for r, x in zip(rows, got):
        n, a, b = (list(map(int, t.split("."))) for t in r)
        assert (x["BEFORE"], x["AFTER"], x["EXACT"], x["THROUGH"]) == (n <= a, n >= a, n == a, min(a, b) <= n <= max(a, b))


def test_normal_words_agree(spark):
    words = ["v1.2.3,", "(2.0)", "1.9.2.", "before,", "<2.4.5", "5.x", "1.2x", "2-3_4", "1.0", "earlier", "a>b", "", "x"]
    got = [r["n"] for r in spark.createDataFrame([(w,) for w in words], "w string").select(versions.normalise("w").alias("n")).collect()]
    assert got == [versions.normal_word(w) for w in words]


# ---------------------------------------------------------------- severity vectors


@pytest.mark.parametrize(
    "labels,want",
    [
        (["Remote", "Write", "HPKP/HSTS", "Context Escape", "Guest OS"], "N,L,X,X,C,N,LH,N"),
        (["Limited Rmt", "Privilege Escalation", "Sandboxed", "Man-in-the-Middle", "Firmware"], "N,H,X,X,C,H,N,N"),
        (["Remote"], "N,L,X,X,U,N,N,N"),
        ([], "X,L,X,X,U,N,N,N"),
        (["Privilege Escalation", "Service Interrupt"], "X,L,X,X,U,N,N,H"),
        (["Physical", "Read", "Write"], "P,L,X,X,U,LH,N,N"),
    ],
)
def test_partial_vector(spark, labels, want):
    arr = F.array(*map(F.lit, labels)).cast("array<string>")
    assert ",".join(one(spark, partial_vector(arr))) == want


# ---------------------------------------------------------------- text and dates


def test_filters_against_plain_python(spark):
    texts = ["", " \t\n", "CVE-2021-1234", "12345", "12345a", "CVE-2021-1234, GHSA-abcd-1234-efgh", "CVE-2021-1234, CVE-2021-12345, and 3 more", "x" * 1000, "x" * 1001, " " + "y" * 1000, None]
    d = spark.createDataFrame([(t, "CVE-2021-1234") for t in texts], "raw_description string, cve_id string")
    got = d.select(*[filters.predicate(n).alias(n) for n in filters.LOCAL]).collect()
    want = {"BLANK": [1, 2, 11], "SELF_ID": [3, 11], "INTEGER": [4, 11], "MULTI_CVE": [6, 7, 11], "SIZE": [9, 11]}
    for name, bad in want.items():
        assert [i for i, r in enumerate(got, 1) if not r[name]] == bad, name


@pytest.mark.parametrize(
    "written,want",
    [
        ("2021-03-04T05:06:07.123Z", "2021-03-04 05:06:07.123"),
        ("2021-03-04T05:06", "2021-03-04 05:06:00"),
        ("Mar 4, 2021, 5:06 PM EST", "2021-03-04 17:06:00"),
        ("march 4th, 2021", "2021-03-04 00:00:00"),
        ("March 2021", "2021-03-01 00:00:00"),
        ("4 Mar 2021", "2021-03-04 00:00:00"),
        ("3/4/2021", "2021-03-04 00:00:00"),
        ("04.03.2021", "2021-03-04 00:00:00"),
        ("Thu Mar 04 05:06:07 UTC 2021", "2021-03-04 05:06:07"),
        ("no date", None),
        ("2021-13-40", None),
    ],
)
def test_timestamps(spark, written, want):
    got = one(spark, dates.parse_timestamp(F.lit(written)).cast("string"))
    assert got == want


@pytest.mark.parametrize("said,want", [("Published 2021-03-04 x 2020-01-01", "2021-03-04"), ("seen 01/02/2020. Created: May 5, 2021", "May 5, 2021"), ("March 2021", "March 2021"), ("none", None)])
def test_publish_date(spark, said, want):
    assert one(spark, dates.publish_date(F.lit(said))) == want


def test_text_functions(spark):
    assert one(spark, text.strict_exploit_id(F.lit('"CVE–2021–12345" '))) == "CVE-2021-12345"
    assert one(spark, text.strict_exploit_id(F.lit("see CVE-2021-12345"))) is None
    assert one(spark, text.ids_are_block(F.lit("CVE-2021-1, CVE-2021-2, CVE-2021-3 are bad")))
    assert not one(spark, text.ids_are_block(F.lit("CVE-2021-1 is another thing than CVE-2021-2")))
    assert one(spark, text.lines_changed(F.lit("@@ -1,2 +1,7 @@ a\n@@ -9 +20,3 @@"))) == 10
    assert one(spark, text.build_leaves(F.lit("((1,2),30)"))) == 3
    assert [one(spark, text.fix_header(F.lit(x))) for x in ("Fixes", "Mitigations", "Resolution notes", "Prefix", "Resolved by")] == [True, True, True, False, False]
    assert one(spark, text.csv_safe(F.lit("a'b|c[d]"))) == "a b c d "
    assert one(spark, text.abridge(F.lit("x" * 1001))).endswith("...")
    assert one(spark, cpe.is_generic(F.lit("Server"))) and not one(spark, cpe.is_generic(F.lit("nginx")))
    assert one(spark, cpe.handle_space(F.lit("CVE 2021-77"))) == "CVE-2021-77"


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("adoption", "adopt"), ("controll", "control"), ("rate", "rate"), ("sky", "sky"), ("is", "is")])
def test_porter(word, want):
    assert features.porter(word) == want


# ---------------------------------------------------------------- reconciliation

RAW = "cve_id string, raw_description_id bigint, raw_description string, source_type string, created_date timestamp_ntz, published_date timestamp_ntz, last_modified_date timestamp_ntz"


def raw(spark, rows):
    return spark.createDataFrame([("CVE-1-1", i, "x" * n, t) for i, n, t in rows], "cve_id string, raw_description_id bigint, raw_description string, source_type string").withColumns({"created_date": F.lit("2023-01-01").cast("timestamp_ntz"), "published_date": F.lit("2023-01-01").cast("timestamp_ntz"), "last_modified_date": F.lit(None).cast("timestamp_ntz")})


def test_merge_builds(spark):
    r = raw(spark, [(1, 3, "cna"), (2, 9, "other"), (3, 9, "cna"), (4, 1, "cna"), (5, 2, "cna")])
    got = reconcile.merge_fold(r).first()
    assert got["build"] == "((((1,2),3),4),5)" and len(got["description"]) == 9
    assert reconcile.merge_fold(r, "RESYNTH").first()["build"] == "(1,2,3,4,5)"
    have = reconcile.merge_fold(r.filter("raw_description_id <= 3"))
    assert reconcile.bulk_update(have, r.filter("raw_description_id > 3")).first()["build"] == "(((1,2),3),4,5)"
    assert len(reconcile.reconcile_simple(r).first()["description"]) == 9
    assert reconcile.merge_fold(r.filter("raw_description_id = 4"), "RESYNTH").first()["build"] == "4"


def test_canonical_builds(spark):
    d = spark.createDataFrame([("((1,2),3)",), ("(3,(2,1))",), ("(1,2,3)",), (None,)], "b string")
    a, b, c, n = [r["c"] for r in d.select(reconcile.canonical_build("b").alias("c")).collect()]
    assert a == b != c and n is None


def test_version_write(spark):
    r = raw(spark, [(1, 3, "cna"), (2, 9, "other")])
    old = spark.createDataFrame([("CVE-1-1", 7), ("CVE-1-2", 8)], "cve_id string, vuln_version_id bigint").withColumn("created_date", F.lit("2020-01-01").cast("timestamp_ntz"))
    out = reconcile.version_write(r, reconcile.merge_fold(r), old, F.lit("2023-06-01").cast("timestamp_ntz"))
    v = {x["cve_id"]: x for x in out["vulnerability"].collect()}
    assert v["CVE-1-2"]["vuln_version_id"] == 8 and v["CVE-1-1"]["vuln_version_id"] == out["vulnerability_version"].first()["vuln_version_id"]
    assert v["CVE-1-1"]["created_date"].year == 2020 and out["raw_description_jt"].count() == 2


# ---------------------------------------------------------------- products, patches, trees


def test_cpe_fallbacks(spark):
    dic = spark.createDataFrame([("a:b", "1.0", "A B 1.0"), ("a:b", "2.0", "A B 2.0 service pack 3.5")], "group_id string, version string, title string")
    n = spark.createDataFrame([("p", "a:b", "1.0"), ("q", "a:b", "3.5"), ("r", "a:b", "9.9"), ("s", "a:b", None)], "name string, group_id string, version string")
    assert {(r["name"], r["version"], r["how"]) for r in products.cpe_fallback(n, dic).collect()} == {("p", "1.0", "dictionary"), ("q", "2.0", "title"), ("r", "9.9", "words"), ("s", "*", "any")}


def test_common_title(spark):
    d = spark.createDataFrame([("g", "1", "Big Server 1"), ("g", "2", "big Server 2"), ("h", "1", "One")], "group_id string, version string, title string")
    assert {r["group_id"]: r["common_title"] for r in products.common_title(d).collect()} == {"g": "Big Server", "h": "One"}


def test_timeline_and_tree(spark):
    c = spark.createDataFrame([(1, f"s{i:02d}", i) for i in range(20)], "repo int, sha string, commit_date int")
    t = patches.commit_timeline(c).first()["timeline"].split(";")
    assert t == [f"s{i:02d}" for i in [*range(10), 19]]
    e = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("e", "b"), ("f", "b")], "child string, parent string")
    n = spark.createDataFrame([(x,) for x in "abcdefz"], "node string")
    roots = catalog.roots(e, n)
    assert {tuple(r) for r in catalog.max_children(spark, e, roots).collect()} == {("a", 3), ("z", 0)}


# ---------------------------------------------------------------- pages


def test_dom():
    root = parse("<ul><li>one<li>two <b>x</b></ul><p>a &amp; b<p>c<br/>d<script>no</script><dl><dt>Published<dd>2021</dl>")
    assert [n.text() for n in root.tags("li")] == ["one", "two x"] and root.tags("p")[0].text() == "a & b"
    assert section(root, "published") == "2021" and parse(None).text() == "" and parse("<<a<p" * 50)


@pytest.mark.parametrize(
    "name,html,want",
    [
        ("table", "<table><thead><tr><th>CVE</th></tr></thead><tbody><tr><td>CVE-2021-1</td><td>bad</td></tr><tr><td>none</td></tr></tbody></table>", [("CVE-2021-1", "CVE-2021-1 bad")]),
        ("list", "<ul><li><b>CVE-2021-1</b><p>attack on x</p></li><li>nothing</li></ul>", [("CVE-2021-1", "attack on x")]),
        ("list", "<dl><dt>CVE-2021-3</dt><dd>flaw</dd><dt>other</dt><dd>x</dd></dl>", [("CVE-2021-3", "CVE-2021-3 flaw")]),
        ("accordion", "<div class='accordion'><div>CVE-2021-1 flaw</div><div>CVE-2021-2 fix</div></div>", [("CVE-2021-1", "CVE-2021-1 flaw"), ("CVE-2021-2", "CVE-2021-2 fix")]),
        ("bulletin", "<p>CVE-2021-1 is bad</p>", [("CVE-2021-1", "CVE-2021-1 is bad")]),
        ("description", "<p>A flaw CVE-2021-1 allows attack</p>", [("CVE-2021-1", "A flaw CVE-2021-1 allows attack")]),
        ("description", "<p>漏洞 CVE-2021-1 flaw</p>", []),
        ("description", "<p>CVE-2021-1, CVE-2021-2 are flaws that let anyone execute code in this very long sentence without any doubt at all, and more of the same</p>", 2),
    ],
)
def test_strategies(name, html, want):
    got = [(r[0], r[1]) for r in pages.STRATEGIES[name](parse(html))]
    assert (len(got) == want) if isinstance(want, int) else got == want


@pytest.mark.parametrize(
    "url,name",
    [
        ("https://github.com/advisories/GHSA-1", "github_advisory"), ("https://www.tenable.com/security/tns-1", "tenable_security"), ("https://www.tenable.com/cve/CVE-1", "tenable_cve"), ("https://www.tenable.com/blog/x", "generic"),
        ("https://bugs.gentoo.org/1", "gentoo_bugs"), ("https://www.gentoo.org/news/1", "null"), ("https://access.redhat.com/security/security-updates/", "redhat_updates"), ("https://access.redhat.com/security/cve/CVE-1", "redhat_cve"),
        ("https://access.redhat.com/security/x", "generic"), ("https://cve.mitre.org/x", "null"), ("https://nvd.nist.gov/x", "null"), ("https://example.com/x", "generic"), ("https://www.intel.com/x", "intel"), (None, "null"),
    ],
)
def test_routing(spark, url, name):
    assert one(spark, pages.parser_name(F.lit(url).cast("string"))) == name


def test_source_rule_and_fix_pages(spark):
    html = "<h1>x</h1><h2>Description</h2><p>A flaw.</p><h2>Published</h2><p>2021-03-04</p><h2>Identifier</h2><p>CVE-2021-9</p><h2>Resolution</h2><p>Upgrade.</p>"
    d = spark.createDataFrame([(1, "https://www.arista.com/a", html), (2, "https://nist.gov/a", html), (3, "https://www.arista.com/b", None)], "page_id bigint, url string, html string")
    assert [tuple(r)[2:6] for r in pages.parse_pages(d).collect()] == [("arista", "CVE-2021-9", "A flaw.", "2021-03-04")]
    assert {(r["page_id"], r["fix_description"]) for r in pages.parse_fixes(d).collect()} == {(1, "Upgrade."), (2, "Upgrade.")}


# ---------------------------------------------------------------- sources, sinks, streams


def test_readers(spark, tmp_path):
    (tmp_path / "nvd.json").write_text('{"vulnerabilities":[{"cve":{"id":"CVE-2021-1","published":"2021-01-01","vulnStatus":"Analyzed","descriptions":[{"lang":"en","value":"d"}],"metrics":{"cvssMetricV30":[{"cvssData":{"vectorString":"CVSS:3.0/AV:L/AC:H/PR:L/UI:R/S:C/C:L/I:N/A:H","baseScore":9.8}}]},"references":[{"url":"u"},{"url":"u"},{"url":"v"}]}}]}')
    p = str(tmp_path / "nvd.json")
    assert readers.nvd_feed(spark, p).first()["sources"] == ["u", "v"] and readers.nvd_sources(spark, p).count() == 2
    assert readers.vector_rows(readers.nvd_details(spark, p)).first()["metrics"] == list("LHLRCLNH")
    m = tmp_path / "mitre" / "2021"
    m.mkdir(parents=True)
    (m / "a.json").write_text('{"cveMetaData":{"cveId":"CVE-2021-1","state":"PUBLIC"}}')
    (m / "b.json").write_text('{"CVE_data_meta":{"ID":"CVE-2020-2","STATE":"RESERVED"}}')
    assert {tuple(r) for r in readers.mitre_records(spark, str(tmp_path / "mitre")).collect()} == {("CVE-2021-1", "PUBLIC"), ("CVE-2020-2", "RESERVED")}
    assert readers.mitre_records(spark, str(tmp_path / "mitre"), [2021]).count() == 1
    y = tmp_path / "adv"
    y.mkdir()
    (y / "p.yaml").write_text("id: P-1\ndetails: |\n  some text\n  more\naliases:\n- CVE-2021-1\n- GHSA-x\n- CVE-2021-2\npublished: 2021-01-01\n")
    assert {(r["cve_id"], r["details"]) for r in readers.advisories(spark, str(y)).collect()} == {("CVE-2021-1", "some text more"), ("CVE-2021-2", "some text more")}
    (tmp_path / "x.csv").write_text("id,file,description,date,a,b,c,d,e,f,g,codes,h,i,j,k,l\n1,f,\"a, b\",2021-01-01,,,,,,,,CVE-2021-1;OSVDB-1;CVE–2021–2222,,,,,\n")
    assert {(r["description"], r["cve_id"]) for r in readers.exploit_csv(spark, str(tmp_path / "x.csv")).collect()} == {("a, b", "CVE-2021-2222")}
    (tmp_path / "types").write_text("a.org cna\nbad\nb.org third_party\n")
    assert readers.source_types(spark, str(tmp_path / "types")).count() == 2
    (tmp_path / "cwe.xml").write_text('<W><Weakness ID="1" Name="A"/><Weakness ID="2" Name="B"><Related_Weaknesses><Related_Weakness Nature="ChildOf" CWE_ID="1"/></Related_Weaknesses></Weakness><Weakness ID="3" Name="DEPRECATED: x"/></W>')
    nodes, edges = readers.weaknesses(spark, str(tmp_path / "cwe.xml"))
    assert nodes.count() == 2 and [tuple(r) for r in edges.collect()] == [("2", "1")]
    (tmp_path / "run_2023-01-02T030405.000001.json").write_text('{"CVE-2021-1":[{"sourceURL":"u","sourceType":"cna","description":"d"}]}')
    r = readers.crawl_runs(spark, str(tmp_path / "run_*.json")).first()
    assert str(r["run_date"]) == "2023-01-02 03:04:05" and r["source_url"] == "u"
    (tmp_path / "dict.json").write_text('{"compTime":"t","products":{"a:b":{"vendor":"a","product":"b","commonTitle":"A B","versions":{"1.0":{"title":"A B 1.0","cpeID":"c"}}}}}')
    assert readers.product_dictionary(spark, str(tmp_path / "dict.json")).first()["title"] == "A B 1.0"


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("CVE-1-1", "u", "a\tb\nc"), ("CVE-1-1", "v", "d")], "cve_id string, source_url string, raw_description string")
    sinks.crawl_tsv(d.limit(1), str(tmp_path / "tsv"))
    assert spark.read.text(str(tmp_path / "tsv")).first()[0] == "CVE-1-1\tu\ta b. c"
    assert sinks.grouped_json(d).first()["value"].startswith('{"CVE-1-1":[{')
    at = str(tmp_path / "t")
    sinks.snapshot(d.limit(1), at)
    sinks.append_accepted(d, spark.read.parquet(at), ["source_url"], at)
    assert spark.read.parquet(at).count() == 2


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text('["CVE-1-1","CVE-1-2"]\n')
    (src / "b.txt").write_text('["CVE-1-2","CVE-1-3"]\n')
    q = jobs.run_batches(jobs.distinct_jobs(jobs.id_stream(spark, str(src))), lambda b: b.select("cve_id"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert sorted(r["cve_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["CVE-1-1", "CVE-1-2", "CVE-1-3"]


def test_classifiers(spark):
    rows = [(i, "remote attack over network" if i % 2 else "local user reads file", "net" if i % 2 else "loc") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, label string")
    got = features.VotingClassifier.fit(d, ("NB", "LR", "DT")).predict(d)
    best = {r["doc_id"]: r["label"] for r in got.filter("p > 0.5").collect()}
    assert all(best[i] == y for i, _, y in rows)


# ---------------------------------------------------------------- word rules against the loops they stand for


def loop_rules(rows, titles, near=30, reach=41):
    """rows of one document: dicts in order; the two passes word by word, with what each changes for the next."""
    words = [r["word"] for r in rows]
    kind, conf = [r["kind"] for r in rows], [r["confidence"] for r in rows]
    titles = [t.lower().split() for t in titles]

    def fits(i):
        low, found = words[i].lower(), False
        for t in titles:
            if low not in t:
                continue
            k = t.index(low)
            if len(t) == 1:
                found = True
                continue
            if k < len(t) - 1 and i + 1 < len(words) and words[i + 1].lower() == t[k + 1]:
                kind[i + 1], conf[i + 1], found = "NAME", 1, True
            if k > 0 and i > 0 and words[i - 1].lower() == t[k - 1]:
                kind[i - 1], conf[i - 1], found = "NAME", 1, True
        return found

    for i, r in enumerate(rows):
        if kind[i] == "NAME" and conf[i] < 0.9:
            if not fits(i):
                kind[i], conf[i] = ("OTHER", r["p_other"]) if r["p_other"] >= r["p_version"] else ("VERSION", r["p_version"])
        elif "http" in words[i].lower():
            kind[i] = "OTHER"
        elif r["nnp"] and words[i].lower() not in ("the", "a", "http") and i < reach and kind[i] == "OTHER" and fits(i):
            kind[i] = "NAME"
    for i in range(1, len(rows) - 1):
        if kind[i] != "NAME" and len(words[i]) > 1 and kind[i - 1] == kind[i + 1] == "NAME":
            kind[i] = "NAME"
    for i in range(len(rows)):
        if kind[i] == "VERSION" and conf[i] < 0.8:
            kind[i] = "OTHER"
    since, prev = -1, False
    for i, w in enumerate(words):
        since += since >= 0
        low = w.lower()
        if kind[i] == "OTHER" and (any(c.isdigit() for c in low) or any(t in low for t in products.TRIGGERS)):
            if 0 <= since <= near or prev:
                kind[i], prev, since = "VERSION", True, -1
        elif kind[i] == "NAME":
            since = 0
        elif kind[i] == "VERSION":
            prev, since = True, -1
        else:
            prev = False
    for i in range(1, len(rows) - 1):
        if kind[i] != "VERSION" and ("and" in words[i].lower() or "or" in words[i].lower()) and kind[i - 1] == kind[i + 1] == "VERSION":
            kind[i] = "VERSION"
    return kind


def test_word_rules_are_the_loops(spark):
    rng = random.Random(4)
    vocabulary = ["Apache", "Tomcat", "Server", "Web", "the", "http://x", "1.2", "before", "and", "or", "x", "plain", "flaw", "in", "v.2", "Vendor"]
    titles = ["Apache Tomcat Server", "Web Server", "Tomcat", "vendor web apache", "x server x", "plain"]
    rows, want = [], []
    for d in range(150):
        mine = []
        for pos in range(1, rng.choice([1, 2, 12, 60]) + 1):
            w = rng.choice(vocabulary)
            mine.append({"doc_id": d, "pos": pos, "word": w, "kind": rng.choice(["NAME", "NAME", "VERSION", "OTHER", "OTHER", "OTHER"]), "confidence": rng.choice([0.5, 0.85, 0.95]), "p_version": rng.choice([0.1, 0.4, 0.85]), "p_other": rng.choice([0.2, 0.4]), "nnp": w[0].isupper()})
        rows += mine
        want += [(d, r["pos"], k) for r, k in zip(mine, loop_rules(mine, titles))]
    got = products.word_rules(spark.createDataFrame(rows), spark.createDataFrame([(t,) for t in titles], "title string")).select("doc_id", "pos", "kind").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_word_rules_move_no_words_and_join_many_titles(spark):
    rng = random.Random(5)
    vocabulary = ["Apache", "Tomcat", "Server", "Web", "the", "http://x", "1.2", "before", "and", "or", "x", "flaw", "v.2"]
    titles = ["Apache Tomcat Server", "Web Server", "Tomcat", "server web apache", "x server x"]
    rows, want = [], []
    for d in range(100):
        mine = [{"doc_id": d, "pos": pos, "word": (w := rng.choice(vocabulary)), "kind": rng.choice(["NAME", "VERSION", "OTHER"]), "confidence": rng.choice([0.5, 0.95]), "p_version": rng.choice([0.1, 0.85]), "p_other": rng.choice([0.2, 0.4]), "nnp": w[0].isupper()} for pos in range(1, rng.choice([1, 12, 60]) + 1)]
        rows += mine
        want += [(d, r["pos"], k) for r, k in zip(mine, loop_rules(mine, titles))]
    known, words = spark.createDataFrame([(t,) for t in titles], "title string"), spark.createDataFrame(rows)
    by_shuffle = products.word_rules(words, known, keep=("doc_id", "pos", "kind"), pairs=0)
    in_order = products.word_rules(words.coalesce(1), known, keep=("doc_id", "pos", "kind"), in_order=True)
    for got in (by_shuffle, in_order):
        assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = in_order._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_documents_stay_small_as_rows_grow(spark, tmp_path):
    rows = spark.range(400).selectExpr("cast(id AS string) AS k", "repeat('x', 200) AS item")
    for n, most in ((2, 1 << 20), (40, 2000)):
        sinks.documents(rows, str(tmp_path / str(n)), 2, "k", lambda: F.struct(F.collect_list("item").alias("xs")), most=most)
        files = list((tmp_path / str(n)).rglob("*.txt"))
        assert len(files) >= n and (n == 2 or max(f.stat().st_size for f in files) < 20 * most)
        back = spark.read.schema("xs array<string>").json(str(tmp_path / str(n)), multiLine=True)
        assert back.selectExpr("sum(size(xs))").first()[0] == 400


def test_divergences_move_rare_terms_only(spark):
    from vexarium.operators import divergence

    docs = spark.createDataFrame([(1, "a a b c"), (2, "b zz"), (1, "a d"), (3, ""), (4, None)], "doc int, text string")
    inst = divergence.document_histogram(docs, lambda t: F.split(t, " "))
    assert sorted(map(tuple, inst.select("doc", "term", "cnt", "ti").collect())) == [(1, "a", 3, 6), (1, "b", 1, 6), (1, "c", 1, 6), (1, "d", 1, 6), (2, "b", 1, 2), (2, "zz", 1, 2), (3, "", 1, 1)]
    assert inst._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 1
    model = spark.createDataFrame([("x", "a", 5), ("x", "b", 2), ("x", "", 1), ("y", "b", 4), ("y", "c", 1), ("y", "d", 1)], "label string, term string, cnt bigint")
    for f in (divergence.cross_entropy, divergence.kl_divergence, divergence.js_divergence):
        want = sorted((r[0], r[1], round(r[2], 9)) for r in f(inst, model, 100).collect())
        assert len(want) == 6 and want == sorted((r[0], r[1], round(r[2], 9)) for r in f(inst.drop("ti"), model, 100, frequent=2).collect())


def test_page_trees_are_freed_and_rows_sent_in_parts(spark, monkeypatch):
    import gc

    from vexarium.functions.dom import Node

    gc.collect()
    gc.disable()
    try:
        for _ in range(20):
            assert pages.parse_page("generic", "<div><p>CVE-2021-0001 allows attack</p><ul><li>x</li></ul></div>")
            assert pages.parse_fix_page("u", "<h2>Fix</h2><p>Upgrade.</p>") == ["Upgrade."]
        assert not any(isinstance(x, Node) for x in gc.get_objects())
    finally:
        gc.enable()
    monkeypatch.setattr(pages, "SEND_CHARS", 10)
    d = spark.createDataFrame([(i, "https://x", f"<p>CVE-2021-{i:04d} allows attack</p>") for i in range(150)], "page_id bigint, url string, html string")
    assert sorted(r["cve_id"] for r in pages.parse_pages(d).collect()) == [f"CVE-2021-{i:04d}" for i in range(150)]


def test_ngrams_are_counted_by_blocks(spark, monkeypatch):
    rng = random.Random(6)
    texts = [None, "", " \t", "One", "a  b\na b a", *("".join(rng.choice(["a", "B", "ü", "Σas ", " ", "\x0b", "\u00a0"]) for _ in range(60)) for _ in range(40))]
    d = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(2)
    want = sorted(map(tuple, features.ngrams(d, "text").select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).collect()))
    assert len(want) > 200
    for chars in (100, 10**6):
        monkeypatch.setattr(features, "BLOCK_CHARS", chars)
        x = features.ngram_counts(d, "text")
        assert x._jdf.queryExecution().executedPlan().toString().count("Exchange") == (2 if chars == 100 else 1)
        assert sorted(map(tuple, x.collect())) == want


def test_hashed_ngrams_are_those_of_the_library(spark):
    from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer

    rng = random.Random(7)
    texts = ["", " \t", "One", "a  b\na b a", "x" * 5003, *("".join(rng.choice(["a", "B", "üß", "日本", "Wörd ", "longer ", " ", "\u00a0"]) for _ in range(60)) for _ in range(40)), None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(2)
    got = {r["doc_id"]: r["tf"] for r in features.hashed_ngrams(d, 64).collect()}
    x = RegexTokenizer(inputCol="text", outputCol="w", pattern=r"\s+").transform(d.filter("text is not null"))
    for n in (1, 2, 3):
        x = HashingTF(inputCol=f"g{n}", outputCol=f"t{n}", numFeatures=64).transform(NGram(n=n, inputCol="w", outputCol=f"g{n}").transform(x))
    want = {r["doc_id"]: [*r["t1"].toArray(), *r["t2"].toArray(), *r["t3"].toArray()] for r in x.collect()}
    assert {i: list(v.toArray()) for i, v in got.items()} == want and len(want) == len(texts) - 1


def test_platforms_are_the_capitalised_words_before_a_version(spark):
    from vexarium.functions.text import platform_versions

    rows = [("fixed in Widget Server 1.2.3 and later",), ("no product 1.2",), (None,), ("Alpha 2.0. Beta 3.1\nAlpha 2.0",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(platform_versions("t")).collect()]
    assert got == [["Widget Server 1.2.3"], [], [], ["Alpha 2.0", "Beta 3.1"]]
