"""The engine's surface over the smallest domain tables."""

import pytest
from pyspark.sql import functions as F

from vexarium import api
from vexarium.plans.bindings import AS_OF, Domain
from vexarium.plans.products import _classified
from vexarium.plans.quality import with_status
from vexarium.plans.reporting import composites

CONF = api.EngineConf(as_of=AS_OF)


@pytest.fixture(scope="module")
def d(spark):
    return Domain(spark, "/root/testdata/sf0.001")


def test_reconcile_jobs(d):
    jobs = d.vulnerability.filter("vuln_id < 20").select("cve_id")
    out = api.reconcile_jobs(jobs, with_status(d), d.vulnerability, CONF)
    ids = {r["cve_id"] for r in jobs.collect()}
    made = {r["cve_id"] for r in out["vulnerability_version"].collect()}
    assert made and made <= ids and out["vulnerability"].count() == d.vulnerability.count()
    assert {r["status"] for r in out["raw_description"].select("status").distinct().collect()} <= {1, 2, 3}


@pytest.mark.parametrize("approach", ["ML", "IT", "IT-ML", "ML-IT"])
def test_characterize(spark, approach):
    rows = [("remote attack over the network again", "Remote"), ("local user reads a secret file", "Local")] * 8
    training = {"AttackTheater": spark.createDataFrame(rows, "text string, label string")}
    c = spark.createDataFrame([("CVE-1-1", "A remote attack over the network is possible by anyone at all.", "NEW"), ("CVE-1-2", "short", "NEW"), ("CVE-1-3", "x" * 60, "UNCHANGED")], "cve_id string, description string, status string")
    scores = spark.createDataFrame([("N,L,X,X,U,N,N,N", 7.0)], "vector string, score double")
    out = api.characterize(c, training, scores, c.filter("cve_id = 'CVE-1-1'").select("cve_id"), api.EngineConf(AS_OF, method=("NB",), approach=approach))
    assert [(r["cve_id"], r["label"]) for r in out["vdo_characteristic"].collect()][0] == ("CVE-1-1", "Remote")
    assert out["vdo_set"].first()["severity"] == "HIGH" and out["ssvc"].first()["exploit_status"] == "POC"


def test_other_jobs(d):
    assert set(api.compare_registry(d.vulnerability, d.nvd, d.mitre)) == {"nvd_counts", "mitre_counts", "nvd_gaps", "mitre_gaps"}
    assert api.run_stats(composites(d)).first()["total_cve_count"] == 50
    assert api.find_patches(d.product, d.commit.drop("cve_id"), d.vulnerability, CONF)["commits"].count() > 0
    assert api.find_fixes(d.raw, d.nvd_url, d.page)["urls"].count() > 200
    assert api.filter_metrics(with_status(d), CONF)["filters"].count() == 5
    assert "version" in api.extract_products(_classified(d), d.dictionary).columns


def test_products_from_words(spark):
    w = [("Apache", "NAME", 0.95), ("Tomcat", "NAME", 0.95), ("before", "VERSION", 0.9), ("9.1", "VERSION", 0.9), ("is", "OTHER", 0.9)]
    words = spark.createDataFrame([(1, i, a, k, c) for i, (a, k, c) in enumerate(w)], "doc_id bigint, pos int, word string, kind string, confidence double")
    dic = spark.createDataFrame([("apache:tomcat", v, f"Apache Tomcat {v}") for v in ("8.0", "9.1", "10.0")], "group_id string, version string, title string")
    assert {(r["group_id"], r["version"]) for r in api.extract_products(words, dic).select(F.col("group_id"), "version").collect()} == {("apache:tomcat", "8.0"), ("apache:tomcat", "9.1")}
