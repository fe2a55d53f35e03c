"""Queries over web pages and fix pages; table functions, so without SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexarium.operators import pages
from vexarium.plans.bindings import Domain
from vexarium.plans.registry import query

#: What a page of each kind ends with, around the page's own id; the supplied pages have no such parts.
_TAILS = {
    "table": "<table><thead><tr><th>CVE</th><th>Text</th></tr></thead><tbody><tr><td>{0}</td><td>A flaw allows attack. Published 2021-03-04</td></tr><tr><td>none</td></tr></tbody></table>",
    "list": "<ul><li><b>{0}</b><p>A flaw allows attack. Updated 2021-04-05</p></li></ul><dl><dt>{0}9</dt><dd>fix</dd><dt>other</dt><dd>x</dd></dl>",
    "accordion": "<div class='accordion'><div>{0} allows attack</div><div>{0}8 and {0}9 were fixed</div></div>",
    "bulletin": "",
    "description": "<p>{0}1, {0}2 let anyone execute code on the host, which nobody who runs it would want to see happen at all</p>",
}


def _with_tail(d: Domain, kind: str) -> DataFrame:
    before, *rest = _TAILS[kind].split("{0}")
    own = F.concat(F.lit("CVE-2020-"), F.lpad(F.col("page_id").cast("string"), 7, "0"))
    pieces = [F.lit(before)]
    for r in rest:
        pieces += [own, F.lit(r)]
    return d.page.select("page_id", "url", F.concat("html", *pieces).alias("html"))


for _name in _TAILS:
    query(f"html_{_name}")(lambda d, s=_name: pages.by_strategy(_with_tail(d, s), s))


@query("html_generic")
def html_generic(d: Domain) -> DataFrame:
    return pages.parse_pages(d.page)


@query("html_sources")
def html_sources(d: Domain) -> DataFrame:
    """Every rule once in turn over the pages, by addresses that each rule admits."""
    hosts = [("https://" + "/".join(r.needs), "+".join((r.name, *r.needs))) for r in pages.RULES]
    k = F.get(F.array(*[F.lit(u) for u, _ in hosts]), (F.col("page_id") % len(hosts)).cast("int"))
    body = F.concat("html", F.lit("<h3>Description</h3><p>A flaw in CVE-2021-1234 allows attack.</p><h3>Published</h3><p>2021-03-04</p>"))
    return pages.parse_pages(d.page.select("page_id", k.alias("url"), body.alias("html")))


# Fragments of addresses and the parser that the first of the conditions below chooses, in the order in which they are tried.
_FRAGMENTS = "github.com/advisories tenable.com security blog exploit-db exploits kb.cert packetstorm talosintelligence gentoo bugs news vmware advisories bugzilla anquanke seclists redhat security-updates cve bosch security-advisories cloud.google bulletins atlassian mend.io autodesk jenkins.io coresecurity mozilla intel msrc trustwave zerodayinitiative tibco android huntr jvn curl snyk.io acronis veritas adobe aliasrobotics amperecomputing.com/products/product-security arubanetworks cybersecurityworks dragos cyberark dotcms pandorafms libreoffice samba.org asustor abb.com eaton arista nvidia mitre.org nist.gov plain".split()
_U = "concat('https://www.', f[1 + page_id % len(f)], '/', f[1 + page_id * 7 % len(f)], '/', f[1 + page_id * 31 % len(f)])"
_CASES = [
    ("github.com/advisories", "github_advisory"), ("tenable.com&security&!blog", "tenable_security"), ("tenable.com&!blog", "tenable_cve"), ("exploit-db&exploits", "exploit_db"), ("kb.cert", "cert_notes"), ("packetstorm", "packet_storm"), ("talosintelligence", "talos"),
    ("gentoo&bugs", "gentoo_bugs"), ("gentoo&security", "gentoo_security"), ("gentoo&news", "null"), ("gentoo&blogs", "null"), ("gentoo", "generic"), ("vmware&advisories", "vmware"), ("bugzilla", "bugzilla"), ("anquanke", "anquanke"), ("seclists", "seclists"),
    ("redhat&security&security-updates", "redhat_updates"), ("redhat&security&cve", "redhat_cve"), ("redhat&security", "generic"), ("bosch&security-advisories", "bosch"), ("cloud.google&bulletins", "google_cloud"), ("atlassian", "atlassian"), ("mend.io", "mend"), ("autodesk", "autodesk"),
    ("jenkins.io", "jenkins"), ("coresecurity", "core"), ("mozilla", "mozilla"), ("intel", "intel"), ("msrc", "microsoft"), ("trustwave", "trustwave"), ("zerodayinitiative", "trend_micro"), ("tibco", "tibco"), ("android", "android"), ("huntr", "huntr"), ("jvn", "jvn"), ("curl", "curl"),
    ("snyk.io", "snyk"), ("acronis", "acronis"), ("veritas", "veritas"), ("adobe", "adobe"), ("aliasrobotics", "alias_robotics"), ("amperecomputing.com/products/product-security", "ampere"), ("arubanetworks", "aruba"), ("cybersecurityworks", "zero_days"), ("dragos", "dragos"),
    ("cyberark", "cyberark"), ("dotcms", "dotcms"), ("pandorafms", "pandora"), ("libreoffice", "libre_office"), ("samba.org", "samba"), ("asustor", "asustor"), ("abb.com", "abb"), ("eaton", "eaton"), ("arista", "arista"), ("nvidia", "nvidia_table"), ("mitre.org", "null"), ("nist.gov", "null"),
]


def _when(condition: str) -> str:
    return " AND ".join(f"NOT contains(url, '{c[1:]}')" if c[0] == "!" else f"contains(url, '{c}')" for c in condition.split("&"))


@query("parser_routing", f"SELECT page_id, url, CASE {' '.join(f"WHEN {_when(c)} THEN '{n}'" for c, n in _CASES)} ELSE 'generic' END AS parser FROM (SELECT page_id, {_U} AS url FROM pages, (SELECT {_FRAGMENTS} AS f))")
def parser_routing(d: Domain) -> DataFrame:
    """Addresses of two or three fragments of known sources each, so that the order of the rules decides."""
    f = F.array(*map(F.lit, _FRAGMENTS))
    part = lambda k: F.get(f, (F.col("page_id") * k % len(_FRAGMENTS)).cast("int"))
    x = d.base("pages").select("page_id", F.concat(F.lit("https://www."), part(1), F.lit("/"), part(7), F.lit("/"), part(31)).alias("url"))
    return x.select("page_id", "url", pages.parser_name("url").alias("parser"))


@query("fix_pages")
def fix_pages(d: Domain) -> DataFrame:
    return pages.parse_fixes(d.page.withColumn("html", F.concat("html", F.lit("<h2>Resolution</h2><p>Upgrade to 2.0.</p>"))))
