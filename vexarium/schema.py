"""Enumerations and source schemas of the vulnerability domain."""

from __future__ import annotations

from pyspark.sql import types as T

SOURCE_TYPES = ("cna", "security_advisory", "third_party", "bug_bounty", "user", "other")
HIGH_PRIORITY = ("cna", "security_advisory", "user")
NEW, UNEVALUATED, PASSED, FAILED = 0, 1, 2, 3
SEVERITIES = ("n/a", "LOW", "MEDIUM", "HIGH", "CRITICAL")

_GROUPS = {
    "ImpactMethod": {1: "Trust Failure", 2: "Man-in-the-Middle", 4: "Authentication Bypass", 9: "Code Execution", 10: "Context Escape"},
    "Context": {3: "Channel", 5: "Physical Hardware", 6: "Application", 7: "Host OS", 8: "Firmware", 11: "Guest OS", 12: "Hypervisor"},
    "Mitigation": {13: "Sandboxed", 14: "Physical Security", 15: "ASLR", 20: "HPKP/HSTS", 21: "MultiFactor Authentication"},
    "AttackTheater": {16: "Limited Rmt", 17: "Local", 22: "Remote", 27: "Physical"},
    "LogicalImpact": {18: "Read", 19: "Resource Removal", 23: "Write", 24: "Indirect Disclosure", 25: "Service Interrupt", 26: "Privilege Escalation"},
}
#: (id, label, noun group), by id.
LABELS = sorted((i, name, group) for group, names in _GROUPS.items() for i, name in names.items())
NVD_STATUSES = ("Analyzed", "Awaiting Analysis", "Undergoing Analysis", "Received", "Not in NVD")
MITRE_STATUSES = ("Public", "Reserved", "Not in MITRE")

S, A = T.StringType(), T.ArrayType


def _s(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_METRIC = A(_s(cvssData=_s(vectorString=S, baseScore=T.DoubleType(), baseSeverity=S), impactScore=T.DoubleType(), exploitabilityScore=T.DoubleType()))
#: A page of the registry's vulnerability feed.
NVD_FEED = _s(vulnerabilities=A(_s(cve=_s(
    id=S, published=S, lastModified=S, vulnStatus=S, descriptions=A(_s(lang=S, value=S)), metrics=_s(cvssMetricV31=_METRIC, cvssMetricV30=_METRIC),
    weaknesses=A(_s(description=A(_s(lang=S, value=S)))), references=A(_s(url=S)),
))))
#: A record of the numbering authority, in either of its two forms.
MITRE_RECORD = _s(cveMetaData=_s(cveId=S, state=S), CVE_data_meta=_s(ID=S, STATE=S))
PRODUCT_DICTIONARY = _s(compTime=S, refreshTime=S, products=T.MapType(S, _s(vendor=S, product=S, groupID=S, commonTitle=S, versions=T.MapType(S, _s(title=S, version=S, update=S, cpeID=S, platform=S)))))
CRAWL_ENTRY = _s(sourceURL=S, sourceType=S, vulnID=T.LongType(), cveId=S, description=S, publishDate=S, createDate=S, lastModifiedDate=S)
CRAWL_DUMP = T.MapType(S, A(CRAWL_ENTRY))
PATCH_URL_CACHE = T.MapType(S, _s(comptime=S, urls=A(S)))
