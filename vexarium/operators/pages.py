"""Web pages to raw descriptions: routing by address, five general strategies, and rules for single sources.

A page parser is a table function, so all of it runs in one mapInArrow over (page_id, url, html); the routing and the bulletin
strategy are native columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexarium.functions import dates, text
from vexarium.functions.dom import HEADERS, Node, parsed, section
from vexarium.functions.text import CVE_ID, RELEVANT

_ANY_ID, _REL, _HAN = re.compile(CVE_ID), re.compile(RELEVANT), re.compile("[㐀-䶿一-鿿豈-﫿]")
_RAW = [re.compile(p) for p in dates.RAW_DATES]


@dataclass(frozen=True)
class Rule:
    """How one source's pages are read: where the ids are ('' means anywhere), the labels of descriptions, and of both dates."""

    name: str
    needs: tuple[str, ...]
    ids: str = ""
    description: tuple[str, ...] = ("Description",)
    published: tuple[str, ...] = ("Published",)
    modified: tuple[str, ...] = ("Updated",)
    single: bool = False
    rows: str = ""


#: First match wins: the fragments of a rule must all be in the address. Sources with `rows` are read row by row.
RULES = (
    Rule("github_advisory", ("github.com/advisories",), "CVE ID", ("Description", "Impact"), single=True),
    Rule("tenable_security", ("tenable.com", "security"), "", ("Synopsis",), ("Release", "Published"), ("Updated",)),
    Rule("tenable_cve", ("tenable.com",), "", ("Description",)),
    Rule("exploit_db", ("exploit-db", "exploits"), "CVE", ("Description",), ("Date",)),
    Rule("cert_notes", ("kb.cert",), "", ("Description", "Overview")),
    Rule("packet_storm", ("packetstorm",), rows="dl"),
    Rule("talos", ("talosintelligence",), "", ("Summary", "Details"), ("Timeline",)),
    Rule("gentoo_bugs", ("gentoo", "bugs"), "Alias", ("Description",), ("Reported",), ("Modified",)),
    Rule("gentoo_security", ("gentoo", "security"), "", ("Synopsis", "Impact"), ("Release date",), ("Latest revision",)),
    Rule("null", ("gentoo", "news")),
    Rule("null", ("gentoo", "blogs")),
    Rule("generic", ("gentoo",)),
    Rule("vmware", ("vmware", "advisories"), "CVE(s)", ("Description",), ("Issue Date",), ("Updated On",)),
    Rule("bugzilla", ("bugzilla",), "", ("Summary", "title"), ("Reported",), ("Modified",)),
    Rule("anquanke", ("anquanke",), "", ("title",), ("发布时间",), single=True),
    Rule("seclists", ("seclists",), "", ("pre",), ("Date",), ("Date",)),
    Rule("redhat_updates", ("redhat", "security-updates"), rows="tr"),
    Rule("redhat_cve", ("redhat", "security", "cve"), "", ("Description",), ("Public", "Published"), ("Last Modified",), single=True),
    Rule("generic", ("redhat", "security")),
    Rule("bosch", ("bosch", "security-advisories"), rows="h3"),
    Rule("google_cloud", ("cloud.google", "bulletins"), rows="tr"),
    Rule("atlassian", ("atlassian",), "CVE", ("Description", "Summary"), ("Advisory Release Date",)),
    Rule("mend", ("mend.io",), "", ("Overview", "Description"), ("Date",), single=True),
    Rule("autodesk", ("autodesk",), rows="h3"),
    Rule("jenkins", ("jenkins.io",), "", ("SECURITY", "Description"), ("Advisory",)),
    Rule("core", ("coresecurity",), "Vulnerability Information", ("Vulnerability Description", "Technical Description"), ("Date published",), ("Date of last update",)),
    Rule("mozilla", ("mozilla",), rows="h3"),
    Rule("intel", ("intel",), rows="h3"),
    Rule("microsoft", ("msrc",), "", ("title", "FAQ"), ("Released",), ("Last updated",), single=True),
    Rule("trustwave", ("trustwave",), rows="h3"),
    Rule("trend_micro", ("zerodayinitiative",), rows="tr"),
    Rule("tibco", ("tibco",), "", ("Description",), ("Original release",), ("Last revised",), single=True),
    Rule("android", ("android",), rows="tr"),
    Rule("huntr", ("huntr",), "CVE", ("Description",), ("Reported on",), single=True),
    Rule("jvn", ("jvn",), "", ("Description", "Impact"), ("Published", "公開日"), ("Last Updated", "最終更新日")),
    Rule("curl", ("curl",), "", ("VULNERABILITY",), ("Advisory", "TIMELINE"), ("TIMELINE",)),
    Rule("snyk", ("snyk.io",), "", ("Overview", "Details"), ("Published",), single=True),
    Rule("acronis", ("acronis",), "", ("Description", "Summary"), ("Published",), ("Update",)),
    Rule("veritas", ("veritas",), "Issues", ("Summary", "Notes"), ("Revision History",), ("Revision History",)),
    Rule("adobe", ("adobe",), "CVE Number", ("Summary",), ("Date Published",), ("Last updated",)),
    Rule("alias_robotics", ("aliasrobotics",), "", ("description",), single=True),
    Rule("ampere", ("amperecomputing.com/products/product-security",), rows="tr"),
    Rule("aruba", ("arubanetworks",), "", ("Overview", "Details"), ("Publication Date",), ("Last Update",)),
    Rule("zero_days", ("cybersecurityworks",), "CVE Number", ("Description",), ("Date",), ("Timeline",), single=True),
    Rule("dragos", ("dragos",), "CVE", ("title", "Description"), ("Date",)),
    Rule("cyberark", ("cyberark",), rows="tr"),
    Rule("dotcms", ("dotcms",), "References", ("Description",), ("Date",)),
    Rule("pandora", ("pandorafms",), rows="tr"),
    Rule("libre_office", ("libreoffice",), "", ("Description",), ("Announced",), ("Updated",), single=True),
    Rule("samba", ("samba.org",), "", ("Description",), single=True),
    Rule("asustor", ("asustor",), "Detail", ("Detail",), ("Revision",), ("Revision",)),
    Rule("abb", ("abb.com",), "", ("Summary",), ("Date",)),
    Rule("eaton", ("eaton",), "", ("Overview", "Summary"), ("Revision Control",), ("Revision Control",)),
    Rule("arista", ("arista",), "", ("Description",), ("Initial release", "Date"), ("Revision",)),
    Rule("nvidia_table", ("nvidia",), rows="tr"),
    Rule("null", ("mitre.org",)),
    Rule("null", ("nist.gov",)),
)
_BY_KEY = {"+".join((r.name, *r.needs)): r for r in RULES}


def parser_key(url: Column | str) -> Column:
    """The key of the first rule for an address; `generic` without one, `null` for a null address."""
    u = text._c(url)
    out = F.when(u.isNull(), "null")
    for key, r in _BY_KEY.items():
        hit = F.lit(True)
        for part in r.needs:
            hit = hit & u.contains(part)
        if r.name.startswith("tenable"):
            hit = hit & ~u.contains("blog")
        out = out.when(hit, key)
    return out.otherwise("generic")


def parser_name(url: Column | str) -> Column:
    return F.substring_index(parser_key(url), "+", 1)


def bulletin(pages: DataFrame) -> DataFrame:
    """(page_id, url, cve_id, context, published, modified): text around each id of a page; native columns only."""
    t = pages.select("page_id", "url", text.strip_tags("html").alias("t")).withColumn("cve_id", F.explode(text.all_cve_ids("t")))
    c = t.withColumn("context", text.context_window("t", F.col("cve_id")))
    return c.select("page_id", "url", "cve_id", "context", F.coalesce(dates.publish_date("context"), dates.publish_date("t")).alias("published"), F.coalesce(dates.modified_date("context"), dates.modified_date("t")).alias("modified"))


Row = tuple[str, str, str | None, str | None]


def _ids(t: str) -> list[str]:
    return list(dict.fromkeys(_ANY_ID.findall(t)))


def _raw_date(t: str) -> str | None:
    return next((m.group() for p in _RAW if (m := p.search(t))), None)


def _keyword_date(t: str, *words: str) -> str | None:
    low = t.lower()
    for w in words:
        if w in low:
            at = low.index(w)
            if d := _raw_date(t[at : at + 40]):
                return d
            break
    return _raw_date(t)


def _rows(t: str, description: str | None = None) -> list[Row]:
    pub = _keyword_date(t, "published", "created")
    mod = _keyword_date(t, "modified", "updated") or pub
    return [(i, description or t, pub, mod) for i in _ids(t)]


def parse_table(root: Node) -> list[Row]:
    """A row for each id of each row of the first table part that names an id; after a header, the part that follows it."""
    head = next((n for n in root.tags("thead") if "CVE" in n.text()), None)
    body = next((n for n in root.tags("tbody", "table") if "CVE" in n.text()), None)
    at = head.next() if head is not None else body
    return [] if at is None else [r for tr in (at.tags("tr") if at.tag in ("table", "tbody") else at.children) for r in _rows(tr.text())]


def parse_list(root: Node) -> list[Row]:
    out: list[Row] = []
    for li in root.find(lambda n: n.tag == "li" and "CVE" in n.text()):
        t = li.text()
        if len(li.children) == 2:
            found, desc = _ids(t), li.children[1].text()
        else:
            own = next((n for n in li.walk() if "CVE" in n.own_text()), None)
            if own is None:
                continue
            found, after = _ids(own.text()), own.next() if own is not li else None
            if after is not None and not _REL.search(after.text()):
                after = next((n for n in li.walk() if re.search("detail|description", n.own_text(), re.I)), None) or next((p for p in li.tags("p") if _REL.search(p.own_text())), None)
            desc = after.text() if after is not None else li.own_text()
        if found and desc:
            pub = _keyword_date(t, "published", "created")
            out.append((found[0], desc, pub, _keyword_date(t, "modified", "updated") or pub))
    for dl in root.find(lambda n: n.tag == "dl" and "CVE" in n.text()):
        group: list[str] = []
        for x in [*dl.children, Node("dt", {}, None)]:
            if x.tag == "dt" and group:
                out += _rows(" ".join(group))
                group = []
            group.append(x.text())
    return out


def _accordion(n: Node) -> bool:
    return n.tag in ("accordion", "bolt-accordion", "acc") or (n.tag == "div" and (n.has("class", "accordion") or n.has("id", "accordion")))


def parse_accordion(root: Node) -> list[Row]:
    """Each part of each outermost accordion; also header and body pairs where a page has more than twenty of both."""
    out: list[Row] = []
    for acc in root.find(_accordion):
        if any(p.has("class", "accordion") or p.has("id", "accordion") for p in acc.up()):
            continue
        while len(acc.children) == 1:
            acc = acc.children[0]
        for c in acc.children:
            out += _rows(c.text())
    heads = root.find(lambda n: n.tag in HEADERS or (n.tag == "div" and (n.has("id", "header") or n.has("class", "header"))))
    bodies = root.find(lambda n: n.tag == "p" or (n.tag == "div" and (n.has("id", "body") or n.has("class", "body"))))
    if len(heads) > 20 and len(bodies) > 20:
        known, is_head = {id(b) for b in bodies}, {id(h) for h in heads}
        for h in heads:
            x = h.next()
            if x is not None and id(x) in known:
                parts = [h.text()]
                while x is not None and id(x) not in is_head:
                    parts.append(x.text())
                    x = x.next()
                out += _rows(" ".join(parts))
    return out


def parse_bulletin(root: Node) -> list[Row]:
    t = root.text()
    out = []
    for i in _ids(t):
        at = t.index(i)
        near = t[max(0, at - 300) : at + 300]
        pub = _keyword_date(near, "published", "created") or _keyword_date(t, "published", "created")
        out.append((i, near, pub, _keyword_date(near, "modified", "updated") or pub))
    return out


def split_at_ids(t: str) -> dict[str, str]:
    """The pieces of a text that follow each id; a piece too short to tell anything joins the next id's piece."""
    ids = list(_ANY_ID.finditer(t))
    out: dict[str, str] = {}
    waiting: list[str] = []
    for k, m in enumerate(ids):
        piece = t[m.end() : ids[k + 1].start() if k + 1 < len(ids) else len(t)].strip(" ,;:\n")
        waiting.append(m.group())
        if len(piece) >= 10 or k + 1 == len(ids):
            for i in waiting:
                out[i] = f"{out[i]} {piece}" if i in out else piece
            waiting = []
    return out


def parse_description(root: Node) -> list[Row]:
    """Relevant text: all of it for a page of one id; else, sentence by sentence, the text that belongs to each id."""
    parts = [n for n in root.walk() if n.tag not in ("script", "style", "#root") and _REL.search(n.own_text())]
    whole = " ".join(n.text() for n in parts)
    ids = _ids(whole)
    if not ids or _HAN.search(whole):
        return []
    if len(ids) == 1:
        return [(ids[0], whole, _keyword_date(whole, "published", "created"), _keyword_date(whole, "modified", "updated"))]
    got: dict[str, str] = {}
    sentences = [n.text() for n in parts]
    for k, s in enumerate(sentences):
        here = _ids(s)
        if not here:
            continue
        gaps = [len(g) for g in _ANY_ID.split(s)[1:-1]]
        block = len(here) > 1 and all(g < 10 for g in gaps)
        if len(here) == 1 or block:
            said = s
            if len(s) <= 3 * 17 * len(here):  # hardly more than the ids: the next sentence without an id tells about them
                said = next((f"{s} {n}" for n in sentences[k + 1 : k + 3] if not _ids(n) and _REL.search(n)), s)
            pieces = dict.fromkeys(here, said)
        else:
            pieces = split_at_ids(s)
        for i, p in pieces.items():
            if len(p) > len(got.get(i, "")):
                got[i] = p
    return [(i, d, _keyword_date(d, "published", "created"), _keyword_date(d, "modified", "updated")) for i, d in got.items()]


def strategy(root: Node) -> str:
    tables = [n for n in root.tags("table", "thead", "tbody") if "CVE" in n.text()]
    if 0 < len(tables) < 5:
        return "table"
    if any("CVE" in n.text() for n in root.tags("li", "ul", "ol", "dl")):
        return "list"
    if root.find(_accordion):
        return "accordion"
    if any(("CVE" in (t := n.text())) or (n.tag == "div" and "bulletin" in t.lower()) for n in root.tags("div", "span", "p")):
        return "bulletin"
    return "description"


STRATEGIES = {"table": parse_table, "list": parse_list, "accordion": parse_accordion, "bulletin": parse_bulletin, "description": parse_description}


def parse_generic(root: Node) -> list[Row]:
    s = strategy(root)
    return STRATEGIES[s](root) + (parse_description(root) if s != "description" else [])


def _labelled(root: Node, labels: tuple[str, ...]) -> str:
    out = []
    for label in labels:
        if label in ("title", "pre"):
            out += [n.text() for n in root.tags(label)[:1]]
        else:
            out.append(section(root, label))
    return " ".join(x for x in out if x)


def parse_source(rule: Rule, root: Node) -> list[Row]:
    """A source by its rule. A page that doesn't hold what the rule expects gives no rows."""
    if rule.rows == "tr":
        return [r for tr in root.tags("tr") for r in _rows(tr.text())]
    if rule.rows == "dl":
        return parse_list(root) or parse_bulletin(root)
    page = root.text()
    pub = next((d for x in rule.published if (d := _raw_date(section(root, x)))), None)
    mod = next((d for x in rule.modified if (d := _raw_date(section(root, x)))), None)
    if rule.rows == "h3":
        out = []
        for h in root.tags(*HEADERS):
            if _ids(h.text()):
                said, x = [h.text()], h.next()
                while x is not None and x.tag not in HEADERS:
                    said.append(x.text())
                    x = x.next()
                out += [(i, " ".join(said), pub, mod or pub) for i in _ids(h.text())]
        return out
    said = _labelled(root, rule.description)
    if not said or _HAN.search(said) and rule.name == "packet_storm":
        return []
    found = _ids(section(root, rule.ids)) if rule.ids else []
    found = found or _ids(page)
    pub = pub or _keyword_date(page, "published", "created")
    return [(i, said, pub, mod or pub) for i in (found[:1] if rule.single else found)]


def parse_page(key: str, html: str | None) -> list[Row]:
    name = key.split("+")[0]
    if name == "null" or not html:
        return []
    with parsed(html) as root:
        return parse_generic(root) if name == "generic" else parse_source(_BY_KEY[key], root)


#: Characters of result and rows of pages that a worker holds before it sends them on.
SEND_CHARS, READ_ROWS = 4_000_000, 64


def _table(pages: DataFrame, columns: tuple[str, ...], rows: Callable[..., Iterable[tuple]], result: str) -> DataFrame:
    """A table function over pages: the rows that `rows` gives for each page's columns, which hold one integer and else texts. A worker holds
    a few pages and their rows besides the batch that it was sent, however many rows the batch gives."""
    kinds = pa.schema([(n, pa.int64() if k == "bigint" else pa.string()) for n, k in (x.split(" ") for x in result.split(", "))])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            chars = 0
            for at in range(0, batch.num_rows, READ_ROWS):
                for page in zip(*(batch.column(c).slice(at, READ_ROWS).to_pylist() for c in columns)):
                    for r in rows(*page):
                        out.append(r)
                        chars += 50 + sum(len(x) for x in r if isinstance(x, str))
                        if chars > SEND_CHARS:
                            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds.types)], schema=kinds)
                            out, chars = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds.types)], schema=kinds)

    return pages.select(*columns).mapInArrow(f, result)


def parse_pages(pages: DataFrame) -> DataFrame:
    """(page_id, source_url, parser, cve_id, raw_description, published, modified) of all pages (page_id, url, html)."""

    def rows(p: int, u: str, k: str, h: str | None) -> Iterator[tuple]:
        return ((p, u, k.split("+")[0], *r) for r in dict.fromkeys(parse_page(k, h)))

    keyed = pages.select("page_id", "url", parser_key("url").alias("key"), "html")
    return _table(keyed, ("page_id", "url", "key", "html"), rows, "page_id bigint, source_url string, parser string, cve_id string, raw_description string, published string, modified string")


def by_strategy(pages: DataFrame, name: str) -> DataFrame:
    """(page_id, cve_id, raw_description) by one strategy on every page."""

    def rows(p: int, h: str | None) -> Iterator[tuple]:
        with parsed(h) as root:
            found = dict.fromkeys(STRATEGIES[name](root))
        return ((p, r[0], r[1]) for r in found)

    return _table(pages, ("page_id", "html"), rows, "page_id bigint, cve_id string, raw_description string")


_FIX = re.compile(r"^(?:FIX|MITIGAT|RESOLV|RESOLUTION)", re.I)


def parse_fix_page(url: str, html: str | None) -> list[str]:
    """Fix descriptions of a page: by the labels of known hosts, else the text after each header that announces a fix."""
    with parsed(html) as root:
        return _fixes(url, root)


def _fixes(url: str, root: Node) -> list[str]:
    if "cisa.gov" in url:
        return []
    if "nvd.nist.gov" in url:  # links marked as patch or advisory; the caller reads those pages in turn
        return [a.attrs.get("href", "") for tr in root.tags("tr") if re.search(r"\b(?:Patch|Mitigation|Vendor Advisory)\b", tr.text()) for a in tr.tags("a")]
    if "redhat.com" in url:
        return [x for x in (section(root, "Mitigation"), section(root, "Solution")) if x]
    if "cxsecurity" in url:
        return [x for n in root.tags("b", "strong") if "fix" in n.text().lower() and (x := section(root, n.text()))]
    out = []
    for h in root.tags(*HEADERS):
        if any(_FIX.match(w) for w in h.text().split()):
            x = h.next()
            if x is not None and x.text():
                out.append(x.text())
    return out


def parse_fixes(pages: DataFrame) -> DataFrame:
    """(page_id, source_url, fix_description) of fetched fix pages (page_id, url, html)."""

    def rows(p: int, u: str | None, h: str | None) -> Iterator[tuple]:
        return ((p, u, x) for x in dict.fromkeys(parse_fix_page(u or "", h)))

    return _table(pages, ("page_id", "url", "html"), rows, "page_id bigint, source_url string, fix_description string")
