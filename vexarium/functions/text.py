"""Text functions as columns: trimming, ids, clean-up, splitting, windows around a word."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CVE_ID = "CVE-[0-9]+-[0-9]+"
VERSION_TOKEN = r"(\d+\.(?:\d+\.)*\d+)"
RELEVANT = r"affect|attack|bypass|cve|execut|fix|flaw|permission|vulnerab|CVE|Mitigat|\d+\.(?:\d+\.)*\d+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def jtrim(x: Column | str) -> Column:
    """Without the characters up to U+0020 at both ends."""
    return F.regexp_replace(_c(x), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def all_cve_ids(x: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(_c(x), F.lit(f"({CVE_ID})"), 1))


def first_cve_id(x: Column | str) -> Column:
    """The first id, or the empty string."""
    return F.regexp_extract(_c(x), CVE_ID, 0)


def strict_exploit_id(x: Column | str) -> Column:
    """The id if the whole text is one, after quotes go and typographic dashes become hyphens; else null."""
    clean = jtrim(F.translate(_c(x), "–‑\"", "--"))
    return F.when(clean.rlike(r"^CVE-\d{4}-\d{4,}$"), clean)


def ids_are_block(x: Column | str) -> Column:
    """Whether a text of several ids is a block of them: less than ten characters between each two."""
    parts = F.split(_c(x), CVE_ID)
    return (F.size(parts) > 2) & F.forall(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda p: F.char_length(p) < 10)


def context_window(x: Column | str, word: Column | str, bound: int = 300) -> Column:
    """Up to `bound` characters before the first occurrence of `word` and as many from it on."""
    t, at = _c(x), F.locate(_c(word), _c(x)) if isinstance(word, str) else F.expr("1")
    at = F.position(_c(word), t)
    start = F.greatest(at - bound, F.lit(1))
    return F.when(at > 0, F.substring(t, start, at + bound - start))


def keyword_window(x: Column | str, keyword: str, length: int = 40) -> Column:
    """`length` characters from the first occurrence of the keyword, in any case; empty without one."""
    at = F.position(F.lit(keyword), F.lower(_c(x)))
    return F.when(at > 0, F.substring(_c(x), at, F.lit(length))).otherwise("")


def without_space(x: Column | str) -> Column:
    return F.lower(F.regexp_replace(_c(x), r"\s+", ""))


def letters_only(x: Column | str) -> Column:
    """Everything but letters becomes a space, spaces collapse."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(x), r"[^\p{L}]", " "), r"\s+", " "))


def identifier_words(x: Column | str) -> Column:
    """camelCase and delimited identifiers as lower-case words."""
    return F.transform(F.regexp_extract_all(_c(x), F.lit("([A-Z][a-z]+|[a-z]+|[A-Z]+)"), 1), F.lower)


#: Common English words without meaning of their own; a caller may pass a list of its own, such as one of a programming language's keywords.
STOP_WORDS = tuple(
    "a about above after again against all am an and any are as at be because been before being below between both but by can cannot could did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself me more most my myself no nor not of off on once only or other ought our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up upon very was we were what when where which while who whom why with would you your yours yourself yourselves".split()
)


def remove_words(words: Column, stop: list[str] | tuple[str, ...] = STOP_WORDS) -> Column:
    return F.filter(words, lambda w: ~w.isin(*stop))


def _platforms(text: str | None) -> list[str]:
    """The versions of a text, each with the capitalised words right before it; in order, once each."""
    out: dict[str, None] = {}
    for s in re.split(r"\n|[.] ", text or ""):
        for m in re.finditer(VERSION_TOKEN, s):
            start, first = s.rindex(m.group()), -1
            for i in range(start - 1, -1, -1):
                if s[i] in ":;*,.\\/='":
                    break
                if s[i].isupper():
                    first = i
                if s[i] == " " and first != i + 1 and i != start - 1:
                    break
            if first >= 0:
                out[s[first : start + len(m.group())]] = None
    return list(out)


@F.pandas_udf(T.ArrayType(T.StringType()))
def platform_versions(x: pd.Series) -> pd.Series:
    """Products with versions, such as Widget Server 1.2; a backward scan from each version, so it runs in Python."""
    return x.map(_platforms)


def csv_safe(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), r"[ '|\"…\[\]]", " ")


def host(url: Column | str, fallback: str = "") -> Column:
    return F.coalesce(F.try_parse_url(_c(url), F.lit("HOST")), F.lit(fallback))


def strip_tags(html: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(_c(html), "<[^>]*>", " "), r"\s+", " "))


def is_relevant(x: Column | str) -> Column:
    return _c(x).rlike(RELEVANT)


def has_han(x: Column | str) -> Column:
    return _c(x).rlike(r"\p{IsHan}")


def valuable_sentence(x: Column | str, n: Column) -> Column:
    """Longer than three times what its n ids may take (17 characters each)."""
    return F.char_length(_c(x)) > 3 * 17 * n


def fix_header(x: Column | str) -> Column:
    """Whether a header's word announces a fix, in the singular or the plural."""
    words = F.split(F.upper(_c(x)), r"[^A-Z]+")
    return F.exists(words, lambda w: F.regexp_replace(w, "(?:E?S)$", "").isin("FIX", "MITIGAT", "MITIGATION", "RESOLV", "RESOLUTION") | w.isin("MITIGATE", "RESOLVE", "MITIGATES", "RESOLVES"))


def diff_body(x: Column | str, limit: int = 500) -> Column:
    """A unified diff from its first hunk header on, cut to `limit` characters."""
    at = F.position(F.lit("@@"), _c(x))
    return F.when(at > 0, F.substring(_c(x), at, F.lit(limit))).otherwise("")


def abridge(x: Column | str, limit: int = 1000) -> Column:
    return F.when(F.char_length(_c(x)) > limit, F.concat(F.substring(_c(x), 1, limit), F.lit("..."))).otherwise(_c(x))


def lines_changed(diff: Column | str) -> Column:
    """The sum of the new lengths of all hunks."""
    return F.aggregate(F.regexp_extract_all(_c(diff), F.lit(r"@@ -\d+(?:,\d+)? \+\d+,(\d+) @@"), 1), F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))


def build_leaves(build: Column | str) -> Column:
    """How many sources a build string such as ((1,2),3) holds."""
    return F.size(F.regexp_extract_all(_c(build), F.lit(r"(\d+)"), 1))


def tsv_safe(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(x), r"\r?\n", ". "), "\t", " ")
