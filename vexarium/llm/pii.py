"""Personal data: regular expressions propose spans, checksum validators confirm them, nearby context words adjust the score.

A proposal starts from its kind's base score. A validator may reject it (a card that fails Luhn, an IBAN that fails mod-97, an
address octet over 255, an area number never issued). Words among the CONTEXT_WORDS words before it or the few after it that
speak for the kind raise the score, words that speak against it (an order or version number, say) lower it. Spans of at least
THRESHOLD are reported; where two overlap, the higher score stays, then the longer, then the earlier.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexarium.llm.common import words

THRESHOLD, CONTEXT_CHARS, CONTEXT_WORDS, BOOST, PENALTY = 0.5, 80, 6, 0.25, 0.35


def luhn(digits: str) -> bool:
    """The Luhn checksum: every second digit from the right doubled, digits summed, a multiple of ten."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i & 1:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The IBAN checksum: first four characters moved to the end, letters as 10 to 35, remainder 1 by 97."""
    s = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


_IBAN_LENGTH = dict(zip("AD AE AL AT AZ BA BE BG BH BR CH CR CY CZ DE DK DO EE ES FI FO FR GB GE GI GL GR GT HR HU IE IL IS IT JO KW KZ LB LI LT LU LV MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SE SI SK SM TN TR UA VG XK".split(), [24, 23, 28, 20, 28, 20, 16, 22, 22, 29, 21, 22, 28, 24, 22, 18, 28, 20, 24, 18, 18, 27, 22, 22, 23, 18, 27, 28, 21, 28, 22, 23, 26, 27, 30, 30, 20, 28, 21, 20, 20, 21, 27, 24, 22, 19, 27, 31, 30, 18, 15, 24, 28, 29, 25, 29, 24, 22, 24, 24, 19, 24, 27, 24, 26, 29, 24, 20]))
_ALNUM = re.compile(r"[^0-9A-Za-z]+")


def _card(s: str) -> bool:
    d = re.sub(r"\D", "", s)
    return 13 <= len(d) <= 19 and len(set(d)) > 1 and d[0] in "23456" and luhn(d)


def _iban(s: str) -> bool:
    c = _ALNUM.sub("", s)
    return _IBAN_LENGTH.get(c[:2]) == len(c) and mod97(c)


def _ipv4(s: str) -> bool:
    p = s.split(".")
    return all(int(x) < 256 and (x == "0" or x[0] != "0") for x in p) and p[0] not in ("0", "127") and s != "255.255.255.255"


def _phone(s: str) -> bool:
    return 10 <= len(re.sub(r"\D", "", s)) <= 15


def _ssn(s: str) -> bool:
    a, b, c = s.split("-")
    return a not in ("000", "666") and a[0] != "9" and b != "00" and c != "0000"


def _email(s: str) -> bool:
    local, _, host = s.rpartition("@")
    return ".." not in s and local[0] != "." and local[-1] != "." and not any(p.startswith("-") or p.endswith("-") for p in host.split("."))


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: re.Pattern
    base: float
    valid: Callable[[str], bool]
    context: frozenset[bytes]
    against: frozenset[bytes]


def _set(s: str) -> frozenset[bytes]:
    return frozenset(w.encode() for w in s.split())


_NUMBERS = _set("order invoice bestellung commande pedido sku serial tracking isbn issn version build revision checksum hash")
KINDS = (
    # The local part is found backwards from the @, so a text without one costs a single search.
    Kind("email", re.compile(r"@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9@-])"), 0.8, _email, _set("email mail contact e-mail correo courriel kontakt write"), _set("")),
    Kind("card", re.compile(r"(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]|\.[0-9])"), 0.6, _card, _set("card credit visa mastercard amex debit karte kreditkarte carte tarjeta payment cvv expiry"), _NUMBERS),
    Kind("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"), 0.85, _iban, _set("iban account konto compte cuenta bank transfer"), _set("")),
    Kind("phone", re.compile(r"(?<![\w.+-])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![\w-]|\.[0-9])"), 0.55, _phone, _set("phone tel telephone call fax mobile cell telefon téléphone teléfono handy whatsapp"), _NUMBERS),
    Kind("ipv4", re.compile(r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])"), 0.55, _ipv4, _set("ip address host server login client remote addr"), _set("version build release section v rev")),
    Kind("ssn", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"), 0.5, _ssn, _set("ssn social security sozialversicherung"), _NUMBERS),
)
_LOCAL = re.compile(r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~.-]{1,64}\Z")


def _proposals(kind: Kind, text: str) -> Iterator[tuple[int, int]]:
    if kind.name == "email":
        at = text.find("@")
        while at >= 0:
            left, right = _LOCAL.search(text[max(0, at - 64) : at]), kind.pattern.match(text, at)
            local = left.group().lstrip(".'`*") if left and right else ""
            if local:
                yield at - len(local), right.end()
            at = text.find("@", at + 1)
    else:
        for m in kind.pattern.finditer(text):
            yield m.span()
            if kind.name == "iban":  # capital words that follow may have been taken in: try the country's own length too
                c = text[m.start() : m.end()]
                n = _IBAN_LENGTH.get(c[:2], 0)
                seen = [i for i, x in enumerate(c) if x != " "]
                if len(seen) > n > 0 and (seen[n - 1] + 1 == len(c) or c[seen[n - 1] + 1] == " "):
                    yield m.start(), m.start() + seen[n - 1] + 1


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of the personal data in a text, in order; offsets in characters."""
    if not text:
        return []
    found = []
    for kind in KINDS:
        for a, b in _proposals(kind, text):
            s = text[a:b]
            if not s or not kind.valid(s):
                continue
            before = words(text[max(0, a - CONTEXT_CHARS) : a])[-CONTEXT_WORDS:]
            near = set(before) | set(words(text[b : b + CONTEXT_CHARS])[:2])
            score = kind.base + BOOST * bool(near & kind.context) - PENALTY * bool(set(before[-2:]) & kind.against)
            if score >= THRESHOLD:
                found.append((kind.name, a, b, round(min(score, 1.0), 4)))
    found.sort(key=lambda x: (-x[3], x[1] - x[2], x[1], x[0]))
    kept: list[tuple[str, int, int, float]] = []
    taken: set[int] = set()
    for x in found:
        cells = range(x[1], x[2])
        if taken.isdisjoint(cells):
            taken.update(cells)
            kept.append(x)
    return sorted(kept, key=lambda x: x[1])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, start, end, score, masked) for each span; masked keeps the last two characters only.

    Null and empty texts have none. Repeated rows give their spans again, and null ids are kept. Extra columns aren't read. Texts are
    read whole. An empty table gives an empty result. One pass without a shuffle."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, a, b, s, "*" * (b - a - 2) + t[b - 2 : b]) for i, t in zip(pdf["doc_id"].astype("Int64"), pdf["text"]) for k, a, b, s in find_spans(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "start", "end", "score", "masked"]).astype({"doc_id": "Int64"})

    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInPandas(f, "doc_id bigint, kind string, start int, end int, score double, masked string")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, with each span of personal data replaced by its kind in angle brackets.

    Null texts stay null, empty ones empty; null ids, repeated rows and further columns of any name are carried along. An empty table gives
    an empty result. Texts are read whole."""

    @F.pandas_udf("string")
    def clean(text: pd.Series) -> pd.Series:
        out = []
        for t in text:
            if t is not None:
                at, parts = 0, []
                for k, a, b, _ in find_spans(t):
                    parts += [t[at:a], f"<{k}>"]
                    at = b
                t = "".join(parts) + t[at:]
            out.append(t)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, clean(docs[text_col].cast("string")))
