"""Text of web pages without the boilerplate of their host, by suffix arrays over each host's pages.

The pages of a host are turned into token streams and concatenated, a different separator after each page. The suffix array of the
whole (by prefix doubling, up to RUN tokens) puts equal substrings next to each other. A substring of at least RUN tokens that
two distinct pages hold is boilerplate; all tokens it covers are removed and the runs between are kept. A repeated substring of RUN
tokens or more is the union of its windows of RUN tokens, so suffixes need no ranks beyond their first RUN tokens.

The bounds of blocks (navigation, footers, headings, list items, paragraphs) are in the streams too, MARKS marks each. They count in a run,
so a short block that is repeated as a whole, from bound to bound, is boilerplate with RUN - 2 * MARKS words, while a chance
repetition inside a paragraph needs RUN.

A host's pages are one block if they have at most HOST_TOKENS tokens, else as many as they were parsed in. Each block has its suffix
array. The arrays of a host's blocks are merged without moving texts: a block sends the fingerprints of its distinct suffix prefixes, sorted
and Golomb coded, to the owners of their ranges, and each owner says by a bitmap which of them another block holds too.
"""

from __future__ import annotations

import html
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexarium.llm.common import BROADCAST_BYTES, Memo, materialise, maybe_broadcast, word_hash
from vexarium.llm.exactdedup import golomb_decode, golomb_encode

RUN, MARKS = 12, 4
HOST_TOKENS = 1_500_000
MARK = "\x1e"  # the bound of a block; no word is it, as it is white space

_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"</?[A-Za-z!?][^>]*>?")
_BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>?", re.I)


def page_tokens(page: str | None) -> list[str]:
    """The visible words, with a MARK between blocks: comments, scripts, styles and tags go, character references are resolved, white space splits."""
    if not page:
        return []
    blocks = _BLOCK.sub(MARK, _DROP.sub(" ", page)).split(MARK)
    out: list[str] = []
    for b in blocks:
        w = html.unescape(_TAG.sub(" ", b)).split()
        if w:
            out.append(MARK)
            out += w
    if out:
        out.append(MARK)
    return out


def suffix_ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """The rank of each suffix among all by its first `depth` tokens; equal prefixes have equal ranks. Prefix doubling."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    done, n = 1, len(tokens)
    while done < depth:
        step = min(done, depth - done)  # windows of `done` at i and at i + step cover done + step tokens
        second = np.full(n, -1, np.int64)
        second[: n - step] = rank[step:]
        rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + second + 1, return_inverse=True)[1]
        done += step
    return rank


def suffix_array(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of all suffixes by their first `depth` tokens (ties by position), and where each group of equal ones begins."""
    rank = suffix_ranks(tokens, depth)
    order = np.argsort(rank, kind="stable")
    return order, np.flatnonzero(np.diff(rank[order], prepend=-1))


def groups(pages: list[np.ndarray], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of the concatenated pages, as the flow with its separators, the order of its suffixes, where each group of those
    that are equal in their first `run` tokens begins, and the least and largest page of each group."""
    lens = np.array([len(p) for p in pages], np.int64)
    flow = np.empty(int(lens.sum()) + len(pages), np.int64)
    owner, ends = np.repeat(np.arange(len(pages)), lens + 1), np.cumsum(lens + 1) - 1
    mask = np.ones(len(flow), bool)
    mask[ends] = False
    flow[mask] = np.concatenate([np.zeros(0, np.int64), *pages])
    flow[ends] = -1 - np.arange(len(pages))  # separators differ, so no match crosses one
    order, starts = suffix_array(flow, run)
    o = owner[order]
    return flow, order, starts, np.minimum.reduceat(o, starts), np.maximum.reduceat(o, starts)


def _cover(lens: list[int], order: np.ndarray, starts: np.ndarray, hot: np.ndarray, run: int) -> list[np.ndarray]:
    """For each page, which tokens lie in the first `run` tokens of a suffix of a hot group."""
    hit = order[np.repeat(hot, np.diff(np.append(starts, len(order))))]
    marks = np.zeros(len(order) + 1, np.int64)
    np.add.at(marks, hit, 1)
    np.add.at(marks, np.minimum(hit + run, len(order)), -1)
    out = np.cumsum(marks[:-1]) > 0
    ends = np.cumsum(np.array(lens, np.int64) + 1)
    return [out[e - n - 1 : e - 1] for n, e in zip(lens, ends)]


def covered(pages: list[np.ndarray], run: int) -> list[np.ndarray]:
    """For each page of a block, which tokens lie in a substring of at least `run` tokens that another of the pages holds too."""
    if len(pages) < 2:
        return [np.zeros(len(p), bool) for p in pages]
    _, order, starts, low, high = groups(pages, run)
    return _cover([len(p) for p in pages], order, starts, low != high, run)


def window_hashes(h: np.ndarray, run: int) -> np.ndarray:
    """63-bit hashes of all windows of `run` word hashes."""
    n = len(h) - run + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    s = np.full(n, run, np.uint64)
    for j in range(run):
        s = (s ^ h[j : j + n]) * np.uint64(0xFF51AFD7ED558CCD)
        s ^= s >> np.uint64(32)
    return (s >> np.uint64(1)).astype(np.int64)


_MARK_HASH = np.uint64(word_hash(MARK.encode()))


def _hashes(text: str, memo: Memo) -> np.ndarray:
    """The stream of a page: its words' hashes, MARKS for each mark."""
    w = text.split(" ") if text else []
    h = np.fromiter(map(memo.__getitem__, w), np.uint64, len(w))
    return np.repeat(h, np.where(h == _MARK_HASH, MARKS, 1)).view(np.int64)


def _memo() -> Memo:
    return Memo(lambda w: word_hash(w.encode("utf-8", "replace")))


def _keep(text: str, gone: np.ndarray) -> tuple[str, int, int]:
    """The kept runs joined by line feeds, the number of kept words and of all; `gone` is by the stream's tokens."""
    w = text.split(" ") if text else []
    mark = np.fromiter((x == MARK for x in w), bool, len(w))
    width = np.where(mark, MARKS, 1)
    out = gone[np.cumsum(width) - width] if len(w) else np.zeros(0, bool)
    words_ = [x for x in w if x != MARK]
    stay = np.flatnonzero(~out[~mark])
    if not len(stay):
        return "", 0, len(words_)
    runs = np.split(stay, np.flatnonzero(np.diff(stay) > 1) + 1)
    return "\n".join(" ".join(words_[r[0] : r[-1] + 1]) for r in runs), len(stay), len(words_)


def _pack(texts: list[str]) -> bytes:
    """Pages as one compressed blob; tokens hold no white space, so a line feed parts pages."""
    return zstandard.ZstdCompressor(level=9).compress("\n".join(texts).encode("utf-8", "replace"))


def _unpack(blob: bytes) -> list[str]:
    return zstandard.ZstdDecompressor().decompress(blob).decode("utf-8").split("\n")


def _prefixes(texts: list[str], run: int, memo: Memo) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's suffix array: the lengths of its pages, the order, the groups' starts, each group's fingerprint (that of the first `run` tokens
    of its suffixes; -1 if a page ends before) and whether two of the block's pages hold it."""
    pages = [_hashes(t, memo) for t in texts]
    lens = [len(p) for p in pages]
    flow, order, starts, low, high = groups(pages, run)
    at = order[starts]
    last = np.repeat(np.cumsum(np.array(lens, np.int64) + 1) - 1, np.array(lens, np.int64) + 1)
    h = np.full(len(flow), -1, np.int64)
    w = window_hashes(flow.view(np.uint64), run)
    h[: len(w)] = w
    return lens, order, starts, np.where(at + run <= last[at], h[at], -1), low != high


def _match(pdf: pd.DataFrame) -> pd.DataFrame:
    """The merge of the blocks' suffix prefixes in a bucket: which of each block's another block holds too, or two pages of one block."""
    lists = [golomb_decode(d, n, k) for d, n, k in zip(pdf["data"], pdf["n"], pdf["k"])]
    twice = [np.unpackbits(np.frombuffer(m, np.uint8))[:n].astype(bool) for m, n in zip(pdf["twice"], pdf["n"])]
    every = np.sort(np.concatenate(lists))
    hot = np.union1d(np.concatenate([x[m] for x, m in zip(lists, twice)]), every[1:][every[1:] == every[:-1]])
    marks = [np.packbits(np.isin(x, hot)).tobytes() for x in lists]
    return pd.DataFrame({"host": pdf["host"], "chunk": pdf["chunk"], "bucket": pdf["bucket"], "n": pdf["n"], "marks": marks})


def extract(pages: DataFrame, run: int = RUN, host_tokens: int = HOST_TOKENS, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, text, kept, n_tokens): each page's words outside its host's boilerplate, runs separated by line feeds.

    Pages of one host are compared with each other; a null or malformed url belongs to the host ''. A page is a row: repeated rows, and rows
    that share an id, are distinct pages, so their text counts as repeated. A null or empty html gives an empty text with n_tokens 0.
    Null ids are kept. Extra columns aren't read. An empty table gives an empty result. Pages are read whole."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for host_, part in pdf.groupby("host", sort=False):
                ids, texts, n = [], [], 0
                for i, x in zip(part["page_id"].astype("Int64"), part["html"]):
                    w = page_tokens(x)
                    ids.append(None if i is pd.NA else int(i))
                    texts.append(" ".join(w))
                    n += len(w)
                    if n >= host_tokens:
                        rows.append((host_, uuid.uuid4().hex, ids, n, _pack(texts)))
                        ids, texts, n = [], [], 0
                if ids:
                    rows.append((host_, uuid.uuid4().hex, ids, n, _pack(texts)))
            yield pd.DataFrame(rows, columns=["host", "chunk", "ids", "n", "pages"])

    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    base = pages.select(F.col(id_col).cast("bigint").alias("page_id"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    parsed = materialise(base.mapInPandas(parse, "host string, chunk string, ids array<bigint>, n bigint, pages binary"), "html-tokens")
    large = materialise(parsed.groupBy("host").agg(F.sum("n").alias("tokens")).filter(F.col("tokens") > host_tokens).select("host"), "html-hosts")
    few = maybe_broadcast(large, 64)
    out = "page_id bigint, host string, text string, kept int, n_tokens int"
    columns = ["page_id", "host", "text", "kept", "n_tokens"]

    def by_host(pdf: pd.DataFrame) -> pd.DataFrame:
        memo = _memo()
        ids = [None if i is None or i != i else int(i) for x in pdf["ids"] for i in x]
        texts = [t for x in pdf["pages"] for t in _unpack(x)]
        gone = covered([_hashes(t, memo) for t in texts], run)
        rows = [(i, pdf["host"].iloc[0], *_keep(t, g)) for i, t, g in zip(ids, texts, gone)]
        return pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64"})

    small = parsed.join(few, "host", "left_anti").groupBy("host").applyInPandas(by_host, out)
    if large.isEmpty():
        return small
    # Hosts of several blocks: each block sends the fingerprints of its distinct suffix prefixes to the owners of their ranges, and gets a bit
    # for each back. Neither texts nor positions move.
    big = parsed.join(few, "host", "left_semi")
    buckets = max(2, 4 * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    width = (1 << 63) // buckets + 1

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _memo()
        for pdf in batches:
            for host_, chunk, blob in zip(pdf["host"], pdf["chunk"], pdf["pages"]):
                _, _, _, h, two = _prefixes(_unpack(blob), run, memo)
                order = np.argsort(h, kind="stable")[np.count_nonzero(h < 0) :]
                h, two = h[order], two[order]
                edges = np.append(np.searchsorted(h, np.array([b * width for b in range(buckets)], np.int64)), len(h))
                rows = []
                for b in np.flatnonzero(np.diff(edges)):
                    x, y = edges[b], edges[b + 1]
                    data, k = golomb_encode((h[x:y] - int(b) * width).astype(np.uint64))
                    rows.append((host_, chunk, int(b), int(y - x), k, data, np.packbits(two[x:y]).tobytes()))
                yield pd.DataFrame(rows, columns=["host", "chunk", "bucket", "n", "k", "data", "twice"])

    lists = big.select("host", "chunk", "pages").mapInPandas(send, "host string, chunk string, bucket int, n int, k int, data binary, twice binary")
    marks = lists.groupBy("host", "bucket").applyInPandas(_match, "host string, chunk string, bucket int, n int, marks binary")
    answers = materialise(marks.groupBy("host", "chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "marks"))).alias("marks")), "html-marks")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _memo()
        for pdf in batches:
            rows = []
            for host_, ids, blob, answer in zip(pdf["host"], pdf["ids"], pdf["pages"], pdf["marks"]):
                texts = _unpack(blob)
                lens, order, starts, h, _ = _prefixes(texts, run, memo)
                bits = [np.unpackbits(np.frombuffer(m["marks"], np.uint8))[: m["n"]] for m in (answer if answer is not None else [])]
                hot = np.zeros(len(h), bool)
                hot[np.argsort(h, kind="stable")[np.count_nonzero(h < 0) :]] = np.concatenate([np.zeros(0, np.uint8), *bits]).astype(bool)
                for i, t, gone in zip(ids, texts, _cover(lens, order, starts, hot, run)):
                    rows.append((None if i is None or i != i else int(i), host_, *_keep(t, gone)))
            yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64"})

    answered = answers.agg(F.coalesce(F.sum(F.expr("aggregate(marks, 0L, (a, m) -> a + length(m.marks) + 40)")), F.lit(0))).first()[0]
    joined = big.join(F.broadcast(answers) if answered <= BROADCAST_BYTES else answers, ["host", "chunk"], "left").select("host", "ids", "pages", "marks")
    return small.unionByName(joined.mapInPandas(finish, out))
