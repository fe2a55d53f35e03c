"""Benchmark decontamination by a prefix-filtered set join with positional windows.

An item's set is its distinct word n-grams (the whole item if it is shorter than n words). A document is contaminated by an item
if some window of the document, as long as the item, holds at least THETA of the item's set.

Shingles are ordered by rarity: their count over all documents, ascending. If a window holds ceil(THETA * size) of the set,
then it holds one of its rarest size - ceil(THETA * size) + 1 shingles, the prefix. So documents are joined with items on prefix
shingles alone; the length bound drops documents whose matches are too few, the positional bound keeps the matches that lie
within one item's length of a matched prefix shingle, and the containment of every window is then computed exactly, over
63-bit hashes of the shingles.

A document is a (doc_id, hash of its text), and so is an item: rows that share an id but not a text are told apart throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexarium.llm.common import BROADCAST_BYTES, Memo, materialise, maybe_broadcast, tidy, word_hash, words

N, THETA = 3, 0.6


def shingle_hashes(w: list[bytes], n: int, memo: Memo) -> np.ndarray:
    """63-bit hashes of the word n-grams in order; of the whole list if it has 1 to n - 1 words."""
    if not w:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(memo.__getitem__, w), np.uint64, len(w))
    m = min(n, len(h))
    s = np.full(len(h) - m + 1, m * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for j in range(m):
        s = (s ^ h[j : len(h) - m + 1 + j]) * np.uint64(0xFF51AFD7ED558CCD)
        s ^= s >> np.uint64(31)
    return (s & np.uint64(0x7FFFFFFFFFFFFFFF)).astype(np.int64)


def _item_shingles(n: int):
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Memo(word_hash)
        for pdf in batches:
            for i, key, text in zip(pdf["item_id"], pdf["ikey"], pdf["text"]):
                w = words(text)
                s = np.unique(shingle_hashes(w, n, memo))
                yield pd.DataFrame({"item_id": i, "ikey": key, "h": s, "size": len(s), "n_words": len(w), "gram": min(n, len(w))})

    return f


def _doc_shingles(n: int, known: dict[int, np.ndarray] | None, short: list[int]):
    """Positions of the shingles of each document that occur in the benchmark; of all its shingles if known is None."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Memo(word_hash)
        for pdf in batches:
            ids, keys, hs, ps, lens = [], [], [], [], []
            for i, key, text in zip(pdf["doc_id"], pdf["dkey"], pdf["text"]):
                w = words(text)
                for m in (n, *short):  # items of fewer than n words are matched by shingles of their own length
                    if len(w) < m:
                        continue
                    h = shingle_hashes(w, m, memo)
                    at = np.arange(len(h), dtype=np.int32)
                    if known is not None:
                        mine = known[m]
                        hit = mine[np.minimum(np.searchsorted(mine, h), len(mine) - 1)] == h
                        h, at = h[hit], at[hit]
                    if len(h):
                        ids.append(i)
                        keys.append(key)
                        hs.append(h)
                        ps.append(at)
                        lens.append(len(h))
            if hs:
                yield pd.DataFrame({"doc_id": np.repeat(np.array(ids, np.int64), lens), "dkey": np.repeat(np.array(keys, np.int64), lens), "h": np.concatenate(hs), "pos": np.concatenate(ps)})

    return f


def _best(pos: np.ndarray, h: np.ndarray, pre: np.ndarray, span: int) -> tuple[int, int]:
    """The most distinct matches in a window of one document and item, and where the first such window begins: two pointers over the matches in order."""
    # Positional bound: a match farther than a window from every prefix match can't be in a window that counts.
    pre = pos[pre]
    k = np.searchsorted(pre, pos)
    reach = np.minimum(np.abs(pos - pre[np.minimum(k, len(pre) - 1)]), np.abs(pos - pre[np.maximum(k - 1, 0)])) <= span
    pos, h = pos[reach].tolist(), h[reach].tolist()
    inside: dict[int, int] = {}
    left = best = where = 0
    for p, x in zip(pos, h):
        inside[x] = inside.get(x, 0) + 1
        while pos[left] < p - span:
            y = h[left]
            inside[y] -= 1
            if not inside[y]:
                del inside[y]
            left += 1
        if len(inside) > best:
            best, where = len(inside), int(pos[left])
    return best, where


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The best window of each (document, item), a row for each with the lists of its matches; one call serves a batch of them."""
    for pdf in batches:
        rows = []
        for d, dk, i, ik, size, span, m in zip(pdf["doc_id"], pdf["dkey"], pdf["item_id"], pdf["ikey"], pdf["size"], pdf["span"], pdf["m"]):
            pos, h, pre = (np.array([x[c] for x in m], t) for c, t in (("pos", np.int64), ("h", np.int64), ("pre", bool)))
            rows.append((d, dk, i, ik, size, *_best(pos, h, pre, span)))
        yield pd.DataFrame(rows, columns=["doc_id", "dkey", "item_id", "ikey", "size", "matched", "start"])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, theta: float = THETA, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, matched, size, start) for every document and benchmark item whose containment reaches `theta`.

    matched of the item's size distinct shingles lie in its best window, the first such, which begins near word `start`. Null
    ids or texts, and texts or items without words, match nothing. Items with equal texts are reported each; an item_id or doc_id with
    several texts has a row for each that matches. Repeated rows count once. Extra columns aren't read.
    Empty tables give an empty result. A benchmark too large to broadcast is joined by shuffle on the shingles instead."""
    found = _found(docs, benchmark, id_col, text_col, n, theta, broadcast_bytes)
    return found.select("doc_id", "item_id", "matched", "size", "start")


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, n: int, theta: float, broadcast_bytes: int) -> DataFrame:
    need = F.ceil(F.lit(theta) * F.col("size") - 1e-9)
    doc, item = ["doc_id", "dkey"], ["item_id", "ikey"]
    bench = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null").distinct()
    bench = bench.withColumn("ikey", F.xxhash64("text"))
    items = materialise(bench.mapInPandas(_item_shingles(n), "item_id bigint, ikey bigint, h bigint, size int, n_words int, gram int"), "bench-items")
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null and text is not null").withColumn("dkey", F.xxhash64("text"))
    n_rows, grams = items.count(), sorted(r[0] for r in items.select("gram").distinct().collect())
    short = [m for m in grams if 0 < m < n]
    known = None
    if n_rows * 16 <= broadcast_bytes:  # its size is known; the list of hashes goes to every task
        by = items.select("gram", "h").distinct().toPandas()
        known = {m: np.sort(by.loc[by["gram"] == m, "h"].to_numpy(np.int64)) for m in (n, *short)}
        known = {m: h if len(h) else np.array([-1], np.int64) for m, h in known.items()}
    hits = base.mapInPandas(tidy(_doc_shingles(n, known, short)), "doc_id bigint, dkey bigint, h bigint, pos int")
    if known is None:
        hits = hits.join(items.select("h").distinct(), "h", "left_semi")
    hits = materialise(hits, "bench-hits")
    # Rarity over all documents; shingles that no document has are the rarest.
    counts = hits.groupBy("h").agg(F.count("*").alias("freq"))
    ranked = items.join(counts, "h", "left").select(*items.columns, F.coalesce("freq", F.lit(0)).alias("freq"))
    by_item = ranked.groupBy(*item, "size", "n_words", "gram").agg(F.sort_array(F.collect_list(F.struct("freq", "h"))).alias("s"))
    prefix = by_item.select(*item, F.explode(F.slice("s", 1, (F.col("size") - need + 1).cast("int"))).alias("p")).select(*item, F.col("p.h").alias("h"))
    prefix = materialise(prefix, "bench-prefix")
    # Candidates by prefix; then all matches of the candidates alone.
    cand = hits.join(maybe_broadcast(prefix, 40, broadcast_bytes), "h").select(*doc, *item).distinct()
    cand = materialise(cand, "bench-cand")
    flagged = items.join(prefix.select(*item, "h", F.lit(True).alias("pre")), [*item, "h"], "left")
    match = hits.join(cand.select(*doc).distinct(), doc, "left_semi").join(maybe_broadcast(flagged, 56, broadcast_bytes), "h").join(cand, [*doc, *item], "left_semi")
    match = match.select(*doc, *item, "size", (F.col("n_words") - F.col("gram")).alias("span"), F.struct("pos", "h", F.coalesce("pre", F.lit(False)).alias("pre")).alias("m"))
    # A pair's matches, no more than the document has words, in order of position. Length bound: too few distinct ones in all of the document can't fill a window.
    pairs = match.groupBy(*doc, *item, "size", "span").agg(F.sort_array(F.collect_set("m")).alias("m"))
    pairs = pairs.filter(F.size(F.array_distinct(F.transform("m", lambda x: x["h"]))) >= need)
    found = pairs.mapInPandas(tidy(_windows), "doc_id bigint, dkey bigint, item_id bigint, ikey bigint, size int, matched int, start int")
    return found.filter(F.col("matched") >= need)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, theta: float = THETA, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of `docs`, all columns, of documents that no benchmark item contaminates.

    A row goes if its own text is contaminated, so another text under the same id stays. Rows with null ids or texts stay, repeated
    rows stay or go together, columns of any name are carried along, and an empty table gives an empty result."""
    bad = materialise(_found(docs, benchmark, id_col, text_col, n, theta, broadcast_bytes).select(F.col("doc_id").alias("_bad"), F.col("dkey").alias("_key")).distinct(), "bench-bad")
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("_bad"), F.xxhash64(F.col(text_col).cast("string")).alias("_key"))
    return keyed.join(maybe_broadcast(bad, 32), ["_bad", "_key"], "left_anti").select("row.*")


_WORDS = "regexp_extract_all(lower(text), '[^\\x00-/:-@\\[-`{-\\x7f]+')"
_GRAMS = "list_transform(range(1, len(w) - g + 2), lambda i: array_to_string(w[i:i + g - 1], ' '))"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, {_WORDS} AS w, least({N}, len(w)) AS g FROM benchmark WHERE text IS NOT NULL),
bs AS (SELECT item_id, len(w) AS n_words, g, unnest(list_distinct({_GRAMS})) AS s FROM b WHERE len(w) > 0),
bz AS (SELECT item_id, count(*) AS size FROM bs GROUP BY item_id),
ds AS (SELECT doc_id, g, unnest(range(0, len(w) - g + 1)) AS pos, unnest({_GRAMS}) AS s FROM d, (SELECT DISTINCT g FROM bs) WHERE len(w) >= g),
m AS (SELECT doc_id, item_id, pos, s, n_words, g FROM ds JOIN bs USING (g, s)),
v AS (SELECT a.doc_id, a.item_id, a.pos AS start, count(DISTINCT c.s) AS matched FROM m a JOIN m c ON a.doc_id = c.doc_id AND a.item_id = c.item_id AND c.pos BETWEEN a.pos AND a.pos + a.n_words - a.g GROUP BY ALL),
x AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, start) = 1)
SELECT doc_id, item_id, matched, size, start FROM x JOIN bz USING (item_id) WHERE matched >= ceil({THETA} * size - 1e-9)
"""
