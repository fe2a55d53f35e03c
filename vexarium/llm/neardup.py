"""Near duplicates: b-bit MinHash signatures joined by a multi-index Hamming search.

A document's set is its word bigrams. Its signature holds K components of B bits, each the low bits of one minimum hash; the
distance of two signatures is the number of components in which they differ, about K * (1 - Jaccard).

The search is exact under that distance. The K components are split into CHUNKS chunks. If two signatures differ in at most R
components, by pigeonhole some chunk holds at most e = R // CHUNKS of the differences. All errors a chunk is allowed are
enumerated: for every choice of e of its components to leave out, the rest of the chunk is a key. So two signatures within R
share at least one key, whatever values the differing components take, and every pair that shares a key is compared in full.

A pair within R is only a candidate: it becomes an edge if a longer signature, of LONG components, agrees in LEAST of them. Groups are the
connected components of the edges, and a member of a group goes only if its set of bigrams, by 32-bit hashes of all of them, shares LEAST
of the union with that of the document that is kept for it; members too far from the least id of their group are grouped among themselves.

Equal signatures are collapsed before the join, and each bucket of a key yields a spanning forest of its edges rather than the pairs
themselves: the components are the same and the output stays linear however large the bucket. A bucket of more than BUCKET signatures
is cut into blocks, and each two of them are searched by a task of their own, so no task holds more than twice BUCKET.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vexarium.llm.common import Memo, materialise, maybe_broadcast, tidy, word_hash, words

K, B, CHUNKS, R = 32, 16, 8, 15
LEAST = 0.5  # the Jaccard similarity of near copies
LONG, BUCKET = 128, 4096

_RNG = np.random.default_rng(20240229)
_MUL = (_RNG.integers(1 << 31, size=256, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _RNG.integers(1 << 32, size=256, dtype=np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    return x


def bigrams(text: str | None, memo: Memo) -> np.ndarray:
    """A 32-bit hash of each word bigram, of the word itself for a single word."""
    w = words(text)
    if not w:
        return np.zeros(0, np.uint32)
    h = np.fromiter(map(memo.__getitem__, w), np.uint64, len(w))
    s = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] if len(h) > 1 else h * np.uint64(0x9E3779B97F4A7C15)
    s = (s ^ (s >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (s >> np.uint64(32)).astype(np.uint32)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def signatures(texts: list[str | None], k: int = K, memo: Memo | None = None) -> list[bytes | None]:
    """One signature of k 16-bit components for each text; None for a text without words. A single word counts as a bigram."""
    memo = Memo(word_hash) if memo is None else memo
    parts, sizes, where = [], [], []
    for i, text in enumerate(texts):
        s = bigrams(text, memo)
        if len(s):
            parts.append(s)
            sizes.append(len(s))
            where.append(i)
    out: list[bytes | None] = [None] * len(texts)
    # Slices of bounded size keep the working arrays in cache, however long the texts are.
    at = 0
    while at < len(parts):
        end, total = at, 0
        while end < len(parts) and (end == at or total + sizes[end] <= 1 << 16):
            total += sizes[end]
            end += 1
        shingles = np.concatenate(parts[at:end])
        starts = np.concatenate([[0], np.cumsum(sizes[at : end - 1])]).astype(np.int64)
        sig = np.empty((k, end - at), np.uint16)
        for j in range(k):
            sig[j] = np.minimum.reduceat(_mix(shingles * _MUL[j] + _ADD[j]), starts).astype(np.uint16)
        for row, i in zip(np.ascontiguousarray(sig.T), where[at:end]):
            out[i] = row.tobytes()
        at = end
    return out


def key_masks(k: int, chunks: int, radius: int) -> list[tuple[int, ...]]:
    """For every chunk and every choice of allowed errors in it, the components that are left as a key."""
    errors = radius // chunks
    out = []
    for part in np.array_split(np.arange(k), chunks):
        if len(part) <= errors:
            raise ValueError("a chunk must be longer than the errors it is allowed; use fewer chunks or a smaller radius")
        out += [tuple(int(c) for c in part if c not in drop) for drop in itertools.combinations(part, errors)]
    return out


def sig_keys(sigs: list[bytes], k: int, chunks: int, radius: int) -> np.ndarray:
    """A matrix of 64-bit keys, a row for each signature and a column for each mask."""
    s = np.frombuffer(b"".join(sigs), np.uint16).reshape(len(sigs), k).astype(np.uint64)
    masks = key_masks(k, chunks, radius)
    out = np.empty((len(sigs), len(masks)), np.uint64)
    for m, left in enumerate(masks):
        h = np.full(len(sigs), (m + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for c in left:
            h = (h ^ s[:, c]) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
        out[:, m] = h
    return out.view(np.int64)


def bucket_forest(ids: np.ndarray, sigs: np.ndarray, radius: int, k: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the graph of all pairs within `radius` in their first k components that agree in LEAST of the others beyond, if there
    are any: every member is searched for its unreached neighbours."""
    k = sigs.shape[1] if k is None else k
    left = np.arange(len(ids))
    edges = []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = (sigs[left, :k] != sigs[at, :k]).sum(axis=1) <= radius
            if sigs.shape[1] > k:
                hit = np.flatnonzero(near)
                near[hit] = (sigs[left[hit]] == sigs[at]).sum(axis=1) >= LEAST * sigs.shape[1]
            hit = left[near]
            edges += [(int(ids[at]), int(x)) for x in ids[hit]]
            queue += list(hit)
            left = left[~near]
    return edges


def hamming_pairs(sig_table: DataFrame, k: int = K, chunks: int = CHUNKS, radius: int = R, forest: bool = False, longer: Callable[[DataFrame], DataFrame] | None = None, bucket: int = BUCKET) -> DataFrame:
    """From (id bigint, sig binary), the pairs (a, b, dist) with a < b and at most `radius` differing components.

    All such pairs, each once, with forest=False. With forest=True, edges that connect the same components.
    `longer` gives (id, sig) with longer signatures for a table of ids; the forest then holds pairs that agree in LEAST of those."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at : at + 4096]
                m = sig_keys(list(part["sig"]), k, chunks, radius)
                yield pd.DataFrame({"key": m.ravel(), "id": np.repeat(part["id"].to_numpy(), m.shape[1])})

    # Ids alone are shuffled by key; signatures are fetched only for the ids of buckets with company. Equal buckets, known by the number and
    # hashes of their ids, are one. No bucket is gathered: it is counted by a window, which spills.
    own = Window.partitionBy("key")
    h = F.xxhash64("id")
    keyed = sig_table.mapInPandas(tidy(keys), "key bigint, id bigint").select("id", F.count("*").over(own).alias("n"), F.bit_xor(h).over(own).alias("x"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).over(own).alias("s"))
    member = keyed.filter("n > 1").select(F.xxhash64("n", "x", "s").alias("bucket"), "n", "id").distinct()
    # The block of an id in its bucket, and the cells (pairs of blocks) that it is searched in.
    blocks = F.ceil(F.col("n") / F.lit(bucket)).cast("int")
    mine = F.pmod(F.xxhash64("id", F.lit(1)), blocks).cast("int")
    cells = F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.struct(F.least(x, mine).alias("i"), F.greatest(x, mine).alias("j")))
    buckets = materialise(member.select("bucket", "id", F.explode(cells).alias("cell")).select("bucket", "cell.i", "cell.j", "id"), "near-buckets")
    members = buckets.join(sig_table if longer is None else longer(buckets.select("id").distinct()), "id")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, s = pdf["id"].to_numpy(np.int64), np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(len(pdf), -1)
        order = np.argsort(ids)
        ids, s = ids[order], s[order]
        if forest:
            e = np.array(bucket_forest(ids, s, radius, k), np.int64).reshape(-1, 2)
            return pd.DataFrame({"a": e[:, 0], "b": e[:, 1], "dist": 0})
        out = [pd.DataFrame({"a": [], "b": [], "dist": []}).astype(int)]
        for i in range(len(ids) - 1):
            d = (s[i + 1 :] != s[i]).sum(axis=1)
            near = np.flatnonzero(d <= radius)
            out.append(pd.DataFrame({"a": ids[i], "b": ids[i + 1 :][near], "dist": d[near]}))
        return pd.concat(out)

    # A number of its own keeps the buckets, small in bytes but not in work, from being joined into few tasks.
    parts = int(sig_table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.repartition(parts, "bucket", "i", "j").groupBy("bucket", "i", "j").applyInPandas(compare, "a bigint, b bigint, dist int").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id of the edges (a, b): root is the least id connected with it.

    Alternating large-star and small-star steps, each a shuffle of the edges, until nothing changes; the rounds grow with the
    logarithm of the longest chain. Each round is a table in the shared folder."""
    e = materialise(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u <> v").distinct(), "near-edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m"))
        large = both.join(least, "v").select(F.col("u").alias("v"), F.least("m", "v").alias("u")).filter("v > u").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("v > u").unionByName(least.select("v", F.col("m").alias("u"))).distinct()
        e = materialise(small, "near-edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == before:
            return e.select(F.col("v").alias("id"), F.col("u").alias("root"))
        before = now


def confirmed(roots: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, root) for the ids of `roots` (id, root) that are LEAST alike to root; the others of a group are grouped among themselves.

    sets (id, grams) has every id and root once. Among the others, each in the order of ids goes to the first kept one alike, or is kept."""

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            near = [jaccard(np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)) >= LEAST for a, b in zip(pdf["grams"], pdf["kept"])]
            yield pd.DataFrame({"id": pdf["id"], "root": pdf["root"], "near": near})

    def regroup(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, out = [], []
        for i, x in pdf.sort_values("id")[["id", "grams"]].itertuples(index=False):
            x = np.frombuffer(x, np.uint32)
            root = next((k for k, y in kept if jaccard(x, y) >= LEAST), None)
            if root is None:
                kept.append((i, x))
            else:
                out.append((i, root))
        return pd.DataFrame(out, columns=["id", "root"]).astype("int64")

    kept = sets.join(roots.select(F.col("root").alias("id")).distinct(), "id").select(F.col("id").alias("root"), F.col("grams").alias("kept"))
    held = materialise(roots.join(sets, "id").join(kept, "root").select("id", "root", "grams", "kept").mapInPandas(tidy(alike), "id bigint, root bigint, near boolean"), "near-held")
    rest = held.filter("not near").join(sets, "id").groupBy("root").applyInPandas(regroup, "id bigint, root bigint")
    return held.filter("near").select("id", "root").unionByName(rest)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, chunks: int = CHUNKS, radius: int = R) -> DataFrame:
    """(doc_id, keep_id) for every document that is a near copy of another and is not the one to keep.

    keep_id is the least id of the group that is LEAST alike to the document, by all bigrams (the least such, if rows of one id with different texts fall into several groups).
    Repeated rows collapse: an id has one row at most, and rows that share the id to keep aren't told apart. Null ids, null texts and
    texts without a word (empty, blank, punctuation) are never grouped. Extra columns are not read. An empty table gives an
    empty result. Texts of any length are read whole."""
    return _grouped(docs, id_col, text_col, k, chunks, radius).groupBy("doc_id").agg(F.min("keep_id").alias("keep_id"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, k: int, chunks: int, radius: int) -> DataFrame:
    """(doc_id, dkey, keep_id), dkey being a hash of the text, for each row that is a near copy and not the one to keep."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Memo(word_hash)
        for pdf in batches:
            sigs = signatures(list(pdf["text"]), k, memo)
            keep = [i for i, s in enumerate(sigs) if s is not None]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[keep], "dkey": pdf["dkey"].to_numpy()[keep], "sig": [sigs[i] for i in keep]})

    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null and text is not null").withColumn("dkey", F.xxhash64("text"))
    signed = materialise(base.mapInPandas(tidy(sign), "doc_id bigint, dkey bigint, sig binary"), "near-sigs")
    # Each distinct signature once, under its least id; further signatures of an id get numbers far above all ids.
    heads = signed.groupBy("sig").agg(F.min("doc_id").alias("doc_id"))
    nth, far = F.row_number().over(Window.partitionBy("doc_id").orderBy("sig")), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("doc_id", "sig"), 2)
    heads = materialise(heads.select("sig", "doc_id", F.when(nth == 1, F.col("doc_id")).otherwise(far).alias("id")), "near-heads")
    sets: list[DataFrame] = []

    def with_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Memo(word_hash)
        for pdf in batches:
            for at in range(0, len(pdf), 1000):  # batches stay small, as sets are as long as their texts
                part = pdf.iloc[at : at + 1000]
                sigs, grams = signatures(list(part["text"]), max(k, LONG), memo), [np.unique(bigrams(t, memo)).tobytes() for t in part["text"]]
                keep = [i for i, s in enumerate(sigs) if s is not None]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[keep], "sig": [sigs[i][: 2 * k] for i in keep], "long": [sigs[i] for i in keep], "grams": [grams[i] for i in keep]})

    def fetch(ids: DataFrame) -> DataFrame:
        # Bigrams of the candidates alone.
        wanted = materialise(heads.join(ids, "id", "left_semi").select("doc_id").distinct(), "near-wanted")
        own = base.select("doc_id", "text").join(maybe_broadcast(wanted, 16), "doc_id", "left_semi")
        own = own.mapInPandas(tidy(with_grams), "doc_id bigint, sig binary, long binary, grams binary").join(heads, ["doc_id", "sig"])
        sets.append(materialise(own.groupBy("id").agg(F.min(F.struct("sig", "long", "grams")).alias("x")).select("id", "x.long", "x.grams"), "near-grams"))
        return sets[0].select("id", F.col("long").alias("sig"))

    roots = components(hamming_pairs(heads.select("id", "sig"), k, chunks, radius, forest=True, longer=fetch))
    roots = confirmed(roots, sets[0].select("id", "grams"))
    kept = roots.join(heads.select(F.col("id").alias("root"), F.col("doc_id").alias("keep_id")), "root").select("id", "keep_id")
    final = heads.join(kept, "id", "left").select("sig", F.coalesce("keep_id", "doc_id").alias("keep_id"))
    return signed.join(final, "sig").filter("doc_id <> keep_id").select("doc_id", "dkey", "keep_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, chunks: int = CHUNKS, radius: int = R) -> DataFrame:
    """The rows of `docs`, all columns, without the near copies that near_groups finds; rows that were not grouped stay.

    A row goes by its id and its own text, so another text under the same id stays. Null ids, null texts and texts without a word stay,
    rows that repeat the one to keep stay with it, columns of any name are carried along, and an empty table gives an empty result."""
    gone = materialise(_grouped(docs, id_col, text_col, k, chunks, radius).select(F.col("doc_id").alias("_gone"), F.col("dkey").alias("_key")).distinct(), "near-gone")
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("_gone"), F.xxhash64(F.col(text_col).cast("string")).alias("_key"))
    return keyed.join(maybe_broadcast(gone, 32), ["_gone", "_key"], "left_anti").select("row.*")
