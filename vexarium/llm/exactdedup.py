"""Exact duplicates by a Golomb-coded fingerprint exchange.

Every input partition sends, to each owner of a range of fingerprints, one sorted and Golomb-Rice coded list of
its 63-bit fingerprints. An owner answers each sender with a bitmap: bit i says that the i-th fingerprint of that
list occurs more than once in the whole input. The bitmaps alone go back; a sender reads its marked fingerprints off its own
list. Only the suspects so marked are shuffled with their texts and compared byte by byte, so the texts of unique documents
never move. There are as many owners as the rows need for OWNER_ROWS each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexarium.llm.common import materialise, maybe_broadcast

FP_BITS = 63
LIST_ROWS = 1 << 20  # fingerprints of a sender's list
OWNER_ROWS = 2_000_000  # fingerprints that an owner gets, about


def golomb_encode(values: np.ndarray, universe_bits: int = FP_BITS) -> tuple[bytes, int]:
    """Sorted non-negative integers as Golomb-Rice coded gaps; returns the bytes and the Rice parameter.

    The quotients are unary (q ones, then a zero) in one bit stream, the remainders follow in fixed k bits."""
    n = len(values)
    if n == 0:
        return b"", 0
    gaps = values.astype(np.uint64)
    gaps[1:] -= gaps[:-1].copy()
    k = int(max(0, math.floor(math.log2(max(1.0, 0.69 * float(gaps.mean()))))))
    k = min(k, universe_bits - 1)
    while int((q := gaps >> np.uint64(k)).sum()) > 64 * n:  # a skewed list: keep the unary part short
        k += 1
    ends = np.cumsum(q.astype(np.int64) + 1) - 1
    unary = int(ends[-1]) + 1
    bits = np.ones(unary + n * k, np.uint8)
    bits[ends] = 0
    bits[unary:].reshape(n, k)[:] = (gaps[:, None] >> np.arange(k, dtype=np.uint64)[::-1]) & np.uint64(1)
    return np.packbits(bits).tobytes(), k


def golomb_decode(data: bytes, n: int, k: int) -> np.ndarray:
    """The inverse of golomb_encode."""
    if n == 0:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    zeros = np.flatnonzero(bits[: min(len(bits), 66 * n)] == 0)[:n]
    q = np.diff(zeros, prepend=-1).astype(np.uint64) - np.uint64(1)
    start = int(zeros[-1]) + 1
    low = np.zeros(n, np.uint64)
    for col in bits[start : start + n * k].reshape(n, k).T:
        low = (low << np.uint64(1)) | col.astype(np.uint64)
    return np.cumsum((q << np.uint64(k)) | low, dtype=np.uint64)


def _send(owners: int):
    width = (1 << FP_BITS) // owners + 1

    def lists(fp: np.ndarray, sender: str) -> pd.DataFrame:
        fp = np.sort(fp).astype(np.uint64)
        own = (fp // np.uint64(width)).astype(np.int64)
        out, edges = [], np.flatnonzero(np.diff(own, prepend=-1, append=owners))
        for a, b in zip(edges[:-1], edges[1:]):
            o = int(own[a])
            data, k = golomb_encode(fp[a:b] - np.uint64(o * width))
            out.append((sender, o, int(b - a), k, data))
        return pd.DataFrame(out, columns=["sender", "owner", "n", "k", "data"])

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        held, n, part = [], 0, 0
        name = TaskContext.get().partitionId()
        for pdf in batches:  # a sender is a partition, or each LIST_ROWS rows of it, which bounds its memory
            held.append(pdf["fp"].to_numpy(np.int64))
            n += len(pdf)
            if n >= LIST_ROWS:
                yield lists(np.concatenate(held), f"{name}-{part}")
                held, n, part = [], 0, part + 1
        if n:
            yield lists(np.concatenate(held), f"{name}-{part}")

    return f


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """An owner's bitmap for each of its senders' lists; nothing else goes back."""
    lists = [golomb_decode(d, n, k) for d, n, k in zip(pdf["data"], pdf["n"], pdf["k"])]
    every = np.sort(np.concatenate(lists))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    marks = [np.packbits(np.isin(x, twice)).tobytes() for x in lists]
    return pd.DataFrame({"sender": pdf["sender"], "owner": pdf["owner"], "marks": marks})


def _marked(owners: int):
    """A sender's own fingerprints that its owners marked, from its list and the bitmaps."""
    width = (1 << FP_BITS) // owners + 1

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for o, n, k, data, marks in zip(pdf["owner"], pdf["n"], pdf["k"], pdf["data"], pdf["marks"]):
                bits = np.unpackbits(np.frombuffer(marks, np.uint8))[:n].astype(bool)
                if bits.any():
                    fp = golomb_decode(data, n, k)[bits] + np.uint64(int(o) * width)
                    yield pd.DataFrame({"fp": np.unique(fp).astype(np.int64)})

    return f


def duplicated_fingerprints(fps: DataFrame, owners: int) -> DataFrame:
    """Distinct values of `fp` (bigint, >= 0) that occur more than once in `fps`, by the coded exchange.

    The senders' lists are a table, so they are the same lists when the answers come back, whatever is lost in between."""
    lists = materialise(fps.select("fp").mapInPandas(_send(owners), "sender string, owner int, n int, k int, data binary"), "dup-lists")
    answers = lists.repartition(owners, "owner").groupBy("owner").applyInPandas(_answer, "sender string, owner int, marks binary")
    return lists.join(answers, ["sender", "owner"]).mapInPandas(_marked(owners), "fp bigint").distinct()


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owners: int | None = None) -> DataFrame:
    """Every document whose text occurs more than once: (doc_id, keep_id, n_copies), keep_id being the least id of the copies.

    Texts are equal when all their bytes are. Null texts equal nothing and are left out; empty texts are equal to each
    other. A repeated row counts as a copy, so a repeated doc_id gives repeated rows. Null ids are kept in the result and
    never chosen as keep_id unless all the copies have null ids. Only the two named columns are read, so extra columns of any
    name do no harm. An empty table gives an empty result."""
    spark = docs.sparkSession
    owners = owners or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // OWNER_ROWS))
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    fp = F.xxhash64("text").bitwiseAND(F.lit((1 << FP_BITS) - 1))
    twice = materialise(duplicated_fingerprints(base.select(fp.alias("fp")), owners), "dup-fp")
    suspects = materialise(base.withColumn("fp", fp).join(maybe_broadcast(twice, 64), "fp", "left_semi"), "dup-suspects")
    # The byte comparison: grouping by the text itself, combined before the shuffle; a much copied text is one row per task.
    groups = materialise(suspects.groupBy("fp", "text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n_copies")), "dup-groups")
    per_fp = groups.groupBy("fp").agg(F.count("*").alias("n_texts"), F.max("keep_id").alias("keep_id"), F.max("n_copies").alias("n_copies"))
    # Nearly every fingerprint stands for one text, and its members need no text any more.
    single = suspects.select("fp", "doc_id").join(per_fp.filter("n_texts = 1 AND n_copies > 1"), "fp")
    collided = per_fp.filter("n_texts > 1").select("fp")
    several = suspects.join(groups.filter("n_copies > 1").join(collided, "fp", "left_semi"), ["fp", "text"])
    out = ("doc_id", "keep_id", "n_copies")
    return single.select(*out).unionByName(several.select(*out))


ORACLE = """
SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS n_copies
FROM documents WHERE text IS NOT NULL
QUALIFY count(*) OVER (PARTITION BY text) > 1
"""
