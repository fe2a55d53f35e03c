"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact token length for each source. A source's budget is its weight's share of the total; a bounded
knapsack over (length, count) decides how many documents of each length to take so that their lengths sum to the budget, or
to the largest sum below it that the search reaches. Which documents of a length are taken is decided by a seeded hash.

The search: each length first gives its proportional share, rounded down, less a slack; the remaining budget, a few times the longest
length, is then filled exactly by dynamic programming over the lengths with documents left, a bit set of reachable sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from vexarium.llm.common import materialise, maybe_broadcast

SEED = 17
#: The whole mixture, as a share of all tokens.
BUDGET_SHARE = 0.5


def token_length(text) -> F.Column:
    """Exact number of tokens: runs of characters other than space, tab, line feed and carriage return. JVM-side."""
    return F.regexp_count(text, F.lit("[^ \\t\\n\\r]+"))


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, at most `counts`: their total is the largest sum of lengths up to `budget`.

    The knapsack is given a rest of a few longest documents. If it doesn't fill that exactly, as with few documents, the rest grows until
    it does, or until the knapsack has the whole budget."""
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    if budget >= int((lengths * counts).sum()):
        return counts.copy()
    if budget <= 0 or not len(lengths):
        return np.zeros(len(lengths), np.int64)
    goal = budget - budget % max(1, int(np.gcd.reduce(lengths[(lengths > 0) & (counts > 0)])))
    slack = 2
    while True:
        take, whole = _fit(lengths, counts, budget, slack)
        if whole or int((lengths * take).sum()) == goal:
            return take
        slack *= 4


def _fit(lengths: np.ndarray, counts: np.ndarray, budget: int, slack: int) -> tuple[np.ndarray, bool]:
    """The counts, and whether the knapsack had all of the budget."""
    total, longest = int((lengths * counts).sum()), int(lengths.max())
    # Proportional floor below the budget, leaving `slack` longest documents' worth, and one more, to the knapsack.
    share = max(0.0, (budget - slack * longest) / total)
    take = np.floor(counts * share).astype(np.int64)
    rest = budget - int((lengths * take).sum())
    if share > 0:
        # Floors lose up to one document a length: give those back in order of lost share while enough rest remains.
        for i in np.lexsort((lengths, -(counts * share - take))):
            if rest <= (slack + 1) * longest:
                break
            if take[i] < counts[i] and lengths[i] <= rest - slack * longest:
                take[i] += 1
                rest -= int(lengths[i])
        if rest > (slack + 1) * longest:
            for i in np.argsort(-lengths, kind="stable"):
                n = min(int(counts[i] - take[i]), max(0, (rest - slack * longest) // max(1, int(lengths[i]))))
                take[i] += n
                rest -= n * int(lengths[i])
    whole = not take.any()
    # Bounded knapsack: multiplicities in binary parts, one bit set of reachable sums after each part.
    items = []
    for i in np.flatnonzero((counts > take) & (lengths > 0) & (lengths <= rest)):
        left, size = int(min(counts[i] - take[i], rest // lengths[i])), 1
        while left > 0:
            n = min(size, left)
            items.append((int(i), n))
            left -= n
            size *= 2
    items.sort(key=lambda x: (lengths[x[0]] * x[1], x[0]))
    mask, reach, trail = (1 << (rest + 1)) - 1, 1, []
    for i, n in items:
        new = (reach | reach << (n * int(lengths[i]))) & mask
        if new != reach:
            trail.append((i, n, reach))
            reach = new
        if reach >> rest & 1:
            break
    at = reach.bit_length() - 1
    for i, n, before in reversed(trail):
        if not before >> at & 1:
            take[i] += n
            at -= n * int(lengths[i])
    return take, whole


def plan(hist: DataFrame, weights: dict[str, float] | None, budget: int | None) -> DataFrame:
    """(source, n_tokens, have, take) from (source, n_tokens, have); a source's DP runs as one task over its length counts."""
    totals = hist.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("have")).alias("tokens"))
    all_tokens = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    budget = int(all_tokens * BUDGET_SHARE) if budget is None else budget
    if weights is None:  # equal weights for all sources
        n = max(1, totals.count())
        totals = totals.withColumn("quota", F.floor(F.lit(budget) / F.lit(n)).cast("bigint"))
    else:
        total_w = sum(weights.values()) or 1.0
        pairs = [(k, int(budget * v / total_w)) for k, v in sorted(weights.items())]
        w = hist.sparkSession.createDataFrame(pairs, "source string, quota bigint")
        totals = totals.join(F.broadcast(w), "source", "left").fillna(0, ["quota"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n_tokens")
        take = fit_counts(pdf["n_tokens"].to_numpy(), pdf["have"].to_numpy(), int(pdf["quota"].iloc[0]))
        return pd.DataFrame({"source": pdf["source"], "n_tokens": pdf["n_tokens"], "have": pdf["have"], "take": take})

    return hist.join(totals.select("source", "quota"), "source").groupBy("source").applyInPandas(fit, "source string, n_tokens bigint, have bigint, take bigint")


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """Each row as the struct `row` (so no column of it can clash) with its source, length and seeded rank."""
    return docs.select(F.struct("*").alias("row"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"), F.coalesce(token_length(F.col("text").cast("string")), F.lit(0)).cast("bigint").alias("_len"), F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.col("text").cast("string")).alias("_rank"))


def selection(docs: DataFrame, weights: dict[str, float] | None = None, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """The rows of `docs`, all columns, that make up the mixture.

    Weights are by source (None: equal), the budget is in tokens (None: half of all). A source whose tokens don't fill its share
    gives all it has. Documents of no tokens (null, empty or blank texts) cost nothing and are all kept where their source has any
    budget. Null sources form the source ''. Rows that tie in the seeded hash (repeated rows) are taken or left by their count: at
    most as many as the plan says. An empty table gives an empty result."""
    own = docs.select("doc_id", "text", "source")
    narrow = materialise(_keyed(own, seed).select("_source", "_len", "_rank"), "mix-lengths")
    hist = materialise(narrow.groupBy(F.col("_source").alias("source"), F.col("_len").alias("n_tokens")).agg(F.count("*").alias("have")), "mix-hist")
    chosen = materialise(plan(hist, weights, budget), "mix-plan")
    # A cut for each (source, length): the rank of the last document taken. Only hashes are shuffled, by (source, length).
    partial = chosen.filter("take > 0 AND take < have").select(F.col("source").alias("_source"), F.col("n_tokens").alias("_len"), "take")
    ranks = narrow.join(maybe_broadcast(partial, 48), ["_source", "_len"]).groupBy("_source", "_len", "take", "_rank").agg(F.count("*").alias("c"))
    order = F.sum("c").over(_by_rank())
    cuts = ranks.withColumn("upto", order).filter("upto <= take").groupBy("_source", "_len").agg(F.max("_rank").alias("_cut"))
    whole = chosen.filter("take = have OR n_tokens = 0").filter("take > 0 OR n_tokens = 0").select(F.col("source").alias("_source"), F.col("n_tokens").alias("_len"), F.lit((1 << 63) - 1).cast("bigint").alias("_cut"))
    table = materialise(cuts.unionByName(whole), "mix-cuts")
    return _keyed(docs, seed).join(maybe_broadcast(table, 48), ["_source", "_len"]).filter("_rank <= _cut").select("row.*")


def _by_rank() -> WindowSpec:
    return Window.partitionBy("_source", "_len").orderBy("_rank")


def mixture(docs: DataFrame, weights: dict[str, float] | None = None, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents that `selection` takes."""
    out = selection(docs.select("doc_id", "text", "source"), weights, budget, seed)
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(token_length(F.col("text").cast("string")), F.lit(0)).cast("bigint").alias("n_tokens"))
