"""Toxicity by a cumulative-link (proportional odds) model over sparse text features.

Grades are 0 (not toxic) and 1 to 3 (mild, marked, severe). The labels say toxic or not, so the grades of toxic documents are the
tertiles of their evidence, the log-odds of their significant features: grades above 0 order documents by that evidence and are no
independent judgement. One weight vector w serves all the ordered thresholds: P(grade <= g) = sigmoid(t_g - w.x), t_0 < t_1 < t_2.
The result is the expected severity, the sum of g * P(g).

Features are the words and the word beginnings of 4, 5 and 6 letters; x is log(1 + count). Only features whose log-odds
between the labelled classes are significant and large are kept, so long clean texts gather no weight from chance words.

The cut-off of P(grade >= 1) that rejects a document is learned too: each of FOLDS parts of the sample is scored by a model that is
selected and fitted on the others, and the cut is the one of the largest recall less COST times the share of clean documents
rejected, among those that reject at most FALSE_REJECTS of the clean ones.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexarium.llm.common import materialise, tidy, words

GRADES = 4
SAMPLE_ROWS = 20_000  # the bound on labelled rows used for fitting, taken in the order of a hash of their ids
MIN_DOCS, MIN_Z, MIN_LOG_ODDS = 4, 4.0, math.log(4)
FOLDS, COST, FALSE_REJECTS = 4, 4.0, 0.03
REJECT_AT = 0.5  # the cut-off of a model that learned none


def features(text: str | None) -> Counter:
    """Counts of words (as they are) and of beginnings (marked by a slash, which no word holds)."""
    w = words(text)
    c = Counter(w)
    out = Counter(c)
    for x, n in c.items():
        t = x.decode("utf-8", "replace")
        for k in (4, 5, 6):
            if len(t) > k:
                out[f"{t[:k]}/".encode()] += n
    return out


@dataclass
class OrdinalModel:
    weights: dict[bytes, float]
    cuts: np.ndarray
    reject_at: float = REJECT_AT

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade) for each score, a row for each."""
        below = 1 / (1 + np.exp(np.clip(score[:, None] - self.cuts[None, :], -50, 50)))
        edges = np.hstack([np.zeros((len(score), 1)), below, np.ones((len(score), 1))])
        return np.diff(edges, axis=1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        w = self.weights
        whole = {k.decode("utf-8", "replace").encode(): v for k, v in w.items() if not k.endswith(b"/")}
        heads = {k[:-1].decode("utf-8", "replace"): v for k, v in w.items() if k.endswith(b"/")}
        starts = {h[:4] for h in heads}
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            c: Counter = Counter()
            for x in words(text):
                if x in whole:
                    c[x] += 1
                t = x.decode("utf-8", "replace")
                if t[:4] in starts:
                    for k in (4, 5, 6):
                        if len(t) > k and t[:k] in heads:
                            c[t[:k]] += 1
            out[i] = sum((whole[k] if isinstance(k, bytes) else heads[k]) * math.log1p(n) for k, n in c.items())
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_ordinal(x: list[dict[int, float]], y: np.ndarray, n_features: int, l2: float = 0.5, steps: int = 300, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model with an L2 prior on the weights, by Adam over the whole sample, so without
    chance; thresholds stay ordered as t_0 + sum of exp."""
    lens = np.array([len(d) for d in x], np.int64)
    idx = np.fromiter((i for d in x for i in d), np.int64, int(lens.sum()))
    val = np.fromiter((v for d in x for v in d.values()), np.float64, int(lens.sum()))
    owner, n = np.repeat(np.arange(len(x)), lens), max(1, len(x))
    clean = float(np.clip((y == 0).mean() if len(y) else 0.5, 0.01, 0.99))
    theta = np.zeros(n_features + GRADES - 1)  # weights, t_0, log gaps
    theta[n_features] = math.log(clean / (1 - clean))
    one, two = np.zeros_like(theta), np.zeros_like(theta)
    first, last = y == 0, y == GRADES - 1
    up, down = np.minimum(y, GRADES - 2), np.maximum(y - 1, 0)
    for step in range(1, steps + 1):
        w, base, gaps = theta[:n_features], theta[n_features], theta[n_features + 1 :]
        cuts = base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        s = np.bincount(owner, val * w[idx], minlength=len(x))
        fh, fl = np.where(last, 1.0, _sigmoid(cuts[up] - s)), np.where(first, 0.0, _sigmoid(cuts[down] - s))
        p = np.maximum(fh - fl, 1e-12)
        dh, dl = fh * (1 - fh) / p, fl * (1 - fl) / p
        g = dh - dl  # d(-log p)/ds
        dcut = np.bincount(up, -dh, GRADES - 1) + np.bincount(down, dl, GRADES - 1)
        grad = np.empty_like(theta)
        grad[:n_features] = np.bincount(idx, val * g[owner], minlength=n_features) + l2 * w
        grad[n_features] = dcut.sum()
        grad[n_features + 1 :] = np.array([dcut[k + 1 :].sum() for k in range(GRADES - 2)]) * np.exp(gaps)
        grad /= n
        one += 0.1 * (grad - one)
        two += 0.001 * (grad**2 - two)
        slow = rate if step <= steps // 2 else rate * 2 * (1 - step / (steps + 1))
        theta -= slow * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-9)
    w, base, gaps = theta[:n_features], theta[n_features], theta[n_features + 1 :]
    return w, base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def _grades(y: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    """0 for clean documents, 1 to 3 for toxic ones by the tertiles of their evidence."""
    third, two = np.quantile(evidence[y == 1], [1 / 3, 2 / 3])
    return np.where(y == 0, 0, 1 + (evidence > third).astype(int) + (evidence > two).astype(int))


def choose_cut(p: np.ndarray, y: np.ndarray, cost: float = COST, false_rejects: float = FALSE_REJECTS) -> float:
    """The cut of p with the largest recall of y = 1 less `cost` times the share of y = 0 at or above it, which is at most `false_rejects`.

    Midway between two scores; of equally good ones the highest. REJECT_AT if no cut is better than rejecting nothing."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    last = np.append(p[1:] != p[:-1], True)
    recall, false = np.cumsum(y == 1) / max(1, (y == 1).sum()), np.cumsum(y == 0) / max(1, (y == 0).sum())
    worth = np.where(last & (false <= false_rejects), recall - cost * false, -1.0)
    k = int(np.argmax(worth))
    if not len(p) or worth[k] <= 0:
        return REJECT_AT
    return float((p[k] + p[k + 1]) / 2) if k + 1 < len(p) else float(p[k])


def _p_toxic(x: list[dict[int, float]], w: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.array([1 - _sigmoid(cuts[0] - sum(w[i] * v for i, v in d.items())) for d in x])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """Fit on at most `sample_rows` labelled documents. Without labels of both kinds the model rejects nothing.

    Labels with a null id or null `toxic`, and those whose document is missing or has a null text, are left out; an id with several labels
    is toxic if one of them says so; each row of an id that documents repeats is a case of its own. Extra columns aren't read."""
    spark = docs.sparkSession
    nothing = OrdinalModel({}, np.array([30.0, 31.0, 32.0]))
    lab = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).toPandas()  # bounded by the parameter
    if chosen["toxic"].nunique() < 2:
        return nothing
    few = F.broadcast(spark.createDataFrame(chosen.astype({"doc_id": "int64", "toxic": "int32"}), "doc_id bigint, toxic int"))
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id")), F.lit(FOLDS)).cast("int").alias("fold")
    sample = materialise(text.join(few, "doc_id").select("doc_id", "text", F.greatest(F.signum("toxic"), F.lit(0)).cast("int").alias("toxic"), fold).repartition(F.col("doc_id")), "tox-sample")
    cells = [f"{kind}{k}" for kind in ("good", "bad") for k in range(FOLDS)]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()  # a feature's counts in the cells, side by side in one number; a sample's are below 2 ** 32

        def out() -> pd.DataFrame:
            n = list(seen.values())
            got = pd.DataFrame({"f": list(seen)} | {c: [x >> 32 * i & 0xFFFFFFFF for x in n] for i, c in enumerate(cells)}).astype(dict.fromkeys(cells, "int64"))
            seen.clear()
            return got

        for pdf in batches:
            for t, y, k in zip(pdf["text"], pdf["toxic"], pdf["fold"]):
                one = 1 << 32 * (y * FOLDS + k)
                for x in features(t):
                    seen[x] += one
                if len(seen) > 100_000:
                    yield out()
        yield out()

    counts = sample.mapInPandas(tidy(count), "f binary, " + ", ".join(f"{c} bigint" for c in cells)).groupBy("f").agg(*[F.sum(c).alias(c) for c in cells])
    totals = {(r["toxic"], r["fold"]): r["n"] for r in sample.groupBy("toxic", "fold").agg(F.count("*").alias("n")).collect()}
    n = [sum(v for (y, _), v in totals.items() if y == kind) for kind in (0, 1)]
    if not all(n):
        return nothing

    def odds(without: int | None) -> tuple[F.Column, F.Column]:
        """The log-odds of a feature and whether it is chosen, by all the folds but one."""
        folds = [k for k in range(FOLDS) if k != without]
        bad, good = (sum((F.col(f"{kind}{k}") for k in folds[1:]), F.col(f"{kind}{folds[0]}")) for kind in ("bad", "good"))
        n0, n1 = (sum(totals.get((y, k), 0) for k in folds) for y in (0, 1))
        a, b = bad + 0.5, good + 0.5
        o = F.log(a / (F.lit(n1 + 1.0) - a)) - F.log(b / (F.lit(n0 + 1.0) - b))
        return o, (bad + good >= MIN_DOCS) & (F.abs(o) >= MIN_LOG_ODDS) & (F.abs(o / F.sqrt(1 / a + 1 / b)) >= MIN_Z)

    views = [None, *range(FOLDS)]  # the whole sample, and it without each fold
    both = [odds(k) for k in views]
    flags = counts.select("f", *[F.when(ok, o).alias(f"o{i}") for i, (o, ok) in enumerate(both)])
    vocab = flags.filter(F.coalesce(*[f"o{i}" for i in range(len(views))]).isNotNull()).orderBy("f").toPandas()  # features significant in a bounded sample
    index = {bytes(f): i for i, f in enumerate(vocab["f"])}

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t, y, k in zip(pdf["text"], pdf["toxic"], pdf["fold"]):
                f = {x: c for x, c in features(t).items() if x in index}
                out.append((int(y), int(k), [index[x] for x in f], list(map(math.log1p, f.values()))))
            yield pd.DataFrame(out, columns=["y", "fold", "i", "v"])

    rows = sample.mapInPandas(tidy(vectors), "y int, fold int, i array<int>, v array<double>").toPandas()
    y, fold_of = rows["y"].to_numpy(np.int64), rows["fold"].to_numpy()

    def fit(view: int, on: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[dict[int, float]]]:
        o = vocab[f"o{view}"].to_numpy(np.float64)
        use = ~np.isnan(o)
        x = [{int(i): v for i, v in zip(a, b) if use[i]} for a, b in zip(rows["i"], rows["v"])]
        evidence = np.array([sum(o[i] * v for i, v in d.items()) for d in x])
        here = np.flatnonzero(on)
        return *fit_ordinal([x[i] for i in here], _grades(y[here], evidence[here]), len(index)), x

    held = np.zeros(len(y))
    for k in range(FOLDS):
        on, off = fold_of != k, np.flatnonzero(fold_of == k)
        if len(off) and len(set(y[on])) == 2:
            w, cuts, x = fit(1 + k, on)
            held[off] = _p_toxic([x[i] for i in off], w, cuts)
    w, cuts, _ = fit(0, np.ones(len(y), bool))
    return OrdinalModel({f: float(w[i]) for f, i in index.items() if w[i] != 0}, cuts, choose_cut(held, y))


def severity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, severity, p_toxic, grade, rejected) for each row of `docs`.

    severity is the expected grade, p_toxic is P(grade >= 1), grade the likeliest, and rejected says p_toxic >= model.reject_at. Null and
    empty texts have no features and get the model's base rate, which rejects nothing by itself. Repeated rows and null ids are
    scored as they are. Extra columns aren't read. An empty table gives an empty result. Texts are read whole."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = model.probabilities(model.score(list(pdf["text"])))
            bad = 1 - p[:, 0]
            empty = np.array([not t for t in pdf["text"]], bool)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "severity": np.round(p @ np.arange(GRADES), 6), "p_toxic": np.round(bad, 6), "grade": p.argmax(axis=1), "rejected": (bad >= model.reject_at) & ~empty})

    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInPandas(tidy(f), "doc_id bigint, severity double, p_toxic double, grade int, rejected boolean")


def drop_toxic(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """The rows of `docs`, all columns, that the model doesn't reject, in one pass and without a shuffle.

    Rows are judged by their text alone: null and empty texts stay, null ids and columns of any name do no harm, repeated rows stay or
    go together. An empty table gives an empty result. Texts are read whole."""

    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        p = model.probabilities(model.score(list(text)))
        return pd.Series((1 - p[:, 0] < model.reject_at) | np.array([not t for t in text], bool))

    return docs.filter(clean(docs["text"].cast("string")))
