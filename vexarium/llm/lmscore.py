"""Language-model scores by a log-bilinear neural model, trained in numpy by noise-contrastive estimation.

Every word has a vector r and a bias b, every context position j a vector c_j that scales its word's own. A context h predicts the
vector q = sum over j of c_j * r(h_j), and a word scores q . r(w) + b(w). The vocabulary is factored: its words, by falling frequency, form
as many classes as each has words, and log P(w | h) = log P(class | h) + log P(w | class, h), both log-bilinear and both normalised exactly, by
products of the matrix of a batch's contexts with the matrix of the classes, and with that of the words of each class.

The vocabulary grows with the corpus: D distinct words give D ** (2/3) ids, CLASS * CLASSES at least. Every other word is UNKNOWN followed by
its spelling, log P(w | h) = log P(UNKNOWN | h) + log P(letters of w), where the letters follow an interpolated trigram model of bytes that
is counted over all words without an id.

Word counts cover the whole corpus. Training covers every position of it: the texts are dealt to shards by a hash, so what a shard holds, its order
and its noise are the corpus's own and don't follow the input's partitions. Each shard runs noise-contrastive estimation (a
binary choice between the true word and noise drawn from the unigram distribution, normaliser fixed at one) over its texts from
the same start, and the parameters of all shards are averaged, each weighted by the positions it saw. A further round starts from there.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexarium.llm.common import materialise, words

CLASS, CLASSES, DIM, CONTEXT = 64, 64, 16, 2  # the least number of words of a class, and of classes; id 0 is any word that is spelled out, 1 the start of a text
NOISE, BATCH, LEARN, RATE, ROUNDS, SEED = 16, 32768, 8192, 0.05, 1, 11
HEAD, LARGEST, CELLS, ALONE = 2048, 80.0, 1 << 17, 64  # ids whose pairs' normalisers a task computes beforehand; exp of it is a float; numbers of a step of the other normalisers; rows of a class that is computed by itself
SHARD_WORDS, SHARDS = 4_000_000, 1024  # about as many words in a shard, and no more shards than this, each then larger
UNKNOWN, START = 0, 1
SMOOTH = 4.0  # the weight of the next shorter context of a letter
# Codes of the bytes that words() leaves, 0 for the end of a word.
_LETTERS = bytes(c for c in range(256) if c >= 128 or chr(c).isalnum() and not 65 <= c <= 90)
_CODE = np.zeros(256, np.int32)
_CODE[list(_LETTERS)] = np.arange(1, len(_LETTERS) + 1)
CODES = len(_LETTERS) + 1


@dataclass
class LogBilinear:
    """`words` holds the ids' words; `vec` and `bias` have a row for each id, `cvec` and `cbias` for each class, `pos` for each position.
    `spell` is the log-probability of a letter after two others, by their codes."""

    index: dict[bytes, int]
    unigram: np.ndarray
    vec: np.ndarray
    bias: np.ndarray
    cvec: np.ndarray
    cbias: np.ndarray
    pos: np.ndarray
    spell: np.ndarray | None = None
    n_words: int = 0  # of the corpus that the model was started from

    @property
    def size(self) -> int:
        return len(self.bias)

    @property
    def width(self) -> int:
        """Words of a class."""
        return self.size // len(self.cbias)

    def ids(self, text: str | None) -> np.ndarray:
        w = words(text)
        return np.fromiter(map(self.index.get, w, repeat(UNKNOWN)), np.int32, len(w))

    def spelled(self, texts: list[list[bytes]]) -> np.ndarray:
        """For each list of words, the sum of their log-probabilities letter by letter."""
        out = np.zeros(len(texts))
        at = [i for i, w in enumerate(texts) if w]
        if at:
            parts = [b"  ".join(texts[i]) for i in at]
            cells = _trigrams(b"  ".join(parts))
            starts = np.cumsum([0, *(len(x) + 2 for x in parts[:-1])])
            out[at] = np.add.reduceat(self.spell[cells].astype(np.float64), starts)
        return out

    def copy(self) -> LogBilinear:
        return LogBilinear(self.index, self.unigram, self.vec.copy(), self.bias.copy(), self.cvec.copy(), self.cbias.copy(), self.pos.copy(), self.spell, self.n_words)

    def context(self, flow: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The predicted vectors at the positions `at` of a flow."""
        q = self.vec.take(flow[at - 1], axis=0)
        q *= self.pos[0]
        for j in range(1, CONTEXT):
            x = self.vec.take(flow[at - 1 - j], axis=0)
            x *= self.pos[j]
            q += x
        return q

    def log_probs(self, flow: np.ndarray, at: np.ndarray, known: tuple[np.ndarray | None, np.ndarray | None] = (None, None)) -> np.ndarray:
        """Normalised log P of the words at the positions `at` given the CONTEXT words before each; `known` is of pair_sums()."""
        out = np.empty(len(at), np.float32)
        classes, own = np.hstack([self.cvec, self.cbias[:, None]]), np.hstack([self.vec, self.bias[:, None]])
        for k in range(0, len(at), BATCH):
            part = at[k : k + BATCH]
            target = flow[part]
            order = np.argsort((target // self.width).astype(np.int16), kind="stable")
            target, part = target[order], part[order]
            cls = target // self.width
            q = np.ones((len(part), DIM + 1), np.float32)
            q[:, :DIM] = self.context(flow, part)
            x = classes.take(cls, axis=0)
            x += own.take(target, axis=0)
            lp = np.einsum("ij,ij->i", q, x)
            edges = np.searchsorted(cls, np.arange(len(self.cbias) + 1))
            lp -= self.log_sums(flow, part, q, classes, known[0])
            for c in np.flatnonzero(np.diff(edges)):
                a, b, lo = edges[c], edges[c + 1], c * self.width
                lp[a:b] -= self.log_sums(flow, part[a:b], q[a:b], own[lo : lo + self.width], None if c else known[1])
            out[k + order] = lp
        return out

    def log_sums(self, flow: np.ndarray, at: np.ndarray, q: np.ndarray, rows: np.ndarray, known: np.ndarray | None) -> np.ndarray:
        """log of the sum of exp(q . r + b) over `rows` (r, b), for the contexts q, each with a one at its end, of the positions `at`."""
        z = np.empty(len(q), np.float32)
        if known is not None:
            first, second = flow[at - 1], flow[at - 2]
            rest = np.flatnonzero((first >= len(known)) | (second >= len(known)))
            z[:] = known[np.minimum(first, len(known) - 1), np.minimum(second, len(known) - 1)]
            z[rest] = self.log_sums(flow, at[rest], q[rest], rows, None)
            return z
        step, one = max(1, CELLS // len(rows)), np.ones(len(rows), np.float32)
        for k in range(0, len(q), step):  # few enough to stay in a CPU's cache
            s = q[k : k + step] @ rows.T
            np.exp(s, out=s)
            np.matmul(s, one, out=z[k : k + step])
        return np.log(z, out=z)

    def pair_sums(self) -> tuple[np.ndarray | None, np.ndarray | None]:
        """log_sums() of the classes, and of the words of the first class, for all contexts of two of the HEAD most frequent ids.

        q is a sum over the two words, so exp(q . r) is a product of a factor of each, and all sums are one matrix product of the factors. None
        where factors are so large that it might leave the range of a float."""
        out = []
        for r, b in ((self.cvec, self.cbias), (self.vec[: self.width], self.bias[: self.width])):
            first, second = ((self.vec[:HEAD] * p) @ r.T for p in self.pos)
            first += b
            if max(np.abs(first).max(), np.abs(second).max()) < LARGEST / 2:
                sums = np.exp(first, out=first) @ np.exp(second, out=second).T
                out.append(np.log(sums, out=sums))
            else:
                out.append(None)
        return out[0], out[1]

    def learn(self, flow: np.ndarray, at: np.ndarray, rng: np.random.Generator, rate: float = RATE) -> None:
        """One pass of minibatch NCE over the positions `at` of a flow, in place, with AdaGrad steps.

        A batch shares its noise: NOISE classes, and NOISE words of each class for the positions whose word is of that class."""
        n_classes, width = len(self.cbias), self.width
        cuni = self.unigram.reshape(-1, width).sum(axis=1)
        within = self.unigram.reshape(-1, width) / cuni[:, None]
        ccdf, wcdf = np.cumsum(cuni), np.cumsum(self.unigram)
        low = np.concatenate([[0.0], wcdf[width - 1 : -1 : width]])
        logk = np.log(NOISE)
        clog, wlog = (np.log(cuni) + logk).astype(np.float32), (np.log(within).ravel() + logk).astype(np.float32)
        squares = [np.full(x.shape, 1e-6, np.float32) for x in (self.vec, self.bias, self.cvec, self.cbias, self.pos)]
        used, place = np.zeros(self.size, bool), np.zeros(self.size, np.int32)
        for k in range(0, len(at), LEARN):
            part = at[k : k + LEARN]
            part = part[np.argsort((flow[part] // width).astype(np.int16), kind="stable")]
            target = flow[part]
            cls = target // width
            heard = [flow[part - 1 - j] for j in range(CONTEXT)]
            n, said = np.float32(len(part)), [self.vec.take(h, axis=0) for h in heard]
            q = said[0] * self.pos[0]
            for x, p in zip(said[1:], self.pos[1:]):
                q += x * p
            rc, rt = self.cvec.take(cls, axis=0), self.vec.take(target, axis=0)
            # P(the true one is taken for noise), for both factors
            gc = 1 / (1 + np.exp(np.einsum("ij,ij->i", q, rc) + (self.cbias - clog)[cls]))
            gt = 1 / (1 + np.exp(np.einsum("ij,ij->i", q, rt) + (self.bias - wlog)[target]))
            grad = gc[:, None] * rc
            grad += gt[:, None] * rt
            d_cvec, d_cbias = _sums(cls, gc[:, None] * q, n_classes), np.bincount(cls, gc, n_classes)
            noise = np.minimum(np.searchsorted(ccdf, rng.random(NOISE) * ccdf[-1]), n_classes - 1)
            taken, back = _noise(q, self.cvec[noise], (self.cbias - clog)[noise])
            grad -= back
            np.subtract.at(d_cvec, noise, taken[:, :DIM])
            np.subtract.at(d_cbias, noise, taken[:, DIM])
            edges = np.searchsorted(cls, np.arange(n_classes + 1))
            present = np.flatnonzero(np.diff(edges))
            drawn = np.searchsorted(wcdf, low[present, None] + rng.random((len(present), NOISE)) * cuni[present, None])
            drawn = np.clip(drawn, present[:, None] * width, present[:, None] * width + width - 1)
            against = _noise_within(q, edges[present], np.diff(edges)[present], self.vec.take(drawn, axis=0), self.bias[drawn] - wlog[drawn], grad)
            # Sums and steps are of the words of this batch alone, whatever the size of the vocabulary.
            drawn, against = drawn.ravel(), against.reshape(-1, DIM + 1)
            used[:] = False
            for ids in (target, drawn, *heard):
                used[ids] = True
            own = np.flatnonzero(used)
            place[own] = np.arange(len(own), dtype=np.int32)
            d_bias = np.bincount(place[target], gt, len(own)) - np.bincount(place[drawn], against[:, DIM], len(own))
            d_pos = np.array([np.einsum("ij,ij->j", grad, x) for x in said])
            d_vec = _sums(place[np.concatenate([target, drawn, *heard])], np.concatenate([gt[:, None] * q, -against[:, :DIM], *(grad * p for p in self.pos)]), len(own))
            every = np.arange(n_classes)
            for x, d, sq, rows in zip((self.vec, self.bias, self.cvec, self.cbias, self.pos), (d_vec, d_bias, d_cvec, d_cbias, d_pos), squares, (own, own, every, every, every[:CONTEXT])):
                d = (d / n).astype(np.float32)
                total = sq.take(rows, axis=0)
                total += d * d
                sq[rows] = total
                d *= rate
                d /= np.sqrt(total, out=total)
                d += x.take(rows, axis=0)
                x[rows] = d


def _sums(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """The sum of the rows of `values` for each of `size` row numbers."""
    rows, out = rows.astype(np.intp), np.empty((DIM, size))
    for x, column in zip(out, np.ascontiguousarray(values.T, np.float64)):
        x[:] = np.bincount(rows, column, size)
    return np.ascontiguousarray(out.T)


def _noise(q: np.ndarray, r: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For noise rows r with offsets b: the gradients of the rows and their biases, and by q; of minus log P(noise is known as noise)."""
    s = q @ r.T
    s += b
    np.negative(s, out=s)
    np.exp(s, out=s)
    s += 1
    np.reciprocal(s, out=s)
    return np.hstack([s.T @ q, s.sum(axis=0)[:, None]]), s @ r


def _noise_within(q: np.ndarray, starts: np.ndarray, lens: np.ndarray, r: np.ndarray, b: np.ndarray, grad: np.ndarray) -> np.ndarray:
    """_noise() for classes, whose `lens` rows of q begin at `starts`, each against its own r and b; what goes back is taken off `grad`.

    Small classes of about the same length are computed at once, filled up with rows that count for nothing."""
    out = np.empty((*r.shape[:2], DIM + 1), np.float32)
    for i in np.flatnonzero(lens > ALONE):
        rows = slice(starts[i], starts[i] + lens[i])
        out[i], back = _noise(q[rows], r[i], b[i])
        grad[rows] -= back
    width = ALONE
    while width:
        i = np.flatnonzero((lens <= width) & (lens > width // 2))
        if len(i):
            inside = np.arange(width) < lens[i, None]
            at = np.where(inside, starts[i, None] + np.arange(width), 0)
            x, y = q.take(at, axis=0), r[i]
            s = x @ y.transpose(0, 2, 1)
            s += b[i, None]
            np.negative(s, out=s)
            np.exp(s, out=s)
            s += 1
            np.divide(inside[:, :, None], s, out=s)
            out[i, :, :DIM], out[i, :, DIM] = s.transpose(0, 2, 1) @ x, s.sum(axis=1)
            grad[at[inside]] -= (s @ y)[inside]
        width //= 2
    return out


def _trigrams(joined: bytes) -> np.ndarray:
    """The cell of each letter of words that are joined by two blanks, and of the end of each, by its code and those of the two before."""
    c = _CODE[np.frombuffer(b"  " + joined + b" ", np.uint8)]
    return (c[:-2] * CODES + c[1:-1]) * CODES + c[2:]


def spelling(cells: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The table of log P(letter | two before) from the counts `n` of trigram cells; no word is empty, and the blank between words is free."""
    tri = np.bincount(cells, n, CODES**3).astype(float).reshape(CODES, CODES, CODES)
    tri[:, 0, 0] = 0
    bi = tri.sum(axis=0)
    p = (bi.sum(axis=0) + 1) / (bi.sum() + CODES)
    p = (bi + SMOOTH * p) / (bi.sum(axis=1, keepdims=True) + SMOOTH)
    p[0, 0] = 0
    p[0] /= p[0].sum()
    tri += SMOOTH * p
    tri /= tri.sum(axis=2, keepdims=True)
    tri[:, 0, 0] = 1
    return np.log(tri, out=tri).astype(np.float32).ravel()


def side(distinct: int) -> int:
    """The number of classes, and of words of a class: the vocabulary is its square."""
    return max(CLASSES, int(np.ceil(round(distinct ** (1 / 3), 6))))


def begin(counts: list[tuple[bytes, int]], unknown: int, k: int = CLASSES, spell: np.ndarray | None = None) -> LogBilinear:
    """The start of training: the unigram model (biases are log frequencies) with small random vectors, k classes of k words."""
    n = k * k
    freq = np.ones(n)
    freq[UNKNOWN] += unknown
    index = {}
    for i, (w, c) in enumerate(counts[: n - 2], 2):
        index[w], freq[i] = i, c + 1
    unigram = freq / freq.sum()
    cuni = unigram.reshape(-1, k).sum(axis=1)
    rng = np.random.default_rng(SEED)
    vec = rng.normal(0, 0.1, (n, DIM)).astype(np.float32)
    cvec = rng.normal(0, 0.1, (k, DIM)).astype(np.float32)
    bias = np.log(unigram / np.repeat(cuni, k)).astype(np.float32)
    return LogBilinear(index, unigram, vec, bias, cvec, np.log(cuni).astype(np.float32), np.ones((CONTEXT, DIM), np.float32) / CONTEXT, spell)


def _flow(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' ids with CONTEXT starts before each, the positions of the words, and each text's number of words."""
    lens = np.array([len(x) for x in ids], np.int64)
    at = np.arange(int(lens.sum())) + np.repeat(CONTEXT * np.arange(1, len(ids) + 1), lens)
    flow = np.full(len(at) + CONTEXT * len(ids), START, np.int32)
    flow[at] = np.concatenate([np.zeros(0, np.int32), *ids])
    return flow, at, lens


def _encoded(ids: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _flow([np.frombuffer(x, np.int32) for x in ids])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, n) over all texts: a Counter for each task, summed by a shuffle of distinct words."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        for pdf in batches:
            for t in pdf["text"]:
                c.update(words(t))
            if len(c) > 1_000_000:
                yield pd.DataFrame({"word": list(c), "n": list(c.values())})
                c.clear()
        yield pd.DataFrame({"word": list(c), "n": list(c.values())}).astype({"n": "int64"})

    return docs.select("text").mapInPandas(f, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def letter_counts(counts: DataFrame) -> DataFrame:
    """(cell, n): how often each trigram of letters occurs in the words (word, n), a word n times."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CODES**3, np.int64)
        for pdf in batches:
            if len(pdf):
                cells = _trigrams(b"  ".join(pdf["word"]))
                times = np.repeat(pdf["n"].to_numpy(), pdf["word"].str.len().to_numpy() + 2)[: len(cells)]
                total += np.bincount(cells, times, CODES**3).astype(np.int64)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"cell": at.astype(np.int32), "n": total[at]})

    return counts.mapInPandas(f, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))


def start(texts: DataFrame) -> LogBilinear:
    """The untrained model of `texts` (text), from the word counts of all of them. Words of the counts that fit into the vocabulary have ids."""
    counts = materialise(word_counts(texts), "lm-words")
    by_count = sorted(((r["n"], r["m"]) for r in counts.groupBy("n").agg(F.count("*").alias("m")).collect()), reverse=True)
    distinct, taken, least = sum(m for _, m in by_count), 0, 0
    k = side(distinct)
    for n, m in by_count:
        if taken + m > k * k - 2:
            least = n + 1
            break
        taken += m
    top = sorted(((bytes(r["word"]), r["n"]) for r in counts.filter(F.col("n") >= least).collect()), key=lambda x: (-x[1], x[0]))
    cells = letter_counts(counts.filter(F.col("n") < least)).toPandas()
    model = begin(top, sum(n * m for n, m in by_count if n < least), k, spelling(cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.float64)))
    return replace(model, n_words=sum(n * m for n, m in by_count))


def encode(docs: DataFrame, model: LogBilinear, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, spelled): each row's words as 32-bit ids, none for a null text, and the log-probability of the letters of those without one."""
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, unigram=None, vec=None, bias=None))

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            ids, rest = [], []
            for t in pdf["text"]:
                w = words(t)
                x = np.fromiter(map(m.index.get, w, repeat(UNKNOWN)), np.int32, len(w))
                ids.append(x.tobytes())
                rest.append([w[i] for i in np.flatnonzero(x == UNKNOWN)])
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "ids": ids, "spelled": m.spelled(rest)})

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(f, "doc_id bigint, ids binary, spelled double")


def train(encoded: DataFrame, model: LogBilinear, rounds: int = ROUNDS) -> LogBilinear:
    """The model after `rounds` rounds of training on all of `encoded`; without any words, as it was.

    The same rows give the same model, whatever their order and partitions. A shard's rows are chosen by their id and text, so copies of a text are spread."""
    from pyspark import TaskContext

    shards = int(np.clip(-(-model.n_words // SHARD_WORDS), 1, SHARDS))
    rank = F.xxhash64("doc_id", "ids")
    encoded = encoded.select("ids", rank.alias("rank")).repartition(shards, "rank").sortWithinPartitions("rank", "ids")

    for number in range(rounds):
        shared = encoded.sparkSession.sparkContext.broadcast(replace(model, index={}, spell=None))

        def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # Noise and order differ by shard and round, the same when a task is repeated; later rounds take smaller steps.
            m, rng, seen = shared.value.copy(), np.random.default_rng([SEED, number, TaskContext.get().partitionId()]), 0
            for pdf in batches:
                flow, at, _ = _encoded(pdf["ids"])
                m.learn(flow, rng.permutation(at), rng, RATE / (1 + number))
                seen += len(at)
            if seen:
                rows = np.vstack([np.hstack([m.vec, m.bias[:, None]]), np.hstack([m.cvec, m.cbias[:, None]]), np.hstack([m.pos, np.zeros((CONTEXT, 1), np.float32)])])
                yield pd.DataFrame({"row": np.arange(len(rows), dtype=np.int32), "p": list(rows * float(seen)), "seen": seen})

        parts = encoded.select("ids").mapInPandas(f, "row int, p array<double>, seen bigint")
        mean = [(F.sum(F.col("p")[j]) / F.sum("seen")).alias(f"p{j}") for j in range(DIM + 1)]
        got = parts.groupBy("row").agg(*mean).toPandas().sort_values("row").to_numpy()[:, 1:].astype(np.float32)  # as long as the vocabulary
        if not len(got):
            break
        n, k = model.size, len(model.cbias)
        cut = [got[a:b, :DIM].copy() for a, b in ((0, n), (n, n + k), (n + k, None))]
        model = LogBilinear(model.index, model.unigram, cut[0], got[:n, DIM].copy(), cut[1], got[n : n + k, DIM].copy(), cut[2], model.spell, model.n_words)
    return model


def score(encoded: DataFrame, model: LogBilinear) -> DataFrame:
    """(doc_id, n_tokens, unknown, log_prob, perplexity) for each row of `encoded`."""
    shared = encoded.sparkSession.sparkContext.broadcast(replace(model, index={}, spell=None))

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, known, seen = shared.value, (None, None), 0
        for pdf in batches:
            flow, at, lens = _encoded(pdf["ids"])
            before, seen = seen, seen + len(at)
            if before < HEAD * HEAD // 4 <= seen:  # enough positions to be worth it
                known = m.pair_sums()
            owner = np.repeat(np.arange(len(lens)), lens)
            lp = np.bincount(owner, m.log_probs(flow, at, known), minlength=len(lens)) + pdf["spelled"].to_numpy()
            unknown = np.bincount(owner, flow[at] == UNKNOWN, minlength=len(lens)).astype(np.int64)
            perplexity = pd.Series(np.round(np.exp(-lp / np.maximum(lens, 1)), 4), index=pdf.index).where(lens > 0)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_tokens": lens, "unknown": unknown, "log_prob": np.round(lp, 4), "perplexity": perplexity})

    return encoded.mapInPandas(f, "doc_id bigint, n_tokens bigint, unknown bigint, log_prob double, perplexity double")


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Train on all of `docs` and score each of its rows: (doc_id, n_tokens, unknown, log_prob, perplexity).

    log_prob is the sum of the normalised natural log-probabilities of the text's words, perplexity exp of minus its mean, unknown the
    number of words outside the vocabulary, which are spelled out. Null texts, and texts without words, have n_tokens 0, log_prob 0
    and a null perplexity. Repeated rows and null ids are trained on and scored as they are. Extra columns aren't read. An empty table
    gives an empty result. Texts are read whole."""
    model = start(docs.select(F.col(text_col).cast("string").alias("text")).filter("text is not null"))
    encoded = materialise(encode(docs, model, id_col, text_col), "lm-ids")
    return score(encoded, train(encoded, model, rounds))
