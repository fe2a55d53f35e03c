"""Token ids in compressed binary blocks: an adaptive context-mixing range coder.

Documents are tokenised with a public byte-level BPE (its file is a parameter), their ids concatenated and cut into blocks of BLOCK
tokens. Each block is coded on its own, from a reset model, and carries the CRC-32 of its ids, so a block can be read, checked or
lost without the others.

The model predicts each id from three orders. Orders 2 and 1 each predict one id, the one last confirmed after the two previous
ids, or after the previous id, with a confidence. Order 0 predicts by the counts so far of all the ids of the block. The three are
mixed by weights learned in the block for each state of the two confidences and their agreement; ids that orders 1 and 2
predicted are excluded from order 0. The weights and counts drive a 48-bit range coder with carries.

All blocks of a batch are coded in lockstep, a numpy lane for each block, so the Python cost is per step and not per token. The
encoder has the ids beforehand, so it takes what order 0 has below each of them from one pass over the batch; the decoder keeps sums.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cache, cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexarium.llm.common import tidy
from vexarium.llm.exactdedup import golomb_decode, golomb_encode

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK, LANES = 4096, 4096
SYMBOLS, WIDE = 4096, 16  # order-0 counts in groups of WIDE; a block has at most SYMBOLS different ids
INC, STEP, LIMIT = 2, 32, 1024
MASK = np.int64((1 << 48) - 1)

_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


# Without the look-ahead, which the library runs slowly, only a run of blanks before a text splits otherwise: its last blank goes with that
# text. Texts are cut there instead. These are the library's blanks; Python and RE2 have others by \s.
_PLAIN = _PATTERN.replace(r"\s+(?!\S)|", "")
_BLANK = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_CUT = re.compile(f"(?<={_BLANK})(?={_BLANK}[^{_BLANK[1:]})")


class Tokenizer:
    """Byte-level BPE of whole texts; ids fit 16 bits."""

    def __init__(self, path: str = TOKENIZER):
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(self.ranks.values()) >= 1 << 16:
            raise ValueError("ids must fit 16 bits")
        # Without any special token, the library looks for an empty one at every byte. This one is never allowed, so it is text.
        self.plain = tiktoken.Encoding("plain", pat_str=_PLAIN, mergeable_ranks=self.ranks, special_tokens={"<|none|>": 1 << 16})

    @cached_property
    def encoding(self):
        """The library's own, which `encode` agrees with."""
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=self.ranks, special_tokens={})

    def _ids(self, text: str) -> np.ndarray:
        return self.plain.encode_to_numpy(text, disallowed_special=()).astype(np.uint16)

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        texts = list(texts)
        runs = pc.match_substring_regex(pa.array(texts, pa.large_string()), _BLANK + "{2}").to_pylist()
        for text, run in zip(texts, runs):
            yield np.concatenate([self._ids(x) for x in _CUT.split(text)]) if run else self._ids(text or "")

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_all([text]))


@cache
def _tokenizer(path: str) -> Tokenizer:
    """One for each worker process, for all the tasks that it runs."""
    return Tokenizer(path)


#: The starting weights of a state, and its counter, as three fields of FIELD bits.
FIELD = 16
_INIT = np.array([sum(w << FIELD * e for e, w in enumerate((STEP * (s >> 3 > 0), STEP * ((s >> 1) & 3 > 0 and not s & 1), STEP))) for s in range(32)], np.int64)
_ONE = (1 << FIELD) - 1
_EACH = np.int64(1 | 1 << FIELD | 1 << 2 * FIELD)
# The encoder counts lesser ids one by one in as many positions, which fit a byte, and by table before; it prepares so many lanes, and so many steps, at once.
NEAR, TOGETHER, SLAB = 128, 16, 16


class _Model:
    """The adaptive state of n lanes, for decoding. A prediction is packed as id * 4 + confidence.

    Order 0 keeps the counts of the ids, `low`, and for each group of WIDE ids the sum of the groups before it, `top`. The tables are
    as wide as the largest alphabet of the lanes, which bounds the memory that a step touches."""

    def __init__(self, sizes: np.ndarray):
        n = len(sizes)
        self.groups = max(1, -(-int(sizes.max(initial=1)) // WIDE))
        self.stride = self.groups * WIDE
        low = (np.arange(self.stride)[None, :] < sizes[:, None]).astype(np.int16)
        sums = low.reshape(n, self.groups, WIDE).sum(2, dtype=np.int16)
        self.top = np.cumsum(sums, axis=1, dtype=np.int16) - sums
        self.low = low.reshape(-1)
        self.later = (np.arange(self.groups)[None, :] > np.arange(self.groups)[:, None]).astype(np.int16) * np.int16(INC)
        self.total = sizes.astype(np.int32)
        self.one, self.two = np.zeros(n * self.stride, np.int16), np.zeros(n * SYMBOLS, np.int16)
        self.weights = np.tile(_INIT, n)
        self.c1, self.c2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
        lane = np.arange(n, dtype=np.int64)
        self.at_state, self.at_id, self.at_pair = lane * 32, lane * self.stride, lane * SYMBOLS

    def predict(self, n: int) -> None:
        c1 = self.c1[:n]
        self.i1 = self.at_id[:n] + c1
        self.i2 = self.at_pair[:n] + (((c1 * 40503 + self.c2[:n] * 2654435761) >> 7) & (SYMBOLS - 1))
        self.v1, self.v2 = self.one.take(self.i1), self.two.take(self.i2)
        self.a1, self.a2, b1, b2 = self.v1 >> 2, self.v2 >> 2, self.v1 & 3, self.v2 & 3
        self.has1, self.has2 = b1 > 0, b2 > 0
        same = self.has1 & self.has2 & (self.a1 == self.a2)
        self.has1 &= ~same
        self.state = self.at_state[:n] + (b2 * 8 + b1 * 2 + same)
        self.w = self.weights.take(self.state)
        self.w0 = self.w & _ONE
        self.w01 = self.w0 + ((self.w >> FIELD) & _ONE)
        self.sum = self.w01 + (self.w >> 2 * FIELD)

    def update(self, n: int, x: np.ndarray, event: np.ndarray) -> None:
        """`x` are the ids, 64-bit."""
        w = self.w + (STEP << event * FIELD)
        big = (self.sum > LIMIT - STEP).nonzero()[0]
        if len(big):
            v = w[big]
            w[big] = sum((((v >> e * FIELD) & _ONE) + 1 >> 1) << e * FIELD for e in range(3))
        self.weights[self.state] = w
        narrow = x.astype(np.int16)
        x4 = narrow << 2
        for table, i, v, a in ((self.one, self.i1, self.v1, self.a1), (self.two, self.i2, self.v2, self.a2)):
            b = v & 3
            hit = (a == narrow) & (b > 0)
            table[i] = np.where(hit | (b > 1), v & ~3, x4) | np.where(hit, np.minimum(b + 1, 3), np.maximum(b - 1, 1))
        at = self.at_id[:n] + x
        self.low[at] = self.low.take(at) + np.int16(INC)
        self.top[:n] += self.later.take(x >> 4, axis=0)
        self.total[:n] += INC
        self.c2[:n] = self.c1[:n]
        self.c1[:n] = x

    def excluded(self, j: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids that orders 1 and 2 predicted, and their order-0 counts, which are left out of order 0."""
        base = self.at_id.take(j)
        return [(x := a.take(j), self.low.take(base + x).astype(np.int32) * has.take(j)) for a, has in ((self.a2, self.has2), (self.a1, self.has1))]


def _divide(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a // b; exact in doubles because a is below 2 ** 48."""
    return (a / b).astype(np.int64)


def below(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How much the lesser ids have in order 0 before each id: 1 each, and INC for each time that one came. A row for each lane; `sizes`
    are the sizes of the alphabets."""
    n, steps = x.shape
    parts = -(-steps // NEAR)
    full = np.zeros((n, parts, NEAR), np.int16)
    full.reshape(n, -1)[:, :steps] = x
    near = np.ascontiguousarray(full.transpose(2, 0, 1)).reshape(NEAR, -1)
    count, less = np.zeros(near.shape, np.uint8), np.empty(near.shape, bool)
    for d in range(1, NEAR):
        np.less(near[:-d], near[d:], out=less[d:])
        count[d:] += less[d:].view(np.uint8)
    sums = np.empty((n, parts * NEAR), np.int16)
    for lane in range(n):
        wide = int(sizes[lane]) + 1
        at = (full[lane] + np.arange(0, parts * wide, wide)[:, None]).ravel()
        came = np.bincount(at + (wide + 1), minlength=parts * wide)[: parts * wide].astype(np.int16).reshape(parts, wide)  # by the next part and id
        sums[lane] = came.cumsum(0, dtype=np.int16).cumsum(1, dtype=np.int16).ravel().take(at)
    sums += count.reshape(NEAR, n, parts).transpose(1, 2, 0).reshape(n, -1)
    return sums[:, :steps] * np.int16(INC) + x


def encode_lanes(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block's ids (at most BLOCK of them) as bytes: the block's alphabet, Golomb coded, then the range coder's words.

    `table` holds, for each id of a lane, its order-0 count and order 1's prediction side by side, then order 2's predictions. Empty ones
    have the ids -2 and -1, which differ and have counts of 0 before the lane's first."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    n, steps = len(blocks), max((len(b) for b in blocks), default=0)
    heads, sizes, lens = [], np.zeros(n, np.int64), np.array([len(blocks[i]) for i in order], np.int64)
    xs, less = np.zeros((steps + 2, n), np.int16), np.zeros((steps, n), np.int16)  # xs: after two steps of id 0
    rank = np.zeros(1 << 16, np.int16)  # read at a block's own ids only
    for first in range(0, n if steps else 0, TOGETHER):
        own = slice(first, min(first + TOGETHER, n))
        x = np.zeros((own.stop - first, steps), np.int16)
        for lane in range(first, own.stop):
            ids = blocks[order[lane]]
            alphabet = np.sort(ids, kind="stable")  # by radix
            alphabet = alphabet[np.append(True, alphabet[1:] != alphabet[:-1])[: len(ids)]]
            rank[alphabet] = np.arange(len(alphabet))
            x[lane - first, : len(ids)] = rank.take(ids)
            sizes[lane] = len(alphabet)
            data, k = golomb_encode(alphabet.astype(np.uint64), 16)
            heads.append(len(ids).to_bytes(2, "little") + len(alphabet).to_bytes(2, "little") + bytes([k]) + len(data).to_bytes(3, "little") + data)
        xs[2:, own], less[:, own] = x.T, below(x, sizes[own]).T
    lanes = np.arange(n, dtype=np.int64)
    ends = 2 * np.cumsum(sizes + 2)
    at_id, pairs = ends - 2 * sizes, int(ends[-1]) if n else 0
    table = np.empty(pairs + n * SYMBOLS, np.int16)
    table[:pairs:2], table[1:pairs:2], table[pairs:] = 1, -2 << 2, -1 << 2
    table[at_id - 4] = table[at_id - 2] = 0
    at_pair, at_state, weights = pairs + lanes * SYMBOLS, lanes * 32, np.tile(_INIT, n)
    at = np.empty((SLAB, 3, n), np.int64)  # order 1, order 2, count
    low, rng = np.zeros(n), np.full(n, float(MASK))  # whole numbers below 2 ** 49, exact in doubles
    size = 2 * steps + 4
    out, pos = np.zeros(n * size, np.uint16), lanes * size
    sizes = sizes.astype(np.int32)
    active = np.searchsorted(-lens, -np.arange(steps), side="left")  # lanes longer than t
    for t in range(steps):
        u = t % SLAB
        if not u:
            s, c1, c2 = (xs[t + 2 - d : min(t + SLAB, steps) + 2 - d] for d in range(3))
            at[: len(s), 0] = at_id + (c1 * 2 + 1)
            at[: len(s), 1] = at_pair + (((c1.astype(np.uint32) * np.uint32(40503) + c2.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(7)) & np.uint32(SYMBOLS - 1))
            at[: len(s), 2] = at_id + s * 2
            packed = s << 2
        k = int(active[t])
        i, x4, lo, ra = at[u, :, :k], packed[u, :k], low[:k], rng[:k]
        got = table.take(i)
        v, f = got[:2], got[2]  # the predictions of orders 1 and 2, the count of the id
        b = v & 3
        hit = ((v ^ x4) - np.int16(1)).view(np.uint16) < 3
        same = (v[0] ^ v[1]).view(np.uint16) < 4
        gone = table.take(at_id[:k] + ((v >> 1) & ~1))  # order-0 counts of the ids that orders 1 and 2 predicted
        gone[0] *= ~same
        state = at_state[:k] + (b[1] * 8 + b[0] * 2 + same)
        w = weights.take(state)
        known = hit[0] | hit[1]
        shift = (2 * FIELD - ((known.view(np.int8) + hit[1]) * np.int8(FIELD))).astype(np.int64)  # 0 for order 2, FIELD for order 1, else 2 * FIELD
        sums = w * _EACH
        total = (sums >> 2 * FIELD) & _ONE
        r = np.floor(ra / total)
        lo += r * (((sums << FIELD) >> shift) & _ONE)
        ra[:] = r * ((w >> shift) & _ONE)
        w += STEP << shift
        big = (total > LIMIT - STEP).nonzero()[0]
        if len(big):
            w[big] = ((w.take(big) + _EACH) >> 1) & (_EACH * (_ONE >> 1))
        weights[state] = w
        # Order 0 narrows the range again where nothing was hit, elsewhere it is all of 1.
        miss = ~known
        rest = (sizes[:k] + np.int32(INC * t) - gone[0] - gone[1]) * miss + known
        gone *= v < x4
        r = np.floor(ra / rest)
        lo += r * ((less[t, :k] - gone[0] - gone[1]) * miss)
        ra[:] = r * (f * miss + known)
        # A hit confirms, a miss takes confidence off or, at the least, replaces.
        new = x4 + np.int16(1) + np.minimum(b, 2) * hit
        v -= new + np.int16(1)
        v *= (b > 1) & ~hit
        v += new
        f += np.int16(INC)
        table[i] = got
        over = (lo > MASK).nonzero()[0]
        if len(over):
            lo[over] -= MASK + 1
            q = pos[over] - 1
            while len(q):
                out[q] += 1
                q = q[out[q] == 0] - 1
        for _ in range(2):
            j = (ra < 1 << 32).nonzero()[0]
            if not len(j):
                break
            e, q = lo.take(j), pos.take(j)
            top = np.floor(e * 2.0**-32)
            out[q] = top.astype(np.uint16)
            pos[j] = q + 1
            lo[j] = (e - top * 2.0**32) * 2.0**16
            ra[j] = ra.take(j) * 2.0**16
    done: list[bytes] = [b""] * n
    for lane, i in enumerate(order):
        if len(blocks[i]):
            v, p = int(low[lane]), int(pos[lane])
            out[p : p + 3] = [v >> 32, v >> 16 & 0xFFFF, v & 0xFFFF]
            done[i] = heads[lane] + out[lane * size : p + 3].astype("<u2").tobytes()
        else:
            done[i] = bytes(8)
    return done


def decode_lanes(payloads: list[bytes]) -> list[np.ndarray]:
    """The inverse of encode_lanes."""
    parsed = []
    for i, p in enumerate(payloads):
        n, m, k, size = int.from_bytes(p[:2], "little"), int.from_bytes(p[2:4], "little"), p[4], int.from_bytes(p[5:8], "little")
        parsed.append((n, i, golomb_decode(p[8 : 8 + size], m, k).astype(np.uint16), np.frombuffer(p[8 + size :], "<u2").astype(np.int64)))
    parsed.sort(key=lambda x: -x[0])
    n, steps = len(parsed), max((x[0] for x in parsed), default=0)
    lens = np.array([x[0] for x in parsed], np.int64)
    words = np.zeros((n, max([len(x[3]) for x in parsed], default=0) + 4), np.int64)
    for lane, x in enumerate(parsed):
        words[lane, : len(x[3])] = x[3]
    m = _Model(np.array([len(x[2]) for x in parsed], np.int64))
    rel = (words[:, 0] << 32) | (words[:, 1] << 16) | words[:, 2]
    pos, rng = np.full(n, 3, np.int64), np.full(n, MASK, np.int64)
    out = np.zeros((steps, n), np.int64)
    active = np.searchsorted(-lens, -np.arange(steps), side="left")
    groups, within = np.arange(m.groups), np.arange(WIDE)
    for t in range(steps):
        k = int(active[t])
        m.predict(k)
        re_, ra = rel[:k], rng[:k]
        r = _divide(ra, m.sum)
        v = np.minimum(_divide(re_, r), m.sum - 1)
        event = np.where(v < m.w0, 0, np.where(v < m.w01, 1, 2))
        re_ -= r * np.where(event == 0, 0, np.where(event == 1, m.w0, m.w01))
        ra[:] = r * ((m.w >> event * FIELD) & _ONE)
        s = np.where(event == 0, m.a2, m.a1).astype(np.int64)
        j = np.flatnonzero(event == 2)
        if len(j):
            total, base, undo = m.total[j], m.at_id[j], m.excluded(j)
            sums = m.top[j].astype(np.int32)
            for a, gone in undo:
                total -= gone
                sums -= gone[:, None] * (groups[None, :] > (a >> 4)[:, None])
            r = _divide(ra[j], np.maximum(total, 1))
            v = np.minimum(_divide(re_[j], r), total - 1)
            group = (sums <= v[:, None]).sum(1) - 1
            each = m.low.reshape(-1, WIDE)[(base >> 4) + group].astype(np.int32)
            for a, gone in undo:
                each -= gone[:, None] * (group[:, None] * WIDE + within[None, :] == a[:, None])
            ends = np.cumsum(each, axis=1) + sums[np.arange(len(j)), group][:, None]
            cell = (ends <= v[:, None]).sum(1)
            f = each[np.arange(len(j)), cell]
            re_[j] -= r * (ends[np.arange(len(j)), cell] - f)
            ra[j] = r * f
            s[j] = group * WIDE + cell
        out[t, :k] = s
        m.update(k, s, event)
        for _ in range(2):
            j = (ra < 1 << 32).nonzero()[0]
            if not len(j):
                break
            re_[j] = (re_[j] << 16) | words[j, pos[j]]
            pos[j] += 1
            ra[j] <<= 16
    result = [np.zeros(0, np.uint16)] * n
    for lane, (size, i, alphabet, _) in enumerate(parsed):
        result[i] = alphabet[out[:size, lane]]
    return result


def _flush(ids: list, streams: list[np.ndarray | None], shard: int, first: int, block: int, lanes: int) -> tuple[pd.DataFrame, int]:
    lens = np.array([0 if s is None else len(s) for s in streams], np.int64)
    ends = np.cumsum(lens)
    flow = np.concatenate([s for s in streams if s is not None] or [np.zeros(0, np.uint16)])
    cuts = list(range(0, len(flow), block)) or [0]
    blocks = [flow[c : c + block] for c in cuts]
    rows, d = [], 0
    payloads = [p for at in range(0, len(blocks), lanes) for p in encode_lanes(blocks[at : at + lanes])]
    for b, (c, ids_) in enumerate(zip(cuts, blocks)):
        docs, starts, sizes = [], [], []
        while d < len(ids):
            begin = int(ends[d] - lens[d])
            lo, hi = max(begin, c), min(int(ends[d]), c + len(ids_))
            last = b == len(cuts) - 1
            if begin >= c + len(ids_) and not last:
                break
            docs.append(ids[d])
            starts.append(lo - begin)
            sizes.append(-1 if streams[d] is None else hi - lo)
            if ends[d] > c + len(ids_):
                break
            d += 1
        rows.append((shard, first + b, docs, starts, sizes, len(ids_), zlib.crc32(ids_.astype("<u2").tobytes()), payloads[b]))
    return pd.DataFrame(rows, columns=["shard", "block", "doc_ids", "starts", "sizes", "n_tokens", "crc", "payload"]), first + len(blocks)


SCHEMA = "shard int, block int, doc_ids array<bigint>, starts array<int>, sizes array<int>, n_tokens int, crc bigint, payload binary"


def token_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, block: int = BLOCK, lanes: int = LANES) -> DataFrame:
    """Compressed blocks with their directory, a row for each: which documents (doc_ids), from which token of each (starts), and how many
    of its tokens (sizes), in the order of the block's stream.

    Every row of `docs` is in the directory once or more: an empty text with size 0, a null text with size -1, a null id as null,
    repeated rows as often as they are there, a long text over as many blocks as it needs. Extra columns aren't read. An empty table
    gives no blocks. One pass, without a shuffle; a task holds `lanes` blocks at a time."""
    if not 0 < block <= BLOCK:
        raise ValueError(f"a block holds 1 to {BLOCK} tokens")

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        tok, shard, first = _tokenizer(tokenizer), TaskContext.get().partitionId(), 0
        ids, streams, size = [], [], 0
        for pdf in batches:
            for i, text, s in zip(pdf["doc_id"].astype("Int64"), pdf["text"], tok.encode_all(pdf["text"])):
                s = None if text is None else s
                ids.append(None if i is pd.NA else int(i))
                streams.append(s)
                size += 0 if s is None else len(s)
                if size >= block * lanes:
                    out, first = _flush(ids, streams, shard, first, block, lanes)
                    yield out
                    ids, streams, size = [], [], 0
        if ids:
            yield _flush(ids, streams, shard, first, block, lanes)[0]

    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInPandas(tidy(f), SCHEMA)


def read_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, shard, block, start, ids) of every piece; raises on a checksum that doesn't match."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for ids, (_, r) in zip(decode_lanes(list(pdf["payload"])), pdf.iterrows()):
                if zlib.crc32(ids.astype("<u2").tobytes()) != r["crc"]:
                    raise ValueError(f"block {r['shard']}/{r['block']} is damaged")
                at = 0
                for d, s, n in zip(r["doc_ids"], r["starts"], r["sizes"]):
                    rows.append((None if d is None or d != d else int(d), r["shard"], r["block"], int(s), None if n < 0 else ids[at : at + n].astype(np.int32)))
                    at += max(int(n), 0)
            yield pd.DataFrame(rows, columns=["doc_id", "shard", "block", "start", "ids"]).astype({"doc_id": "Int64"})

    return blocks.mapInPandas(f, "doc_id bigint, shard int, block int, start int, ids array<int>")
