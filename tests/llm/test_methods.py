"""Each operator against brute force, an exact round trip or held-out accuracy."""

import hashlib
import itertools
import math
import os
import random
import re
import string
import time
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vexarium.llm import common, decontam, exactdedup, htmltext, lmscore, mixing, neardup, pii, secretscan, tokenout, toxicity

RNG = random.Random(5)
WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ra", "so", "ti", "ve", "zu") for b in ("bar", "den", "fol", "gim", "hut", "jas", "kel", "lon", "mar", "nep")]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# ---------------------------------------------------------------- exact duplicates


@given(st.lists(st.integers(0, (1 << 63) - 1), max_size=200))
@settings(max_examples=60, deadline=None)
def test_golomb_round_trip(values):
    v = np.sort(np.array(values, np.uint64))
    data, k = exactdedup.golomb_encode(v)
    assert (exactdedup.golomb_decode(data, len(v), k) == v).all()


def test_exact_against_brute_force(spark):
    texts = [prose(RNG.randint(1, 3)) for _ in range(300)] + ["x", "x ", "X", "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    by = defaultdict(list)
    for i, t in enumerate(texts):
        by[t].append(i)
    want = {(i, min(g), len(g)) for g in by.values() if len(g) > 1 for i in g}
    for owners in (1, 7):
        assert {tuple(r) for r in exactdedup.exact_duplicates(docs, owners=owners).collect()} == want


# ---------------------------------------------------------------- near duplicates


@pytest.mark.parametrize("owners", [1, 7])
def test_the_exchange_finds_all_repeats(spark, owners, monkeypatch):
    rng = random.Random(owners)
    values = [rng.choice([rng.randrange(300), rng.randrange(1 << 63)]) for _ in range(3000)] + [0, (1 << 63) - 1, (1 << 63) - 1]
    got = exactdedup.duplicated_fingerprints(spark.createDataFrame([(v,) for v in values], "fp bigint").repartition(5), owners)
    assert sorted(r[0] for r in got.collect()) == sorted(v for v in set(values) if values.count(v) > 1)


@pytest.mark.parametrize("bucket", [neardup.BUCKET, 3])
def test_hamming_join_is_complete(spark, bucket):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 16, (20, 32), dtype=np.uint16)
    sigs = [s for b in base for s in (b, *[np.where(rng.random(32) < p, rng.integers(0, 1 << 16, 32), b).astype(np.uint16) for p in (0.1, 0.3, 0.45, 0.5, 0.6)])]
    table = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sigs)], "id bigint, sig binary")
    want = {(i, j, int(d)) for i, j in itertools.combinations(range(len(sigs)), 2) if (d := (sigs[i] != sigs[j]).sum()) <= neardup.R}
    assert {tuple(r) for r in neardup.hamming_pairs(table, bucket=bucket).collect()} == want
    groups = neardup.components(neardup.hamming_pairs(table, forest=True, bucket=bucket)).collect()
    parent = list(range(len(sigs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, _ in want:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert {(r["id"], r["root"]) for r in groups} == {(i, root(i)) for i in range(len(sigs)) if root(i) != i}


def test_near_copies_are_found_and_clean_documents_stay(spark):
    rng = random.Random(8)
    rows, expected, clean = [], set(), set()
    for g in range(60):
        w = prose(120, rng).split()
        rows.append((g * 10, " ".join(w)))
        if g % 2:
            for c in range(1, 4):
                v = list(w)
                for _ in range(5):
                    v[rng.randrange(len(v))] = rng.choice(WORDS)
                rows.append((g * 10 + c, " ".join(v)))
                expected.add((g * 10 + c, g * 10))
        else:
            clean.add(g * 10)
    got = {tuple(r) for r in neardup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(expected & got) >= 0.95 * len(expected)
    assert not clean & {i for i, _ in got} and got <= expected


def test_a_shared_passage_makes_no_near_copies(spark):
    rng = random.Random(5)
    own = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = own(55)
    rows = [(i, " ".join(passage + own(55))) for i in range(1000)]
    w = own(100)
    rows += [(5000, " ".join(w)), (5001, " ".join(w[:-5] + own(5)))]
    assert {tuple(r) for r in neardup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == {(5001, 5000)}


def test_a_copy_shares_its_id_with_another_text(spark):
    rng = random.Random(15)
    w, other = prose(100, rng), prose(100, rng)
    docs = spark.createDataFrame([(1, w), (2, w + " extra"), (2, other), (1, w)], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in neardup.keep_one(docs).collect()) == sorted([(1, w), (1, w), (2, other)])


def test_members_are_held_against_the_kept_document(spark):
    grams = {1: range(0, 100), 2: range(30, 130), 3: range(60, 160), 4: range(62, 162)}
    sets = spark.createDataFrame([(i, bytearray(np.array(g, np.uint32).tobytes())) for i, g in grams.items()], "id bigint, grams binary")
    roots = spark.createDataFrame([(2, 1), (3, 1), (4, 1)], "id bigint, root bigint")
    assert {tuple(r) for r in neardup.confirmed(roots, sets).collect()} == {(2, 1), (4, 3)}


# ---------------------------------------------------------------- decontamination


def brute_contamination(docs, items, n=decontam.N, theta=decontam.THETA):
    out = set()
    for i, t in items:
        w = common.words(t)
        g = min(n, len(w))
        if not g:
            continue
        s = {tuple(w[k : k + g]) for k in range(len(w) - g + 1)}
        for d, text in docs:
            v = common.words(text)
            grams = [tuple(v[k : k + g]) for k in range(len(v) - g + 1)]
            span = len(w) - g + 1
            best = max((len(s & set(grams[k : k + span])) for k in range(max(1, len(grams) - span + 1))), default=0)
            if best >= math.ceil(theta * len(s) - 1e-9):
                out.add((d, i, best, len(s)))
    return out


@pytest.mark.parametrize("broadcast", [1 << 26, 0])
def test_decontamination_against_brute_force(spark, broadcast):
    rng = random.Random(11)
    items = [(i, prose(rng.choice([1, 2, 3, 8, 20, 40]), rng)) for i in range(25)]
    docs = []
    for d in range(120):
        w = prose(rng.randint(1, 90), rng).split()
        if d % 2:
            p = rng.choice(items)[1].split()
            p = p[: max(1, int(len(p) * rng.choice([0.5, 0.65, 0.8, 1.0])))]
            at = rng.randrange(len(w) + 1)
            w[at:at] = p
        docs.append((d, " ".join(w)))
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), broadcast_bytes=broadcast)
    assert {(r["doc_id"], r["item_id"], r["matched"], r["size"]) for r in got.collect()} == brute_contamination(docs, items)


# ---------------------------------------------------------------- toxicity


def test_rows_that_share_an_id_are_told_apart(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, "one two three four five six seven"), (1, "four five six seven eight nine ten x"), (2, item), (2, "clean text")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, item), (7, "another item of some seven words here")], "item_id bigint, text string")
    assert {tuple(r) for r in decontam.contaminated(docs.filter("doc_id = 1"), bench, theta=0.8).collect()} == set()
    assert {tuple(r)[:4] for r in decontam.contaminated(docs, bench, theta=0.8).collect()} == {(2, 7, 8, 8)}
    assert {tuple(r) for r in decontam.decontaminate(docs, bench, theta=0.8).collect()} == {tuple(r) for r in docs.collect()} - {(2, item)}


def test_the_first_of_equally_good_windows(spark):
    item = "one two three four five"
    docs = spark.createDataFrame([(1, f"x {item} y y {item}")], "doc_id bigint, text string")
    assert [tuple(r) for r in decontam.contaminated(docs, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()] == [(1, 1, 3, 3, 1)]


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 1)), min_size=1, max_size=30))
@settings(max_examples=200, deadline=None)
def test_the_cut_is_the_best(rows):
    p, y = np.array([r[0] / 10 for r in rows]), np.array([r[1] for r in rows])
    value = lambda c: (p[y == 1] >= c).mean() - toxicity.COST * ((p[y == 0] >= c).mean() if (y == 0).any() else 0) if (y == 1).any() else -1
    best = max((value(c) for c in p if not (y == 0).any() or (p[y == 0] >= c).mean() <= toxicity.FALSE_REJECTS), default=-1)
    cut = toxicity.choose_cut(p, y)
    assert cut == toxicity.REJECT_AT if best <= 0 else abs(value(cut) - best) < 1e-9


def test_toxicity_on_held_out_rows_of_the_tables(spark):
    d = "/root/testdata/sf0.1"
    if not os.path.exists(d):
        pytest.skip("no tables here")
    docs, labels = (common.table(spark, d, t) for t in ("documents", "labels"))
    part = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(4))
    m = toxicity.train(docs, labels.filter(part > 0))
    got = toxicity.severity(docs, m).join(labels.filter(part == 0), "doc_id").groupBy("toxic").agg(F.avg(F.col("rejected").cast("int"))).collect()
    share = {r[0]: r[1] for r in got}
    assert share[1] >= 0.9 and share[0] <= 0.04


def test_toxicity_held_out(spark):
    rng = random.Random(2)
    bad = ["vile", "scum", "rotten", "filthy"]
    rows, labels = [], []
    for i in range(600):
        w = prose(rng.randint(20, 200), rng).split()
        t = i % 5 == 0
        if t:
            for _ in range(rng.randint(2, 6)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(t)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    m = toxicity.train(docs, spark.createDataFrame(labels[:400], "doc_id bigint, quality int, toxic int"))
    assert (np.diff(m.cuts) > 0).all()
    out = {r["doc_id"]: r for r in toxicity.severity(docs, m).collect()}
    right = [out[i]["rejected"] == bool(t) for i, _, t in labels[400:]]
    assert sum(right) >= 0.97 * len(right)
    p = m.probabilities(np.array([0.0, 3.0]))
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    assert 0 <= min(r["severity"] for r in out.values()) and max(r["severity"] for r in out.values()) <= 3


def test_ordinal_shares_weights_over_thresholds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=2000)
    y = np.digitize(2 * x + rng.logistic(size=2000), [1.0, 2.5, 4.0])
    w, cuts = toxicity.fit_ordinal([{0: v} for v in x], y, 1)
    assert abs(w[0] - 2) < 0.4 and np.allclose(cuts, [1.0, 2.5, 4.0], atol=0.6)


# ---------------------------------------------------------------- mixing


@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 4)), min_size=1, max_size=6, unique_by=lambda x: x[0]), st.integers(0, 80))
@settings(max_examples=100, deadline=None)
def test_fit_counts_reaches_the_best_sum(pairs, budget):
    lengths, counts = (np.array(x) for x in zip(*pairs))
    take = mixing.fit_counts(lengths, counts, budget)
    assert (take >= 0).all() and (take <= counts).all()
    sums = {0}
    for n, c in pairs:
        sums = {s + n * k for s in sums for k in range(c + 1)}
    assert int((lengths * take).sum()) == max(s for s in sums if s <= budget)


def test_mixture_meets_quotas(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng.randint(1, 40), rng), f"s{i % 3}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    weights = {"s0": 0.5, "s1": 0.3, "s2": 0.2}
    got = mixing.mixture(docs, weights, 6000).toPandas()
    assert got.groupby("source")["n_tokens"].sum().to_dict() == {"s0": 3000, "s1": 1800, "s2": 1200}
    again = mixing.mixture(docs.repartition(7), weights, 6000).toPandas()
    assert sorted(again["doc_id"]) == sorted(got["doc_id"]) and got["doc_id"].is_unique
    assert sorted(mixing.mixture(docs, weights, 6000, seed=99).toPandas()["doc_id"]) != sorted(got["doc_id"])


# ---------------------------------------------------------------- token blocks

TOKENS = tokenout.Tokenizer()


def test_lanes_round_trip():
    rng = np.random.default_rng(1)
    blocks = [np.zeros(0, np.uint16), rng.integers(0, 50_000, 4096).astype(np.uint16), np.repeat(np.uint16(7), 900), (rng.zipf(1.3, 3000) % 50_000).astype(np.uint16), np.arange(4096).astype(np.uint16), np.array([65_535], np.uint16)]
    payloads = tokenout.encode_lanes(blocks)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(tokenout.decode_lanes(payloads), blocks))
    assert len(payloads[2]) < 60 and all(len(tokenout.encode_lanes([b])[0]) == len(p) for b, p in zip(blocks, payloads))


@given(st.text(alphabet=" \n\tabAB.,;!'s19é漢🙂\u00a0-", max_size=60))
@settings(max_examples=300, deadline=None)
def test_tokenizer_agrees_with_the_library(text):
    assert TOKENS.encode(text).tolist() == TOKENS.encoding.encode_ordinary(text)


BLANKS = " \t\n\x0b\x0c\r\x85\u00a0\u1680\u2000\u2007\u200a\u2028\u2029\u202f\u205f\u3000"


@given(st.lists(st.lists(st.sampled_from([*BLANKS, "  ", "\n\n", "\x1c", "\x1f", "\u180e", "\u200b", "the", "'ll", "é", "7", "?", "<|none|>"]), max_size=12).map("".join) | st.none(), max_size=5))
@settings(max_examples=300, deadline=None)
def test_runs_of_blanks_split_as_by_the_library(texts):
    assert [x.tolist() for x in TOKENS.encode_all(texts)] == [TOKENS.encoding.encode_ordinary(t or "") for t in texts]


def test_tokenizer_is_cheaper_than_the_look_ahead():
    rng, took = random.Random(4), {TOKENS.encode: [], TOKENS.encoding.encode_ordinary: []}
    text = prose(30_000, rng)
    for _ in range(7):
        for f, each in took.items():
            began = time.thread_time()
            f(text)
            each.append(time.thread_time() - began)
    ours, library = map(min, took.values())
    assert ours < 0.9 * library


@given(st.lists(st.lists(st.integers(0, 9), min_size=1, max_size=300), min_size=1, max_size=5))
@settings(max_examples=60, deadline=None)
def test_order_0_below_against_counts(rows):
    x = np.zeros((len(rows), max(map(len, rows))), np.int16)
    for lane, r in enumerate(rows):
        x[lane, : len(r)] = r
    got = tokenout.below(x, np.full(len(rows), 10))
    for lane, r in enumerate(rows):
        assert got[lane, : len(r)].tolist() == [y + tokenout.INC * sum(z < y for z in r[:t]) for t, y in enumerate(r)]


def test_blocks_keep_their_bytes():
    rng = np.random.default_rng(3)
    blocks = [(rng.zipf(1.2, n) % 50_000).astype(np.uint16) for n in (4096, 4095, 700, 1)] + [np.tile(np.arange(9), 400).astype(np.uint16), np.zeros(0, np.uint16)]
    assert hashlib.sha256(b"".join(tokenout.encode_lanes(blocks))).hexdigest() == "2b0f0700f84a44b1027535caa7f3e0aed3573f3ac88aa51cac85a7dae3c10f82"


def test_token_blocks_round_trip_and_damage(spark):
    texts = [prose(RNG.randint(0, 400)) + RNG.choice(["", "\n\n ", "  é漢🙂 1,234.5 it's"]) for _ in range(60)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    blocks = tokenout.token_blocks(docs, block=512, lanes=16)
    pieces = defaultdict(list)
    for r in tokenout.read_blocks(blocks).collect():
        pieces[r["doc_id"]].append((r["start"], r["ids"]))
    enc = tokenout.Tokenizer().encoding
    for i, t in enumerate(texts):
        ids = [x for _, p in sorted(pieces[i], key=lambda y: y[0]) for x in p or []]
        assert ids == (enc.encode_ordinary(t) if t else [])
    one = blocks.toPandas()
    one["crc"] = one["crc"] ^ 1
    with pytest.raises(Exception, match="damaged"):
        tokenout.read_blocks(spark.createDataFrame(one, tokenout.SCHEMA)).collect()


# ---------------------------------------------------------------- pages


def brute_cover(pages, run):
    at = defaultdict(set)
    for i, p in enumerate(pages):
        for k in range(len(p) - run + 1):
            at[tuple(p[k : k + run])].add(i)
    return [[any(len(at[tuple(p[k : k + run])]) > 1 for k in range(max(0, j - run + 1), min(j, len(p) - run) + 1)) for j in range(len(p))] for p in pages]


@given(st.lists(st.lists(st.integers(0, 2), max_size=25), min_size=1, max_size=5), st.integers(2, 5))
@settings(max_examples=80, deadline=None)
def test_covered_tokens(pages, run):
    got = htmltext.covered([np.array(p, np.int64) for p in pages], run)
    assert [list(map(bool, g)) for g in got] == brute_cover(pages, run)


def test_large_hosts_agree_with_small(spark):
    rng = random.Random(6)
    foot = prose(30, rng)
    rows = [(i, f"https://h{i % 2}.example.org/{i}", f"<html><script>var x;</script><p>{prose(rng.randint(0, 60), rng)}</p><div>{foot}</div></html>") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    small = {tuple(r) for r in htmltext.extract(pages).collect()}
    assert {tuple(r) for r in htmltext.extract(pages, host_tokens=10).collect()} == small
    assert all(foot not in r[2] for r in small) and any(r[3] > 20 for r in small)


def test_short_boilerplate_goes(spark):
    rng = random.Random(8)
    rows = []
    for i in range(12):
        nav = "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in ("Home", "News", "About", "Contact"))
        body = "".join(f"<p>{prose(rng.randint(20, 60), rng)}</p>" for _ in range(3))
        rows.append((i, "https://short.example.org/", f"<html><body><ul>{nav}</ul>{body}<div>buy now at once</div><footer>Example Press all rights reserved</footer></body></html>"))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for tokens in (htmltext.HOST_TOKENS, 50):  # one block, and one for each page or so
        out = htmltext.extract(pages, host_tokens=tokens).collect()
        assert len(out) == 12
        for r in out:
            assert not {"Home", "News", "About", "Contact", "Press", "buy"} & set(r["text"].split())
            assert r["kept"] == len(r["text"].split()) == r["n_tokens"] - 13


# ---------------------------------------------------------------- personal data and secrets


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE89370400440532013001")


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("write to jo.do@mail.example.org now", ["email"]),
        ("my card 4111 1111 1111 1111 please", ["card"]),
        ("number 4111 1111 1111 1112 please", []),
        ("order 4111111111111111 shipped", []),
        ("IBAN DE89 3704 0044 0532 0130 00 at the bank", ["iban"]),
        ("call +1 (415) 555-2671 today", ["phone"]),
        ("server 10.20.30.40 is up", ["ipv4"]),
        ("version 1.2.3.4 is out", []),
        ("address 300.1.1.1 no", []),
        ("ssn 123-45-6789", ["ssn"]),
        ("", []),
        (None, []),
    ],
)
def test_personal_data(text, kinds):
    assert [s[0] for s in pii.find_spans(text)] == kinds


def brute_emails(text):
    """Every @ with the longest local part before it and the longest host after it, without regular expressions."""
    local, host = set(string.ascii_letters + string.digits + "!#$%&'*+/=?^_`{|}~.-"), set(string.ascii_letters + string.digits + "-")
    out = []
    for at in (i for i, c in enumerate(text) if c == "@"):
        a = at
        while a > max(0, at - 64) and text[a - 1] in local:
            a -= 1
        while a < at and text[a] in ".'`*":
            a += 1
        ends = []
        for b in range(at + 4, len(text) + 1):
            labels = text[at + 1 : b].split(".")
            if not set(text[at + 1 : b]) <= host | {"."}:
                break
            tld = labels[-1]
            if 2 <= len(labels) <= 9 and all(1 <= len(x) <= 63 for x in labels) and 2 <= len(tld) <= 24 and set(tld) <= set(string.ascii_letters) and (b == len(text) or text[b] not in host | {"@"}):
                ends.append(b)
        s = text[a : max(ends, default=0)]
        if a < at and ends and ".." not in s and text[a] != "." and text[at - 1] != "." and not any(x[0] == "-" or x[-1] == "-" for x in text[at + 1 : ends[-1]].split(".")):
            out.append((a, max(ends)))
    return out


@given(st.text(alphabet="ab1.@'`*-_ é", max_size=40))
@settings(max_examples=2000, deadline=None)
@example("'@example.com")
@example("`@example.com` and .@example.com")
@example("x@a.bc@d.ef")
def test_emails_against_brute_force(text):
    got = {(a, b) for k, a, b, _ in pii.find_spans(text) if k == "email"}
    want = brute_emails(text)
    assert got <= set(want)
    clear = [x for x in want if not any(y != x and y[0] < x[1] and x[0] < y[1] for y in want)]
    assert {x for x in clear} <= got


def brute_numbers(text):
    """Every substring that is a card or an address of four numbers, held apart from its surroundings, by trying all of them."""
    cards, ips = set(), set()
    for a in range(len(text)):
        for b in range(a + 7, min(len(text), a + 38) + 1):
            s, before, after = text[a:b], text[a - 1 : a], text[b : b + 1]
            if set(s) <= set("0123456789 -") and s[0].isdigit() and s[-1].isdigit() and not any(x in s for x in ("  ", "--", " -", "- ")):
                d = [int(c) for c in s if c.isdigit()]
                total = sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
                if 13 <= len(d) <= 19 and len(set(d)) > 1 and d[0] in (2, 3, 4, 5, 6) and total % 10 == 0:
                    cards.add((a, b))
            p = s.split(".")
            if len(p) == 4 and all(x.isdigit() and len(x) <= 3 and int(x) < 256 and (x == "0" or x[0] != "0") for x in p) and p[0] not in ("0", "127") and s != "255.255.255.255" and not (before.isalnum() or before in ("_", ".") and before) and not (after.isalnum() or after == "_"):
                if not (after == "." and text[b + 1 : b + 2].isdigit()):
                    ips.add((a, b))
    return cards, ips


@given(st.text(alphabet="0123459.- x", max_size=36), st.sampled_from(["", "4111 1111 1111 1111", "10.20.30.40", "5500-0000-0000-0004"]), st.text(alphabet="01 .-x", max_size=6))
@settings(max_examples=1500, deadline=None)
def test_numbers_against_brute_force(a, b, c):
    text = f"{a}{b}{c}"
    cards, ips = brute_numbers(text)
    for kind, x, y, _ in pii.find_spans(text):
        assert kind != "card" or (x, y) in cards
        assert kind != "ipv4" or (x, y) in ips


@given(st.text(alphabet="ab@.'`*09- +()DE٣\n\u00a0", max_size=80))
@settings(max_examples=10_000, deadline=None)
def test_spans_are_in_order_and_apart(text):
    at = 0
    for _, a, b, score in pii.find_spans(text):
        assert at <= a < b <= len(text) and pii.THRESHOLD <= score <= 1
        at = b


def test_personal_data_of_odd_rows(spark):
    long = prose(30_000) + " write to jo.do@mail.example.org"
    rows = [(None, "mail a.b@example.com"), (1, "mail a.b@example.com"), (1, "mail a.b@example.com"), (2, long), (3, None), (4, ""), (5, "`@example.com`")]
    got = sorted(((r["doc_id"], r["kind"], r["start"], r["end"], r["masked"]) for r in pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    one = ("email", 5, 20, "*" * 13 + "om")
    assert got == sorted([(None, *one), (1, *one), (1, *one), (2, "email", len(long) - 22, len(long), "*" * 20 + "rg")], key=str)


def test_redaction(spark):
    d = spark.createDataFrame([(1, "mail a.b@example.com or 10.20.30.40"), (2, None)], "doc_id bigint, text string")
    assert {r["doc_id"]: r["text"] for r in pii.redact(d).collect()} == {1: "mail <email> or <ipv4>", 2: None}


def test_ledger_is_incremental(spark, tmp_path):
    key = "AKIA" + "ABCDEFGH12345678"
    one = spark.createDataFrame([(1, f"x {key}", "a"), (2, f"x {key}", "b"), (3, "clean", "c")], "doc_id bigint, text string, source string")
    ledger = secretscan.Ledger(spark, str(tmp_path / "ledger"))
    assert {(r["doc_id"], r["path"], r["rule_id"]) for r in secretscan.scan_versions(one, ledger).collect()} == {(1, "a", "aws_access_key"), (2, "b", "aws_access_key")}
    n = ledger.scanned().count()
    assert n == 2 * len(secretscan.RULES)
    two = one.unionByName(spark.createDataFrame([(4, f"x {key}", "d"), (5, "password = hunter22x", "e")], one.schema))
    got = secretscan.scan_versions(two, ledger).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 4, 5}
    assert ledger.scanned().count() == n + len(secretscan.RULES)
    newer = tuple(secretscan.Rule(r.rule_id, 2, r.literal, r.pattern, r.fold, r.min_entropy) if r.rule_id == "jwt" else r for r in secretscan.RULES)
    assert {r["doc_id"] for r in secretscan.scan_versions(two, ledger, newer).collect()} == {1, 2, 4, 5}
    assert ledger.scanned().count() == n + len(secretscan.RULES) + 3
    assert {tuple(r) for r in secretscan.scan_versions(two).collect()} == {tuple(r) for r in got}


def test_secrets_query_against_brute_force(spark, tmp_path):
    from vexarium.llm import queries

    rng = random.Random(12)
    keys = ["AKIA" + "".join(rng.choice(string.ascii_uppercase) for _ in range(16)), "ghp_" + "a1B2" * 9, "xoxb-1234567890ab", "token = 'q8Zr71LmXcVb09Ty'", "password: hunter22x", "-----BEGIN RSA PRIVATE KEY-----", "secret=aaaaaaaaaaaaaaaaaaaa"]
    texts = [f"{prose(rng.randint(0, 30), rng)} {rng.choice(keys) if i % 3 else ''} {prose(rng.randint(0, 5), rng)}" for i in range(60)] + [None, "", prose(40_000, rng) + " " + keys[0]]
    rows = [(i, t, f"p{i % 4}") for i, t in enumerate(texts)] + [(1, texts[1], "p1"), (None, texts[2], None), (900, texts[1], "p9")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, t, p in rows:
        for r in secretscan.RULES if t else ():
            for m in re.finditer(r.pattern, t):
                s = m.group(1)
                bits = -sum(s.count(c) / len(s) * math.log2(s.count(c) / len(s)) for c in set(s))
                if bits >= r.min_entropy or r.min_entropy <= 0:
                    want.append((i, p, hashlib.sha256(t.encode()).hexdigest(), r.rule_id, 1, m.start(1), m.end(1), hashlib.sha256(s.encode()).hexdigest()[:16]))
    got = [tuple(r) for r in queries.op4_secrets(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len({r[3] for r in got}) == 6


# ---------------------------------------------------------------- language model


def test_log_bilinear_is_normalised_and_learns(spark):
    rng = random.Random(3)
    follow = {w: rng.sample(WORDS, 3) for w in WORDS}

    def chain(n):
        w = [rng.choice(WORDS)]
        while len(w) < n:
            w.append(rng.choice(follow[w[-1]]))
        return " ".join(w)

    rows = [(i, chain(200)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    start = lmscore.start(docs.select("text"))
    enc = lmscore.encode(docs, start)
    fitted = lmscore.train(enc, start, rounds=4)
    flow, _, _ = lmscore._flow([fitted.ids(chain(3))])
    every = np.arange(fitted.size)
    total = 0.0
    for w in every:
        f = np.concatenate([flow, [w]]).astype(np.int32)
        total += float(np.exp(fitted.log_probs(f, np.array([len(f) - 1]))[0]))
    assert abs(total - 1) < 1e-3
    held = [fitted.ids(chain(200)) for _ in range(20)]
    flow, at, _ = lmscore._flow(held)
    assert -fitted.log_probs(flow, at).mean() < -start.log_probs(flow, at).mean() - 0.3
    out = lmscore.score(enc, fitted).toPandas()
    assert len(out) == 400 and (out["n_tokens"] == 200).all() and (out["log_prob"] < 0).all()


def test_words_without_an_id_are_spelled(spark):
    rng = random.Random(4)
    rare = lambda: "".join(rng.choice(["ba", "ke", "lo", "mi"]) for _ in range(8))
    rows = [(i, " ".join(rng.choice(WORDS) if k % 2 else rare() for k in range(200))) for i in range(100)]
    rows += [(1000, " ".join(rare() for _ in range(50))), (1001, " ".join("".join(rng.choice("qxzvwj9") for _ in range(16)) for _ in range(50)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    m = lmscore.start(docs.select("text"))
    p = np.exp(m.spell.reshape(lmscore.CODES, lmscore.CODES, lmscore.CODES).astype(float))
    p[:, 0, 0] = 0
    assert np.allclose(p.sum(axis=2), 1, atol=1e-4)
    one, two = m.spelled([[b"bakelo"]])[0], m.spelled([[b"mi"]])[0]
    assert np.allclose(m.spelled([[], [b"bakelo", b"mi"], [b"mi"]]), [0, one + two, two])
    out = lmscore.lm_scores(docs).toPandas().set_index("doc_id")
    assert out["unknown"].sum() > 5000 and out["perplexity"][1001] > 100 * out["perplexity"][1000]
    assert out["perplexity"][1001] > out["perplexity"].drop([1000, 1001]).max()


def test_the_vocabulary_grows_with_the_words():
    assert [lmscore.side(n) for n in (10, 280_729, 899_189, 10**9)] == [64, 66, 97, 1000]


def zipf_model(k, n):
    """A model of k classes of k words with larger vectors, and a flow of n words by Zipf's law with all their positions."""
    size, rng = k * k, np.random.default_rng(k)
    m = lmscore.begin([(b"%d" % i, size // i) for i in range(1, size - 1)], size // 9, k)
    m.vec *= 5
    m.cvec *= 5
    flow, at, _ = lmscore._flow([rng.choice(size, n, p=m.unigram).astype(np.int32)])
    return m, flow, at


def test_normalisers_of_frequent_pairs():
    m, flow, at = zipf_model(70, 20_000)
    known = m.pair_sums()
    assert all(x.shape == (lmscore.HEAD, lmscore.HEAD) for x in known)
    vec, bias, cvec, cbias = (x.astype(float) for x in (m.vec, m.bias, m.cvec, m.cbias))
    q = vec[flow[at - 1]] * m.pos[0] + vec[flow[at - 2]] * m.pos[1]
    s, c = q @ cvec.T + cbias, flow[at] // 70
    want = s[np.arange(len(s)), c] - np.log(np.exp(s).sum(axis=1))
    within = np.einsum("ij,ikj->ik", q, vec.reshape(70, 70, -1)[c]) + bias.reshape(70, 70)[c]
    want += within[np.arange(len(s)), flow[at] % 70] - np.log(np.exp(within).sum(axis=1))
    head = (flow[at - 1] < lmscore.HEAD) & (flow[at - 2] < lmscore.HEAD)
    assert 0.1 < head.mean() < 0.9
    assert np.abs(m.log_probs(flow, at, known) - want).max() < 1e-3 and np.abs(m.log_probs(flow, at) - want).max() < 1e-3
    m.vec *= 1000  # products would leave the range of a float
    assert m.pair_sums() == (None, None)


def test_noise_of_many_classes_at_once():
    rng = np.random.default_rng(6)
    lens = np.array([1, 2, 3, 4, 5, 8, 9, 31, 64, 65, 200])
    starts = np.cumsum(lens) - lens
    draw = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
    q, r, b, grad = draw(lens.sum(), lmscore.DIM), draw(len(lens), lmscore.NOISE, lmscore.DIM), draw(len(lens), lmscore.NOISE), draw(lens.sum(), lmscore.DIM)
    want = grad.copy()
    got = lmscore._noise_within(q, starts, lens, r, b, grad)
    for i, (a, n) in enumerate(zip(starts, lens)):
        taken, back = lmscore._noise(q[a : a + n], r[i], b[i])
        want[a : a + n] -= back
        assert np.allclose(got[i], taken, atol=1e-4)
    assert np.allclose(grad, want, atol=1e-4)


def test_work_for_a_word_grows_less_than_the_vocabulary(monkeypatch):
    m, flow, at = zipf_model(313, 1 << 16)  # the vocabulary of about 30 million distinct words
    sizes, exp = [], np.exp
    monkeypatch.setattr(np, "exp", lambda x, *args, **named: sizes.append(np.size(x)) or exp(x, *args, **named))
    m.learn(flow, at, np.random.default_rng(1))
    assert len(sizes) < 50 * len(at) / lmscore.LEARN  # not one for each of the classes of a batch
    sizes.clear()
    m.log_probs(flow, at)
    assert max(sizes) <= 1 << 18  # what stays in a CPU's cache
    known = m.pair_sums()
    sizes.clear()
    m.log_probs(flow, at, known)
    assert sum(sizes) < 0.75 * len(at) * 2 * 313


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    rows, labels, item = [], [], prose(25, rng)
    for i in range(240):
        w = prose(rng.randint(30, 80), rng).split()
        if i % 6 == 0:
            w += ["vile", "scum", "rotten", "vile"]
        rows.append((i, " ".join(w), "en", f"src{i % 2}"))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(1000 + k, rows[k][1] + " extra", "en", "src0") for k in (1, 2, 3)] + [(2000, prose(20, rng) + " " + item, "en", "src1")]
    docs = spark.createDataFrame([(i, t, g, s, len(t)) for i, t, g, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, df in (("documents", docs), ("labels", spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")), ("benchmark", spark.createDataFrame([(1, item)], "item_id bigint, text string"))):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    d = str(tmp_path)
    at, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        at = common.materialise(stage(spark, at, d), f"test-{name}")
        if name != "token_blocks":
            assert at.columns == docs.columns
            kept[name] = {r["doc_id"] for r in at.select("doc_id").collect()}
    everything = {r[0] for r in rows}
    assert kept["toxicity"] == {i for i in everything if i >= 1000 or i % 6}
    assert kept["near_dedup"] == kept["toxicity"] - {1001, 1002, 1003}
    assert kept["decontamination"] == kept["near_dedup"] - {2000}
    lengths = {i: len(t.split()) for i, t, _, _ in rows}
    budget = sum(lengths[i] for i in kept["decontamination"]) // 2
    assert abs(sum(lengths[i] for i in kept["mixture"]) - budget) <= 1
    blocks = {r["doc_id"] for r in tokenout.read_blocks(at).collect()}
    assert blocks == kept["mixture"]
    assert {r["doc_id"] for r in tokenout.read_blocks(corpus_pipeline.run(spark, d)).collect()} == kept["mixture"]
