"""Product matching: names to dictionary groups by an inverted token index, versions to ranges, words to products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexarium.functions import cpe
from vexarium.functions.versions import in_range, is_version, parts


def dictionary_groups(pages: DataFrame) -> DataFrame:
    """(vendor, product_name, version, title) from dictionary entries (cpe, title): the first entry of each version."""
    x = pages.select(cpe.vendor("cpe").alias("vendor"), cpe.product("cpe").alias("product_name"), cpe.version("cpe").alias("version"), "title", "cpe").filter("vendor <> ''")
    return x.groupBy("vendor", "product_name", "version").agg(F.min_by("title", "cpe").alias("title"))


def common_title(dictionary: DataFrame) -> DataFrame:
    """(group_id, common_title, n_versions): the words that all titles of a group share at the same place, in any case."""
    words = F.split("title", " ")
    g = dictionary.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("version", words.alias("w")))).alias("xs"), F.count_distinct("version").alias("n_versions"))
    keep = lambda acc, x: F.filter(F.zip_with(acc, x["w"], lambda a, b: F.when(F.lower(a) == F.lower(b), a)), lambda w: w.isNotNull())
    return g.select("group_id", F.array_join(F.aggregate("xs", F.col("xs")[0]["w"], keep), " ").alias("common_title"), "n_versions")


def match_groups(names: DataFrame, groups: DataFrame) -> DataFrame:
    """(name, group_id, score): the groups with the highest token overlap with each name, ties included.

    names (name), groups (group_id, common_title). The score is the number of shared tokens over the longer token list. Tokens are
    joined by equality, so names and groups that share none never meet. Single generic words match nothing."""
    n = names.select("name").distinct().filter(~cpe.is_generic("name")).select("name", F.array_distinct(F.split(F.trim(cpe.normal_name("name")), " +")).alias("t"))
    g = groups.select("group_id", F.array_distinct(F.split(F.trim(cpe.normal_name("common_title")), " +")).alias("t"))
    a = n.select("name", F.size("t").alias("na"), F.explode("t").alias("tok"))
    b = g.select("group_id", F.size("t").alias("nb"), F.explode("t").alias("tok"))
    s = a.join(b, "tok").groupBy("name", "group_id", "na", "nb").agg(F.count("*").alias("m")).select("name", "group_id", F.round(F.col("m") / F.greatest("na", "nb"), 6).alias("score"))
    return s.withColumn("_r", F.rank().over(Window.partitionBy("name").orderBy(F.desc("score")))).filter("_r = 1").drop("_r")


def affected_versions(dictionary: DataFrame, ranges: DataFrame) -> DataFrame:
    """Dictionary rows whose version lies in a range of their group. ranges (group_id, kind, a, b); the join is on group_id."""
    d = dictionary.filter(is_version("version")).withColumn("_v", parts("version"))
    r = ranges.select(F.col("group_id").alias("_g"), "kind", parts("a").alias("_a"), parts("b").alias("_b"))
    return d.join(r, (d["group_id"] == r["_g"]) & in_range(d["_v"], r["kind"], r["_a"], r["_b"]), "left_semi").drop("_v")


def cpe_fallback(named: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(name, group_id, version, how): the version in the dictionary, else one whose title holds it, else the word itself, else *.

    named (name, group_id, version) with null versions allowed."""
    exact = dictionary.select("group_id", "version", F.lit(1).alias("_exact")).distinct()
    j = named.join(exact, ["group_id", "version"], "left")
    t = dictionary.select("group_id", F.col("version").alias("_tv"), "title")
    by_title = named.filter("version is not null").join(t, "group_id").filter(F.contains(F.col("title"), F.col("version"))).groupBy("group_id", "version").agg(F.min("_tv").alias("_title_version"))
    j = j.join(by_title, ["group_id", "version"], "left")
    how = F.when(F.col("_exact") == 1, "dictionary").when(F.col("_title_version").isNotNull(), "title").when(F.col("version").isNotNull(), "words").otherwise("any")
    return j.select("name", "group_id", F.when(how == "title", F.col("_title_version")).otherwise(F.coalesce("version", F.lit("*"))).alias("version"), how.alias("how"))


#: A word of class OTHER that holds a digit or one of these may be a version.
TRIGGERS = ("before", "earlier", "prior", "between", "after", "newer", "older", "through", ">", "=", "<", "version", "v.", "build")


def _title_words(titles: DataFrame) -> DataFrame:
    """(t, k): each title's words in lower case, and the places (from 1) where a word of it stands first."""
    t = titles.select(F.filter(F.split(F.lower("title"), r"[ \t\n\r]+"), lambda x: x != "").alias("t")).distinct()
    return t.select("t", F.explode(F.sequence(F.lit(1), F.size("t"))).alias("k")).filter("size(t) > 0 AND k > 0 AND array_position(t, t[k - 1]) = k")


def title_matches(words: DataFrame, titles: DataFrame) -> DataFrame:
    """(word, title): the titles that hold each word, both in lower case, by equality of words."""
    w = words.select(F.lower("word").alias("word")).distinct()
    return w.join(_title_words(titles).select(F.expr("t[k - 1]").alias("word"), F.array_join("t", " ").alias("title")), "word")


#: Pairs of the dictionary's words that are sent to every worker, at 8 bytes each; more are joined by shuffle.
PAIRS = 8_000_000
_KINDS = ("NAME", "VERSION", "OTHER")
_NAME, _VERSION, _OTHER = range(3)
_BITS = ("again", "fresh", "link", "other_likelier", "unsure", "unlikely", "trigger", "link_word", "long", "next_fits", "before_fits", "alone")


def _mix(a: np.ndarray, b: np.ndarray | int, salt: int) -> np.ndarray:
    """64 bits for each pair of 64-bit hashes."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(b).astype(np.uint64) + np.uint64(salt)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def _among(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def _rules(doc: np.ndarray, pos: np.ndarray, kind: np.ndarray, bits: np.ndarray, h: np.ndarray, known: np.ndarray | None, near: int) -> np.ndarray:
    """Corrected kinds of whole documents, one after another in the order of positions; the windows of word_rules as array operations."""
    n = len(doc)
    at = np.arange(n)
    first = np.ones(n, bool)
    first[1:] = doc[1:] != doc[:-1]
    last = np.append(first[1:], True)
    start = np.maximum.accumulate(np.where(first, at, 0))
    bit = {name: bits >> i & 1 == 1 for i, name in enumerate(_BITS)}

    def prev(x: np.ndarray, none: int | bool) -> np.ndarray:
        return np.where(first, none, np.roll(x, 1))

    def following(x: np.ndarray, none: int | bool) -> np.ndarray:
        return np.where(last, none, np.roll(x, -1))

    asks = bit["again"] | bit["fresh"]
    if known is None:
        mn, mp, m1 = (bit[x] for x in ("next_fits", "before_fits", "alone"))
    else:
        mn, mp, m1 = (np.zeros(n, bool) for _ in range(3))
        for out, who, salt in ((mn, asks & ~last, 1), (mp, asks & ~first, 2), (m1, asks, 3)):
            i = np.flatnonzero(who)
            out[i] = _among(known, _mix(h[i - 1], h[i], 2) if salt == 2 else _mix(h[i], h[i + 1], 1) if salt == 1 else _mix(h[i], 0, 3))
    c = mn & asks
    turn = at - np.maximum.accumulate(np.where(~c, at, np.where(first, at - 1, -1)))
    got = prev(c & (turn % 2 == 1), False)
    found = mn | mp | m1
    looks = asks & ~got
    doubt = np.where(found, _NAME, np.where(bit["other_likelier"], _OTHER, _VERSION))
    k = np.where(got, np.where(bit["link"], _OTHER, _NAME), np.where(bit["again"], doubt, np.where(bit["link"], _OTHER, np.where(bit["fresh"] & found, _NAME, kind))))
    k = np.where(following(looks & mp, False), _NAME, k)
    k = np.where((k != _NAME) & bit["long"] & (prev(k, -1) == _NAME) & (following(k, -1) == _NAME), _NAME, k)
    k = np.where((k == _VERSION) & np.where(kind == _VERSION, bit["unsure"], bit["unlikely"]), _OTHER, k)
    cand = (k == _OTHER) & bit["trigger"]
    plain = (k == _OTHER) & ~cand
    seen = prev(np.maximum.accumulate(np.where(~plain, at, -1)), -1)
    close = (seen >= start) & (k[seen] == _NAME) & (pos - pos[seen] <= near)
    seed = (k == _VERSION) | (cand & close)
    held = prev(np.maximum.accumulate(np.where(seed, at, -1)), -1) >= np.maximum.accumulate(np.where(plain | first, at, 0))
    k = np.where(seed | (cand & held), _VERSION, k)
    linked = (k != _VERSION) & bit["link_word"] & (prev(k, -1) == _VERSION) & (following(k, -1) == _VERSION)
    return np.where(linked, _VERSION, k).astype(np.int8)


def _title_pairs(titles: DataFrame) -> DataFrame:
    """(what, a, b): hashes of the titles' words and followers (1), predecessors and words (2), and of titles of one word (3)."""
    s = _title_words(titles)
    h = lambda at: F.xxhash64(F.get("t", F.col("k") + at))
    rows = F.array(
        F.when(F.col("k") < F.size("t"), F.struct(F.lit(1).alias("what"), h(-1).alias("a"), h(0).alias("b"))),
        F.when(F.col("k") > 1, F.struct(F.lit(2).alias("what"), h(-2).alias("a"), h(-1).alias("b"))),
        F.when(F.size("t") == 1, F.struct(F.lit(3).alias("what"), h(-1).alias("a"), F.lit(0).cast("bigint").alias("b"))),
    )
    return s.select(F.explode(rows).alias("x")).filter("x is not null").select("x.*").distinct()


def _blocks(batches: Iterator[pa.RecordBatch], least: int = 50_000) -> Iterator[pa.Table]:
    """Whole documents of adjacent rows, `least` rows or more at once but for the last."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < least:
            continue
        d = b.column("_doc").to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(d[1:] != d[:-1])
        if len(cut):
            yield pa.Table.from_batches([*held[:-1], b.slice(0, cut[-1] + 1)])
            held = [b.slice(cut[-1] + 1)]
            rows = held[0].num_rows
    if held:
        yield pa.Table.from_batches(held)


def word_rules(words: DataFrame, titles: DataFrame | None = None, near: int = 30, reach: int = 41, in_order: bool = False, keep: tuple[str, ...] | None = None, pairs: int = PAIRS) -> DataFrame:
    """Corrected classes of classified words (doc_id, pos from 1, word, kind, confidence, p_version, p_other, nnp): kind is NAME, VERSION or OTHER.

    Names. A name below 0.9, and an OTHER proper noun (nnp) among the first `reach` words, is looked up in the dictionary's `titles`: it fits
    a title of one word, or one where its neighbour in the text is its neighbour in the title too; that neighbour becomes a name as well and
    isn't looked up itself. A doubtful name that fits none gets the likelier of the other two classes. Links become OTHER. A word between two names becomes one.

    Versions. One below 0.8 becomes OTHER. An OTHER word with a digit or a trigger becomes a version up to `near` words after a name, if no
    version lies between, or after a version with nothing but names and such words between. A word with and/or between two versions becomes one.

    All of it is a fixed number of windows over a document's words. The loops that it stands for take turns in three ways: of a chain of words that each
    would make the next a name every second does (the others weren't looked up), only the first version or candidate after a name can be near to
    it, and a version reaches on as long as no plain word comes. tests/test_operators.py holds it against the loops. Without the last three columns no word is
    a proper noun, and a doubtful name becomes OTHER.

    The windows run as array operations over blocks of whole documents. Words that come `in_order`, as an explode of texts gives them (a
    document's words adjacent and by position), aren't shuffled; others are, once. Titles are compared by 64-bit hashes of their words: up to `pairs` pairs
    are sent to every worker, more are joined by shuffle. `keep` names the columns that are returned, all by default."""
    keep = tuple(words.columns) if keep is None else keep
    col = lambda c, v: F.col(c) if c in words.columns else F.lit(v)
    k, low = F.col("kind"), F.lower("word")
    link = low.contains("http")
    p_version, p_other = col("p_version", 0.0), col("p_other", 0.0)
    told = {
        "again": (k == "NAME") & (F.col("confidence") < 0.9), "fresh": (k == "OTHER") & col("nnp", False) & ~low.isin("the", "a", "http") & ~link & (F.col("pos") <= reach), "link": link, "other_likelier": p_other >= p_version,
        "unsure": F.col("confidence") < 0.8, "unlikely": p_version < 0.8, "trigger": low.rlike("[0-9]|" + "|".join(t.replace(".", r"\.") for t in TRIGGERS)), "link_word": low.contains("and") | low.contains("or"), "long": F.length("word") > 1,
    }
    flags = sum((F.coalesce(x.cast("int"), F.lit(0)) * (1 << _BITS.index(n)) for n, x in told.items()), F.lit(0))
    rest = [F.col(c) for c in keep if c != "kind"]
    number = F.when(k == "NAME", _NAME).when(k == "VERSION", _VERSION).otherwise(_OTHER).cast("tinyint")
    x = words.select(*rest, F.xxhash64("doc_id").alias("_doc"), F.col("pos").cast("bigint").alias("_pos"), number.alias("_kind"), flags.alias("_bits"), F.xxhash64(low).alias("_h"))
    known = None
    if titles is not None:
        wanted = _title_pairs(titles).persist()
        if wanted.count() <= pairs:
            t = wanted.toArrow()
            what, a, b = (t.column(c).to_numpy() for c in ("what", "a", "b"))
            known = words.sparkSession.sparkContext.broadcast(np.unique(np.concatenate([_mix(a[what == i], b[what == i], i) for i in (1, 2, 3)])))
        else:
            w = Window.partitionBy("_doc").orderBy("_pos")
            x = x.withColumns({"_nxt": F.lead("_h").over(w), "_prv": F.lag("_h").over(w)})
            for i, (left, right, name) in enumerate((("_h", "_nxt", "next_fits"), ("_prv", "_h", "before_fits"), ("_h", None, "alone")), 1):
                one = wanted.filter(F.col("what") == i).select(F.col("a").alias(left), *([F.col("b").alias(right)] if right else []), F.lit(1 << _BITS.index(name)).alias("_hit"))
                x = x.join(one, [left, *([right] if right else [])], "left").withColumn("_bits", F.col("_bits") + F.coalesce("_hit", F.lit(0))).drop("_hit")
            x = x.drop("_nxt", "_prv")
            in_order = False
        if known is not None:
            wanted.unpersist()
    if not in_order:
        x = x.repartition("_doc").sortWithinPartitions("_doc", "_pos")
    kept = [c for c in keep if c != "kind"]

    def correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs_ = None if known is None else known.value
        for t in _blocks(batches):
            new = _rules(*(t.column(c).to_numpy() for c in ("_doc", "_pos", "_kind", "_bits", "_h")), pairs_, near)
            out = t.select(kept).append_column("_kind", pa.array(new, pa.int8()))
            yield from out.to_batches(max_chunksize=50_000)

    fields = T.StructType([*(T.StructField(c, x.schema[c].dataType) for c in kept), T.StructField("_kind", T.ByteType())])
    name = F.get(F.array(*map(F.lit, _KINDS)), F.col("_kind").cast("int"))
    return x.mapInArrow(correct, fields).select(*[name.alias("kind") if c == "kind" else c for c in keep])


def product_islands(words: DataFrame) -> DataFrame:
    """(doc_id, island, name, versions): runs of name words and the version words up to the next run."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    opens = (F.col("kind") == "NAME") & (F.coalesce(F.lag("kind").over(w), F.lit("")) != "NAME")
    x = words.withColumn("_o", opens.cast("int")).withColumn("island", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("island > 0")
    pick = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", "word")))), lambda s: s["word"])
    return x.groupBy("doc_id", "island").agg(F.array_join(pick("NAME"), " ").alias("name"), F.array_join(pick("VERSION"), ";").alias("versions"))


def dictionary_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: how many groups a dictionary refresh inserts and updates. Both sides (group_id, common_title, n_versions)."""
    j = old.select("group_id", F.lit(1).alias("_o")).join(new.select("group_id", F.lit(1).alias("_n")), "group_id", "full_outer")
    return j.agg(F.count_if(F.col("_o").isNull()).alias("inserted"), F.count_if(F.col("_o").isNotNull() & F.col("_n").isNotNull()).alias("updated"))
