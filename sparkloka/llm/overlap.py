"""Records of evaluation splits that recur in training, exactly or nearly: bit fingerprints joined by code blocks.

A record's code has one bit for every possible word hash, set for its words; the Hamming distance of two codes is the
number of words that only one of them has. Two records of a and b words with a Jaccard similarity of t or more differ
in at most d = (a + b)(1 - t)/(1 + t) bits. Copies (equal word sets) are one class; classes are joined, not rows.

* Segmented code. The code is cut into m blocks, m by size class. At least m - d blocks of such a pair are equal, so it
  is enough that a training class is looked up under its d + 1 fullest blocks and an evaluation class under all m.
  A block's key that the other side doesn't have is dropped where it is made: each side asks a bitmap of the other's keys
  (a Bloom filter of one hash, MAX_BITS at most whatever the data's size; fuller bitmaps drop less and lose nothing).
* A 128-bit folding of the code (each word flips one bit) can't be further apart than the code itself; it drops most
  candidates within the join. The words decide.
* Permuted code. A block that very many classes share (a template's) isn't joined as it is: within it the bits are
  permuted so that the rarest words come first, and classes meet on (block, word) for the leading bits, of which two
  records of that similarity share at least one. Rarity is read from counts of word hashes in RARITY buckets. Keys that
  are still hot are salted.

No pair is missed by any of these. Defined results: null texts and texts without words match nothing; equal texts have
similarity 1; every pair of rows is reported once, repeated rows once; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloka.llm.lookalikes import fold
from sparkloka.runtime import bounded, release, stage

SIMILARITY = 0.8
#: Ratio of the bounds of a size class.
CLASS_RATIO = 1.5625
#: Pairs that one block may give before it counts as hot: what a task compares in a tenth of a second.
HOT_PAIRS = 1_000_000
#: Bits of a side's bitmap of keys: so many a word, at most MAX_BITS (16 MB).
BITS_A_WORD, MAX_BITS = 32, 1 << 27
#: Buckets in which the words of hot classes are counted.
RARITY = 1 << 18
#: Counted rows up to which keys, candidates and pairs are broadcast.
SMALL = 200_000

_LINK = regex.compile(r"(?i)\b(?:https?://|www\.)\S+")
_MENTION = regex.compile(r"(?<![\p{L}\p{N}])@[\p{L}\p{N}_.]+")
_UNSEEN = regex.compile("[​-‍⁠﻿\xad]")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")

_CODED = "key bigint, h1 bigint, n int, s1 bigint, s2 bigint"


def words(text: str) -> list[str]:
    """Distinct words of a text, sorted; links, mentions, case and look-alikes don't count."""
    bare = text if text.isascii() else fold(_UNSEEN.sub("", text))
    if "@" in bare or "/" in bare or "." in bare:
        bare = _MENTION.sub(" ", _LINK.sub(" ", bare))
    return sorted(set(_WORD.findall(bare.lower())))


def bounds(t: float = SIMILARITY, ratio: float = CLASS_RATIO, most: int = 1 << 30) -> list[tuple[int, int, int]]:
    """(smallest size, largest size, blocks) of the size classes."""
    out, low = [], 1
    while low <= most:
        high = max(low, math.ceil(low * ratio) - 1)
        # both sides count: the partner of a record of size s has at most s / t words
        out.append((low, high, math.floor((high + high / t) * (1 - t) / (1 + t) + 1e-9) + 1))
        low = high + 1
    return out


_BOUNDS = bounds()
_LOWS = np.array([x[0] for x in _BOUNDS])
_BLOCKS = np.array([x[2] for x in _BOUNDS])
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit number from every other."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class Hasher:
    """64-bit hashes of words, the frequent ones kept."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def flat(self, lists: list[list[str]]) -> np.ndarray:
        seen, out = self.seen, []
        if len(seen) > 300_000:
            seen.clear()
        for ws in lists:
            for w in ws:
                h = seen.get(w)
                if h is None:
                    h = seen[w] = xxhash.xxh3_64_intdigest(w)
                out.append(h)
        return np.array(out, np.uint64)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["row_id", "side", "h1", "h2", "words"]
    for batch in batches:
        made = [" ".join(words(t)) for t in batch.column(2).to_pylist()]
        digest = [xxhash.xxh3_128_digest(w) for w in made]
        h = np.frombuffer(b"".join(digest), ">i8").astype(np.int64).reshape(-1, 2)
        out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(made, pa.string())], names)
        yield out.filter(pa.array([w != "" for w in made], pa.bool_()))


def _keys(h: np.ndarray, n: np.ndarray, c: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """(record, key) of the blocks of records whose words' hashes lie one after another in ``h``, n of each, looked up
    in size class c: all blocks if ``whole``, else the fullest, one more than can differ."""
    m = _BLOCKS[c]
    rec = np.repeat(np.arange(len(n)), n)
    off = np.cumsum(m) - m
    at = off[rec] + (h % m[rec].astype(np.uint64)).astype(np.int64)
    total = int(m.sum())
    sums = np.zeros(total, np.uint64)
    np.add.at(sums, at, h)
    owner = np.repeat(np.arange(len(n)), m)
    i = np.arange(total) - off[owner]
    key = _mix(_mix(sums) + (c[owner] * 4_000_003 + i).astype(np.uint64) * _A)
    if not whole:
        order = np.lexsort((i, -np.bincount(at, minlength=total), owner))
        need = np.floor((n + n / SIMILARITY) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-9).astype(np.int64) + 1
        rank = np.arange(total) - off[owner]  # the order keeps the owners' places
        pick = order[rank < need[owner]]
        pick.sort()
        owner, key = owner[pick], key[pick]
    return owner, key


def _folded(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the 128-bit folding: each word flips one bit."""
    bit = _mix(h + _C) >> np.uint64(57)
    one = np.uint64(1) << (bit & np.uint64(63))
    zero = np.uint64(0)
    starts = np.cumsum(n) - n
    return tuple(np.bitwise_xor.reduceat(np.where((bit >> np.uint64(6)) == s, one, zero), starts) for s in (0, 1))


def _spread(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The records once for each size class that a partner may have: (record, hashes, n, class)."""
    lo = np.searchsorted(_LOWS, np.ceil(n * SIMILARITY - 1e-9), "right") - 1
    hi = np.searchsorted(_LOWS, np.floor(n / SIMILARITY + 1e-9), "right") - 1
    times = hi - lo + 1
    rec = np.repeat(np.arange(len(n)), times)
    c = lo[rec] + np.arange(len(rec)) - (np.cumsum(times) - times)[rec]
    starts = (np.cumsum(n) - n)[rec]
    size = n[rec]
    idx = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return rec, h[idx], size, c


def _coder(train: bool, bits: int, other: Broadcast | None, marks: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of (h1, words): those whose key the bitmap ``other`` has; or with ``marks`` the bitmap of all keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, shift, own = Hasher(), np.uint64(64 - bits), {}
        seen = np.zeros(1 << (bits - 6), np.uint64) if marks else None
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                lists = [w.split(" ") for w in part.column(1).to_pylist()]
                n = np.array([len(x) for x in lists], np.int64)
                h = hasher.flat(lists)
                if train:
                    rec, key = _keys(h, n, np.searchsorted(_LOWS, n, "right") - 1, False)
                else:
                    which, hs, size, c = _spread(h, n)
                    rec, key = _keys(hs, size, c, True)
                    rec = which[rec]
                at = key >> shift
                if marks:
                    np.bitwise_or.at(seen, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
                    continue
                hit = (other.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)) == 1
                rec, key = rec[hit], key[hit]
                s1, s2 = _folded(h, n)
                cols = [key.view(np.int64), part.column(0).to_numpy()[rec], n[rec].astype(np.int32), s1[rec].view(np.int64), s2[rec].view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["key", "h1", "n", "s1", "s2"])
        if marks:
            idx = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(idx.astype(np.int32)), pa.array(seen[idx].view(np.int64))], ["i", "bits"])

    return run


def _bitmap(parts: DataFrame, bits: int) -> Broadcast:
    """The bitmap whose 64-bit pieces (i, bits) the partitions give; at most MAX_BITS / 64 rows reach the driver."""
    out = np.zeros(1 << (bits - 6), np.uint64)
    got = parts.groupBy("i").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[got.column("i").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return parts.sparkSession.sparkContext.broadcast(out)


def _near() -> Column:
    """The sizes fit and the foldings' distance is within what they allow."""
    a, b = F.col("a.n"), F.col("b.n")
    radius = F.floor((a + b) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-9)
    bits = lambda s: F.bit_count(F.col(f"a.{s}").bitwiseXOR(F.col(f"b.{s}")))
    return (a * SIMILARITY <= b + 1e-9) & (b * SIMILARITY <= a + 1e-9) & (bits("s1") + bits("s2") <= radius)


def _load(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, x, y) of the keys that give more than HOT_PAIRS pairs."""
    x = left.groupBy("key").agg(F.count(F.lit(1)).alias("x"))
    y = right.groupBy("key").agg(F.count(F.lit(1)).alias("y"))
    return x.join(y, "key").filter(F.col("x").cast("double") * F.col("y") > HOT_PAIRS)


def _meet(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    fits = _near()
    for c in on:
        fits = (F.col(f"a.{c}") == F.col(f"b.{c}")) & fits
    return left.alias("a").join(right.alias("b"), fits).select(F.col("a.h1").alias("ha"), F.col("b.h1").alias("hb"))


def _leading(rare: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key and word, ...) for the leading bits of the permuted codes of (key, h1, n, s1, s2, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            rec, key = [], []
            for r, (k, ws) in enumerate(zip(batch.column(0).to_pylist(), batch.column(5).to_pylist())):
                h = hasher.flat([ws.split(" ")])
                lead = len(h) - math.ceil(SIMILARITY * len(h) - 1e-9) + 1
                first = h[np.lexsort((h, rare.value[(h % RARITY).astype(np.int64)]))[:lead]]
                key.append(_mix(first + np.uint64(k & 0xFFFFFFFFFFFFFFFF)).view(np.int64))
                rec += [r] * lead
            idx = pa.array(rec, pa.int64())
            flat = pa.array(np.concatenate(key) if key else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([flat, *[batch.column(i).take(idx) for i in range(1, 5)]], ["key", "h1", "n", "s1", "s2"])

    return run


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, n = Hasher(), np.zeros(RARITY, np.int64)
    for batch in batches:
        h = hasher.flat([w.split(" ") for w in batch.column(0).to_pylist()])
        n += np.bincount((h % RARITY).astype(np.int64), minlength=RARITY)
    i = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(n[i])], ["i", "n"])


def _permuted(left: DataFrame, right: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidates of hot blocks by the leading bits of the permuted codes; keys that are still hot are salted."""
    some = bounded(stage(left.select("h1").unionByName(right.select("h1")).distinct(), "overlap-hot"), SMALL)
    texts = stage(classes.select("h1", "words").join(some, "h1", "left_semi"), "overlap-hot-words")
    left, right = (stage(d.join(texts, "h1").select("key", "h1", "n", "s1", "s2", "words"), f"overlap-hot-{i}") for i, d in enumerate((left, right)))
    counted = left.select("words").unionByName(right.select("words")).mapInArrow(_count_words, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    rare = np.zeros(RARITY, np.int64)
    rare[counted.column("i").to_numpy()] = counted.column("n").to_numpy()
    kept = left.sparkSession.sparkContext.broadcast(rare)
    left, right = (stage(d.mapInArrow(_leading(kept), _CODED), f"overlap-lead-{i}") for i, d in enumerate((left, right)))
    salts = F.least(F.ceil(F.col("x") * F.col("y") / HOT_PAIRS), "x").cast("int")
    load = stage(_load(left, right).select("key", salts.alias("salts")), "overlap-salts")
    left = left.join(bounded(load, SMALL), "key", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("h1"), F.col("salts")).cast("int"), F.lit(0)))
    right = right.join(bounded(load, SMALL), "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    return _meet(left, right, ["key", "salt"])


class Overlaps:
    """The overlaps of ``train`` and ``evaluation`` (row_id, text).

    ``members``: (row_id, side, h1, h2), side 0 for training, 1 for evaluation; (h1, h2) names the class of the records
    with the same words. ``pairs``: (a1, a2, b1, b2, similarity) of training and evaluation classes."""

    def __init__(self, train: DataFrame, evaluation: DataFrame) -> None:
        side = lambda d, i: d.select(F.col("row_id").cast("bigint").alias("row_id"), F.lit(i).alias("side"), "text")
        rows = side(train, 0).unionByName(side(evaluation, 1)).filter("row_id IS NOT NULL AND text IS NOT NULL")
        records = stage(rows.mapInArrow(_records, "row_id bigint, side int, h1 bigint, h2 bigint, words string"), "overlap-records")
        self.members = stage(records.select("row_id", "side", "h1", "h2"), "overlap-members")
        self.classes = stage(records.groupBy("h1", "h2").agg(F.bool_or(F.col("side") == 0).alias("train"), F.bool_or(F.col("side") == 1).alias("held"), F.first("words").alias("words")), "overlap-classes")
        release(records)
        self.pairs = self._pairs()

    def _pairs(self) -> DataFrame:
        a, b = self.classes.filter("train").select("h1", "words"), self.classes.filter("held").select("h1", "words")
        n = b.agg(F.sum(F.length("words") - F.length(F.replace("words", F.lit(" "))) + 1)).first()[0] or 1
        bits = min(MAX_BITS.bit_length() - 1, max(16, (BITS_A_WORD * n).bit_length()))
        asked = _bitmap(b.mapInArrow(_coder(False, bits, None, True), "i int, bits bigint"), bits)
        left = stage(a.mapInArrow(_coder(True, bits, asked, False), _CODED), "overlap-a")
        known = _bitmap(left.select("key").mapInArrow(_marks(bits), "i int, bits bigint"), bits)
        right = stage(b.mapInArrow(_coder(False, bits, known, False), _CODED), "overlap-b")
        hot = stage(_load(left, right).select("key"), "overlap-load")
        if hot.limit(1).count():
            keys = bounded(hot, SMALL)
            cold = _meet(left.join(keys, "key", "left_anti"), right.join(keys, "key", "left_anti"), ["key"])
            met = cold.unionByName(_permuted(left.join(keys, "key", "left_semi"), right.join(keys, "key", "left_semi"), self.classes))
        else:
            met = _meet(left, right, ["key"])
        met = stage(met.distinct(), "overlap-met")
        release(left)
        release(right)
        # only the candidates' words are moved, not those of all classes
        some = bounded(met.select(F.col("ha").alias("h1")).unionByName(met.select(F.col("hb").alias("h1"))).distinct(), 2 * SMALL)
        texts = stage(self.classes.select("h1", "h2", "words").join(some, "h1", "left_semi"), "overlap-words")
        one = lambda x: texts.select(F.col("h1").alias(f"h{x}"), F.col("h2").alias(f"{x}2"), F.col("words").alias(f"w{x}"))
        both = met.join(one("a"), "ha").join(one("b"), "hb").withColumns({"wa": F.split("wa", " "), "wb": F.split("wb", " ")})
        common = F.size(F.array_intersect("wa", "wb"))
        both = both.select(F.col("ha").alias("a1"), "a2", F.col("hb").alias("b1"), "b2", (common / (F.size("wa") + F.size("wb") - common)).alias("similarity"))
        return stage(both.filter(F.col("similarity") >= SIMILARITY - 1e-9), "overlap-pairs")

    def _rows(self, side: int, name: str, x: str) -> DataFrame:
        """The rows of one side whose classes have pairs."""
        some = bounded(self.pairs.select(f"{x}1", f"{x}2").distinct(), SMALL)
        rows = self.members.filter(F.col("side") == side).select(F.col("row_id").alias(name), F.col("h1").alias(f"{x}1"), F.col("h2").alias(f"{x}2"))
        return rows.join(some, [f"{x}1", f"{x}2"], "left_semi").distinct()

    def train_rows(self) -> DataFrame:
        return self._rows(0, "train_id", "a")

    def held_rows(self) -> DataFrame:
        return self._rows(1, "eval_id", "b")


def _marks(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << (bits - 6), np.uint64)
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            np.bitwise_or.at(seen, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        idx = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(idx.astype(np.int32)), pa.array(seen[idx].view(np.int64))], ["i", "bits"])

    return run


def overlaps(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """(train_id, eval_id, similarity) of all pairs of rows with a Jaccard similarity of SIMILARITY or more."""
    o = Overlaps(train, evaluation)
    out = o.pairs.join(o.train_rows(), ["a1", "a2"]).join(o.held_rows(), ["b1", "b2"])
    return out.groupBy("train_id", "eval_id").agg(F.max("similarity").alias("similarity"))


def evaluation_rows(val: DataFrame, test: DataFrame, *extra: str) -> DataFrame:
    return val.select("row_id", "text", *extra).withColumn("split", F.lit("validation")).unionByName(test.select("row_id", "text", *extra).withColumn("split", F.lit("test")))


def found(train: DataFrame, val: DataFrame, test: DataFrame) -> DataFrame:
    """All pairs of rows, as the cases ask for; ``classes`` gives the same without expanding copies."""
    pairs = overlaps(train.select("row_id", "text"), evaluation_rows(val, test).select("row_id", "text"))
    return pairs.select(F.least("train_id", "eval_id").alias("row_id_a"), F.greatest("train_id", "eval_id").alias("row_id_b"))


def classes(train: DataFrame, val: DataFrame, test: DataFrame) -> DataFrame:
    """(row_id, side, class_id, n_links) of every record with words: its class is named by the smallest row id that has
    its words, its links are the records of the other side that are at least as similar as SIMILARITY."""
    o = Overlaps(train.select("row_id", "text"), evaluation_rows(val, test).select("row_id", "text"))
    sizes = o.members.distinct().groupBy("h1", "h2").agg(F.min("row_id").alias("class_id"), F.count_if(F.col("side") == 0).alias("n_train"), F.count_if(F.col("side") == 1).alias("n_held"))
    n = stage(sizes, "overlap-sizes")
    side = lambda x, y, c: o.pairs.join(n.select(F.col("h1").alias(f"{y}1"), F.col("h2").alias(f"{y}2"), F.col(c).alias("n")), [f"{y}1", f"{y}2"]).groupBy(F.col(f"{x}1").alias("h1"), F.col(f"{x}2").alias("h2")).agg(F.sum("n").alias("n_links"))
    links = side("a", "b", "n_held").withColumn("side", F.lit(0)).unionByName(side("b", "a", "n_train").withColumn("side", F.lit(1)))
    out = o.members.distinct().join(n.select("h1", "h2", "class_id"), ["h1", "h2"]).join(links, ["h1", "h2", "side"], "left")
    return out.select("row_id", F.when(F.col("side") == 0, "train").otherwise("evaluation").alias("side"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def claim(c: Column) -> Column:
    """The split that a record claims, in one spelling; '' for none."""
    p = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(p.isin("val", "valid", "dev"), "validation").when(p.isin("train", "training"), "train").otherwise(p)


def report(train: DataFrame, val: DataFrame, test: DataFrame) -> DataFrame:
    """Overlaps by split and source of the evaluation record and source and claimed split of the training record:
    evaluation records, those with the same words, and pairs. Pairs are counted by class and never expanded.

    The row without training source and claim (nulls) counts all records of its split and source and those that overlap
    with any. Null sources count as ''."""
    source = F.coalesce("source", F.lit("")).alias("source")
    held = evaluation_rows(val, test, "source").select("row_id", "text", "split", source)
    o = Overlaps(train.select("row_id", "text"), held.select("row_id", "text"))
    e = held.select(F.col("row_id").alias("eval_id"), "split", "source").distinct().join(o.held_rows(), "eval_id").groupBy("b1", "b2", "split", "source").agg(F.count(F.lit(1)).alias("e"))
    t = train.select(F.col("row_id").alias("train_id"), F.coalesce("source", F.lit("")).alias("train_source"), claim(F.col("provenance_split")).alias("train_claim")).distinct()
    t = t.join(o.train_rows(), "train_id").groupBy("a1", "a2", "train_source", "train_claim").agg(F.count(F.lit(1)).alias("t"))
    p = stage(o.pairs.join(e, ["b1", "b2"]).join(t, ["a1", "a2"]), "overlap-report")

    def by(*more: str) -> DataFrame:
        one = p.groupBy("b1", "b2", "split", "source", *more).agg(F.max("e").alias("e"), F.sum(F.col("e") * F.col("t")).alias("pairs"), F.max((F.col("similarity") >= 1.0).cast("int")).alias("same"))
        return one.groupBy("split", "source", *more).agg(F.sum("e").alias("n_overlapping"), F.sum(F.col("e") * F.col("same")).alias("n_same_words"), F.sum("pairs").alias("n_pairs"))

    every = held.groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_records"))
    none = F.lit(None).cast("string")
    total = every.join(by(), ["split", "source"], "left").na.fill(0, ["n_overlapping", "n_same_words", "n_pairs"]).withColumns({"train_source": none, "train_claim": none})
    return total.unionByName(by("train_source", "train_claim").join(every, ["split", "source"]))
