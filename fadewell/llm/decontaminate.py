"""Benchmark decontamination by SimHash of item-sized windows.

Items are classed by their length in words. For each class a window of that length slides over every
document; its SimHash over 5-word shingles comes from running sums of the shingles' bits. Multi-index
tables over four 16-bit blocks hold for every block value its flips to the nearest item's block; the sum over
the blocks is never more than the distance to an item, so a window within `radius` of one is always found. Candidates are then compared exactly:
weighted Jaccard similarity of the shingle multisets at the best place near the window.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WORD_HASHES, bounded_batches, gram_hashes, keep_words, lower_words_of, scratch
from .simhash import majority

SHINGLE = 5
RADIUS = 15
SIMILARITY = 0.8
ITEMS_PER_SHARD = 20_000  # items a task holds at once; more are searched shard after shard
_STREAM = 32_768  # words handled at once
_ROUNDING = 1e-9  # sliding sums may be off by far less; the best place is then summed afresh


def _hashes(text: str | None) -> np.ndarray:
    return WORD_HASHES.of(lower_words_of(text))


@dataclass
class _Class:
    words: int
    gram: int  # words of a shingle: five, or all words of a shorter item
    items: list[int]
    prints: np.ndarray
    blocks: list[np.ndarray] = field(default_factory=list)  # for each block, the flips from each value to an item's

    @property
    def shingles(self) -> int:
        return max(1, self.words - self.gram + 1)

    @property
    def step(self) -> int:
        return max(1, self.words // 16)


def _distances(values: np.ndarray) -> np.ndarray:
    """For each 16-bit value the least number of flips to one of `values`."""
    every = np.arange(65_536)
    least = np.full(65_536, 17, np.uint8)
    least[values.astype(np.int64)] = 0
    for bit in range(16):
        least = np.minimum(least, least[every ^ (1 << bit)] + 1).astype(np.uint8)
    return least


def item_grams(text: str | None) -> np.ndarray:
    """Shingle hashes of an item, repeats included; none without words."""
    return gram_hashes(_hashes(text), SHINGLE)


class Index:
    """Fingerprints and shingles of benchmark items.

    `seen` gives for each shingle the number of items of the whole benchmark that hold it, `total` the number of
    items with words; by default `items` is the whole benchmark.
    """

    def __init__(self, items: list[tuple[int, str]], radius: int = RADIUS, similarity: float = SIMILARITY, seen: dict[int, int] | None = None, total: int | None = None):
        self.radius, self.similarity = radius, similarity
        self.ids, self.grams, self.n_words = [], [], []
        for item_id, text in items:
            words = _hashes(text)
            if len(words):
                self.ids.append(item_id), self.grams.append(gram_hashes(words, SHINGLE)), self.n_words.append(len(words))
        self.bags = [Counter(g.tolist()) for g in self.grams]
        self.sets = [np.unique(g) for g in self.grams]
        if seen is None:
            seen, total = Counter(g for b in self.bags for g in b), len(self.ids)
        self.weight = {g: math.log1p(total / k) for g, k in seen.items()}
        self.unseen = math.log1p(total)
        self.known = np.array(sorted(self.weight), np.uint64)
        self.known_weight = np.array([self.weight[g] for g in self.known.tolist()])
        self.mass = [sum(n * self.weight[g] for g, n in b.items()) for b in self.bags]
        self.classes: list[_Class] = []
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(self.n_words):
            by_length.setdefault(_class_of(w), []).append(i)
        for words, members in sorted(by_length.items()):
            prints = np.array([majority(self.grams[i]) for i in members], np.uint64)
            c = _Class(words, min(SHINGLE, words), members, prints)
            c.blocks = [_distances(block) for block in prints.view("<u2").reshape(-1, 4).T]
            self.classes.append(c)

    def weights_of(self, grams: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        return np.where(self.known[at] == grams, self.known_weight[at], self.unseen)

    def alike(self, grams: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of a window's shingles and an item's, repeats counted."""
        bag, mine, both, either = Counter(grams.tolist()), self.bags[item], 0.0, 0.0
        for g in bag.keys() | mine.keys():
            w = self.weight.get(g, self.unseen)
            both += w * min(bag[g], mine[g])
            either += w * max(bag[g], mine[g])
        return both / either

    def verify(self, grams: np.ndarray, low: int, high: int, item: int) -> tuple[float, int]:
        """Best (similarity, start) among item-sized windows that begin from low to high; (0, low) if none is alike enough.

        The weight of the window's shingles that the item has at all bounds the shared weight, so starts whose
        bound is too low are left out; over the rest the window slides, one shingle in and one out.
        """
        n, known = len(self.grams[item]), self.sets[item]
        part = grams[low : high + n]
        hit = known[np.minimum(np.searchsorted(known, part), len(known) - 1)] == part
        if not hit.any():
            return 0.0, low
        weights = self.weights_of(part)
        masses, bounds = (np.concatenate([[0.0], np.cumsum(w)]) for w in (weights, weights * hit))
        starts = np.arange(high - low + 1)
        ends = np.minimum(starts + n, len(part))
        mass, most = masses[ends] - masses[starts], np.minimum(bounds[ends] - bounds[starts], self.mass[item])
        starts = starts[most >= (self.similarity - _ROUNDING) * (self.mass[item] + mass - most)]
        if not len(starts):
            return 0.0, low
        mine, bag, both = self.bags[item], Counter(), 0.0
        left = right = int(starts[0])
        values, shared, hits = part.tolist(), weights.tolist(), hit.tolist()
        best, place = 0.0, low
        for s, end, whole in zip(starts.tolist(), np.minimum(starts + n, len(part)).tolist(), mass[starts].tolist()):
            for j in range(right, end):
                if hits[j]:
                    g = values[j]
                    bag[g] += 1
                    if bag[g] <= mine[g]:
                        both += shared[j]
            right = max(right, end)
            for j in range(left, s):
                if hits[j]:
                    g = values[j]
                    if bag[g] <= mine[g]:
                        both -= shared[j]
                    bag[g] -= 1
            left = s
            value = both / (self.mass[item] + whole - both)
            if value > best + _ROUNDING:
                best, place = value, s + low
                if best > 1 - _ROUNDING:
                    break
        best = self.alike(grams[place : place + n], item)
        return (best, place) if best >= self.similarity else (0.0, low)

    def matches(self, texts: list[str | None]) -> list[list[tuple[int, int, float]]]:
        """For each text (item_id, first word, similarity) of each item found, at its best place."""
        found: list[dict[int, tuple[float, int]]] = [{} for _ in texts]
        if not self.ids:
            return [[] for _ in texts]
        held: list[tuple[int, np.ndarray]] = []
        words = 0
        for t, text in enumerate(texts):
            hashes = _hashes(text)
            if len(hashes):
                held.append((t, hashes))
                words += len(hashes)
            if words >= _STREAM:
                self._scan(held, found)
                held, words = [], 0
        if held:
            self._scan(held, found)
        return [[(self.ids[i], s, v) for i, (v, s) in sorted(f.items())] for f in found]

    def _scan(self, held: list[tuple[int, np.ndarray]], found: list[dict[int, tuple[float, int]]]) -> None:
        for k in sorted({c.gram for c in self.classes}):
            docs = [(t, gram_hashes(w, k)) for t, w in held]
            sizes = np.array([len(g) for _, g in docs])
            firsts = np.cumsum(sizes) - sizes
            stream = np.concatenate([g for _, g in docs])
            classes = [c for c in self.classes if c.gram == k]
            ranges: dict[tuple[int, int], list[tuple[int, int]]] = {}
            if k < SHINGLE:  # the item is one shingle, whose bits are the fingerprint
                for c in classes:
                    self._candidates(c, stream, np.arange(len(stream)), firsts, sizes, ranges)
            else:
                short = [c for c in classes if c.shingles <= _STREAM // 2]
                self._short(short, stream, firsts, sizes, ranges)
                self._long([c for c in classes if c.shingles > _STREAM // 2], stream, firsts, sizes, ranges)
            for (d, item), near in ranges.items():
                t, grams = docs[d]
                best = (0.0, 0)
                for low, high in _merged(near):
                    value = self.verify(grams, low, high, item)
                    if value[0] > best[0]:
                        best = value
                if best[0] >= self.similarity:
                    found[t][item] = best

    def _short(self, classes, stream, firsts, sizes, ranges) -> None:
        """Windows from running bit sums of one part of the stream at a time."""
        if not classes:
            return
        longest = max(c.shingles for c in classes)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        for low in range(0, len(stream), _STREAM):
            part = stream[low : low + _STREAM + longest]
            sums = _running(part)
            small = sums.astype(np.uint8)  # a window of under 256 shingles: differences modulo 256 are whole
            n = len(part)
            own = owner[low : low + n]
            # and one window at each document's end; a shorter document is a window itself
            ends = firsts + sizes - low
            ends = ends[(ends > 0) & (ends <= n)]
            begins = np.maximum(firsts - low, 0)[own[ends - 1]]
            for c in classes:
                m, step = c.shingles, c.step
                starts = np.arange(0, min(n - m + 1, _STREAM), step)
                if len(starts):
                    beyond = int(starts[-1]) + 1
                    whole = own[:beyond:step] == own[m - 1 : m - 1 + beyond : step]
                    self._candidates(c, _regular_prints(small if m < 256 else sums, m, step, len(starts)), starts + low, firsts, sizes, ranges, whole)
                tails = np.maximum(ends - m, begins)
                self._candidates(c, _prints(sums[ends] - sums[tails], ends - tails), tails + low, firsts, sizes, ranges)

    def _long(self, classes, stream, firsts, sizes, ranges) -> None:
        """Windows of any length: running sums are kept at the windows' ends only."""
        if not classes:
            return
        windows = []
        for c in classes:
            starts = [np.append(np.arange(f, f + n - c.shingles + 1, c.step), f + max(0, n - c.shingles)) for f, n in zip(firsts.tolist(), sizes.tolist())]
            ends = [np.minimum(s + c.shingles, f + n) for s, f, n in zip(starts, firsts.tolist(), sizes.tolist())]
            windows.append((c, np.concatenate(starts), np.concatenate(ends)))
        places = np.unique(np.concatenate([x for _, s, e in windows for x in (s, e)]))
        sums = _sums_at(stream, places)
        for c, starts, ends in windows:
            counts = sums[np.searchsorted(places, ends)] - sums[np.searchsorted(places, starts)]
            self._candidates(c, _prints(counts, ends - starts), starts, firsts, sizes, ranges)

    def _candidates(self, c: _Class, prints, starts, firsts, sizes, ranges, whole=True) -> None:
        """Adds for each (document, item) within the radius the starts, in the document, that are to be verified."""
        flips = np.zeros(len(prints), np.uint8)
        for least, block in zip(c.blocks, prints.view("<u2").reshape(-1, 4).T):
            flips += np.take(least, block)
        near = np.flatnonzero((flips <= self.radius) & whole)
        prints, starts = prints[near], starts[near]
        owner = np.searchsorted(firsts, starts, "right") - 1
        for at in range(0, len(prints), 1024):
            w, k = np.nonzero(np.bitwise_count(prints[at : at + 1024, None] ^ c.prints[None, :]) <= self.radius)
            for w, k in zip((w + at).tolist(), k.tolist()):
                d, item = int(owner[w]), c.items[k]
                n = len(self.grams[item])
                place, slack = int(starts[w] - firsts[d]), c.step + abs(n - c.shingles)
                low = max(0, place - slack)
                ranges.setdefault((d, item), []).append((low, max(low, min(place + slack, int(sizes[d]) - n))))


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges, ends included, that neither overlap nor touch."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _running(part: np.ndarray) -> np.ndarray:
    """Sums of each of the 64 bits before every place of at most 65,535 shingles."""
    bits = np.zeros((len(part) + 1, 64), np.uint16)
    bits[1:] = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    # four 16-bit counters are added as one number; a part is short enough that none overflows
    return np.cumsum(bits.view(np.uint64), axis=0).view(np.uint16)


def _sums_at(stream: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Bit sums before each of the sorted places, carried from part to part."""
    out, carried = np.zeros((len(places), 64), np.int64), np.zeros(64, np.int64)
    for low in range(0, len(stream), _STREAM):
        sums = _running(stream[low : low + _STREAM])
        first, last = np.searchsorted(places, [low, low + _STREAM])
        if low + _STREAM >= len(stream):
            last = len(places)
        out[first:last] = carried + sums[places[first:last] - low]
        carried = carried + sums[-1]
    return out


def _prints(counts: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Fingerprints from the counts of set bits among `of` shingles each."""
    return np.packbits(counts > (of // 2)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _regular_prints(sums: np.ndarray, m: int, step: int, windows: int, at_once: int = 2048) -> np.ndarray:
    """Fingerprints of windows of m shingles that begin every `step`, a part that fits a cache at a time."""
    out = np.empty(windows, np.uint64)
    counts, over = np.empty((at_once, 64), sums.dtype), np.empty((at_once, 64), bool)
    half = sums.dtype.type(m // 2)
    for at in range(0, windows, at_once):
        k = min(at_once, windows - at)
        first, last = at * step, (at + k - 1) * step + 1
        np.subtract(sums[first + m : last + m : step], sums[first:last:step], out=counts[:k])
        np.greater(counts[:k], half, out=over[:k])
        out[at : at + k] = np.packbits(over[:k].reshape(-1), bitorder="little").view("<u8")
    return out


def _class_of(words: int) -> int:
    """Lengths on a grid whose steps are about a tenth."""
    return words if words < 12 else round(12 * 1.1 ** round(math.log(words / 12) / math.log(1.1)))


@dataclass
class Shard:
    """Items that a task holds at once, with the whole benchmark's counts of their shingles (None: these are all items)."""

    items: list[tuple[int, str]]
    seen: dict[int, int] | None = None
    total: int | None = None


def item_shards(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", per_shard: int = ITEMS_PER_SHARD):
    """Shards of at most about per_shard items; the benchmark's size is counted first.

    Weights are those of the whole benchmark however it is split: Spark counts the items of each shingle, and a
    shard takes the counts of its own shingles.
    """
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    shards = max(1, -(-rows.count() // per_shard))
    if shards == 1:
        yield Shard(sorted((r["id"], r["text"]) for r in rows.collect()))
        return

    def distinct(texts: pa.Array) -> pa.Array:
        keep_words()
        return pa.array([np.unique(item_grams(t)).view(np.int64) for t in texts.to_pylist()], pa.list_(pa.int64()))

    distinct_grams = F.arrow_udf(distinct, "array<long>")
    held = rows.withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(shards))).withColumn("grams", distinct_grams("text"))
    held = scratch(spark, held, "items")
    total = held.where(F.size("grams") > 0).count()
    grams = held.select("shard", F.explode("grams").alias("gram"))
    counts = scratch(spark, grams.groupBy("gram").count(), "item-grams")
    for s in range(shards):
        mine = counts.join(grams.where(F.col("shard") == s), "gram", "left_semi")
        seen = {r["gram"] % 2**64: r["count"] for r in mine.toLocalIterator()}
        yield Shard(sorted((r["id"], r["text"]) for r in held.where(F.col("shard") == s).collect()), seen, total)


_MATCH = "array<struct<item_id:long,first_word:long,similarity:double>>"


def found_in(shard: Shard, text: Column, radius: int = RADIUS, similarity: float = SIMILARITY) -> Column:
    """Column expression: the items found in each whole text; no shuffle of documents."""
    made: list[Index] = []

    def match(texts: pa.Array) -> pa.Array:
        keep_words()
        if not made:
            made.append(Index(shard.items, radius, similarity, shard.seen, shard.total))
        rows = [[{"item_id": i, "first_word": s, "similarity": v} for i, s, v in row] for row in made[0].matches(texts.to_pylist())]
        return pa.array(rows, pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int64()), ("similarity", pa.float64())])))

    return F.arrow_udf(match, _MATCH)(text)


def contaminated(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_shard: int = ITEMS_PER_SHARD, **options
) -> DataFrame:
    """(doc_id, item_id, first_word, similarity) of each benchmark item found in each document.

    Letter case aside; at least 0.8 of weighted 5-word shingles agree at the place first_word. Shingles
    weigh more the fewer items hold them. An item of fewer than five words is one shingle and is found wherever
    its words follow one another. Null or empty texts and items, and an empty benchmark, give no rows; equal rows give equal rows.
    """
    out = None
    for shard in item_shards(benchmark, per_shard=per_shard):
        part = docs.select(F.col(id_col).alias("doc_id"), F.explode(found_in(shard, F.col(text_col), **options)).alias("f")).select("doc_id", "f.*")
        out = part if out is None else out.union(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """Rows of docs, with all their columns, in which no benchmark item is found."""
    bounded_batches(docs.sparkSession)
    for shard in item_shards(benchmark):
        docs = docs.where(F.size(found_in(shard, F.col(text_col), **options)) == 0)
    return docs
