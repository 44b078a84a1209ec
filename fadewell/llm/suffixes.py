"""Suffix-array dedup of byte strings of at least 100 bytes.

One suffix array over a corpus cannot be sorted in tasks of bounded size, so the suffixes are dealt out first:
every 100-byte window has one anchor, the least hash of its 16-byte grams (the first of equal ones), hence equal
windows have equal anchors. Neighbouring windows with one anchor form a cell, a fragment of at most 184 bytes.
Cells of an anchor meet in one task. Equal fragments need no sorting: the first stays, the others are repeats.
Fragments that share an anchor but differ go, with their bytes, into suffix arrays: two-stage sorting orders
only suffixes smaller than their successors directly, induces the rest by bucket scans, and windows whose
neighbours in the array share 100 bytes or more are repeats of the earliest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, scratch

WINDOW = 100
GRAM = 16
CELLS_PER_BUCKET = 250_000
MAX_BUCKETS = 50_000  # beyond it buckets grow, so that blocks do not shrink to single cells
EMIT_BYTES = 16_000_000  # text a map task gathers before it emits its cells
ARRAY_BYTES = 2_000_000  # fragments of one suffix array, unless one anchor has more
HOT_CELLS = 20_000  # an anchor with more differing fragments is split into windows
SAMPLE_DOCS, SAMPLE_HITS = 20_000, 20  # an anchor in a thousandth of the sample's documents is split at once
_PIECE = 1 << 19
_ODD = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
_OF_BYTE = np.random.default_rng(12).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# --- windows and cells -----------------------------------------------------------------------------------

def _stir(h: np.ndarray) -> np.ndarray:
    h *= _ODD[0]
    h ^= h >> np.uint64(31)
    return h


def _doubled(h: np.ndarray, width: int, odd: np.uint64) -> np.ndarray:
    """Hashes of runs of 2 * width bytes from those of `width` bytes."""
    return _stir(h[:-width] * odd + h[width:])


def _gram_tables(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 16-byte and the 64-byte string at each place."""
    h, width, kept = _OF_BYTE[data], 1, None
    for odd in _ODD:
        h = _doubled(h, width, odd)
        width *= 2
        if width == GRAM:
            kept = h
    return kept, h


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return values if have == width else np.minimum(values[: len(values) - (width - have)], values[width - have :])


def _pieces(data: np.ndarray, ends: np.ndarray, heavy: np.ndarray):
    """Cells of texts laid end to end: (text number, start in data, windows, anchor hash, fragment hash)."""
    low = np.uint64(2 * _PIECE - 1)
    for a in range(0, max(len(data) - WINDOW + 1, 0), _PIECE):
        part = data[a : a + _PIECE + WINDOW - 1]
        grams, long = _gram_tables(part)
        marked = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)  # of equal hashes the first is least
        count = len(part) - WINDOW + 1
        at = (_least(marked, WINDOW - GRAM + 1) & low).astype(np.int64)
        start = np.arange(a, a + count)
        text = np.searchsorted(ends, start, "right")
        ok = start + WINDOW <= ends[text]
        new = np.ones(count, bool)
        new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | (ok[1:] != ok[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, count))
        keep = ok[first]
        first, size = first[keep], size[keep]
        core = grams[at[first]]
        if len(heavy):
            split = np.isin(core, heavy)
            if split.any():
                reps = np.where(split, size, 1)
                inner = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                first, single = np.repeat(first, reps) + inner, np.repeat(split, reps)
                size = np.where(single, 1, np.repeat(size, reps))
                core = np.where(single, _stir(long[first] * _ODD[1] + long[first + WINDOW - 64] * _ODD[2]), np.repeat(core, reps))
        span = size + WINDOW - 1
        frag = _stir(_stir(long[first] * _ODD[3] + long[first + (span - 64) // 2] * _ODD[4] + size.astype(np.uint64)) + long[first + span - 64] * _ODD[5])
        yield text[first], first + a, size, core, frag


def _string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column laid end to end, and where each row ends."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[1:] - offsets[0]


def _local_cells(batches, heavy: np.ndarray):
    """Per run of batches: (doc_id, content) of the texts, and their cells with places counted in the text."""
    ids, contents, texts, held = [], [], [], 0
    for batch in batches:
        ids.append(batch.column(0).to_numpy())
        contents.append(batch.column(1).to_numpy())
        texts.append(_string_buffer(batch.column(2)))
        held += len(texts[-1][0])
        if held >= EMIT_BYTES:
            yield _gathered(ids, contents, texts, heavy)
            ids, contents, texts, held = [], [], [], 0
    if ids:
        yield _gathered(ids, contents, texts, heavy)


def _gathered(ids, contents, texts, heavy):
    shift = np.cumsum([0] + [len(e) for _, e in texts])
    found = []
    for base, (data, ends) in zip(shift, texts):
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        found += [(t + base, s - begins[t], n, c, f) for t, s, n, c, f in _pieces(data, ends, heavy)]
    cells = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, np.uint64)]
    return np.concatenate(ids), np.concatenate(contents), cells


def _first_of_copies(order: list[np.ndarray], core: np.ndarray, frag: np.ndarray):
    """Sort cells by (core, frag, *order); mark the first of equal fragments, and later ones at another place."""
    rank = np.lexsort([*reversed(order), frag, core])
    core, frag = core[rank], frag[rank]
    new = np.ones(len(rank), bool)
    new[1:] = (core[1:] != core[:-1]) | (frag[1:] != frag[:-1])
    group = np.cumsum(new) - 1
    head = np.flatnonzero(new)[group] if len(rank) else group
    copy = ~new
    same = np.ones(len(rank), bool)
    for column in order:
        column = column[rank]
        same &= column == column[head]
    return rank, new, copy & ~same  # a repeated row is the same document: neither first nor copy


_FOUND = "doc_id long, content long, core long, start int, size int, hot boolean"
_FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("content", pa.int64()), ("core", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("hot", pa.bool_())])
_BLOCK = "bucket int, ids array<long>, contents array<long>, core array<long>, frag array<long>, doc array<int>, start array<int>, size array<int>"


def _found_rows(ids, contents, start, size, core=None, hot=None) -> pa.RecordBatch:
    n = len(ids)
    return pa.RecordBatch.from_arrays([
        pa.array(ids), pa.array(contents), pa.nulls(n, pa.int64()) if core is None else pa.array(core.view(np.int64)), pa.array(start.astype(np.int32)),
        pa.array(size.astype(np.int32)), pa.nulls(n, pa.bool_()) if hot is None else pa.array(hot)], schema=_FOUND_ARROW)


def _joined_runs(doc, start, size):
    """Neighbouring runs of windows of one document made one; sorted by document and start."""
    rank = np.lexsort([start, doc])
    doc, start, size = doc[rank], start[rank], size[rank]
    new = np.ones(len(rank), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + size[:-1])
    first = np.flatnonzero(new)
    return doc[first], start[first], np.add.reduceat(size, first) if len(first) else size


def _blocks(docs: DataFrame, buckets: int, heavy: np.ndarray) -> DataFrame:
    """Cells as blocks of arrays, one row per bucket and run of texts; a block without bucket (-1 - any) has
    runs of windows that are known to be copies of an earlier text of the same run."""

    def run(batches):
        for ids, contents, (doc, start, size, core, frag) in _local_cells(batches, heavy):
            rank, first, copy = _first_of_copies([ids[doc], contents[doc], start], core, frag)
            gone = rank[copy]
            parts = []
            if len(gone):
                d, s, n = _joined_runs(doc[gone], start[gone], size[gone])
                parts.append((-1 - int(ids[d[0]]) % buckets, d, s, n, None, None))
            mine = rank[first]
            bucket = (core[mine] % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            mine, bucket = mine[by], bucket[by]
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(mine) else []
            for a, b in zip(cuts, [*cuts[1:], len(mine)]):
                m = mine[a:b]
                parts.append((int(bucket[a]), doc[m], start[m], size[m], core[m], frag[m]))
            for number, d, s, n, c, f in parts:
                used, index = np.unique(d, return_inverse=True)
                none = np.empty(0, np.int64)
                columns = [ids[used], contents[used], none if c is None else c.view(np.int64), none if f is None else f.view(np.int64),
                           index.astype(np.int32), s.astype(np.int32), n.astype(np.int32)]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([number], pa.int32())} | {
                    name: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v))
                    for name, v in zip(("ids", "contents", "core", "frag", "doc", "start", "size"), columns)})

    return docs.mapInArrow(run, _BLOCK)


def _meet(batches):
    """Blocks sorted by bucket: copies of fragments, and the fragments that differ under a shared anchor."""
    bucket, held = None, []
    for batch in batches:
        for i, number in enumerate(batch.column(0).to_pylist()):
            if number != bucket:
                yield from _met(held)
                bucket, held = number, []
            ids, contents, core, frag, doc, start, size = (c[i].values.to_numpy() for c in batch.columns[1:])
            if number < 0:
                yield _found_rows(ids[doc], contents[doc], start, size)
            else:
                held.append((ids[doc], contents[doc], core.view(np.uint64), frag.view(np.uint64), start, size))
    yield from _met(held)


def _met(held):
    if not held:
        return
    ids, contents, core, frag, start, size = (np.concatenate(x) for x in zip(*held))
    rank, first, copy = _first_of_copies([ids, contents, start], core, frag)
    gone = rank[copy]
    if len(gone):
        yield _found_rows(ids[gone], contents[gone], start[gone], size[gone])
    mine = rank[first]
    c = core[mine]
    new = np.append(True, c[1:] != c[:-1])
    cuts = np.flatnonzero(new)
    many = np.repeat(np.diff(np.append(cuts, len(c))), np.diff(np.append(cuts, len(c))))
    mine, c, many = mine[many > 1], c[many > 1], many[many > 1]
    if len(mine):
        yield _found_rows(ids[mine], contents[mine], start[mine], size[mine], c, many > HOT_CELLS)


def _heavy_anchors(docs: DataFrame, n: int) -> np.ndarray:
    """Anchors that a sample of documents has very often; their windows are dealt out one by one.

    The list decides only where windows meet, never the result; it has at most a few hashes per document of the sample.
    """
    part = docs.sample(min(1.0, SAMPLE_DOCS / max(n, 1)), 12)

    def run(batches):
        for _, _, (doc, _, _, core, frag) in _local_cells(batches, np.empty(0, np.uint64)):
            both = np.unique(np.stack([core, frag], axis=1), axis=0)[:, 0] if len(core) else core
            values, count = np.unique(both, return_counts=True)
            often = count > 1
            yield pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(count[often])], names=["core", "n"])

    rows = part.mapInArrow(run, "core long, n long").groupBy("core").agg(F.sum("n").alias("n")).where(F.col("n") >= SAMPLE_HITS)
    return np.array(sorted(r["core"] for r in rows.select("core").collect()), np.int64).view(np.uint64)


# --- suffix arrays ---------------------------------------------------------------------------------------

def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one number; data must end in at least eight spare bytes."""
    words = np.zeros(len(data) - 7, np.uint64)
    for i in range(8):
        words = (words << np.uint64(8)) | data[i : len(data) - 7 + i]
    return words


def _sorted_directly(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their first `depth` bytes, eight at a time; only tied ones go on."""
    order = places[np.argsort(words[places], kind="stable")]
    value = words[order]
    tied = np.zeros(len(order), bool)
    group = np.cumsum(np.append(True, value[1:] != value[:-1])) if len(order) else np.empty(0, np.int64)
    for at in range(8, depth, 8):
        if len(order) < 2:
            break
        equal = group[1:] == group[:-1]
        tied[:] = False
        tied[1:] |= equal
        tied[:-1] |= equal
        left = np.flatnonzero(tied)
        if not len(left):
            break
        place, g = order[left], group[left]
        value = words[np.minimum(place + at, len(words) - 1)]
        by = np.lexsort([value, g])
        order[left] = place[by]
        value = value[by]
        new = np.ones(len(left), bool)
        new[1:] = (value[1:] != value[:-1]) | (g[1:] != g[:-1])
        # numbers stay in order: a group's members keep the range of places it had
        group[left] = left[np.flatnonzero(new)[np.cumsum(new) - 1]] + 1
        if at == 8:
            group[~tied] = np.flatnonzero(~tied) + 1
    return order


def suffix_order(data: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The places where `wanted` holds, ordered by the suffixes of `data` as far as their first `depth` bytes.

    Two-stage sorting. A suffix smaller than its successor is sorted directly; any other one follows from its
    successor when the scan of the buckets, one per first byte, comes by it: within a bucket those that the
    smaller buckets give, then those that they give in turn, then the directly sorted ones.
    """
    m = len(data)
    if not m:
        return np.empty(0, np.int64)
    padded = np.concatenate([data, np.zeros(depth + 16, np.uint8)])
    change = np.append(np.flatnonzero(data[1:] != data[:-1]), m - 1)  # last place of each run of equal bytes
    run_end = change[np.searchsorted(change, np.arange(m), "left")]
    after = np.append(data, 0)[run_end + 1].astype(np.int16)
    smaller = (data < after) & (run_end < m - 1)
    # an induced suffix needs its successors down to one that is sorted directly, or to the end
    nearest = np.append(np.where(smaller, np.arange(m), m), m)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    reach = np.zeros(m + 2, np.int64)
    places = np.flatnonzero(wanted)
    np.add.at(reach, places, 1)
    np.add.at(reach, nearest[places] + 1, -1)
    used = np.cumsum(reach)[: m + 1] > 0
    direct = _sorted_directly(np.flatnonzero(used[:m] & smaller), _words(padded), depth)
    induced = used[:m] & ~smaller
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]

    def hand_on(found: np.ndarray, byte: int) -> None:
        before = found[found > 0] - 1
        before = before[induced[before]]
        value = data[before].astype(np.int16)
        before, value = before[value > byte], value[value > byte]
        by = np.argsort(value, kind="stable")
        before, value = before[by], value[by]
        cuts = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(before) else []
        for a, b in zip(cuts, [*cuts[1:], len(before)]):
            pending[value[a]].append(before[a:b])

    out = []
    if used[m]:
        hand_on(np.array([m]), -1)
    heads = np.searchsorted(data[direct], np.arange(257), "left")
    for byte in range(256):
        now = np.concatenate(pending[byte]) if pending[byte] else np.empty(0, np.int64)
        scanned = [now]
        while len(now):
            now = now[now > 0] - 1
            now = now[induced[now] & (data[now] == byte)]
            scanned.append(now)
        bucket = np.concatenate([*scanned, direct[heads[byte] : heads[byte + 1]]])
        pending[byte] = []
        if len(bucket):
            hand_on(bucket, byte)
            out.append(bucket)
    order = np.concatenate(out) if out else np.empty(0, np.int64)
    return order[wanted[order]]


def common_prefixes(data: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Equal leading bytes of each suffix and the one before it in `order`, as far as `limit`; the first has 0."""
    padded = np.concatenate([data, np.zeros(limit + 16, np.uint8)])
    words = _words(padded)
    lcp = np.zeros(len(order), np.int64)
    a, b, live = order[1:], order[:-1], np.arange(1, len(order))
    for at in range(0, limit, 8):
        if not len(live):
            break
        x = words[a[live - 1] + at] ^ words[b[live - 1] + at]
        same = x == 0
        differ = live[~same]
        bits = x[~same]
        lead = np.zeros(len(bits), np.int64)
        for k in range(7):
            lead += bits < np.uint64(1) << np.uint64(56 - 8 * k)
        lcp[differ] = at + lead
        live = live[same]
    lcp[live] = limit
    return np.minimum(lcp, limit)


def _repeats(ids, contents, start, size, fragments):
    """Windows of fragments that an earlier fragment has too, as found rows."""
    data = np.frombuffer(b"".join(fragments), np.uint8)
    begin = np.cumsum([0] + [len(f) for f in fragments[:-1]])
    owner = np.repeat(np.arange(len(begin)), size)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    wanted = np.zeros(len(data), bool)
    wanted[begin[owner] + inside] = True
    order = suffix_order(data, wanted, WINDOW)
    lcp = common_prefixes(data, order, WINDOW)
    group = np.cumsum(lcp < WINDOW)
    holder = np.searchsorted(begin, order, "right") - 1
    place = start[holder] + order - begin[holder]
    rank = np.lexsort([place, contents[holder], ids[holder], group])
    g, h, p = group[rank], holder[rank], place[rank]
    head = np.searchsorted(g, g, "left")
    later = (ids[h] != ids[h[head]]) | (contents[h] != contents[h[head]]) | (p != p[head])  # else a repeated row
    if later.any():
        docs, s, n = _joined_runs(h[later], p[later], np.ones(int(later.sum()), np.int64))
        yield _found_rows(ids[docs], contents[docs], s, n)


def _sort_fragments(batches):
    """Fragments sorted by anchor; whole anchors are gathered into one array."""
    held, size, last = [], 0, None
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in ("core", "doc_id", "content", "start", "size", "fragment"))):
            if size >= ARRAY_BYTES and row[0] != last:
                yield from _repeats(*_columns(held))
                held, size = [], 0
            held.append(row[1:])
            size += len(row[5])
            last = row[0]
    if held:
        yield from _repeats(*_columns(held))


def _columns(held):
    ids, contents, start, size, fragments = zip(*held)
    return np.array(ids, np.int64), np.array(contents, np.int64), np.array(start, np.int64), np.array(size, np.int64), fragments


# --- the operator ----------------------------------------------------------------------------------------

def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row.

    A byte goes if a 100-byte string over it also starts earlier: in a smaller id, or earlier in the same
    document. Strings never cross documents and are judged on the input. Null text is empty; shorter texts keep
    all. Repeated rows are one document; of different texts with one id the one with the smaller text hash is
    the earlier. Rows without an id keep all and lend nothing. Other columns are not read.
    """
    bounded_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    source = source.withColumn("content", F.xxhash64("text"))
    texts = source.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= WINDOW)).select("doc_id", "content", "text")
    facts = texts.agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()
    buckets = min(MAX_BUCKETS, max(1, -(-(facts["bytes"] or 0) // (CELLS_PER_BUCKET * 43))))  # a cell has 43 windows on average
    heavy = _heavy_anchors(texts, facts["n"])
    blocks = _blocks(texts, buckets, heavy).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    found = scratch(spark, blocks.mapInArrow(_meet, _FOUND), "found")
    key = ["doc_id", "content"]
    cells = found.groupBy(*key).agg(F.collect_list(F.struct("core", "start", "size", "hot")).alias("cells"))
    seeded = scratch(spark, texts.join(cells, key), "seeded")  # the texts that share anything, with what they share
    edges = found.agg(F.count(F.col("core")).alias("n"), F.count_if("hot").alias("hot")).first()
    cell = seeded.select(*key, "text", F.filter("cells", lambda c: c["core"].isNotNull()).alias("cells")).where(F.size("cells") > 0)
    fragments = cell.mapInArrow(_cut_fragments, "core long, doc_id long, content long, start int, size int, fragment binary")
    arrays = max(1, -(-edges["n"] * 142 // ARRAY_BYTES))
    later = fragments.repartition(arrays, "core").sortWithinPartitions("core").mapInArrow(_sort_fragments, _FOUND)
    if edges["hot"]:
        later = later.union(_hot_repeats(spark, cell))
    later = later.groupBy(*key).agg(F.collect_list(F.struct("core", "start", "size", "hot")).alias("more"))
    result = seeded.join(later, key, "left").select(*key, "text", F.concat(F.filter("cells", lambda c: c["core"].isNull()), F.coalesce("more", F.array())).alias("gone"))
    cut = result.where(F.size("gone") > 0).mapInArrow(_cut, "doc_id long, content long, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(key)
    base = source.select(*key, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    none = F.lit(0).cast("long")
    return base.join(cut, key, "left").select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"),
                                              F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


def _cut_fragments(batches):
    schema = pa.schema([("core", pa.int64()), ("doc_id", pa.int64()), ("content", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("fragment", pa.binary())])
    for batch in batches:
        rows = [[] for _ in schema]
        ids, contents, texts, cells = (batch.column(n) for n in ("doc_id", "content", "text", "cells"))
        data, ends = _string_buffer(texts)
        lists, fields = cells.flatten(), cells.offsets.to_numpy() - cells.offsets[0].as_py()
        core, start, size, hot = (lists.field(n).to_pylist() for n in ("core", "start", "size", "hot"))
        for i, (doc, content) in enumerate(zip(ids.to_pylist(), contents.to_pylist())):
            base = int(ends[i - 1]) if i else 0
            for j in range(fields[i], fields[i + 1]):
                if not hot[j]:
                    a = base + start[j]
                    for column, v in zip(rows, (core[j], doc, content, start[j], size[j], data[a : a + size[j] + WINDOW - 1].tobytes())):
                        column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(rows, schema)], schema=schema)


def _hot_repeats(spark: SparkSession, cells: DataFrame) -> DataFrame:
    """Windows of anchors with very many differing fragments: every window is a row of its own that meets its
    equals by hash, pre-aggregated, so no anchor is gathered whole."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("content", pa.int64()), ("start", pa.int32())])

    def run(batches):
        for batch in batches:
            for doc, content, text, found in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "content", "text", "cells"))):
                starts = [s for c in found if c["hot"] for s in range(c["start"], c["start"] + c["size"])]
                if starts:
                    raw, s = text.encode(), np.array(starts)
                    digests = np.frombuffer(b"".join(hashlib.blake2b(raw[a : a + WINDOW], digest_size=16).digest() for a in starts), np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), pa.array(np.full(len(s), doc)), pa.array(np.full(len(s), content)), pa.array(s.astype(np.int32))], schema=schema)

    windows = scratch(spark, cells.mapInArrow(run, "h1 long, h2 long, doc_id long, content long, start int"), "windows")
    place = F.struct("doc_id", "content", "start")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"))
    return windows.join(first, ["h1", "h2"]).where(place != F.col("first")).select(
        "doc_id", "content", F.lit(None).cast("long").alias("core"), "start", F.lit(1).alias("size"), F.lit(None).cast("boolean").alias("hot"))


def _cut(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("content", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    for batch in batches:
        out = {n: [] for n in schema.names}
        out["doc_id"], out["content"] = batch.column(0), batch.column(1)
        data, ends = _string_buffer(batch.column(2))
        gone = batch.column(3)
        at, runs = gone.offsets.to_numpy() - gone.offsets[0].as_py(), gone.flatten()
        start, size = runs.field("start").to_numpy().astype(np.int64), runs.field("size").to_numpy().astype(np.int64)
        for i in range(batch.num_rows):
            text = data[ends[i - 1] if i else 0 : ends[i]]
            edge = np.zeros(len(text) + 1, np.int64)
            a, n = start[at[i] : at[i + 1]], size[at[i] : at[i + 1]]
            np.add.at(edge, a, 1)
            np.add.at(edge, a + n + WINDOW - 1, -1)
            removed = np.cumsum(edge)[:-1] > 0
            out["n_removed"].append(int(removed.sum()))
            out["n_spans"].append(int(np.count_nonzero(np.diff(removed.astype(np.int8), prepend=0) == 1)))
            out["kept_sha256"].append(hashlib.sha256(text[~removed].tobytes()).hexdigest())
        yield pa.RecordBatch.from_pydict(out, schema=schema)
