"""Substring dedup by seed and extend.

Winnowing picks anchors, hashed runs of ANCHOR words, such that any run of `window` equal words holds the
same anchor in every document. Documents meet on shared anchors; from each the match is extended both ways
to all runs of `window` words around it, for all partners of an anchor at once: equal runs meet by their
hash, and one first seen in a smaller document is repeated text. Adjacent runs join to maximal repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WORD_HASHES, mixed, scratch, words_of

WINDOW = 50
ANCHOR = 16
_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return WORD_HASHES.of(words)


def run_hashes(h: np.ndarray, k: int, odd: int = _ODD[0]) -> np.ndarray:
    """Hash of each run of k words, by prefix sums of a polynomial modulo 2**64 with an odd base."""
    n = len(h)
    if n < k:
        return np.empty(0, np.uint64)
    base, inverse = np.uint64(odd), np.uint64(pow(odd, -1, 1 << 64))
    powers = np.ones(n + 1, np.uint64)
    powers[1:] = base
    powers = np.cumprod(powers, dtype=np.uint64)
    back = np.full(n - k + 1, inverse, np.uint64)
    back[0] = 1
    back = np.cumprod(back, dtype=np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * powers[:n], dtype=np.uint64, out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * back)


def winnowed(h: np.ndarray, width: int) -> np.ndarray:
    """Places of the least hash in each `width` neighbours, the last of equal ones."""
    n = len(h)
    if not n:
        return np.empty(0, np.int64)
    width = min(width, n)
    from numpy.lib.stride_tricks import sliding_window_view

    picked = []
    for at in range(0, n - width + 1, 65_536):
        view = sliding_window_view(h[at : at + 65_535 + width], width)[:, ::-1]
        picked.append(np.unique(np.arange(at, at + len(view)) + width - 1 - view.argmin(axis=1)))
    return np.unique(np.concatenate(picked))


def _digest(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """Per row: content hash, word count, sha256 of the words, anchors and their places."""
    schema = pa.schema([("doc_id", pa.int64()), ("content", pa.string()), ("n_words", pa.int64()), ("sha256", pa.string()), ("hash", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            out = {n: [] for n in schema.names}
            out["doc_id"] = batch.column(0)
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                joined = b" ".join(words)
                grams = run_hashes(_word_hashes(words), anchor) if len(words) >= window else np.empty(0, np.uint64)
                at = winnowed(grams, window - anchor + 1)
                for n, v in (("content", xxhash.xxh3_128_hexdigest(joined)), ("n_words", len(words)), ("sha256", hashlib.sha256(joined).hexdigest()), ("hash", grams[at].view(np.int64)), ("at", at.astype(np.int32))):
                    out[n].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return rows.mapInArrow(run, "doc_id long, content string, n_words long, sha256 string, hash array<long>, at array<int>")


def _extend(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """All runs of `window` words that hold a shared anchor: (h1, h2, doc_id, content, start)."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32())])

    def run(batches):
        for batch in batches:
            for doc_id, text, seeds in zip(*(batch.column(i).to_pylist() for i in range(3))):
                h = _word_hashes(words_of(text))
                last = len(h) - window
                if last < 0:  # another row of a repeated id
                    continue
                cover = np.zeros(last + 2, np.int64)
                seeds = np.unique(np.array(seeds))
                np.add.at(cover, np.maximum(seeds - (window - anchor), 0), 1)
                np.add.at(cover, np.minimum(seeds, last) + 1, -1)
                starts = np.flatnonzero(np.cumsum(cover)[: last + 1])
                one, two = (run_hashes(h, window, odd)[starts].view(np.int64) for odd in _ODD)
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(np.full(len(starts), doc_id, np.int64)), pa.array(starts.astype(np.int32))], schema=schema)

    return rows.mapInArrow(run, "h1 long, h2 long, doc_id long, start int")


def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) of each row; spans are maximal repeats in words.

    A word goes if a run of `window` consecutive words over it also starts in a document with a smaller id;
    runs are judged on the input. Null text has no words; shorter documents keep all; rows without an id
    keep all and lend nothing; rows that share an id do not repeat each other. Other columns are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    digest = scratch(spark, _digest(source, window, anchor), "anchors")
    least = scratch(spark, digest.where("doc_id is not null").groupBy("content").agg(F.min("doc_id").alias("least")), "least")
    # copies of a smaller document repeat it as a whole and need no search
    owners = digest.join(least, "content").where("doc_id = least")
    anchors = owners.select("doc_id", F.explode(F.arrays_zip("hash", "at")).alias("a")).select("doc_id", "a.hash", "a.at")
    # written apart, both sides of the joins are plain shuffles, whose hot keys adaptive execution splits
    shared = scratch(spark, anchors.groupBy("hash").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("hash"), "shared")
    seeds = anchors.join(shared, "hash").groupBy("doc_id").agg(F.collect_set("at").alias("seeds"))
    seeded = scratch(spark, source.where("text is not null").join(seeds, "doc_id"), "seeded")
    runs = scratch(spark, _extend(seeded.select("doc_id", "text", "seeds"), window, anchor), "runs")
    first = scratch(spark, runs.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("h1", "h2", "low"), "first")
    covered = runs.join(first, ["h1", "h2"]).where("doc_id > low").groupBy("doc_id").agg(F.collect_set("start").alias("starts"))
    schema = pa.schema([("doc_id", pa.int64()), ("content", pa.string()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.string())])

    def cut(batches):
        for batch in batches:
            out = {n: [] for n in schema.names}
            for doc_id, text, starts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = words_of(text)
                starts = np.array(starts)
                starts = starts[starts <= len(words) - window]
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + window, -1)
                gone = np.cumsum(edge)[:-1] > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                for n, v in (("doc_id", doc_id), ("content", xxhash.xxh3_128_hexdigest(b" ".join(words))), ("n_removed", int(gone.sum())), ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("spans", ",".join(f"{a}:{b}" for a, b in turn.reshape(-1, 2).tolist()))):
                    out[n].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    parts = seeded.join(covered, "doc_id").select("doc_id", "text", "starts").mapInArrow(cut, "doc_id long, content string, n_removed long, kept_sha256 string, spans string").dropDuplicates(["doc_id", "content"])
    parts = parts.withColumnsRenamed({"doc_id": "owner", "content": "of"})
    copy = (F.col("doc_id") > F.col("least")) & (F.col("n_words") >= window)
    rows = digest.select("doc_id", "content", "n_words", "sha256").join(least, "content", "left").join(parts, (F.col("doc_id") == F.col("owner")) & (F.col("content") == F.col("of")), "left")
    return rows.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        F.when(copy, F.concat(F.lit("0:"), F.col("n_words"))).otherwise(F.coalesce("spans", F.lit(""))).alias("spans"))
