"""Helpers of the corpus operators: scratch tables, words, word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from operator import itemgetter

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

from fadewell.session import ensure_checkpoint_dir

MAX_WORDS_KEPT = 150_000  # word hashes a Python worker keeps; beyond it the table starts anew


BATCH_ROWS = "1000"


def bounded_batches(spark: SparkSession) -> None:
    """Long texts: Arrow batches of 1,000 rows bound a worker's memory, unless the session sets its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)


def scratch(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    bounded_batches(spark)
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than space and \\t\\n\\v\\f\\r, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    """The same with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """XXH64 of words, each computed once per worker."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MAX_WORDS_KEPT:
            self.clear()
        if len(words) < 2:
            return np.array([self[w] for w in words], np.uint64)
        return np.fromiter(itemgetter(*words)(self), np.uint64, len(words))


#: One table per worker process for all operators, so its memory is held once.
WORD_HASHES = WordHashes()

#: Tables that a worker process keeps between tasks: word hashes, encoders.
KEPT_TABLES: list[dict] = [WORD_HASHES]


def keep_only(table: dict | None = None) -> None:
    """Empty the tables of other stages: Spark reuses its Python workers, so they would stay until the end.

    Every Python stage calls it, those without a table of their own too.
    """
    others = [t for t in KEPT_TABLES if t is not table and t]
    for t in others:
        t.clear()
    if others:
        give_back()


def give_back() -> None:
    """Free memory goes back to the system where the C library can."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """From the worker's own table: a nested function that names the table would carry a copy of it."""
    return WORD_HASHES.of(words)


def keep_words() -> None:
    """Keep the worker's word hashes only."""
    keep_only(WORD_HASHES)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finisher: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; fewer words make one gram of all, none make none."""
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    k = min(k, n)
    total = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        odd = np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1)) % 2**64)
        total += word_hashes[j : n - k + 1 + j] * odd
    return mixed(total)
