"""Language identification by nearest centroid.

Texts become normalised TF-IDF vectors of hashed character n-grams. Each language is clustered into a few
centroids; a text takes the language of the centroid with the highest cosine and is rejected if it lies
farther away than that centroid's training texts do.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, keep_only

DIMENSIONS = 4096
PER_LANGUAGE = 1000  # about as many training texts of each language are taken at most
CENTROIDS = 4
LEAST_SHARE = 0.05  # of a language's training texts in each of its clusters
GRAMS = (1, 2, 3)
_CHARS_AT_ONCE = 1 << 20


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def gram_counts(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Counts of the hashed character n-grams of the whole text, lower-cased; digits and signs act as blanks."""
    total = np.zeros(dimensions)
    overlap = max(GRAMS) - 1
    for at in range(0, len(text), _CHARS_AT_ONCE):
        part = text[max(0, at - overlap) : at + _CHARS_AT_ONCE].lower()
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        low = c < 128
        c = np.where(low & ~((c >= 97) & (c <= 122)), np.uint32(32), c)
        for k in GRAMS:
            n = len(c) - k + 1
            # what the overlap repeats of the former part is not counted again
            skip = min(at, overlap) - k + 1 if at else 0
            if n <= skip:
                continue
            h = np.full(n, k, np.uint32)
            for j in range(k):
                h = (h ^ c[j : n + j]) * np.uint32(0x9E3779B1)
            total += np.bincount((h >> np.uint32(16))[skip:] % dimensions, minlength=dimensions)
    return total


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    centroids: np.ndarray  # unit rows
    owner: np.ndarray  # language of each centroid
    reach: np.ndarray  # cosine below which a text is rejected
    sizes: np.ndarray  # training texts of each centroid

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score in 0 to 1, rejected); "und" for a null text or one without a letter."""
        if text is None or not has_letter(text):
            return "und", 0.0, True
        if not len(self.languages):
            return "und", 0.0, True
        cos = self.centroids @ _unit(np.log1p(gram_counts(text)) * self.idf)
        best = int(np.argmax(cos))
        score = float(min(1.0, max(0.0, cos[best])))
        return self.languages[self.owner[best]], score, score < self.reach[best]


def _clusters(x: np.ndarray, k: int, rounds: int = 12, least: float = LEAST_SHARE) -> np.ndarray:
    """Spherical k-means from drawn texts, the far ones likelier; a fixed seed makes runs repeat.

    A cluster with less than the share `least` of the texts is one odd text rather than a way of writing: its centre
    goes to the largest cluster, which two of its texts part in two. What is still small in the end is left out.
    """
    rng = np.random.default_rng(len(x))
    floor = max(1, int(least * len(x)))
    chosen = [int(rng.integers(len(x)))]
    for _ in range(min(k, len(x)) - 1):
        far = np.maximum(0.0, 1 - np.max(x @ x[chosen].T, axis=1)).astype(float)
        if far.sum() < 1e-9:
            break
        chosen.append(int(rng.choice(len(x), p=far / far.sum())))
    c = x[chosen]
    for r in range(rounds):
        mine = np.argmax(x @ c.T, axis=1)
        sizes = np.bincount(mine, minlength=len(c))
        c = np.array([_unit(x[mine == j].mean(0)) if sizes[j] else c[j] for j in range(len(c))])
        small, large = int(np.argmin(sizes)), int(np.argmax(sizes))
        if sizes[small] < floor and sizes[large] >= 2 * floor and r < rounds - 4:
            inside = x[mine == large]
            pair = inside[rng.choice(len(inside), 2, replace=False)]
            half = np.argmax(inside @ pair.T, axis=1) == 0
            if half.any() and not half.all():
                c[small], c[large] = _unit(inside[half].mean(0)), _unit(inside[~half].mean(0))
    while len(c) > 1:
        sizes = np.bincount(np.argmax(x @ c.T, axis=1), minlength=len(c))
        if sizes.min() >= floor:
            break
        c = np.delete(c, int(np.argmin(sizes)), axis=0)
    return c


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE,
          held_out: Column | None = None, centroids: int = CENTROIDS, slack: float = 0.5) -> Model:
    """Fit on a bounded sample: rows with a language and a letter, drawn by a hash of the id, about
    `per_language` of each language (expected value; the documented bound). Only vectors reach the driver.

    slack: a text is rejected below (1 - slack) times the lowest training cosine of its centroid's nearest
    99 %, so clean texts stay.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and id is not null")
    if held_out is not None:
        rows = rows.where(~held_out)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        empty = np.zeros((0, DIMENSIONS))
        return Model((), np.zeros(DIMENSIONS), empty, np.zeros(0, int), np.zeros(0), np.zeros(0, int))
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))) for lang, n in counts.items()], F.lit(0.0))
    drawn = F.shiftrightunsigned(F.xxhash64("id", F.lit("language sample")), 11) / F.lit(2.0**53) < share

    def vectors(texts: pa.Array) -> pa.Array:
        keep_only()
        return pa.array([np.log1p(gram_counts(t)).astype(np.float16).tobytes() if t and has_letter(t) else None for t in texts.to_pylist()], pa.binary())

    vector = F.arrow_udf(vectors, "binary")

    found = rows.where(drawn).select("lang", "id", vector("text").alias("v")).where("v is not null").collect()
    found.sort(key=lambda r: (r["lang"], r["id"]))
    names, n = np.array([r["lang"] for r in found]), len(found)
    x = np.empty((n, DIMENSIONS), np.float16)
    for i in range(n - 1, -1, -1):  # rows go as they are copied
        x[i] = np.frombuffer(found.pop()["v"], np.float16)
    seen = np.zeros(DIMENSIONS, np.int64)
    for at in range(0, n, PER_LANGUAGE):
        seen += (x[at : at + PER_LANGUAGE] > 0).sum(0)
    idf = np.log((1 + n) / (1 + seen)) + 1
    languages = tuple(sorted(set(names)))
    parts, owner, reach, sizes = [], [], [], []
    for k, lang in enumerate(languages):
        mine = _unit(x[names == lang] * idf)  # the wide numbers of one language at a time
        c = _clusters(mine, centroids)
        cos = mine @ c.T
        near = np.argmax(cos, axis=1)
        for j in range(len(c)):
            own = cos[near == j, j]
            parts.append(c[j]), owner.append(k), sizes.append(len(own))
            reach.append((1 - slack) * float(np.quantile(own, 0.01)) if len(own) else 0.0)
    return Model(languages, idf.astype(np.float32), np.array(parts, np.float32), np.array(owner), np.array(reach), np.array(sizes))


def classified(model: Model, text: Column) -> Column:
    """Column expression struct(lang_pred, score, rejected) of whole texts; no shuffle."""

    def classify(texts: pa.Array) -> pa.Array:
        keep_only()
        kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
        return pa.array([dict(zip(("lang_pred", "score", "rejected"), model.classify(t))) for t in texts.to_pylist()], kind)

    return F.arrow_udf(classify, "lang_pred string, score double, rejected boolean")(text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of each row.

    A third of the ids, by crc32, is held out from training. Predictions see the text alone. Null texts and
    texts without a letter are "und"; without any training row all are. Repeated rows get equal results.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
    inner = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = train(docs, id_col, text_col, lang_col, held_out=inner, **options)
    return docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), classified(model, F.col(text_col)).alias("f")).select("doc_id", "held_out", "f.*")
