"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact rerank.

A rotation learned on a bounded sample turns each vector into a balanced binary code. Vectors whose codes
agree in one block of bits meet in that block's table; candidates within a Hamming radius are compared by
the cosine of the original vectors in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .hamming import flat_components
from .shared import scratch

SAMPLE = 20_000  # vectors the rotation is fitted on, about; drawn by a hash of the id
BITS = 64
BLOCKS = 8
CHUNK = 2048  # vectors of one table cell that a task compares at once
_QUERIES_AT_ONCE = 512


@dataclass(frozen=True)
class Rotation:
    mean: np.ndarray
    turn: np.ndarray  # dimensions x bits

    def codes(self, x: np.ndarray) -> np.ndarray:
        bits = (x - self.mean) @ self.turn > 0
        if bits.shape[1] < 64:
            bits = np.pad(bits, ((0, 0), (0, 64 - bits.shape[1])))
        return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def fit_rotation(x: np.ndarray, bits: int = BITS, rounds: int = 30, seed: int = 5) -> Rotation:
    """Principal directions, then alternating: codes are the signs of the rotated vectors, the rotation is
    the orthogonal one that brings the vectors nearest to their codes."""
    dims = x.shape[1] if x.ndim == 2 else 1
    bits = min(bits, dims, 64)
    if len(x) < 2:
        return Rotation(np.zeros(dims), np.eye(dims)[:, :bits])
    mean = x.mean(0)
    _, axes = np.linalg.eigh(np.cov((x - mean).T).reshape(dims, dims))
    v = (x - mean) @ axes[:, ::-1][:, :bits]
    turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
        turn = (u @ w).T
    return Rotation(mean, axes[:, ::-1][:, :bits] @ turn)


def _unit_rows(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, bytes, scaled) with vectors as little-endian doubles; null where nothing can link."""

    @F.pandas_udf("binary")
    def as_bytes(col):
        import pandas as pd

        def one(v):
            if v is None or any(e is None for e in v):
                return None
            x = np.asarray(v, "<f8")
            top = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0.0
            if not top > 0:
                return None
            x = x / top  # no overflow or underflow in the norm
            return (x + 0.0).tobytes()

        return pd.Series([one(v) for v in col], dtype=object)

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), as_bytes(F.col(vector_col)).alias("raw"))


def _cells(threshold: float, radius: int, masks: list[int]):
    """Streams rows sorted by cell; yields link counts and spanning links of each cell's queries."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def cell(rows: pa.Table, table: int):
        ids, code, copies = rows["id"].to_numpy(), rows["code"].to_numpy().view(np.uint64), rows["copies"].to_numpy()
        x = _unit_rows(rows["raw"].to_pylist())
        hold = np.flatnonzero(rows["holds"].to_numpy(zero_copy_only=False))
        ask = np.flatnonzero(rows["asks"].to_numpy(zero_copy_only=False))
        names, node = np.unique(ids, return_inverse=True)
        node = node.ravel()
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        count = np.zeros(len(ask), np.int64)
        for at in range(0, len(ask), _QUERIES_AT_ONCE):
            q = ask[at : at + _QUERIES_AT_ONCE]
            apart = code[q][:, None] ^ code[hold][None, :]
            near = (np.bitwise_count(apart) <= radius) & (ids[q][:, None] != ids[hold][None, :])
            for earlier in masks[:table]:  # an earlier table has the pair already
                near &= (apart & np.uint64(earlier)) != 0
            if not near.any():
                continue
            near &= x[q] @ x[hold].T >= threshold
            i, j = np.nonzero(near)
            count[at : at + len(q)] += np.bincount(i, copies[hold[j]], len(q)).astype(np.int64)
            a.append(node[q[i]]), b.append(node[hold[j]])
            if sum(map(len, a)) > 2_000_000:
                a, b = star(len(names), a, b)
        a, b = star(len(names), a, b)
        linked = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([names[a[0]], ids[ask[linked]]])), pa.array(np.concatenate([names[b[0]], ids[ask[linked]]])),
            pa.array(np.concatenate([np.zeros(len(a[0]), np.int64), count[linked]]))], schema=out)

    def star(n, a, b):
        label = flat_components(n, np.concatenate(a), np.concatenate(b))
        moved = np.flatnonzero(label != np.arange(n))
        return [moved], [label[moved]]

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                key = batch["cell"].to_numpy()
                if held[0]["cell"][0].as_py() == key[-1]:
                    continue
                rows = pa.Table.from_batches(held)
                key = rows["cell"].to_numpy()
                cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()]
                for s, e in zip(cuts, cuts[1:]):
                    part = rows.slice(s, e - s)
                    yield cell(part, part["t"][0].as_py())
                held = rows.slice(cuts[-1]).to_batches()
        if held:
            rows = pa.Table.from_batches(held)
            yield cell(rows, rows["t"][0].as_py())

    return run


def near_vectors(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9,
                 radius: int = 18, blocks: int = BLOCKS, sample: int = SAMPLE, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each vector.

    Every link reported has a cosine of at least `threshold`. Pairs whose codes differ in fewer bits than
    there are `blocks` are always found; the tests measure recall against brute force. Equal vectors are
    compared once and counted in full. A cell of more than `chunk` vectors is searched chunk by chunk, each
    chunk a task of its own. Null, zero or non-finite vectors link with nothing. Vectors link only with ones
    of their own length. Repeated ids are one vector each in n_links and share a component.
    """
    raw = scratch(spark, _valid(vectors, id_col, vector_col), "vectors")
    alike = scratch(spark, raw.where("raw is not null").groupBy("raw").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "alike")
    parts = []
    for row in alike.select(F.length("raw").alias("bytes")).groupBy("bytes").agg(F.count("*").alias("n")).collect():  # one row per vector length
        group = alike.where(F.length("raw") == row["bytes"])
        share = min(1.0, sample / row["n"])
        drawn = group.where(F.shiftrightunsigned(F.xxhash64("id", F.lit("rotation")), 11) / F.lit(2.0**53) < share).select("id", "raw").collect()
        drawn.sort(key=lambda r: r["id"])
        fitted = fit_rotation(_unit_rows([r["raw"] for r in drawn]) if drawn else np.zeros((0, row["bytes"] // 8)))

        @F.pandas_udf("long")
        def code(col, fitted=fitted):
            import pandas as pd

            return pd.Series(fitted.codes(_unit_rows(list(col))).view(np.int64)) if len(col) else pd.Series([], dtype="int64")

        edges = [64 * i // blocks for i in range(blocks + 1)]
        masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
        signed = [m - (1 << 64) if m >> 63 else m for m in masks]
        coded = scratch(spark, group.select("id", "raw", "copies", code("raw").alias("code")), "codes")
        keyed = coded.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("code").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(signed)])).alias("k")).select("id", "raw", "copies", "code", "k.t", "k.v")
        sizes = keyed.groupBy("t", "v").agg(F.count("*").alias("n")).where("n > 1")
        chunks = F.ceil(F.col("n") / F.lit(chunk))
        rows = keyed.join(sizes, ["t", "v"]).withColumn("c", F.pmod(F.xxhash64("id", "t"), chunks))
        one = rows.where(chunks == 1).withColumns({"asks": F.lit(True), "holds": F.lit(True)})
        many = rows.where(chunks > 1)
        holds = many.withColumns({"asks": F.lit(False), "holds": F.lit(True)})
        asks = many.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))).withColumns({"asks": F.lit(True), "holds": F.lit(False)})
        names = ["id", "raw", "copies", "code", "t", "asks", "holds"]
        laid = one.unionByName(holds).unionByName(asks).select(*names, F.xxhash64("t", "v", "c").alias("cell"))
        parts.append(laid.repartition("cell").sortWithinPartitions("cell", "t").mapInArrow(_cells(threshold, radius, masks), "a long, b long, n long"))
    if not parts:
        return raw.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    found = scratch(spark, found, "found")
    counts = found.where("n > 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    labels = components(spark, found.where("n = 0").select("a", "b"))
    known = alike.join(counts, "id", "left").join(labels, F.col("id") == F.col("node"), "left").select(
        "raw", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = raw.join(known, "raw", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
