"""Links between 64-bit fingerprints within a Hamming radius: multi-index shards, a BK-tree in each.

`tables(radius, rows)` cuts the 64 bits into blocks and takes every choice of `k` blocks; fingerprints at
most `radius` bits apart agree on one such choice in full, so they meet in one shard (table, blocks' bits).
A shard's fingerprints form a BK-tree: children hang on the integer Hamming distance to the parent, and a
search follows only edges within the radius. Trees are not broadcast, because they grow with the corpus:
each is built in the task that holds its shard. Links come out as a spanning forest, never as all pairs.

A shard of more than CHUNK rows is cut into chunks by a hash. After the first round of components, only
fingerprints outside the shard's largest component search the other chunks, which is all that can still join.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import scratch

CHUNK = 2048
SHARD_ROWS = 256  # expected rows of a shard above which finer tables are taken
PAIRS_AT_ONCE = 200_000


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


def tables(radius: int, rows: int) -> list[int]:
    """Masks of the blocks compared in full; finer for more rows, with the same guarantee at every size."""
    for k in range(1, 6):
        blocks = radius + k
        if rows <= SHARD_ROWS << (64 * k // blocks) or k == 5:
            edges = [64 * i // blocks for i in range(blocks + 1)]
            parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
            return [sum(c) for c in combinations(parts, k)]
    raise AssertionError


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _repeat_ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each range, one after another."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - np.repeat(before - starts, sizes)


class BkForest:
    """A BK-tree for each shard, built level by level; all trees in the same arrays."""

    def __init__(self, fps: np.ndarray, shard: np.ndarray):
        self.fps = fps
        n = len(fps)
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        self.shards, first, group = np.unique(shard, return_index=True, return_inverse=True)
        self.roots = first
        rest, heads = np.arange(n), first
        group = group.ravel()
        while len(rest):
            stays = np.ones(n, bool)
            stays[heads] = False
            keep = stays[rest]
            rest, above = rest[keep], heads[group[keep]]
            if not len(rest):
                break
            d = bits_apart(fps[rest], fps[above])
            _, first, group = np.unique(above * 65 + d, return_index=True, return_inverse=True)
            group = group.ravel()
            heads = rest[first]
            parent[heads], edge[heads] = above[first], d[first]
        kids = np.flatnonzero(parent >= 0)
        self.kids = kids[np.lexsort((edge[kids], parent[kids]))]
        self.kid_edge = edge[self.kids]
        counts = np.bincount(parent[kids], minlength=n)
        self.kid_from = np.cumsum(counts) - counts
        self.kid_count = counts

    def within(self, fps: np.ndarray, shard: np.ndarray, radius: int):
        """(query, node, distance) arrays of all pairs within the radius, in bounded batches."""
        at = np.searchsorted(self.shards, shard)
        known = np.flatnonzero((at < len(self.shards)) & (self.shards[np.minimum(at, len(self.shards) - 1)] == shard)) if len(self.shards) else np.empty(0, int)
        waiting = [(known, self.roots[at[known]])]
        while waiting:
            q, node = waiting.pop()
            if len(q) > PAIRS_AT_ONCE:
                half = len(q) // 2
                waiting += [(q[half:], node[half:]), (q[:half], node[:half])]
                continue
            d = bits_apart(fps[q], self.fps[node])
            near = d <= radius
            if near.any():
                yield q[near], node[near], d[near]
            sizes = self.kid_count[node]
            kid = _repeat_ranges(self.kid_from[node], sizes)
            q, d = np.repeat(q, sizes), np.repeat(d, sizes)
            follow = np.abs(self.kid_edge[kid] - d) <= radius
            if follow.any():
                waiting.append((q[follow], self.kids[kid[follow]]))


def flat_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reachable, for indices below n."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label != label[label]).any():
            label = label[label]
    return label


def spanning(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Indices of the links of a heaviest spanning forest."""
    rank = np.empty(len(a), np.int64)
    rank[np.argsort(-weight, kind="stable")] = np.arange(len(a))
    label, chosen, live = np.arange(n), [], np.arange(len(a))
    while True:
        live = live[label[a[live]] != label[b[live]]]
        if not len(live):
            return np.concatenate(chosen) if chosen else live
        ends = np.concatenate([label[a[live]], label[b[live]]])
        both = np.concatenate([live, live])
        order = np.lexsort((rank[both], ends))
        _, first = np.unique(ends[order], return_index=True)
        best = np.unique(both[order][first])
        chosen.append(best)
        label = flat_components(n, label[a[best]], label[b[best]])[label]


def _forest_links(fps, ids, shard, query_fps, query_ids, query_shard, radius, score: Callable | None, accept: Callable):
    """Spanning links (query index, node index) between queries and the trees of their shards."""
    none = np.empty(0, np.int64)
    if not len(fps) or not len(query_fps):
        return none, none
    forest = BkForest(fps, shard)
    names, node_of = np.unique(np.concatenate([ids, query_ids]), return_inverse=True)
    node_of = node_of.ravel()
    held: list[tuple] = []

    def reduced():
        q, x, w = (np.concatenate(v) for v in zip(*held))
        pick = spanning(len(names), node_of[x], node_of[len(ids) + q], w)
        return q[pick], x[pick], w[pick]

    for q, x, d in forest.within(query_fps, query_shard, radius):
        keep = ids[x] != query_ids[q]
        q, x, d = q[keep], x[keep], d[keep]
        keep = accept(q, x)
        q, x, d = q[keep], x[keep], d[keep]
        if len(q):
            held.append((q, x, score(q, x) if score is not None else -d.astype(float)))
        if sum(len(h[0]) for h in held) > 4 * PAIRS_AT_ONCE:
            held[:] = [reduced()]
    return reduced()[:2] if held else (none, none)


def sketch_agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bytes, corrected for those equal by chance."""
    same = (a == b).mean(axis=1)
    return (same - 1 / 256) / (1 - 1 / 256)


def _kernel(radius: int, least: float | None):
    """Streams rows sorted by shard and chunk; a batch ends at a shard's end."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solve(rows: pa.Table):
        fp, ids, shard, label = (rows[k].to_numpy() for k in ("fp", "id", "shard", "label"))
        fp = fp.view(np.uint64)
        ask, hold = (np.flatnonzero(rows[k].to_numpy(zero_copy_only=False)) for k in ("asks", "holds"))
        score = None
        if least is not None:
            raw = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(rows.num_rows, -1)

            def score(q, x):
                return sketch_agreement(raw[ask[q]], raw[hold[x]])

        def accept(q, x):
            apart = label[ask[q]] != label[hold[x]]
            return apart if least is None else apart & (score(q, x) >= least)

        q, x = _forest_links(fp[hold], ids[hold], shard[hold], fp[ask], ids[ask], shard[ask], radius, score, accept)
        return pa.RecordBatch.from_arrays([pa.array(ids[ask][q]), pa.array(ids[hold][x])], schema=out)

    def run(batches):
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count < 50_000:
                continue
            rows = pa.Table.from_batches(held)
            shard = rows["shard"].to_numpy()
            cut = int(np.flatnonzero(shard != shard[-1])[-1]) + 1 if shard[0] != shard[-1] else 0
            if cut:
                yield solve(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
                count -= cut
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def fingerprint_links(spark: SparkSession, items: DataFrame, radius: int, guaranteed: int | None = None, least: float | None = None, chunk: int = CHUNK, search_again: bool = True) -> DataFrame:
    """Edges (a, b) that connect what links within `radius` connect; items: id long, distinct,
    fp long, and sketch binary if `least` is given.

    guaranteed: radius up to which the tables must meet (the search radius unless given). least: with it,
    links also need that share of agreement between the sketches, and the forest prefers the highest.
    search_again: without it, shards above `chunk` are searched only within their chunks.
    """
    rows_in = items.count()
    masks = [signed(m) for m in tables(radius if guaranteed is None else guaranteed, rows_in)]
    sketch = F.col("sketch") if least is not None else F.lit(None).cast("binary").alias("sketch")
    keyed = items.select("id", "fp", sketch, F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks)])).alias("k"))
    keyed = keyed.select("id", "fp", "sketch", "k.t", "k.v")
    sizes = keyed.groupBy("t", "v").agg(F.count("*").alias("n")).where("n > 1")
    rows = keyed.join(sizes, ["t", "v"]).withColumn("c", F.pmod(F.xxhash64("id", "t"), F.ceil(F.col("n") / F.lit(chunk))))
    shard = F.xxhash64("t", "v", "c").alias("shard")
    run = _kernel(radius, least)

    def solved(found: DataFrame) -> DataFrame:
        parts = found.repartition("shard").sortWithinPartitions("shard")
        return parts.select("shard", "id", "fp", "sketch", "asks", "holds", "label").mapInArrow(run, "a long, b long")

    yes = F.lit(True)
    # every row is its own label in the first round
    first = scratch(spark, solved(rows.select(shard, "id", "fp", "sketch", yes.alias("asks"), yes.alias("holds"), F.col("id").alias("label"))), "links")
    if not search_again:
        return first
    hot = scratch(spark, rows.where(F.col("n") > chunk), "hot")
    if hot.isEmpty():
        return first
    labels = components(spark, first)
    hot = hot.join(labels, hot.id == labels.node, "left").withColumn("label", F.coalesce("component", "id")).drop("node", "component")
    largest = hot.groupBy("t", "v", "label").agg(F.count("*").alias("m")).groupBy("t", "v").agg(F.max_by("label", F.struct("m", "label")).alias("most"), F.count("*").alias("labels"))
    hot = scratch(spark, hot.join(largest.where("labels > 1"), ["t", "v"]), "hot")
    other = hot.where("label <> most").withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / F.lit(chunk)) - 1)))
    again = hot.select(shard, "id", "fp", "sketch", F.lit(False).alias("asks"), yes.alias("holds"), "label").union(
        other.select(shard, "id", "fp", "sketch", yes.alias("asks"), F.lit(False).alias("holds"), "label"))
    return first.union(scratch(spark, solved(again), "links"))
