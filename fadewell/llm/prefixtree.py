"""Prefix trie of conversations from ternary search trees.

Turns are dictionary-encoded, so a rebuilt conversation is a short row of ids. The rows are range-partitioned
by (ids, conv_id) and each range shard builds one ternary search tree, median first, so that the search trees
among siblings are balanced. Shards share only the nodes on the paths of their first and last rows. Those
boundary nodes are merged by one pass over the shards' two paths, kept as a stack of open nodes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import scratch

TURNS_PER_SHARD = 200_000
BROADCAST_ROWS = 200_000
ENDS_PER_ROW = 50_000  # ids in one piece of a boundary node's member list
_NODE = "shard int, chain int, depth long, conv_id long, parent_conv_id long, up_chain int, up_depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_PATH = "shard int, chain int, ids array<long>, lens array<long>, least array<long>, members array<long>, inner array<long>, leaves array<long>, saved array<long>"
_ENDS = "shard int, chain int, depth long, piece long, ids string"
_SHARD = f"kind int, {_NODE}, {', '.join(c.strip() for c in _PATH.split(',')[2:])}, piece long, convs string"


class TernaryTree:
    """Trie over rows of ids; siblings hang in a binary search tree (low, high), children below `equal`.

    Node 0 is the root of the trie. A node is made after its parent, so falling numbers visit children first.
    """

    def __init__(self) -> None:
        self.key, self.low, self.high, self.equal, self.parent, self.depth, self.size = [0], [0], [0], [0], [-1], [0], [0]

    def insert(self, ids: list[int], lens: list[int]) -> int:
        """The node of the whole row; new nodes get the turns' lengths."""
        key, low, high, equal = self.key, self.low, self.high, self.equal
        at = 0
        for depth, (wanted, size) in enumerate(zip(ids, lens), 1):
            above, slot, place = at, equal, at
            now = slot[place]
            while now and key[now] != wanted:
                slot, place = (low if wanted < key[now] else high), now
                now = slot[place]
            if not now:
                now = slot[place] = len(key)
                for column, value in ((key, wanted), (low, 0), (high, 0), (equal, 0), (self.parent, above), (self.depth, depth), (self.size, size)):
                    column.append(value)
            at = now
        return at

    def path(self, node: int) -> list[int]:
        """Nodes from the root down to `node`."""
        found = []
        while node >= 0:
            found.append(node)
            node = self.parent[node]
        return found[::-1]


def median_first(n: int):
    """0..n-1, the middle of each range before its halves."""
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        if a < b:
            m = (a + b) // 2
            yield m
            todo += [(m + 1, b), (a, m)]


def conversation_ids(spark: SparkSession, turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                     text_col: str = "text") -> DataFrame:
    """(conv_id, ids, lens): each conversation's dictionary ids in order of turn, null first, and code points.

    Null role or text is empty. Turns with one number are ordered by the digest of role and text. Rows without
    a conv_id are left out. A conversation is one row of 16 bytes a turn; texts never leave the dictionary.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = scratch(spark, turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("len")), "turns")
    # written once, so the numbers stay the same whichever executor reads them
    words = scratch(spark, rows.groupBy("digest").agg(F.first("len").alias("len")).withColumn("id", F.monotonically_increasing_id()), "dictionary")
    cell = F.struct("turn", "digest", "id", "len")
    coded = rows.select("conv_id", "turn", "digest").join(words, "digest")
    return coded.groupBy("conv_id").agg(F.array_sort(F.collect_list(cell)).alias("t")).select(
        "conv_id", F.col("t.id").alias("ids"), F.col("t.len").alias("lens"))


def with_shared_heads(rows: DataFrame, family: int = 100, modulus: int = 6) -> DataFrame:
    """Conversation c gets the first h turns of conversation c - c % family before its own turns after the
    first h, h = unsigned crc32 of c in decimal, modulo `modulus`. An absent head gives no turns."""
    base = F.col("conv_id") - F.col("conv_id") % family
    heads = rows.where(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("base"), F.slice("ids", 1, modulus).alias("head_ids"), F.slice("lens", 1, modulus).alias("head_lens"))
    own = rows.withColumn("base", base).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus).cast("int"))

    def both(head: str, tail: str) -> Column:
        first = F.coalesce(F.slice(head, F.lit(1), F.col("h")), F.array().cast("array<long>"))
        return F.concat(first, F.slice(tail, F.col("h") + 1, F.greatest(F.size(tail), F.lit(1)))).alias(tail)

    return own.join(heads, "base", "left").select("conv_id", both("head_ids", "ids"), both("head_lens", "lens"))


def _joined(convs: list[int]) -> str:
    return ",".join(map(str, convs))


def _shard_tables(shard: int, groups: list[tuple[list[int], list[int], list[int]]]):
    """One shard's tree: finished nodes, its two boundary paths, and the member lists of boundary nodes."""
    tree, ends = TernaryTree(), {}
    for g in median_first(len(groups)):
        ends[tree.insert(groups[g][0], groups[g][1])] = g
    n = len(tree.key)
    members, least, children, leaves, saved = [0] * n, [2**63] * n, [0] * n, [0] * n, [0] * n
    first, last = (tree.path(tree.insert(*groups[g][:2])) for g in (0, -1))
    border = {}
    for chain, path in ((1, last), (0, first)):  # the first path names the nodes on both
        border |= {node: (chain, depth) for depth, node in enumerate(path)}
    for node, g in ends.items():
        members[node], least[node] = len(groups[g][2]), groups[g][2][0]
    for node in range(n - 1, -1, -1):  # children before parents
        if node not in border:
            leaves[node] += not children[node]
            saved[node] += (members[node] - 1) * tree.size[node]
        up = tree.parent[node]
        if up >= 0:
            members[up] += members[node]
            least[up] = min(least[up], least[node])
            if node not in border:  # a boundary node's sums are added when it is merged
                children[up] += 1
                leaves[up] += leaves[node]
                saved[up] += saved[node]
    nodes = []
    for node in range(n):
        if node in border:
            continue
        up = tree.parent[node]
        edge = border.get(up)
        own = groups[ends[node]][2] if node in ends else []
        nodes.append((0, shard, None, tree.depth[node], least[node], None if edge else least[up], *(edge or (None, None)), members[node],
                      children[node], leaves[node], saved[node], hashlib.sha256(_joined(own).encode()).hexdigest()))
    paths = []
    for chain, path in ((0, first), (1, last)):
        mine = [border[node][0] == chain for node in path]  # shared nodes count in the first path
        column = lambda values, other=0: [values[p] if m else other for p, m in zip(path, mine)]
        paths.append((shard, chain, [tree.key[p] for p in path[1:]], [tree.size[p] for p in path], column(least, 2**63 - 1), column(members),
                      column(children), column(leaves), column(saved)))
    pieces = []
    for node, (chain, depth) in border.items():
        own = groups[ends[node]][2] if node in ends else []
        pieces += [(shard, chain, depth, at, _joined(own[at : at + ENDS_PER_ROW])) for at in range(0, len(own), ENDS_PER_ROW)]
    return nodes, paths, pieces


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


def _tables(names: list[str], rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cells = dict(zip(names, zip(*rows)))
    return pa.RecordBatch.from_pydict({f.name: list(cells[f.name]) if f.name in cells else [None] * len(rows) for f in schema}, schema=schema)


def _build(batches):
    """A shard's rows arrive sorted; equal sequences become one entry with their members."""
    from pyspark import TaskContext

    shard, groups = TaskContext.get().partitionId(), []
    for batch in batches:
        for ids, lens, conv in zip(*(batch.column(n).to_pylist() for n in ("ids", "lens", "conv_id"))):
            if groups and groups[-1][0] == ids:
                groups[-1][2].append(conv)
            else:
                groups.append((ids, lens, [conv]))
    if not groups:
        return
    schema = _arrow(_SHARD)
    nodes, paths, pieces = _shard_tables(shard, groups)
    node_names = ["kind", *(c.split()[0] for c in _NODE.split(", "))]
    path_names = ["kind", *(c.split()[0] for c in _PATH.split(", "))]
    for at in range(0, len(nodes), 10_000):
        yield _tables(node_names, nodes[at : at + 10_000], schema)
    yield _tables(path_names, [(1, *p) for p in paths], schema)
    for p in pieces:
        yield _tables(["kind", "shard", "chain", "depth", "piece", "convs"], [(2, *p)], schema)


_MERGED = "number long, parent long, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, shard int, chain int"


def merge_paths(paths):
    """Boundary nodes from the shards' paths in order: (node rows, places of each node in the paths).

    The stack holds the open node of each depth. A path closes the nodes it does not go through; a closed
    node is complete and adds its sums to the one above. Memory is that of one path.
    """
    stack: list[dict] = []
    made = 0

    def close():
        node = stack.pop()
        childless = node["inner"] == 0
        leaves, saved = node["leaves"] + childless, node["saved"] + (node["members"] - 1) * node["len"]
        if stack:
            up = stack[-1]
            up["inner"] += 1
            up["leaves"] += leaves
            up["saved"] += saved
        return {"number": node["number"], "parent": node["parent"], "depth": len(stack), "conv_id": node["least"], "n_convs": node["members"],
                "n_children": node["inner"], "n_leaves": leaves, "saved_tokens": saved}

    for p in paths:
        keys = [None, *p["ids"]]  # the root has no turn
        same = 0
        while same < min(len(stack), len(keys)) and stack[same]["key"] == keys[same]:
            same += 1
        while len(stack) > same:
            yield close()
        for depth, key in enumerate(keys):
            if depth == len(stack):
                stack.append({"key": key, "number": made, "parent": stack[-1]["number"] if stack else None, "len": p["lens"][depth],
                              "least": 2**63 - 1, "members": 0, "inner": 0, "leaves": 0, "saved": 0})
                made += 1
            node = stack[depth]
            node["least"] = min(node["least"], p["least"][depth])
            for name in ("members", "inner", "leaves", "saved"):
                node[name] += p[name][depth]
            yield {"number": node["number"], "depth": depth, "shard": p["shard"], "chain": p["chain"]}
    while stack:
        yield close()


def _merge(batches):
    schema, held = _arrow(_MERGED), []
    for row in merge_paths(r for b in batches for r in b.to_pylist()):
        held.append(row)
        if len(held) == 10_000:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _digests(batches):
    """Rows sorted by (number, shard, piece): the digest of each number's joined pieces, one at a time."""
    schema = pa.schema([("number", pa.int64()), ("ends_sha256", pa.string())])
    number, state = None, None
    for batch in batches:
        for now, convs in zip(batch.column("number").to_pylist(), batch.column("convs").to_pylist()):
            if now == number:
                state.update(b",")
            else:
                if state is not None:
                    yield pa.RecordBatch.from_pydict({"number": [number], "ends_sha256": [state.hexdigest()]}, schema=schema)
                number, state = now, hashlib.sha256()
            state.update(convs.encode())
    if state is not None:
        yield pa.RecordBatch.from_pydict({"number": [number], "ends_sha256": [state.hexdigest()]}, schema=schema)


def prefix_nodes(spark: SparkSession, rows: DataFrame, turns_per_shard: int = TURNS_PER_SHARD) -> DataFrame:
    """Nodes of the trie over rows (conv_id, ids, lens): conv_id (least member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Equal rows are members of one node and lie side by side in the range order, over several shards where they
    are many. A row without ids is a member of the root alone. conv_id must not be null; an empty table has no
    nodes. A shard holds about `turns_per_shard` ids; the one task that merges reads two paths a shard.
    """
    rows = scratch(spark, rows.select("conv_id", "ids", "lens"), "sequences")
    size = rows.agg(F.sum(F.size("ids").cast("long") + 1)).first()[0] or 0
    shards = max(1, -(-size // turns_per_shard))
    order = ["ids", "conv_id"]
    ranged = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    built = scratch(spark, ranged.mapInArrow(_build, _SHARD), "tree")
    paths = built.where("kind = 1").select(*[c.split()[0] for c in _PATH.split(", ")])
    merged = scratch(spark, paths.coalesce(1).sortWithinPartitions("shard", "chain").mapInArrow(_merge, _MERGED), "boundary")
    places = merged.where("shard is not null").select("shard", "chain", "depth", "number")
    border = merged.where("shard is null").select("number", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    few = places.count() <= BROADCAST_ROWS
    bounded = F.broadcast if few else (lambda df: df)
    pieces = built.where("kind = 2").select("shard", "chain", "depth", "piece", "convs").join(bounded(places), ["shard", "chain", "depth"])
    ends = (pieces.repartition("number").sortWithinPartitions("number", "shard", "chain", "piece").select("number", "convs")
            .mapInArrow(_digests, "number long, ends_sha256 string"))
    parents = border.select(F.col("number").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    edge = border.join(parents, "parent", "left").join(ends, "number", "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    tops = places.join(border.select("number", F.col("conv_id").alias("top")), "number").select(
        "shard", F.col("chain").alias("up_chain"), F.col("depth").alias("up_depth"), "top")
    inner = built.where("kind = 0").select("shard", "up_chain", "up_depth", *columns).join(bounded(tops), ["shard", "up_chain", "up_depth"], "left")
    inner = inner.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "top"))
    return edge.select(*columns).union(inner.select(*columns))


def conversation_tree(spark: SparkSession, turns: DataFrame, turns_per_shard: int = TURNS_PER_SHARD) -> DataFrame:
    """The trie of all rebuilt conversations; see conversation_ids for nulls, ties and repeats. Other columns are not read."""
    return prefix_nodes(spark, with_shared_heads(conversation_ids(spark, turns)), turns_per_shard)
