"""Best-fit packing of documents into sequences: hierarchical residual packing.

Level 0 packs the pieces of each partition by best fit, largest first. Full sequences are done. The
underfull ones of `fan_in` neighbours then meet in one task of the next level as items of their own, and so
on up the tree. Two sequences of at most half the capacity would have been joined, so a task has at most one
of those left; a larger one can only take in such small ones. A task of the next level meets at most `fan_in`
small ones, so each level above uses up at most `fan_in` sequences of one fill, and it is enough to hand up
`fan_in` per fill for each level still to come. That bounds what goes up without losing a possible fit.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import keep_only, scratch
from .tokens import encoder

FAN_IN = 8
ITEMS_PER_TASK = 100_000
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"
_PIECE_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("row", pa.int64())])
_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, sequence_id long, offset long, fill long, task long, open boolean"


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = 1024,
                 keep_words: bool = True) -> DataFrame:
    """Pieces of at most `capacity` ids of each whole document with its end id; a longer document's first
    piece is the shorter one. Null text is empty. `row` tells rows that repeat an id apart.

    Without keep_words a worker forgets its words after a task: where more workers than cores take turns, those
    that wait hold none, and each task learns its words anew."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out = {k: [] for k in _PIECE_ARROW.names}
            for doc_id, raw in zip(batch.column(0).to_pylist(), encoder(tokenizer).ids(batch.column(1).to_pylist())):
                raw += end
                n = len(raw) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    for name, v in zip(_PIECE_ARROW.names, (doc_id, k, a, b - a, zlib.crc32(raw[a * 4 : b * 4]), row)):
                        out[name].append(v)
                row += 1
            yield pa.RecordBatch.from_pydict(out, schema=_PIECE_ARROW)
        if not keep_words:
            encoder(tokenizer).forget()

    return rows.mapInArrow(run, _PIECE)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item by best fit, largest first; ties in given order."""
    place, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set while a bin with r free places exists
    made = 0
    for i, size in zip(np.argsort(-sizes, kind="stable").tolist(), np.sort(sizes)[::-1].tolist()):
        fits = rooms >> size
        if fits:
            room = size + ((fits & -fits).bit_length() - 1)
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room, made = made, capacity, made + 1
        place[i], offset[i], left = b, capacity - room, room - size
        if not by_room[left]:
            rooms |= 1 << left
        by_room[left].append(b)
    return place, offset


def _pack_group(rows: pa.Table, level: int, task: int, capacity: int, full: int, handed_up: int) -> pa.Table:
    """One task of a level: pieces with their current sequence and place in, packed again out."""
    length, offset = rows["length"].to_numpy(), rows["offset"].to_numpy()
    _, at = np.unique(rows["sequence_id"].to_numpy(), return_inverse=True)
    sizes = np.bincount(at, length).astype(np.int64)
    place, shift = best_fit(sizes, capacity)
    fills = np.bincount(place, sizes).astype(np.int64)
    mine = place[at]
    # the levels above bring at most handed_up small ones, so no more sequences of a fill can meet one
    order = np.argsort(fills, kind="stable")
    rank = np.empty(len(fills), np.int64)
    rank[order] = np.arange(len(fills)) - np.searchsorted(fills[order], fills[order], "left")
    goes_up = (fills < full) & (rank < handed_up)
    out = {name: rows[name] for name in _PIECE_ARROW.names}
    out |= {"sequence_id": (level << 56) + (task << 32) + mine, "offset": offset + shift[at], "fill": fills[mine],
            "task": np.full(len(at), task, np.int64), "open": goes_up[mine]}
    return pa.table(out)


def _packer(level: int, capacity: int, full: int, handed_up: int):
    def group(key, rows):
        keep_only()
        return _pack_group(rows, level, key[0].as_py(), capacity, full, handed_up)

    return group


def levels_above(tasks: int, fan_in: int) -> int:
    """Levels that follow one of so many tasks until a single task is left."""
    levels = 0
    while tasks > 1:
        tasks, levels = -(-tasks // fan_in), levels + 1
    return levels


def pack(spark: SparkSession, pieces: DataFrame, capacity: int = 1024, nearly_full: float = 1.0, fan_in: int = FAN_IN, items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """Pieces (token_pieces' columns) with sequence_id and offset; each piece once, offsets gapless from 0.

    Only lengths and keys are shuffled, dealt evenly by a hash of the whole row, so a hot document or source
    spreads. The number of tasks follows the number of pieces; an empty table gives an empty result. Sequences
    filled to less than `nearly_full` may take in more; below 1 the last places of some stay free.
    """
    full = int(np.ceil(capacity * nearly_full))
    # of two equal rows the place in the file decides, so ids are unique
    n = pieces.count()
    tasks = max(1, -(-n // items_per_task))
    now = (pieces.withColumn("task", F.pmod(F.xxhash64("row", "piece"), F.lit(tasks)))
           .withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")))
    results, level = [], 0
    while True:
        packed = scratch(spark, now.groupBy("task").applyInArrow(_packer(level, capacity, full, fan_in * levels_above(tasks, fan_in)), _PACKED), "packed")
        if tasks == 1:
            results.append(packed)
            break
        results.append(packed.where("not open"))
        tasks, level = -(-tasks // fan_in), level + 1
        now = packed.where("open").withColumn("task", F.expr(f"task div {fan_in}"))
    out = results[0]
    for r in results[1:]:
        out = out.union(r)
    return out.drop("task", "open")


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Tokenize, cut and pack: (doc_id, piece, start, length, ids_crc32, row, sequence_id, offset, fill)."""
    return pack(spark, scratch(spark, token_pieces(docs, tokenizer, **options), "pieces"), options.get("capacity", 1024))
