"""Token-id files: fixed-size id blocks as zstandard-compressed bit or byte planes, with a chunk index.

File format (a folder of Parquet files, one row per block, in ascending document order):

    part, block    the file part, and the block's number in it
    first_id       ids of the part before the block
    n_ids          ids of the block; block_ids in all but the last one of a part
    planes         one zstandard frame per plane; byte plane p holds byte p of each id, least first,
                   bit plane p holds bit p of each id, eight ids to a byte, first id in the lowest bit
    ends           chunk index: the documents that lie in the block, as (doc_no, doc_id, from, n, last)

A block is decoded alone, so readers split anywhere, prune by part and block, and lose nothing with an executor.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tokens import encoder

BLOCK_IDS = 65_536
_ENTRY = "array<struct<doc_no:long,doc_id:long,at:int,n:int,last:boolean>>"
_FILE = f"part int, block int, first_id long, n_ids int, planes array<binary>, ends {_ENTRY}"
_FILE_ARROW = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int32()),
    ("planes", pa.list_(pa.binary())),
    ("ends", pa.list_(pa.struct([("doc_no", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("last", pa.bool_())]))),
])


def to_planes(ids: np.ndarray, bits: bool = False, level: int = 3) -> list[bytes]:
    """Compressed planes of unsigned 32-bit ids."""
    packer = zstandard.ZstdCompressor(level=level)
    as_bytes = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        planes = np.packbits(np.unpackbits(as_bytes, axis=1, bitorder="little"), axis=0, bitorder="little").T
    else:
        planes = as_bytes.T
    return [packer.compress(np.ascontiguousarray(p).tobytes()) for p in planes]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """Inverse of to_planes; 32 planes are bit planes, 4 are byte planes."""
    if not n:
        return np.empty(0, "<u4")
    opener = zstandard.ZstdDecompressor()
    rows = np.stack([np.frombuffer(opener.decompress(p), np.uint8) for p in planes])
    if len(planes) == 32:
        rows = np.packbits(np.unpackbits(rows.T, axis=0, count=n, bitorder="little"), axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view("<u4").ravel()


def encode_planes(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0,
                  bits: bool = False, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The blocks of all documents in ascending order of id_col; write them as Parquet to get the file format.

    One range shuffle of the texts, then each part streams: a task holds one block and one batch of texts.
    Null text counts as empty; null ids come first; rows that repeat an id stay apart, each with a doc_no
    of its own. end_id is appended to each document (None: nothing). Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        from pyspark import TaskContext

        part, block, doc_no, first = TaskContext.get().partitionId(), 0, 0, 0
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        size, held, entries = block_ids * 4, bytearray(), []
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc_id, raw in zip(ids, encoder(tokenizer).ids(batch.column(1).to_pylist())):
                raw, at = raw + end, 0
                while True:
                    take = min(len(raw) - at, size - len(held))
                    done = at + take == len(raw)
                    entries.append({"doc_no": doc_no, "doc_id": doc_id, "at": len(held) // 4, "n": take // 4, "last": done})
                    held += raw[at : at + take]
                    at += take
                    if len(held) == size:
                        yield one(part, block, first, held, entries)
                        block, first, held, entries = block + 1, first + block_ids, bytearray(), []
                    if done:
                        break
                doc_no += 1
        if entries:
            yield one(part, block, first, held, entries)

    def one(part, block, first, held, entries):
        ids = np.frombuffer(bytes(held), "<u4")
        return pa.RecordBatch.from_pylist([{"part": part, "block": block, "first_id": first, "n_ids": len(ids), "planes": to_planes(ids, bits), "ends": entries}], schema=_FILE_ARROW)

    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, _FILE)


def write_planes(blocks: DataFrame, path: str) -> None:
    """The planes are compressed already, so Parquet does not compress them again."""
    blocks.write.option("compression", "uncompressed").parquet(path)


def _crc_matrix_step(rows: list[int]) -> list[int]:
    return [_crc_times(rows, r) for r in rows]


def _crc_times(rows: list[int], vector: int) -> int:
    total, i = 0, 0
    while vector:
        if vector & 1:
            total ^= rows[i]
        vector, i = vector >> 1, i + 1
    return total


def crc32_joined(first: int, second: int, n_second: int) -> int:
    """crc32 of two byte strings from the crc32 of each and the second one's length."""
    shift = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
    for _ in range(3):
        shift = _crc_matrix_step(shift)  # one zero byte
    while n_second:
        if n_second & 1:
            first = _crc_times(shift, first)
        shift, n_second = _crc_matrix_step(shift), n_second >> 1
    return first ^ second


def read_planes(spark: SparkSession, path: str) -> DataFrame:
    """(part, doc_no, doc_id, start, n_tokens, ids_crc32) of each document, from the written planes.

    Blocks are decoded where they are read. Only digests of the document pieces are shuffled; the start of
    a part is the running sum over the parts' lengths, one small row each.
    """
    blocks = spark.read.schema(_FILE).parquet(path)
    piece = pa.schema([("part", pa.int32()), ("doc_no", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("crc", pa.int64())])

    def run(batches):
        for batch in batches:
            out = {k: [] for k in piece.names}
            for row in batch.to_pylist():
                raw = from_planes(row["planes"], row["n_ids"]).tobytes()
                for e in row["ends"]:
                    a = e["at"] * 4
                    for k, v in zip(piece.names, (row["part"], e["doc_no"], e["doc_id"], row["first_id"] + e["at"], e["n"], zlib.crc32(raw[a : a + e["n"] * 4]))):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=piece)

    pieces = blocks.mapInArrow(run, "part int, doc_no long, doc_id long, at long, n long, crc long")

    @F.pandas_udf("long")
    def joined(parts):
        import pandas as pd

        def total(found):
            crc = 0
            for p in found:
                crc = crc32_joined(crc, int(p["crc"]), int(p["n"]) * 4) if crc else int(p["crc"])
            return crc

        return pd.Series([total(sorted(x, key=lambda p: p["at"])) for x in parts], dtype="int64")

    docs = pieces.groupBy("part", "doc_no").agg(
        F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n_tokens"), F.count("*").alias("pieces"),
        F.collect_list(F.struct("at", "n", "crc")).alias("found"))
    docs = docs.withColumn("ids_crc32", F.when(F.col("pieces") == 1, F.col("found")[0]["crc"]).otherwise(joined(F.when(F.col("pieces") > 1, F.col("found")).otherwise(F.array()))))
    lengths = blocks.groupBy("part").agg(F.sum(F.col("n_ids").cast("long")).alias("n"))
    starts = lengths.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return docs.join(starts, "part").select("part", "doc_no", "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
