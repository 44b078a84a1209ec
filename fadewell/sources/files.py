"""File listings, manifests and folder loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import natural_key
from ..operators.ordering import bounded_join, text_positions

D = "dataset_id"
FILES_PER_DIGEST = 10_000


def binary_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Path, size and content hash of every file below a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return raw.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def profile_folder(spark: SparkSession, folder: str, values: str = "dbm") -> DataFrame:
    """One parquet file per snapshot: snapshot order by natural file name."""
    raw = spark.read.parquet(folder).select(values, F.col("_metadata.file_name").alias("name"))
    return ordered_profiles(raw.withColumn(D, F.lit(folder)), "name", values)


def ordered_profiles(files: DataFrame, name: str, values: str) -> DataFrame:
    """Snapshot position by natural name and the number of different vector lengths."""
    sizes = files.groupBy(D).agg(F.countDistinct(F.size(values)).alias("lengths"))
    names = files.select(D, name, natural_key(name).alias("_key"))
    ranks = text_positions(names, [D], "_key", [name], "snapshot").drop("_key")
    return bounded_join(bounded_join(files, ranks, [D, name]), sizes, [D])


def inventory_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("archive", "extension").agg(F.count(F.lit(1)).alias("file_count"),
                                                     F.sum("size_bytes").alias("total_bytes"))


def inventory_samples(files: DataFrame, k: int = 40) -> DataFrame:
    """First k paths per archive; the rank limit is applied before the shuffle."""
    w = Window.partitionBy("archive").orderBy("path", "file_id")
    return files.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def manifest_digest(entries: DataFrame, files_per_digest: int = FILES_PER_DIGEST) -> DataFrame:
    """File count, total bytes and one digest of the sorted manifest lines.

    At every size the digest is the hash of the hashes of the lines' blocks,
    so no task holds all lines.
    """
    line = F.concat_ws("  ", "sha256", F.col("size_bytes").cast("string"), "path")
    ranked = text_positions(entries, [D], "path", ["sha256"], "_pos")
    cell = F.struct("_pos", line.alias("line"))
    blocks = ranked.groupBy(D, F.floor((F.col("_pos") - 1) / files_per_digest).alias("block")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(cell))["line"], "\n"), 256).alias("digest"),
        F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("b"))
    ordered = F.array_sort(F.collect_list(F.struct("block", "digest")))["digest"]
    return blocks.groupBy(D).agg(
        F.sum("n").alias("file_count"), F.sum("b").alias("total_bytes"),
        F.sha2(F.array_join(ordered, "\n"), 256).alias("aggregate_sha256"))
