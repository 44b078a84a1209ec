"""Result bundles written as ordinary Spark tables.

Every writer refuses to overwrite and writes from the executors; nothing goes
through the driver but one-row documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, folder: str, partition_by: list[str] | None = None) -> str:
    """Under zstandard, which keeps key columns and repeated numbers smaller than the default codec."""
    df.write.mode("errorifexists").option("compression", "zstd").partitionBy(*(partition_by or [])).parquet(folder)
    return folder


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_copy(df: DataFrame, name: str, arrow_rows: int = 0) -> DataFrame:
    """The rows written to the shared folder and read back: they cost no executor memory and outlive a lost executor.

    With arrow_rows no Python worker is handed more rows at a time while they are made.
    """
    spark = df.sparkSession
    before = spark.conf.get(ARROW_ROWS)
    if arrow_rows and not 0 < int(before) <= arrow_rows:
        spark.conf.set(ARROW_ROWS, arrow_rows)
    try:
        folder = write_table(df, scratch_folder(spark, name))
    finally:
        spark.conf.set(ARROW_ROWS, before)
    return spark.read.schema(df.schema).parquet(folder)


def write_bundle(folder: str, tables: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None) -> str:
    """One parquet folder per table."""
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}", (partition_by or {}).get(name))
    return folder


def read_bundle(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def write_json(df: DataFrame, folder: str) -> str:
    df.write.mode("errorifexists").json(folder)
    return folder


def analysis_export(status: DataFrame, points: DataFrame, tasks: DataFrame) -> DataFrame:
    """One JSON line per metric with its points; a failed analysis is refused.

    `status` has dataset_id, status, metric, available, reason; points of one
    metric of one dataset are its plot and bounded by its grid or sample count.
    """
    refuse = F.raise_error(F.lit("a failed analysis cannot be exported")).cast("string")
    checked = status.withColumn("status", F.when(F.col("status") == "FAIL", refuse).otherwise(F.col("status")))
    rows = points.select("dataset_id", "metric", F.lit("point").alias("kind"), F.to_json(F.struct("series", "x", "y")).alias("document"))
    heads = checked.join(tasks, "dataset_id", "left").select(
        "dataset_id", "metric", F.lit("metric").alias("kind"),
        F.to_json(F.struct("status", "available", "reason", "task")).alias("document"))
    return heads.unionByName(rows)


def write_pairs_csv(pairs: DataFrame, folder: str) -> str:
    pairs.write.mode("errorifexists").option("header", True).csv(folder)
    return folder


def read_pairs_csv(spark: SparkSession, folder: str, schema, partition: str) -> DataFrame:
    """Pairs of one partition; a row of another partition raises."""
    wrong = F.raise_error(F.lit("the pair file holds the wrong partition")).cast("string")
    rows = spark.read.schema(schema).option("header", True).csv(folder)
    return rows.withColumn("split_part", F.when(F.col("split_part") == partition, F.col("split_part")).otherwise(wrong))
