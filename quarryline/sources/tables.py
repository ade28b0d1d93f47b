"""Readers of the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt over all cores if their files give fewer partitions than that, as one small file does.

    Larger inputs have partitions enough and are left as they are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, key)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, over all cores even if they lie in one small file."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def short_batches(rows: DataFrame, most: int = 2000) -> DataFrame:
    """rows, whose texts go to Python workers in batches of at most so many rows from now on in this session.

    Texts are long and of any length; smaller batches bound what a task holds on both sides.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(rows.sparkSession.conf.get(key)) > most:
        rows.sparkSession.conf.set(key, str(most))
    return rows
