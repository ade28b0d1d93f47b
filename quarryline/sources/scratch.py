"""Intermediate tables in the folder that driver and executors share.

Iterative operators and operators that read an expensive intermediate result more than once
write it as Parquet below ``spark.checkpoint.dir`` and go on from the written table. That cuts
the lineage and survives the loss of executors. Tables that only a step needs are written inside
``passing`` and deleted when the step is done.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local_root: dict[str, str] = {}
#: For each open ``passing``, from the outermost on, the paths that it deletes.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


def shared_root(spark: SparkSession) -> str:
    """The shared scratch folder: spark.checkpoint.dir, or a fresh temporary one in local mode only."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _local_root[app] = "file://" + tempfile.mkdtemp(prefix="quarryline-")
    return _local_root[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_root(spark)}/quarryline/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, lasting: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and return the table read back.

    Inside ``passing`` the table goes when that ends; a lasting one goes with the next outer one, if any.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    blocks = _open.get()[: -1 if lasting else None]
    if blocks:
        blocks[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the scratch tables written inside that aren't lasting. No plan may read them later."""
    mine: list[str] = []
    token = _open.set((*_open.get(), mine))
    try:
        yield
    finally:
        _open.reset(token)
        for path in mine:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that no later plan reads."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
