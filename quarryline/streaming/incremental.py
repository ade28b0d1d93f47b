"""The main pipeline over files as they arrive.

Structured Streaming keeps what has been read and which fingerprints have been seen in the
checkpoint, so a run that is stopped goes on where it was. The rules' hash lies beside the checkpoint;
a run with other rules is refused.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import hashing as H
from quarryline.functions import text as T
from quarryline.operators import filters
from quarryline.operators.prefix import by_digest, running_sum
from quarryline.sources.scratch import materialize, passing
from quarryline.streaming.control import Commits, Full, drive

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def accepted(docs: DataFrame, rules: filters.StreamRules) -> DataFrame:
    """doc_id, text, fp, split of documents that pass, cleaned; works on tables and streams."""
    cleaned = docs.select("doc_id", T.clean_text(F.col("text")).alias("text"))
    good = cleaned.where(filters.quality_rejection(F.col("text"), rules).isNull()).withColumn("fp", H.fingerprint(F.col("text")))
    return good.withColumn("split", H.split_by_bucket(F.col("fp"), 800, 100, 1000))


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def same_rules(spark: SparkSession, checkpoint: str, rules: filters.StreamRules) -> None:
    """Writes the rules' hash beside a new checkpoint; refuses another one's."""
    digest = hashlib.sha256(json.dumps(asdict(rules), sort_keys=True).encode()).hexdigest()
    at, system = _hadoop(spark, f"{checkpoint}/rules.sha256")
    if system.exists(at):
        stream = system.open(at)
        known = bytes(stream.readAllBytes()).decode("ascii")
        stream.close()
        if known != digest:
            raise ValueError("the checkpoint was made with other rules")
        return
    out = system.create(at)
    out.write(bytearray(digest, "ascii"))
    out.close()


def run(spark: SparkSession, folder: str, out: str, checkpoint: str, rules: filters.StreamRules = filters.StreamRules(), files_per_batch: int = 8, once: bool = True, stop_after: int | None = None, progress: str | None = None, every: int | None = None):
    """Reads new Parquet files of a folder, drops what has been seen, and appends the rest by split.

    With stop_after the run ends in order after the batch in which it has read so many documents; the next
    run goes on behind it. What has been read is reported at `progress`, each `every` documents and at the end.
    """
    same_rules(spark, checkpoint, rules)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    writer = accepted(stream, rules).dropDuplicates(["fp"]).writeStream.format("parquet").partitionBy("split").option("path", out).option("checkpointLocation", checkpoint)
    return drive(spark, writer, stop_after, progress, every, once)[0]


def run_to_targets(spark: SparkSession, folder: str, out: str, checkpoint: str, targets: dict[str, int], rules: filters.StreamRules = filters.StreamRules(), files_per_batch: int = 8, must_reach: bool = False, progress: str | None = None):
    """The same with a target of words for each split: documents are taken in the order of their
    fingerprints within a batch until the target is reached, the last one cut; the rest is skipped.

    What earlier batches took is in the record that the last one committed, and a batch that runs again replaces its own
    folder, so nothing counts twice. Once all targets are met no file is read any more: the next batch ends
    the run uncommitted, so a later run with higher targets begins with it. With must_reach it is an error if the files end before the targets.
    """
    same_rules(spark, checkpoint, rules)
    commits = Commits(spark, out)

    def add(batch: DataFrame, number: int) -> None:
        had = (commits.read(number - 1) or {}).get("taken", {}) if number else {}
        left = {s: t - had.get(s, 0) for s, t in targets.items()}
        if max(left.values(), default=0) <= 0:
            raise Full
        with passing(spark):
            rows = materialize(batch.select("doc_id", "fp", "split", T.word_count(F.col("text")).alias("n")), "batch")
            wanted = spark.createDataFrame(list(left.items()), "split string, left long")
            placed = running_sum(rows, by_digest("fp"), ["fp"], F.col("n"), "before", by=("split",)).join(F.broadcast(wanted), "split")  # a row for each split
            taken = placed.withColumn("taken", F.least("n", F.greatest(F.col("left") - F.col("before"), F.lit(0)))).where("taken > 0")
            taken.select("doc_id", "fp", "taken", "split").write.mode("overwrite").parquet(f"{out}/batch={number}")
        now = spark.read.schema("taken long, split string").parquet(f"{out}/batch={number}").groupBy("split").agg(F.sum("taken").alias("n"))
        new = {r["split"]: r["n"] for r in now.collect()}  # a row for each split
        commits.write(number, {"taken": {s: had.get(s, 0) + new.get(s, 0) for s in {*had, *targets}}})

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    query, _ = drive(spark, accepted(stream, rules).dropDuplicates(["fp"]).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint), progress=progress)
    if must_reach:
        had = (commits.last() or {}).get("taken", {})
        if short := {s: (had.get(s, 0), t) for s, t in targets.items() if had.get(s, 0) < t}:
            raise RuntimeError(f"the files ended before the targets: {short}")
    return query
