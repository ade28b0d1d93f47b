"""Exact and near duplicates dropped from a stream, as if its documents had come one after the other.

What is kept is the state: a table of fingerprints and SimHash values with a part for each batch, which a batch that runs again replaces. A
batch is settled in two steps: documents that an earlier batch's kept ones match go first, for they never
count for anything; among the others the first one wins, in the order of doc_id, by the rounds that a table is settled by. So the
result is that of one table in the order of batches, however the files are dealt out to batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import dedup, filters
from quarryline.operators.selection import sendable
from quarryline.sources.scratch import materialize, passing
from quarryline.streaming.control import Commits, drive
from quarryline.streaming.incremental import SCHEMA, same_rules

STATE = "fingerprint string, simhash long"


def settled(marks: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, fingerprint, simhash, label (kept, exact_duplicate, near_duplicate) of marks (doc_id, fingerprint, simhash) after known ones.

    known: fingerprint and simhash of what earlier batches kept. An empty table gives no rows.
    """
    # what a batch meets is few; the fingerprints are asked for, so that the known table isn't shuffled
    again = known.join(sendable(marks.select("fingerprint").distinct()), "fingerprint", "left_semi").select("fingerprint").distinct()
    said = marks.join(again.withColumn("_again", F.lit(True)), "fingerprint", "left")
    said = said.join(dedup.near_known(marks, known).withColumn("_near", F.lit(True)), "simhash", "left")
    early = F.when(F.col("_again"), "exact_duplicate").when(F.col("_near"), "near_duplicate")
    judged = materialize(said.select("doc_id", "fingerprint", "simhash", early.alias("label")), "judged")
    rest = dedup.survivors(judged.where("label is null").drop("label"))
    return judged.alias("j").join(rest.alias("r"), "doc_id", "left").select("doc_id", "fingerprint", "simhash", F.coalesce("j.label", "r.label").alias("label"))


def run(spark: SparkSession, folder: str, out: str, checkpoint: str, files_per_batch: int = 8, stop_after: int | None = None, progress: str | None = None, every: int | None = None):
    """Labels the documents of new files: out/labels has doc_id and label, out/state what is kept, by batch. doc_id must be distinct. Returns the query."""
    same_rules(spark, checkpoint, filters.StreamRules())
    commits = Commits(spark, out)

    def add(batch: DataFrame, number: int) -> None:
        with passing(spark):
            marks = materialize(batch.select("doc_id", *dedup.marks_of(F.col("text"))), "marks")
            # parts of this batch, or of later ones, come from runs that didn't commit it
            known = spark.read.schema(f"{STATE}, batch long").parquet(f"{out}/state").where(F.col("batch") < number) if commits.numbers() else spark.createDataFrame([], STATE)
            labels = materialize(settled(marks, known.select("fingerprint", "simhash")), "labels")
            labels.select("doc_id", "label").write.mode("overwrite").parquet(f"{out}/labels/batch={number}")
            labels.where("label = 'kept'").select("fingerprint", "simhash").write.mode("overwrite").parquet(f"{out}/state/batch={number}")
            counts = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}  # three rows
        commits.write(number, {"documents": counts})

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return drive(spark, stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint), stop_after, progress, every)[0]
