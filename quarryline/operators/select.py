"""Selection under budgets, quotas and targets."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.hashing import sha, stable_key
from quarryline.operators.dedup import keep_first
from quarryline.operators.prefix import by_digest, by_number, running_sum


def byte_cap(rows: DataFrame, order: str, size: str, most_bytes: int, most_rows: int) -> DataFrame:
    """Rows taken in order until the next would exceed the bytes; the first is taken in any case."""
    bucket = by_number(rows, order)
    ranked = running_sum(running_sum(rows, bucket, [order], F.col(size), "before"), bucket, [order], F.lit(1), "place")
    fits = (F.col("place") == 0) | ((F.col("before") + F.col(size) <= most_bytes) & (F.col("before") < most_bytes))
    return ranked.where(fits & (F.col("place") < most_rows))


def corpus_cap(rows: DataFrame, order: str, size: str, most: int) -> DataFrame:
    """Rows taken in order up to the first that would exceed the bytes; nothing after it."""
    return running_sum(rows, by_number(rows, order), [order], F.col(size), "before").where(F.col("before") + F.col(size) <= most)


def quotas(shares: DataFrame, target: int) -> DataFrame:
    """source, quota: whole numbers in proportion to target_share; what is left goes to the largest remainders.

    shares is a registry of sources, small by nature; shares must add up to 1 and none be negative.
    """
    positive = shares.where("target_share > 0")
    exact = F.col("target_share").cast("decimal(20,10)") * F.lit(Decimal(target)).cast("decimal(18,0)")
    floor = F.floor(exact).cast("long")
    rest = F.row_number().over(Window.orderBy(F.desc(exact - floor), "source"))
    left = F.lit(target) - F.sum(floor).over(Window.partitionBy())
    return positive.select("source", (floor + (rest <= left).cast("long")).alias("quota"))


def corpus_records(docs: DataFrame, seed: str) -> DataFrame:
    """source, record_id, text_bytes, text_sha256, selection_key of docs with source, doc_id, text."""
    record = F.col("doc_id").cast("string")
    return docs.select("source", "doc_id", record.alias("record_id"), F.octet_length("text").cast("long").alias("text_bytes"), sha(F.col("text")).alias("text_sha256"), stable_key(seed, "select", F.col("source"), record).alias("selection_key"), stable_key(seed, "output", F.col("source"), record).alias("output_key"))


def distinct_records(records: DataFrame) -> DataFrame:
    """Of records with one text, that with the smallest selection key."""
    return keep_first(records, ["text_sha256"], ["selection_key", "source", "record_id"])


def quota_prefix(records: DataFrame, quota: DataFrame) -> DataFrame:
    """Records of each source in the order of their keys until its quota of bytes is reached; the last may exceed it."""
    before = running_sum(records, by_digest("selection_key"), ["selection_key"], F.col("text_bytes"), "before", by=("source",))
    return before.join(F.broadcast(quota), "source").where("before < quota")  # a row for each source


def digest_of(lines: DataFrame, line: Column, by: list[str], out: str) -> DataFrame:
    """For each group the sha256 of its sorted lines, each with a line end."""
    joined = F.concat(F.array_join(F.sort_array(F.collect_list(line)), "\n"), F.lit("\n"))
    return lines.groupBy(*by).agg(sha(joined).alias(out), F.count("*").alias("n"))


def token_caps(rows: DataFrame, cap: int) -> DataFrame:
    """Tokens taken of each row (split, doc_id, n) under one cap for each split, with the place before it."""
    return running_sum(rows, by_number(rows, "doc_id"), ["doc_id"], F.col("n"), "before", by=("split",)).withColumn("taken", F.least(F.col("n"), F.greatest(F.lit(cap) - F.col("before"), F.lit(0))))


def resumed(rows: DataFrame, key: str, seed: str, start: int = 0) -> DataFrame:
    """rows with their place in a seeded order, from a place on: what a run that had taken `start` rows goes on with."""
    hashed = rows.withColumn("_order", sha(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    return running_sum(hashed, by_digest("_order"), ["_order", key], F.lit(1), "place").where(F.col("place") >= start).drop("_order")


def buffered(rows: DataFrame, key: str, seed: int, buffer: int, start: int = 0) -> DataFrame:
    """rows with their place after a seeded shuffle through a buffer, from a place on.

    The buffer takes the first `buffer` rows in the order of a distinct whole-number key. From then on its slots are visited in rounds,
    each round in an order of its own: a visited slot gives its row away and takes the next one. At the end the
    rounds go on until the buffer is empty. So a row moves by less than 2 * buffer places either way.

    No task has to play that through: a row that comes in at one round leaves at its slot's turn in the next, and orders of slots follow
    from the seed. Windows hold one round, and a run that had taken `start` rows begins one buffer before.
    """
    numbered = running_sum(rows, by_number(rows, key), [key], F.lit(1), "_i")
    n = rows.count()
    near = numbered.where(F.col("_i") >= start - buffer)
    rounds = -(-n // buffer) + 1
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_round").cast("string"), F.col("_slot").cast("string")).cast("binary"))
    turn = (F.row_number().over(Window.partitionBy("_round").orderBy("_mark", "_slot")) - 1).cast("long").alias("_turn")
    first = max(0, start - buffer) // buffer
    slots = rows.sparkSession.range(first, max(first, rounds)).withColumnRenamed("id", "_round").withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(buffer - 1)))).withColumn("_mark", mark).select("_round", "_slot", turn)
    came = near.withColumn("_round", F.floor(F.col("_i") / buffer)).withColumn("_turn", F.col("_i") % buffer).join(slots, ["_round", "_turn"]).drop("_turn")
    left = came.withColumn("_round", F.col("_round") + 1).join(slots, ["_round", "_slot"]).withColumn("_step", F.col("_round") * buffer + F.col("_turn"))
    # steps from n on take no row in, and empty slots give none: what is left then, a buffer at most, follows step by step
    last = left.where(F.col("_step") >= n).withColumn("place", max(0, n - buffer) + F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_step")).cast("long") - 1)
    both = left.where(F.col("_step") < n).withColumn("place", F.col("_step") - buffer).unionByName(last)
    return both.where(F.col("place") >= start).select(*rows.columns, "place")
