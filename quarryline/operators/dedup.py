"""Exact and near-duplicate removal in an order."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.hashing import fingerprint, hamming, simhash
from quarryline.functions.text import words
from quarryline.operators.selection import sendable
from quarryline.sources.scratch import materialize

#: A 64-bit value is cut into six parts; values at a distance of at most 3 agree in at least three of them.
PARTS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
DISTANCE = 3
ROUNDS = 200


def keep_first(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def marks_of(text: Column) -> tuple[Column, Column]:
    """fingerprint and simhash of a text, both from its own row."""
    return fingerprint(text).alias("fingerprint"), simhash(words(text)).alias("simhash")


def near_known(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The distinct simhash values of rows that lie within DISTANCE of a known one, themselves included.

    The rows' values, with a key for each choice of three parts, are sent to all tasks if they are few, so that a large table of known ones isn't shuffled.
    """
    asked = rows.select("simhash").distinct().select("simhash", F.explode(_keys(F.col("simhash"))).alias("key"))
    there = known.select(F.col("simhash").alias("other"), F.explode(_keys(F.col("simhash"))).alias("key"))
    return there.join(sendable(asked), "key").where(hamming(F.col("simhash"), F.col("other")) <= DISTANCE).select("simhash").distinct()


def _keys(value: Column) -> Column:
    part = [F.shiftrightunsigned(value, at).bitwiseAND((1 << width) - 1) for at, width in PARTS]
    return F.array(*[F.xxhash64(F.lit(n), *[part[k] for k in chosen]) for n, chosen in enumerate(combinations(range(6), 3))])


def simhash_pairs(marks: DataFrame) -> DataFrame:
    """src, dst, distance of distinct values at a Hamming distance of 1 to 3, each named by its smallest doc_id.

    marks: doc_id, simhash. Three equal parts of six are about 32 bits, so buckets stay small where
    16-bit bands would not, and no pair is lost.
    """
    values = marks.groupBy("simhash").agg(F.min("doc_id").alias("doc_id"))
    keyed = values.select("doc_id", "simhash", F.explode(_keys(F.col("simhash"))).alias("key"))
    a, b = (keyed.select("key", F.col("doc_id").alias(i), F.col("simhash").alias(h)) for i, h in (("src", "x"), ("dst", "y")))
    distance = hamming(F.col("x"), F.col("y"))
    return a.join(b, "key").where((F.col("src") < F.col("dst")) & (distance <= DISTANCE)).select("src", "dst", distance.cast("long").alias("distance")).distinct()


def simhash_members(docs: DataFrame) -> DataFrame:
    """doc_id, representative: the doc_id that names the document's SimHash in simhash_pairs.

    docs: doc_id, fingerprint, simhash. With the pairs it gives every text within DISTANCE of another, those
    of one SimHash (distance 0) too: they have one representative.
    """
    first = docs.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.min("simhash").alias("simhash"))
    value = first.groupBy("simhash").agg(F.min("first").alias("representative"))
    return docs.select("doc_id", "fingerprint").join(first.join(value, "simhash").select("fingerprint", "representative"), "fingerprint").select("doc_id", "representative")


def greedy(pairs: DataFrame) -> DataFrame:
    """doc_id, kept: going through the nodes in order, one goes if an earlier kept one is its neighbour.

    pairs: src < dst. A node is settled once an earlier neighbour is kept, or all of them are gone; rounds
    repeat that for all nodes at once until none is open.
    """
    pairs = materialize(pairs.select("src", "dst"), "pairs")
    nodes = pairs.select(F.col("src").alias("doc_id")).union(pairs.select("dst")).distinct()
    state = materialize(nodes.withColumn("kept", F.lit(None).cast("boolean")), "state")
    for _ in range(ROUNDS):
        if state.where("kept is null").isEmpty():
            return state
        open_ones = state.where("kept is null").select(F.col("doc_id").alias("dst"))
        earlier = pairs.join(open_ones, "dst").join(state.select(F.col("doc_id").alias("src"), "kept"), "src")
        seen = earlier.groupBy("dst").agg(F.coalesce(F.bool_or("kept"), F.lit(False)).alias("near"), F.bool_or(F.col("kept").isNull()).alias("waits"))
        now = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("near"), F.lit(False)).when(F.coalesce("waits", F.lit(False)), F.lit(None)).otherwise(F.lit(True))
        state = materialize(state.join(seen.withColumnRenamed("dst", "doc_id"), "doc_id", "left").select("doc_id", now.cast("boolean").alias("kept")), "state")
    raise RuntimeError(f"not settled in {ROUNDS} rounds")


def survivors(docs: DataFrame) -> DataFrame:
    """doc_id, label (kept, exact_duplicate, near_duplicate). docs: doc_id, fingerprint, simhash.

    A later copy is an exact duplicate only if its first copy was kept, for only then was it recorded.
    """
    first = docs.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.min("simhash").alias("simhash"))
    value = first.groupBy("simhash").agg(F.min("first").alias("node"))
    state = greedy(simhash_pairs(first.select(F.col("first").alias("doc_id"), "simhash")))
    nodes = value.join(state.withColumnRenamed("doc_id", "node"), "node", "left").select("simhash", "node", F.coalesce("kept", F.lit(True)).alias("kept"))
    named = first.join(nodes, "simhash").select("fingerprint", "first", (F.col("kept") & (F.col("node") == F.col("first"))).alias("kept"))
    label = F.when(~F.col("kept"), "near_duplicate").when(F.col("doc_id") == F.col("first"), "kept").otherwise("exact_duplicate")
    return docs.join(named, "fingerprint").select("doc_id", label.alias("label"))
