"""Token streams cut into blocks and shards.

Tokens of a document stand in one array with the place of its first token in the stream. A document
meets only the blocks that it reaches into, so a block is put together from its documents' slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import words
from quarryline.operators.prefix import by_number, running_sum

EOS, BOS, PAD = 2, 1, 0
IGNORED = -100
VOCABULARY = 30_003


def word_ids(text: Column) -> Column:
    """A stand-in for a trained tokenizer that SQL can express: an id for each word, from its hash."""
    return F.transform(words(text), lambda w: (F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("int") % (VOCABULARY - 3) + 3))


def stream(docs: DataFrame) -> DataFrame:
    """doc_id, ids with an end mark, n, start: documents in order of doc_id as one token stream."""
    rows = docs.select("doc_id", F.concat(word_ids(F.col("text")), F.array(F.lit(EOS))).alias("ids")).withColumn("n", F.size("ids").cast("long"))
    # the places are found from narrow rows; arrays are joined to them once
    places = running_sum(rows.select("doc_id", "n"), by_number(docs, "doc_id"), ["doc_id"], F.col("n"), "start")
    return rows.join(places.select("doc_id", "start"), "doc_id")


def cut(rows: DataFrame, size: int, name: str = "block_id") -> DataFrame:
    """A row for each document and block it reaches into: name, doc_id, at (in the block), part."""
    first, last = (F.floor(x / size).cast("long") for x in (F.col("start"), F.col("start") + F.col("n") - 1))
    spread = rows.where("n > 0").withColumn(name, F.explode(F.sequence(first, last)))
    low = F.greatest(F.col(name) * size, F.col("start"))
    high = F.least((F.col(name) + 1) * size, F.col("start") + F.col("n"))
    part = F.slice("ids", (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
    return spread.select(name, "doc_id", (low - F.col(name) * size).alias("at"), part.alias("part"))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """block_id, real, input_ids, attention_mask, labels: blocks of `size` tokens, the last one padded."""
    made = cut(rows, size).groupBy("block_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda x: x["part"])).alias("ids"))
    return padded(made, size)


def padded(made: DataFrame, size: int) -> DataFrame:
    real = F.size("ids")
    pad = lambda x: F.array_repeat(F.lit(x), F.lit(size) - real)
    keep = [F.col(c) for c in made.columns if c != "ids"]
    filled = made.select(*keep, real.cast("long").alias("real"), F.concat("ids", pad(PAD)).alias("input_ids"), F.concat(F.array_repeat(F.lit(1), real), pad(0)).alias("attention_mask"))
    return filled.withColumn("labels", F.zip_with("input_ids", "attention_mask", lambda i, m: F.when(m == 0, F.lit(IGNORED)).otherwise(i)))


def with_labels(rows: DataFrame) -> DataFrame:
    """Blocks without labels get them: the ids, and IGNORED for the padding."""
    return rows.withColumn("labels", F.transform("input_ids", lambda i: F.when(i == PAD, F.lit(IGNORED)).otherwise(i)))


def document_blocks(docs: DataFrame, size: int) -> DataFrame:
    """Blocks of each document by itself, between its own marks; blocks of one token are dropped."""
    ids = F.concat(F.array(F.lit(BOS)), word_ids(F.col("text")), F.array(F.lit(EOS)))
    rows = docs.select("doc_id", ids.alias("all"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / size).cast("int")), lambda k: F.slice("all", k * size + 1, F.lit(size)))
    return padded(rows.select("doc_id", F.posexplode(parts).alias("part", "ids")).where(F.size("ids") >= 2), size)


def printed(ids: str) -> Column:
    return F.sha2(F.array_join(ids, " "), 256)
