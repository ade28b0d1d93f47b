"""Checks that name what is wrong with rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import text as T
from quarryline.functions.hashing import sha
from quarryline.operators.packing import IGNORED


def _problems(named: dict[str, Column]) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(c, n) for n, c in named.items()])), ",")


def records(rows: DataFrame, min_chars: int, min_words: int) -> DataFrame:
    """doc_id, split, problems of cleaned records with text, digest, split, said_split."""
    text = F.coalesce("text", F.lit(""))
    slim = rows.select(
        "doc_id",
        "split",
        "digest",
        _problems(
            {
                "empty": T.strip(text) == "",
                "too_short": F.length(text) < min_chars,
                "too_few_words": T.word_count(text) < min_words,
                "broken": text.rlike(T.BROKEN),
                "wrong_hash": F.col("digest") != sha(text),
                "wrong_split": F.col("said_split") != F.col("split"),
            }
        ).alias("own"),
    )
    # counted before the shuffle and joined back, so that no window gathers the copies of a text
    copies = slim.groupBy("digest").agg(F.count("*").alias("copies"), F.min("split").alias("low"), F.max("split").alias("high")).where("copies > 1")
    met = slim.join(copies, "digest", "left")
    shared = _problems({"duplicate": F.col("copies") > 1, "split_overlap": F.col("low") != F.col("high")})
    return met.select("doc_id", "split", F.concat_ws(",", F.nullif("own", F.lit("")), F.nullif(shared, F.lit(""))).alias("problems"))


def block_problems(size: int, vocabulary: int) -> Column:
    """What is wrong with a packed block, joined by commas."""
    ids, mask, labels = F.col("input_ids"), F.col("attention_mask"), F.col("labels")
    named = {
        "width": F.size(ids) != size,
        "shape": (F.size(ids) != F.size(mask)) | (F.size(ids) != F.size(labels)),
        "range": (F.array_min(ids) < 0) | (F.array_max(ids) >= vocabulary),
        "mask": F.aggregate(mask, F.lit(0), lambda a, x: a + x) != F.col("real"),
        "labels": F.exists(F.zip_with(F.zip_with(ids, mask, lambda i, m: F.when(m == 0, IGNORED).otherwise(i)), labels, lambda a, b: ~a.eqNullSafe(b)), lambda x: x),
    }
    return _problems(named)


def blocks(rows: DataFrame, size: int, vocabulary: int) -> DataFrame:
    """block_id, problems of packed blocks."""
    return rows.select("block_id", block_problems(size, vocabulary).alias("problems"))


def registry(rows: DataFrame) -> DataFrame:
    """id, problem: rules that entries of a source registry break."""
    known = F.col("dataset").isNotNull()
    approved = F.coalesce("production_approved", F.lit(False))
    named = {
        "no review or terms status": F.col("review_status").isNull() | F.col("terms_status").isNull(),
        "no removal status": F.col("removal_status").isNull(),
        "no approval flag": F.col("production_approved").isNull(),
        "revision not pinned": known & ~F.coalesce(F.col("revision").rlike(r"\A[0-9a-f]{40}\z"), F.lit(False)),
        "no evidence": known & (F.coalesce("evidence", F.lit("")) == ""),
        "approved without dataset": approved & ~known,
        "approved without review": approved & ~F.col("review_status").eqNullSafe("approved"),
        "approved without terms": approved & ~F.col("terms_status").eqNullSafe("approved_for_project"),
        "approved without removal": approved & ~F.col("removal_status").eqNullSafe("ready"),
        "id not unique": F.col("copies") > 1,
    }
    counted = rows.withColumn("copies", F.count("*").over(Window.partitionBy("id")))
    return counted.select("id", F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in named.items()]))).alias("problem"))
