"""Splits of a corpus by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions import text as T
from quarryline.operators.prefix import by_digest, running_sum


def shares(n: int, validation: float, test: float) -> tuple[int, int]:
    """Numbers of validation and test units, so that at least one is left for training if that can be."""
    if not 0 < validation < 1 or not 0 <= test < 1 or validation + test >= 1:
        raise ValueError("shares must lie between 0 and 1 and leave some for training")
    v, t = max(1, round(n * validation)), max(1, round(n * test)) if test > 0 else 0
    while n - v - t < 1:
        if t > 1:
            t -= 1
        elif v > 1:
            v -= 1
        else:
            return v, 0
    return v, t


def split_units(rows: DataFrame, key: str, validation: float, test: float) -> DataFrame:
    """Adds split to rows in the order of a hash: first test, then validation, then training."""
    v, t = shares(rows.count(), validation, test)
    placed = running_sum(rows, by_digest(key), [key], F.lit(1), "place")
    return placed.withColumn("split", F.when(F.col("place") < t, "test").when(F.col("place") < t + v, "validation").otherwise("train"))


def checked_ratios(train: float, validation: float, test: float) -> tuple[float, float, float]:
    """The ratios, if all are positive and they add up to 1."""
    if min(train, validation, test) <= 0 or abs(train + validation + test - 1) > 1e-6:
        raise ValueError("ratios must be positive and add up to 1")
    return train, validation, test


def without_duplicates(rows: DataFrame, digest: str) -> DataFrame:
    """rows as they are; reading them fails if a digest comes twice."""
    repeated = rows.groupBy(digest).count().where("count > 1").select(F.col(digest).alias("_digest"))
    fails = F.raise_error(F.concat(F.lit("duplicate hash "), F.col("_digest").cast("string"))).cast("boolean")
    return rows.join(repeated, F.col(digest) == F.col("_digest"), "left").where(F.col("_digest").isNull() | fails).drop("_digest")


def character_split(text: Column, validation: float, test: float) -> dict[str, Column]:
    """train, validation and test parts of one text by characters; test is null if it is blank."""
    n = F.length(text)
    t, v = F.floor(n * F.lit(test)).cast("int"), F.greatest(F.lit(1), F.floor(n * F.lit(validation)).cast("int"))
    r = F.greatest(F.lit(1), n - v - t)
    rest = F.substring(text, r + v + 1, F.greatest(n, F.lit(1)))
    return {"train": F.substring(text, F.lit(1), r), "validation": F.substring(text, r + 1, v), "test": F.when(T.strip(rest) != "", rest)}
