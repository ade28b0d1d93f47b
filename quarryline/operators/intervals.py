"""Joins of points with the intervals that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.operators.prefix import by_number, running_sum
from quarryline.operators.selection import sendable
from quarryline.sources.scratch import materialize


def consecutive(sizes: DataFrame, key: str, size: str) -> DataFrame:
    """sizes with start, stop: intervals one after the other in the order of a whole-number key, from 0."""
    rows = sizes.withColumn(size, F.col(size).cast("long"))
    return running_sum(rows, by_number(rows, key), [key], F.col(size), "start").withColumn("stop", F.col("start") + F.col(size))


def holding(points: DataFrame, at: str, intervals: DataFrame) -> DataFrame:
    """points with the columns of the interval, start <= at < stop, that holds them; points outside all aren't returned.

    An interval of a length up to 2 ** k lies in bins of that width, in two at most. Of disjoint intervals a bin then holds three at most,
    whatever their lengths, so no bin is hot; a point looks into one bin for each k that occurs. Intervals that overlap are all met.
    Few intervals are sent to all tasks; more are written first, so that Spark may split a bin that many points meet.
    Empty intervals hold nothing, and a null point is in none.
    """
    wide = intervals.where("start < stop").withColumn("_k", F.when(F.expr("stop - start = 1"), 0).otherwise(F.length(F.bin(F.expr("stop - start - 1")))).cast("int"))
    binned = materialize(wide.withColumn("_bin", F.explode(F.expr("sequence(shiftright(start, _k), shiftright(stop - 1, _k))"))), "intervals")
    widths = sorted(r["_k"] for r in binned.select("_k").distinct().collect())  # 64 rows at most
    if not widths:
        return points.where("false").join(binned.limit(0).drop("_k", "_bin"), F.lit(False))
    looked = points.withColumn("_k", F.explode(F.array(*map(F.lit, widths)))).withColumn("_bin", F.expr(f"shiftright(`{at}`, _k)"))
    return looked.join(sendable(binned), ["_k", "_bin"]).where(f"start <= `{at}` and `{at}` < stop").drop("_k", "_bin")
