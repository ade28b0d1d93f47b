"""Values at given ranks of each group, exactly, without sorting a group.

A group of more than FEW rows is refined in rounds. A sketch of bounded size gives borders between about
equally many rows; each row falls on a border or between two; rows are counted by that; and only rows in cells that
hold a wanted rank go on. So a round leaves about one in BORDERS of a group's rows for each rank, and counts are combined before the
shuffle, however many rows one group has. A cell of one value needs no more refining, whatever its size;
any other ends when it has FEW rows or less, which are then numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import let
from quarryline.sources.scratch import materialize

#: Rows of a cell that may be numbered in one task.
FEW = 1 << 16
#: Borders of a round.
BORDERS = 128
#: Rows of a table that is sent to all tasks at most; larger ones are shuffled.
SENT = 100_000
ROUNDS = 7


def sendable(rows: DataFrame) -> DataFrame:
    """rows with a hint: to be sent to all tasks if they are few, else to be merged in."""
    return F.broadcast(rows) if rows.limit(SENT + 1).count() <= SENT else rows.hint("merge")


def same_cell(a: str, b: str) -> Column:
    return F.expr(f"{a}._by <=> {b}._by and {a}._cell = {b}._cell")


def _place(value: Column, borders: Column) -> Column:
    """2 * k on the border number k (from 1), 2 * k + 1 between it and the next."""
    # a search by halves, for this is done for every row; past the last border get gives null
    step = lambda at, by: F.when(F.get(borders, at + by - 1) <= value, at + by).otherwise(at)
    reached = F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(BORDERS.bit_length()))]), F.lit(0), step)
    return let(reached, lambda r: _beside(r, value, borders))


def _beside(reached: Column, value: Column, borders: Column) -> Column:
    on = (reached > 0) & (F.element_at(borders, F.greatest(reached, F.lit(1))) == value)
    return (2 * reached + F.when(on, 0).otherwise(1)).cast("long")


def _borders(rows: DataFrame, kind: str) -> DataFrame:
    """_by, _cell, _borders (distinct, ascending) from a sketch of each cell's values."""
    # the sketch computes with doubles, so whole and decimal numbers count from the cell's smallest, which brings near ones apart
    far = kind == "bigint" or kind.startswith("decimal")
    number = lambda c: F.col(c).cast("decimal(20,0)") if kind == "bigint" else F.col(c)
    fractions = F.array(*[F.lit((k + 0.5) / BORDERS) for k in range(BORDERS)])
    sketch = F.percentile_approx((number("_value") - number("_low")) if far else F.col("_value"), fractions, F.lit(8 * BORDERS))
    made = rows.groupBy("_by", "_cell").agg(sketch.alias("_sketch"), F.min("_low").alias("_low"))
    return made.select("_by", "_cell", F.array_sort(F.array_distinct(F.transform("_sketch", lambda x: (number("_low") + x).cast(kind)) if far else F.col("_sketch"))).alias("_borders"))


def _within(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """_by, _cell, _name, _index in their new cells, of which counts has _by, _cell, _place, _n: a bounded number for each old one."""
    before = Window.partitionBy("_by", "_cell").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    met = wanted.alias("w").join(cells.alias("c"), F.expr("w._by <=> c._by and w._cell = c._cell and c._before <= w._index and w._index < c._before + c._n"))
    return met.selectExpr("w._by", f"w._cell * {2 * BORDERS + 2} + c._place as _cell", "w._name", "w._index - c._before as _index")


def at_ranks(rows: DataFrame, by: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """by and a column for each name: the value at an index, from 0, in the order of the group's values.

    ranks: indices as expressions of `total`, the number of the group's values. Null values don't count,
    a null group is a group, and not-a-number is the largest value. An index outside gives null; an empty table gives no rows.
    """
    live = rows.select(F.col(by).alias("_by"), F.col(value).alias("_value")).where("_value is not null").withColumn("_cell", F.lit(0).cast("long"))
    kind = dict(live.dtypes)["_value"]
    asked = F.explode(F.array(*[F.struct(F.lit(n).alias("_name"), r.cast("long").alias("_index")) for n, r in ranks.items()]))
    totals = live.groupBy("_by").agg(F.count("*").alias("total"))
    wanted = materialize(totals.select("_by", F.lit(0).cast("long").alias("_cell"), asked.alias("_r")).select("_by", "_cell", "_r.*"), "wanted")
    for _ in range(ROUNDS):
        cells = materialize(live.groupBy("_by", "_cell").agg(F.count("*").alias("_n"), F.min("_value").alias("_low"), F.max("_value").alias("_high")), "cells")
        large = cells.where(F.col("_n") > FEW).where("_low < _high").select("_by", "_cell", "_low")
        if large.isEmpty():
            break
        rows_of_large = live.alias("l").join(sendable(large).alias("g"), same_cell("l", "g")).select("l.*", "g._low")
        borders = materialize(_borders(rows_of_large, kind), "borders")
        # cells that are not refined have no borders, and stay as they are in place 1
        marked = live.alias("l").join(sendable(borders).alias("b"), same_cell("l", "b"), "left").select("l._by", "l._cell", "l._value", F.when(F.col("_borders").isNull(), F.lit(1).cast("long")).otherwise(_place(F.col("l._value"), F.col("_borders"))).alias("_place"))
        wanted = materialize(_within(wanted, marked.groupBy("_by", "_cell", "_place").agg(F.count("*").alias("_n"))), "wanted")
        placed = marked.select("_by", (F.col("_cell") * (2 * BORDERS + 2) + F.col("_place")).alias("_cell"), "_value")
        live = materialize(placed.alias("p").join(sendable(wanted.select("_by", "_cell").distinct()).alias("w"), same_cell("p", "w"), "left_semi"), "live")
    else:
        raise RuntimeError(f"cells of {FEW} rows not found in {ROUNDS} rounds")
    same = wanted.alias("w").join(cells.where("not _low < _high").alias("c"), same_cell("w", "c")).selectExpr("w._by", "_name", "case when _index >= 0 and _index < _n then _low end as _value")
    several = live.alias("l").join(sendable(cells.where("_low < _high").select("_by", "_cell")).alias("c"), same_cell("l", "c"), "left_semi")
    numbered = several.withColumn("_row", F.row_number().over(Window.partitionBy("_by", "_cell").orderBy("_value")) - 1)
    found = wanted.alias("w").join(numbered.alias("n"), F.expr("w._by <=> n._by and w._cell = n._cell and w._index = n._row")).selectExpr("w._by", "_name", "_value")
    both = same.unionByName(found)
    # two rows of one rank can't be: every rank has one cell, and every cell one value or distinct row numbers
    picked = both.groupBy("_by").agg(*[F.max(F.when(F.col("_name") == n, F.col("_value"))).alias(n) for n in ranks])
    return totals.alias("t").join(picked.alias("p"), F.expr("t._by <=> p._by"), "left").select(F.col("t._by").alias(by), *[F.col(f"p.{n}") for n in ranks])
