"""Values at ranks, against sorting."""

import random

import pytest
from pyspark.sql import functions as F

from quarryline.operators import profile, selection

def ranks():
    return {"first": F.lit(0), "quarter": F.floor(F.col("total") / 4), "middle": F.floor((F.col("total") - 1) / 2), "last": F.col("total") - 1, "beyond": F.col("total")}


def plain(rows):
    groups = {}
    for g, v, _ in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    out = {}
    for g, vs in groups.items():
        vs.sort(key=lambda v: (v != v, v))
        n = len(vs)
        out[g] = [repr(v) for v in (vs[0], vs[n // 4], vs[(n - 1) // 2], vs[-1], None)]
    return out


def got(df):
    return {r[0]: [repr(v) for v in r[1:]] for r in df.collect()}


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(selection, "FEW", 20)
    monkeypatch.setattr(selection, "BORDERS", 4)


def test_one_group_of_distinct_values_is_refined(spark, small, monkeypatch):
    rnd, sizes, write = random.Random(1), [], selection.materialize

    def written(df, label):
        out = write(df, label)
        if label in ("live", "cells"):
            sizes.append(out.count() if label == "live" else out.agg(F.max("_n")).first()[0])
        return out

    monkeypatch.setattr(selection, "materialize", written)
    rows = [("g", rnd.random() * 10 ** rnd.randint(-3, 6), 1) for _ in range(1500)]
    found = selection.at_ranks(spark.createDataFrame(rows, "g string, v double, x int").repartition(4), "g", "v", ranks())
    assert got(found) == plain(rows)
    assert max(sizes) > 1000 and sizes[-1] <= 20 * 5  # the rows left for five ranks


def test_ties_nulls_and_groups(spark, small):
    rnd = random.Random(2)
    rows = [("hot", 7.0, 1)] * 300 + [("hot", rnd.choice([7.0, 6.0, 8.0, rnd.random()]), 1) for _ in range(200)]
    rows += [(None, float(k % 50), 1) for k in range(200)] + [("one", 3.5, 1), ("none", None, 1), ("nan", float("nan"), 1), ("nan", 1.0, 1)]
    rows += [("nans", float("nan") if k % 2 else float(k), 1) for k in range(90)] + [(f"g{k}", float(k), 1) for k in range(30)]
    assert got(selection.at_ranks(spark.createDataFrame(rows, "g string, v double, x int").repartition(3), "g", "v", ranks())) == plain(rows)


def test_other_types(spark, small):
    rows = [("a", (k * 7919) % 1000 + 2**60, 1) for k in range(1000)]
    assert got(selection.at_ranks(spark.createDataFrame(rows, "g string, v long, x int"), "g", "v", ranks())) == plain(rows)
    days = spark.range(300).selectExpr("'d' as g", "date_add(date'2020-01-01', cast(id * 7 % 300 as int)) as v")
    assert str(selection.at_ranks(days, "g", "v", {"m": F.lit(150)}).first().m) == "2020-05-30"


def test_many_groups_are_merged_in(spark, small, monkeypatch):
    monkeypatch.setattr(selection, "SENT", 3)
    rows = [(f"g{k % 9}", float((k * 31) % 997), 1) for k in range(900)]
    assert got(selection.at_ranks(spark.createDataFrame(rows, "g string, v double, x int"), "g", "v", ranks())) == plain(rows)


def test_empty(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert selection.at_ranks(none, "g", "v", ranks()).count() == 0
    assert profile.quantiles(none, "g", "v", {"p05": 0.05}).count() == 0


@pytest.mark.parametrize("borders", [4, 5, 128])
def test_place_is_found_by_halves(spark, monkeypatch, borders):
    monkeypatch.setattr(selection, "BORDERS", borders)
    nan = float("nan")
    lists = [[2.0 * k for k in range(n)] + last for n in (0, 1, 2, 3, borders - 1) for last in ([], [nan])]
    rows = spark.createDataFrame([(v, b) for b in lists if b for v in (-1.0, 0.0, 1.0, 2.0, 3.5, 2.0 * borders, nan)], "v double, b array<double>")
    place = rows.select("v", "b", selection._place(F.col("v"), F.col("b")).alias("p"))
    key = lambda x: (x != x, 0 if x != x else x)
    for v, b, p in place.collect():
        reached = sum(key(x) <= key(v) for x in b)
        assert p == 2 * reached + (0 if reached and key(b[reached - 1]) == key(v) else 1)
    assert " filter(" not in place._jdf.queryExecution().optimizedPlan().toString().replace("(filter(", " filter(")
