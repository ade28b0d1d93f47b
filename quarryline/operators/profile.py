"""Profiles of a corpus: summaries, quantiles, comparisons of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import text as T
from quarryline.operators.selection import at_ranks


def quantiles(rows: DataFrame, by: str, value: str, fractions: dict[str, float]) -> DataFrame:
    """Smallest and largest value, the median, and values at indices (n - 1) * fraction rounded half to even."""
    total = F.col("total")
    ranks = {n: F.bround((total - 1) * F.lit(f)) for n, f in fractions.items()} | {"_lower": F.floor((total - 1) / 2), "_upper": F.floor(total / 2)}
    ends = rows.groupBy(F.col(by).alias("_group")).agg(F.min(value).alias("minimum"), F.max(value).alias("maximum"))
    found = at_ranks(rows, by, value, ranks).join(ends, F.col(by).eqNullSafe(F.col("_group")))
    return found.select(by, "minimum", *fractions, F.round((F.col("_lower") + F.col("_upper")) / 2, 9).alias("median"), "maximum")


def means_and_medians(rows: DataFrame, by: str, columns: dict[str, str]) -> DataFrame:
    """by, n, and mean and median of each column."""
    out = rows.groupBy(by).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"{n}_mean") for n, c in columns.items()])
    for n, c in columns.items():
        middle = at_ranks(rows, by, c, {"_lower": F.floor((F.col("total") - 1) / 2), "_upper": F.floor(F.col("total") / 2)})
        median = middle.select(F.col(by).alias("_group"), ((F.col("_lower") + F.col("_upper")) / 2).alias(f"{n}_median"))
        out = out.join(median, F.col(by).eqNullSafe(F.col("_group")), "left").drop("_group")
    return out


def line_stats(docs: DataFrame, by: str) -> DataFrame:
    """by, bytes, lines, nonempty_lines of docs with text and its parts between line ends, l."""
    lines = F.size("l") - F.when(F.element_at("l", -1) == "", 1).otherwise(0)
    full = F.size(F.filter("l", lambda x: T.strip(x) != ""))
    return docs.groupBy(by).agg(F.sum(F.octet_length("text")).cast("long").alias("bytes"), F.sum(lines).cast("long").alias("lines"), F.sum(full).cast("long").alias("nonempty_lines"))


def summary(rows: DataFrame, by: str, size: str, key: str, more: dict[str, Column]) -> DataFrame:
    """Counts, the upper median of size, the first five keys, and what else is asked for, by group."""
    median = at_ranks(rows, by, size, {f"median_{size}": F.floor(F.col("total") / 2)})
    place = F.row_number().over(Window.partitionBy(by).orderBy(key))
    first = rows.select(by, key).withColumn("_place", place).where("_place <= 5").groupBy(by).agg(F.array_join(F.sort_array(F.collect_list(key)), ",").alias("sample_ids"))
    return rows.groupBy(by).agg(F.count("*").alias("documents"), *[c.alias(n) for n, c in more.items()]).join(median, by).join(first, by)


def piece_summary(docs: DataFrame, by: str, pieces: Column) -> DataFrame:
    """Totals, rates and nearest-rank quantiles of piece lengths for each group and overall."""
    totals = docs.rollup(by).agg(F.sum(F.length("text")).cast("long").alias("characters"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))
    lengths = docs.select(by, F.explode(pieces).alias("piece")).select(by, F.octet_length("piece").cast("long").alias("length")).groupBy(by, "length").agg(F.count("*").alias("n"))
    # lengths are few, so both groupings come from their counts
    both = lengths.unionByName(lengths.groupBy("length").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias(by), "length", "n"))
    ordered = Window.partitionBy(by).orderBy("length").rowsBetween(Window.unboundedPreceding, -1)
    places = both.withColumn("before", F.coalesce(F.sum("n").over(ordered), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy(by)))

    def nearest(q: float) -> Column:
        index = F.greatest(F.ceil(F.col("total") * F.lit(q)) - 1, F.lit(0))
        return F.max(F.when((F.col("before") <= index) & (index < F.col("before") + F.col("n")), F.col("length")))

    made = places.groupBy(by).agg(F.sum("n").alias("tokens"), nearest(0.5).alias("p50"), nearest(0.95).alias("p95"), nearest(0.99).alias("p99"), F.max("length").alias("longest"), F.sum(F.when(F.col("length") >= 8, F.col("n")).otherwise(0)).alias("long_pieces"))
    rate = lambda c: F.round(F.col(c) / F.greatest(F.col("tokens"), F.lit(1)), 9)
    joined = totals.join(made.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")))
    return joined.select(F.coalesce(by, F.lit("overall")).alias("domain"), "characters", "bytes", "tokens", rate("bytes").alias("bytes_per_token"), rate("characters").alias("characters_per_token"), "p50", "p95", "p99", "longest", rate("long_pieces").alias("long_rate"))


def mismatch(expected: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has: missing from what is given, or extra."""
    a, b = expected.select(F.col(key).alias("_a")).distinct(), given.select(F.col(key).alias("_b")).distinct()
    both = a.join(b, F.col("_a") == F.col("_b"), "full_outer").where("_a is null or _b is null")
    return both.select(F.coalesce("_a", "_b").alias(key), F.when(F.col("_a").isNull(), "extra").otherwise("missing").alias("problem"))


def deltas(a: DataFrame, b: DataFrame, key: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Differences b - a of two metric tables; a key that one side lacks is an error."""
    joined = a.join(b, key, "full_outer") if not set(a.columns) & set(b.columns) - {key} else a.join(b.select(key, *[c for c in b.columns if c not in a.columns]), key, "full_outer")
    known = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit("domain sets differ")).cast("double")).otherwise(F.col(c))
    return joined.select(key, *[(F.when(F.col(x).isNull() | F.col(y).isNull(), known(x)).otherwise(F.col(y) - F.col(x))).cast(dict(joined.dtypes)[y]).alias(n) for n, (x, y) in columns.items()])
