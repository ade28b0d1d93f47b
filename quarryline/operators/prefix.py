"""Running sums over an order, without a window over all rows.

Rows fall into buckets that follow the order. The sums of the buckets, of which there is a bounded
number, are accumulated in one small window; within its bucket each row adds the sum of those before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bucket, about; more if there would be more than BUCKETS of them, which bounds the window over buckets.
ROWS, BUCKETS = 256, 1 << 16
#: Values of the key that are looked at for each border between buckets, about.
SAMPLED = 8
#: Borders that are compared at once.
FAN = 64


def borders(rows: DataFrame, key: str) -> list[int]:
    """Borders between buckets of about equally many rows, from a sample by the hash of the key.

    Values that are repeated count once, so the sample is bounded whatever the key holds.
    """
    n = rows.count()
    buckets = min(BUCKETS, -(-n // ROWS))
    if buckets < 2:
        return []
    part = max(1, n // (SAMPLED * buckets))
    known = rows.select(F.col(key).cast("long").alias("k")).where("k is not null")
    seen = known.where(F.pmod(F.xxhash64("k"), F.lit(part)) == 0).distinct().toArrow().column("k").to_numpy()
    step = max(1, -(-len(seen) // buckets))
    return sorted(seen.tolist())[step::step]


def by_number(rows: DataFrame, key: str) -> Column:
    """Buckets of a key of whole numbers, in its order: how many borders a row's key reaches; nulls come first.

    The borders only balance the buckets and never change a sum. They are compared FAN at a time.
    """
    cuts = borders(rows, key)
    longs = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")  # noqa: E731  folded to a literal
    reached = lambda values: F.size(F.filter(values, lambda v: v <= F.col(key)))
    stride = 1
    while stride * FAN < len(cuts):
        stride *= FAN
    place = reached(longs(cuts[::stride])) if cuts else F.lit(0)
    while stride > 1:
        stride //= FAN
        before = (F.greatest(place, F.lit(1)) - 1) * FAN
        place = before + reached(F.slice(longs(cuts[::stride]), before + 1, FAN))
    return F.when(F.col(key).isNotNull(), place).otherwise(-1).cast("long")


def by_digest(key: str) -> Column:
    """Buckets of a hexadecimal key by its first three digits."""
    return F.conv(F.substring(key, 1, 3), 16, 10).cast("long")


def running_sum(rows: DataFrame, bucket: Column, order: list, value: Column, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds, as `out`, the sum of value over the rows before, in an order that bucket follows, for each `by`."""
    keys = [*by, "_bucket"]
    marked = rows.withColumn("_bucket", bucket).withColumn("_value", value.cast("long"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = marked.groupBy(*keys).agg(F.sum("_value").alias("_sum"))
    base = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before(Window.partitionBy(*by).orderBy("_bucket"))), zero)).drop("_sum")
    inner = F.coalesce(F.sum("_value").over(before(Window.partitionBy(*keys).orderBy(*order))), zero)
    return marked.withColumn("_inner", inner).join(base, keys).withColumn(out, F.col("_inner") + F.col("_base")).select(*rows.columns, out)
