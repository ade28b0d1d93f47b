"""Overlap of documents with benchmark texts by runs of words.

The benchmark's runs fill a bit array (a Bloom filter) of a size that follows from their number, which is sent to all tasks
once. Documents are looked through where they are read; only runs whose bits are all set go on as strings and
meet the benchmark's in a join, which settles each exactly. So what is shuffled is about as much as matches,
not every run of every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import words
from quarryline.operators.filters import ngrams

#: Bits for each run of the benchmark, at least, and bits that a run sets.
BITS, MARKS = 16, 4
#: Bits of the array at least and at most (16 MB, what is sent to a task). A larger benchmark fills it more, and more runs go on to the join.
LEAST_BITS, MOST_BITS = 1 << 12, 1 << 27
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def array_bits(runs: int) -> int:
    """A power of two of at least BITS bits a run, within the limits."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS * runs - 1).bit_length()))


def run_hashes(hashes: pa.ListArray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lists of word hashes: a hash for each run of n words, its list, and its place there."""
    offsets = hashes.offsets.to_numpy()
    flat = hashes.values.to_numpy(zero_copy_only=False).view(np.uint64)
    many = np.maximum(np.diff(offsets) - (n - 1), 0)
    own = np.repeat(np.arange(len(many)), many)
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    first = offsets[own] + place
    if not len(first):
        return np.zeros(0, np.uint64), own, place
    rolled = np.zeros(len(flat) - n + 1, np.uint64)
    for k in range(n):
        rolled = rolled * _FACTOR + flat[k : len(flat) - n + 1 + k]
    found = rolled[first]
    found = (found ^ (found >> np.uint64(31))) * _MIX
    return found ^ (found >> np.uint64(29)), own, place


def places(found: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The MARKS bits of each hash in an array of so many bits, one after the other."""
    step = (found >> np.uint64(32)) | np.uint64(1)
    for k in range(MARKS):
        yield (found + np.uint64(k) * step) & np.uint64(size - 1)


def may_hold(bits: np.ndarray, found: np.ndarray) -> np.ndarray:
    held = np.ones(len(found), bool)
    for p in places(found, 64 * len(bits)):
        held &= (bits[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return held


def bit_array(benchmark: DataFrame, n: int) -> np.ndarray:
    """The bits that the benchmark's runs set: made in the tasks, put together by Spark, of the driver it takes MOST_BITS / 64 rows."""
    hashed = benchmark.select(F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes")).where(F.size("hashes") >= n)
    runs = hashed.agg(F.sum(F.size("hashes") - (n - 1))).first()[0] or 0
    size = array_bits(max(1, runs))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 64, np.uint64)
        for batch in batches:
            found, _, _ = run_hashes(batch.column(0), n)
            for p in places(found, size):
                np.bitwise_or.at(bits, p >> np.uint64(6), np.uint64(1) << (p & np.uint64(63)))
        used = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(bits[used].view(np.int64))], ["word", "bits"])

    made = hashed.mapInArrow(fill, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[made.column("word").to_numpy()] = made.column("bits").to_numpy().view(np.uint64)
    return out


def candidates(docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """doc_id, gram: the documents' distinct runs that the bit array may hold."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_array(benchmark, n))

    @F.arrow_udf("array<int>")
    def met(hashes: pa.Array) -> pa.Array:
        found, own, place = run_hashes(hashes, n)
        held = may_hold(shared.value, found)
        ends = np.concatenate(([0], np.cumsum(np.bincount(own[held], minlength=len(hashes)))))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[held], pa.int32()))

    hashes = F.coalesce(F.transform(words(F.col("text")), lambda w: F.xxhash64(w)), F.array().cast("array<bigint>"))
    marked = docs.select("doc_id", "text", met.asNondeterministic()(hashes).alias("at"))  # else it would run again for each use
    split = marked.where(F.size("at") > 0).select("doc_id", words(F.col("text")).alias("words"), "at")
    grams = F.array_distinct(F.transform("at", lambda k: F.array_join(F.slice("words", k + 1, F.lit(n)), " ")))
    return split.select("doc_id", F.explode(grams).alias("gram"))


def overlaps(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """doc_id, shared (distinct runs of n words that a benchmark text has too), items (benchmark texts).

    Null texts and texts of fewer words have no runs; documents without a match aren't returned.
    """
    given = benchmark.select("item_id", F.explode(F.array_distinct(ngrams(words(F.col("text")), n))).alias("gram"))
    met = candidates(docs, benchmark, n).join(given, "gram")
    return met.groupBy("doc_id").agg(F.count_distinct("gram").alias("shared"), F.count_distinct("item_id").alias("items"))
