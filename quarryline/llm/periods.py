"""Runs of repeated words: periodic stretches of a text, found by comparing it with itself at every lag.

Words are what white space of ASCII separates, as numbers within the text. At lag q the numbers are compared
with those q places on; a stretch of equal places, and the q words behind it, is a run of period q. Every
lag up to a quarter of the words is compared, many at once, so a run has four periods at least, and
LEAST words. A stretch that a smaller lag gives as well, with the same first and last word, has that
smaller period: if two periods both fit a stretch four times over, the smaller divides the larger.

A text of n words takes n * n / 4 comparisons. Texts of more than RANGE comparisons are cut into ranges
of lags, which Spark deals over the machines; each range travels with the text's numbers, not the text.
Other texts are one range, and are done where they are read. What is returned follows from all runs of a
text: their digest, the longest, and the text without the words that repeat a period.

Before that, about a tenth of the texts (by the checksum of doc_id) are made periodic from some word on,
if `planted`, which gives every table runs that are known.

Defined results: null, empty and blank texts have no words and no runs; words are compared by their bytes; a null doc_id is never
planted; repeated rows give repeated results; a very long text takes time with the square of its words, in at most RANGES tasks,
and its numbers are what a task holds; other columns aren't looked at; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm import worker
from quarryline.sources.scratch import materialize

#: Periods and words that a run has at least.
REPEATS, LEAST = 4, 6
#: Comparisons of a range of lags, about; and ranges of a text, beyond which they get longer.
RANGE, RANGES = 1 << 25, 256
#: Comparisons made at once.
AT_ONCE = 1 << 20
#: Lags up to this one give stretches that may lie within less than fifteen places.
FEW = 4
#: Eight true places.
FULL = np.frombuffer(b"\x01" * 8, np.uint64)[0]
#: Texts a worker holds at once.
SLICE = 256
#: Columns of a text's result after its doc_id.
RESULT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def words_of(text: str | None, mark: int | None) -> list[bytes]:
    """The words as bytes; if mark, a checksum, says so, periodic from some word on."""
    words = text.encode("utf-8", "surrogatepass").split() if text else []  # bytes are split at ASCII's white space alone
    n = len(words)
    if mark is None or mark % 10 or not n:
        return words
    g = mark // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    again, rest = divmod(n - a, p)
    period = words[a : a + p]
    return words[:a] + period * again + period[:rest]


def numbers_of(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers, from 0; the type's largest number isn't used."""
    seen: dict[bytes, int] = {}
    found = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint32, len(words))
    return found.astype(np.uint16) if len(seen) < 1 << 16 else found


def true_places(equal: np.ndarray, stretch: int) -> np.ndarray:
    """Where a mask, whose length is a multiple of eight, is true; stretches of fewer than `stretch` places may be missing or cut.

    The mask is looked at eight places at a time. Fifteen true ones in a row fill one such eight, and
    reach into its neighbours at most from there.
    """
    eights = equal.view(np.uint64)
    if stretch < 15:
        some = np.flatnonzero(eights)
    else:
        full = np.flatnonzero(eights == FULL)
        some = np.unique(np.concatenate((full, full[full > 0] - 1, full[full < len(eights) - 1] + 1))) if len(full) else full
    at = np.flatnonzero(equal.reshape(-1, 8)[some])
    return some[at >> 3] * 8 + (at & 7)


def runs_at(numbers: np.ndarray, low: int, high: int) -> np.ndarray:
    """start, length, period (rows, ascending) of the stretches that lags low to high give, each under the smallest of these."""
    n = len(numbers)
    found = [np.zeros((0, 3), np.int64)]
    padded = np.concatenate((numbers, np.full(high, np.iinfo(numbers.dtype).max, numbers.dtype)))
    step = max(1, min(AT_ONCE // max(n, 1), high + 1 - low))
    equal = np.zeros(-(-step * n // 8) * 8, bool)
    lag = low
    while lag <= high:
        lags = max(1, min(step, (high if lag > FEW else min(high, FEW)) + 1 - lag))
        shifted = np.lib.stride_tricks.as_strided(padded[lag:], (lags, n), padded.strides * 2, writeable=False)
        np.equal(shifted, numbers, out=equal[: lags * n].reshape(lags, n))
        equal[lags * n :] = False
        same = true_places(equal, (REPEATS - 1) * lag)  # from lag to lag; the last places of a lag are never equal
        if len(same):
            ends = np.flatnonzero(np.append(same[1:] - same[:-1] != 1, True))
            size = np.diff(ends, prepend=-1)
            first = same[ends - size + 1]
            q, start = lag + first // n, first % n
            good = size + q >= np.maximum(LEAST, REPEATS * q)
            found.append(np.stack((start, size + q, q), axis=1)[good])
        lag += lags
    return least_periods(np.concatenate(found))


def least_periods(runs: np.ndarray) -> np.ndarray:
    """Of runs with the same start and length the one with the smallest period; by start, then period."""
    if len(runs) > 1:
        runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
        runs = runs[np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1))]
        runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return runs


def result_of(words: list[bytes], runs: np.ndarray) -> tuple:
    """What RESULT names."""
    said = hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in runs.tolist()).encode())
    if not len(runs):
        return 0, None, None, None, None, said.hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    kept = hashlib.sha256(b" ".join([words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]))
    start, size, q = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
    return len(runs), start, size, q, 1000 * size // q, said.hexdigest(), kept.hexdigest()


def _results(batch: pa.RecordBatch, made: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([m[k] for m in made], t) for k, t in enumerate(kinds))], ["doc_id", *(c.split()[0] for c in RESULT.split(", "))])


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker.begin("periods")
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _sliced(batches):
        made = []
        for text, mark in zip(batch.column("text"), batch.column("mark").to_pylist()):
            words = words_of(text.as_py(), mark)
            made.append(result_of(words, runs_at(numbers_of(words), 1, len(words) // REPEATS)))
        yield _results(batch, made)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each range of lags, one at a time, for each carries the text's numbers."""
    for batch in _sliced(batches):
        for key, text, mark in zip(batch.column("key").to_pylist(), batch.column("text"), batch.column("mark").to_pylist()):
            numbers = numbers_of(words_of(text.as_py(), mark))
            lags = len(numbers) // REPEATS
            step = max(1, -(-lags // min(RANGES, -(-lags * len(numbers) // RANGE) or 1)))
            for low in range(1, lags + 1, step):
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([low], pa.int64()), pa.array([min(low + step - 1, lags)], pa.int64()), pa.array([numbers.itemsize], pa.int32()), pa.array([numbers.tobytes()], pa.binary())], ["key", "low", "high", "width", "numbers"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _sliced(batches):
        for key, low, high, width, numbers in zip(*(batch.column(k).to_pylist() if k < 4 else batch.column(k) for k in range(5))):
            runs = runs_at(np.frombuffer(numbers.as_buffer(), f"<u{width}"), low, high)
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(runs), pa.string()), *(pa.array(runs[:, k], pa.int64()) for k in range(3))], ["key", "start", "length", "period"])


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _sliced(batches):
        made = []
        for text, mark, runs in zip(batch.column("text"), batch.column("mark").to_pylist(), batch.column("runs")):
            own = runs.values  # null if there are none
            found = np.zeros((0, 3), np.int64) if own is None else np.stack([own.field(k).to_numpy(zero_copy_only=False) for k in range(3)], axis=1)
            made.append(result_of(words_of(text.as_py(), mark), least_periods(found)))
        yield _results(batch, made)


def periodic_runs(docs: DataFrame, planted: bool = True) -> DataFrame:
    """doc_id and RESULT for each document."""
    mark = F.crc32(F.col("doc_id").cast("string").cast("binary")) if planted else F.lit(None).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", mark.alias("mark"))
    most = int((REPEATS * RANGE) ** 0.5)  # words of a text that is one range
    # n words have 2 n - 1 characters at least, so only long texts are counted
    long = F.coalesce((F.length("text") >= 2 * most) & (F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) > most), F.lit(False))
    short = rows.where(~long).mapInArrow(_here, f"doc_id long, {RESULT}")
    cut = materialize(rows.where(long).withColumn("key", F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.sha2(F.col("text").cast("binary"), 256))), "long")
    ranges = cut.mapInArrow(_cut, "key string, low long, high long, width int, numbers binary")
    runs = ranges.repartition("key", "low").mapInArrow(_scan, "key string, start long, length long, period long")
    least = runs.groupBy("key", "start", "length").agg(F.min("period").alias("period"))
    # a text's runs are fewer than its words
    gathered = materialize(least.groupBy("key").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs")), "runs")
    return short.unionByName(cut.join(gathered, "key", "left").select("doc_id", "text", "mark", "runs").mapInArrow(_join_up, f"doc_id long, {RESULT}"))
