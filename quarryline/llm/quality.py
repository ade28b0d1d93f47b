"""Quality of texts by the votes of the nearest labelled texts in a space of latent meanings.

Terms of a text are its words (what white space separates, in lower case), their shapes (runs of letters, digits and signs), and marks
for words that repeat the one before; each falls into one of TERMS places by a checksum. Places weigh the logarithm of the inverse
share of documents that use them, counted over all documents. A truncated singular value decomposition of
the weighted rows of a bounded sample of labelled texts (about SAMPLE for each label, by a hash of doc_id, whole texts) gives
DIMENSIONS directions. The sample's rows in that space, of length 1, are sent to every task: SAMPLE and DIMENSIONS bound them.

A text's score: the exact cosines with all of them, as products of blocks; the NEIGHBOURS largest (with all that tie with the last)
vote for their labels, with their cosines as weights, times how many labelled texts of that label each stands for. A small
weight for the share of label 1 among all decides where no neighbour is near.

Defined results: null, empty and blank texts have no terms and get the share of label 1, as do texts that share no term with the
sample; without labelled rows of both labels all get that share, 0.5 if there is none; of labels that contradict each other for a doc_id the
lowest counts, of texts the smallest; labels above 0 are label 1; rows with a null doc_id are scored, aren't learnt from, and aren't held out; repeated rows give repeated
results; a very long text takes time and memory in proportion to its length; other columns aren't looked at; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm import worker

#: Labelled texts of each label in the fit, about; directions; neighbours that vote.
SAMPLE, DIMENSIONS, NEIGHBOURS = 1500, 48, 15
#: Places of terms, a power of two.
TERMS = 1 << 16
#: Weight of the labels' shares, and how near to the last neighbour's cosine counts as a tie.
PRIOR, TIE = 1e-3, 1e-6
#: Score from which a text is predicted to have label 1.
CHANCE = 0.3
#: Folds by the checksum of doc_id; the first is held out.
FOLDS = 5
#: Steps of the decomposition, and directions that it takes more.
STEPS, SPARE = 4, 10
#: Texts whose terms a task holds at once, and words whose terms a worker remembers.
SLICE, WORDS_KEPT = 64, 300_000
ALIKE = re.compile(r"(.)\1+")
#: Words that repeat the one before for the first, second, third and any later time.
AGAIN = np.array([zlib.crc32(f"again {k}".encode()) % TERMS for k in range(1, 5)])


class Model(NamedTuple):
    """weights and directions of each place, the labelled rows, whether each is of label 1, what each stands for, and label 1's share."""

    weights: np.ndarray
    directions: np.ndarray
    rows: np.ndarray
    good: np.ndarray
    stands_for: np.ndarray
    share: float


class Kinds(dict):
    """X for capitals, x for other letters, 9 for digits, by code point; signs stand for themselves."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        self[code] = ord("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c)
        return self[code]


_kinds = Kinds()
#: Of words, and of words whose letters are replaced by their kinds, what is known of them.
_terms: dict[str, int] = {}
_shapes: dict[str, int] = {}
_WORD, _SHAPE = zlib.crc32(b"word "), zlib.crc32(b"shape ")


def forget() -> None:
    for known in (_kinds, _terms, _shapes):
        known.clear()


def shape(kinds: str) -> str:
    """Each run of one kind as one."""
    return ALIKE.sub(r"\1", kinds)[:8]


def terms_of(word: str) -> int:
    """The word's own checksum, the place of its shape, and its own place, in one number."""
    kinds = word.translate(_kinds)
    known = _shapes.get(kinds)
    if known is None:
        known = _shapes[kinds] = zlib.crc32(shape(kinds).encode("utf-8", "surrogatepass"), _SHAPE) % TERMS << 16
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) >> 1 << 32 | known | zlib.crc32(word.lower().encode("utf-8", "surrogatepass"), _WORD) % TERMS


def counted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and number of uses of each term of these texts, by row and place."""
    if len(_terms) > WORDS_KEPT:
        forget()
    said = [t.split() if t else [] for t in texts]
    for w in set().union(*said).difference(_terms):
        _terms[w] = terms_of(w)
    lengths = np.fromiter(map(len, said), np.int64, len(said))
    codes = np.fromiter(map(_terms.__getitem__, chain.from_iterable(said)), np.int64, int(lengths.sum()))
    row = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(codes))
    new = np.append(True, (codes[1:] != codes[:-1]) | (row[1:] != row[:-1]))[: len(codes)]
    times = place - np.maximum.accumulate(np.where(new, place, 0))  # how many words before, on end, are the same
    marks = row[times > 0] * TERMS + AGAIN[np.minimum(times[times > 0], len(AGAIN)) - 1]
    keys, uses = np.unique(np.concatenate((row * TERMS + (codes >> 16 & TERMS - 1), row * TERMS + (codes & TERMS - 1), marks)), return_counts=True)
    return keys // TERMS, keys % TERMS, uses


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker.begin("quality", forget)
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each place is used, and how many documents there are; of the driver it takes TERMS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros(TERMS, np.int64), 0
        for batch in _slices(batches):
            found += np.bincount(counted(batch.column(0).to_pylist())[1], minlength=TERMS)
            rows += batch.num_rows
        used = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1), pa.int32()), pa.array(np.append(found[used], rows), pa.int64())], ["place", "n"])

    summed = docs.select("text").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(TERMS + 1, np.int64)
    out[summed.column("place").to_numpy()] = summed.column("n").to_numpy()  # -1, all documents, comes last
    return out[:-1], int(out[-1])


def checksum(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, good, text of the labelled texts in the fit, and how many rows of labels each label has; the held-out fold is left out."""
    said = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") > 0).cast("int").alias("good"))
    learnt = said.where(checksum() % FOLDS != 0).groupBy("doc_id").agg(F.min("good").alias("good"))
    sizes = {r["good"]: r["count"] for r in learnt.groupBy("good").count().collect()}  # two rows
    draw = F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("good") == 1, min(1.0, SAMPLE / max(1, sizes.get(1, 0)))).otherwise(min(1.0, SAMPLE / max(1, sizes.get(0, 0))))
    drawn = learnt.where(draw < share)  # about 2 * SAMPLE rows at most, so it may be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("good").alias("good"), F.min("text").alias("text")), sizes


def decompose(rows: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """size x DIMENSIONS: the directions of the largest singular values of sparse rows (places, values), by subspace iteration."""
    across = lambda x: np.stack([v @ x[k] for k, v in rows])

    def back(y: np.ndarray) -> np.ndarray:
        out = np.zeros((size, y.shape[1]))
        for (k, v), own in zip(rows, y):
            out[k] += v[:, None] * own  # a row's places differ
        return out

    few = min(DIMENSIONS + SPARE, len(rows), size)
    x = np.random.default_rng(13).standard_normal((size, few))
    for _ in range(STEPS):
        x = np.linalg.qr(back(np.linalg.qr(across(x))[0]))[0]
    turn = np.linalg.svd(across(x), full_matrices=False)[2]
    return x @ turn[:DIMENSIONS].T


def unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 1e-9)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Weights of places from all documents, directions and labelled rows from the sample."""
    chosen, sizes = sample(docs, labels)
    share = sizes.get(1, 0) / sum(sizes.values()) if sizes else 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            row, place, uses = counted(batch.column(2).to_pylist())
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            packed = lambda a, kind: pa.array([a[i:j].astype(kind).tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed(place, "<u2"), packed(uses, "<u4")], ["doc_id", "good", "places", "uses"])

    # bounded by SAMPLE texts of TERMS places each
    found = sorted(chosen.select("doc_id", "good", "text").mapInArrow(run, "doc_id long, good int, places binary, uses binary").collect())
    found = [r for r in found if r["places"]]
    good = np.array([r["good"] for r in found], np.int64)
    if len(set(good.tolist())) < 2:
        return Model(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), good, good.astype(np.float64), share)
    used, n = document_frequencies(docs)
    weights = np.log((1 + n) / (1 + used))
    rows = []
    for r in found:
        k = np.frombuffer(r["places"], "<u2").astype(np.int64)
        v = np.frombuffer(r["uses"], "<u4") * weights[k]
        rows.append((k, v / max(np.linalg.norm(v), 1e-9)))
    directions = decompose(rows, TERMS)
    near = unit(np.stack([v @ directions[k] for k, v in rows]))
    stands_for = np.array([sizes[0], sizes[1]])[good] / np.bincount(good)[good]
    made = Model(weights.astype(np.float32), directions.astype(np.float32), near.astype(np.float32), good, stands_for, share)
    del rows, found, directions
    worker.give_back()
    return made


def latent(texts: list[str | None], model: Model) -> np.ndarray:
    """Rows of length 1, or of zeros, for these texts; SLICE rows always, so that products have one shape."""
    row, place, uses = counted(texts)
    out = np.zeros((SLICE, model.directions.shape[1]), np.float32)
    if len(row):
        first = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[first]] = np.add.reduceat((uses * model.weights[place]).astype(np.float32)[:, None] * model.directions[place], first, axis=0)
    return unit(out)


def votes(near: np.ndarray, model: Model) -> np.ndarray:
    """The scores of rows from `latent`."""
    cosines = (near @ model.rows.T).astype(np.float64)
    many = min(NEIGHBOURS, cosines.shape[1])
    if not many:
        return np.full(len(near), model.share)
    last = np.partition(cosines, -many, axis=1)[:, -many, None]
    weight = np.where(cosines >= last - TIE, cosines.clip(0), 0.0) * model.stands_for
    return (weight @ model.good + PRIOR * model.share) / (weight.sum(axis=1) + PRIOR)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            made = votes(latent(batch.column(1).to_pylist(), shared.value), shared.value)[: batch.num_rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each document's whole text."""
    held_out = F.coalesce(checksum() % FOLDS == 0, F.lit(False)).alias("held_out")
    return score(docs, train(docs, labels)).select("doc_id", held_out, "score", (F.col("score") >= CHANCE).cast("int").alias("predicted"))
