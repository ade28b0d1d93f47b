"""Toxicity grades of texts by cumulative-link ordinal regression on sparse text features.

Features are words (runs of letters, lower-cased) and beginnings of words; a feature's value is its
number of uses over the square root of the text's number of words and SMOOTH more. One weight vector serves all
ordered thresholds: P(grade > k) = logistic(weights . x - threshold k). Grades are the distinct values
of the label, in order; labels that only say 0 or 1 are two grades with one threshold, and nothing
finer is made up. The expected severity is the expected label, from these chances and the values; a
text is toxic if P(label > 0) is at least CHANCE, as if to miss one cost as much as four false alarms.

The model is fitted on a bounded sample of labelled rows (at most about SAMPLE for each value of the
label, by a hash of doc_id, weighted back to the values' shares), whole texts, with all features of
theirs. Weights carry an absolute penalty, which leaves most of them zero; those left are fitted again
under RELAXED of it, so that they aren't held down. Its strength is chosen among PATH inside the
sample, by the likelihood of every FOLDS-th row under a fit on the others. A feature
whose summed importance doesn't exceed the least penalty can't have a weight, whatever the others are,
for no row's residual exceeds 1; only such features are left out beforehand, which bounds the others by
the mean sum of values over that penalty. Every text is scored whole.

Defined results: null and empty texts and texts without letters have no features and get the base
chances; without labels both above 0 and not nothing is toxic; of labels that contradict each other for a
doc_id the highest counts; repeated rows give repeated results and count as often in the fit; a very
long text takes time and memory in proportion to its length; other columns are carried along or not
looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructType

from quarryline.llm import worker
from quarryline.sources.scratch import materialize
from quarryline.sources.tables import short_batches

#: Labelled documents of each value of the label in the fit, about.
SAMPLE = 2_000
BEGINNINGS = (5, 6, 7)
#: Strengths of the penalty, as shares of the least one at which all weights are zero; and the folds that choose.
PATH = (1 / 16, 1 / 64)
RELAXED = 1 / 16
FOLDS = 5
STEPS = 60
#: Values are this many times the uses over the root of the number of words, so that weights are of order 1.
SCALE = 10.0
#: Words added to a text's number, so that one word doesn't decide over a very short text.
SMOOTH = 30
WORDS_KEPT = 80_000
#: Texts whose features a task holds at once.
SLICE = 64


class Model(NamedTuple):
    """Weights by feature, thresholds, and the grades' label values (one more than thresholds)."""

    weights: dict[str, float]
    bounds: np.ndarray
    values: np.ndarray


#: Chance from which a text counts as toxic.
CHANCE = 0.2

#: Without labels of both kinds.
NOTHING = Model({}, np.array([50.0]), np.array([0.0, 1.0]))


def words_of(text: str | None) -> list[str]:
    return worker.letter_runs(text.lower()) if text else []


def features_of(word: str) -> list[str]:
    """The word itself, and its beginnings marked by a leading circumflex."""
    return [word, *("^" + word[:n] for n in BEGINNINGS if len(word) >= n)]


def values_of(text: str | None) -> dict[str, float]:
    words = words_of(text)
    counts: dict[str, int] = {}
    for w in words:
        for f in features_of(w):
            counts[f] = counts.get(f, 0) + 1
    each = SCALE / (len(words) + SMOOTH) ** 0.5
    return {f: each * n for f, n in counts.items()}


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[float, int]]:
    """doc_id, label, text of the documents in the fit, and the labelled documents of each value."""
    said = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("double")).alias("label"))
    sizes = {r["label"]: r["count"] for r in said.groupBy("label").count().collect()}  # a row for each grade
    draw = F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for value, n in sizes.items():
        share = F.when(F.col("label") == value, min(1.0, SAMPLE / n)).otherwise(share)
    drawn = said.where(draw < share)  # at most about SAMPLE rows for each grade, so it may be broadcast
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(drawn), "doc_id"), sizes


def feature_sums(chosen: DataFrame, importance: dict[float, float], slope: dict[float, float]) -> DataFrame:
    """feature, total (importance times value), score (the same times the grade's slope without weights)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("toxicity")
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            sums: dict[str, list[float]] = {}
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for f, x in values_of(text.as_py()).items():
                    own = sums.setdefault(f, [0.0, 0.0])
                    own[0] += importance[label] * x
                    own[1] += importance[label] * x * slope[label]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *(pa.array([s[k] for s in sums.values()], pa.float64()) for k in (0, 1))], ["feature", "total", "score"])

    return chosen.select("label", "text").mapInArrow(run, "feature string, total double, score double").groupBy("feature").agg(F.sum("total").alias("total"), F.sum("score").alias("score"))


def chances(score: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """P(grade > k) for k from -1 (always 1) to the highest grade (always 0)."""
    above = 1 / (1 + np.exp(-(score[:, None] - bounds).clip(-500, 500)))
    return np.concatenate((np.ones((len(score), 1)), above, np.zeros((len(score), 1))), axis=1)


class Rows(NamedTuple):
    """Sparse rows: row, column and value of each entry, and each row's grade and weight."""

    rows: np.ndarray
    cols: np.ndarray
    values: np.ndarray
    grades: np.ndarray
    weights: np.ndarray

    def where(self, keep: np.ndarray) -> Rows:
        place = np.cumsum(keep) - 1
        own = keep[self.rows]
        return Rows(place[self.rows[own]].astype(np.int32), self.cols[own], self.values[own], self.grades[keep], self.weights[keep])


def likelihood(data: Rows, w: np.ndarray, bounds: np.ndarray) -> float:
    """Mean logarithm of the rows' chances of their own grades."""
    above = chances(np.bincount(data.rows, data.values * w[data.cols], len(data.grades)), bounds)
    each = np.arange(len(data.grades))
    own = np.maximum(above[each, data.grades] - above[each, data.grades + 1], 1e-12)
    return float((np.log(own) * data.weights).sum() / data.weights.sum())


def slopes(data: Rows, p: np.ndarray, size: int) -> np.ndarray:
    """Derivatives of minus the likelihood by weights, first threshold, and logarithms of the steps between thresholds."""
    n, top = len(data.grades), len(p) - size
    steps = np.exp(p[size + 1 :])
    above = chances(np.bincount(data.rows, data.values * p[data.cols], n), p[size] + np.concatenate(([0.0], np.cumsum(steps))))
    each = np.arange(n)
    own = np.maximum(above[each, data.grades] - above[each, data.grades + 1], 1e-12)
    slope = above * (1 - above)
    importance = data.weights / data.weights.sum()
    up, down = slope[each, data.grades] / own * importance, slope[each, data.grades + 1] / own * importance
    g = np.zeros_like(p)
    g[:size] = np.bincount(data.cols, data.values * (down - up)[data.rows], size)
    by_bound = np.array([up[data.grades == k + 1].sum() - down[data.grades == k].sum() for k in range(top)])
    g[size] = by_bound.sum()
    g[size + 1 :] = by_bound[1:][::-1].cumsum()[::-1] * steps
    return g


def begin(grades: np.ndarray, weights: np.ndarray, size: int, top: int) -> np.ndarray:
    """No weights, and the thresholds that give the grades' shares."""
    share = np.array([weights[grades > k].sum() / weights.sum() for k in range(top)]).clip(1e-4, 1 - 1e-4)
    first = np.log(1 / share - 1)
    return np.concatenate((np.zeros(size), first[:1], np.log(np.maximum(np.diff(first), 0.05))))


def fit_ordinal(data: Rows, size: int, p: np.ndarray, penalty: float, steps: int = STEPS) -> np.ndarray:
    """Weights shared by all thresholds, and thresholds as in `begin`, from p on.

    Adam on the likelihood; each step then takes the penalty's share off each weight, down to zero.
    """
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        g = slopes(data, p, size)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        rate = 0.1 * min(1.0, 2.05 - 2 * t / steps) / (np.sqrt(v / (1 - 0.999**t)) + 1e-12)
        p = p - rate * m / (1 - 0.9**t)
        p[:size] = np.sign(p[:size]) * np.maximum(np.abs(p[:size]) - rate[:size] * penalty, 0)
    return p


def fit_again(data: Rows, size: int, p: np.ndarray, penalty: float) -> np.ndarray:
    """The same from p on, for the weights alone that p has left."""
    left = np.flatnonzero(p[:size])
    place = np.full(size, -1, np.int32)
    place[left] = np.arange(len(left))
    own = place[data.cols] >= 0
    few = Rows(data.rows[own], place[data.cols[own]], data.values[own], data.grades, data.weights)
    q = fit_ordinal(few, len(left), np.concatenate((p[left], p[size:])), RELAXED * penalty, 2 * STEPS)
    out = np.concatenate((np.zeros(size), q[len(left) :]))
    out[left] = q[: len(left)]
    return out


def thresholds(p: np.ndarray, size: int) -> np.ndarray:
    return p[size] + np.concatenate(([0.0], np.cumsum(np.exp(p[size + 1 :]))))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Feature weights and thresholds."""
    chosen, sizes = sample(docs, labels)
    values = np.array(sorted(sizes))
    if len(values) < 2 or values[0] > 0 or values[-1] <= 0:
        return NOTHING
    grade = {v: k for k, v in enumerate(values.tolist())}
    total = sum(sizes.values())
    top = len(values) - 1
    # without weights a row's slope is 1 - P(grade >= its own) - P(grade > its own)
    higher = {v: sum(sizes[x] for x in sizes if x > v) / total for v in sizes}
    slope = {v: 1 - 2 * higher[v] - sizes[v] / total for v in sizes}
    drawn = {v: min(SAMPLE, sizes[v]) for v in sizes}
    sums = materialize(feature_sums(chosen, {v: sizes[v] / total / drawn[v] for v in sizes}, slope), "features")
    least = (sums.agg(F.max(F.abs("score"))).first()[0] or 0.0) * min(PATH)
    number = {r["feature"]: k for k, r in enumerate(sums.where(F.col("total") > least).select("feature").orderBy("feature").toLocalIterator())}
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("toxicity")
        number = shared.value
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            ids, vals = [], []
            for text in batch.column(2):
                own = [(number[f], x) for f, x in values_of(text.as_py()).items() if f in number]
                ids.append(np.array([k for k, _ in own], "<i4").tobytes())
                vals.append(np.array([x for _, x in own], "<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(vals, pa.binary())], ["doc_id", "label", "ids", "vals"])

    rows = sorted(chosen.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label double, ids binary, vals binary").collect())  # bounded by SAMPLE
    shared.unpersist()
    grades = np.array([grade[r["label"]] for r in rows], np.int64)
    if len(set(grades.tolist())) < 2:
        return NOTHING
    counts = np.bincount(grades, minlength=top + 1)
    weights = np.array([sizes[v] for v in values.tolist()])[grades] / counts[grades]
    lengths = np.array([len(r["ids"]) // 4 for r in rows])
    data = Rows(np.repeat(np.arange(len(rows), dtype=np.int32), lengths), np.frombuffer(b"".join(r["ids"] for r in rows), "<i4"), np.frombuffer(b"".join(r["vals"] for r in rows), "<f4"), grades, weights)
    del rows
    size = len(number)
    p = begin(grades, weights, size, top)
    most = float(np.abs(slopes(data, p, size)[:size]).max(initial=0.0))
    kept = np.arange(len(grades)) % FOLDS != 0
    inner, outer = data.where(kept), data.where(~kept)
    found, q = [], p
    for share in PATH:  # each fit goes on from the one before
        q = fit_ordinal(inner, size, q, share * most)
        again = fit_again(inner, size, q, share * most)
        found.append((likelihood(outer, again[:size], thresholds(again, size)), share))
    best = max(found)[1]
    for share in PATH[: PATH.index(best) + 1]:
        p = fit_ordinal(data, size, p, share * most)
    p = fit_again(data, size, p, best * most)
    made = Model({f: float(p[k]) for f, k in number.items() if p[k]}, thresholds(p, size), values)
    del data, inner, outer, number
    worker.give_back()
    return made


def score(docs: DataFrame, model: Model, names: tuple[str, str, str] = ("p_toxic", "severity", "toxic")) -> DataFrame:
    """docs' columns with P(label > 0), the expected label and whether the text is toxic, under names that docs doesn't use."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of the sample's features those with a weight

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("toxicity")
        weights, bounds, values = shared.value
        known: dict[str, float] = {}
        first = int(np.searchsorted(values, 0.0, "right"))  # the lowest grade above 0
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for k, text in enumerate(batch.column("text")):
                words = words_of(text.as_py())
                if not words:
                    continue
                if len(known) > WORDS_KEPT:
                    known.clear()
                for w in set(words).difference(known):
                    known[w] = sum(weights.get(f, 0.0) for f in features_of(w))
                scores[k] = SCALE * sum(map(known.__getitem__, words)) / (len(words) + SMOOTH) ** 0.5
            above = chances(scores, bounds)
            severity = values[0] + above[:, 1:-1] @ np.diff(values)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(above[:, first]), pa.array(severity), pa.array(above[:, first] >= CHANCE)], [*batch.schema.names, *names])

    schema = StructType(list(docs.schema.fields)).add(names[0], DoubleType()).add(names[1], DoubleType()).add(names[2], BooleanType())
    return short_batches(docs).mapInArrow(run, schema)


def grade(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_toxic, severity, toxic of each document's whole text."""
    return score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels)).drop("text")
