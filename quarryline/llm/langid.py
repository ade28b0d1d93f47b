"""Language of texts: unigrams over a fixed public vocabulary, summed over all segmentations.

Each language has a probability for each vocabulary entry. A word's probability under a language is
the sum over all ways to cut it into entries of the product of their probabilities, by a forward
pass over its places. A text's score is the sum of its words' logarithms.

Training: expectation maximisation on the word counts of each language, one language after the other.
The expected number of uses of each entry follows from a forward and a backward pass. Fitted on a
bounded sample of labelled documents (about SAMPLE a language, or SAMPLE_ALL among all of them if that
is less, chosen by a hash of doc_id): all languages, all words of whole texts and all entries count.

Predictions come from the text alone. Words are runs of letters, lower-cased. Beside the language and
its score, a text's strangeness tells how badly even the best language explains it: its nats a letter,
less what SLACK standard deviations of the language's words allow for, over the language's own.

Defined results: `und` with score and strangeness 0 if the text is null or has no letter; score is the posterior
probability of the language under equal priors with the evidence of at most EVIDENCE letters, so
that it doesn't round to 1 on long texts; ties go to the language that sorts first; repeated rows
give repeated results and count as often in the fit; a very long text takes time and memory in
proportion to its length; other columns aren't looked at; without labelled rows everything is `und`;
an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm import worker
from quarryline.sources.scratch import materialize
from quarryline.sources.tables import short_batches

SPACE = "▁"
#: Labelled documents a language that the model is fitted on, and among all languages, about.
SAMPLE, SAMPLE_ALL = 1200, 24_000
ROUNDS = 3
#: Words whose arcs are laid out at once.
CHUNK = 8192
#: Letters of which the mean evidence counts in a score.
EVIDENCE = 60
#: Words with more letters are scaled in the fit, so that their chances don't leave the range of doubles.
LONG = 24
#: Added to the expected uses of each entry.
FLOOR = 0.02
#: Probability of a letter that is no entry.
STRANGE = 1e-6
SLACK = 6.0
WORDS_KEPT = 120_000


def words_of(text: str | None) -> list[str]:
    return worker.letter_runs(text.lower()) if text else []


def vocabulary(model_file: str) -> dict[str, int]:
    """The model's entries that hold letters only, after at most one leading space sign, lower-cased; and the space sign."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    seen = (sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    good = sorted({p for p in seen if (p[1:] if p[0] == SPACE else p).isalpha()} | {SPACE})
    return {p: k for k, p in enumerate(good)}


class Segmentations:
    """All cuts of a batch of words over the entries, as arcs between the places of the words.

    A word of n letters has places 0 to n + 1, for a space sign stands before it. One more row of a
    table of probabilities stands for any letter that is no entry; it is the same in all languages.
    """

    def __init__(self, entries: dict[str, int]):
        import ahocorasick

        self.size = len(entries) + 1
        self.letters = {p for p in entries if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        self.longest = max(map(len, entries), default=1)
        for p, k in entries.items():
            self.automaton.add_word(p, (k << 16) + len(p))
        if entries:
            self.automaton.make_automaton()

    def arcs(self, words: list[str]) -> dict[str, np.ndarray]:
        joined = SPACE + SPACE.join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64).reshape(-1, 2) if self.size > 1 else np.zeros((0, 2), np.int64)
        own = np.repeat(np.arange(len(words)), lengths)
        strange = [ord(c) for c in set(joined) if c not in self.letters]
        at = np.flatnonzero(np.isin(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4"), strange)) if strange else np.zeros(0, np.int64)
        stop = np.concatenate((found[:, 0], at)) + 1
        width = np.concatenate((found[:, 1] & 0xFFFF, np.ones(len(at), np.int64)))
        entry = np.concatenate((found[:, 1] >> 16, np.full(len(at), self.size - 1)))
        word = own[stop - 1]
        return {"stop": stop + word, "start": stop - width + word, "level": stop - starts[word], "width": width, "entry": entry, "first": starts + np.arange(len(words)), "length": lengths, "word": word}

    def scores(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """Logarithms of the words' probabilities (words x languages)."""
        a = self.arcs(words)
        order = np.lexsort((a["stop"], a["level"]))
        start, stop, level, entry = (a[k][order] for k in ("start", "stop", "level", "entry"))
        alpha = np.zeros((int(a["length"].sum()) + len(words), table.shape[1]))
        alpha[a["first"]] = 1.0
        total = np.zeros((len(words), table.shape[1]))
        edges = np.searchsorted(level, np.arange(1, int(a["length"].max()) + 2))
        for e in range(len(edges) - 1):
            lo, hi = edges[e], edges[e + 1]
            to = stop[lo:hi]
            heads = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
            alpha[to[heads]] = np.add.reduceat(alpha[start[lo:hi]] * table[entry[lo:hi]], heads, axis=0)
            if e % 8 == 7:  # keep the numbers in range; entries reach back `longest` places at most
                live = np.flatnonzero(a["length"] >= e + 1)
                here = a["first"][live] + e + 1
                scale = alpha[here].copy()
                for back in range(min(self.longest, e + 1) + 1):
                    alpha[here - back] /= scale
                total[live] += np.log(scale)
        return np.log(alpha[a["first"] + a["length"]]) + total

    def expected(self, words: list[str], times: np.ndarray, rounds: int) -> np.ndarray:
        """Entry probabilities after some rounds of expectation maximisation.

        A long word's arcs are all multiplied by one number a letter, which its expected uses don't depend on.
        """
        by_length = sorted(range(len(words)), key=lambda k: len(words[k]))
        words, times = [words[k] for k in by_length], times[by_length]
        parts = []
        for k in range(0, len(words), CHUNK):
            a = {n: v.astype(np.int32) for n, v in self.arcs(words[k : k + CHUNK]).items()}
            ways = []
            for level, other in ((a["level"], a["stop"]), (a["width"] - a["level"], a["start"])):
                by = np.lexsort((other, level)).astype(np.int32)
                cuts = np.flatnonzero(np.concatenate(([True], np.diff(level[by]) != 0, [True])))
                ways.append((by, cuts))
            del a["level"]
            parts.append((a, ways, times[k : k + CHUNK], words[k : k + CHUNK] if len(words[min(k + CHUNK, len(words)) - 1]) > LONG else None))
        weights = np.full(self.size, 1.0 / self.size)
        for _ in range(rounds):
            counts = np.full(self.size, FLOOR)
            for a, ways, seen, long in parts:
                chance = weights[a["entry"]]
                if long:
                    each = np.exp(-self.scores(long, weights[:, None])[:, 0] / a["length"])
                    chance = chance * each[a["word"]] ** a["width"]
                n = int(a["length"].sum()) + len(seen)
                last = a["first"] + a["length"]
                alpha, beta = np.zeros(n), np.zeros(n)
                alpha[a["first"]] = 1.0
                beta[last] = 1.0
                for (by, cuts), mass, came, went in ((ways[0], alpha, a["start"], a["stop"]), (ways[1], beta, a["stop"], a["start"])):
                    for lo, hi in zip(cuts, cuts[1:]):
                        k = by[lo:hi]
                        np.add.at(mass, went[k], mass[came[k]] * chance[k])
                with np.errstate(all="ignore"):
                    use = alpha[a["start"]] * chance * beta[a["stop"]] * (seen / alpha[last])[a["word"]]
                counts += np.bincount(a["entry"], np.nan_to_num(use, nan=0.0, posinf=0.0), self.size)
            counts[-1] = 0.0
            weights = counts / counts.sum()
            weights[-1] = STRANGE
        return weights


class Model(NamedTuple):
    """Languages in order, probabilities (entries and the rest row x languages), the entries' rows, and
    nats a letter and their standard deviation a word (2 x languages)."""

    langs: list[str]
    table: np.ndarray
    entries: dict[str, int]
    typical: np.ndarray


def fit(words: Iterable[tuple[str, list[str], list[int]]], entries: dict[str, int]) -> Model:
    """From language, its words and their counts, in order of language."""
    cuts = Segmentations(entries)
    langs, cols, typical = [], [], []
    for lang, own, times in words:
        langs.append(lang)
        n, letters = np.array(times, float), np.array([len(w) + 1.0 for w in own])
        cols.append(cuts.expected(own, n, ROUNDS) if own else np.full(cuts.size, 1.0 / cuts.size))
        nats = -np.concatenate([cuts.scores(own[k : k + CHUNK], cols[-1][:, None])[:, 0] for k in range(0, len(own), CHUNK)] or [np.zeros(0)])
        mean = (n * nats).sum() / (n * letters).sum() if own else 1.0
        typical.append((mean, np.sqrt((n * (nats - mean * letters) ** 2).sum() / n.sum()) if own else 1.0))
    return Model(langs, np.stack(cols, axis=1) if cols else np.zeros((cuts.size, 0)), entries, np.array(typical).reshape(-1, 2).T)


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n: counts within each task are summed before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("langid")
        for batch in (b.slice(at, 128) for b in batches for at in range(0, b.num_rows, 128)):
            counts: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts.setdefault(lang, Counter()).update(words_of(text.as_py()))
            rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "word", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def held_out_column():
    """Documents that training must not see."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, model_file: str) -> Model:
    """Fits on a bounded sample of rows with a label that aren't held out."""
    usable = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out_column())
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # a row for each language
    entries = vocabulary(model_file)
    if not sizes:
        return fit([], entries)
    most = min(SAMPLE, -(-SAMPLE_ALL // len(sizes)))
    share = docs.sparkSession.createDataFrame([(lang, min(1.0, most / n)) for lang, n in sizes.items()], "lang string, share double")
    draw = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    counts = word_counts(usable.join(F.broadcast(share), "lang").where(draw < F.col("share")))
    rows = materialize(counts, "words").orderBy("lang", "word")

    def by_language() -> Iterator[tuple[str, list[str], list[int]]]:
        for lang, group in groupby(rows.toLocalIterator(), key=lambda r: r["lang"]):
            own = [(r["word"], r["n"]) for r in group]
            yield lang, [w for w, _ in own], [n for _, n in own]

    model = fit(by_language(), entries)
    worker.give_back()
    return model


def predict(docs: DataFrame, model: Model, names: tuple[str, str, str] = ("lang_pred", "score", "strangeness")) -> DataFrame:
    """docs' columns with the language, its score and the text's strangeness, under names that docs doesn't use."""
    # vocabulary x languages numbers: bounded, whatever the corpus
    shared = docs.sparkSession.sparkContext.broadcast(model)

    from pyspark.sql.types import DoubleType, StringType, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("langid")
        langs, table, entries, typical = shared.value
        cuts = Segmentations(entries)
        place: dict[str, int] = {}
        scores = np.zeros((WORDS_KEPT, max(1, len(langs))))
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            preds, certain, strange = [], [], []
            texts = [words_of(text.as_py()) if langs else [] for text in batch.column("text")]
            distinct = set().union(*texts)
            new = sorted(distinct.difference(place), key=len)
            if len(place) + len(new) > len(scores):
                place.clear()
                new = sorted(distinct, key=len)
                if len(new) > len(scores):
                    scores = np.zeros((len(new), len(langs)))
            for k in range(0, len(new), 4096):
                part = new[k : k + 4096]
                scores[len(place) : len(place) + len(part)] = cuts.scores(part, table)
                place.update(zip(part, range(len(place), len(place) + len(part))))
            for words in texts:
                if not words:
                    preds.append("und"), certain.append(0.0), strange.append(0.0)
                    continue
                own = scores[np.fromiter(map(place.__getitem__, words), np.int64, len(words))].sum(axis=0)
                letters = sum(map(len, words))
                best = int(own.argmax())
                mean, spread = typical[:, best]
                strange.append(max(0.0, float(-own[best] - SLACK * spread * len(words) ** 0.5) / (letters + len(words)) / mean))
                own = (own - own[best]) * (min(letters, EVIDENCE) / letters)
                preds.append(langs[best]), certain.append(float(1.0 / np.exp(own).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(preds, pa.string()), pa.array(certain, pa.float64()), pa.array(strange, pa.float64())], [*batch.schema.names, *names])

    schema = StructType([f for f in docs.schema.fields]).add(names[0], StringType()).add(names[1], DoubleType()).add(names[2], DoubleType())
    return short_batches(docs).mapInArrow(run, schema)


def identify(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document's whole text."""
    model = train(docs, model_file)
    return predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).select("doc_id", held_out_column().alias("held_out"), "lang_pred", "score")
