"""Packing of documents into sequences of bounded length, best-two-fit.

A sequence is filled greedily: the longest piece that fits comes next. Then its smallest piece is
replaced by two unpacked ones if they fill the gap that its removal leaves more tightly.

Only lengths matter for that, and there are at most `capacity` of them. So the plan is made over
the histogram of lengths: while the counts last, the next sequence looks like the one before, and
a run of equal sequences is one step. The steps are bounded by the capacity, not by the corpus.
Each step claims, for each place in its sequences, an interval of ranks among the pieces of one
length. The pieces then find their places by their rank, which is counted in groups, as many as the
length's count asks for, so that no length gathers in one task.

Defined results: null text counts as empty and is packed as its end mark alone; no piece is dropped
or cut short; repeated rows are packed as often as they occur; among pieces of equal length places
go by a salt and doc_id, ties are equal rows; a very long text is tokenized in one task, at a multiple
of its length; an empty table gives no rows; other columns aren't looked at.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm import worker
from quarryline.sources.scratch import materialize
from quarryline.sources.tables import short_batches

END = b"\0\0\0\0"
#: Units whose ids a worker remembers, in two generations; beyond it older ones are forgotten, never the result changed.
WORDS_KEPT = 180_000
#: Pieces of one length that are ranked together, about; more if a length would have more than MOST_GROUPS such groups.
GROUP, MOST_GROUPS = 256, 1 << 16


#: What the tokenizer's pattern cuts a lower-cased Latin-1 text into. The pattern's own order.
UNITS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼-¾]+")


class WordIds:
    """ids of texts by a tokenizer that lower-cases, drops white space and never joins across its pattern's units.

    Latin-1 texts are cut into units here and each unit's ids are remembered; other texts, and those
    that may hold the tokenizer's own marks, go to the tokenizer whole.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        """Encodes units, many in a line; a unit's last token is one that ends words."""
        for k in range(0, len(new), 64):
            part = new[k : k + 64]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part):
                data, at = ids.tobytes(), 0
                for word, stop in zip(part, (stops * 4).tolist()):
                    self.words[word] = data[at:stop]
                    at = stop
            else:
                for word in part:
                    self.words[word] = self.whole(word)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit numbers, with the end mark."""
        out: list[bytes | None] = []
        split, places = [], []
        for text in texts:
            if any(m in text for m in self.marks) or not (text.isascii() or _latin(text)):
                out.append(self.whole(text) + END)
            else:
                places.append(len(out))
                out.append(None)
                split.append(UNITS.findall(text.lower()))
        if len(self.words) > WORDS_KEPT:
            self.words, self.older = {}, self.words
        words, older = self.words, self.older
        new = []
        for word in set(chain.from_iterable(split)).difference(words):
            if (ids := older.get(word)) is None:
                new.append(word)
            else:
                words[word] = ids
        self._learn(new)
        for k, units in zip(places, split):
            out[k] = b"".join(map(words.__getitem__, units)) + END
        return out


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@cache
def word_ids(tokenizer_file: str) -> WordIds:
    return WordIds(tokenizer_file)


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document with its end mark; only those longer than capacity are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("packing", word_ids.cache_clear)
        encode = word_ids(tokenizer_file)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encode([x or "" for x in part.column(1).to_pylist()])):
                    for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[start : start + 4 * capacity]
                        rows.append((doc_id, k, start // 4, len(own) // 4, zlib.crc32(own)))
                cols = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return short_batches(docs).selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Steps (lengths in a sequence, number of such sequences) that use up the counts of lengths 1 to capacity."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    at = np.arange(capacity + 1)
    steps = []
    while left.any():
        have = left.copy()
        longest = np.maximum.accumulate(np.where(have > 0, at, 0))  # the longest there is up to each length
        own: list[int] = []
        gap = capacity
        while gap and (length := int(longest[gap])):
            k = min(int(have[length]), gap // length)
            own += [length] * k
            gap -= k * length
            have[length] -= k
            if not have[length]:
                longest = np.maximum.accumulate(np.where(have > 0, at, 0))
        if gap and len(own) > 1:
            least = own[-1]
            room = gap + least
            a = np.flatnonzero(have[: room + 1])
            b = longest[room - a]
            alone = (b == a) & (have[a] < 2)
            shorter = np.where(a > 0, longest[np.maximum(a - 1, 0)], 0)
            b = np.where(alone, np.minimum(shorter, longest[room - a]), b)
            fill = np.where(b > 0, a + b, 0)
            if len(a) and (best := int(fill.argmax())) >= 0 and fill[best] > least:
                own[-1:] = [int(a[best]), int(b[best])]
        need = np.bincount(own, minlength=capacity + 1)
        used = np.flatnonzero(need)
        times = int((left[used] // need[used]).min())
        steps.append((own, times))
        left -= need * times
    return steps


def places(steps: list[tuple[list[int], int]]) -> dict[int, tuple[list[int], list[int], list[int]]]:
    """For each length, the rank at which each interval begins, the sequence of its first piece, and the offset."""
    out: dict[int, tuple[list[int], list[int], list[int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for own, times in steps:
        offset = 0
        for length in own:
            ranks, sequences, offsets = out.setdefault(length, ([], [], []))
            ranks.append(taken.get(length, 0))
            sequences.append(sequence)
            offsets.append(offset)
            taken[length] = taken.get(length, 0) + times
            offset += length
        sequence += times
    return out


def pack_pieces(table: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length (1 to capacity)."""
    counts = {r["length"]: r["count"] for r in table.groupBy("length").count().collect()}  # at most capacity rows
    by_length = places(best_two_fit(counts, capacity))
    keys = ["length", "salt"]
    groups = {n: min(MOST_GROUPS, -(-c // GROUP)) for n, c in counts.items()}
    several = F.create_map(*[F.lit(x).cast("long") for n, g in groups.items() if g > 1 for x in (n, g)] or [F.lit(0).cast("long"), F.lit(1).cast("long")])
    salts = F.coalesce(F.try_element_at(several, F.col("length")), F.lit(1).cast("long"))
    dealt = table.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), salts))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy(*keys).orderBy("doc_id", "piece", *[c for c in table.columns if c not in ("doc_id", "piece", "length")])
    ranked = dealt.withColumn("rank", F.row_number().over(order) - 1).join(bases.hint("merge"), keys)
    ranked = ranked.select(*table.columns, (F.col("rank") + F.col("base")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("packing", word_ids.cache_clear)
        for batch in batches:
            where = [by_length[n] for n in batch.column("length").to_pylist()]
            ranks = batch.column("rank").to_pylist()
            found = [bisect_right(w[0], r) - 1 for w, r in zip(where, ranks)]
            sequence = [w[1][k] + r - w[0][k] for w, k, r in zip(where, found, ranks)]
            offset = [w[2][k] for w, k in zip(where, found)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*batch.schema.names[:-1], "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructType

    schema = StructType(list(table.schema.fields)).add("sequence_id", LongType()).add("offset", LongType())
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = 2048) -> DataFrame:
    """Tokenizes, cuts and packs whole documents. The pieces are written once, for they are read three times."""
    return pack_pieces(materialize(pieces(docs, tokenizer_file, capacity), "pieces", lasting=True), capacity)
