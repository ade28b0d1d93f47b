"""Subword encoding of a merge-type (BPE) sentencepiece model by a prefix table.

For each prefix of a word the encoding of that prefix ends in exactly one token. The table holds
that token: among the vocabulary entries that an automaton finds ending at a position, it is the
one that may follow the last token of the prefix before it. Whether two tokens may stand side by
side is decided by taking their merges back, latest first: if a merge across the boundary would
have come before the merge taken back, the pair can't occur. The ids are then read off backwards.

Word boundaries: no entry holds a space sign after another character, so the text is cut before
each space and a word's ids don't depend on its neighbours. Only runs of spaces join up; their
entries all have one score, so the leftmost merges go first and a run is cut into the longest
entries from the left. Line ends are cut likewise when no entry holds one, and punctuation after a
letter when no entry holds that letter with it behind.

Defined results: null text counts as empty; empty text has no ids; unknown characters become the
ids of their UTF-8 bytes; very long texts take time and memory in proportion to their length; repeated
rows give repeated results; other columns aren't looked at; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: Stands before a part that is cut off without a space.
CUT = "\x01"
#: Words whose ids a worker remembers, in two generations; beyond it older ones are forgotten, never the result changed.
WORDS_KEPT = 250_000
#: Cut off words where no entry joins them to the character before.
MARKS = ".,!?;:"
LETTER = re.compile(r"[^\W\d_]")


def cut_after_letters(joined: set[str]) -> re.Pattern:
    """Matches a mark after a letter (or a number that isn't decimal) if no entry holds that letter with that mark behind.

    joined: neighbouring characters of the entries. Some marks follow some letters there, as in `².`; such places aren't cut.
    """
    by_exception: dict[str, str] = {}
    for mark in MARKS:
        kept = "".join(sorted(x[0] for x in joined if x[1] == mark and LETTER.match(x[0])))
        by_exception[kept] = by_exception.get(kept, "") + mark
    return re.compile("|".join(rf"[{re.escape(marks)}](?<=[^\W\d_{re.escape(kept)}].)" for kept, marks in by_exception.items()))


class PrefixTableEncoder:
    """ids of texts under a sentencepiece model of merge type with byte fallback."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        self.processor = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.runs = {len(p): i for p, i in self.ids.items() if set(p) == {SPACE}}
        #: Merges happen in this order: by score, best first.
        self.order = {i: n for n, i in enumerate(sorted(plain, key=lambda i: (-sp.get_score(i), i)))}
        words = {p: i for p, i in self.ids.items() if not (len(p) > 1 and set(p) == {SPACE})}
        if any(SPACE in p[1:] for p in words):
            raise ValueError("an entry holds a space inside; words can't be encoded apart")
        self.piece = {i: p for p, i in words.items()}
        self.cut_lines = not any("\n" in p for p in words)
        self.apart = cut_after_letters({a + b for p in words for a, b in zip(p, p[1:])})
        self.automaton = ahocorasick.Automaton()
        for p, i in words.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.allowed: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[tuple[int, ...], str]] = {}
        self.older: dict[str, tuple[tuple[int, ...], str]] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes the token at last; itself twice for a character; None if merging never reaches it."""
        if token not in self.parts:
            text = self.piece[token]
            left = right = token
            have: list[str] = list(text)
            while len(have) > 1:
                ranked = [(self.order[self.ids[a + b]], k) for k, (a, b) in enumerate(zip(have, have[1:])) if a + b in self.ids and self.ids[a + b] in self.piece]
                if not ranked:
                    break
                k = min(ranked)[1]
                if len(have) == 2:
                    left, right = self.ids[have[0]], self.ids[have[1]]
                have[k : k + 2] = [have[k] + have[k + 1]]
            self.parts[token] = (left, right) if len(have) == 1 else None
        return self.parts[token]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging leaves the tokens a, b next to each other."""
        key = (a, b)
        known = self.allowed.get(key)
        if known is not None:
            return known
        ids, piece, order = self.ids, self.piece, self.order
        before = len(order) + 1  # a merge across the boundary counts if it comes before this one
        while True:
            joined = ids.get(piece[a] + piece[b])
            if joined in piece and order[joined] < before:
                good = False
                break
            whole_a, whole_b = len(piece[a]) == 1, len(piece[b]) == 1
            if whole_a and whole_b:
                good = True
                break
            # of equal entries the left one is merged first, so the right one is taken back first
            if whole_b or not whole_a and order[a] > order[b]:
                before, a = order[a], self.halves(a)[1]
            else:
                before, b = order[b] + 1, self.halves(b)[0]
        if len(self.allowed) > 2_000_000:
            self.allowed.clear()
        self.allowed[key] = good
        return good

    def encode_word(self, word: str) -> list[int]:
        """ids of a string without runs of spaces."""
        n = len(word)
        last: list[int] = [-1] * (n + 1)  # the token that ends at each place; -2: an unknown character
        begin = [0] * (n + 1)
        done = 0
        may_follow, halves, allowed = self.may_follow, self.halves, self.allowed
        for end, (size, token) in self.automaton.iter(word):
            end += 1
            while done < end - 1:  # no entry ended at these places
                done += 1
                if last[done] == -1:
                    last[done], begin[done] = -2, done - 1
            if last[end] != -1:
                continue
            done = max(done, end - 1)
            start = end - size
            before = last[start] if start else -1
            if before >= 0:
                fits = allowed.get((before, token))
                if fits is None:
                    fits = halves(token) is not None and may_follow(before, token)
            else:
                fits = halves(token) is not None
            if fits:
                last[end], begin[end] = token, start
        out: list[int] = []
        place = n
        while place:
            token = last[place]
            if token < 0:
                out.extend(self.bytes[b] for b in reversed(word[place - 1].encode("utf-8")))
                place -= 1
            else:
                out.append(token)
                place = begin[place]
        return out[::-1]

    def _word(self, key: str) -> tuple[tuple[int, ...], str]:
        out = self.older.get(key)
        if out is None:
            raw = key[1:] if key[:1] == CUT else key if key[:1] == "\n" and self.cut_lines else SPACE + key
            ids = self.encode_word(raw)
            out = (tuple(ids), ",".join(map(str, ids)))
        if len(self.words) >= WORDS_KEPT:
            self.words, self.older = {}, self.words
        self.words[key] = out
        return out

    def encode(self, text: str) -> tuple[list[int], str]:
        """The ids, and the same joined by commas."""
        if not text:
            return [], ""
        marks = "" if CUT in text else CUT + "\n" * self.cut_lines
        if not marks:  # rare: such a text is cut at spaces only
            keys = text.replace(SPACE, " ").split(" ")
            found = [(tuple(ids), ",".join(map(str, ids))) for ids in (self.encode_word(SPACE + k) for k in keys)]
        else:
            text = text.replace(SPACE, " ")
            if self.cut_lines:
                text = text.replace("\n", " \n")
            text = self.apart.sub(rf" {CUT}\g<0>", text)
            keys = text.split(" ")
            get, word = self.words.get, self._word
            found = [get(k) or word(k) for k in keys]
        if "" in keys:
            found = self._runs(keys, found, marks)
        return list(chain.from_iterable([x[0] for x in found])), ",".join([x[1] for x in found])

    def _runs(self, keys: list[str], found: list, marks: str) -> list:
        """Joins neighbouring lone spaces. marks: what keys begin with that no space precedes."""
        out, run, lone = [], 0, self.runs.get(1)
        most = max(self.runs)

        def flush() -> None:
            nonlocal run
            ids = []
            while run:
                k = min(run, most)
                while k not in self.runs:
                    k -= 1
                ids.append(self.runs[k])
                run -= k
            if ids:
                out.append((ids, ",".join(map(str, ids))))

        for key, (ids, said) in zip(keys, found):
            if key == "":
                run += 1
                continue
            if run and ids[0] == lone and key[0] not in marks:
                run += 1
                ids = ids[1:]
                said = ",".join(map(str, ids))
            flush()
            out.append((ids, said))
        flush()
        return out


@cache
def encoder(model_file: str) -> PrefixTableEncoder:
    """One encoder for each worker process and model."""
    return PrefixTableEncoder(model_file)


def encode_texts(docs: DataFrame, model_file: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row's whole text, and the ids on request."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(model_file)
        decode = model.processor.decode
        sha = hashlib.sha256
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, said = model.encode(text.as_py() or "")
                cols[0].append(len(ids))
                cols[1].append(sha(said.encode("ascii")).hexdigest())
                cols[2].append(sha(decode(ids).encode("utf-8")).hexdigest())
                if with_ids:
                    cols[3].append(ids)
            arrays = [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays.append(pa.array(cols[3], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, schema)
