"""Lengths of greedy longest-match word pieces, without building the pieces.

A trie over the vocabulary has failure links: where no child fits, the link leads to the place
that the text reaches once the longest tokens on the way are taken off, and each node knows how
many tokens that takes off. One pass over a word's characters then gives its number of tokens.

Vocabulary: the normal entries of a public sentencepiece model, which is a BPE one, for no word-piece
vocabulary is supplied. Entries with the space sign begin
words, the others continue them. Words are runs without white space. A word of which some part
matches no entry counts as one unknown token.

Defined results: null and empty texts have no words; very long words take time in proportion to
their length, and so do very long texts; repeated rows give repeated results; other columns aren't
looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: Words whose lengths a worker remembers; beyond it the memory is emptied, never the result changed.
WORDS_KEPT = 400_000


class LongestMatch:
    """The automaton. Node 0 begins words, node 1 stands between the tokens of a word."""

    def __init__(self, first: Iterable[str], later: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        self.fail: list[int] = [-1, -1]
        self.popped: list[int] = [0, 0]
        ends: set[int] = set()
        for root, entries in ((0, first), (1, later)):
            for entry in entries:
                node = root
                for ch in entry:
                    child = self.next[node].get(ch)
                    if child is None:
                        child = self.next[node][ch] = len(self.next)
                        self.next.append({})
                        self.fail.append(-1)
                        self.popped.append(0)
                    node = child
                if node != root:
                    ends.add(node)
        level = [0, 1]
        while level:  # breadth first: a link leads to a shorter string
            below = []
            for parent in level:
                for ch, node in self.next[parent].items():
                    below.append(node)
                    if node in ends:
                        self.fail[node], self.popped[node] = 1, 1
                        continue
                    count, place = self.popped[parent], self.fail[parent]
                    while place >= 0 and ch not in self.next[place]:
                        count, place = count + self.popped[place], self.fail[place]
                    if place >= 0:
                        self.fail[node], self.popped[node] = self.next[place][ch], count
            level = below

    def length(self, word: str) -> int:
        """Tokens of a word; -1 if some part of it matches no entry."""
        following, fail, popped = self.next, self.fail, self.popped
        node, count = 0, 0
        for ch in word:
            child = following[node].get(ch)
            while child is None:
                count += popped[node]
                node = fail[node]
                if node < 0:
                    return -1
                child = following[node].get(ch)
            node = child
        while node != 1:
            count += popped[node]
            node = fail[node]
            if node < 0:
                return -1
        return count


@cache
def automaton(model_file: str) -> LongestMatch:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    entries = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return LongestMatch((p[1:] for p in entries if p[0] == SPACE and len(p) > 1), (p for p in entries if SPACE not in p))


def count_tokens(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_words, n_tokens (an unknown word counts as one), n_unknown of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = automaton(model_file).length
        known: dict[str, int] = {}
        for batch in batches:
            words_out, tokens_out, unknown_out = [], [], []
            for text in batch.column(1):
                words = (text.as_py() or "").split()
                if len(known) > WORDS_KEPT:
                    known.clear()
                for w in set(words).difference(known):
                    known[w] = length(w)
                lengths = [known[w] for w in words]
                unknown = lengths.count(-1)
                words_out.append(len(words))
                tokens_out.append(sum(lengths) + 2 * unknown)
                unknown_out.append(unknown)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words_out, tokens_out, unknown_out))], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
