import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from quarryline.llm import packing  # noqa: E402
from quarryline.llm.packing import WordIds, best_two_fit, pack_documents, places  # noqa: E402
from quarryline.llm.pieces import PrefixTableEncoder, encode_texts  # noqa: E402
from quarryline.llm.wordpiece import LongestMatch, count_tokens  # noqa: E402

MODEL, WORDS = P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")
EDGES = ["", " ", "   a  b ", "▁x", "foo\nbar", "\n\n", "日本語 é́", "<s></s><0x0A>", "\x00", "\x01  \n x.\x01 a.b", "a.b, c.", "x" * 3000, "🙂  🙂", " " * 40 + "the"]
SCHEMA = "doc_id long, text string, n_tokens string, ids long"


def texts(n=300, seed=1):
    rnd = random.Random(seed)
    return EDGES + ["".join(rnd.choice(["the ", "ing", "er", " ", "\n", "é", "🙂", "a", "zz", "▁", ".", ",", "\x01"]) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def test_prefix_table_equals_library():
    encoder = PrefixTableEncoder(MODEL)
    pieces = list(encoder.ids)
    rnd = random.Random(2)
    for text in texts() + ["".join(rnd.choice(pieces) for _ in range(8)) for _ in range(500)]:
        ids, said = encoder.encode(text)
        assert ids == encoder.processor.encode(text), text
        assert said == ",".join(map(str, ids))


def test_prefix_table_cuts_marks_only_where_no_entry_joins_them():
    encoder = PrefixTableEncoder(MODEL)
    same = lambda text: encoder.encode(text)[0] == encoder.processor.encode(text)
    assert encoder.encode("².")[0] == encoder.processor.encode("².") == [28705, 20110]
    assert all(map(same, ["a².", "10 m². Next", "m²,", "x²!"]))
    latin = [chr(c) for c in range(1, 256)]
    assert all(same(a + b) for a in latin for b in latin)
    assert all(same(c + mark + "a " + c + mark) for c in {c for p in encoder.ids for c in p} for mark in ".,!?;:")


def test_encode_a_very_long_text(spark):
    text = "the cat². sat   on " * 30_000 + "x" * 50_000
    sp = PrefixTableEncoder(MODEL).processor
    got = encode_texts(spark.createDataFrame([(1, text, "x", 0)], SCHEMA), MODEL).first()
    assert got.n_tokens == len(sp.encode(text))


def test_encode_rows(spark):
    rows = [(1, None, "x", 0), (2, "", "x", 0), (3, "the cat", "x", 0), (3, "the cat", "x", 0)]
    got = encode_texts(spark.createDataFrame(rows, SCHEMA), MODEL).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [0, 0, 2, 2]
    assert encode_texts(spark.createDataFrame([], SCHEMA), MODEL).count() == 0


def test_word_ids_equal_tokenizer():
    ids = WordIds(WORDS)
    for text in texts() + ["can't <|endoftext|> x", "Σ'S İ", "\x1c½²"]:
        want = np.asarray(ids.tokenizer.encode(text, add_special_tokens=False).ids + [0], "<u4").tobytes()
        assert ids([text])[0] == want, text


@pytest.mark.parametrize("seed", range(6))
def test_best_two_fit_packs_everything(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 64, 500])
    counts = {n: rnd.randint(1, 30) for n in rnd.sample(range(1, capacity + 1), min(capacity, 9))}
    steps = best_two_fit(counts, capacity)
    used: dict = {}
    for own, times in steps:
        assert sum(own) <= capacity
        for n in own:
            used[n] = used.get(n, 0) + times
    assert used == counts
    total = sum(n * c for n, c in counts.items())
    assert sum(t for _, t in steps) <= 1.25 * -(-total // capacity) + 2
    assert all(ranks == sorted(ranks) for ranks, _, _ in places(steps).values())


def piece_by_piece(counts, capacity):
    """Best-two-fit with a list of pieces, one sequence after the other."""
    left = sorted((n for n, c in counts.items() for _ in range(c)), reverse=True)
    out = []
    while left:
        own, gap = [], capacity
        for n in list(left):
            if n <= gap:
                own.append(n)
                left.remove(n)
                gap -= n
        if gap and len(own) > 1:
            least, room = own[-1], gap + own[-1]
            fills = [(left[i] + left[j], -min(left[i], left[j])) for i in range(len(left)) for j in range(i) if left[i] + left[j] <= room]
            if fills and max(fills)[0] > least:
                total, low = max(fills)
                own[-1:] = [-low, total + low]
                left += [least]
                left.remove(-low)
                left.remove(total + low)
                left.sort(reverse=True)
        out.append(sorted(own))
    return out


@pytest.mark.parametrize("seed", range(60))
def test_best_two_fit_equals_piece_by_piece(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([7, 12, 30, 100])
    counts = {n: rnd.randint(1, 7) for n in rnd.sample(range(1, capacity + 1), min(capacity, rnd.randint(1, 9)))}
    assert [sorted(own) for own, times in best_two_fit(counts, capacity) for _ in range(times)] == piece_by_piece(counts, capacity)


def test_best_two_fit_replaces_the_smallest():
    assert best_two_fit({7: 1, 2: 1, 1: 2}, 10)[0] == ([7, 2, 1], 1)
    assert best_two_fit({6: 1, 3: 3}, 10)[0][0] == [6, 3]
    own, _ = best_two_fit({50: 1, 30: 1, 25: 1, 24: 1}, 100)[0]
    assert sorted(own) == [24, 25, 50]


@pytest.mark.parametrize("group", [4096, 2])
def test_pack_documents(spark, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP", group)
    rows = [(i, ("word " * (i * 37 % 900)).strip() if i % 5 else None, "x", i) for i in range(60)] + [(7, "same", "x", 1)] * 3 + [(None, "no id", "x", 1), (99, "long " * 5000, "x", 1)]
    got = pack_documents(spark.createDataFrame(rows, SCHEMA), WORDS).collect()
    ids = WordIds(WORDS)
    want = []
    for doc_id, text, *_ in rows:
        data = ids([text or ""])[0]
        want += [(doc_id, k, s // 4, len(data[s : s + 8192]) // 4, zlib.crc32(data[s : s + 8192])) for k, s in enumerate(range(0, len(data), 8192))]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    at: dict = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert at.get(r.sequence_id, 0) == r.offset
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 2048 and len(at) <= 1.1 * sum(at.values()) / 2048 + 1
    assert pack_documents(spark.createDataFrame([], SCHEMA), WORDS).count() == 0


def greedy(word, first, later):
    i = n = 0
    while i < len(word):
        j = len(word)
        while j > i and word[i:j] not in (later if i else first):
            j -= 1
        if j == i:
            return -1
        n, i = n + 1, j
    return n


def test_longest_match_equals_greedy():
    rnd = random.Random(4)
    for _ in range(400):
        first, later = ({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(0, 6))} for _ in range(2))
        automaton = LongestMatch(first, later)
        for _ in range(8):
            word = "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 9)))
            assert automaton.length(word) == greedy(word, first, later)


def test_count_tokens(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    entries = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    first, later = {p[1:] for p in entries if p[0] == "▁" and len(p) > 1}, {p for p in entries if "▁" not in p}
    rows = [(i, t, "x", 0) for i, t in enumerate(texts(60))] + [(-1, None, "x", 0)]
    for r in count_tokens(spark.createDataFrame(rows, SCHEMA), MODEL).collect():
        words = (dict((a, b) for a, b, *_ in rows)[r.doc_id] or "").split()
        lengths = [greedy(w, first, later) for w in words]
        assert (r.n_words, r.n_unknown, r.n_tokens) == (len(words), lengths.count(-1), sum(n if n > 0 else 1 for n in lengths))


def test_count_tokens_of_odd_rows(spark):
    rows = [(1, "the cat", "x", 0)] * 2 + [(2, "", "x", 0), (3, "the " * 100_000, "x", 0), (None, "the", "x", 0)]
    got = sorted((r.doc_id or 0, r.n_words, r.n_tokens, r.n_unknown) for r in count_tokens(spark.createDataFrame(rows, SCHEMA), MODEL).collect())
    assert got == [(0, 1, 1, 0), (1, 2, 2, 0), (1, 2, 2, 0), (2, 0, 0, 0), (3, 100_000, 100_000, 0)]
    assert count_tokens(spark.createDataFrame([], SCHEMA), MODEL).count() == 0
