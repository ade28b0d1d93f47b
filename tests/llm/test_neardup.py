import random
import re

import pytest

from quarryline.llm import neardup
from quarryline.llm.graph import components

SCHEMA = "doc_id long, text string, key string, n long"


def brute(rows):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = {}
    for doc_id, text, *_ in rows:
        w = word.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        sets[doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def corpus(seed=3):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows, doc = [], 0
    passage = [rnd.choice(words) for _ in range(60)]
    for _ in range(25):
        base = [rnd.choice(words) for _ in range(rnd.choice([6, 30, 80, 140, 700]))]
        for _ in range(rnd.randint(1, 12)):
            text = list(base)
            for _ in range(rnd.randint(0, 6)):
                text[rnd.randrange(len(text))] = rnd.choice(words)
            if rnd.random() < 0.3:
                text += passage
            rows.append((doc, " ".join(text), "k", 1))
            doc += 1
    rows += [(doc, None, "k", 1), (doc + 1, "", "k", 1), (doc + 2, " \n\t", "k", 1), (doc + 3, "One two", "k", 1), (doc + 4, "one\x0btwo", "k", 1), (doc + 5, "one two", "k", 1)]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    rnd = random.Random(1)
    rnd.shuffle(rows)
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("unsure", [1, 8])
def test_large_group_in_blocks_and_long_sets(spark, monkeypatch, unsure):
    for name, value in (("BLOCK", 3), ("CHUNK", 8), ("CARRIED", 100), ("UNSURE", unsure), ("UNSURE_GROWS", 2)):
        monkeypatch.setattr(neardup, name, value)
    rows = corpus(8)
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_a_bucket_with_one_foreign_member_isn_t_copied(spark):
    """Every member of a large component meets one outside it once, and that link is found."""
    words = [f"w{k}" for k in range(100)]
    docs = [(0, " ".join(words), "k", 1), *((k, " ".join(words[:-1] + [f"x{k}"]), "k", 1) for k in range(1, 900))]
    one = bytes(neardup.SIZE)
    signatures = spark.createDataFrame([(k, one, one) for k in range(900)], "id long, low binary, high binary")
    shared = spark.createDataFrame([(64, k) for k in range(900)], "key long, id long")
    labels = spark.createDataFrame([(k, 1) for k in range(2, 900)], "id long, component long")
    found = neardup.between_components(shared, labels, signatures, spark.createDataFrame(docs, SCHEMA), 8)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == 1 and got[0][0] == 0 and got[0][2:] == (True, False)


def test_very_long_texts(spark):
    text = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, text, "k", 1), (2, text + " more", "k", 1), (3, "x" * 500_000, "k", 1)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (59_996, 1), 2: (59_997, 1), 3: (1, 3)}


def test_repeats_nulls_and_empty(spark):
    rows = [(5, "a b c d e f", "k", 1), (5, "a b c d e f", "k", 1), (None, "a b c d e f", "k", 1), (3, "A B C D E F", "k", 1)]
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(-1, None, True), (3, 3, True), (5, 3, False), (5, 3, False)]
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 40])
def test_components(spark, n):
    rnd = random.Random(n)
    edges = [(k, k + 1) for k in range(n)] + [(rnd.randrange(100, 140), rnd.randrange(100, 140)) for _ in range(n)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {x: x for e in edges for x in e}
    for _ in range(len(parent) + 1):
        for u, v in edges:
            parent[u] = parent[v] = min(parent[u], parent[v])
    assert got == {k: v for k, v in parent.items() if k != v}


def test_pruning_keeps_what_reaches_the_threshold():
    levels = neardup.least_matches()
    assert levels[-1][0] == neardup.SIZE and all(m < 0.75 * n for n, m in levels)


def test_first_common_bucket_by_whole_values(spark):
    """Two sets whose band 0 agrees in the low bytes only are compared in band 1, the one bucket that they share."""
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, text, "k", 1), (2, text + " more", "k", 1)], SCHEMA)
    low, high = bytes(neardup.SIZE), bytearray(neardup.SIZE)
    high[: neardup.ROWS] = b"\1" * neardup.ROWS
    signatures = spark.createDataFrame([(1, low, bytes(neardup.SIZE)), (2, low, bytes(high))], "id long, low binary, high binary")
    shared = spark.createDataFrame([(64 + 1, 1), (64 + 1, 2)], "key long, id long")
    labels = spark.createDataFrame([], "id long, component long")
    assert [tuple(r) for r in neardup.between_components(shared, labels, signatures, docs, 8).collect()] == [(1, 2, True, False)]


def test_prefixes_meet_wherever_sets_are_linked():
    rnd = random.Random(5)
    for _ in range(4000):
        n, m = sorted((rnd.randint(1, 60), rnd.randint(1, 60)))
        order = rnd.sample(range(200), 200)
        x = set(rnd.sample(range(90), n))
        y = set(rnd.sample(sorted(x), min(n, rnd.randint(0, n)))) | set(rnd.sample(range(90, 200), m))
        small, large = sorted((x, y), key=len)
        if 100 * len(x & y) >= 75 * len(x | y):
            early = sorted(small, key=order.index)[: neardup.prefix_lengths(len(small))[1]]
            late = sorted(large, key=order.index)[: neardup.prefix_lengths(len(large))[0]]
            assert set(early) & set(late)


def alike(n, shared, own):
    """n texts that share a passage, each with words of its own after it."""
    return [(k, " ".join([f"w{j}" for j in range(shared)] + [f"x{k}:{j}" for j in range(own)]), "k", 1) for k in range(n)]


def test_members_just_below_the_threshold_leave_a_crowded_bucket(spark):
    """196 shared shingles of 240: 0.69 to each other. Only the pair that is linked stays."""
    rows = alike(300, 200, 44)
    rows.append((300, rows[7][1] + " more", "k", 1))
    docs = spark.createDataFrame(rows, SCHEMA)
    wanted = spark.createDataFrame([(k, k) for k in range(301)], "doc_id long, component long")
    assert {r.id for r in neardup.reachable(docs, wanted, 301).collect()} == {7, 300}
    same = spark.createDataFrame([(k, 0 if k == 300 else k if k != 7 else 0) for k in range(301)], "doc_id long, component long")
    assert neardup.reachable(docs, same, 301).isEmpty()


@pytest.mark.parametrize("slots", [1, 1 << 20])
def test_reachable_keeps_every_link(spark, monkeypatch, slots):
    monkeypatch.setattr(neardup, "SLOTS", slots)
    rows = [r for r in corpus(11) if r[1] and r[1].strip()]
    docs = spark.createDataFrame(rows, SCHEMA)
    wanted = spark.createDataFrame([(r[0], r[0]) for r in rows], "doc_id long, component long")
    near = {r.id for r in neardup.reachable(docs, wanted, len(rows)).collect()}
    sets = {r[0]: neardup.shingles(r[1]) for r in rows}
    linked = {a for a in sets for b in sets if a != b and neardup.linked(sets[a], sets[b])}
    assert linked and linked <= near


@pytest.mark.parametrize("own", [44, 24])
def test_crowded_bucket_by_element_numbers(spark, monkeypatch, own):
    """Unlinked and linked ones of many, compared by numbers of elements."""
    for name, value in (("BLOCK", 16), ("CHUNK", 64), ("MANY", 2)):
        monkeypatch.setattr(neardup, name, value)
    rows = alike(120, 200, own)
    rnd = random.Random(own)
    for k in range(0, 120, 3):  # words changed inside the shared part, so that prefixes meet
        w = rows[k][1].split()
        for _ in range(3):
            w[rnd.randrange(200)] = f"y{rnd.randrange(9)}"
        rows[k] = (k, " ".join(w), "k", 1)
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_numbered_sets():
    import numpy as np

    sets = [np.array([3, 9], np.uint64), None, np.array([9], np.uint64)]
    table, none = neardup.numbered(sets)
    assert table.tolist() == [[0, 1], [2, 2], [1, 2]] and none == 2
    assert neardup.numbered([None])[0].shape == (1, 0)
