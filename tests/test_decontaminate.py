"""Runs of words shared with a benchmark: the bit array and the whole result, against plain Python."""

import random

import numpy as np

from quarryline.operators import decontaminate as D


def plain(docs, items, n):
    def grams(text):
        words = (text or "").lower().split()
        return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}

    given = {k: grams(t) for k, t in items}
    out = {}
    for d, t in docs:
        own = grams(t)
        shared = own & set().union(*given.values())
        if shared:
            out[d] = (len(shared), sum(bool(g & own) for g in given.values()))
    return out


def tables(n_docs=300):
    rnd = random.Random(3)
    text = lambda k: " ".join(rnd.choice("abcdefghijklmnopqrst") + rnd.choice("aeiou") for _ in range(k))
    items = [(k, text(rnd.choice([3, 20, 60]))) for k in range(40)] + [(90, None), (91, "")]
    docs = [(k, text(rnd.choice([0, 2, 30, 200]))) for k in range(n_docs)]
    for k in range(0, n_docs, 5):
        words = rnd.choice(items[:40])[1].split()
        at = rnd.randrange(len(words))
        docs[k] = (k, docs[k][1] + " " + " ".join(words[at : at + 9]).upper() + " " + text(5))
    return docs + [(1000, None), (1001, ""), (1002, items[1][1] * 3)], items


def test_equals_plain_python_and_hardly_more_is_shuffled(spark):
    docs, items = tables()
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string").repartition(3)
    wanted = plain(docs, items, 5)
    assert {r.doc_id: (r.shared, r.items) for r in D.overlaps(d, b, 5).collect()} == wanted and wanted
    runs, went_on = sum(max(0, len((t or "").split()) - 4) for _, t in docs), D.candidates(d, b, 5).count()
    matches = sum(s for s, _ in wanted.values())
    assert matches <= went_on <= matches + 0.02 * runs


def test_false_positives_and_no_false_negatives():
    rng = np.random.default_rng(1)
    held = rng.integers(0, 2**63, 50_000).astype(np.uint64)
    size = D.array_bits(len(held))
    assert size & (size - 1) == 0 and 16 <= size / len(held) <= 32
    bits = np.zeros(size // 64, np.uint64)
    for p in D.places(held, size):
        np.bitwise_or.at(bits, p >> np.uint64(6), np.uint64(1) << (p & np.uint64(63)))
    assert D.may_hold(bits, held).all()
    assert D.may_hold(bits, rng.integers(0, 2**63, 200_000).astype(np.uint64)).mean() < 0.005
    assert D.array_bits(1) == D.LEAST_BITS and D.array_bits(1 << 40) == D.MOST_BITS


def test_a_full_array_still_gives_right_results(spark, monkeypatch):
    monkeypatch.setattr(D, "MOST_BITS", 64)
    monkeypatch.setattr(D, "LEAST_BITS", 64)
    docs, items = tables(60)
    got = D.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 5)
    assert {r.doc_id: (r.shared, r.items) for r in got.collect()} == plain(docs, items, 5)


def test_empty(spark):
    docs, items = tables(10)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert D.overlaps(d, b.limit(0)).count() == 0 and D.overlaps(d.limit(0), b).count() == 0
