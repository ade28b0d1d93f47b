import hashlib
import math
import random
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from quarryline.llm import imatch

SCHEMA = "doc_id long, text string, own long, next string"


@pytest.mark.parametrize(("size", "quantiles"), [(1024, 4096), (20, 4096), (20, 4)])
def test_edited_texts_and_likeness(spark, monkeypatch, size, quantiles):
    """With one range, with ranges between quantiles, and with ranges that cut the gaps; one doc_id lies far out."""
    monkeypatch.setattr(imatch, "RANGE", size)
    monkeypatch.setattr(imatch, "QUANTILES", quantiles)
    rnd = random.Random(2)
    words = [f"wörd{k}" for k in range(4000)]
    rows = [(k * 3 - 50, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 8, 90, 400]))), 1, "n") for k in range(600)]
    rows += [(10_000 + k, rows[k][1], 1, "n") for k in range(60)] + [(90_000, None, 1, "n"), (1 << 62, "far out", 1, "n"), (-(1 << 62), "far below", 1, "n")]
    random.Random(3).shuffle(rows)
    got = {r.doc_id: r for r in imatch.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    order = sorted(((d, t or "") for d, t, *_ in rows), reverse=True)
    prints: dict = {}
    for k, (doc, text) in enumerate(order):
        following, half = order[(k + 1) % len(order)], len(text) // 2
        edited = text[: len(text) - half] + following[1][:half]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        prints.setdefault(text, set()).add(r.fingerprint)
        prints.setdefault(edited, set()).add(r.edited_fingerprint)
        assert r.near_next == likeness(r.fingerprint, got[following[0]].fingerprint)
        assert r.near_edited == likeness(r.fingerprint, r.edited_fingerprint)
    assert all(len(x) == 1 for x in prints.values())
    long = [r for r in got.values() if r.n_chars > 500]
    assert sum(r.near_edited for r in long) > 5 * sum(r.near_next for r in long)


def likeness(a, b):
    x, y = ({p[k : k + 8] for k in range(0, len(p), 8)} for p in (a, b))
    if x == y:
        return 1.0
    if min(p[:2] for p in x) >= "c0" or min(p[:2] for p in y) >= "c0":
        return 0.0
    return len(x & y) / len({p[:2] for p in x | y})


def signed(n, bits=64):
    return n - (1 << bits) if n >> (bits - 1) else n


def hashed(*values):
    """Spark's xxhash64 of strings, longs (given as ("l", n)) and ints."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<q", v[1]) if isinstance(v, tuple) else struct.pack("<i", v)
        seed = xxhash.xxh64_intdigest(data, seed)
    return signed(seed)


def plain_fingerprint(words, lexicon):
    """Subsets and parts, term by term."""
    marks = set()
    for w in words & lexicon:
        h = hashed(w)
        for k, rate in enumerate(imatch.RATES):
            if (d := hashed(("l", h), k) % rate) < imatch.SUBSETS:
                marks.add((d + k * imatch.SUBSETS) << imatch.BITS | (h & (1 << 64) - 1) >> (64 - imatch.BITS))
    parts = {}
    for m in sorted(marks):
        code = m >> imatch.BITS
        parts[code] = hashed(("l", parts[code]), m) if code in parts else hashed(m)
    return "".join(f"{code << 24 | h & 0xFFFFFF:08x}" for code, h in parts.items())


def test_lexicon_and_parts_equal_plain_python(spark):
    rnd = random.Random(6)
    words = [f"t{k}" for k in range(120)]
    rows = [(k, " ".join(rnd.choice(words) for _ in range(12)), 1, "n") for k in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    df = Counter(w for r in rows for w in set(r[1].split()))
    inside = {w for w in words if df[w] and 2.0 <= math.log(len(rows) / df[w]) < 3.0}
    assert {r.term for r in imatch.lexicon(docs, len(rows), (2.0, 3.0)).select("term").distinct().collect()} == {hashed(w) for w in inside}
    got = {r.doc_id: r.fingerprint for r in imatch.fingerprints(docs, (2.0, 3.0)).collect()}
    made = {k: plain_fingerprint(set(text.split()), inside) for k, text, *_ in rows}
    assert sum(map(bool, made.values())) > 150
    assert all(got[k] == made[k] for k in made if made[k])


def test_equal_texts_whose_terms_meet_in_a_mark(spark):
    """Two terms share a subset and the bits of their hashes that a mark holds."""
    text = "q225814 alpha beta q415818"
    rows = [(300, text, 1, "n")] * 3 + [(400, text, 1, "n")] + [(k, f"filler{k} word{k}", 1, "n") for k in range(190)]
    got = [r.fingerprint for r in imatch.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect() if r.doc_id >= 300]
    assert len(got) == 4
    assert len(set(got)) == 1


def test_an_id_with_many_rows(spark, monkeypatch):
    """Its rows are cut by the tie, and each row's next is the one behind it in the order of that."""
    monkeypatch.setattr(imatch, "RANGE", 10)
    rows = [(7, f"text number {k}", 1, "n") for k in range(200)] + [(k, "other", 1, "n") for k in (3, 9)]
    docs = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text")
    quantiles, cuts = imatch.borders(docs, len(rows))
    tie = F.xxhash64("text")
    got = imatch.with_next(docs, imatch.in_range(quantiles, cuts, tie), "text", "next", tie).collect()
    order = sorted(((-d, hashed(t), t) for d, t, *_ in rows))
    want = Counter((t, order[(k + 1) % len(order)][2]) for k, (_, _, t) in enumerate(order))
    assert Counter((r.text, r.next) for r in got) == want
    ranges = docs.select(imatch.in_range(quantiles, cuts, tie).alias("r")).groupBy("r").count()
    assert ranges.agg(F.max("count")).first()[0] < 60


def test_lexicon_by_shuffle_is_the_same(spark, monkeypatch):
    rows = [(k, f"word{k % 9} other{k % 13} third{k % 17}", 1, "n") for k in range(120)]
    docs = spark.createDataFrame(rows, SCHEMA)
    sent = sorted(map(tuple, imatch.fingerprints(docs).collect()))
    monkeypatch.setattr(imatch, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, imatch.fingerprints(docs).collect())) == sent


def test_very_long_text(spark):
    rows = [(1, "long words of " * 50_000 + "x" * 100_000, 1, "n"), (2, "short one", 1, "n")]
    got = {r.doc_id: r for r in imatch.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].n_chars == len(rows[0][1])


def test_ties_nulls_repeats_empty(spark):
    rows = [(1, "same words here", 1, "n"), (1, "same words here", 1, "n"), (None, "no id", 1, "n"), (2, "", 1, "n")]
    got = imatch.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 4
    assert {r.near_next for r in got if r.doc_id is None} == {0.0}
    assert sorted(r.near_next for r in got if r.doc_id == 1) == [0.0, 1.0]
    assert imatch.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
