import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from quarryline.llm import periods
from quarryline.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, key string, low long, n_runs string, mark string, runs long"


def edited(words, h):
    if h is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def runs_of(words):
    """Every maximal stretch of every period, those with a smaller period of their own left out, by definition."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e > s and (size := e - s + q) >= max(6, 4 * q):
                assert s == 0 or words[s - 1] != words[s - 1 + q]
                stretch = words[s : s + size]
                if not any(stretch[d:] == stretch[:-d] for d in range(1, q)):
                    found[s, q] = size
            s = e + 1
    return [(s, size, q) for (s, q), size in sorted(found.items())]


def plain(doc_id, text):
    words = edited(re.findall(r"[^\x20\x09-\x0D]+", text or ""), None if doc_id is None else zlib.crc32(str(doc_id).encode()))
    runs = runs_of(words)
    gone = {k for s, size, q in runs for k in range(s + q, s + size)}
    best = min(((-size, s, q) for s, size, q in runs), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (doc_id, len(runs), *top, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def texts():
    rnd = random.Random(11)
    spaces = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c"]
    made = [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "a a a a", "a\x1ca \x85 \x85 \x85 \x85 \x85 \x85", "é " * 9, "a b " * 3, "a b " * 4, "x " + "a b c " * 5 + "a", "a a b " * 4 + "a a a a a a a"]
    for size in (10, 40, 120, 300):
        for letters in ("ab", "abc", "abcdefgh"):
            for _ in range(8):
                words = [rnd.choice(letters) for _ in range(rnd.randint(1, size))]
                if rnd.random() < 0.7:
                    at, p = rnd.randrange(len(words)), rnd.randint(1, 20)
                    words[at:at] = words[at : at + p] * rnd.randint(2, 12)
                made.append("".join(w + rnd.choice(spaces) for w in words))
    return made


@pytest.mark.parametrize("limit", ["whole texts", "ranges of lags"])
def test_equals_brute_force(spark, monkeypatch, limit):
    if limit != "whole texts":
        monkeypatch.setattr(periods, "RANGE", 400)
        monkeypatch.setattr(periods, "RANGES", 5)
        monkeypatch.setattr(periods, "AT_ONCE", 64)
    rows = [(k, t) for k, t in enumerate(texts())] + [(None, "a b a b a b a b"), (7, "z z z z z z z"), (7, "z z z z z z z"), (-40, "a b c d " * 30), (-40, "a b c d " * 30)]
    given = spark.createDataFrame([(d, t, "k", 1, "n", "m", 2) for d, t in rows], SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in periods.periodic_runs(given).collect()), key=repr)
    assert got == sorted((plain(d, t) for d, t in rows), key=repr)


def test_long_texts_at_their_true_limits(spark):
    words = [str(k) for k in range(7000)]
    text = " ".join(words + words[:3000] * 4 + words[:2000])
    (row,) = periods.periodic_runs(spark.createDataFrame([(3, text, "k", 1, "n", "m", 2)], SCHEMA)).collect()
    assert zlib.crc32(b"3") % 10 and (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (1, 7000, 14000, 3000, 4666)


def test_true_places_of_long_stretches():
    rnd = np.random.default_rng(3)
    for _ in range(300):
        mask = np.zeros(160, bool)
        for _ in range(rnd.integers(0, 5)):
            at = rnd.integers(0, 150)
            mask[at : at + rnd.integers(1, 40)] = True
        assert periods.true_places(mask, 1).tolist() == np.flatnonzero(mask).tolist()
        edges = np.flatnonzero(np.diff(np.concatenate(([0], mask, [0]))))
        long = [k for a, b in edges.reshape(-1, 2) if b - a >= 15 for k in range(a, b)]
        assert set(long) <= set(periods.true_places(mask, 15).tolist()) <= set(np.flatnonzero(mask).tolist())


def test_empty(spark):
    assert periods.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_sql(spark, sf_dir):
    got = QUERIES["op11_periodic_runs"](spark, sf_dir)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    found = c.execute(ORACLES["op11_periodic_runs"])
    names = [d[0] for d in found.description]
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(found.fetchall())
