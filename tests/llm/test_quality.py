import random
import zlib
from collections import Counter

import numpy as np

from quarryline.llm import quality
from quarryline.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, score double, held_out string, good long, predicted long"
PROSE = "the river runs past an old mill and people walk there in the evening light with their dogs while birds sing".split()


def made(n, seed=1):
    rnd = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        bad = k % 4 == 0
        words = [rnd.choice(PROSE) for _ in range(rnd.randint(5, 60))]
        if bad:
            kind = rnd.randrange(3)
            words = [w.upper() + "!!" for w in words] if kind == 0 else [w for w in words[:12] for _ in range(8)] if kind == 1 else [w + rnd.choice(["###", "%%%"]) for w in words]
        docs.append((k, " ".join(words), 0.1, "h", 5, 6))
        labels.append((k, int(not bad), 0))
    return docs, labels


def plain_terms(text):
    words = (text or "").split()
    found, times = Counter(), 0
    for k, w in enumerate(words):
        times = times + 1 if k and words[k - 1] == w else 0
        found[zlib.crc32(("shape " + quality.shape(w.translate(quality.Kinds()))).encode()) % quality.TERMS] += 1
        found[zlib.crc32(("word " + w.lower()).encode()) % quality.TERMS] += 1
        if times:
            found[int(quality.AGAIN[min(times, 4) - 1])] += 1
    return found


def test_terms_of_slices():
    texts = ["a a a a a a B", "a", None, "", "B b b", "Ünïcode wörds 12 345-6 x", " x\n\nx\tx "]
    row, place, uses = quality.counted(texts)
    for k, t in enumerate(texts):
        assert dict(zip(place[row == k].tolist(), uses[row == k].tolist())) == plain_terms(t)
    assert [quality.shape(w.translate(quality.Kinds())) for w in ("Thhaen", "THE!!", "a12-b", "Éé")] == ["Xx", "X!", "x9-x", "Xx"]


def test_directions_are_those_of_a_full_decomposition(monkeypatch):
    monkeypatch.setattr(quality, "DIMENSIONS", 4)
    rng = np.random.default_rng(2)
    a = (rng.standard_normal((60, 5)) * [9, 7, 5, 3, 0.1]) @ rng.standard_normal((5, 40)) + 0.01 * rng.standard_normal((60, 40))
    rows = [(np.flatnonzero(r), r[np.flatnonzero(r)]) for r in a]
    got = quality.decompose(rows, 40)
    full = np.linalg.svd(a)[2][:4].T
    assert np.allclose(np.abs(np.diag(got.T @ full)), 1, atol=1e-6)


def test_votes_are_those_of_every_cosine(monkeypatch):
    monkeypatch.setattr(quality, "NEIGHBOURS", 5)
    rng = np.random.default_rng(4)
    rows = quality.unit(rng.standard_normal((40, 6)).astype(np.float32))
    rows[7] = rows[3]  # ties
    good = (rng.random(40) < 0.6).astype(np.int64)
    model = quality.Model(np.zeros(1), np.zeros((1, 6)), rows, good, np.where(good == 1, 3.0, 1.5), 0.7)
    near = quality.unit(rng.standard_normal((20, 6)).astype(np.float32))
    near[0], near[1] = 0, rows[3]
    for own, got in zip(near, quality.votes(near, model)):
        cosines = [float(own.astype(np.float64) @ r.astype(np.float64)) for r in rows]
        last = sorted(cosines)[-5]
        weights = [(max(c, 0) * s, g) for c, s, g in zip(cosines, model.stands_for, good) if c >= last - quality.TIE]
        total = sum(w for w, _ in weights)
        assert abs(got - (sum(w * g for w, g in weights) + quality.PRIOR * 0.7) / (total + quality.PRIOR)) < 1e-5
    assert abs(quality.votes(near, model)[0] - 0.7) < 1e-9


def test_weights_come_from_all_documents(spark):
    docs, _ = made(50)
    used, n = quality.document_frequencies(spark.createDataFrame(docs, SCHEMA).repartition(3))
    wanted = Counter(t for d in docs for t in plain_terms(d[1]))
    assert n == 50 and {k: int(used[k]) for k in np.flatnonzero(used)} == dict(wanted)


def test_separates_and_does_not_depend_on_partitions(spark):
    docs, labels = made(400)
    docs += [(1000, None, 0.0, "h", 1, 1), (1001, "", 0.0, "h", 1, 1), (1002, " \n", 0.0, "h", 1, 1), (None, docs[1][1], 0.0, "h", 1, 1), (1, docs[1][1], 0.0, "h", 1, 1), (1003, docs[1][1], 0.0, "h", 1, 1), (1004, "river " + " ".join(PROSE) * 5000, 0.0, "h", 1, 1)]
    labels += [(1, 0, 0), (1, 1, 0), (None, 1, 0), (1002, None, 0), (2000, 1, 0)]
    said = spark.createDataFrame(labels, "doc_id long, quality int, score int")
    got = [sorted((tuple(r) for r in quality.classify(spark.createDataFrame(docs, SCHEMA).repartition(p), said).collect()), key=repr) for p in (2, 5)]
    assert [(r[0], r[1], round(r[2], 5)) for r in got[0]] == [(r[0], r[1], round(r[2], 5)) for r in got[1]]
    by = {r[0]: r for r in got[0]}
    assert len(got[0]) == len(docs) and all(by[d][1] == (d is not None and zlib.crc32(str(d).encode()) % 5 == 0) for d in by)
    held = [k for k in range(400) if by[k][1]]
    assert np.mean([by[k][3] == (k % 4 != 0) for k in held]) > 0.95 and all(r[3] == (r[2] >= 0.3) and 0 <= r[2] <= 1 for r in got[0])
    share = by[1000][2]
    assert share == by[1001][2] == by[1002][2] and 0.6 < share < 0.9
    assert by[None][2] == by[1003][2]


def test_held_out_labels_and_other_columns_are_not_looked_at(spark):
    docs, labels = made(120)
    turned = [(d, 1 - q if zlib.crc32(str(d).encode()) % 5 == 0 else q, t) for d, q, t in labels]
    rows = spark.createDataFrame(docs, SCHEMA)
    got = [sorted(map(tuple, quality.classify(rows, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect())) for x in (labels, turned)]
    assert got[0] == got[1]


def test_without_labels(spark):
    docs, labels = made(12)
    rows, none = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([], "doc_id long, quality int")
    assert {(r.score, r.predicted) for r in quality.classify(rows, none).collect()} == {(0.5, 1)}
    good = spark.createDataFrame([(d, 1) for d, _, _ in labels], "doc_id long, quality int")
    assert {r.score for r in quality.classify(rows, good).collect()} == {1.0}
    assert quality.classify(rows.limit(0), good).count() == 0


def test_held_out_accuracy(spark, sf_dir):
    at = sf_dir.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op13_quality"](spark, at).collect() if r.held_out and r.doc_id in labels]
    assert len(rows) > 50 and np.mean([r.predicted == labels[r.doc_id] for r in rows]) > 0.95
