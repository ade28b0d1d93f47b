import numpy as np
import pytest

from quarryline.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, score double"


def brute(rows, every, k):
    good = [(i, np.array(v, float)) for i, v, *_ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in good:
        if q % every == 0:
            near = sorted((-float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b))), i) for i, b in good if i != q)
            out[q] = near[:k]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((40, 24))
    m = centres[rng.integers(0, 40, 3000)] + 0.3 * rng.standard_normal((3000, 24))
    m[500:1400] = m[500]
    rows = [(k, [float(x) for x in v.astype(np.float32)], 0, 1.0) for k, v in enumerate(m)]
    rows += [(5000, None, 0, 1.0), (5050, [0.0] * 24, 0, 1.0), (5100, [float("nan")] * 24, 0, 1.0), (5150, [None] * 24, 0, 1.0), (None, rows[0][1], 0, 1.0)]
    rows += [(5200, [1.0, 2.0], 0, 1.0)]
    got: dict = {}
    for r in ann.nearest(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    usable = {r[0]: r for r in rows if r[0] is not None and r[0] < 5000}
    want = brute(list(usable.values()), 50, 5)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        hits += sum(s >= -want[q][-1][0] - 1e-9 for _, _, s in found)
        a = np.array(usable[q][1])
        for _, v, s in found:
            b = np.array(usable[v][1])
            assert abs(s - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12
    assert hits >= 0.95 * 5 * len(want)
    # equal vectors: the smallest other ids come first
    assert [v for _, v, _ in got[1000]] == [500, 501, 502, 503, 504]


def test_few_rows(spark):
    rows = [(0, [1.0, 0.0], 0, 1.0), (50, [0.0, 2.0], 0, 1.0), (7, [3.0, 3.0], 0, 1.0)]
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(spark.createDataFrame(rows, SCHEMA)).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 7), (0, 2, 50), (50, 1, 7), (50, 2, 0)]
    assert ann.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert ann.nearest(spark.createDataFrame(rows[:1], SCHEMA)).count() == 0


def test_repeated_ids_and_other_lengths(spark):
    rows = [(0, [1.0, 0.0], 0, 1.0), (0, [0.0, 1.0], 0, 1.0), (7, [1.0, 1.0], 0, 1.0), (7, [1.0, 1.0], 0, 1.0), (50, [1.0, 0.0, 0.0], 0, 1.0), (8, [2.0, 1.0, 0.0], 0, 1.0)]
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in ann.nearest(spark.createDataFrame(rows, SCHEMA)).collect())
    half = round(0.5**0.5, 6)
    assert got == [(0, 1, 7, half)] * 2 + [(0, 2, 7, half)] * 2 + [(0, 3, 0, 0.0)] * 2 + [(50, 1, 8, round(2 / 5**0.5, 6))]


@pytest.mark.parametrize("clusters", [0, 40])
def test_recall_of_12000_vectors(spark, clusters):
    """Random ones, which suit a graph least, and clustered ones."""
    rng = np.random.default_rng(2)
    n = 12_000
    m = rng.standard_normal((n, 64))
    if clusters:
        m = m[rng.integers(0, clusters, n)] + 0.3 * m
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(m)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect()
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    score = m[::50] @ m.T
    score[np.arange(len(score)), np.arange(0, n, 50)] = -9
    want = {(50 * q, int(v)) for q, near in enumerate(np.argsort(-score, axis=1)[:, :5]) for v in near}
    assert len(got) == len(want)
    hits = len(want & {(r.query_id, r.vec_id) for r in got})
    print(f"recall {hits / len(want):.3f}, {clusters} clusters")
    assert hits >= 0.9 * len(want)


def test_rows_written_for_each_vector(spark, monkeypatch):
    """Neighbours stay in their node's row, so no step has a row for each neighbour, in any round."""
    written, write = {}, ann.materialize

    def counted(df, label, **more):
        table = write(df, label, **more)
        written[label] = max(written.get(label, 0), table.count())
        return table

    monkeypatch.setattr(ann, "materialize", counted)
    n = 6000
    m = np.random.default_rng(3).standard_normal((n, 16))
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(m)]
    assert ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count() == n // 50 * 5
    assert max(written.values()) < 4 * n, written
