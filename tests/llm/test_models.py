import random
import zlib
from itertools import product

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from quarryline.llm import langid, toxicity  # noqa: E402

MODEL = P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, score long"


def test_forward_sums_all_segmentations():
    entries = langid.vocabulary(MODEL)
    cuts = langid.Segmentations(entries)
    table = np.random.default_rng(0).random((len(entries) + 1, 2)) / 100
    for word in ["the", "thinking", "x", "éêtat", "日本の"]:
        s = langid.SPACE + word
        total = np.zeros(2)
        for bits in product([0, 1], repeat=len(s) - 1):
            ends = [0, *(i + 1 for i, b in enumerate(bits) if b), len(s)]
            weight = np.ones(2)
            for a, b in zip(ends, ends[1:]):
                part = s[a:b]
                weight = weight * (table[entries[part]] if part in entries else table[-1] if b - a == 1 else 0)
            total += weight
        assert np.allclose(cuts.scores(["a", word, "longer"], table)[1], np.log(total))
    assert np.isfinite(cuts.scores(["thing" * 2000, "語" * 500], table)).all()


def cuts_of(s, entries):
    """Every way to cut s into entries or single letters that are none, as rows of the table."""
    for bits in product([0, 1], repeat=len(s) - 1):
        ends = [0, *(i + 1 for i, b in enumerate(bits) if b), len(s)]
        parts = [s[a:b] for a, b in zip(ends, ends[1:])]
        if all(p in entries or len(p) == 1 for p in parts):
            yield [entries.get(p, len(entries)) for p in parts]


def test_expected_uses_equal_brute_force(monkeypatch):
    entries = {p: k for k, p in enumerate(sorted(["▁", "▁a", "a", "b", "ab", "ba", "bab", "▁ab"]))}
    words, times = ["abab", "b", "aab", "babxa"], np.array([3.0, 5.0, 2.0, 1.0])
    cuts = langid.Segmentations(entries)
    weights = np.full(cuts.size, 1.0 / cuts.size)
    for _ in range(2):
        counts = np.full(cuts.size, langid.FLOOR)
        for word, n in zip(words, times):
            ways = list(cuts_of("▁" + word, entries))
            chances = np.array([np.prod(weights[w]) for w in ways])
            for way, chance in zip(ways, chances / chances.sum()):
                np.add.at(counts, way, n * chance)
        counts[-1] = 0
        weights = counts / counts.sum()
        weights[-1] = langid.STRANGE
    assert np.allclose(cuts.expected(words, times, 2), weights)
    monkeypatch.setattr(langid, "LONG", 2)  # the same if words are scaled
    assert np.allclose(cuts.expected(words, times, 2), weights)


def test_long_words_and_all_languages_count():
    entries = langid.vocabulary(MODEL)
    many = [(f"l{k:03d}", [f"word{'abcdefghij'[k % 10]}", "thing" * 300], [2, 1]) for k in range(300)]
    model = langid.fit(iter(many), entries)
    assert len(model.langs) == 300 and np.isfinite(model.table).all() and np.isfinite(model.typical).all()
    assert max(map(len, entries)) > 12


def test_language_on_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = langid.identify(docs, MODEL).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)


def test_language_edges(spark):
    rows = [(k, t, lang, "s", 1) for k, (t, lang) in enumerate([("der die das und", "de"), ("the of and to", "en")] * 8)]
    rows += [(100, None, "de", "s", 1), (101, "", None, "s", 1), (102, "123 !? _", "en", "s", 1), (None, "the and", None, "s", 1), (103, "the " * 30_000, None, "s", 1)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, SCHEMA), MODEL).collect()}
    assert [got[k].lang_pred for k in (100, 101, 102, None, 103)] == ["und", "und", "und", "en", "en"]
    assert got[100].score == 0.0 and got[None].held_out is False
    twice = langid.identify(spark.createDataFrame(rows + rows, SCHEMA), MODEL).collect()
    assert len(twice) == 2 * len(rows) and {(r.doc_id, r.lang_pred) for r in twice} == {(r.doc_id, r.lang_pred) for r in got.values()}
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.identify(empty, MODEL).count() == 0
    unlabelled = spark.createDataFrame([(1, "the", None, "s", 1)], SCHEMA)
    assert langid.identify(unlabelled, MODEL).first().lang_pred == "und"


def test_labels_of_held_out_documents_do_not_matter(spark):
    rows = [(k, f"the of {k}", "en", "s", 1) for k in range(40)] + [(100 + k, f"der von {k}", "de", "s", 1) for k in range(40)]
    spoilt = [(d, t, "xx" if zlib.crc32(str(d).encode()) % 4 == 2 else lang, s, n) for d, t, lang, s, n in rows]
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(x, SCHEMA), MODEL).collect()} for x in (rows, spoilt))
    assert a.keys() == b.keys() and all(a[k][0] == b[k][0] and abs(a[k][1] - b[k][1]) < 1e-9 for k in a)


def toxic_corpus():
    rnd = random.Random(0)
    plain, bad = [f"word{k}" for k in range(300)], ["scum", "moron", "idiot"]
    rows, labels = [], []
    for k in range(500):
        text = [rnd.choice(plain) for _ in range(rnd.choice([20, 100, 300]))]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(max(2, len(text) // 30)):
                text.insert(rnd.randrange(len(text)), rnd.choice(bad))
        rows.append((k, " ".join(text), "en", "s", 1))
        labels.append((k, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame(rows + [(900, None, "en", "s", 1), (901, "", "en", "s", 1), (902, "!!! 123", "en", "s", 1), (903, "You MORON, idiot scum!", "en", "s", 1)], SCHEMA)
    marks = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.grade(docs, marks).collect()}
    held = [k for k, _ in labels if k % 3 == 0]
    assert all(got[k].toxic == (k % 5 == 0) for k in held)
    assert not any(got[k].toxic for k in (900, 901, 902)) and got[903].toxic
    # with labels 0 and 1 there is one threshold, and the expected label is the chance of the higher one
    assert all(0 <= r.p_toxic <= 1 and abs(r.severity - r.p_toxic) < 1e-12 for r in got.values())


def test_graded_labels(spark):
    """Marked words of three strengths: the expected grade follows them, and so does the likeliest one on held-out rows."""
    rnd = random.Random(3)
    plain, bad = [f"word{k}" for k in range(200)], ["meh", "nasty", "vile"]
    rows, labels = [], []
    for k in range(900):
        grade = k % 4
        text = [rnd.choice(plain) for _ in range(60)] + ([bad[grade - 1]] * 6 if grade else [])
        rnd.shuffle(text)
        rows.append((k, " ".join(text), "en", "s", 1))
        labels.append((k, grade))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in toxicity.grade(docs, spark.createDataFrame(labels[:600], "doc_id long, toxic int")).collect()}
    held = labels[600:]
    assert all(got[k].toxic == (grade > 0) for k, grade in held)
    means = [np.mean([got[k].severity for k, g in held if g == grade]) for grade in range(4)]
    assert means == sorted(means) and abs(means[0]) < 0.2 and abs(means[3] - 3) < 0.4


def test_labels_repeated_and_contradictory_and_long_texts(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame(rows + rows[:50] + [(2000, "word1 " * 200_000, "en", "s", 1)], SCHEMA)
    said = labels + labels[:40] + [(k, 0) for k in range(0, 100, 5)] + [(10_000, 1), (None, 1), (7, None)]
    got = toxicity.grade(docs, spark.createDataFrame(said, "doc_id long, toxic int")).collect()
    assert len(got) == 551 and len({(r.doc_id, r.p_toxic) for r in got}) == 501
    assert all(r.toxic == (r.doc_id % 5 == 0) for r in got if r.doc_id < 500)
    assert not next(r for r in got if r.doc_id == 2000).toxic


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame(toxic_corpus()[0][:20], SCHEMA)
    for labels in ([], [(1, 0)], [(1, None)]):
        got = toxicity.grade(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        assert len(got) == 20 and not any(r.toxic for r in got)
    assert toxicity.grade(spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")).count() == 0


def sparse(dense, grades, weights=None):
    rows, cols = np.nonzero(dense)
    return toxicity.Rows(rows.astype(np.int32), cols.astype(np.int32), dense[rows, cols], grades, np.ones(len(grades)) if weights is None else weights)


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(1)
    x = rng.random((600, 1)) * 4
    grades = np.minimum(x[:, 0].astype(int), 3)
    data = sparse(x, grades)
    p = toxicity.fit_ordinal(data, 1, toxicity.begin(grades, np.ones(600), 1, 3), 0.0, 300)
    bounds = toxicity.thresholds(p, 1)
    assert p[0] > 0 and (np.diff(bounds) > 0).all()
    expected = toxicity.chances(x[:, 0] * p[0], bounds)[:, 1:-1].sum(axis=1)
    assert np.abs(expected - grades).mean() < 0.3


def test_slopes_equal_differences():
    rng = np.random.default_rng(4)
    dense = rng.random((40, 5)) * (rng.random((40, 5)) < 0.5)
    data = sparse(dense, rng.integers(0, 4, 40), rng.random(40) + 0.5)
    p = np.concatenate((rng.standard_normal(5), [-0.3, -0.2, 0.4]))

    def loss(p):
        total = 0.0
        for i, g in enumerate(data.grades):  # row by row, from the definition
            s, b = dense[i] @ p[:5], p[5] + np.array([0, np.exp(p[6]), np.exp(p[6]) + np.exp(p[7])])
            above = [1.0, *(1 / (1 + np.exp(-(s - b)))), 0.0]
            total -= data.weights[i] * np.log(above[g] - above[g + 1])
        return total / data.weights.sum()

    near = np.array([(loss(p + e) - loss(p - e)) / 2e-6 for e in 1e-6 * np.eye(8)])
    assert np.allclose(toxicity.slopes(data, p, 5), near, atol=1e-7)
    assert abs(toxicity.likelihood(data, p[:5], toxicity.thresholds(p, 5)) + loss(p)) < 1e-12
    assert np.abs(toxicity.slopes(data, p, 5)[:5]).max() <= (dense * data.weights[:, None]).sum(axis=0).max() / data.weights.sum()


def test_chances_and_expected_label():
    bounds, values = np.array([-0.5, 0.2, 1.0]), np.array([0.0, 1.0, 2.0, 5.0])
    above = toxicity.chances(np.array([0.3]), bounds)[0]
    own = above[:-1] - above[1:]
    assert abs(own.sum() - 1) < 1e-12 and (own > 0).all()
    assert abs(own @ values - (values[0] + above[1:-1] @ np.diff(values))) < 1e-12


def test_number_signs_are_no_letters(spark, sf_dir):
    import unicodedata

    from quarryline.llm import worker
    from quarryline.llm.queries import tokenizer_path

    every = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000]
    assert worker.letter_runs(" ".join(every)) == [c for c in every if unicodedata.category(c).startswith("L")]
    assert worker.letter_runs("a²b ½ Ⅷ ① 12x ünï_z") == ["a", "b", "x", "ünï", "z"]
    given = [(10**6 + k, t) for k, t in enumerate(["²", "½ ① 12", "Ⅷ", "123 !!", None, "", "²the house of the people"])]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.unionByName(spark.createDataFrame(given, "doc_id long, text string"), allowMissingColumns=True)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(rows, tokenizer_path("piece_bpe_32k.model")).collect()}
    assert all(got[10**6 + k] == ("und", 0.0) for k in range(6)) and got[10**6 + 6][0] == "en"


def test_fit_meets_the_conditions_of_the_penalised_optimum():
    rng = np.random.default_rng(8)
    n, size, top = 900, 40, 3
    kept = rng.random((n, size)) < 0.3
    rows, cols = np.nonzero(kept)
    values = rng.random(len(rows)) * 2
    true = np.where(np.arange(size) < 8, rng.normal(0, 2, size), 0.0)
    score = np.bincount(rows, values * true[cols], n) + rng.logistic(size=n)
    grades = np.digitize(score, np.quantile(score, [0.4, 0.7, 0.9]))
    data = toxicity.Rows(rows, cols, values, grades, np.ones(n))
    start = toxicity.begin(grades, data.weights, size, top)
    penalty = np.abs(toxicity.slopes(data, start, size)[:size]).max() / 16
    loss = lambda p, l: l * np.abs(p[:size]).sum() - toxicity.likelihood(data, p[:size], toxicity.thresholds(p, size))

    def plain(p, l, steps=6000):  # proximal gradient with steps that shrink until the loss falls
        rate, now = 1.0, loss(p, l)
        for _ in range(steps):
            q = p - rate * toxicity.slopes(data, p, size)
            q[:size] = np.sign(q[:size]) * np.maximum(np.abs(q[:size]) - rate * l, 0)
            if (new := loss(q, l)) <= now:
                p, now, rate = q, new, rate * 1.1
            else:
                rate /= 2
        return p

    best = plain(start, penalty)
    slope = toxicity.slopes(data, best, size)
    used = best[:size] != 0
    assert np.abs(slope[:size][used] + penalty * np.sign(best[:size][used])).max() < 0.01 * penalty and (np.abs(slope[:size][~used]) <= 1.01 * penalty).all()
    way = loss(start, penalty) - loss(best, penalty)
    gaps = [(loss(toxicity.fit_ordinal(data, size, start, penalty, steps), penalty) - loss(best, penalty)) / way for steps in (toxicity.STEPS, 4 * toxicity.STEPS, 20 * toxicity.STEPS)]
    assert 0.03 > gaps[0] > gaps[1] > gaps[2] > -1e-6 and gaps[2] < 1e-3, gaps  # the steps of a fit stop a little short of the optimum, more steps reach it
