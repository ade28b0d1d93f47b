"""Text, hash and rule expressions against plain Python, on odd strings."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.functions import hashing as H
from quarryline.functions import text as T
from quarryline.operators import filters

EDGES = [
    "", " ", "\t\n", "plain", "a\r\nb\rc", "x\x00y\x1fz\x7f", "﻿BOM �", "aaaaaaaa", "aaaaaaaaa", "a" * 8 + "\n" + "a" * 8, "\n\n\n\nfour\n\n\n",
    "Ünïcödé ÄÖÜ ß", "²³ ① 日本語 _under_score", "http://x.y/z and WWW.Foo.bar end", "1234567890 " * 5, "!!! ??? ...", "é combining", " nbsp em　",
    "line one\nLine  ONE\nline one", "der die das und ist nicht " * 3, "Cookie Einstellungen und Newsletter abonnieren, Passwort VERGESSEN", "Copyright 2020 Alle Rechte vorbehalten ZUM INHALT SPRINGEN",
    "one two three four five " * 20, "🙂🙃 emoji", "DATENSCHUTZERKLÄRUNG", "a.b! c? " + "x" * 900, "word " * 190 + ". " + "tail " * 20,
]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(7)
    bits = ["a", "B", " ", "\n", "\r\n", "ä", "1", "²", ".", "!", "\x07", "http://q ", "der ", " ", "日", "_", "-"]
    return EDGES + ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 120))) for _ in range(200)]


def check(spark, texts, column, want, close=False):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", column.alias("got")).collect()
    for i, got in rows:
        expected = want(texts[i])
        assert (math.isclose(got, expected, abs_tol=1e-12) if close else got == expected), (texts[i], got, expected)


def test_cleaning(spark, texts):
    def cleaned(t):
        t = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", t.replace("\r\n", "\n").replace("\r", "\n"))
        return re.sub(r"\n{3,}", "\n\n", t).strip()

    def normal(t):
        return " ".join(re.sub(r"[﻿�\x00-\x08\x0b\x0c\x0e-\x1f]", " ", t).split())

    check(spark, texts, T.clean_text(F.col("text")), cleaned)
    check(spark, texts, T.normalize_text(F.col("text")), normal)
    check(spark, texts, T.canonical(F.col("text")), lambda t: " ".join(t.lower().split()))
    check(spark, texts, T.words(F.col("text")), lambda t: re.findall(r"\w+", t.lower()))
    check(spark, texts, T.approx_tokens(F.col("text")), lambda t: max(1, round(len(t) / 4)))
    check(spark, texts, T.preview(F.col("text"), 20), lambda t: " ".join(t.split())[:20])
    check(spark, texts, T.shortened(F.col("text"), 30), lambda t: t[:30] + "...[truncated]" if len(t) > 30 else t)


def test_truncation(spark, texts):
    def cut(t, most=100):
        if len(t) <= most:
            return t
        head = t[:most]
        end = max(head.rfind(c) for c in ".!?")
        return (head[: end + 1] if end > most * 0.7 else head).strip()

    check(spark, texts, T.truncated(F.col("text"), 100), cut)


def test_metrics(spark, texts):
    def repeated(items):
        return sum(n - 1 for n in Counter(items).values()) / len(items) if items else 0.0

    def ngrams(t):
        w = re.findall(r"\w+", t.lower())
        return [tuple(w[k : k + 5]) for k in range(len(w) - 4)]

    plain = {
        "url_ratio": lambda t: sum(len(m[0]) for m in re.finditer(r"https?://\S+|www\.\S+", t, re.I)) / max(len(t), 1),
        "digit_ratio": lambda t: sum(c.isdigit() for c in t) / max(len(t), 1),
        "symbol_ratio": lambda t: sum(not c.isalnum() and not c.isspace() for c in t) / max(len(t), 1),
        "alpha_ratio": lambda t: sum(c.isalpha() for c in t) / max(len(t), 1),
        "duplicate_lines": lambda t: repeated([" ".join(x.lower().split()) for x in t.splitlines() if x.strip()]),
        "repeated_5grams": lambda t: repeated(ngrams(t)),
    }
    made = filters.metrics(F.col("text"))
    for name, want in plain.items():
        check(spark, texts, made[name].cast("double"), want, close=True)
    patterns = [p.replace(T.SPACE, r"\s").replace(r"\p{Nd}", r"\d") for p in filters.BOILERPLATE]
    check(spark, texts, made["boilerplate"], lambda t: sum(bool(re.search(p, t, re.I)) for p in patterns))


def test_pilot_rules(spark, texts):
    rules = filters.PilotRules(min_chars=20, min_words=4, min_stopwords=2)

    def reasons(t):
        if not t:
            return ["empty_text"]
        seen = [c for c in t if not c.isspace()]
        ratio = 1 - sum(c.isalpha() for c in seen) / len(seen) if seen else 1.0
        out = ["too_short_chars"] * (len(t) < 20) + ["too_few_words"] * (len(re.findall(r"\w+", t)) < 4)
        out += ["repeated_character_run"] * bool(re.search(r"(.)\1{8,}", t)) + ["too_many_non_letters"] * (ratio > 0.4)
        out += ["not_enough_german_stopwords"] * (sum(w in filters.STOPWORDS for w in re.findall(r"\w+", t.lower())) < 2)
        hit = next((p for p in filters.PHRASES if p.lower() in t.lower()), None)
        return out + ([f"boilerplate:{hit}"] if hit else [])

    check(spark, texts, filters.rejection_reasons(F.col("text"), rules), reasons)


def test_thresholds_are_strict(spark):
    rules = filters.StreamRules(min_chars=1, min_words=1, max_digits=0.2, max_symbols=1.0, min_letters=0.0)
    check(spark, ["abcd1", "abc12"], filters.quality_rejection(F.col("text"), rules), lambda t: "digit_ratio" if t == "abc12" else None)


def test_metadata_rules(spark):
    rows = [("deu", "Latn", 0.98, 0.25, 500), ("eng", "Latn", 1.0, 1.0, 1), (None, "Latn", 1.0, 1.0, 1), ("deu", None, 1.0, 1.0, 1), ("deu", "Latn", None, 1.0, 1), ("deu", "Latn", 0.97, 1.0, 1), ("deu", "Latn", 1.0, None, 1), ("deu", "Latn", 1.0, 0.2, 1), ("deu", "Latn", 1.0, 1.0, None), ("deu", "Latn", 1.0, 1.0, 501)]
    df = spark.createDataFrame(rows, "l string, s string, ls double, q double, c int")
    got = [r[0] for r in df.select(filters.metadata_rejection(*map(F.col, ("l", "s", "ls", "q", "c")))).collect()]
    assert got == [None, "metadata_language", "metadata_language", "metadata_script", "metadata_language_score", "metadata_language_score", "metadata_quality_score", "metadata_quality_score", "metadata_cluster_size", "metadata_cluster_size"]


def test_hashes_and_splits(spark, texts):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    check(spark, texts, H.fingerprint(F.col("text")), lambda t: sha(" ".join(t.lower().split())))
    check(spark, texts, H.stable_key("s", "p", F.lit("src"), F.col("text")), lambda t: sha("s\0p\0src\0" + t))
    check(spark, texts, H.bucket(H.sha(F.col("text")), 8000), lambda t: int(sha(t)[:16], 16) % 8000)
    check(spark, texts, H.fraction(H.sha(F.col("text"))), lambda t: int(sha(t)[:12], 16) / 16**12)


def test_simhash(spark, texts):
    def plain(t, value):
        votes = [0] * 64
        for w, n in Counter(re.findall(r"\w+", t.lower())).items():
            for b in range(64):
                votes[b] += n if value(w) >> b & 1 else -n
        return f"{sum(1 << b for b in range(64) if votes[b] >= 0) if re.search(r'\w', t) else 0:016x}"

    check(spark, texts, H.simhash_blake(F.col("text")), lambda t: plain(t, lambda w: int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: r[1] for r in H.simhash_sha(rows).select("doc_id", H.as_hex(F.col("simhash"))).collect()}
    assert got == {i: plain(t, lambda w: int(hashlib.sha256(w.encode()).hexdigest()[:16], 16)) for i, t in enumerate(texts)}


def test_simhash_blake_forgets_the_words_of_other_batches(spark):
    """Every text has its own words: hashing them must not cost more for each text, the more there were before."""
    rows = spark.range(0, 8000, 1, 1).selectExpr("concat_ws(' ', transform(sequence(0, 79), k -> concat('w', id, 'x', k))) as text")
    began = time.time()
    assert rows.select(H.simhash_blake(F.col("text")).alias("h")).where("length(h) = 16").count() == 8000
    assert time.time() - began < 20


def test_majorities_of_long_rows():
    digests = bytes([255] * 8 + [0] * 8 + [15] * 8)
    codes = np.array([0] * 70_000 + [1] * 70_001 + [2] + [1], np.int64)
    got = H.majorities(digests, codes, np.array([70_000, 70_000, 140_002, 140_003]))
    assert [int(v) for v in got] == [2**64 - 1, 0, 0, 0]
    both = H.majorities(digests, np.array([0] * 70_000 + [1] * 70_000 + [2]), np.array([140_001]))
    assert int(both[0]) == int("0f" * 8, 16)
    assert [int(v) for v in H.majorities(b"", np.zeros(0, np.int64), np.array([0, 0]))] == [0, 0]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rejection_finds_words_once(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    once = T.let(F.col("text"), lambda t: T.let(T.words(t), F.size))
    assert plan_of(rows.select(filters.quality_rejection(F.col("text")))).count("regexp_extract_all") == plan_of(rows.select(once)).count("regexp_extract_all")


def test_white_space_one_by_one():
    assert sorted(T.SPACE_CHARS) == [c for c in map(chr, range(0x3001)) if re.match("[" + re.sub(r"\\x\{(\w+)\}", r"\\u\1", T.SPACES) + "]", c)]
    assert sorted(T.LINE_ENDS) == [c for c in T.SPACE_CHARS if len(f"a{c}b".splitlines()) == 2]


def test_lines_and_repeated_ngrams(spark, texts):
    odd = [*texts, *(f"A{c}{d} b{c}C " for c in T.SPACE_CHARS for d in T.SPACE_CHARS), "ΑΣ\nΣ\u2028ΑΣ Σ", "a b c d", "a b c d e", "a b c d e " * 9, "\t\n \n"]
    rows = spark.createDataFrame(list(enumerate(odd)), "id long, t string")
    shares = (0.0, 0.12, 0.5, -1.0)
    more = [filters.repeats_ngrams(T.words(F.col("t")), 5, m) for m in shares]
    for r in rows.select("t", filters.lines(F.col("t")), F.array(*more)).collect():
        assert r[1] == [x for line in re.split("[" + T.LINE_ENDS + "]", r[0].lower()) if (x := " ".join(line.split()))]
        w = re.findall(r"\w+", r[0].lower())
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        share = 1 - len(set(grams)) / len(grams) if grams else 0.0
        assert r[2] == [share > m for m in shares] or any(abs(share - m) < 1e-9 for m in shares)
