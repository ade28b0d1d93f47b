"""Selection, deduplication, splits, sources, sinks and streams against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quarryline.operators import dedup, packing, prefix, select, split
from quarryline.sources import readers, scratch, sinks
from quarryline.streaming import incremental


def test_running_sum(spark):
    rnd = random.Random(1)
    rows = [(k, rnd.choice("ab"), rnd.randint(-5, 50)) for k in rnd.sample(range(-500, 10**9), 300)]
    df = spark.createDataFrame(rows, "k long, g string, v long")
    got = {(r.g, r.k): r.before for r in prefix.running_sum(df, prefix.by_number(df, "k"), ["k"], F.col("v"), "before", by=("g",)).collect()}
    for g in "ab":
        total = 0
        for k, _, v in sorted(r for r in rows if r[1] == g):
            assert got[g, k] == total
            total += v


def test_greedy_near_duplicates(spark):
    rnd = random.Random(3)
    values = [rnd.getrandbits(64) for _ in range(40)]
    for _ in range(200):
        v = rnd.choice(values)
        for _ in range(rnd.randint(0, 4)):
            v ^= 1 << rnd.randrange(64)
        values.append(v)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = [(k, f"{v:016x}{k % 3 if k % 7 else 0}", v) for k, v in enumerate(values)]
    prints = {}
    rows = [(k, prints.setdefault((fp, v), f"{fp}"), v) for k, fp, v in rows]
    got = {r.doc_id: r.label for r in dedup.survivors(spark.createDataFrame([(k, fp, signed(v)) for k, fp, v in rows], "doc_id long, fingerprint string, simhash long")).collect()}
    kept, seen = [], set()
    for k, fp, v in rows:
        if fp in seen:
            want = "exact_duplicate"
        elif any((v ^ u).bit_count() <= 3 for u in kept):
            want = "near_duplicate"
        else:
            want = "kept"
            kept.append(v)
            seen.add(fp)
        assert got[k] == want


def test_quotas(spark):
    shares = spark.createDataFrame([("a", "0.5"), ("b", "0.3333"), ("c", "0.1667"), ("z", "0")], "source string, target_share string").withColumn("target_share", F.col("target_share").cast("decimal(10,4)"))
    for target in (1, 2, 7, 100, 10_001):
        got = {r.source: r.quota for r in select.quotas(shares, target).collect()}
        assert sum(got.values()) == target and "z" not in got
        assert all(abs(got[s] - target * x) < 1 for s, x in (("a", 0.5), ("b", 0.3333), ("c", 0.1667)))


def test_selection_does_not_depend_on_order(spark):
    rows = [(k, f"text {k % 30} " * 9, f"s{k % 3}") for k in range(90)]
    made = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string").repartition(3)
        records = select.distinct_records(select.corpus_records(docs, "seed"))
        quota = spark.createDataFrame([("s0", 200), ("s1", 300), ("s2", 10)], "source string, quota long")
        made.append(sorted(map(tuple, select.quota_prefix(records, quota).collect())))
    assert made[0] == made[1] and made[0]


def test_split_shares():
    assert split.shares(1, 0.1, 0.1) == (1, 0)
    assert split.shares(2, 0.1, 0.1) == (1, 0)
    assert split.shares(3, 0.1, 0.1) == (1, 1)
    assert split.shares(20, 0.2, 0.2) == (4, 4)
    with pytest.raises(ValueError):
        split.shares(5, 0.5, 0.5)


@pytest.mark.parametrize("size", [8, 50])
def test_blocks(spark, size):
    docs = spark.createDataFrame([(k, "word " * (k % 23)) for k in range(60)], "doc_id long, text string")
    rows = packing.stream(docs).orderBy("doc_id").collect()
    tokens = [t for r in rows for t in r.ids]
    got = packing.blocks(packing.stream(docs), size).orderBy("block_id").collect()
    assert [t for b in got for t in b.input_ids[: b.real]] == tokens
    assert all(len(b.input_ids) == len(b.labels) == len(b.attention_mask) == size for b in got)
    assert [b.labels[b.real :] for b in got[-1:]] == [[-100] * (size - got[-1].real)]


def test_jsonl_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "text": " x "}\n\n{"id": "2", "text": "ü"}\n', encoding="utf-8")
    (tmp_path / "b.jsonl").write_text('{"id": "1", "text": "y"}\n{"text": "no id"}\n', encoding="utf-8")
    assert [r.text for r in readers.read_texts(spark, str(tmp_path / "a.jsonl")).collect()] == ["x", "ü"]
    good = readers.staged_sources(spark, readers.named_sources([f"s={tmp_path}/a.jsonl"]), "seed").collect()
    assert [(r.source, r.record_id, r.text_bytes) for r in good] == [("s", "1", 3), ("s", "2", 2)]
    with pytest.raises(Exception, match="no id"):
        readers.staged_sources(spark, {"b": f"{tmp_path}/b.jsonl"}, "seed").collect()
    with pytest.raises(ValueError):
        readers.named_sources(["a=1", "a=2"])
    (tmp_path / "c.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):
        readers.read_jsonl(spark, f"{tmp_path}/c.jsonl", "id string").collect()


def test_text_units_and_prompts(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep/one.txt").write_text("first\n\n \n\nsecond\nline\n\n")
    units = readers.text_units(readers.read_text_files(spark, f"file://{tmp_path}")).collect()
    assert [(r.unit, r.text) for r in units] == [(0, "first"), (1, "second\nline")]
    (tmp_path / "p.jsonl").write_text('{"prompt": "hi"}\n{"id": "q", "prompt": "ho", "category": "c"}\n')
    assert [tuple(r) for r in readers.prompts(spark, f"{tmp_path}/p.jsonl").collect()] == [("prompt-001", "hi", "completion"), ("q", "ho", "c")]


def test_shards_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(k, "word " * (k % 40)) for k in range(50)], "doc_id long, text string")
    stream = packing.stream(docs)
    tokens = [t for r in stream.orderBy("doc_id").collect() for t in r.ids]
    folder = f"file://{tmp_path}/shards"
    manifest = sinks.write_shards(stream, folder, 100)
    assert [m["tokens"] for m in manifest] == [100] * (len(tokens) // 100) + [len(tokens) % 100] * bool(len(tokens) % 100)
    for start in (0, 32):
        got = readers.read_shards(spark, folder, 16, start).orderBy("sequence").collect()
        assert [r.tokens for r in got] == [tokens[k : k + 16] for k in range(start, len(tokens) - 15, 16)]
    with pytest.raises(ValueError):
        readers.read_shards(spark, folder, 16, 5)
    known = spark.createDataFrame([(m["name"], m["bytes"], m["sha256"]) for m in manifest] + [("gone.bin", 1, "x")], "name string, bytes long, sha256 string")
    assert [tuple(r) for r in readers.check_files(readers.files_with_digests(spark, folder), known).collect()] == [("gone.bin", "missing")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("b", "two\n", "x"), ("a", "one", "y")], "output_key string, text string, split string")
    sinks.write_ordered(rows, f"{tmp_path}/corpus")
    assert "".join(p.read_text() for p in sorted((tmp_path / "corpus").glob("part-*"))) == "one\ntwo\n"
    with pytest.raises(Exception):
        sinks.write_ordered(rows, f"{tmp_path}/corpus")
    sinks.write_splits(rows, f"{tmp_path}/splits")
    assert spark.read.json(f"{tmp_path}/splits").where("split = 'x'").count() == 1
    for _ in range(2):
        sinks.write_json(spark, f"file://{tmp_path}/r/report.json", {"ü": 1})
    assert json.loads((tmp_path / "r/report.json").read_text("utf-8")) == {"ü": 1}
    assert sinks.markdown(rows.select("split").orderBy("split"), "t").splitlines()[2:] == ["| split |", "|---|", "| x |", "| y |"]


def test_stream_resumes_and_equals_the_table(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = f"{tmp_path}/in"
    docs.where("doc_id % 2 = 0").repartition(3).write.parquet(where)
    rules = incremental.filters.StreamRules()
    incremental.run(spark, where, f"{tmp_path}/out", f"{tmp_path}/check", rules, files_per_batch=1)
    first = spark.read.parquet(f"{tmp_path}/out").count()
    docs.where("doc_id % 2 = 1").repartition(2).write.mode("append").parquet(where)
    incremental.run(spark, where, f"{tmp_path}/out", f"{tmp_path}/check", rules, files_per_batch=1)
    got = {r.fp for r in spark.read.parquet(f"{tmp_path}/out").select("fp").collect()}
    want = {r.fp for r in incremental.accepted(docs, rules).select("fp").collect()}
    assert got == want and 0 < first < len(want)
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(want)
    with pytest.raises(ValueError):
        incremental.run(spark, where, f"{tmp_path}/out", f"{tmp_path}/check", incremental.filters.StreamRules(min_chars=1))


def test_stream_targets(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.repartition(4).write.parquet(f"{tmp_path}/in")
    incremental.run_to_targets(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", {"train": 3000, "validation": 100, "test": 10**9}, files_per_batch=1)
    got = {r.split: r.n for r in spark.read.parquet(f"{tmp_path}/out").groupBy("split").agg(F.sum("taken").alias("n")).collect()}
    assert got["train"] == 3000 and got["validation"] == 100 and got["test"] > 100


def test_tokenizer_round_trip(spark):
    model = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    from quarryline.operators import tokenize

    texts = ["", "plain words", "Ünï 🦥", "tabs\tand\nlines", "  two  spaces ", None]
    got = {r.doc_id: r for r in tokenize.metrics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert all(got[k].same and got[k].stable for k in range(len(texts)))
    assert got[2].byte_tokens > 0 and got[0].tokens == got[5].tokens == 0 and got[1].words == 2


def test_text_similarity_labels(spark, tmp_path):
    from difflib import SequenceMatcher

    from quarryline.plans.catalog import QUERIES

    pairs = [("same text", "same  text"), ("a quick brown fox", "a quick brown dog"), ("abc", "xyz")]
    rows = [(k, t, "user", p[t]) for k, p in enumerate(pairs) for t in (0, 1)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: (r.similarity, r.label) for r in QUERIES["text_similarity"](spark, str(tmp_path)).collect()}
    ratio = SequenceMatcher(a=pairs[1][0], b=pairs[1][1]).ratio()
    assert got == {0: (1.0, "identical"), 1: (ratio, "similar"), 2: (0.0, "different")}


def test_simhash_members(spark):
    """Texts of the same words in another order have one SimHash, and each is found from the pairs."""
    rows = [(1, "a", 5), (2, "b", 5), (3, "b", 5), (4, "c", 7), (6, "e", 7), (5, "d", -1)]
    docs = spark.createDataFrame(rows, "doc_id long, fingerprint string, simhash long")
    members = {r.doc_id: r.representative for r in dedup.simhash_members(docs).collect()}
    assert members == {1: 1, 2: 1, 3: 1, 4: 4, 6: 4, 5: 5}
    assert [tuple(r) for r in dedup.simhash_pairs(docs.select("doc_id", "simhash")).collect()] == [(1, 4, 1)]


def test_similarity_of_all_turns(spark, tmp_path):
    from quarryline.plans.text_queries import text_similarity

    rows = [(1, 0, "abcd"), (1, 1, "abcd"), (1, 2, "wxyz"), (1, 4, "wxyz"), (1, 5, None), (2, 0, "alone")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((r.conv_id, r.turn, r.similarity, r.label) for r in text_similarity(spark, str(tmp_path)).collect())
    assert got == [(1, 0, 1.0, "identical"), (1, 1, 0.0, "different"), (1, 2, 1.0, "identical"), (1, 4, None, "different")]


@pytest.mark.parametrize("most", [3, 70, 5000])
def test_buckets_follow_sampled_borders(spark, monkeypatch, most):
    """One far key, negative ones and nulls; borders on one, two and three levels."""
    monkeypatch.setattr(prefix, "ROWS", 1)
    monkeypatch.setattr(prefix, "BUCKETS", most)
    monkeypatch.setattr(prefix, "FAN", 8 if most < 5000 else 16)
    keys = [*range(-3000, 3000, 2), 1 << 62, None]
    rows = spark.createDataFrame([(k, 1 + (k or 0) % 3) for k in keys], "k long, v long").repartition(5)
    bucket = prefix.by_number(rows, "k")
    sizes = [r["count"] for r in rows.groupBy(bucket.alias("b")).count().collect()]
    assert len(sizes) > 0.6 * min(most, 3000) and max(sizes) < 6 * len(keys) / min(most, len(keys))
    got = {r.k: r.before for r in prefix.running_sum(rows, bucket, ["k"], F.col("v"), "before").collect()}
    want, total = {}, 0
    for k in sorted(keys, key=lambda k: (k is not None, k or 0)):
        want[k] = total
        total += 1 + (k or 0) % 3
    assert got == want


def test_buckets_of_an_empty_table(spark):
    rows = spark.createDataFrame([], "k long, v long")
    assert prefix.running_sum(rows, prefix.by_number(rows, "k"), ["k"], F.col("v"), "before").count() == 0


def test_passing_tables_go(spark):
    gone = lambda df: not df.sparkSession._jvm.java.io.File(df.inputFiles()[0].removeprefix("file://")).exists()
    with scratch.passing(spark):
        with scratch.passing(spark):
            a = scratch.materialize(spark.range(3), "a")
            b = scratch.materialize(spark.range(4), "b", lasting=True)
        assert gone(a) and not gone(b) and b.count() == 4
        c = scratch.materialize(spark.range(5), "c", lasting=True)
    assert gone(b) and c.count() == 5
    d = scratch.materialize(spark.range(6), "d")
    assert d.count() == 6


def test_marks_are_made_once_and_in_short_batches(spark, sf_dir):
    from quarryline.plans import corpus_queries

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for query, most in ((corpus_queries.near_dup_pairs, 2000), (corpus_queries.tokenizer_roundtrip, 500)):
        spark.conf.set(key, "10000")
        query(spark, sf_dir)
        assert int(spark.conf.get(key)) <= most
    plan = corpus_queries.near_dup_members(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and "regexp" not in plan
