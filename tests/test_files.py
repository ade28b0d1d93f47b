"""Line numbers over many splits, and digests of files of any size."""

import hashlib
import json
import random
import tracemalloc

import pytest

from quarryline.sources import readers


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "10"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def written(folder, files=3):
    rnd, lines = random.Random(4), {}
    for k in range(files):
        own = [rnd.choice(["", " ", json.dumps({"a": j, "b": "ü" * rnd.randint(0, 60)}, ensure_ascii=False)]) for j in range(rnd.choice([1, 40, 400]))]
        (folder / f"f{k}.jsonl").write_text("\n".join(own) + ("\n" if k % 2 else ""), "utf-8")
        lines[f"f{k}.jsonl"] = own if k % 2 or own[-1] else own[:-1]
    return lines


def test_lines_have_their_numbers_in_every_split(spark, tmp_path, small_splits):
    lines = written(tmp_path)
    rows = readers.numbered_lines(spark, f"file://{tmp_path}")
    assert rows.rdd.getNumPartitions() > 5
    got = {(r.file.rpartition("/")[2], r.line): r.value for r in rows.collect()}
    assert got == {(f, k): v for f, own in lines.items() for k, v in enumerate(own, 1)} and len(got) == rows.count()


def test_broken_lines_are_named(spark, tmp_path, small_splits):
    lines = written(tmp_path)
    got = readers.read_numbered_jsonl(spark, f"file://{tmp_path}", "a long, b string").collect()
    assert {(r.file.rpartition("/")[2], r.line, r.a, r.b) for r in got} == {(f, k, json.loads(v)["a"], json.loads(v)["b"]) for f, own in lines.items() for k, v in enumerate(own, 1) if v.strip()}
    for text in ('{"a": 1', "[1]", "x", '{"a": "no number"}'):
        (tmp_path / "bad").mkdir(exist_ok=True)
        (tmp_path / "bad/x.jsonl").write_text("\n" * 300 + '{"a": 5}\n' + text + '\n{"a": 6}\n')
        with pytest.raises(Exception, match=r"x\.jsonl, line 302"):
            readers.read_numbered_jsonl(spark, f"file://{tmp_path}/bad", "a long").collect()
        assert sorted((r.line, r.a) for r in readers.read_numbered_jsonl(spark, f"file://{tmp_path}/bad", "a long", lenient=True).collect()) == [(301, 5), (303, 6)]


def test_a_file_of_three_gib_is_streamed(spark, tmp_path):
    with open(tmp_path / "large file.bin", "wb") as f:
        f.truncate(3 << 30)  # takes no disk
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/small").write_bytes(b"x")
    (tmp_path / "empty").write_bytes(b"")
    got = {r.name: (r.bytes, r.sha256) for r in readers.files_with_digests(spark, f"file://{tmp_path}").collect()}
    wanted = hashlib.sha256()
    for _ in range(3 << 6):
        wanted.update(bytes(1 << 24))
    assert got == {"large file.bin": (3 << 30, wanted.hexdigest()), "sub/small": (1, hashlib.sha256(b"x").hexdigest()), "empty": (0, hashlib.sha256(b"").hexdigest())}
    tracemalloc.start()
    with open(tmp_path / "large file.bin", "rb") as f:
        assert readers.digest_of_file(f) == wanted.hexdigest()
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()


def test_only_training_data_is_learnt_from(spark, tmp_path):
    for name in ("train.jsonl", "validation.jsonl", "other.jsonl"):
        (tmp_path / name).write_text('{"text": " a "}\n{"text": " "}\n')
    assert [r.text for r in readers.read_training_texts(spark, f"file://{tmp_path}/train.jsonl").collect()] == ["a"]
    for name in ("validation.jsonl", "other.jsonl", "test.jsonl/train.jsonl"):
        with pytest.raises(ValueError):
            readers.read_training_texts(spark, f"file://{tmp_path}/{name}")
    with pytest.raises(FileNotFoundError):
        readers.read_training_texts(spark, f"file://{tmp_path}/none/train.jsonl")
