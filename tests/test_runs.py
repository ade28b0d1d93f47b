"""Sources, sinks, recovery, controlled stops, gates and checks of runs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.operators import packing, runs, select, split
from quarryline.sources import readers, sinks
from quarryline.streaming import incremental


def test_text_files_are_sorted_and_needed(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in (("b.txt", "two"), ("sub/a.txt", "three"), ("a.txt", "one"), ("c.md", "no")):
        (tmp_path / name).write_text(text)
    assert [r.text for r in readers.read_text_files(spark, f"file://{tmp_path}").collect()] == ["one", "two", "three"]
    assert readers.first_text_file(spark, f"file://{tmp_path}").endswith("/a.txt")
    (tmp_path / "none").mkdir()
    for read in (readers.read_text_files, readers.first_text_file):
        with pytest.raises(FileNotFoundError):
            read(spark, f"file://{tmp_path}/none")


def test_prompts_and_evaluation_records(spark, tmp_path):
    (tmp_path / "lines.txt").write_text("one\n two \nthree\n")
    (tmp_path / "parts.txt").write_text("one\ntwo\n\n three\n\n\n")
    assert [r.prompt for r in readers.prompt_texts(spark, f"file://{tmp_path}/lines.txt").collect()] == ["one", "two", "three"]
    assert [r.prompt for r in readers.prompt_texts(spark, f"file://{tmp_path}/parts.txt").collect()] == ["one\ntwo", "three"]
    (tmp_path / "p.jsonl").write_text('{"prompt": "x"}\n{"prompt": " "}\n{"other": 1}\n')
    assert [r.prompt for r in readers.benchmark_prompts(spark, f"file://{tmp_path}/p.jsonl").collect()] == ["x"]
    (tmp_path / "e.jsonl").write_text('{"domain": "de", "text": "x"}\n')
    assert readers.evaluation_records(spark, f"file://{tmp_path}/e.jsonl").collect() == [("de", "x")]
    (tmp_path / "f.jsonl").write_text('{"text": "x"}\n')
    with pytest.raises(Exception, match="no domain"):
        readers.evaluation_records(spark, f"file://{tmp_path}/f.jsonl").collect()


def test_history_and_pinned_revisions(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.jsonl").write_text('{"sha256": "h1", "id": " "}\n{"sha256": "h2", "id": "b"}\n{"sha256": "h1"}\n')
    got = readers.history_marks(spark, [f"file://{tmp_path}/a", f"file://{tmp_path}/missing"], ["x.jsonl", "y.jsonl"])
    assert sorted(r.mark for r in got.collect()) == ["id:b", "sha256:h1", "sha256:h2"]
    assert readers.history_marks(spark, [f"file://{tmp_path}/missing"], ["x.jsonl"]).count() == 0
    revision = "0123456789" * 4
    spark.range(30).write.parquet(f"{tmp_path}/data/{revision}")
    rows = readers.pinned(spark, f"{tmp_path}/data", revision)
    with pytest.raises(ValueError):
        readers.pinned(spark, f"{tmp_path}/data", "main")
    whole = [r.id for r in select.resumed(rows, "id", "7").orderBy("place").collect()]
    assert sorted(whole) == list(range(30)) != whole
    assert [r.id for r in select.resumed(rows.repartition(5), "id", "7", 12).orderBy("place").collect()] == whole[12:]


def shards(spark, folder, target=None):
    stream = spark.createDataFrame([(k, list(range(10 * k, 10 * k + 7)), 7, 7 * k) for k in range(40)], "doc_id long, ids array<int>, n long, start long")
    return sinks.write_shards(stream, folder, 64, target), [v for k in range(40) for v in range(10 * k, 10 * k + 7)]


def test_target_of_tokens_and_places(spark, tmp_path):
    manifest, tokens = shards(spark, f"file://{tmp_path}/s", 150)
    data = b"".join((tmp_path / "s" / m["name"]).read_bytes() for m in manifest)
    assert np.frombuffer(data, "<u2").tolist() == tokens[:150]
    assert runs.shard_problems({"total_tokens": 150, "shards": manifest}) == []
    spoilt = [dict(manifest[0], bytes=1), dict(manifest[2], sha256="x"), *manifest[2:]]
    assert runs.shard_problems({"total_tokens": 9, "shards": spoilt}) == [f"{manifest[0]['name']}: bytes", f"{manifest[2]['name']}: sha256", f"{manifest[2]['name']}: order", "total_tokens: 108"]
    sizes = [m["tokens"] for m in manifest]
    assert [readers.located(k, sizes) for k in (0, 63, 64, 149)] == [(0, 0), (0, 63), (1, 0), (2, 21)]
    for wrong in (-1, 150):
        with pytest.raises(ValueError):
            readers.located(wrong, sizes)


def test_recovery_cuts_back_to_the_checkpoint(spark, tmp_path):
    _, tokens = shards(spark, f"file://{tmp_path}/s")
    (tmp_path / "s/temporary").mkdir()
    (tmp_path / "s/temporary/unfinished").write_bytes(b"x")
    for _ in range(2):  # a second recovery changes nothing
        assert sinks.recover_shards(f"file://{tmp_path}/s", 100, 64) == ["shard-000000.bin", "shard-000001.bin"]
        assert sorted(p.name for p in (tmp_path / "s").iterdir() if not p.name.startswith(".")) == ["shard-000000.bin", "shard-000001.bin"]
        data = b"".join((tmp_path / f"s/shard-00000{k}.bin").read_bytes() for k in (0, 1))
        assert np.frombuffer(data, "<u2").tolist() == tokens[:100]
    with pytest.raises(ValueError):
        sinks.recover_shards(f"file://{tmp_path}/s", 120, 64)


def test_blocks_are_checked_when_read(spark, tmp_path):
    made = packing.blocks(spark.createDataFrame([(0, list(range(3, 23)), 20, 0)], "doc_id long, ids array<int>, n long, start long"), 8)
    sinks.write_blocks(made, f"{tmp_path}/good")
    assert readers.read_blocks(spark, f"{tmp_path}/good", 8, 100).count() == 3
    sinks.write_blocks(made.drop("labels"), f"{tmp_path}/plain")
    a, b = (readers.read_blocks(spark, f"{tmp_path}/{n}", 8, 100).select("block_id", "labels").orderBy("block_id").collect() for n in ("good", "plain"))
    assert a == b
    with pytest.raises(Exception, match="range"):
        readers.read_blocks(spark, f"{tmp_path}/good", 8, 10).collect()


def test_publish_copies_and_marks_last(spark, tmp_path):
    shards(spark, f"file://{tmp_path}/s")
    assert sinks.publish(spark, f"file://{tmp_path}/s", f"file://{tmp_path}/to").count() == 5
    assert json.loads((tmp_path / "to/COMPLETE").read_text()) == {"files": 5}
    for p in (tmp_path / "s").glob("*.bin"):
        assert (tmp_path / "to" / p.name).read_bytes() == p.read_bytes()


def test_publish_keeps_folders(spark, tmp_path):
    for name in ("a.txt", "sub/a.txt", "sub/deep er/b.txt"):
        (tmp_path / "from" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "from" / name).write_text(name)
    got = sinks.publish(spark, f"file://{tmp_path}/from", f"file://{tmp_path}/to")
    assert sorted(r.name for r in got.collect()) == ["a.txt", "sub/a.txt", "sub/deep er/b.txt"]
    assert all((tmp_path / "to" / n).read_text() == n for n in ("a.txt", "sub/a.txt", "sub/deep er/b.txt"))


def test_training_text_and_jsonl(spark, tmp_path):
    docs = spark.createDataFrame([("a\r\nb\rc",), (" ",), ("ü",)], "text string").coalesce(1)
    sinks.write_training_text(docs, f"{tmp_path}/t")
    assert [r.value for r in spark.read.text(f"{tmp_path}/t").collect()] == ["a", "b", "c", "ü"]
    sinks.write_jsonl(docs.where("text = 'ü'"), f"{tmp_path}/j")
    assert "".join(p.read_text("utf-8") for p in (tmp_path / "j").glob("*.json")) == '{"text":"ü"}\n'
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_jsonl(docs, f"{tmp_path}/j")


def test_controlled_stop_and_resume(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where, out, check = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check"
    docs.repartition(8).write.parquet(where)
    incremental.run(spark, where, out, check, files_per_batch=1, stop_after=60, progress=f"file://{tmp_path}/p.json")
    said = json.loads((tmp_path / "p.json").read_text())
    assert said["stopped"] and 60 <= said["documents_read"]
    incremental.run(spark, where, out, check, files_per_batch=1)
    want = incremental.accepted(docs, incremental.filters.StreamRules()).select("fp").distinct().count()
    got = spark.read.parquet(out)
    assert got.count() == got.select("fp").distinct().count() == want


def test_targets_that_are_not_reached(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.repartition(2).write.parquet(f"{tmp_path}/in")
    with pytest.raises(RuntimeError, match="before the targets"):
        incremental.run_to_targets(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", {"train": 100, "test": 10**9}, must_reach=True)
    incremental.run_to_targets(spark, f"{tmp_path}/in", f"{tmp_path}/out2", f"{tmp_path}/check2", {"train": 100}, must_reach=True)


def test_ratios_and_duplicates(spark):
    assert split.checked_ratios(0.98, 0.01, 0.01) == (0.98, 0.01, 0.01)
    for wrong in ((0.5, 0.5, 0.0), (0.5, 0.3, 0.1)):
        with pytest.raises(ValueError):
            split.checked_ratios(*wrong)
    rows = spark.createDataFrame([("a",), ("b",)], "h string")
    assert split.without_duplicates(rows, "h").count() == 2
    with pytest.raises(Exception, match="duplicate hash a"):
        split.without_duplicates(rows.union(rows.limit(1)), "h").collect()


def test_maps(spark):
    row = spark.sql("select map('a', 1, 'b', 2) x, map('b', cast(null as int), 'c', 3) y").select(runs.merged(F.col("x"), F.col("y")).alias("m")).first()
    assert row.m == {"a": 1, "b": None, "c": 3}


def test_control_records():
    good = {"schema_version": 1, "state": "RUNNING", "step": 0, "processed_tokens": 5, "run_id": "r"}
    assert runs.status_problems(good) == []
    assert runs.status_problems({"state": "x", "step": -1}) == ["schema_version", "state", "run_id", "step", "processed_tokens"]
    assert runs.manifest_problems({"seed": 7, "source": {"dataset": "d"}}, ["seed", "files"], 7, "d") == ["missing: files"]
    assert runs.manifest_problems({}, [], 7, "d") == ["seed: None", "source"]
    assert runs.path_problems("X\\Data\\Corpus\\Final\\a", ("data", "corpus"), ("pilot",)) == []
    assert runs.path_problems("data/x/corpus/pilot-1", ("data", "corpus"), ("pilot",)) == ["holds pilot", "not under data/corpus"]
    assert runs.provenance_problems({"a": 1, "s": "bad"}, ["a", "b"], {"s": ["good"], "t": ["good"]}) == ["missing: b", "invalid s: 'bad'"]
    kinds, base = {0: "unknown", 1: "control"}, {"<unk>": (0, "unknown"), "<s>": (1, "control")}
    assert runs.special_token_problems({"<unk>": 0, "<s>": 1, "<|a|>": 9}, kinds, base, ["<|a|>"], ["<|a|>"], 0) == []
    assert runs.special_token_problems({"<unk>": 0, "<s>": 2}, {**kinds, 5: "byte"}, base, ["<|a|>"], [], 0) == ["<s>: id 2", "<|a|>: missing", "order of chat tokens", "byte pieces"]
    assert runs.now().endswith("+00:00")
