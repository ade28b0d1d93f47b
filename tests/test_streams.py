"""Streams: counts, stops, targets and shards, however the runs are cut."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.sources import sinks
from quarryline.streaming import control, incremental


def arriving(spark, sf_dir, folder, files=8, rows=10):
    """Files of so many documents each, older ones first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(files * rows).collect()
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    for k in range(files):
        spark.createDataFrame(docs[k * rows : (k + 1) * rows], schema).coalesce(1).write.mode("append").parquet(folder)
    return docs


def test_a_stop_does_not_rest_on_what_spark_remembers(spark, sf_dir, tmp_path):
    arriving(spark, sf_dir, f"{tmp_path}/in")
    key = "spark.sql.streaming.numRecentProgressUpdates"
    spark.conf.set(key, "2")
    try:
        incremental.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", files_per_batch=1, stop_after=30, progress=f"file://{tmp_path}/p.json", every=10)
        said = json.loads((tmp_path / "p.json").read_text())
        assert said["stopped"] and said["state"] == "stopped" and 30 <= said["documents_read"] < 80 and said["documents_read"] == 10 * said["batches"]
        assert len([p for p in (tmp_path / "check/commits").iterdir() if p.name.isdigit()]) in (said["batches"], said["batches"] + 1)
        incremental.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", files_per_batch=1, progress=f"file://{tmp_path}/q.json")
        rest = json.loads((tmp_path / "q.json").read_text())
        assert rest["state"] == "finished" and 80 - said["documents_read"] - 10 <= rest["documents_read"] <= 80 - said["documents_read"]
    finally:
        spark.conf.unset(key)


def test_errors_are_reported(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.parquet").write_bytes(b"no table")
    with pytest.raises(Exception):
        incremental.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", progress=f"file://{tmp_path}/p.json")
    said = json.loads((tmp_path / "p.json").read_text())
    assert said["state"] == "failed" and said["error"] and said["documents_read"] == 0


def test_reports_take_the_old_ones_place(spark, tmp_path):
    for k in range(3):
        sinks.write_json(spark, f"file://{tmp_path}/r.json", {"k": k, "ü": "é"})
        assert json.loads((tmp_path / "r.json").read_text("utf-8")) == {"k": k, "ü": "é"}
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["r.json"]


def test_nothing_is_read_after_the_last_target(spark, sf_dir, tmp_path):
    arriving(spark, sf_dir, f"{tmp_path}/in")
    targets = {"train": 500}
    incremental.run_to_targets(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", targets, files_per_batch=1, must_reach=True, progress=f"file://{tmp_path}/p.json")
    said = json.loads((tmp_path / "p.json").read_text())
    first = control.Commits(spark, f"{tmp_path}/out")
    assert said["state"] == "full" and said["documents_read"] == 10 * len(first.numbers()) < 80 and first.last() == {"taken": {"train": 500}}
    # higher targets go on with the batch that wasn't taken
    incremental.run_to_targets(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", {"train": 10**9}, files_per_batch=1)
    got = spark.read.parquet(f"{tmp_path}/out").where("split = 'train'").agg(F.sum("taken"), F.count("*"), F.count_distinct("fp")).first()
    assert first.numbers() == list(range(8)) and first.last()["taken"]["train"] == got[0] and got[1] >= got[2]


def shard_bytes(spark, out):
    """The stream of each split, read back through the manifests, and the names of all files."""
    from quarryline.streaming import shard_stream

    names = shard_stream.write_manifests(spark, f"file://{out}")
    found = {}
    for split, name in names.items():
        manifest = json.loads((out / name).read_text())
        assert [hashlib.sha256((out / s["name"]).read_bytes()).hexdigest() for s in manifest["shards"]] == [s["sha256"] for s in manifest["shards"]]
        found[split] = b"".join((out / s["name"]).read_bytes() for s in manifest["shards"])
        assert len(found[split]) == 2 * manifest["total_tokens"]
        assert all(s["tokens"] == 64 for s in manifest["shards"][:-1])
    listed = {s["name"] for n in names.values() for s in json.loads((out / n).read_text())["shards"]}
    assert {p.name for p in out.iterdir() if p.suffix in (".bin", ".part")} == listed
    return found


@pytest.mark.parametrize("crash", ["before the commit", "after the commit"])
def test_shards_are_the_same_bytes_after_a_crash(spark, sf_dir, tmp_path, monkeypatch, crash):
    from quarryline.sources import shards
    from quarryline.streaming import shard_stream

    arriving(spark, sf_dir, f"{tmp_path}/in", files=6)
    args = dict(tokens_per_shard=64, files_per_batch=1)
    shard_stream.run(spark, f"{tmp_path}/in", f"file://{tmp_path}/whole", f"{tmp_path}/check", **args)
    whole = shard_bytes(spark, tmp_path / "whole")
    assert len(whole["train"]) > 64 * 2 * 20

    write, calls = control.Commits.write, []

    def failing(self, batch, record):
        calls.append(batch)
        if batch == 2 and calls.count(2) == 1:
            if crash == "after the commit":
                write(self, batch, record)
            raise RuntimeError("killed")
        write(self, batch, record)

    monkeypatch.setattr(control.Commits, "write", failing)
    with pytest.raises(Exception, match="killed"):
        shard_stream.run(spark, f"{tmp_path}/in", f"file://{tmp_path}/cut", f"{tmp_path}/check2", **args)
    if crash == "before the commit":  # what the batch wrote is there, and nobody vouches for it
        (tmp_path / "cut/_writing").mkdir(exist_ok=True)
        (tmp_path / "cut/_writing/unfinished").write_bytes(b"x")
        (tmp_path / "cut/train-000999.bin").write_bytes(b"x")
    shard_stream.run(spark, f"{tmp_path}/in", f"file://{tmp_path}/cut", f"{tmp_path}/check2", **args)
    assert calls.count(2) == (2 if crash == "before the commit" else 1)
    assert shard_bytes(spark, tmp_path / "cut") == whole
    tokens = np.frombuffer(whole["train"], "<u2")
    got = shards.sequences(spark, f"file://{tmp_path}/cut", 32, 320, "train.manifest.json").orderBy("sequence").collect()
    assert [t for r in got for t in r.tokens] == tokens[320 : len(tokens) // 32 * 32].tolist()


def test_shards_stop_and_end_at_their_targets(spark, sf_dir, tmp_path):
    from quarryline.streaming import shard_stream

    arriving(spark, sf_dir, f"{tmp_path}/in", files=5)
    args = dict(tokens_per_shard=64, files_per_batch=1)
    shard_stream.run(spark, f"{tmp_path}/in", f"file://{tmp_path}/whole", f"{tmp_path}/check", **args)
    whole = shard_bytes(spark, tmp_path / "whole")
    shard_stream.run(spark, f"{tmp_path}/in", f"file://{tmp_path}/two", f"{tmp_path}/check2", stop_after=20, **args)
    shard_stream.run(spark, f"{tmp_path}/in", f"file://{tmp_path}/two", f"{tmp_path}/check2", **args)
    assert shard_bytes(spark, tmp_path / "two") == whole
    shard_stream.run(spark, f"{tmp_path}/in", f"file://{tmp_path}/some", f"{tmp_path}/check3", targets={"train": 701}, progress=f"file://{tmp_path}/p.json", **args)
    assert shard_bytes(spark, tmp_path / "some") == {"train": whole["train"][: 2 * 701]}
    assert json.loads((tmp_path / "p.json").read_text())["state"] == "full"
    with pytest.raises(ValueError, match="another checkpoint"):
        shard_stream.run(spark, f"{tmp_path}/in", f"file://{tmp_path}/some", f"{tmp_path}/check4", **args)


@pytest.mark.parametrize("files", [1, 3, 7])
def test_near_duplicates_do_not_depend_on_the_files(spark, sf_dir, tmp_path, monkeypatch, files):
    from quarryline.operators import dedup
    from quarryline.streaming import near_stream

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    docs = [r.asDict() for r in docs[:120]]
    for k in range(8, 120, 8):  # copies, copies with other case, and texts a word apart, near and far
        docs[k]["text"] = docs[k - 8]["text"].upper() if k % 3 == 0 else docs[k // 2]["text"] + " end" if k % 3 == 1 else docs[k % 40]["text"]
    rows = [tuple(d.values()) for d in docs]
    marks = spark.createDataFrame(rows, schema).select("doc_id", *dedup.marks_of(F.col("text")))
    wanted = {r.doc_id: r.label for r in dedup.survivors(marks).collect()}
    assert {"kept", "exact_duplicate", "near_duplicate"} <= set(wanted.values())
    for k in range(files):
        part = rows[k * len(rows) // files : (k + 1) * len(rows) // files]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    args = (spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", 1)
    if files == 3:  # killed with a batch written but not committed
        write = control.Commits.write
        monkeypatch.setattr(control.Commits, "write", lambda self, batch, record: write(self, batch, record) if batch != 1 else (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(Exception, match="killed"):
            near_stream.run(*args)
        monkeypatch.setattr(control.Commits, "write", write)
    near_stream.run(*args)
    got = spark.read.parquet(f"{tmp_path}/out/labels").collect()
    assert {r.doc_id: r.label for r in got} == wanted and len(got) == len(wanted)
