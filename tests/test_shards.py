"""Shards read from where a sequence lies, and points in intervals."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.operators import intervals, selection
from quarryline.sources import readers, shards


def written(folder, sizes, seed=1):
    rng = np.random.default_rng(seed)
    tokens = rng.integers(0, 1 << 16, sum(sizes)).astype("<u2")
    at, folder_parts = 0, []
    for k, n in enumerate(sizes):
        (folder / f"shard-{k:06d}.bin").write_bytes(tokens[at : at + n].tobytes())
        folder_parts.append({"name": f"shard-{k:06d}.bin", "tokens": n})
        at += n
    (folder / "manifest.json").write_text(json.dumps({"total_tokens": sum(sizes), "shards": folder_parts}))
    return tokens


@pytest.mark.parametrize("sizes", [[100, 100, 100, 37], [3, 0, 250, 1, 1, 70, 0], [5], []])
@pytest.mark.parametrize("start", [0, 16, 160])
def test_sequences_over_borders(spark, tmp_path, sizes, start):
    tokens = written(tmp_path, sizes)
    if start > sum(sizes):
        with pytest.raises(Exception, match="behind"):
            shards.sequences(spark, f"file://{tmp_path}", 16, start).collect()
        return
    wanted = [tokens[k : k + 16].tolist() for k in range(start, len(tokens) - 15, 16)]
    for manifest in (None, "manifest.json"):
        got = shards.sequences(spark, f"file://{tmp_path}", 16, start, manifest, tokens_per_task=50).orderBy("sequence").collect()
        assert [r.sequence for r in got] == list(range(len(wanted))) and [r.tokens for r in got] == wanted


def test_only_what_is_asked_for_is_read(spark, tmp_path):
    tokens = written(tmp_path, [1000] * 10)
    reader = shards.ShardReader({"path": f"file://{tmp_path}", "context": "100", "start": "9000", "manifest": "manifest.json", "tokens_per_task": "300"})
    parts = reader.partitions()
    assert sum(n for p in parts for _, _, n in p.pieces) == 1000 and len(parts) == 4
    for k in range(9):  # what lies before isn't even opened
        (tmp_path / f"shard-{k:06d}.bin").unlink()
    got = shards.sequences(spark, f"file://{tmp_path}", 100, 9000, "manifest.json").orderBy("sequence").collect()
    assert [t for r in got for t in r.tokens] == tokens[9000:].tolist()
    with pytest.raises(Exception):
        shards.sequences(spark, f"file://{tmp_path}", 100, 0, "manifest.json").collect()


def test_what_is_wrong_is_said(spark, tmp_path):
    written(tmp_path, [100, 50])
    for context, start in ((16, 5), (0, 0), (16, -16)):
        with pytest.raises(ValueError):
            readers.read_shards(spark, f"file://{tmp_path}", context, start)
    (tmp_path / "shard-000001.bin").write_bytes(b"x" * 40)
    with pytest.raises(Exception, match="shorter"):
        readers.read_shards(spark, f"file://{tmp_path}", 10, 0, "manifest.json").collect()
    (tmp_path / "shard-000001.bin").write_bytes(b"x" * 41)
    with pytest.raises(Exception, match="whole tokens"):
        readers.read_shards(spark, f"file://{tmp_path}", 10).collect()
    (tmp_path / "manifest.json").write_text(json.dumps({"total_tokens": 7, "shards": []}))
    with pytest.raises(Exception, match="manifest says"):
        readers.read_shards(spark, f"file://{tmp_path}", 10, 0, "manifest.json").collect()


@pytest.mark.parametrize("sent", [100_000, 5])
def test_points_in_consecutive_intervals(spark, monkeypatch, sent):
    monkeypatch.setattr(selection, "SENT", sent)
    rnd = random.Random(5)
    sizes = [rnd.choice([0, 1, 1, 2, 3, 1000, 70_000]) for _ in range(60)] + [5_000_000] + [1] * 300  # one long, many short side by side
    ends = np.cumsum(sizes)
    points = [rnd.randrange(int(ends[-1])) for _ in range(300)] + [0, int(ends[-1]) - 1, int(ends[-1]), -1, None] + list(range(int(ends[-1]) - 300, int(ends[-1])))
    made = intervals.consecutive(spark.createDataFrame(list(enumerate(sizes)), "shard long, tokens int"), "shard", "tokens")
    got = intervals.holding(spark.createDataFrame([(p, k) for k, p in enumerate(points)], "at long, id int"), "at", made)
    wanted = {k: int(np.searchsorted(ends, p, "right")) for k, p in enumerate(points) if p is not None and 0 <= p < ends[-1]}
    assert {r.id: r.shard for r in got.collect()} == wanted and got.count() == len(wanted)


def test_intervals_that_overlap_and_none(spark):
    spans = spark.createDataFrame([("a", 0, 10), ("b", 5, 6), ("c", 5, 5), ("d", -8, 7)], "name string, start long, stop long")
    points = spark.createDataFrame([(5,), (6,), (-8,), (10,)], "at long")
    got = sorted((r.at, r.name) for r in intervals.holding(points, "at", spans).collect())
    assert got == [(-8, "d"), (5, "a"), (5, "b"), (5, "d"), (6, "a"), (6, "d")]
    assert intervals.holding(points, "at", spans.where(F.lit(False))).count() == 0
