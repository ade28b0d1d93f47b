import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from quarryline.llm import trie
from quarryline.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, depth long, node long, place string, n_convs string"


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = []
    for path, convs in members.items():
        subtree = [p for p in members if p[: len(path)] == path]
        kids = [p for p in subtree if len(p) == len(path) + 1]
        leaves = sum(not any(len(x) == len(p) + 1 and x[: len(p)] == p for x in members) for p in subtree)
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in subtree if p)
        ends = ",".join(map(str, sorted(c for c in convs if made[c] == path)))
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def given(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, "p", "n") for r in rows], SCHEMA).repartition(parts)


def tree(df):
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    assert df.columns == names and {t for n, t in df.dtypes if n != "ends_sha256"} == {"bigint"}
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 2)
    monkeypatch.setattr(trie, "ROWS", 1)
    monkeypatch.setattr(trie, "COPIES", 1)
    rnd = random.Random(seed)
    rows = []
    for conv in rnd.sample(range(330), 60) + [100, 200] * (seed != 1):
        for turn in range(rnd.choice([0, 1, 2, 3, 5, 7])):
            rows.append((conv, rnd.choice([turn, turn, 0, None]), rnd.choice(["user", "assistant", None]), rnd.choice(["a", "a", "é🙂", "", None, "long " * 400])))
    rows += [(150, 0, "user", "again")] * 7 + [(151, 0, "user", "again")] * 7 + [(None, 0, "user", "x")]
    rows += [(170 + k, t, "user", f"the same {t}") for k in range(12) for t in range(9)]
    rows += [(300, t, "user", str(t)) for t in range(60)]
    rnd.shuffle(rows)
    assert tree(trie.prefix_tree(given(spark, rows))) == plain(rows)


def test_small_tables(spark):
    one = [(5, 0, "user", "a"), (5, 1, "assistant", "b")]
    for rows in ([], [(None, 0, "a", "b")], one, [(0, 0, "user", "a")], [(7, k, "user", "x") for k in range(3)]):
        assert tree(trie.prefix_tree(given(spark, rows, 1))) == plain(rows)


def test_query_equals_sql(spark, sf_dir):
    got = QUERIES["op12_prefix_trie"](spark, sf_dir)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    found = c.execute(ORACLES["op12_prefix_trie"])
    names = [d[0] for d in found.description]
    wanted = sorted(found.fetchall(), key=repr)
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr) == wanted
    rows = c.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    assert tree(got) == plain(rows)
