"""Every query with an equivalent in SQL gives the same rows on another engine."""

import glob
import os

import duckdb
import pytest

from quarryline.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def other(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows_of(columns, rows):
    order = sorted(columns)
    return order, sorted((tuple(r[columns.index(c)] for c in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal(spark, sf_dir, other, name):
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = other.execute(ORACLES[name])
    assert got == rows_of([d[0] for d in found.description], found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_results_do_not_depend_on_partitions(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.repartition(7, "text").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("dedup_min_key", "token_offsets", "pack_blocks", "near_dup_survivors", "quota_prefix_select"):
        a, b = (sorted(map(tuple, QUERIES[name](spark, d).collect())) for d in (sf_dir, str(tmp_path)))
        assert a == b


def test_edit_distances_of_every_pair_of_turns(spark, tmp_path):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, above = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        return row[-1]

    said = ["Grüße  an alle", "Gruße an\talle", "日本語 テキスト", "日本 テキスト!", "", "ünï 123"]
    rows = [(c, t, "user", said[(c + t * (c + 1)) % 6]) for c in range(4) for t in range(5)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): r.distance for r in QUERIES["text_levenshtein"](spark, str(tmp_path)).collect()}
    text = {(c, t): " ".join(x.split()) for c, t, _, x in rows}
    assert got == {(c, t): distance(text[c, t], text[c, t + 1]) for c in range(4) for t in range(4)}
