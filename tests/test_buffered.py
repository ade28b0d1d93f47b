"""A seeded shuffle through a buffer, against playing it through."""

import hashlib
import random

import pytest

from quarryline.operators import select


def played(keys, seed, size):
    """Row by row, with a buffer that is a list."""
    order = lambda k: sorted(range(size), key=lambda s: (hashlib.md5(f"{seed}:{k}:{s}".encode()).hexdigest(), s))
    keys, held, out = sorted(keys), [None] * size, []
    for k in range(len(keys) // size + 2):
        for turn, slot in enumerate(order(k)):
            if held[slot] is not None:
                out.append(held[slot])
            at = k * size + turn
            held[slot] = keys[at] if at < len(keys) else None
    return out


@pytest.mark.parametrize("n,size", [(0, 4), (3, 8), (8, 8), (9, 8), (50, 8), (64, 16), (37, 1)])
def test_equals_a_buffer_played_through(spark, n, size):
    keys = random.Random(n).sample(range(-500, 500), n)
    rows = spark.createDataFrame([(k, f"t{k}", 1) for k in keys], "doc_id long, text string, place_ long")
    wanted = played(keys, 5, size)
    assert sorted(wanted) == sorted(keys)
    for parts in (1, 5):
        got = select.buffered(rows.repartition(parts), "doc_id", 5, size).orderBy("place").collect()
        assert [r.doc_id for r in got] == wanted and [r.place for r in got] == list(range(n)) and all(r.text == f"t{r.doc_id}" for r in got)
    came = {k: i for i, k in enumerate(sorted(keys))}
    assert all(abs(place - came[k]) < 2 * size for place, k in enumerate(wanted))


def test_goes_on_at_any_row(spark):
    keys = list(range(0, 130, 2))
    rows = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    wanted = played(keys, 9, 8)
    for start in (0, 1, 7, 8, 20, 57, 64, 65, 100):
        got = select.buffered(rows, "doc_id", 9, 8, start).orderBy("place").collect()
        assert [(r.place, r.doc_id) for r in got] == list(enumerate(wanted))[start:]
    assert played(keys, 10, 8) != wanted
