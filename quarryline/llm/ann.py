"""Nearest neighbours by largest cosine: NN-descent graphs, searched greedily.

Equal vectors are one node. Nodes are dealt by a hash over SHARDS shards, over more once these would
hold more than LARGEST nodes, and each shard gets a graph of its own. It starts from neighbours within
blocks of nodes whose signs under random hyperplanes sort next to each other, in STARTS orders. Then
neighbours of neighbours are compared: each round takes every node's neighbours, forward and (at most
DEGREE) backward, and offers each the others that beat its worst one. Only pairs with a neighbour that
is new since the round before are compared, and rounds end once few lists change. The index is a table
of all nodes with their vectors and neighbours. So vectors are shuffled once to build it and once for
each search, however many rounds there are; a row for each neighbour is never shuffled.

A query meets each shard once. It starts there from the PIVOTS nearest of the shard's drawn nodes and
from its own vector's node. Each step expands the best unexpanded half of its beam, the best nodes it
has met, until none is left there. How wide the beam must be depends on the vectors, so it is found
first: SAMPLE queries are also compared with every node, and the beam is doubled, and with it the number
of drawn nodes, until their search meets TARGET of their true neighbours, or until it holds every node
of a shard. Then all queries are searched with that beam. Graph and search use half precision.

The scores of the nodes that half precision can't tell from the best are then computed in double
precision from the original vectors, nodes are replaced by their rows, and ties go to the smaller vec_id.

Shards, blocks of queries, neighbour lists and beams are bounded, so no task gathers a hot group.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor
do rows with a null vec_id; a cosine needs equal lengths, so vectors of each length are searched among
themselves; of rows that repeat a vec_id each is a query and a candidate of its own, with its own
vector; with fewer candidates than k all that the search meets are returned; other columns aren't
looked at; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.sources.scratch import materialize, passing

DEGREE = 32
BLOCK = 1024
PLANES = 24
STARTS = 6
#: Rounds end once at most this share of the list entries is new.
SETTLED = 0.05
#: Shards of a table of some size, what fewer nodes than SHARDS * SMALL are cut into, and the most that one holds.
SHARDS, SMALL, LARGEST = 24, 400, 65_536
#: Numbers that a shard's vectors may have; long vectors make shards smaller.
NUMBERS = 1 << 24
#: Queries that meet a shard in one task.
TOGETHER = 16_384
#: With the first beam, one of so many nodes of a shard is drawn.
DRAWN = 16
#: The first beam and the pivots of a search.
BEAM, PIVOTS = 96, 8
#: A beam is wide enough once this share of the true neighbours of SAMPLE queries is met.
TARGET, SAMPLE = 0.96, 200
#: Scores in half precision are off by less than half of this.
ROUNDING = 0.002


def usable(table: DataFrame) -> DataFrame:
    """vec_id, embedding (array of double), its length n and a 128-bit key of each vector that takes part."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null and size(embedding) > 0")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    key = F.struct(F.xxhash64("embedding").alias("x"), F.xxhash64(F.lit(1), "embedding").alias("y"))
    return rows.where(finite & F.exists("embedding", lambda x: x != 0)).withColumn("n", F.size("embedding")).withColumn("key", key)


def _rows(column: pa.Array, kind: str) -> np.ndarray:
    """A matrix from a column of arrays or of bytes, all of one length."""
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def coded(nodes: DataFrame) -> DataFrame:
    """id and half-precision unit vector of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = _unit(_rows(batch.column(1), "f8")).astype("<f2")
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in m], pa.binary())], ["id", "vec"])

    return nodes.select("id", "embedding").mapInArrow(run, "id long, vec binary")


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """Unit vectors in single precision from half-precision ones."""
    m = _rows(column.combine_chunks(), "<f2").astype(np.float32)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


class Lists:
    """The best neighbours met of each row of m: ids, scores, and which are new. Empty places have id -1."""

    def __init__(self, m: np.ndarray):
        self.m, self.size, self.degree = m, len(m), min(DEGREE, len(m) - 1)
        self.ids = np.full((self.size, self.degree), -1, np.int32)
        self.score = np.full((self.size, self.degree), -9, np.float32)
        self.new = np.zeros((self.size, self.degree), bool)

    def take(self, src: np.ndarray, dst: np.ndarray, score: np.ndarray) -> None:
        """Offers each src a dst; an entry that was there before isn't new."""
        once = np.unique(src.astype(np.int64) * self.size + dst, return_index=True)[1]
        src, dst, score = src[once], dst[once], score[once]
        order = np.lexsort((-score, src))
        at, row, place = _places(src[order])
        kept = place < self.degree
        order, row, place = order[kept], row[kept], self.degree + place[kept]
        ids, best, new = (np.concatenate((x[at], np.full((len(at), self.degree), fill, x.dtype)), axis=1) for x, fill in ((self.ids, -1), (self.score, -9), (self.new, True)))
        ids[row, place], best[row, place] = dst[order], score[order]
        sort = np.argsort(ids, axis=1, kind="stable")
        ids, best, new = (np.take_along_axis(x, sort, 1) for x in (ids, best, new))
        again = ids[:, 1:] == ids[:, :-1]
        ids[:, 1:][again], best[:, 1:][again] = -1, -9
        top = np.argpartition(-best, self.degree - 1, axis=1)[:, : self.degree]
        self.ids[at], self.score[at], self.new[at] = (np.take_along_axis(x, top, 1) for x in (ids, best, new & (ids >= 0)))

    def within_blocks(self) -> None:
        """Offers each row the best within its block of rows whose signs sort next to each other, in STARTS orders."""
        planes = np.random.default_rng(5).standard_normal((self.m.shape[1], STARTS * PLANES)).astype(np.float32)
        codes = ((self.m @ planes > 0).reshape(self.size, STARTS, PLANES).astype(np.int64) << np.arange(PLANES)).sum(axis=2)
        for order in np.argsort(codes, axis=0, kind="stable").T:
            for ids in np.array_split(order, math.ceil(self.size / BLOCK)):
                score = self.m[ids] @ self.m[ids].T
                np.fill_diagonal(score, -9)
                k = min(self.degree, len(ids) - 1)
                top = np.argpartition(-score, k - 1, axis=1)[:, :k]
                self.take(np.repeat(ids, k), ids[top].ravel(), np.take_along_axis(score, top, 1).ravel())

    def both_ways(self) -> tuple[np.ndarray, np.ndarray]:
        """Neighbours of each row, forward and at most DEGREE backward, each once, and which are new."""
        src, at = np.nonzero(self.ids >= 0)
        mixed = np.random.default_rng(6).permutation(len(src))
        mixed = mixed[np.argsort(self.ids[src, at][mixed], kind="stable")]
        src, at = src[mixed], at[mixed]
        to, row, place = _places(self.ids[src, at])
        kept = place < self.degree
        kept[kept] = ~(self.ids[to[row[kept]]] == src[kept, None]).any(axis=1)
        back, fresh = np.full_like(self.ids, -1), np.zeros_like(self.new)
        back[to[row[kept]], place[kept]], fresh[to[row[kept]], place[kept]] = src[kept], self.new[src, at][kept]
        return np.concatenate((self.ids, back), axis=1), np.concatenate((self.new, fresh), axis=1)

    def descend(self) -> None:
        """Compares neighbours of neighbours until few lists change."""
        vectors = np.concatenate((self.m, np.full((1, self.m.shape[1]), np.nan, np.float32)))  # -1 is the last, which beats nothing
        step = max(1, (1 << 20) // (2 * DEGREE * max(2 * DEGREE, self.m.shape[1])))
        changed = True
        while changed:  # ends, for scores in the lists only grow
            around, fresh = self.both_ways()
            self.new[:] = False
            offers = []
            for a in range(0, self.size, step):
                ids, new = around[a : a + step], fresh[a : a + step]
                v = vectors[ids]
                score = v @ v.transpose(0, 2, 1)
                good = score > self.score[ids].min(axis=2)[:, :, None]
                good &= new[:, :, None] | new[:, None, :]
                good[:, range(ids.shape[1]), range(ids.shape[1])] = False
                at, i, j = np.nonzero(good)
                offers.append((ids[at, i], ids[at, j], score[at, i, j]))
                if sum(len(x[0]) for x in offers) > 1 << 20 or a + step >= self.size:
                    self.take(*map(np.concatenate, zip(*offers)))
                    offers = []
            changed = self.new.sum() > SETTLED * self.new.size


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ones of sorted keys, and for each key the number of its run and its place there."""
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    long = np.diff(np.append(first, len(keys)))
    return keys[first], np.repeat(np.arange(len(first)), long), np.arange(len(keys)) - np.repeat(first, long)


def linked(nodes: DataFrame) -> DataFrame:
    """The index: shard, id, vec, and others, the places (int32) of its neighbours in its shard's nodes in the order of id."""

    def run(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("id")
        lists = Lists(_vectors(shard["vec"]))
        if lists.size > 1:
            lists.within_blocks()
            lists.descend()
        others = [x[x >= 0].astype("<i4").tobytes() for x in lists.both_ways()[0]]
        return shard.append_column("others", pa.array(others, pa.binary()))

    return nodes.select("shard", "id", "vec").groupBy("shard").applyInArrow(run, "shard int, id long, vec binary, others binary")


def scored(pairs: DataFrame, queries: DataFrame, points: DataFrame) -> DataFrame:
    """Adds score to pairs of q and node. queries: q, qvec; points: id, vec, all of one precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (_rows(batch.column(k), "<f2").astype(np.float64) for k in (2, 3))
                score = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["q", "node", "score"])

    joined = pairs.select("q", "node").join(points.select(F.col("id").alias("node"), "vec"), "node").join(queries, "q")
    return joined.select("q", "node", "qvec", "vec").mapInArrow(run, "q long, node long, score double")


def best_first(by: str = "q") -> Column:
    return F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "node"))


def truth(sample: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """q, node: the k nearest other nodes of each of at most SAMPLE queries, by comparison with all nodes."""
    asked = sample.select("q", "start", "embedding").collect()
    ids, own = [r["q"] for r in asked], [r["start"] for r in asked]
    shared = sample.sparkSession.sparkContext.broadcast(np.array([r["embedding"] for r in asked]))  # SAMPLE vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = _unit(shared.value)
        best, of = np.full((len(q), k), -9.0), np.zeros((len(q), k), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.asarray(batch.column(0))
            score = np.concatenate((best, np.where(names == np.array(own)[:, None], -9.0, q @ _unit(_rows(batch.column(1), "f8")).T)), axis=1)
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            of = np.take_along_axis(np.concatenate((of, np.broadcast_to(names, (len(q), len(names)))), axis=1), top, 1)
            best = np.take_along_axis(score, top, 1)
        good = best > -9
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids), k).reshape(good.shape)[good]), pa.array(of[good]), pa.array(best[good])], ["q", "node", "score"])

    found = nodes.select("id", "embedding").mapInArrow(run, "q long, node long, score double")
    return found.withColumn("place", best_first()).where(F.col("place") <= k).select("q", "node")


def _meet(m: np.ndarray, around: np.ndarray, v: np.ndarray, own: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of m, and scores, of the beams in which the queries v end. own: each query's own row or -1."""
    size = len(m)
    drawn = np.random.default_rng(7).permutation(size)[: size if beam >= size else max(PIVOTS, math.ceil(size / DRAWN * beam / BEAM))]
    beam, half = min(beam, size), max(1, min(beam, size) // 2)
    ids, best, done = np.full((len(v), beam), -1), np.full((len(v), beam), -9, np.float32), np.ones((len(v), beam), bool)
    seen, last = np.zeros(len(v) * size, bool), np.zeros(len(v) * size, np.int32)

    def take(row: np.ndarray, at: np.ndarray) -> None:
        """Queries row, in order, meet nodes at."""
        nonlocal ids, best, done
        flat = row * size + at
        flat = flat[~seen[flat]]
        last[flat] = np.arange(len(flat))
        flat = flat[last[flat] == np.arange(len(flat))]  # each once
        seen[flat] = True
        row, at = np.divmod(flat, size)
        score = np.einsum("ij,ij->i", v[row], m[at])
        # what falls out of a beam is forgotten, for it can't come back: the beam's worst score only grows
        good = score > best.min(axis=1)[row]
        to, row, place = _places(row[good])
        if not len(to):
            return
        wide = place.max() + 1
        more = np.full((len(to), wide), -1), np.full((len(to), wide), -9, np.float32), np.ones((len(to), wide), bool)
        for x, now in zip(more, (at[good], score[good], False)):
            x[row, place] = now
        both = [np.concatenate((x[to], y), axis=1) for x, y in zip((ids, best, done), more)]
        top = np.argpartition(-both[1], beam - 1, axis=1)[:, :beam]
        ids[to], best[to], done[to] = (np.take_along_axis(x, top, 1) for x in both)

    score = v @ m[drawn].T
    begins = size if beam == size else min(PIVOTS, len(drawn))
    begin = drawn[np.argpartition(-score, begins - 1, axis=1)[:, :begins]]
    begin = np.concatenate((begin, np.where(own < 0, begin[:, 0], own)[:, None]), axis=1)
    take(np.repeat(np.arange(len(v)), begin.shape[1]), begin.ravel())
    while not done.all():
        left = np.where(done, -9, best)
        top = np.argpartition(-left, half - 1, axis=1)[:, :half]
        row, k = np.nonzero(np.take_along_axis(left, top, 1) > -9)
        done[row, top[row, k]] = True
        near = around[ids[row, top[row, k]]]
        take(np.repeat(row, near.shape[1])[(near >= 0).ravel()], near[near >= 0])
    return ids, best


def search(queries: DataFrame, index: DataFrame, shards: int, beam: int, k: int) -> DataFrame:
    """q, node, score of what each query meets in any shard that may be among its k + 1 best. queries: q, start, qvec."""

    def run(nodes: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if nodes.num_rows and asked.num_rows:
            nodes = nodes.sort_by("id")
            names, m, v = nodes["id"].to_numpy(), _vectors(nodes["vec"]), _vectors(asked["qvec"])
            lists = [np.frombuffer(x, "<i4") for x in nodes["others"].to_pylist()]
            around = np.full((len(m), max(1, *map(len, lists))), -1)
            for x, others in zip(around, lists):
                x[: len(others)] = others
            q, start = asked["q"].to_numpy(), asked["start"].to_numpy()
            own = np.minimum(np.searchsorted(names, start), len(names) - 1)
            own = np.where(names[own] == start, own, -1)
            step = min(256, max(16, (1 << 21) // len(m)))
            for a in range(0, len(q), step):
                ids, best = _meet(m, around, v[a : a + step], own[a : a + step], beam)
                # k + 1 nodes suffice, for one may be the query's own
                enough = -np.partition(-best, k, axis=1)[:, k] if best.shape[1] > k else np.full(len(best), -9)
                row, at = np.nonzero((ids >= 0) & (best >= enough[:, None] - ROUNDING))
                found.append((q[a : a + step][row], names[ids[row, at]], best[row, at].astype(float)))
        columns = [np.concatenate(x) for x in zip(*found)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(columns, names=["q", "node", "score"])

    parts = math.ceil(queries.count() / TOGETHER) or 1
    everywhere = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("part", F.pmod(F.xxhash64("q"), F.lit(parts)))
    copies = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    there, asked = (x.repartition(apart(shards * parts), "shard", "part").groupBy("shard", "part") for x in (copies, everywhere))
    return there.cogroup(asked).applyInArrow(run, "q long, node long, score double")


def apart(groups: int) -> int:
    """Partitions that so many groups may be hashed to without many in one of them."""
    return min(4 * groups, 4096)


def candidates(asked: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """q, node: what may be among the k nearest of each query. asked: q, start, embedding; nodes: id, embedding."""
    count, width = nodes.count(), F.size("embedding").alias("n")
    largest = max(SMALL, min(LARGEST, NUMBERS // nodes.select(width).first()["n"]))
    shards = max(min(SHARDS, math.ceil(count / SMALL)), math.ceil(count / largest))
    points = materialize(coded(nodes).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")), "points")
    index = materialize(linked(points.repartition(apart(shards), "shard")), "index")
    queries = asked.select("q", "start").join(points.select(F.col("id").alias("start"), F.col("vec").alias("qvec")), "start")
    queries = materialize(queries, "queries")
    sample = materialize(asked.orderBy(F.xxhash64("q"), "q").limit(SAMPLE), "sample")
    near = materialize(truth(sample, nodes, k), "truth")
    wanted, beam, most = near.count(), max(BEAM, 4 * k), points.groupBy("shard").count().agg(F.max("count")).first()[0]
    few = materialize(queries.join(F.broadcast(sample.select("q")), "q", "left_semi"), "queries")  # SAMPLE rows
    while True:
        met = materialize(search(few, index, shards, beam, k), "met")
        if beam >= most or near.join(met, ["q", "node"], "left_semi").count() >= TARGET * wanted:
            break
        beam *= 2
    if not queries.join(few, "q", "left_anti").isEmpty():
        met = materialize(search(queries, index, shards, beam, k), "met")
    last = met.withColumn("place", best_first()).where(F.col("place") == k + 1).select("q", F.col("score").alias("last"))
    return met.join(last, "q", "left").where(F.col("last").isNull() | (F.col("score") >= F.col("last") - ROUNDING)).select("q", "node")


def of_one_length(rows: DataFrame, k: int, every: int) -> DataFrame:
    """query_id, rank, vec_id, score among rows (row, vec_id, embedding, key) of one length."""
    first = materialize(rows.groupBy("key").agg(F.min("row").alias("id")), "firsts")  # written, so that the join may split a common vector
    members = materialize(rows.select("row", "vec_id", "key").join(first, "key").select("id", "row", "vec_id"), "members")
    nodes = rows.join(first.select(F.col("id").alias("row")), "row", "left_semi").select(F.col("row").alias("id"), "embedding")
    nodes = materialize(nodes, "nodes")
    asked = members.where(F.col("vec_id") % every == 0).select(F.col("row").alias("q"), F.col("vec_id").alias("query_id"), F.col("id").alias("start"))
    asked = materialize(asked.join(nodes.withColumnRenamed("id", "start"), "start"), "asked")
    if asked.isEmpty():
        return members.where("false").selectExpr("vec_id query_id", "0 rank", "vec_id", "0d score")
    with passing(rows.sparkSession):
        met = materialize(candidates(asked, nodes, k), "candidates", lasting=True)
    exact = scored(met, asked.select("q", F.col("embedding").alias("qvec")), nodes.select("id", F.col("embedding").alias("vec")))
    # of equal vectors the k + 1 smallest vec_ids suffice, for one may be the query's own
    small = F.row_number().over(Window.partitionBy("id").orderBy("vec_id", "row"))
    some = members.withColumn("place", small).where(F.col("place") <= k + 1).select(F.col("id").alias("node"), "row", "vec_id")
    order = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "row"))
    ranked = exact.join(some, "node").where("row <> q").withColumn("rank", order).where(F.col("rank") <= k)
    return ranked.join(asked.select("q", "query_id"), "q").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(table: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id that `every` divides, its k nearest of the other rows found."""
    rows = materialize(usable(table).withColumn("row", F.monotonically_increasing_id()), "vectors")
    lengths = [r["n"] for r in rows.groupBy("n").count().orderBy("n").collect()]  # a handful, and at least one search
    return reduce(DataFrame.unionByName, (of_one_length(rows.where(F.col("n") == n), k, every) for n in lengths or [0]))
