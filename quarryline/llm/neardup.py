"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian pruning, exact verification.

A document's set holds its distinct runs of five words (ASCII-lower-cased, cut at ASCII white
space); with fewer words the whole sequence is the one element. Documents are linked if
100 * intersection >= 75 * union. The work goes over classes of equal sets, one representative each:

1. One pass gives each document its set's size, digest and signature.
2. Bands of the signature give buckets. In each bucket the member that shares most buckets with
   others is the centre, and every other member is a candidate of it. Pairs are compared by batches
   of signature values and dropped once the posterior chance of reaching the threshold is below
   the chosen miss probability; survivors are verified on the full sets.
3. Links make components. Buckets whose members all lie in one component are settled. In the others
   the members outside the bucket's largest component are compared with all members of other components,
   in blocks, and survivors verified. So no link that could join components is left out, and large
   groups of near copies cost no pair each. Of two components' pairs whose long sets must be verified
   apart, the most alike come first; the rest follows, more each time, while these leave them apart.
   Where more than a block of members would be compared so, those that can't reach the threshold with
   any other component leave first, by size-ordered prefixes of their sets, rarest elements first.

Chance to miss a link at the threshold itself: 1e-4 by the bands (48 of 6 values), MISS by the
pruning; far less above it.

Defined results: null or blank text has an empty set and no links; a doc_id with several rows links
if any of its rows does; rows with a null doc_id have no component and are kept; a very long text is
hashed in one task, at a multiple of its length; other columns are not looked at; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm import worker
from quarryline.llm.graph import components
from quarryline.sources.scratch import materialize, passing
from quarryline.sources.tables import short_batches

WORDS = 5
BANDS, ROWS = 48, 6
SIZE = BANDS * ROWS
THRESHOLD = (75, 100)
#: A pair is dropped if the posterior chance that it reaches the threshold falls below this.
MISS = 1e-5
BATCH = 32
#: Members of a bucket outside its largest component that are compared at once, and with how many others, about.
BLOCK, CHUNK = 512, 2048
#: Of two components' pairs with long sets in a block, so many are verified at first; then UNSURE_GROWS times as many.
UNSURE, UNSURE_GROWS = 8, 16
#: Members verified against one copy of a centre's text; beyond it the centre is salted.
STAR = 256
#: Counts of elements, by hash, that order the elements for prefixes; from so many survivors on, sets are compared by element numbers.
SLOTS, MANY = 1 << 20, 8
#: Elements of a set that travels with a bucket's member; pairs with a larger set are verified apart.
CARRIED = 512
#: Most rows of a side that is broadcast; a larger side is joined by shuffling.
BROADCAST_ROWS = 400_000
WORDS_KEPT = 120_000

_mask = (1 << 64) - 1


def _odd(n: int, seed: int) -> np.ndarray:
    return np.array([int.from_bytes(blake2b(f"{seed}:{k}".encode(), digest_size=8).digest(), "little") | 1 for k in range(n)], np.uint64)


STEPS = _odd(WORDS, 1)
FACTORS = _odd(SIZE, 2)
BAND_STEPS = _odd(ROWS, 3)
MIX = _odd(2, 4)
_words: dict[bytes, int] = {}


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if len(_words) > WORDS_KEPT:
        _words.clear()
    for w in set(words).difference(_words):
        _words[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's set."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = max(1, len(w) - WORDS + 1)
    h = np.full(n, len(w) if len(w) < WORDS else WORDS, np.uint64) * MIX[0]
    for k in range(min(WORDS, len(w))):
        h += w[k : k + n] * STEPS[k]
    h ^= h >> np.uint64(29)
    h *= MIX[1]
    h ^= h >> np.uint64(32)
    return np.unique(h)


def signature(h: np.ndarray) -> np.ndarray:
    """16 bits of each of the SIZE minima."""
    least = np.full(SIZE, _mask, np.uint64)
    for k in range(0, len(h), 2048):
        least = np.minimum(least, np.multiply.outer(FACTORS, h[k : k + 2048]).min(axis=1))
    return ((least * MIX[0]) >> np.uint64(48)).astype("<u2")


@cache
def least_matches() -> list[tuple[int, int]]:
    """For each number of compared values, the fewest matches at which a pair stays a candidate.

    The prior of the similarity is uniform. Values hold 8 bits, so unequal minima match by chance 1/256.
    """
    s = (np.arange(4000) + 0.5) / 4000
    chance = np.log(s + (1 - s) / 256), np.log((1 - s) * 255 / 256)
    high = s >= THRESHOLD[0] / THRESHOLD[1]
    out = []
    for n in range(BATCH, SIZE + 1, BATCH):
        for m in range(n + 1):
            weight = m * chance[0] + (n - m) * chance[1]
            weight = np.exp(weight - weight.max())
            if weight[high].sum() >= MISS * weight.sum():
                out.append((n, m))
                break
    return out


def surviving(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of the pairs (rows of a and b, 8 bits a value) that sequential pruning leaves."""
    at = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for n, least in least_matches():
        matches = matches + (a[at, n - BATCH : n] == b[at, n - BATCH : n]).sum(axis=1)
        stay = matches >= least
        at, matches = at[stay], matches[stay]
    return at


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    if min(len(a), len(b)) * THRESHOLD[1] < max(len(a), len(b)) * THRESHOLD[0]:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return THRESHOLD[1] * both >= THRESHOLD[0] * (len(a) + len(b) - both)


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set, low and high bytes of the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("neardup", _words.clear)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sizes, digests, low, high = [], [], [], []
                for text in part.column(1):
                    h = shingles(text.as_py())
                    sizes.append(len(h))
                    if not len(h):
                        digests.append(None), low.append(None), high.append(None)
                        continue
                    values = signature(h)
                    digests.append(blake2b(h.tobytes(), digest_size=16).digest())
                    low.append((values & 255).astype(np.uint8).tobytes())
                    high.append((values >> 8).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), *(pa.array(x, pa.binary()) for x in (digests, low, high))], ["doc_id", "n_shingles", "digest", "low", "high"])

    return short_batches(docs).selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, low binary, high binary")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def band_keys(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The key of each band of each row, by all 16 bits of its values. Its last 6 bits are the band's number."""
    values = low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(8)
    number = np.arange(BANDS, dtype=np.uint64)
    keys = (((values.reshape(-1, BANDS, ROWS) + np.uint64(1)) * BAND_STEPS).sum(axis=2, dtype=np.uint64) + number * MIX[1]) * MIX[0]
    keys ^= keys >> np.uint64(31)
    return (keys & ~np.uint64(63) | number).view(np.int64)


def band_rows(classes: DataFrame) -> DataFrame:
    """key, id for each band of each row with id, low, high."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("neardup", _words.clear)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                keys = band_keys(_matrix(part.column("low"), SIZE), _matrix(part.column("high"), SIZE))
                ids = np.repeat(np.asarray(part.column("id")), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["key", "id"])

    return classes.select("id", "low", "high").mapInArrow(run, "key long, id long")


def pruned(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs a, b that sequential Bayesian comparison of their signatures leaves."""
    left = signatures.select(F.col("id").alias("a"), F.col("low").alias("low_a"))
    right = signatures.select(F.col("id").alias("b"), F.col("low").alias("low_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("neardup", _words.clear)
        for batch in batches:
            stay = pa.array(surviving(_matrix(batch.column("low_a"), SIZE), _matrix(batch.column("low_b"), SIZE)))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(stay), batch.column("b").take(stay)], ["a", "b"])

    return pairs.join(right, "b").join(left, "a").select("a", "b", "low_a", "low_b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs a, b whose full sets reach the threshold. pairs is a written table."""
    # only centres with many members are salted; written, so that the join may split them
    load = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts")).where("salts > 1")
    dealt = pairs.join(materialize(load, "centres"), "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))))
    wanted = dealt.select(F.col("b").alias("doc_id"), "a", "salt", F.lit(1).alias("part"), "b").unionByName(dealt.select(F.col("a").alias("doc_id"), "a", "salt", F.lit(0).alias("part"), F.col("a").alias("b")).distinct())
    texts = texts_of(docs, wanted, 2 * pairs.count())
    together = texts.select("a", "salt", "part", "b", "text").repartition("a", "salt").sortWithinPartitions("a", "salt", "part", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("neardup", _words.clear)
        centre, sets = None, []
        for batch in batches:
            rows: tuple[list, list] = ([], [])
            for a, salt, part, b, text in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4)):
                if (a, salt) != centre:
                    centre, sets = (a, salt), []
                own = shingles(text.as_py())
                if part == 0:
                    sets.append(own)
                    continue
                if any(linked(own, other) for other in sets):
                    rows[0].append(a), rows[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64())], ["a", "b"])

    return together.mapInArrow(run, "a long, b long")


def texts_of(docs: DataFrame, wanted: DataFrame, rows: int) -> DataFrame:
    """wanted (doc_id and more, a written table of that many rows) with each document's text."""
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").join(F.broadcast(wanted) if rows <= BROADCAST_ROWS else wanted.hint("merge"), "doc_id")


def short_sets(docs: DataFrame, wanted: DataFrame, rows: int) -> DataFrame:
    """id and the full set of each wanted doc_id whose sets have at most CARRIED elements; ids that occur once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("neardup", _words.clear)
        for batch in batches:
            ids, sets = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                h = shingles(text.as_py())
                ids.append(doc_id)
                sets.append(h.tobytes() if len(h) <= CARRIED else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["id", "set"])

    found = texts_of(docs, wanted, rows).select("doc_id", "text").mapInArrow(run, "id long, set binary")
    return found.groupBy("id").agg(F.count("*").alias("n"), F.max("set").alias("set")).where("n = 1 and set is not null").select("id", "set")


def prefix_lengths(n: int) -> tuple[int, int]:
    """How many first elements, in any order common to all, a set of n shares with a set that it is linked to.

    The first number holds against sets that aren't larger, the second against those that aren't smaller: of
    two linked sets, the smaller one's second prefix and the larger one's first prefix have an element in common.
    """
    part, whole = THRESHOLD
    return n + part * -n // whole + 1, n + 2 * part * -n // (part + whole) + 1


def reachable(docs: DataFrame, wanted: DataFrame, rows: int) -> DataFrame:
    """id of each wanted document that may be linked to one of another component, by prefixes of the whole sets.

    wanted: doc_id, component, a written table of that many rows. Elements are ordered by how often their
    hash's slot occurs among these documents, so that what many share comes last; a slot's count only
    orders them and never decides. An element's rows are counted before the shuffle, not paired.
    """
    texts = texts_of(docs, wanted, rows).select("doc_id", "component", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("neardup", _words.clear)
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for text in batch.column(2):
                np.add.at(counts, shingles(text.as_py()) & np.uint64(SLOTS - 1), 1)
        slots = np.flatnonzero(counts)
        for at in range(0, len(slots), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(slots[at : at + 65536]), pa.array(counts[slots[at : at + 65536]])], ["slot", "n"])

    often = np.zeros(SLOTS, np.int64)
    seen = texts.mapInArrow(counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    often[seen.column("slot").to_numpy()] = seen.column("n").to_numpy()

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("neardup", _words.clear)
        for batch in batches:
            for doc_id, component, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                h = shingles(text.as_py())
                if not len(h):
                    continue
                first, second = prefix_lengths(len(h))
                h = h[np.lexsort((h, often[h & np.uint64(SLOTS - 1)]))][:first].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), doc_id)), pa.array(np.full(len(h), component)), pa.array(np.arange(len(h)) < second)], ["element", "id", "component", "early"])

    found = materialize(texts.mapInArrow(prefixes, "element long, id long, component long, early boolean"), "prefixes")
    early = F.when(F.col("early"), F.col("component"))
    met = found.groupBy("element").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min(early).alias("low_early"), F.max(early).alias("high_early"))
    # written, so that the join may split an element that many share
    met = materialize(met.where("low < high and low_early is not null").select("element", "low_early", "high_early"), "elements")
    return found.join(met, "element").where("early or low_early <> component or high_early <> component").select("id").distinct()


def of_mixed(own: DataFrame) -> DataFrame:
    """The rows (key, id, component) of buckets with more than one component, written."""
    mixed = materialize(own.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key"), "mixed")
    return materialize(own.join(mixed, "key"), "members")


def bucket_sizes(members: DataFrame) -> DataFrame:
    """key, main (the largest component), blocks of the others' members, chunks of all; written, so that a join may split a large bucket."""
    by_component = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    sizes = by_component.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("largest"))
    return materialize(sizes.select("key", F.col("largest.component").alias("main"), F.ceil((F.col("n") - F.col("largest.n")) / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "buckets")


def numbered(sets: list[np.ndarray | None]) -> tuple[np.ndarray, int]:
    """Each set as a row of numbers of its elements, filled up with a number that no element has; that number."""
    width = max((len(x) for x in sets if x is not None), default=0)
    names, numbers = np.unique(np.concatenate([np.empty(0, np.uint64), *(x for x in sets if x is not None)]), return_inverse=True)
    out, at = np.full((len(sets), width), len(names), np.int32), 0
    for k, x in enumerate(sets):
        if x is not None:
            out[k, : len(x)] = numbers[at : at + len(x)]
            at += len(x)
    return out, len(names)


def between_components(shared: DataFrame, labels: DataFrame, signatures: DataFrame, docs: DataFrame, unsure: int) -> DataFrame:
    """Pairs a, b of bucket members from different components, whether their full sets have been verified, and whether more are like them.

    shared: key, id of buckets with several members; labels: id, component where it isn't the id itself.
    Sets of up to CARRIED elements travel with the members and are compared at once; of those pairs
    only links come out, and within a block none between components that another link has joined. Of
    pairs with a larger set, at most `unsure` come out of a block for two components.
    """
    members = of_mixed(shared.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")))
    sizes = bucket_sizes(members)
    crowded = sizes.where("blocks > 1").select("key", F.lit(True).alias("crowded"))
    if not crowded.isEmpty():
        marked = materialize(members.join(crowded, "key", "left"), "members")
        asked = materialize(marked.where("crowded").select(F.col("id").alias("doc_id"), "component").distinct(), "members")
        near = materialize(reachable(docs, asked, asked.count()).withColumn("near", F.lit(True)), "near")
        members = of_mixed(marked.join(near, "id", "left").where("crowded is null or near").select("key", "id", "component"))
        sizes = bucket_sizes(members)
    wanted = materialize(members.select(F.col("id").alias("doc_id")).distinct(), "members")
    sets = short_sets(docs, wanted, wanted.count())
    placed = members.join(sizes, "key").withColumn("minor", F.col("component") != F.col("main"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "id"), F.col(n)).cast("int")
    # a cell holds a block of members outside the largest component (side 0) and a chunk of all members (side 1)
    some = placed.where("minor").select("key", "id", "component", "minor", of(1, "blocks").alias("x"), upto("chunks").alias("y"), F.lit(0).alias("side"))
    every = placed.select("key", "id", "component", "minor", upto("blocks").alias("x"), of(2, "chunks").alias("y"), F.lit(1).alias("side"))
    dealt = some.unionByName(every)
    rows = dealt.join(signatures.select("id", F.concat("low", "high").alias("sig")), "id").join(sets, "id", "left").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "side", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("neardup", _words.clear)

        def compare(key: int, ids: list, comps: list, minor: list, sides: list, sigs: list, sets: list) -> pa.RecordBatch:
            i, c, second = np.array(ids), np.array(comps), np.array(sides) == 1
            alone = second & ~np.array(minor)
            both = np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, 2, SIZE)
            m, bands = both[:, 0], band_keys(both[:, 0], both[:, 1])
            own = [None if x is None else np.frombuffer(x, np.uint64) for x in sets]
            size = np.array([0 if x is None else len(x) for x in own])
            at = c.copy()  # the component that links found here have made of a member's
            table = held = None
            out: tuple[list, list, list, list] = ([], [], [], [])
            apart: dict[tuple[int, int], tuple[int, int, list]] = {}

            def links(k: int, rest: np.ndarray) -> np.ndarray:
                nonlocal table, held
                if len(rest) < MANY:
                    return np.array([n for n in rest.tolist() if linked(own[k], own[n])], np.int64)
                if table is None:
                    table, none = numbered(own)
                    held = np.zeros(none + 1, bool)
                mine = table[k, : size[k]]
                held[mine] = True
                common = held[table[rest]].sum(axis=1)
                held[mine] = False
                return rest[THRESHOLD[1] * common >= THRESHOLD[0] * (size[k] + size[rest] - common)]

            for k in np.flatnonzero(~second).tolist():
                # two members outside the largest component meet twice and are compared once
                rest = np.flatnonzero((alone | second & (i > i[k])) & (at != at[k]))
                if not len(rest):
                    continue
                rest = rest[(bands[rest] == bands[k]).argmax(axis=1) == key & 63]  # a pair is compared in its first common bucket
                rest = rest[surviving(np.broadcast_to(m[k], (len(rest), SIZE)), m[rest])]
                known = size[rest] > 0 if size[k] else np.zeros(len(rest), bool)
                for n in links(k, rest[known]).tolist():
                    if at[n] != at[k]:
                        for col, v in zip(out, (min(ids[k], ids[n]), max(ids[k], ids[n]), True, False)):
                            col.append(v)
                        at[at == max(at[k], at[n])] = min(at[k], at[n])
                for n in rest[~known].tolist():
                    alike = int((both[k] == both[n]).all(axis=0).sum())
                    apart.setdefault((min(comps[k], comps[n]), max(comps[k], comps[n])), (k, n, []))[2].append((-alike, min(ids[k], ids[n]), max(ids[k], ids[n])))
            for k, n, pairs in apart.values():
                if at[k] != at[n]:
                    for _, a, b in sorted(pairs)[:unsure]:
                        for col, v in zip(out, (a, b, False, len(pairs) > unsure)):
                            col.append(v)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.bool_(), pa.bool_()))], ["a", "b", "sure", "more"])

        cell, held = None, ([], [], [], [], [], [])
        for batch in batches:
            key, x, y, *cols = (batch.column(n).to_pylist() for n in batch.schema.names)
            for k in range(len(key)):
                at = (key[k], x[k], y[k])
                if at != cell:
                    if len(held[0]) > 1:
                        yield compare(cell[0], *held)
                    cell, held = at, ([], [], [], [], [], [])
                for col, v in zip(held, cols):
                    col.append(v[k])
        if len(held[0]) > 1:
            yield compare(cell[0], *held)

    return rows.select("key", "x", "y", "id", "component", "minor", "side", "sig", "set").mapInArrow(run, "a long, b long, sure boolean, more boolean").distinct()


def named_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each row's doc_id, n_shingles and digest, and each digest's component_id, as written tables."""
    table = materialize(described(docs), "signatures", lasting=True)
    known = table.where("digest is not null and doc_id is not null")
    first = materialize(known.groupBy("digest").agg(F.min("doc_id").alias("id")), "classes")
    signatures = known.withColumnRenamed("doc_id", "id").select("id", "digest", "low", "high")
    classes = signatures.join(first, ["id", "digest"], "left_semi")
    rows = band_rows(classes)
    # the sides of joins by bucket are written, so that the joins may split large buckets
    many = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    shared = materialize(rows.join(many, "key"), "buckets")
    popular = shared.groupBy("id").agg(F.sum("n").alias("popular"))
    centres = shared.join(popular, "id").groupBy("key").agg(F.max(F.struct("popular", (-F.col("id")).alias("negative"))).alias("best"))
    centres = materialize(centres.select("key", (-F.col("best.negative")).alias("a")), "centres")
    stars = shared.join(centres, "key").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    kept_classes = materialize(signatures.join(shared.select("id").distinct(), "id", "left_semi"), "classes")
    star_pairs = materialize(pruned(stars, kept_classes), "pairs")
    links = materialize(verified(star_pairs, docs), "links")
    labels = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    unsure = UNSURE
    while True:
        found = materialize(between_components(shared.select("key", "id"), labels, kept_classes, docs, unsure), "pairs")
        more = found.where("sure").select("a", "b").unionByName(verified(found.where("not sure").select("a", "b").distinct(), docs))
        joined = labels.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(more.select(F.col("a").alias("u"), F.col("b").alias("v")))
        labels = components(joined)
        if found.where("more").isEmpty():
            break
        unsure *= UNSURE_GROWS
    # written, so that the join may split a text with many copies
    named = first.join(labels, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    return table.select("doc_id", "n_shingles", "digest"), materialize(named, "classes", lasting=True)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    with passing(docs.sparkSession):
        table, named = named_classes(docs)
    whole = table.join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return whole.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
