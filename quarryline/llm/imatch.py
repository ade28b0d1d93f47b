"""I-Match fingerprints of documents, and of versions of them whose second half is the next document's.

Terms (lower-cased runs of letters and digits) whose inverse document frequency ln(N / df) lies within
BAND make the lexicon. Random subsets of the lexicon, at several rates, each give one part of a
fingerprint: the hash of the document's distinct terms in the subset, taken in order. A part is a
number: the subset's code in the high 8 bits and 24 bits of the hash. Subsets of which a document has
no term give no part. The likeness of two fingerprints is the share of equal parts among the subsets of
which either has one.

DataFrame expressions only. The lexicon is written and broadcast if it has at most BROADCAST_ROWS rows,
else joined by a shuffle; as the document frequencies sum to the number of documents times the mean
number m of distinct terms, at most m * exp(BAND[1]) terms are in the band. Terms outside it are dropped
by that join, so what is shuffled per document is its terms within the band. The next document is found
by a window over ranges of doc_id, whose borders are quantiles of the ids, so that outlying ids don't
matter; an id that holds several quantiles is cut by a hash of the text. Only each range's first row
meets the range before. What a document's terms give is written once, for it is read twice.

Defined results: null text counts as empty; rows come in the order of descending doc_id, then a hash
of the text, so repeated rows follow each other; rows with a null doc_id have no next document (an
empty one); texts without a term in any subset get a fingerprint of the whole text; the likeness of
two such is 1 if they are equal, else 0; equal texts have equal fingerprints, whatever rows they stand
in; a very long text is cut into its terms in one task, at a multiple of its length; other columns
aren't looked at; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.sources.scratch import materialize

#: Inverse document frequencies of the lexicon's terms.
BAND = (2.5, 5.0)
#: Of each rate there are SUBSETS subsets of the lexicon, each with one in so many of its terms.
RATES = (16, 64, 256, 1024)
SUBSETS = 16
#: Bits of a term's hash in a mark.
BITS = 25
#: Documents in a range of doc_id, about; ranges grow beyond MOST_RANGES, which a window in one task chains.
RANGE = 1024
MOST_RANGES = 1 << 18
#: Quantiles of doc_id that are asked for; in larger tables the ranges between two of them are of equal width.
QUANTILES = 4096
#: Most rows of the lexicon that are broadcast.
BROADCAST_ROWS = 2_000_000
WHOLE = 192  # codes from here on: parts of a whole text's hash


def terms(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))


def lexicon(docs: DataFrame, n: int, band: tuple[float, float]) -> DataFrame:
    """term (64-bit hash), mark: a row for each subset of each term within the band.

    A mark holds the subset's code above BITS bits of the term's hash.
    """
    df = docs.select(F.explode(terms(F.col("text"))).alias("word")).where("word <> ''").select(F.xxhash64("word").alias("term")).groupBy("term").count()
    idf = F.log(F.lit(float(n)) / F.col("count"))
    own = F.shiftrightunsigned("term", 64 - BITS)
    draw = [F.pmod(F.xxhash64("term", F.lit(k)), F.lit(rate)) for k, rate in enumerate(RATES)]
    marks = [F.when(d < SUBSETS, F.shiftleft(d + k * SUBSETS, BITS).bitwiseOR(own).cast("int")) for k, d in enumerate(draw)]
    return df.where((idf >= band[0]) & (idf < band[1])).select("term", F.explode(F.array_compact(F.array(*marks))).alias("mark"))


def borders(docs: DataFrame, n: int) -> tuple[list[int], int]:
    """Quantiles of doc_id in ascending order, with repetitions, and the parts into which each gap is cut."""
    ranges = min(MOST_RANGES, -(-max(n, 1) // RANGE))
    asked = min(ranges, QUANTILES)
    found = docs.agg(F.percentile_approx("doc_id", [k / asked for k in range(asked + 1)], 8 * QUANTILES)).first()[0] or []
    return sorted(found), -(-ranges // asked)


def in_range(quantiles: list[int], cuts: int, tie: Column) -> Column:
    """The number of a row's range; numbers descend in the order of the rows.

    A quantile's place is found among every 64th one first, then among those between.
    """
    steps: dict[int, int] = {}
    for q in quantiles or [0]:
        steps[q] = steps.get(q, 0) + 1
    ids = list(steps)
    longs = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")  # noqa: E731  folded to a literal
    below = lambda values: F.size(F.filter(values, lambda v: v <= F.col("doc_id")))
    block = F.greatest(below(longs(ids[::64])), F.lit(1))
    place = F.greatest((block - 1) * 64 + below(F.slice(longs(ids), (block - 1) * 64 + 1, 64)), F.lit(1))
    # rows of the quantile itself are cut by the tie, which ascends, if it holds several quantiles; those above it by doc_id
    low, held = F.element_at(longs(ids), place), F.element_at(longs(steps.values()), place)
    by_tie = held - 1 - F.least(F.floor((tie / F.lit(2.0**64) + 0.5) * held), held - 1)
    gap = F.lit(0)
    if cuts > 1:
        width = F.element_at(longs([max(1, -(-(b - a) // cuts)) for a, b in zip(ids, [*ids[1:], 1 << 63])]), place)
        gap = F.least(F.floor((F.col("doc_id").cast("decimal(20,0)") - low) / width), F.lit(1 << 20))
    inner = F.when(F.col("doc_id") <= low, by_tie).otherwise(held + gap)
    # rows without a doc_id have no order; they are dealt out
    return F.when(F.col("doc_id").isNotNull(), place.cast("long") * (1 << 21) + inner.cast("long")).otherwise(-1 - F.pmod(tie, F.lit(QUANTILES)))


def with_next(rows: DataFrame, place: Column, column: str, name: str, tie: Column) -> DataFrame:
    """Adds `column` of the next row, by descending doc_id and tie, as `name`; after the last row comes the first.

    place: the row's range. rows is read twice: in full, and to find each range's first row.
    """
    ranged = rows.withColumn("range", place)
    tops = ranged.where("doc_id is not null").groupBy("range").agg(F.max("doc_id").alias("top"))
    chain = tops.select("range", F.coalesce(F.lead("range").over(Window.orderBy(F.desc("range"))), F.first("range").over(Window.orderBy(F.desc("range")))).alias("follows"))
    highest = F.broadcast(tops.select(F.col("range").alias("of"), "top"))  # a row for each range
    firsts = ranged.join(highest, (F.col("range") == F.col("of")) & (F.col("doc_id") == F.col("top"))).groupBy("range").agg(F.min_by(column, tie).alias("head"))
    links = chain.join(firsts.withColumnRenamed("range", "follows"), "follows").select(F.col("range").alias("of"), "head")
    own = Window.partitionBy("range").orderBy(F.desc("doc_id"), tie)
    placed = ranged.withColumn(name, F.lead(column).over(own)).withColumn("after", F.lead("doc_id").over(own))
    ends = F.col("after").isNull() & F.col("doc_id").isNotNull()
    joined = placed.join(links, (F.col("range") == F.col("of")) & ends, "left")
    return joined.withColumn(name, F.when(ends, F.col("head")).when(F.col("doc_id").isNotNull(), F.col(name))).select(*rows.columns, name)


def parts(found: Column, whole: Column) -> Column:
    """A fingerprint's parts from the marks of a text's terms, or from the whole text's hash if there are none."""
    start = F.struct(F.lit(-1).alias("code"), F.lit(0).cast("long").alias("hash"), F.array().cast("array<int>").alias("out"))
    part = lambda a: F.shiftleft(a["code"], 24).bitwiseOR(a["hash"].bitwiseAND(0xFFFFFF).cast("int"))

    def step(a: Column, x: Column) -> Column:
        code = F.shiftright(x, BITS)
        same = a["code"] == code
        return F.struct(code.alias("code"), F.when(same, F.xxhash64(a["hash"], x)).otherwise(F.xxhash64(x)).alias("hash"), F.when(same | (a["code"] < 0), a["out"]).otherwise(F.concat(a["out"], F.array(part(a)))).alias("out"))

    made = F.aggregate(F.sort_array(found), start, step, lambda a: F.concat(a["out"], F.array(part(a))))
    plain = F.array(*[F.shiftleft(F.lit(WHOLE + k), 24).bitwiseOR(F.shiftright(whole, 20 * k).bitwiseAND(0xFFFFFF).cast("int")) for k in range(3)])
    return F.when(F.size(found) > 0, made).otherwise(plain)


def likeness(a: Column, b: Column) -> Column:
    codes = lambda x: F.transform(x, lambda p: F.shiftrightunsigned(p, 24))
    whole = lambda x: F.shiftrightunsigned(x[0], 24) >= WHOLE
    either = F.size(F.array_union(codes(a), codes(b)))
    same = F.size(F.array_intersect(a, b)).cast("double") / either
    return F.when(a == b, F.lit(1.0)).when(whole(a) | whole(b), F.lit(0.0)).otherwise(same)


def printed(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda p: F.lpad(F.lower(F.hex(p.cast("long").bitwiseAND(0xFFFFFFFF))), 8, "0")), "")


def fingerprints(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    quantiles, cuts = borders(docs, n)
    half = F.floor(F.length("text") / 2).cast("int")
    rows = with_next(docs, in_range(quantiles, cuts, F.xxhash64("text")), "text", "next", F.xxhash64("text"))
    edited = F.concat(F.substring("text", 1, F.length("text") - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    rows = rows.select("doc_id", "text", edited.alias("edited"), F.xxhash64("text").alias("of_text"), F.xxhash64(edited).alias("of_edited"))
    known = materialize(lexicon(docs, n, band), "lexicon")
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known

    # one row for each text of a document, one more for what else is returned
    said = F.concat_ws(":", F.length("text").cast("string"), F.sha2(F.col("edited").cast("binary"), 256))
    sides = rows.select("doc_id", "of_text", "of_edited", F.posexplode(F.array(F.col("text"), F.col("edited"), said)).alias("side", "own"))
    words = sides.select("doc_id", "of_text", "of_edited", "side", F.explode(F.when(F.col("side") == 2, F.array("own")).otherwise(terms(F.col("own")))).alias("word"))
    hashed = words.select("doc_id", "of_text", "of_edited", "side", F.when(F.col("side") < 2, F.xxhash64("word")).alias("term"), F.when(F.col("side") == 2, F.col("word")).alias("said"))
    banded = hashed.join(known, "term", "left").where("side = 2 or mark is not null")
    grouped = banded.groupBy("doc_id", "of_text", "of_edited").agg(F.collect_list(F.when(F.col("side") == 0, F.col("mark"))).alias("a"), F.collect_list(F.when(F.col("side") == 1, F.col("mark"))).alias("b"), F.max("said").alias("said"), F.count("said").alias("times"))
    # marks are made distinct in every row: repeated rows repeat them, and so may terms whose hashes meet in a mark
    once = F.array_distinct
    made = grouped.select("doc_id", "of_text", F.split("said", ":").alias("said"), parts(once("a"), F.col("of_text")).alias("own"), parts(once("b"), F.col("of_edited")).alias("edited"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")).drop("copy")
    beside = with_next(materialize(made, "fingerprints"), in_range(quantiles, cuts, F.col("of_text")), "own", "next", F.col("of_text"))
    return beside.select("doc_id", F.col("said")[0].cast("long").alias("n_chars"), F.col("said")[1].alias("edited_sha256"), printed(F.col("own")).alias("fingerprint"), printed(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("edited")).alias("near_edited"), F.when(F.col("next").isNull(), F.lit(0.0)).otherwise(likeness(F.col("own"), F.col("next"))).alias("near_next"))
