"""Queries: deduplication, splits, tokens, packing, validators and whole pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import hashing as H
from quarryline.functions import text as T
from quarryline.operators import decontaminate, dedup, filters, intervals, packing, select, split, tokenize, validate
from quarryline.operators.prefix import by_number, running_sum
from quarryline.plans import sql as S
from quarryline.plans.registry import query
from quarryline.plans.relational_queries import DISTINCT_RECORDS, RECORDS, SEED, quota_sql
from quarryline.plans.text_queries import SIMHASH_SQL
from quarryline.sources.scratch import materialize
from quarryline.sources.tables import documents, short_batches, table

STREAM = filters.StreamRules()
CONTEXT, SHARD, CAP, BUFFER = 512, 10_000, 30_000, 64
NEAR_SQL = f"""
    prints AS (SELECT doc_id, sha256({S.canonical('text')}) AS fp FROM documents),
    firsts AS (SELECT fp, min(prints.doc_id) AS doc_id, min(h) AS h FROM prints JOIN marks USING (doc_id) GROUP BY fp),
    vals AS (SELECT h, min(doc_id) AS doc_id FROM firsts GROUP BY h),
    bands AS (SELECT doc_id, h, b, (h >> CAST(16 * b AS UBIGINT)) & 65535 AS k FROM vals, (SELECT unnest([0, 1, 2, 3]) AS b)),
    near AS (SELECT DISTINCT x.doc_id AS src, y.doc_id AS dst, bit_count(xor(x.h, y.h)) AS distance FROM bands x JOIN bands y ON x.b = y.b AND x.k = y.k AND x.doc_id < y.doc_id WHERE bit_count(xor(x.h, y.h)) <= 3)"""


def _marks(spark, sf_dir):
    return short_batches(documents(spark, sf_dir)).select("doc_id", *dedup.marks_of(F.col("text")))


@query(f"WITH {SIMHASH_SQL}, {NEAR_SQL} SELECT src, dst, CAST(distance AS BIGINT) AS distance FROM near")
def near_dup_pairs(spark, sf_dir):
    first = _marks(spark, sf_dir).groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.min("simhash").alias("simhash"))
    return dedup.simhash_pairs(first.select("doc_id", "simhash"))


@query()
def near_dup_members(spark, sf_dir):
    """The documents behind each end of near_dup_pairs; those with one representative are at distance 0."""
    return dedup.simhash_members(materialize(_marks(spark, sf_dir), "marks"))  # read three times


@query(f"""
    WITH RECURSIVE {SIMHASH_SQL}, {NEAR_SQL},
    nodes AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS p FROM (SELECT src AS doc_id FROM near UNION SELECT dst FROM near)),
    early AS (SELECT dst, list(src) AS srcs FROM near GROUP BY dst),
    steps AS (SELECT n.p, n.doc_id, coalesce(e.srcs, []) AS srcs FROM nodes n LEFT JOIN early e ON e.dst = n.doc_id),
    walk(p, gone) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
        UNION ALL SELECT s.p, CASE WHEN len(list_filter(s.srcs, lambda x: NOT list_contains(w.gone, x))) > 0 THEN list_append(w.gone, s.doc_id) ELSE w.gone END FROM walk w JOIN steps s ON s.p = w.p + 1),
    gone AS (SELECT unnest(gone) AS doc_id FROM (SELECT gone FROM walk ORDER BY p DESC LIMIT 1)),
    state AS (SELECT f.fp, f.doc_id AS first, v.doc_id = f.doc_id AND v.doc_id NOT IN (SELECT doc_id FROM gone) AS kept FROM firsts f JOIN vals v ON v.h = f.h)
    SELECT p.doc_id, CASE WHEN NOT kept THEN 'near_duplicate' WHEN p.doc_id = first THEN 'kept' ELSE 'exact_duplicate' END AS label FROM prints p JOIN state USING (fp)""")
def near_dup_survivors(spark, sf_dir):
    """Going through documents in order, one goes if an earlier kept one is near; settled in rounds of joins."""
    return dedup.survivors(materialize(_marks(spark, sf_dir), "marks"))  # read three times


@query(f"""
    WITH d AS (SELECT DISTINCT doc_id, unnest({S.ngrams("w", 13)}) AS g FROM (SELECT doc_id, {S.words("text")} AS w FROM documents)),
    b AS (SELECT DISTINCT item_id, unnest({S.ngrams("w", 13)}) AS g FROM (SELECT item_id, {S.words("text")} AS w FROM benchmark))
    SELECT doc_id, CAST(count(DISTINCT g) AS BIGINT) AS shared, CAST(count(DISTINCT item_id) AS BIGINT) AS items FROM d JOIN b USING (g) GROUP BY doc_id""")
def benchmark_decontam(spark, sf_dir):
    return decontaminate.overlaps(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query(f"SELECT doc_id, {S.by_ratio('sha256(text)', 7, 0.8, 0.1)} AS split FROM documents")
def split_ratio(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", H.split_by_ratio(H.sha(F.col("text")), 7, 0.8, 0.1).alias("split"))


PRINT_SQL = f"sha256({S.canonical('text')})"


@query(f"SELECT doc_id, {S.bucket(PRINT_SQL, 1000)} AS bucket, {S.by_bucket(PRINT_SQL, 800, 100, 1000)} AS split FROM documents")
def split_bucket(spark, sf_dir):
    prints = documents(spark, sf_dir).select("doc_id", H.fingerprint(F.col("text")).alias("fp"))
    return prints.select("doc_id", H.bucket(F.col("fp"), 1000).alias("bucket"), H.split_by_bucket(F.col("fp"), 800, 100, 1000).alias("split"))


@query(f"""
    WITH n AS (SELECT count(*) AS n, greatest(1, CAST(round_even(count(*) * 0.1, 0) AS BIGINT)) AS v, greatest(1, CAST(round_even(count(*) * 0.05, 0) AS BIGINT)) AS t FROM documents)
    SELECT doc_id, CAST(place AS BIGINT) AS place, CASE WHEN place < t THEN 'test' WHEN place < t + v THEN 'validation' ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY output_key) - 1 AS place FROM ({RECORDS})), n""")
def split_units(spark, sf_dir):
    rows = select.corpus_records(documents(spark, sf_dir), SEED).select("doc_id", "output_key")
    return split.split_units(rows, "output_key", 0.1, 0.05).select("doc_id", "place", "split")


IDS = f"(SELECT doc_id, list_append({S.word_ids('text')}, CAST(2 AS INTEGER)) AS ids FROM documents)"
STREAM_SQL = f"""
    stream AS (SELECT doc_id, ids, CAST(len(ids) AS BIGINT) AS n, CAST(coalesce(sum(len(ids)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM {IDS}),
    cut AS (SELECT block_id, doc_id, greatest(block_id * {CONTEXT}, start) - block_id * {CONTEXT} AS pos, list_slice(ids, greatest(block_id * {CONTEXT}, start) - start + 1, least((block_id + 1) * {CONTEXT}, start + n) - start) AS part
        FROM (SELECT *, unnest(range(start // {CONTEXT}, (start + n - 1) // {CONTEXT} + 1)) AS block_id FROM stream)),
    blocks AS (SELECT block_id, CAST(sum(len(part)) AS BIGINT) AS real, string_agg(array_to_string(part, ' '), ' ' ORDER BY pos) AS ids, CAST(count(DISTINCT doc_id) AS BIGINT) AS documents FROM cut GROUP BY block_id)"""
PADDED_SQL = f"SELECT block_id, real, sha256(ids || repeat(' 0', CAST({CONTEXT} - real AS BIGINT))) AS ids_sha256, sha256(ids || repeat(' -100', CAST({CONTEXT} - real AS BIGINT))) AS labels_sha256 FROM blocks"


def _blocks(spark, sf_dir):
    return packing.blocks(packing.stream(documents(spark, sf_dir)), CONTEXT)


def _digests(blocks, *keys):
    return blocks.select(*keys, "real", packing.printed("input_ids").alias("ids_sha256"), packing.printed("labels").alias("labels_sha256"))


@query(f"WITH {STREAM_SQL} {PADDED_SQL}")
def pack_blocks(spark, sf_dir):
    return _digests(_blocks(spark, sf_dir), "block_id")


@query(f"WITH {STREAM_SQL} {PADDED_SQL} WHERE real >= 2")
def pack_blocks_min2(spark, sf_dir):
    return _digests(_blocks(spark, sf_dir).where("real >= 2"), "block_id")


@query(f"WITH {STREAM_SQL} SELECT block_id - 2 AS sequence, sha256(ids) AS ids_sha256 FROM blocks WHERE real = {CONTEXT} AND block_id * {CONTEXT} >= 1024")
def token_stream_blocks(spark, sf_dir):
    """Full sequences from an aligned offset on; the rest at the end is left out."""
    offset = 2 * CONTEXT
    full = _blocks(spark, sf_dir).where((F.col("real") == CONTEXT) & (F.col("block_id") * CONTEXT >= offset))
    return full.select((F.col("block_id") - offset // CONTEXT).alias("sequence"), packing.printed("input_ids").alias("ids_sha256"))


@query(f"""
    WITH d AS (SELECT doc_id, list_concat([1], list_append({S.word_ids("text")}, CAST(2 AS INTEGER))) AS ids FROM documents),
    p AS (SELECT doc_id, part, list_slice(ids, part * {CONTEXT} + 1, (part + 1) * {CONTEXT}) AS ids FROM (SELECT *, unnest(range(0, (len(ids) - 1) // {CONTEXT} + 1)) AS part FROM d))
    SELECT doc_id, CAST(part AS BIGINT) AS part, CAST(len(ids) AS BIGINT) AS real, sha256(array_to_string(ids, ' ') || repeat(' 0', CAST({CONTEXT} - len(ids) AS BIGINT))) AS ids_sha256, sha256(array_to_string(ids, ' ') || repeat(' -100', CAST({CONTEXT} - len(ids) AS BIGINT))) AS labels_sha256 FROM p WHERE len(ids) >= 2""")
def doc_blocks(spark, sf_dir):
    return _digests(packing.document_blocks(documents(spark, sf_dir), CONTEXT), "doc_id", F.col("part").cast("long").alias("part"))


@query(f"""
    WITH {STREAM_SQL.split("blocks AS")[0].replace(str(CONTEXT), str(SHARD)).rstrip().rstrip(",")}
    SELECT block_id AS shard, CAST(sum(len(part)) AS BIGINT) AS tokens, CAST(2 * sum(len(part)) AS BIGINT) AS bytes, CAST(count(*) AS BIGINT) AS documents, block_id * {SHARD} AS first_token FROM cut GROUP BY block_id""")
def shard_plan(spark, sf_dir):
    """Rolling shards of a fixed number of tokens; documents may straddle them. Only lengths are moved."""
    rows = documents(spark, sf_dir).select("doc_id", (F.size(T.words(F.col("text"))) + 1).cast("long").alias("n"))
    placed = running_sum(rows, by_number(rows, "doc_id"), ["doc_id"], F.col("n"), "start")
    spread = placed.withColumn("shard", F.explode(F.sequence(F.floor(F.col("start") / SHARD).cast("long"), F.floor((F.col("start") + F.col("n") - 1) / SHARD).cast("long"))))
    own = F.least((F.col("shard") + 1) * SHARD, F.col("start") + F.col("n")) - F.greatest(F.col("shard") * SHARD, F.col("start"))
    return spread.groupBy("shard").agg(F.sum(own).alias("tokens"), (F.sum(own) * 2).alias("bytes"), F.count("*").alias("documents")).withColumn("first_token", F.col("shard") * SHARD)


@query(f"""
    WITH n AS (SELECT count(*) AS n FROM documents), numbered AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents),
    slots AS (SELECT round, slot, row_number() OVER (PARTITION BY round ORDER BY md5('7:' || round || ':' || slot), slot) - 1 AS turn
        FROM (SELECT unnest(range(0, (n + {BUFFER - 1}) // {BUFFER} + 1)) AS round FROM n), (SELECT unnest(range(0, {BUFFER})) AS slot)),
    steps AS (SELECT doc_id, b.round * {BUFFER} + b.turn AS step FROM numbered JOIN slots a ON a.round = i // {BUFFER} AND a.turn = i % {BUFFER} JOIN slots b ON b.round = a.round + 1 AND b.slot = a.slot)
    SELECT doc_id, CAST(CASE WHEN step < n THEN step - {BUFFER} ELSE greatest(0, n - {BUFFER}) + row_number() OVER (PARTITION BY step < n ORDER BY step) - 1 END AS BIGINT) AS place FROM steps, n""")
def buffered_shuffle(spark, sf_dir):
    """The documents' places after a seeded shuffle through a buffer, in the order in which a stream would give them."""
    return select.buffered(documents(spark, sf_dir).select("doc_id"), "doc_id", 7, BUFFER)


@query(f"""
    WITH {STREAM_SQL.split("cut AS")[0].rstrip().rstrip(",")},
    sizes AS (SELECT coalesce(source, '') AS shard, sum(n) AS tokens, min(doc_id) AS number FROM stream JOIN documents USING (doc_id) GROUP BY 1),
    shards AS (SELECT shard, tokens, sum(tokens) OVER (ORDER BY number) - tokens AS first FROM sizes)
    SELECT doc_id, shard, CAST(stream.start - first AS BIGINT) AS place FROM stream JOIN shards ON stream.start >= first AND stream.start < first + tokens""")
def document_shards(spark, sf_dir):
    """The shard in which each document's first token lies, and its place there, if the stream is cut into shards as long as the sources are, in the order of their first documents."""
    docs = documents(spark, sf_dir)
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("shard"), (F.size(T.words(F.col("text"))) + 1).cast("long").alias("n"))
    placed = running_sum(rows.select("doc_id", "n"), by_number(rows, "doc_id"), ["doc_id"], F.col("n"), "first")
    sizes = rows.groupBy("shard").agg(F.sum("n").alias("tokens"), F.min("doc_id").alias("number"))
    shards = intervals.consecutive(sizes, "number", "tokens")
    return intervals.holding(placed, "first", shards).select("doc_id", "shard", (F.col("first") - F.col("start")).alias("place"))


SPLIT_TOKENS = f"""
    tokens AS (SELECT doc_id, ids, CAST(len(ids) AS BIGINT) AS n, {S.by_bucket("sha256(CAST(doc_id AS VARCHAR))", 800, 100, 1000)} AS split FROM {IDS}),
    placed AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY split ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM tokens),
    capped AS (SELECT *, least(n, greatest({CAP} - before, 0)) AS taken FROM placed)"""


def _capped(spark, sf_dir):
    ids = F.concat(packing.word_ids(F.col("text")), F.array(F.lit(packing.EOS)))
    rows = documents(spark, sf_dir).select("doc_id", ids.alias("ids"), H.split_by_bucket(F.sha2(F.col("doc_id").cast("string"), 256), 800, 100, 1000).alias("split")).withColumn("n", F.size("ids").cast("long"))
    places = select.token_caps(rows.select("split", "doc_id", "n"), CAP).where("taken > 0")
    return rows.select("doc_id", "ids").join(places, "doc_id")


@query(f"""WITH {SPLIT_TOKENS} SELECT split, doc_id, before, taken, sha256(CASE WHEN taken = n THEN array_to_string(ids, ' ') WHEN taken = 1 THEN '2' ELSE array_to_string(list_slice(ids, 1, taken - 1), ' ') || ' 2' END) AS ids_sha256 FROM capped WHERE taken > 0""")
def token_cap_eos(spark, sf_dir):
    """Tokens up to a cap for each split; the last document is cut and ends with the end mark."""
    cut = F.when(F.col("taken") == F.col("n"), F.col("ids")).otherwise(F.concat(F.slice("ids", F.lit(1), (F.col("taken") - 1).cast("int")), F.array(F.lit(packing.EOS))))
    return _capped(spark, sf_dir).select("split", "doc_id", "before", "taken", F.sha2(F.array_join(cut, " "), 256).alias("ids_sha256"))


@query(f"""WITH {SPLIT_TOKENS} SELECT split, doc_id, before, taken, sha256(array_to_string(list_slice(ids, 1, taken), ' ')) AS ids_sha256 FROM capped WHERE taken > 0""")
def token_target_truncate(spark, sf_dir):
    """Tokens up to a target for each split; the last document is cut where the target ends."""
    return _capped(spark, sf_dir).select("split", "doc_id", "before", "taken", F.sha2(F.array_join(F.slice("ids", F.lit(1), F.col("taken").cast("int")), " "), 256).alias("ids_sha256"))


DOC_SPLIT = S.by_bucket("sha256(CAST(doc_id AS VARCHAR))", 800, 100, 1000)


@query(f"""
    WITH r AS (SELECT doc_id, text, CASE WHEN doc_id % 41 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS digest, {DOC_SPLIT} AS split, CASE WHEN doc_id % 37 = 0 THEN 'other' ELSE {DOC_SPLIT} END AS said_split FROM documents),
    m AS (SELECT *, count(*) OVER (PARTITION BY digest) AS copies, min(split) OVER (PARTITION BY digest) AS low, max(split) OVER (PARTITION BY digest) AS high FROM r)
    SELECT doc_id, split, array_to_string(list_filter([CASE WHEN {S.strip("text")} = '' THEN 'empty' END, CASE WHEN length(text) < 200 THEN 'too_short' END,
        CASE WHEN len(regexp_extract_all(text, {S.quoted(T.WORD)})) < 40 THEN 'too_few_words' END, CASE WHEN regexp_matches(text, {S.quoted(T.BROKEN)}) THEN 'broken' END,
        CASE WHEN digest <> sha256(text) THEN 'wrong_hash' END, CASE WHEN said_split <> split THEN 'wrong_split' END, CASE WHEN copies > 1 THEN 'duplicate' END, CASE WHEN low <> high THEN 'split_overlap' END], lambda s: s IS NOT NULL), ',') AS problems FROM m""")
def validate_records(spark, sf_dir):
    own = H.split_by_bucket(F.sha2(F.col("doc_id").cast("string"), 256), 800, 100, 1000)
    digest = F.when(F.col("doc_id") % 41 == 0, H.sha(F.concat("text", F.lit("!")))).otherwise(H.sha(F.col("text")))
    rows = documents(spark, sf_dir).select("doc_id", "text", digest.alias("digest"), own.alias("split")).withColumn("said_split", F.when(F.col("doc_id") % 37 == 0, "other").otherwise(F.col("split")))
    return validate.records(rows, 200, 40)


SPOILT_SQL = f"""
    full_ids AS (SELECT block_id, flatten(list(part ORDER BY pos)) AS ids FROM cut GROUP BY block_id),
    made AS (SELECT block_id, len(ids) AS real, list_concat(ids, list_transform(range({CONTEXT} - len(ids)), lambda i: CAST({packing.PAD} AS INTEGER))) AS input_ids, list_transform(range({CONTEXT}), lambda i: CASE WHEN i < len(ids) THEN 1 ELSE 0 END) AS mask,
        list_concat(ids, list_transform(range({CONTEXT} - len(ids)), lambda i: CAST({packing.IGNORED} AS INTEGER))) AS labels FROM full_ids),
    spoilt AS (SELECT block_id, mask, CASE WHEN block_id % 5 = 0 THEN list_slice(input_ids, 1, {CONTEXT - 1}) WHEN block_id % 7 = 0 THEN list_concat([CAST({packing.VOCABULARY} AS INTEGER)], list_slice(input_ids, 2, {CONTEXT})) ELSE input_ids END AS input_ids,
        CASE WHEN block_id % 13 = 0 THEN list_concat(list_slice(labels, 1, {CONTEXT - 1}), [CAST(-5 AS INTEGER)]) ELSE labels END AS labels, CASE WHEN block_id % 11 = 0 THEN real - 1 ELSE real END AS real FROM made)"""


@query(f"""
    WITH {STREAM_SQL.split("blocks AS")[0].rstrip().rstrip(",")}, {SPOILT_SQL}
    SELECT block_id, array_to_string(list_filter([
        CASE WHEN len(input_ids) <> {CONTEXT} THEN 'width' END,
        CASE WHEN len(input_ids) <> len(mask) OR len(input_ids) <> len(labels) THEN 'shape' END,
        CASE WHEN list_min(input_ids) < 0 OR list_max(input_ids) >= {packing.VOCABULARY} THEN 'range' END,
        CASE WHEN list_sum(mask) <> real THEN 'mask' END,
        CASE WHEN len(list_filter(range(1, greatest(len(input_ids), len(mask), len(labels)) + 1), lambda i: (CASE WHEN mask[i] = 0 THEN {packing.IGNORED} ELSE input_ids[i] END) IS DISTINCT FROM labels[i])) > 0 THEN 'labels' END], lambda x: x IS NOT NULL), ',') AS problems FROM spoilt""")
def validate_blocks(spark, sf_dir):
    """What the validator says of packed blocks of which some were spoilt: cut, with an id out of range, a wrong label or a wrong count."""
    k = F.col("block_id")
    ids = F.when(k % 5 == 0, F.slice("input_ids", 1, CONTEXT - 1)).when(k % 7 == 0, F.concat(F.array(F.lit(packing.VOCABULARY)), F.slice("input_ids", 2, CONTEXT))).otherwise(F.col("input_ids"))
    labels = F.when(k % 13 == 0, F.concat(F.slice("labels", 1, CONTEXT - 1), F.array(F.lit(-5)))).otherwise(F.col("labels"))
    spoilt = _blocks(spark, sf_dir).select("block_id", "attention_mask", labels.alias("labels"), ids.alias("input_ids"), F.when(k % 11 == 0, F.col("real") - 1).otherwise(F.col("real")).alias("real"))
    return validate.blocks(spoilt, CONTEXT, packing.VOCABULARY)


HEX = "c0c06e94fd3a44ae9e802b2b0fc533817601eb5e"
ENTRIES = (
    ("a", "set-a", HEX, "approved", "approved_for_project", "ready", True, "card"),
    ("b", "set-b", "main", "pending", "unknown", "planned", False, "card"),
    ("c", None, None, "approved", "approved_for_project", "ready", True, None),
    ("d", "set-d", HEX, None, "unknown", None, None, ""),
    ("e", "set-e", HEX, "pending", "unknown", "planned", True, "card"),
    ("e", None, None, "pending", "unknown", "planned", False, None),
)


def _literal(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'"


@query(f"""
    WITH r AS (SELECT *, count(*) OVER (PARTITION BY id) AS copies, coalesce(approved, false) AS ok FROM (VALUES {", ".join("(" + ", ".join(map(_literal, e)) + ")" for e in ENTRIES)}) t(id, dataset, revision, review, terms, removal, approved, evidence))
    SELECT id, p AS problem FROM (SELECT id, unnest([CASE WHEN review IS NULL OR terms IS NULL THEN 'no review or terms status' END, CASE WHEN removal IS NULL THEN 'no removal status' END, CASE WHEN approved IS NULL THEN 'no approval flag' END,
        CASE WHEN dataset IS NOT NULL AND NOT coalesce(regexp_matches(revision, '\\A[0-9a-f]{{40}}\\z'), false) THEN 'revision not pinned' END, CASE WHEN dataset IS NOT NULL AND coalesce(evidence, '') = '' THEN 'no evidence' END,
        CASE WHEN ok AND dataset IS NULL THEN 'approved without dataset' END, CASE WHEN ok AND review IS DISTINCT FROM 'approved' THEN 'approved without review' END, CASE WHEN ok AND terms IS DISTINCT FROM 'approved_for_project' THEN 'approved without terms' END,
        CASE WHEN ok AND removal IS DISTINCT FROM 'ready' THEN 'approved without removal' END, CASE WHEN copies > 1 THEN 'id not unique' END]) AS p FROM r) WHERE p IS NOT NULL""")
def registry_rules(spark, sf_dir):
    names = "id string, dataset string, revision string, review_status string, terms_status string, removal_status string, production_approved boolean, evidence string"
    return validate.registry(spark.createDataFrame(list(ENTRIES), names))


@query()
def tokenizer_roundtrip(spark, sf_dir):
    """Documents through a public sentencepiece model and back, with token counts."""
    import public_tokenizers

    return tokenize.metrics(short_batches(documents(spark, sf_dir), 500), public_tokenizers.path("piece_bpe_32k.model"))


FLAG_SHARES = tuple((f"src{k}", "0.0500" if k not in (3, 7) else "0.0519" if k == 3 else "0.0481") for k in range(20))
FLAG_SQL = "(VALUES " + ", ".join(f"('{s}', CAST({v} AS DECIMAL(10, 4)))" for s, v in FLAG_SHARES) + ") s(source, target_share)"
FLAG_TARGET = 200_000
GOOD_SQL = f"(SELECT doc_id, source, t AS text FROM ({S.metric_rows('documents', S.clean('text'), 'doc_id, source')}) WHERE {S.rejection(STREAM)} IS NULL)"
DISTINCT_GOOD = DISTINCT_RECORDS.replace("FROM documents", f"FROM {GOOD_SQL}")


@query(f"""
    SELECT source, quota AS target_bytes, CAST(count(*) FILTER (before < quota) AS BIGINT) AS selected, CAST(sum(CASE WHEN before < quota THEN text_bytes ELSE 0 END) AS BIGINT) AS selected_bytes,
        CAST(count(*) AS BIGINT) AS available, sha256(string_agg(CASE WHEN before < quota THEN source || chr(0) || record_id || chr(0) || text_sha256 || chr(10) END, '' ORDER BY record_id)) AS digest
    FROM (SELECT r.*, quota, coalesce(sum(text_bytes) OVER (PARTITION BY r.source ORDER BY selection_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({DISTINCT_GOOD}) r JOIN ({quota_sql(FLAG_TARGET, FLAG_SQL)}) q ON r.source = q.source) GROUP BY source, quota""")
def assemble_corpus(spark, sf_dir):
    """Clean, filter, deduplicate, give sources quotas of bytes, select by stable keys, and sum up by source."""
    docs = documents(spark, sf_dir).select("doc_id", "source", T.once(T.clean_text(F.col("text"))).alias("text"))
    good = docs.where(filters.quality_rejection(F.col("text"), STREAM).isNull())
    records = select.distinct_records(select.corpus_records(good, SEED))
    shares = spark.createDataFrame(list(FLAG_SHARES), "source string, target_share string").withColumn("target_share", F.col("target_share").cast("decimal(10,4)"))
    quota = select.quotas(shares, FLAG_TARGET)
    from quarryline.operators.prefix import by_digest

    placed = running_sum(records, by_digest("selection_key"), ["selection_key"], F.col("text_bytes"), "before", by=("source",)).join(F.broadcast(quota), "source")
    nul = F.char(F.lit(0))
    chosen = F.col("before") < F.col("quota")
    # the quota bounds what is gathered for a source's digest
    line = F.when(chosen, F.struct("record_id", F.concat("source", nul, "record_id", nul, "text_sha256", F.lit("\n")).alias("line")))
    return placed.groupBy("source", F.col("quota").alias("target_bytes")).agg(F.count_if(chosen).alias("selected"), F.sum(F.when(chosen, F.col("text_bytes")).otherwise(0)).alias("selected_bytes"), F.count("*").alias("available"), H.sha(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "")).alias("digest"))


@query(f"""
    WITH g AS (SELECT doc_id, text, sha256({S.canonical("text")}) AS fp FROM {GOOD_SQL}), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY doc_id) AS r FROM g) WHERE r = 1)
    SELECT split, CAST(count(*) AS BIGINT) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(len({S.words("text")})) AS BIGINT) AS words, CAST(sum({S.tokens("text")}) AS BIGINT) AS approx_tokens
    FROM (SELECT *, {S.by_bucket("fp", 800, 100, 1000)} AS split FROM f) GROUP BY split""")
def pipeline_flagship(spark, sf_dir):
    """Clean, filter, fingerprint, keep the first of each fingerprint, split, and sum up by split."""
    docs = documents(spark, sf_dir).select("doc_id", T.once(T.clean_text(F.col("text"))).alias("t"))
    good = docs.where(filters.quality_rejection(F.col("t"), STREAM).isNull())
    slim = good.select("doc_id", H.fingerprint(F.col("t")).alias("fp"), T.chars(F.col("t")).alias("chars"), T.word_count(F.lower("t")).alias("words"), T.approx_tokens(F.col("t")).alias("tokens"))
    first = slim.groupBy("fp").agg(F.min(F.struct("doc_id", "chars", "words", "tokens")).alias("d")).select("fp", "d.*")
    return first.groupBy(H.split_by_bucket(F.col("fp"), 800, 100, 1000).alias("split")).agg(F.count("*").alias("documents"), F.sum("chars").alias("chars"), F.sum("words").alias("words"), F.sum("tokens").alias("approx_tokens"))
