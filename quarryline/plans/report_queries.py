"""Queries: reports on runs, gates, captures, metadata and single units."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import hashing as H
from quarryline.functions import text as T
from quarryline.operators import packing, profile, runs, select, split
from quarryline.operators.prefix import by_number, running_sum
from quarryline.plans import relational_queries as R
from quarryline.plans import sql as S
from quarryline.plans.corpus_queries import CONTEXT, STREAM_SQL
from quarryline.plans.registry import query
from quarryline.sources.tables import documents, spread, table

UNKNOWN = 7


@query(f"""
    SELECT conv_id, turn, role AS mode, sha256(text) AS decoded_sha256, CAST(len(ids) AS BIGINT) AS n_tokens, CAST(len(list_filter(ids, lambda i: i % 100 = {UNKNOWN})) AS BIGINT) AS unknown_tokens,
        CAST(len(regexp_extract_all(text, {S.quoted(R.UNUSUAL)})) AS BIGINT) AS unusual, list_contains(ids, 2) AS contains_eos
    FROM (SELECT *, CASE WHEN turn % 2 = 0 THEN list_append({S.word_ids('text')}, CAST(2 AS INTEGER)) ELSE {S.word_ids('text')} END AS ids FROM conversations)""")
def generation_record(spark, sf_dir):
    """Each turn as a generated record with what its tokens and characters tell."""
    ids = packing.word_ids(F.col("text"))
    rows = table(spark, sf_dir, "conversations").withColumn("ids", F.when(F.col("turn") % 2 == 0, F.concat(ids, F.array(F.lit(packing.EOS)))).otherwise(ids))
    return rows.select("conv_id", "turn", F.col("role").alias("mode"), H.sha(F.col("text")).alias("decoded_sha256"), F.size("ids").cast("long").alias("n_tokens"), F.size(F.filter("ids", lambda i: i % 100 == UNKNOWN)).cast("long").alias("unknown_tokens"), F.size(F.regexp_extract_all("text", F.lit(R.UNUSUAL), F.lit(0))).cast("long").alias("unusual"), F.array_contains("ids", packing.EOS).alias("contains_eos"))


@query(f"SELECT label, CAST(count(*) AS BIGINT) AS n FROM ({S.outer_compare_sql()}) GROUP BY label")
def compare_counts(spark, sf_dir):
    """How many pairs of two reports fall under each label."""
    return R.outer_compare(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


@query(f"""
    WITH heads AS (SELECT conv_id, text AS prompt FROM conversations WHERE turn = 0),
    prompts AS (SELECT prompt, min(conv_id) AS prompt_index FROM heads WHERE conv_id % 5 <> 0 GROUP BY prompt),
    capture AS (SELECT prompt_index, role AS mode, list(text ORDER BY c.conv_id DESC, turn DESC)[1] AS t FROM conversations c JOIN heads h ON c.conv_id = h.conv_id JOIN prompts USING (prompt) WHERE c.conv_id % 3 <> 0 AND turn > 0 GROUP BY ALL),
    report AS (SELECT conv_id AS prompt_index, role AS mode, list(text ORDER BY turn DESC)[1] AS t FROM conversations WHERE turn > 0 GROUP BY ALL)
    SELECT prompt_index, mode, sha256(r.t) AS report_sha256, sha256(c.t) AS capture_sha256, CASE WHEN {S.collapse("r.t")} = {S.collapse("c.t")} THEN 'identical' ELSE 'different' END AS label
    FROM report r JOIN capture c USING (prompt_index, mode)""")
def report_intersection(spark, sf_dir):
    """A report against captured records: prompts become their first index, unknown ones go, only keys of both sides stay."""
    rows = table(spark, sf_dir, "conversations")
    heads = rows.where("turn = 0").select("conv_id", F.col("text").alias("prompt"))
    prompts = heads.where("conv_id % 5 <> 0").groupBy("prompt").agg(F.min("conv_id").alias("prompt_index"))
    captured = rows.where("conv_id % 3 <> 0 and turn > 0").join(heads, "conv_id").join(prompts, "prompt")
    capture = captured.groupBy("prompt_index", F.col("role").alias("mode")).agg(F.max_by("text", F.struct("conv_id", "turn")).alias("c"))
    report = rows.where("turn > 0").groupBy(F.col("conv_id").alias("prompt_index"), F.col("role").alias("mode")).agg(F.max_by("text", "turn").alias("r"))
    label = F.when(T.collapse(F.col("r")) == T.collapse(F.col("c")), "identical").otherwise("different")
    return report.join(capture, ["prompt_index", "mode"]).select("prompt_index", "mode", H.sha(F.col("r")).alias("report_sha256"), H.sha(F.col("c")).alias("capture_sha256"), label.alias("label"))


@query(f"SELECT doc_id, CAST(length(c) AS BIGINT) AS n_chars FROM (SELECT doc_id, {S.clean('text')} AS c FROM documents) WHERE length(c) >= 200")
def corpus_min_length(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", T.once(T.clean_text(F.col("text"))).alias("c"))
    return docs.select("doc_id", T.chars(F.col("c")).alias("n_chars")).where("n_chars >= 200")


REGISTRY = (("src0", "0.4000", True), ("src1", "0.3000", False), ("src2", "0.2000", None), ("src3", "0.1000", True), ("src4", "0.0000", False), ("src99", "0.0500", None))
REGISTRY_SQL = "(VALUES " + ", ".join(f"('{s}', CAST({v} AS DECIMAL(10, 4)), {'NULL' if ok is None else str(ok).lower()})" for s, v, ok in REGISTRY) + ") s(source, target_share, production_approved)"


def _registry(spark):
    return spark.createDataFrame(list(REGISTRY), "source string, target_share string, production_approved boolean").withColumn("target_share", F.col("target_share").cast("decimal(10,4)"))


@query(f"SELECT source, target_share FROM {REGISTRY_SQL} WHERE target_share > 0 AND NOT coalesce(CAST(production_approved AS BOOLEAN), false) AND source IN (SELECT source FROM documents)")
def production_gate(spark, sf_dir):
    """Sources in use that aren't approved; any of them blocks production."""
    return runs.blocking_sources(_registry(spark), documents(spark, sf_dir).select("source"))


SUMS = tuple(("registry", s, v) for s, v, _ in REGISTRY) + tuple(("shares", s, v) for s, v in R.SHARES) + (("near", "a", "0.3333333333"), ("near", "b", "0.6666666666"))


@query("SELECT name, sum(share) AS total, sum(share) = 1 AS exact, abs(CAST(sum(share) AS DOUBLE) - 1) <= 1e-9 AS near FROM (VALUES " + ", ".join(f"('{n}', CAST({v} AS DECIMAL(20, 10)))" for n, _, v in SUMS) + ") t(name, share) GROUP BY name")
def share_sums(spark, sf_dir):
    rows = spark.createDataFrame(list(SUMS), "name string, source string, share string").withColumn("share", F.col("share").cast("decimal(20,10)"))
    return runs.share_sums(rows, "name", "share")


@query(f"""
    WITH m AS ({R.MARKED}), k AS (SELECT DISTINCT doc_id FROM m WHERE mark IN ({R.HISTORY}))
    SELECT CAST(count(*) AS BIGINT) AS scanned, CAST((SELECT count(*) FROM k) AS BIGINT) AS removed, round((SELECT count(*) FROM k) / greatest(1, count(*)), 6) AS ratio FROM documents WHERE doc_id % 10 <> 0""")
def overlap_ratio(spark, sf_dir):
    new, known = R._known(spark, sf_dir)
    marked = new.select("doc_id").join(known.withColumn("known", F.lit(True)), "doc_id", "left")
    counts = marked.agg(F.count("*").alias("scanned"), F.count("known").alias("removed"))
    return counts.withColumn("ratio", F.round(F.col("removed") / F.greatest(F.lit(1), F.col("scanned")), 6))


@query("""
    WITH b AS (SELECT l_returnflag, l_orderkey, count(*) AS sequences, sum(CAST(l_quantity AS BIGINT)) AS active, sum(CAST(round(l_discount * 100) AS BIGINT)) / count(*) AS loss FROM lineitem GROUP BY 1, 2)
    SELECT l_returnflag, CAST(count(*) AS BIGINT) AS batches, round(sum(loss * sequences) / sum(sequences), 6) AS loss FROM b WHERE active > 0 GROUP BY 1""")
def sequence_weighted_loss(spark, sf_dir):
    """Mean loss of batches, weighted by their sequences; batches without active tokens are skipped."""
    cents = F.round(F.col("l_discount") * 100).cast("long")
    batches = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_orderkey").agg(F.count("*").alias("sequences"), F.sum(F.col("l_quantity").cast("long")).alias("active"), (F.sum(cents) / F.count("*")).alias("loss"))
    return batches.where("active > 0").groupBy("l_returnflag").agg(F.count("*").alias("batches"), F.round(F.sum(F.col("loss") * F.col("sequences")) / F.sum("sequences"), 6).alias("loss"))


@query("""
    SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS latency_mean, round(median(value), 6) AS latency_median,
        round(avg(CASE WHEN value > 0 THEN 1000 / value ELSE 0 END), 6) AS rate_mean, round(median(CASE WHEN value > 0 THEN 1000 / value ELSE 0 END), 6) AS rate_median
    FROM events WHERE value IS NOT NULL GROUP BY 1""")
def latency_summary(spark, sf_dir):
    """Mean and median of measured times and of the rates that follow from them."""
    events = spread(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_id")
    rows = events.where("value is not null").select("event_type", "value", F.when(F.col("value") > 0, 1000 / F.col("value")).otherwise(0.0).alias("rate"))
    return profile.means_and_medians(rows, "event_type", {"latency": "value", "rate": "rate"}).select("event_type", "n", *[F.round(f"{a}_{b}", 6).alias(f"{a}_{b}") for a in ("latency", "rate") for b in ("mean", "median")])


@query(f"""
    SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(len(l) - CASE WHEN l[-1] = '' THEN 1 ELSE 0 END) AS BIGINT) AS lines, CAST(sum(len(list_filter(l, lambda x: {S.strip('x')} <> ''))) AS BIGINT) AS nonempty_lines
    FROM (SELECT source, text, string_split(text, chr(10)) AS l FROM documents) GROUP BY source""")
def line_stats(spark, sf_dir):
    docs = documents(spark, sf_dir).select("source", "text", F.split("text", "\n").alias("l"))
    return profile.line_stats(docs, "source")


@query("""
    SELECT doc_id, coalesce(nullif(trim(a), ''), nullif(trim(b), ''), nullif(trim(c), ''), sha256(text)) AS document_hash FROM (
        SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN ' id-' || doc_id WHEN doc_id % 5 = 1 THEN '  ' END AS a, CASE WHEN doc_id % 3 = 0 THEN 'sha-' || doc_id ELSE '' END AS b, CASE WHEN doc_id % 7 = 0 THEN 'raw-' || doc_id || ' ' END AS c FROM documents)""")
def document_hash(spark, sf_dir):
    """The first hash field that isn't blank, else the text's own hash."""
    said = lambda when, *parts: F.when(F.expr(when), F.concat(*parts))
    key = F.col("doc_id").cast("string")
    fields = [said("doc_id % 5 = 0", F.lit(" id-"), key).when(F.expr("doc_id % 5 = 1"), "  "), said("doc_id % 3 = 0", F.lit("sha-"), key).otherwise(""), said("doc_id % 7 = 0", F.lit("raw-"), key, F.lit(" "))]
    return documents(spark, sf_dir).select("doc_id", H.document_hash(fields, F.col("text")).alias("document_hash"))


@query("""
    SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'override' ELSE 'page' END AS kind, url AS address, CASE WHEN page_id % 3 = 0 THEN 'de' END AS lang,
        CASE WHEN page_id % 3 = 0 THEN 'de' WHEN page_id % 2 = 0 THEN 'override' ELSE 'page' END AS first_present, CAST(2 + CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_keys FROM pages""")
def merged_metadata(spark, sf_dir):
    """Two maps merged, the later one first, and the first of some keys that is there."""
    text = lambda c: F.col(c).cast("string")
    base = F.create_map(F.lit("kind"), F.lit("page"), F.lit("address"), text("url"))
    over = F.map_filter(F.create_map(F.lit("kind"), F.when(F.col("page_id") % 2 == 0, "override"), F.lit("lang"), F.when(F.col("page_id") % 3 == 0, "de")), lambda k, v: v.isNotNull())
    rows = table(spark, sf_dir, "pages").select("page_id", runs.merged(base, over).alias("m"))
    return rows.select("page_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("kind", "address", "lang")], runs.first_present(F.col("m"), "missing", "lang", "kind").alias("first_present"), F.size("m").cast("long").alias("n_keys"))


@query("SELECT doc_id, sha256(text) AS text_sha256 FROM documents ORDER BY doc_id LIMIT 500")
def first_rows(spark, sf_dir):
    """A fixed sample: the first rows in the order of their key."""
    return documents(spark, sf_dir).select("doc_id", "text").orderBy("doc_id").limit(500).select("doc_id", H.sha(F.col("text")).alias("text_sha256"))


@query(f"SELECT doc_id, output_key FROM ({R.RECORDS}) ORDER BY output_key, doc_id LIMIT 200")
def seeded_sample(spark, sf_dir):
    """A seeded sample: the first rows in the order of a hash, the same from any partitioning."""
    return select.corpus_records(documents(spark, sf_dir), R.SEED).select("doc_id", "output_key").orderBy("output_key", "doc_id").limit(200)


@query(f"""
    WITH n AS (SELECT doc_id, text, length(text) AS n, CAST(floor(length(text) * 0.05) AS BIGINT) AS t, greatest(1, CAST(floor(length(text) * 0.1) AS BIGINT)) AS v FROM documents),
    p AS (SELECT *, greatest(1, n - v - t) AS r FROM n)
    SELECT doc_id, sha256(substr(text, 1, r)) AS train_sha256, sha256(substr(text, r + 1, v)) AS validation_sha256, CASE WHEN {S.strip("substr(text, r + v + 1)")} <> '' THEN sha256(substr(text, r + v + 1)) END AS test_sha256 FROM p""")
def character_split(spark, sf_dir):
    """A single unit cut by characters into training, validation and test parts."""
    parts = split.character_split(F.col("text"), 0.1, 0.05)
    return documents(spark, sf_dir).select("doc_id", *[H.sha(c).alias(f"{n}_sha256") for n, c in parts.items()])


@query(f"""WITH {STREAM_SQL} SELECT block_id, sha256(ids || repeat(' -100', CAST({CONTEXT} - real AS BIGINT))) AS labels_sha256 FROM blocks""")
def derived_labels(spark, sf_dir):
    """Labels of packed blocks that hold none: the ids, without the padding."""
    blocks = packing.blocks(packing.stream(documents(spark, sf_dir)), CONTEXT).drop("labels", "attention_mask")
    return packing.with_labels(blocks).select("block_id", packing.printed("labels").alias("labels_sha256"))


@query("""
    SELECT page_id, CAST(len(p) AS BIGINT) AS n_parts, contains(u, 'page/1') AS forbidden, len(list_filter(range(1, len(p)), lambda i: p[i] <> '' AND p[i + 1] = CAST(page_id AS VARCHAR))) > 0 AS under,
        array_to_string(['archive', p[3], CAST(page_id AS VARCHAR)], '/') AS key
    FROM (SELECT page_id, u, string_split(u, '/') AS p FROM (SELECT page_id, lower(replace(url, chr(92), '/')) AS u FROM pages))""")
def path_rules(spark, sf_dir):
    """Parts of a path, a part that is forbidden, a run of parts that is asked for, and a key made of parts."""
    u = F.lower(F.replace("url", F.lit("\\"), F.lit("/")))
    rows = table(spark, sf_dir, "pages").select("page_id", u.alias("u"), F.split(u, "/").alias("p"), F.col("page_id").cast("string").alias("id"))
    under = F.exists(F.sequence(F.lit(1), F.greatest(F.size("p") - 1, F.lit(1))), lambda i: (F.try_element_at("p", i) != "") & F.coalesce(F.try_element_at("p", i + 1) == F.col("id"), F.lit(False)))
    return rows.select("page_id", F.size("p").cast("long").alias("n_parts"), F.col("u").contains("page/1").alias("forbidden"), under.alias("under"), F.array_join(F.array(F.lit("archive"), F.try_element_at("p", F.lit(3)), F.col("id")), "/").alias("key"))


@query("SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS source_index FROM documents")
def source_index(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "source")
    return running_sum(rows, by_number(rows, "doc_id"), ["doc_id"], F.lit(1), "source_index", by=("source",))


@query("SELECT conv_id, role, CAST(count(*) AS BIGINT) AS fragments, sha256(string_agg(text, '' ORDER BY turn)) AS text_sha256 FROM conversations GROUP BY conv_id, role")
def joined_fragments(spark, sf_dir):
    """A role's fragments of a conversation as one text; a conversation's fragments are one record."""
    parts = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("f"))
    return parts.select("conv_id", "role", F.size("f").cast("long").alias("fragments"), H.sha(F.array_join(F.transform("f", lambda x: x["text"]), "")).alias("text_sha256"))


CAPTURE = {
    "model_id": "CASE WHEN conv_id % 4 = 0 THEN 'other' ELSE 'm1' END",
    "ui_model_id": "CASE WHEN conv_id % 6 = 0 THEN NULL WHEN conv_id % 9 = 0 THEN 'm2' ELSE 'm1' END",
    "digest": "CASE WHEN turn % 5 = 4 THEN 'bad' ELSE 'good' END",
    "size": "length(text) % 100",
    "seed": "CASE WHEN conv_id % 11 = 0 THEN NULL ELSE 7 END",
}


@query(f"""
    WITH r AS (SELECT conv_id, turn, {", ".join(f"{e} AS {n}" for n, e in CAPTURE.items())} FROM conversations)
    SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN ui_model_id IS NULL THEN 'missing_field:ui_model_id' END, CASE WHEN model_id IS DISTINCT FROM 'm1' THEN 'model_mismatch:' || model_id END,
        CASE WHEN ui_model_id IS DISTINCT FROM 'm1' THEN 'ui_model_mismatch' END, CASE WHEN ui_model_id IS DISTINCT FROM model_id THEN 'ui_model_differs' END, CASE WHEN digest IS DISTINCT FROM 'good' THEN 'digest_mismatch' END,
        CASE WHEN size < 10 THEN 'size_mismatch' END, CASE WHEN seed IS NULL THEN 'missing_sampling:seed' END], lambda x: x IS NOT NULL), ',') AS issues FROM r""")
def capture_issues(spark, sf_dir):
    """What is wrong with captured records, by name."""
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", *[f"{e} AS {n}" for n, e in CAPTURE.items()])
    return rows.select("conv_id", "turn", runs.capture_issues(rows, "m1", "good", F.col("size") < 10, ("seed",)).alias("issues"))
