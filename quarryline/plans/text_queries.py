"""Queries: scans, projections, filters and scalar functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarryline.functions import hashing as H
from quarryline.functions import text as T
from quarryline.operators import filters
from quarryline.operators.dedup import keep_first
from quarryline.plans import sql as S
from quarryline.plans.registry import query
from quarryline.sources.tables import documents, short_batches, table

DATASET, SUBSET = "fixtures", "documents"
PILOT = filters.PilotRules()
STREAM = filters.StreamRules()
METADATA = filters.MetadataRules(language="en", script="Latn", min_language_score=0.5, min_quality_score=0.5, max_cluster=5)


@query(f"""
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS BIGINT) AS unit, sha256(u) AS unit_sha256, CAST(length(u) AS BIGINT) AS n_chars
    FROM (SELECT doc_id, {S.strip("p")} AS u, i FROM (
        SELECT doc_id, unnest(string_split(t, chr(10) || chr(10))) AS p, generate_subscripts(string_split(t, chr(10) || chr(10)), 1) AS i
        FROM (SELECT doc_id, replace(text, '.' || chr(10), '.' || chr(10) || chr(10)) AS t FROM documents)))
    WHERE u <> ''""")
def paragraph_units(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.replace(F.col("text"), F.lit(".\n"), F.lit(".\n\n")).alias("t"))
    units = F.filter(F.transform(F.split("t", "\n\n"), T.strip), lambda u: u != "")
    return docs.select("doc_id", F.posexplode(units).alias("unit", "u")).select("doc_id", F.col("unit").cast("long").alias("unit"), H.sha(F.col("u")).alias("unit_sha256"), T.chars(F.col("u")).alias("n_chars"))


@query("""
    WITH s AS (SELECT DISTINCT r.r_regionkey AS theme, n.n_name || ' ' || v || ' ' || o || '.' AS sentence
        FROM region r CROSS JOIN nation n CROSS JOIN (VALUES ('buys'), ('sells')) a(v) CROSS JOIN (VALUES ('grain'), ('steel'), ('wool')) b(o) WHERE n.n_regionkey = r.r_regionkey)
    SELECT theme, sentence, rank FROM (
        SELECT theme, sentence, CAST(row_number() OVER (PARTITION BY theme ORDER BY sha256(sentence), sentence) AS BIGINT) AS rank FROM s) WHERE rank <= 10""")
def cross_product_topk(spark, sf_dir):
    """Sentences from a product of word lists that are small by nature, deduplicated, some of each theme."""
    names = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_regionkey").alias("theme"), "n_name")
    product = names.withColumn("v", F.explode(F.array(F.lit("buys"), F.lit("sells")))).withColumn("o", F.explode(F.array(F.lit("grain"), F.lit("steel"), F.lit("wool"))))
    made = product.select("theme", F.concat(F.concat_ws(" ", "n_name", "v", "o"), F.lit(".")).alias("sentence")).distinct()
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("theme").orderBy(F.sha2("sentence", 256), "sentence"))
    return made.withColumn("rank", rank.cast("long")).where("rank <= 10")


@query("SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing.path') AS missing FROM events")
def json_path_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.missing.path").alias("missing"))


CONTENT, URL_FIELD = "CASE WHEN page_id % 3 = 0 THEN '  ' ELSE html END", "CASE WHEN page_id % 2 = 0 THEN NULL ELSE url END"


@query(f"""
    SELECT page_id, CASE WHEN {S.strip("content")} <> '' THEN content WHEN {S.strip("html")} <> '' THEN html ELSE '' END AS value,
        CASE WHEN {S.strip("content")} <> '' THEN 'content' WHEN {S.strip("html")} <> '' THEN 'raw_content' END AS field,
        nullif({S.strip("coalesce(url_field, url)")}, '') AS source_url
    FROM (SELECT page_id, url, html, {CONTENT} AS content, {URL_FIELD} AS url_field FROM pages)""")
def first_nonblank_field(spark, sf_dir):
    """The first of two fields that holds text, whole; in every third page the first one is blank."""
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", "url", "html raw_content", f"{CONTENT} content", f"{URL_FIELD} url_field")
    value, field = T.first_nonblank({"content": F.col("content"), "raw_content": F.col("raw_content")})
    stripped = [F.nullif(T.strip(F.col(c)), F.lit("")) for c in ("url_field", "url")]
    return rows.select("page_id", value.alias("value"), field.alias("field"), F.coalesce(*stripped).alias("source_url"))


@query("""
    SELECT page_id, unnest(map_keys(m)) AS key, unnest(map_values(m)) AS value FROM (
        SELECT page_id, MAP {'url': CASE WHEN length(url) > 30 THEN substr(url, 1, 30) || '...[truncated]' ELSE url END,
            'html': CASE WHEN length(html) > 500 THEN substr(html, 1, 500) || '...[truncated]' ELSE html END} AS m FROM pages)""")
def truncate_metadata(spark, sf_dir):
    fields = F.create_map(F.lit("url"), F.struct(F.col("url").alias("v"), F.lit(30).alias("n")), F.lit("html"), F.struct(F.col("html").alias("v"), F.lit(500).alias("n")), F.lit("text"), F.struct(F.lit("dropped").alias("v"), F.lit(500).alias("n")))
    kept = F.map_filter(fields, lambda k, v: k != "text")
    cut = F.transform_values(kept, lambda k, v: F.when(F.length(v["v"]) > v["n"], F.concat(F.substring(v["v"], F.lit(1), v["n"]), F.lit("...[truncated]"))).otherwise(v["v"]))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(cut).alias("key", "value"))


@query(f"""
    SELECT substr(sha256('{DATASET}' || chr(10) || '{SUBSET}' || chr(10) || chr(10) || text), 1, 24) AS id, '{DATASET}' AS source_dataset, '{SUBSET}' AS source_subset,
        source AS source_split, doc_id AS source_index, CAST(NULL AS VARCHAR) AS source_url, 'text' AS text_field, sha256(text) AS raw_text_sha256, CAST(strlen(text) AS BIGINT) AS raw_text_bytes
    FROM documents""")
def raw_record(spark, sf_dir):
    url = F.lit(None).cast("string")
    return documents(spark, sf_dir).select(H.stable_doc_id(DATASET, SUBSET, url, F.col("text")).alias("id"), F.lit(DATASET).alias("source_dataset"), F.lit(SUBSET).alias("source_subset"), F.col("source").alias("source_split"), F.col("doc_id").alias("source_index"), url.alias("source_url"), F.lit("text").alias("text_field"), H.sha(F.col("text")).alias("raw_text_sha256"), F.octet_length("text").cast("long").alias("raw_text_bytes"))


@query(f"SELECT doc_id, substr({S.collapse('text')}, 1, 300) AS preview FROM documents")
def preview(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.preview(F.col("text"), 300).alias("preview"))


@query(f"SELECT doc_id, array_to_string({S.pilot_reasons('t', PILOT)}, ',') AS reasons FROM (SELECT doc_id, {S.normal('text')} AS t FROM documents)")
def pilot_rejection_reasons(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.once(T.normalize_text(F.col("text"))).alias("t")).select("doc_id", F.array_join(filters.rejection_reasons(F.col("t"), PILOT), ",").alias("reasons"))


@query(f"""
    WITH d AS (SELECT d.doc_id, lang, l.quality, CAST(count(*) OVER (PARTITION BY sha256({S.canonical('text')})) AS BIGINT) AS cluster, n_chars FROM documents d LEFT JOIN labels l USING (doc_id))
    SELECT doc_id, CASE WHEN lang IS DISTINCT FROM '{METADATA.language}' THEN 'metadata_language' WHEN n_chars % 50 = 0 THEN 'metadata_script'
        WHEN n_chars IS NULL OR (n_chars % 100) / 100.0 < {METADATA.min_language_score} THEN 'metadata_language_score'
        WHEN quality IS NULL OR quality < {METADATA.min_quality_score} THEN 'metadata_quality_score'
        WHEN cluster > {METADATA.max_cluster} THEN 'metadata_cluster_size' END AS rejection FROM d""")
def metadata_rejection(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "lang", "n_chars", H.fingerprint(F.col("text")).alias("fp"))
    sizes = docs.groupBy("fp").agg(F.count("*").alias("cluster"))
    rows = docs.join(sizes, "fp").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    script = F.when(F.col("n_chars") % 50 == 0, F.lit("Cyrl")).otherwise(F.lit("Latn"))
    return rows.select("doc_id", filters.metadata_rejection(F.col("lang"), script, F.col("n_chars") % 100 / F.lit(100.0), F.col("quality").cast("double"), F.col("cluster"), METADATA).alias("rejection"))


@query(f"SELECT doc_id, {S.rejection(STREAM)} AS rejection FROM ({S.metric_rows('documents', S.clean('text'))})")
def quality_rejection(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.once(T.clean_text(F.col("text"))).alias("t")).select("doc_id", filters.quality_rejection(F.col("t"), STREAM).alias("rejection"))


@query(f"""SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, CAST(n_words AS BIGINT) AS n_words, CAST(boilerplate AS BIGINT) AS boilerplate,
    {", ".join(f"round({c}, 9) AS {c}" for c in ("url_ratio", "digit_ratio", "symbol_ratio", "alpha_ratio", "duplicate_lines", "repeated_5grams"))} FROM ({S.metric_rows('documents', S.clean('text'))})""")
def quality_metrics(spark, sf_dir):
    made = filters.metrics(F.col("t"))
    cols = [(c if n in ("n_chars", "n_words", "boilerplate") else F.round(c.cast("double"), 9)).alias(n) for n, c in made.items()]
    return documents(spark, sf_dir).select("doc_id", T.once(T.clean_text(F.col("text"))).alias("t")).select("doc_id", *cols)


EDGES_SPARK = "CASE WHEN doc_id % 7 = 0 THEN concat(text, char(7)) WHEN doc_id % 11 = 0 THEN concat(char(0), text) WHEN doc_id % 13 = 0 THEN concat(text, char(13), char(10), char(9)) ELSE text END"
EDGES_SQL = "CASE WHEN doc_id % 7 = 0 THEN text || chr(7) WHEN doc_id % 11 = 0 THEN chr(0) || text WHEN doc_id % 13 = 0 THEN text || chr(13) || chr(10) || chr(9) ELSE text END"


@query(f"SELECT doc_id, regexp_matches({EDGES_SQL}, {S.quoted(T.BROKEN)}) AS broken FROM documents")
def broken_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.expr(EDGES_SPARK).rlike(T.BROKEN).alias("broken"))


#: Own choice: what is masked, in this order.
MASKS = ((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<EMAIL>"), (r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", "<IP>"), (r"\+?[0-9][0-9 ()-]{7,}[0-9]", "<PHONE>"))


def _masked(x: str) -> str:
    for pattern, to in MASKS:
        x = S.sub(x, pattern, S.quoted(to))
    return x


@query(f"""
    SELECT doc_id, CAST(len(regexp_extract_all(m, '<EMAIL>')) AS BIGINT) AS emails, CAST(len(regexp_extract_all(m, '<IP>')) AS BIGINT) AS ips,
        CAST(len(regexp_extract_all(m, '<PHONE>')) AS BIGINT) AS phones, sha256(m) AS masked_sha256 FROM (SELECT doc_id, {_masked('text')} AS m FROM documents)""")
def pii_mask(spark, sf_dir):
    masked = F.col("text")
    for pattern, to in MASKS:
        masked = F.regexp_replace(masked, pattern, to)
    rows = documents(spark, sf_dir).select("doc_id", masked.alias("m"))
    return rows.select("doc_id", *[F.regexp_count("m", F.lit(to)).cast("long").alias(n) for n, to in (("emails", "<EMAIL>"), ("ips", "<IP>"), ("phones", "<PHONE>"))], H.sha(F.col("m")).alias("masked_sha256"))


@query(f"SELECT doc_id, sha256({S.normal(EDGES_SQL)}) AS normalized_sha256, CAST(length({S.normal(EDGES_SQL)}) AS BIGINT) AS n_chars FROM documents")
def normalize_text(spark, sf_dir):
    t = T.normalize_text(F.expr(EDGES_SPARK))
    return documents(spark, sf_dir).select("doc_id", t.alias("t")).select("doc_id", H.sha(F.col("t")).alias("normalized_sha256"), T.chars(F.col("t")).alias("n_chars"))


@query(f"SELECT doc_id, sha256({S.clean(EDGES_SQL)}) AS cleaned_sha256, CAST(length({S.clean(EDGES_SQL)}) AS BIGINT) AS n_chars FROM documents")
def clean_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.clean_text(F.expr(EDGES_SPARK)).alias("t")).select("doc_id", H.sha(F.col("t")).alias("cleaned_sha256"), T.chars(F.col("t")).alias("n_chars"))


@query(f"""SELECT doc_id, CAST(len({S.words('text')}) AS BIGINT) AS n_words, CAST(len(list_distinct({S.words('text')})) AS BIGINT) AS n_distinct,
    CAST(len({S.spaced('text')}) AS BIGINT) AS n_spaced, array_to_string(list_slice({S.words('text')}, 1, 5), ' ') AS first_words FROM documents""")
def word_stats(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", T.words(F.col("text")).alias("w"), F.size(T.spaced_words(F.col("text"))).cast("long").alias("n_spaced"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), "n_spaced", F.array_join(F.slice("w", 1, 5), " ").alias("first_words"))


@query(f"SELECT doc_id, {S.tokens('text')} AS approx_tokens FROM documents")
def approx_tokens(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.approx_tokens(F.col("text")).alias("approx_tokens"))


@query(f"SELECT doc_id, {S.truncated('text', 800)} AS truncated, length(text) > 800 AS was_truncated FROM documents")
def truncate_at_sentence(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.truncated(F.col("text"), 800).alias("truncated"), (F.length("text") > 800).alias("was_truncated"))


PIECES = ("▁", "▁Straße", "<0xC3>", "<0x0a>", "<0xZZ>", "ing", "▁▁", "日本", "")


@query("SELECT piece, CAST(CASE WHEN regexp_matches(piece, '\\A<0x[0-9A-Fa-f]{2}>\\z') THEN 1 ELSE strlen(replace(piece, '▁', ' ')) END AS BIGINT) AS n_bytes FROM (VALUES " + ", ".join(f"({S.quoted(p)})" for p in PIECES) + ") v(piece)")
def piece_bytes(spark, sf_dir):
    return spark.createDataFrame([(p,) for p in PIECES], "piece string").select("piece", T.piece_bytes(F.col("piece")).alias("n_bytes"))


LINES = r"(?i)licensed under the ([A-Za-z]+) license"


@query(f"""
    SELECT doc_id, CAST(i - 1 AS BIGINT) AS line, regexp_extract(l, '{LINES}', 1) AS license, contains(l, 'copyright') AS says_copyright
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
    WHERE regexp_matches(l, '{LINES}') OR contains(l, 'copyright')""")
def line_pattern_scan(spark, sf_dir):
    rows = documents(spark, sf_dir).where(F.col("text").rlike(LINES) | F.col("text").contains("copyright")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "l"))
    return rows.where(F.col("l").rlike(LINES) | F.col("l").contains("copyright")).select("doc_id", F.col("line").cast("long").alias("line"), F.regexp_extract("l", LINES, 1).alias("license"), F.col("l").contains("copyright").alias("says_copyright"))


@query(f"SELECT page_id, substr(sha256('{DATASET}' || chr(10) || 'pages' || chr(10) || coalesce(CASE WHEN page_id % 5 = 0 THEN NULL ELSE url END, '') || chr(10) || html), 1, 24) AS id FROM pages")
def stable_doc_id(spark, sf_dir):
    url = F.when(F.col("page_id") % 5 != 0, F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", H.stable_doc_id(DATASET, "pages", url, F.col("html")).alias("id"))


@query(f"SELECT doc_id, sha256({S.canonical('text')}) AS fingerprint FROM documents")
def fingerprint(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", H.fingerprint(F.col("text")).alias("fingerprint"))


@query()
def simhash_blake(spark, sf_dir):
    return short_batches(documents(spark, sf_dir)).select("doc_id", H.simhash_blake(F.col("text")).alias("simhash"))


SIMHASH_SQL = f"""
    counts AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest({S.words('text')}) AS w FROM documents) GROUP BY ALL),
    hashed AS (SELECT doc_id, n, CAST('0x' || substr(sha256(w), 1, 16) AS UBIGINT) AS h FROM counts),
    bits AS (SELECT doc_id, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN n ELSE -n END) AS score FROM hashed, (SELECT CAST(unnest(range(64)) AS UBIGINT) AS b) GROUP BY ALL),
    made AS (SELECT doc_id, CAST(sum(CASE WHEN score >= 0 THEN CAST(1 AS HUGEINT) << CAST(b AS HUGEINT) ELSE 0 END) AS UBIGINT) AS h FROM bits GROUP BY doc_id),
    marks AS (SELECT d.doc_id, coalesce(h, 0) AS h FROM documents d LEFT JOIN made USING (doc_id))"""


@query(f"WITH {SIMHASH_SQL} SELECT doc_id, lpad(lower(to_hex(h)), 16, '0') AS simhash FROM marks")
def simhash_sha(spark, sf_dir):
    return H.simhash_sha(documents(spark, sf_dir)).select("doc_id", H.as_hex(F.col("simhash")).alias("simhash"))


@query()
def text_similarity(spark, sf_dir):
    """Likeness of each turn of a conversation and the next one by matching blocks, with its label."""
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([None if x is None or y is None else 1.0 if x == y else SequenceMatcher(a=x, b=y).ratio() for x, y in zip(a, b)], dtype=float)

    rows = _neighbours(spark, sf_dir).withColumn("similarity", ratio("a", "b"))
    return rows.select("conv_id", "turn", "similarity", F.when(F.col("a") == F.col("b"), "identical").when(F.col("similarity") >= 0.72, "similar").otherwise("different").alias("label"))


def _neighbours(spark, sf_dir):
    """conv_id, turn, a, b: the whole collapsed text of each turn but the last, and the next one's."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.collapse(F.col("text")).alias("a"))
    order = Window.partitionBy("conv_id").orderBy("turn", "a")
    return turns.withColumn("b", F.lead("a").over(order)).withColumn("last", F.lead("turn").over(order).isNull()).where("not last").drop("last")


@query()
def text_levenshtein(spark, sf_dir):
    """Edit distance, in characters, of each turn of a conversation and the next one; other engines count bytes."""
    return _neighbours(spark, sf_dir).select("conv_id", "turn", F.levenshtein("a", "b").cast("long").alias("distance"))


MODELS = ((1, 32000, 768, 2048, 12, 12, 4, True), (2, 32768, 1536, 4096, 18, 16, 8, False), (3, 48000, 2048, 5504, 22, 32, 4, False))


@query(f"""
    SELECT id, CAST(v * h + l * (2 * h * h + 2 * h * (k * (h // a)) + 3 * h * i + 2 * h) + h + CASE WHEN tied THEN 0 ELSE v * h END AS BIGINT) AS parameters
    FROM (VALUES {", ".join(f"({m[0]}, {', '.join(map(str, m[1:7]))}, {str(m[7]).lower()})" for m in MODELS)}) t(id, v, h, i, l, a, k, tied)""")
def param_count(spark, sf_dir):
    rows = spark.createDataFrame(list(MODELS), "id int, v long, h long, i long, l long, a long, k long, tied boolean")
    h, width = F.col("h"), F.col("k") * F.floor(F.col("h") / F.col("a"))
    layer = 2 * h * h + 2 * h * width + 3 * h * F.col("i") + 2 * h
    return rows.select("id", (F.col("v") * h + F.col("l") * layer + h + F.when(F.col("tied"), 0).otherwise(F.col("v") * h)).cast("long").alias("parameters"))


@query("""
    WITH g AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS ids FROM lineitem GROUP BY 1)
    SELECT l_orderkey, list_contains(ids, 3) AS contains_eos, CASE WHEN list_contains(ids, 3) THEN CAST(list_position(ids, 3) - 1 AS BIGINT) END AS first_eos_index,
        ids[-1] = 3 AS ended_with_eos, CAST(len(list_filter(ids, lambda x: x = 3)) AS BIGINT) AS eos_count FROM g""")
def eos_behavior(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("ids"))  # an order has a handful of lines
    place = F.array_position("ids", 3)
    return ids.select("l_orderkey", F.array_contains("ids", 3).alias("contains_eos"), F.when(place > 0, place - 1).cast("long").alias("first_eos_index"), (F.element_at("ids", -1) == 3).alias("ended_with_eos"), F.size(F.filter("ids", lambda x: x == 3)).cast("long").alias("eos_count"))


@query("SELECT doc_id, sha256 AS text_sha256 FROM (SELECT doc_id, sha256(text) AS sha256, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def exact_dedup_first(spark, sf_dir):
    """The first document with each text; only ids and hashes are shuffled."""
    return keep_first(documents(spark, sf_dir).select("doc_id", H.sha(F.col("text")).alias("text_sha256")), ["text_sha256"], ["doc_id"])
