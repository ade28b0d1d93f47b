"""Queries: joins, aggregations, windows, selection and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarryline.functions import hashing as H
from quarryline.functions import text as T
from quarryline.operators import filters, profile, select
from quarryline.operators.prefix import by_digest, by_number, running_sum
from quarryline.plans import sql as S
from quarryline.plans.registry import query
from quarryline.sources.tables import documents, table

PILOT = filters.PilotRules()
STREAM = filters.StreamRules()
SEED = "corpus-seed"

HISTORY = """
    SELECT 'sha256:' || sha256(text) AS mark FROM documents WHERE doc_id % 10 = 0
    UNION SELECT 'id:' || substr(sha256(source || doc_id), 1, 24) FROM documents WHERE doc_id % 17 = 0"""
MARKED = "SELECT doc_id, unnest(['sha256:' || sha256(text), 'id:' || substr(sha256(source || doc_id), 1, 24)]) AS mark FROM documents WHERE doc_id % 10 <> 0"


def _marks(docs):
    return docs.select("doc_id", F.explode(F.array(F.concat(F.lit("sha256:"), H.sha(F.col("text"))), F.concat(F.lit("id:"), F.substring(F.sha2(F.concat("source", F.col("doc_id").cast("string")), 256), 1, 24)))).alias("mark"))


def _known(spark, sf_dir):
    docs = documents(spark, sf_dir)
    history = _marks(docs.where("doc_id % 10 = 0")).where("mark like 'sha256:%'").select("mark").union(_marks(docs.where("doc_id % 17 = 0")).where("mark like 'id:%'").select("mark"))
    new = docs.where("doc_id % 10 <> 0")
    return new, _marks(new).join(history, "mark", "left_semi").select("doc_id").distinct()


@query(f"SELECT doc_id FROM documents WHERE doc_id % 10 <> 0 AND doc_id NOT IN (SELECT doc_id FROM ({MARKED}) WHERE mark IN ({HISTORY}))")
def exclude_known(spark, sf_dir):
    """Documents none of whose marks the history has: an anti-join over marks of several fields."""
    new, known = _known(spark, sf_dir)
    return new.select("doc_id").join(known, "doc_id", "left_anti")


@query(f"SELECT DISTINCT doc_id FROM ({MARKED}) WHERE mark IN ({HISTORY})")
def known_overlap(spark, sf_dir):
    return _known(spark, sf_dir)[1]


@query(f"""
    SELECT digest, CAST(count(*) AS BIGINT) AS copies, CAST(count(DISTINCT split) AS BIGINT) AS splits, min(doc_id) AS first_doc
    FROM (SELECT doc_id, sha256(text) AS digest, {S.by_bucket("sha256(CAST(doc_id AS VARCHAR))", 800, 100, 1000)} AS split FROM documents) GROUP BY digest HAVING count(*) > 1""")
def split_overlap(spark, sf_dir):
    split = H.split_by_bucket(F.sha2(F.col("doc_id").cast("string"), 256), 800, 100, 1000)
    rows = documents(spark, sf_dir).select("doc_id", H.sha(F.col("text")).alias("digest"), split.alias("split"))
    return rows.groupBy("digest").agg(F.count("*").alias("copies"), F.count_distinct("split").alias("splits"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query(S.outer_compare_sql())
def outer_compare(spark, sf_dir):
    """Two reports matched by key; a missing text is empty, the last of repeated keys counts."""
    rows = table(spark, sf_dir, "conversations")
    sides = [rows.where(keep).groupBy("conv_id", "role").agg(F.max_by("text", "turn").alias(n)) for keep, n in (("conv_id % 3 <> 0 or turn > 1", "a"), ("conv_id % 4 <> 0", "b"))]
    a, b = (F.coalesce(c, F.lit("")) for c in ("a", "b"))
    return sides[0].join(sides[1], ["conv_id", "role"], "full_outer").select("conv_id", "role", H.sha(a).alias("left_sha256"), H.sha(b).alias("right_sha256"), F.when(T.collapse(a) == T.collapse(b), "identical").otherwise("different").alias("label"))


@query(f"""
    WITH m AS (SELECT coalesce(lang, '') AS domain, CAST(sum(length(text)) AS BIGINT) AS c, CAST(sum(len({S.words('text')})) AS BIGINT) AS a, CAST(sum(len({S.spaced('text')})) AS BIGINT) AS b FROM documents GROUP BY 1)
    SELECT domain, round(c / greatest(b, 1) - c / greatest(a, 1), 9) AS characters_per_token_delta, b - a AS tokens_delta FROM m""")
def metric_delta(spark, sf_dir):
    """Metrics of two ways to cut words, by language, and their differences; domains must be the same."""
    docs = documents(spark, sf_dir).select(F.coalesce("lang", F.lit("")).alias("domain"), T.chars(F.col("text")).alias("c"), F.size(T.words(F.col("text"))).alias("a"), F.size(T.spaced_words(F.col("text"))).alias("b"))
    sums = docs.groupBy("domain").agg(*[F.sum(c).alias(c) for c in "cab"])
    sides = [sums.select("domain", F.col(n).alias(f"tokens_{n}"), (F.col("c") / F.greatest(F.col(n), F.lit(1))).alias(f"rate_{n}")) for n in "ab"]
    return profile.deltas(sides[0], sides[1], "domain", {"characters_per_token_delta": ("rate_a", "rate_b"), "tokens_delta": ("tokens_a", "tokens_b")}).select("domain", F.round("characters_per_token_delta", 9).alias("characters_per_token_delta"), "tokens_delta")


#: Score bands, the upper end left out.
BANDS = (("very_low", 0.00, 0.08), ("low", 0.08, 0.18), ("medium", 0.18, 0.47), ("high", 0.47, 0.94), ("very_high", 0.94, 1.01))
BAND_SQL = "CASE " + " ".join(f"WHEN score >= {low} AND score < {high} THEN '{n}'" for n, low, high in BANDS) + " END"


def _banded(spark, sf_dir):
    score = F.col("value") / 100.0 - F.floor(F.col("value") / 100.0)
    band = F.when(F.lit(False), F.lit(""))
    for n, low, high in BANDS:
        band = band.when((F.col("score") >= low) & (F.col("score") < high), n)
    return table(spark, sf_dir, "events").where("value is not null").select("event_id", score.alias("score")).withColumn("band", band)


SCORES = "(SELECT event_id, value / 100.0 - floor(value / 100.0) AS score FROM events WHERE value IS NOT NULL)"


@query(f"SELECT band, CAST(count(*) AS BIGINT) AS n, round(min(score), 9) AS low, round(max(score), 9) AS high FROM (SELECT score, {BAND_SQL} AS band FROM {SCORES}) WHERE band IS NOT NULL GROUP BY band")
def score_bands(spark, sf_dir):
    return _banded(spark, sf_dir).where("band is not null").groupBy("band").agg(F.count("*").alias("n"), F.round(F.min("score"), 9).alias("low"), F.round(F.max("score"), 9).alias("high"))


@query(f"SELECT band, event_id, round(score, 9) AS score, CAST(r AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY event_id) AS r FROM (SELECT event_id, score, {BAND_SQL} AS band FROM {SCORES}) WHERE band IS NOT NULL) WHERE r <= 3")
def topk_per_band(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("band").orderBy("event_id"))
    return _banded(spark, sf_dir).where("band is not null").withColumn("rank", rank).where("rank <= 3").select("band", "event_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


SHARES = (("src0", "0.3500"), ("src1", "0.2500"), ("src2", "0.2000"), ("src3", "0.1519"), ("src4", "0.0481"), ("src98", "0.0000"))
SHARES_SQL = "(VALUES " + ", ".join(f"('{s}', CAST({v} AS DECIMAL(10, 4)))" for s, v in SHARES) + ") s(source, target_share)"


def _shares(spark):
    return spark.createDataFrame(list(SHARES), "source string, target_share string").withColumn("target_share", F.col("target_share").cast("decimal(10,4)"))


@query(f"""
    SELECT coalesce(a.source, b.source) AS source, CASE WHEN a.source IS NULL THEN 'extra' ELSE 'missing' END AS problem
    FROM (SELECT source FROM {SHARES_SQL}) a FULL JOIN (SELECT DISTINCT source FROM documents) b ON a.source = b.source WHERE a.source IS NULL OR b.source IS NULL""")
def registry_mismatch(spark, sf_dir):
    given = documents(spark, sf_dir).select("source").distinct()
    return profile.mismatch(_shares(spark).select("source"), given, "source").select("source", "problem")


CLEANED = f"(SELECT doc_id, {S.normal('text')} AS t FROM documents)"


def _cleaned(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", T.once(T.normalize_text(F.col("text"))).alias("t"))
    reasons = filters.rejection_reasons(F.col("t"), PILOT)
    marked = docs.select("doc_id", H.sha(F.col("t")).alias("digest"), T.chars(F.col("t")).alias("chars"), T.word_count(F.col("t")).alias("words"), T.approx_tokens(F.col("t")).alias("tokens"), (F.length("t") > PILOT.max_chars).alias("cut"), reasons.alias("found"))
    # only hashes and counts are shuffled; a copy is a duplicate whether or not the first one passed
    copy = F.row_number().over(Window.partitionBy("digest").orderBy("doc_id")) > 1
    return marked.withColumn("reasons", F.when(copy & (F.col("chars") > 0), F.array(F.lit("exact_duplicate"))).otherwise(F.col("found")))


CLEANED_SQL = f"""
    marked AS (SELECT doc_id, sha256(t) AS digest, length(t) AS chars, len(regexp_extract_all(t, {S.quoted(T.WORD)})) AS words, {S.tokens("t")} AS tokens, length(t) > {PILOT.max_chars} AS cut, {S.pilot_reasons("t", PILOT)} AS found FROM {CLEANED}),
    judged AS (SELECT *, CASE WHEN chars > 0 AND row_number() OVER (PARTITION BY digest ORDER BY doc_id) > 1 THEN ['exact_duplicate'] ELSE found END AS reasons FROM marked)"""


@query(f"""WITH {CLEANED_SQL} SELECT CAST(count(*) AS BIGINT) AS input, CAST(count(*) FILTER (len(reasons) = 0) AS BIGINT) AS kept, CAST(count(*) FILTER (len(reasons) > 0) AS BIGINT) AS rejected,
    CAST(count(*) FILTER (cut AND len(reasons) = 0) AS BIGINT) AS truncated, CAST(sum(CASE WHEN len(reasons) = 0 THEN chars ELSE 0 END) AS BIGINT) AS chars,
    CAST(sum(CASE WHEN len(reasons) = 0 THEN words ELSE 0 END) AS BIGINT) AS words, CAST(sum(CASE WHEN len(reasons) = 0 THEN tokens ELSE 0 END) AS BIGINT) AS tokens FROM judged""")
def clean_stats(spark, sf_dir):
    kept = F.size("reasons") == 0
    total = lambda c: F.coalesce(F.sum(F.when(kept, F.col(c)).otherwise(0)), F.lit(0)).alias(c)
    return _cleaned(spark, sf_dir).agg(F.count("*").alias("input"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("rejected"), F.count_if(kept & F.col("cut")).alias("truncated"), total("chars"), total("words"), total("tokens"))


@query(f"WITH {CLEANED_SQL} SELECT reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(reasons) AS reason FROM judged) GROUP BY reason")
def rejection_histogram(spark, sf_dir):
    return _cleaned(spark, sf_dir).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""
    SELECT split, CAST(count(*) AS BIGINT) AS documents, CAST(sum(coalesce(n_chars, length(text))) AS BIGINT) AS chars, CAST(sum(len({S.words('text')})) AS BIGINT) AS words, CAST(sum({S.tokens('text')}) AS BIGINT) AS approx_tokens
    FROM (SELECT *, {S.by_ratio("sha256(text)", 7, 0.8, 0.1)} AS split FROM documents) GROUP BY split""")
def split_stats(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("split", H.split_by_ratio(H.sha(F.col("text")), 7, 0.8, 0.1))
    return docs.groupBy("split").agg(F.count("*").alias("documents"), F.sum(F.coalesce("n_chars", F.length("text"))).alias("chars"), F.sum(T.word_count(F.lower("text"))).alias("words"), F.sum(T.approx_tokens(F.col("text"))).alias("approx_tokens"))


@query(f"""
    SELECT source, CAST(count(*) AS BIGINT) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(min(length(text)) AS BIGINT) AS min_chars,
        CAST(list_sort(list(length(text)))[count(*) // 2 + 1] AS BIGINT) AS median_chars, CAST(max(length(text)) AS BIGINT) AS max_chars, CAST(sum({S.tokens('text')}) AS BIGINT) AS approx_tokens,
        array_to_string(list_slice(list_sort(list(doc_id)), 1, 5), ',') AS sample_ids FROM documents GROUP BY source""")
def corpus_summary(spark, sf_dir):
    """By source; the upper median and first ids come from ranks, so no group is gathered."""
    docs = documents(spark, sf_dir).select("source", "doc_id", T.chars(F.col("text")).alias("chars"), T.approx_tokens(F.col("text")).alias("tokens"))
    return profile.summary(docs, "source", "chars", "doc_id", {"chars": F.sum("chars"), "min_chars": F.min("chars"), "max_chars": F.max("chars"), "approx_tokens": F.sum("tokens")})


@query(f"""
    WITH d AS (SELECT text, {S.clean('text')} AS c, {S.by_bucket("sha256(" + S.canonical('text') + ")", 800, 100, 1000)} AS split FROM documents),
    stages AS (SELECT 'raw' AS stage, text AS t FROM d UNION ALL SELECT 'cleaned', c FROM d WHERE length(c) >= 200 UNION ALL SELECT split, c FROM d WHERE length(c) >= 200)
    SELECT coalesce(stage, 'all') AS stage, CAST(count(*) AS BIGINT) AS documents, CAST(sum(length(t)) AS BIGINT) AS chars, CAST(sum(len({S.spaced('t')})) AS BIGINT) AS words, CAST(sum({S.tokens('t')}) AS BIGINT) AS approx_tokens
    FROM stages GROUP BY ROLLUP (stage)""")
def stage_manifest(spark, sf_dir):
    """Totals of each stage in one pass: a document counts in the stages that it reaches."""
    docs = documents(spark, sf_dir).select("text", T.once(T.clean_text(F.col("text"))).alias("c"), H.split_by_bucket(H.fingerprint(F.col("text")), 800, 100, 1000).alias("split"))
    measured = lambda t: F.struct(T.chars(t).alias("chars"), F.size(T.spaced_words(t)).alias("words"), T.approx_tokens(t).alias("tokens"))
    rows = docs.select("split", (F.length("c") >= 200).alias("long"), measured(F.col("text")).alias("raw"), measured(F.col("c")).alias("cleaned"))
    stages = F.array(F.struct(F.lit("raw").alias("stage"), F.col("raw").alias("m")), F.when(F.col("long"), F.struct(F.lit("cleaned").alias("stage"), F.col("cleaned").alias("m"))), F.when(F.col("long"), F.struct(F.col("split").alias("stage"), F.col("cleaned").alias("m"))))
    reached = rows.select(F.explode(F.array_compact(stages)).alias("s")).select("s.stage", "s.m.*")
    return reached.rollup("stage").agg(F.count("*").alias("documents"), F.sum("chars").alias("chars"), F.sum("words").cast("long").alias("words"), F.sum("tokens").alias("approx_tokens")).withColumn("stage", F.coalesce("stage", F.lit("all")))


@query("""
    SELECT 'lang' AS field, coalesce(lang, '(missing)') AS value, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 2
    UNION ALL SELECT 'quality', coalesce(CAST(quality AS VARCHAR), '(missing)'), CAST(count(*) AS BIGINT) FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 2
    UNION ALL SELECT 'event_type', coalesce(event_type, '(missing)'), CAST(count(*) AS BIGINT) FROM events GROUP BY 2""")
def metadata_profile(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "lang")
    quality = docs.select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").select(F.col("quality").cast("string").alias("quality"))
    fields = (("lang", docs.select("lang")), ("quality", quality), ("event_type", table(spark, sf_dir, "events").select("event_type")))
    parts = [d.groupBy(F.coalesce(c, F.lit("(missing)")).alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("field"), "value", "n") for c, d in fields]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


FRACTIONS = (("p05", 0.05), ("p25", 0.25), ("p75", 0.75), ("p95", 0.95))


@query(f"""
    WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY 1)
    SELECT event_type, v[1] AS minimum, {", ".join(f"v[CAST(round_even((len(v) - 1) * {f}, 0) AS BIGINT) + 1] AS {n}" for n, f in FRACTIONS)}, round((v[(len(v) + 1) // 2] + v[len(v) // 2 + 1]) / 2, 9) AS median, v[len(v)] AS maximum FROM s""")
def profile_quantiles(spark, sf_dir):
    """Quantiles at indices rounded half to even, found by rank and not by gathering values."""
    rows = table(spark, sf_dir, "events").where("value is not null").select("event_type", "value", "event_id")
    return profile.quantiles(rows, "event_type", "value", dict(FRACTIONS))


@query(f"""
    WITH p AS (SELECT source, doc_id, unnest({S.spaced('text')}) AS piece FROM documents),
    d AS (SELECT source, CAST(sum(length(text)) AS BIGINT) AS characters, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY ROLLUP (source)),
    t AS (SELECT source, CAST(count(*) AS BIGINT) AS tokens, CAST(quantile_disc(strlen(piece), 0.5) AS BIGINT) AS p50, CAST(quantile_disc(strlen(piece), 0.95) AS BIGINT) AS p95, CAST(quantile_disc(strlen(piece), 0.99) AS BIGINT) AS p99,
        CAST(max(strlen(piece)) AS BIGINT) AS longest, CAST(count(*) FILTER (strlen(piece) >= 8) AS BIGINT) AS long_pieces FROM p GROUP BY ROLLUP (source))
    SELECT coalesce(d.source, 'overall') AS domain, characters, bytes, tokens, round(bytes / greatest(tokens, 1), 9) AS bytes_per_token, round(characters / greatest(tokens, 1), 9) AS characters_per_token, p50, p95, p99, longest, round(long_pieces / greatest(tokens, 1), 9) AS long_rate
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source""")
def tokenizer_summary(spark, sf_dir):
    """Metrics of words as pieces, by source and overall; quantiles come from the counts of lengths."""
    docs = documents(spark, sf_dir).select(F.coalesce("source", F.lit("")).alias("source"), "text")
    return profile.piece_summary(docs, "source", T.spaced_words(F.col("text")))


@query(f"""
    WITH c AS (SELECT doc_id, fp, rejection, {S.by_bucket("fp", 800, 100, 1000)} AS split FROM (
        SELECT doc_id, sha256({S.canonical("t")}) AS fp, {S.rejection(STREAM)} AS rejection FROM ({S.metric_rows("documents", S.clean("text"))})))
    SELECT coalesce(split, '(all)') AS split, coalesce(reason, '(all)') AS reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT split, coalesce(rejection, 'accepted') AS reason FROM c) GROUP BY CUBE (split, reason)""")
def pipeline_counters(spark, sf_dir):
    docs = documents(spark, sf_dir).select(T.once(T.clean_text(F.col("text"))).alias("t"))
    judged = docs.select(H.split_by_bucket(H.fingerprint(F.col("t")), 800, 100, 1000).alias("split"), F.coalesce(filters.quality_rejection(F.col("t"), STREAM), F.lit("accepted")).alias("reason"))
    counts = judged.groupBy("split", "reason").agg(F.count("*").alias("n"))  # the cube then spreads counts, not documents
    return counts.cube("split", "reason").agg(F.sum("n").alias("n")).select(F.coalesce("split", F.lit("(all)")).alias("split"), F.coalesce("reason", F.lit("(all)")).alias("reason"), "n")


@query("""
    WITH m AS (SELECT l_returnflag, sum(CAST(l_discount * 100 AS BIGINT) * CAST(l_quantity AS BIGINT)) / sum(CAST(l_quantity AS BIGINT)) AS loss FROM lineitem WHERE l_quantity > 0 GROUP BY 1)
    SELECT l_returnflag, round(loss, 9) AS loss, CASE WHEN loss < 50 THEN round(exp(loss), 6) ELSE CAST('Infinity' AS DOUBLE) END AS perplexity FROM m""")
def weighted_mean_exp(spark, sf_dir):
    """Mean weighted by counts and its exponential; batches without weight are left out."""
    weight, value = F.col("l_quantity").cast("long"), F.round(F.col("l_discount") * 100).cast("long")
    m = table(spark, sf_dir, "lineitem").where("l_quantity > 0").groupBy("l_returnflag").agg((F.sum(value * weight) / F.sum(weight)).alias("loss"))
    return m.select("l_returnflag", F.round("loss", 9).alias("loss"), F.when(F.col("loss") < 50, F.round(F.exp("loss"), 6)).otherwise(F.lit(float("inf"))).alias("perplexity"))


@query("SELECT source, CAST(count(*) AS BIGINT) AS n, sha256(string_agg(h || chr(10), '' ORDER BY h)) AS digest FROM (SELECT source, sha256(text) AS h FROM documents) GROUP BY source")
def hash_set_digest(spark, sf_dir):
    return select.digest_of(documents(spark, sf_dir).select("source", H.sha(F.col("text")).alias("h")), F.col("h"), ["source"], "digest")


@query("SELECT source, CAST(count(*) AS BIGINT) AS n, sha256(string_agg(k || chr(10), '' ORDER BY k)) AS digest FROM (SELECT source, source || chr(0) || doc_id || chr(0) || sha256(text) AS k FROM documents) GROUP BY source")
def selection_digest(spark, sf_dir):
    nul = F.char(F.lit(0))
    key = F.concat("source", nul, F.col("doc_id").cast("string"), nul, H.sha(F.col("text")))
    return select.digest_of(documents(spark, sf_dir).select("source", key.alias("k")), F.col("k"), ["source"], "digest")


ALLOWED = ".,;:!?-()\"'"
UNUSUAL = rf"[^\p{{L}}\p{{N}}{T.SPACES}" + "".join("\\" + c if c in "-()" else c for c in ALLOWED) + "]"


@query(f"SELECT c AS character, 'U+' || upper(lpad(to_hex(unicode(c)), 4, '0')) AS codepoint, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(regexp_extract_all(text, {S.quoted(UNUSUAL)})) AS c FROM documents) GROUP BY c")
def unusual_chars(spark, sf_dir):
    found = documents(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(UNUSUAL), F.lit(0))).alias("character"))
    code = F.conv(F.hex(F.encode("character", "UTF-32")), 16, 10).cast("long")
    return found.groupBy("character").agg(F.count("*").alias("n")).select("character", F.concat(F.lit("U+"), F.lpad(F.hex(code), 4, "0")).alias("codepoint"), "n")


RECORDS = f"SELECT source, doc_id, CAST(doc_id AS VARCHAR) AS record_id, CAST(strlen(text) AS BIGINT) AS text_bytes, sha256(text) AS text_sha256, {S.stable_key(SEED, 'select', 'source', 'doc_id')} AS selection_key, {S.stable_key(SEED, 'output', 'source', 'doc_id')} AS output_key FROM documents"
DISTINCT_RECORDS = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY selection_key, source, record_id) AS r FROM ({RECORDS})) WHERE r = 1"


@query(f"SELECT source, doc_id, text_sha256, selection_key FROM ({DISTINCT_RECORDS})")
def dedup_min_key(spark, sf_dir):
    records = select.corpus_records(documents(spark, sf_dir), SEED)
    return select.distinct_records(records).select("source", "doc_id", "text_sha256", "selection_key")


TARGET = 20_000


def quota_sql(target: int, shares: str = SHARES_SQL) -> str:
    return f"""SELECT source, CAST(f + CASE WHEN row_number() OVER (ORDER BY e - f DESC, source) <= {target} - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota
        FROM (SELECT source, e, CAST(floor(e) AS BIGINT) AS f FROM (SELECT source, CAST(target_share AS DECIMAL(20, 10)) * {target} AS e FROM {shares} WHERE target_share > 0))"""


@query(quota_sql(10_007))
def largest_remainder_quota(spark, sf_dir):
    return select.quotas(_shares(spark), 10_007)


@query(f"""SELECT r.source, doc_id, text_bytes, CAST(before AS BIGINT) AS before FROM (SELECT *, coalesce(sum(text_bytes) OVER (PARTITION BY source ORDER BY selection_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({DISTINCT_RECORDS})) r
    JOIN ({quota_sql(TARGET)}) q ON r.source = q.source WHERE before < quota""")
def quota_prefix_select(spark, sf_dir):
    records = select.distinct_records(select.corpus_records(documents(spark, sf_dir), SEED))
    return select.quota_prefix(records, select.quotas(_shares(spark), TARGET)).select("source", "doc_id", "text_bytes", "before")


SIZED = "(SELECT doc_id, strlen(text) AS n FROM documents)"


def _sized(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.octet_length("text").cast("long").alias("n"))


@query(f"SELECT doc_id, CAST(n AS BIGINT) AS n, CAST(before AS BIGINT) AS before FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (ORDER BY doc_id) AS r FROM {SIZED}) WHERE (r = 1 OR (before + n <= 500000 AND before < 500000)) AND r <= 300")
def byte_cap_prefix(spark, sf_dir):
    return select.byte_cap(_sized(spark, sf_dir), "doc_id", "n", 500_000, 300).select("doc_id", "n", "before")


@query(f"SELECT doc_id, CAST(n AS BIGINT) AS n, CAST(before AS BIGINT) AS before FROM (SELECT *, coalesce(sum(n + 2) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {SIZED}) WHERE before + n + 2 <= 700000")
def corpus_cap(spark, sf_dir):
    rows = _sized(spark, sf_dir).withColumn("size", F.col("n") + 2)
    return select.corpus_cap(rows, "doc_id", "size", 700_000).select("doc_id", "n", "before")


@query(f"SELECT doc_id, CAST(len({S.words('text')}) + 1 AS BIGINT) AS n, CAST(coalesce(sum(len({S.words('text')}) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM documents")
def token_offsets(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", (F.size(T.words(F.col("text"))) + 1).cast("long").alias("n"))
    return running_sum(rows, by_number(rows, "doc_id"), ["doc_id"], F.col("n"), "start").select("doc_id", "n", "start")


@query(f"SELECT doc_id, output_key, CAST(row_number() OVER (ORDER BY output_key) - 1 AS BIGINT) AS place FROM ({RECORDS})")
def stable_shuffle(spark, sf_dir):
    """Places in the order of a seeded hash, without sorting all rows in one task."""
    rows = select.corpus_records(documents(spark, sf_dir), SEED).select("doc_id", "output_key")
    return running_sum(rows, by_digest("output_key"), ["output_key"], F.lit(1), "place")


@query("""
    SELECT source_id, item_id, kind FROM (SELECT 'benchmark' AS source_id, item_id, 'text' AS kind FROM benchmark UNION ALL SELECT 'documents', doc_id, 'text' FROM documents UNION ALL SELECT 'pages', page_id, 'html' FROM pages)""")
def union_sources(spark, sf_dir):
    parts = [table(spark, sf_dir, n).select(F.lit(n).alias("source_id"), F.col(key).alias("item_id"), F.lit(kind).alias("kind")) for n, key, kind in (("benchmark", "item_id", "text"), ("documents", "doc_id", "text"), ("pages", "page_id", "html"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""
    (SELECT 'unlabelled' AS side, doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) UNION ALL
    (SELECT 'both', doc_id FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) UNION ALL
    (SELECT 'unknown', doc_id FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents))""")
def set_difference(spark, sf_dir):
    a, b = (table(spark, sf_dir, n).select("doc_id") for n in ("documents", "labels"))
    named = lambda d, n: d.select(F.lit(n).alias("side"), "doc_id")
    return named(a.subtract(b), "unlabelled").unionByName(named(a.intersect(b), "both")).unionByName(named(b.subtract(a), "unknown"))
