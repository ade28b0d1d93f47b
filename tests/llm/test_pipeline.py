import pytest

P = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_columns_and_decide(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "packing"]
    from quarryline.llm import langid, neardup
    from quarryline.sources.scratch import materialize

    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, now, sf_dir), name)
        assert after.columns == docs.columns and 0 < after.count() <= now.count()
        if name == "near_duplicates":
            kept = {r.doc_id for r in neardup.near_duplicates(now).where("kept").collect()}
            assert sorted(r.doc_id for r in after.select("doc_id").collect()) == sorted(kept)
        now = after
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in now.collect()}
    assert langid.SPACE == "▁"
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r.doc_id, r.piece) for r in whole.collect()) == sorted((r.doc_id, r.piece) for r in packed)


def test_stages_on_odd_rows(spark, sf_dir, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, Toxic string, _score int, place int, lang_pred int"
    rows = [(1, "the same words in a row here", "en", "s", 1, None, None, None, None, None, None), (1, "the same words in a row here", "en", "s", 1, None, None, None, None, None, None), (2, "the same words in a row here", "en", "s", 1, None, None, None, None, None, None), (3, None, None, "s", 1, None, None, None, None, None, None), (None, "the same words in a row here", "en", "s", 1, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    after = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert sorted(str(r.doc_id) for r in after.collect()) == ["1", "3", "None"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_odd_rows_among_documents_in_toxicity_and_language(spark, sf_dir):
    """Nulls, repeats, a very long text and columns with a stage's own names: all but the texts without a language stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = docs.where("lang = 'en'").orderBy("doc_id").first()
    odd = [(9_000_001, None, None), (9_000_002, "", "en"), (9_000_003, " \n", None), (9_000_004, "\u00b2 \u2460", None), (9_000_005, first.text, "en"), (9_000_005, first.text, "en"), (9_000_006, (first.text + " ") * 400, None), (None, first.text, None)]
    rows = spark.createDataFrame([(d, t, lang, None, None) for d, t, lang in odd], docs.schema)
    clashing = docs.unionByName(rows).selectExpr("*", "'a' score", "1 lang_pred", "'b' Strangeness", "'c' Toxic", "2 p_toxic", "3.5D severity")
    toxic = corpus_pipeline.drop_toxic(spark, clashing, sf_dir)
    assert toxic.columns == clashing.columns
    judged = {first.doc_id: 0}
    for r in toxic.where("doc_id is null or doc_id >= 9000000").collect():
        judged[r.doc_id] = judged.get(r.doc_id, 0) + 1
        assert (r.score, r.lang_pred, r.Strangeness, r.Toxic, r.p_toxic, r.severity) == ("a", 1, "b", "c", 2, 3.5)
    assert judged == {first.doc_id: 0, **{9_000_000 + k: 1 for k in (1, 2, 3, 4, 6)}, 9_000_005: 2, None: 1}
    known = corpus_pipeline.keep_known_language(spark, clashing, sf_dir)
    assert known.columns == clashing.columns
    left = sorted(str(r.doc_id) for r in known.where("doc_id is null or doc_id >= 9000000").collect())
    assert left == ["9000005", "9000005", "9000006", "None"]


def test_rows_of_one_doc_id_are_combined(spark, sf_dir):
    """A doc_id with a third of the rows, one text among nulls: one row of it stays, whole."""
    rows = [(1, None, "en", f"s{k % 7}", k) for k in range(300)] + [(1, "words of its own that no other row has", "en", "x", -1)]
    rows += [(k, f"text {k} of a document that is not like others {k * k} at all", "en", "s", k) for k in range(2, 600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == list(range(1, 600))
    assert {tuple(r) for r in got} <= set(rows)


FOREIGN = [
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах.",
    "qzx vvkj xqw zzpt kqjx wvvz " * 20,
]


def test_language_stage_drops_foreign_texts_and_keeps_the_others(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    planted = spark.createDataFrame([(10_000_000 + k, t, None, "s", len(t)) for k, t in enumerate(FOREIGN)], docs.schema)
    before = {r.doc_id: r for r in docs.collect()}
    after = {r.doc_id for r in corpus_pipeline.keep_known_language(spark, docs.unionByName(planted), sf_dir).collect()}
    assert not {d for d in after if d >= 10_000_000}
    gone = [r.text for d, r in before.items() if d not in after]
    assert len(gone) <= 0.02 * len(before), gone


def test_packing_on_odd_rows(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, length int, sequence_id string"
    rows = [(1, "some words", "en", "s", 1, 0, None), (1, "some words", "en", "s", 1, 0, None), (2, None, None, "s", 1, None, None), (None, "", "en", "s", 1, 0, None)]
    got = corpus_pipeline.pack(spark, spark.createDataFrame(rows, schema), sf_dir).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got) == [(0, 1), (1, 3), (1, 3), (2, 1)]
    assert corpus_pipeline.pack(spark, spark.createDataFrame([], schema), sf_dir).count() == 0
