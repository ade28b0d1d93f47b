"""From raw documents to packed sequences: toxicity, language, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents, whatever they are. run() applies them in order and writes each stage's result in the
shared scratch folder before the next reads it. What a stage wrote for itself goes when its result is
written; the results go when the last stage has written the pieces that it packs.

Defined results: rows with null text, without letters or in a language that no labelled document shows
go in the second stage; repeated rows of a doc_id are one document in the third; rows with a null
doc_id are never near duplicates; an empty table passes through; very long texts are judged whole, in
one task each; columns named like a stage's own pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import langid, neardup, packing, toxicity
from quarryline.llm.queries import tokenizer_path
from quarryline.sources.scratch import materialize, passing
from quarryline.sources.tables import table

#: A document goes if its best language's posterior, on the evidence of a few words, is below this,
LEAST_CERTAINTY = 0.4
#: or if it takes so many times the nats a letter that its best language's own words take: another language, or no language.
MOST_STRANGENESS = 2.2


def unused(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """Names like these that no column of docs has, in any case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return tuple(out)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity model says not toxic; the model learns from labels of these documents."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    names = unused(docs, "p_toxic", "severity", "toxic")
    return toxicity.score(docs, model, names).where(~F.col(names[2])).select(*docs.columns)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled documents show; others fit no model, and go."""
    model = langid.train(docs, tokenizer_path("piece_bpe_32k.model"))
    names = unused(docs, "lang_pred", "score", "strangeness")
    kept = (F.col(names[0]) != "und") & (F.col(names[1]) >= LEAST_CERTAINTY) & (F.col(names[2]) <= MOST_STRANGENESS)
    return langid.predict(docs, model, names).where(kept).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id."""
    found = materialize(neardup.near_duplicates(docs).select("doc_id", "kept"), "kept")
    # written, so that the joins may split a doc_id with many rows
    dropped = materialize(found.where("not kept").select("doc_id").distinct(), "dropped")
    small = lambda ids: F.broadcast(ids) if ids.count() <= neardup.BROADCAST_ROWS else ids.hint("merge")
    rest = docs.join(small(dropped), "doc_id", "left_anti")
    repeated = materialize(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return rest.select(*docs.columns)
    # found in a written table, so that rows of one doc_id are combined before the shuffle and no task gathers them
    again = materialize(rest.join(small(repeated), "doc_id", "left_semi").select(*docs.columns), "repeats")
    one = again.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64("text")).alias("row")).select("row.*")
    return rest.join(small(repeated), "doc_id", "left_anti").unionByName(one).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place in it."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("language", keep_known_language), ("near_duplicates", drop_near_duplicates), ("packing", pack)]

#: Trained models, signatures and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with passing(spark):
        for name, stage in STAGES[:-1]:
            with passing(spark):
                docs = materialize(stage(spark, docs, sf_dir), name, lasting=True)
        return STAGES[-1][1](spark, docs, sf_dir)
