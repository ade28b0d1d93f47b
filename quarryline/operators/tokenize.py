"""Adapter of a trained sentencepiece model: round trips and metrics of each text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, characters long, bytes long, words long, tokens long, byte_tokens long, unknown_tokens long, stable boolean, same boolean"


@cache
def processor(model_file: str):
    """One model for each worker process."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_file)


def metrics(docs: DataFrame, model_file: str) -> DataFrame:
    """Sizes, token counts, whether decoding gives the text back, and whether encoding that gives the same ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sp = processor(model_file)
        unknown, byte = sp.unk_id(), {i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                text = text or ""
                ids = sp.encode(text)
                back = sp.decode(ids)
                rows.append((doc_id, len(text), len(text.encode("utf-8")), len(text.split()), len(ids), sum(i in byte for i in ids), ids.count(unknown), sp.encode(back) == ids, back == text))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA)
