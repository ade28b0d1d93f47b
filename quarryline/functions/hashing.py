"""Hash expressions: fingerprints, stable keys, splits, SimHash."""

from __future__ import annotations

from array import array
from typing import TYPE_CHECKING

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import canonical, strip, words

if TYPE_CHECKING:
    import numpy as np


def sha(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def fingerprint(text: Column) -> Column:
    return sha(canonical(text))


def stable_doc_id(dataset: str, subset: str, url: Column, text: Column) -> Column:
    payload = F.concat(F.lit(f"{dataset}\n{subset}\n"), F.coalesce(url, F.lit("")), F.lit("\n"), text)
    return F.substring(sha(payload), 1, 24)


def document_hash(fields: list[Column], text: Column) -> Column:
    """The first of the fields that isn't blank, stripped; the text's own hash if all are."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in fields], sha(text))


def stable_key(seed: str, purpose: str, source: Column, record: Column) -> Column:
    nul = F.char(F.lit(0))
    return sha(F.concat(F.lit(seed), nul, F.lit(purpose), nul, source, nul, record))


def bucket(digest: Column, total: int) -> Column:
    """The first 16 hex digits as an unsigned number, modulo total."""
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % total).cast("long")


def fraction(digest: Column) -> Column:
    """The first 12 hex digits as a number from 0 to 1."""
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(16**12))


def split_by_bucket(digest: Column, train: int, validation: int, total: int) -> Column:
    b = bucket(digest, total)
    return F.when(b < train, "train").when(b < train + validation, "validation").otherwise("test")


def split_by_ratio(digest: Column, seed: int, train: float, validation: float) -> Column:
    f = fraction(sha(F.concat(F.lit(f"{seed}:"), digest)))
    return F.when(f < train, "train").when(f < train + validation, "validation").otherwise("test")


def signed(hexadecimal: Column) -> Column:
    """16 hex digits as the signed long with the same 64 bits."""
    high, low = (F.conv(F.substring(hexadecimal, k, 8), 16, 10).cast("long") for k in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)


def as_hex(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def majorities(digests: bytes, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each row, as 64 bits, those set in at least half of the 8-byte digests of its words; 0 without words.

    codes: the places of all rows' words among the digests, row after row; ends: where each row's words end.
    """
    import numpy as np

    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).astype(np.uint16)
    out = np.zeros((len(ends), 8), np.uint8)
    for k, (first, last) in enumerate(zip(np.concatenate(([0], ends[:-1])), ends)):
        if last > first:
            # 16-bit sums, which are the fast ones, hold for so many words
            ones = sum(bits[codes[at : min(at + 65_535, last)]].sum(axis=0, dtype=np.uint16).astype(np.int64) for at in range(first, last, 65_535))
            out[k] = np.packbits(2 * ones >= last - first)
    return out.view(">u8").ravel()


def simhash(words: Column) -> Column:
    """SimHash of a row's array of words as a signed long: each word's sha256 prefix votes as often as the word occurs.

    It depends on one row only, so nothing is shuffled; rows come in Arrow batches, and each word of a batch is hashed once. Without words it is 0.
    """

    @F.arrow_udf("bigint")
    def made(lists: pa.Array) -> pa.Array:
        from hashlib import sha256

        import numpy as np

        coded = lists.flatten().dictionary_encode()
        digests = b"".join(sha256(w.encode("utf-8", "surrogatepass")).digest()[:8] for w in coded.dictionary.to_pylist())
        ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        return pa.array(majorities(digests, coded.indices.to_numpy(zero_copy_only=False), ends).astype(np.int64))

    return made(F.coalesce(words, F.array().cast("array<string>")))


def simhash_sha(docs: DataFrame) -> DataFrame:
    """doc_id, simhash (signed long) of each document's words."""
    return docs.select("doc_id", simhash(words(F.col("text"))).alias("simhash"))


def simhash_blake(text: Column) -> Column:
    """SimHash of 8-byte BLAKE2b word hashes as 16 hex digits; a pandas function, for Spark has no BLAKE2b. Each word of a batch is hashed once, and nothing is kept from batch to batch."""

    @F.pandas_udf("string")
    def made(texts: pd.Series) -> pd.Series:
        import re
        from hashlib import blake2b

        import numpy as np

        class Places(dict):
            """The place of each word of this batch in the order in which they were met."""

            def __missing__(self, word: str) -> int:
                self[word] = place = len(self)
                return place

        places, codes, ends = Places(), array("i"), []
        for text in texts:
            codes.extend(map(places.__getitem__, re.findall(r"\w+", (text or "").lower())))
            ends.append(len(codes))
        digests = b"".join(blake2b(w.encode("utf-8"), digest_size=8).digest() for w in places)
        return pd.Series([f"{v:016x}" for v in majorities(digests, np.frombuffer(codes, np.int32), np.array(ends, np.int64)).tolist()], dtype=object)

    return made(text)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
