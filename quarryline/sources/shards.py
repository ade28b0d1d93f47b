"""A stream of 16-bit tokens in shards, read as a data source that touches only the bytes it needs.

The manifest's numbers of tokens, summed up, say where each shard begins. The sequences from `start` on are dealt
out as ranges; a task reads the byte ranges of its sequences, from as many shards as they reach into, so nothing is
shuffled to put a sequence together, and no shard is read whole for a part of it.

    spark.dataSource.register(TokenShards)
    spark.read.format("token_shards").option("context", 1024).load("s3://bucket/shards")
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Tokens that a task reads, about, and sequences that it hands on at once.
TOKENS, AT_ONCE = 1 << 23, 256
WIDTH = 2


def manifest_of(folder: str, name: str | None) -> list[tuple[str, int]]:
    """File names and numbers of tokens, in order: from a JSON manifest in the folder, or else from the sizes of its .bin files."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    if name is not None:
        with system.open_input_stream(f"{root}/{name}") as stream:
            found = json.loads(stream.read())
        shards = [(s["name"], int(s["tokens"])) for s in found["shards"]]
        if "total_tokens" in found and int(found["total_tokens"]) != sum(n for _, n in shards):
            raise ValueError(f"the manifest says {found['total_tokens']} tokens, its shards have {sum(n for _, n in shards)}")
        return shards
    files = sorted((f.base_name, f.size) for f in system.get_file_info(fs.FileSelector(root)) if f.base_name.endswith(".bin"))
    if odd := [name for name, size in files if size % WIDTH]:
        raise ValueError(f"{odd[0]} doesn't hold whole tokens")
    return [(name, size // WIDTH) for name, size in files]


def pieces(begins: list[int], first: int, last: int) -> Iterator[tuple[int, int, int]]:
    """Shard, place in it and number of tokens of the stream's tokens from first up to last; begins has the end as well."""
    shard = bisect_right(begins, first) - 1
    while first < last:
        stop = min(last, begins[shard + 1])
        if stop > first:  # a shard may be empty
            yield shard, first - begins[shard], stop - first
        first, shard = max(first, stop), shard + 1


@dataclass
class Sequences(InputPartition):
    """Sequences from first up to last, numbered from the stream's beginning, and the pieces (file, place, tokens) that hold them."""

    first: int
    last: int
    pieces: list[tuple[str, int, int]]


class ShardReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if not (folder := options.get("path")):
            raise ValueError("a folder is needed")
        self.folder = folder
        self.context, self.start, self.tokens = int(options.get("context", "0")), int(options.get("start", "0")), int(options.get("tokens_per_task", str(TOKENS)))
        self.manifest = options.get("manifest")
        if self.context <= 0:
            raise ValueError("context must be positive")
        if self.start < 0 or self.start % self.context:
            raise ValueError("start must be a multiple of the context length")

    def partitions(self) -> list[Sequences]:
        shards = manifest_of(self.folder, self.manifest)
        begins = [0, *accumulate(n for _, n in shards)]
        if self.start > begins[-1]:
            raise ValueError("start lies behind the last shard")
        step = max(1, self.tokens // self.context)
        end = begins[-1] // self.context
        out = []
        for first in range(self.start // self.context, end, step):
            last = min(first + step, end)
            out.append(Sequences(first, last, [(shards[k][0], at, n) for k, at, n in pieces(begins, first * self.context, last * self.context)]))
        return out or [Sequences(0, 0, [])]

    def read(self, partition: Sequences) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.folder)
        number, size = partition.first - self.start // self.context, self.context
        held, waiting = [], 0

        def batch(tokens: np.ndarray, first: int) -> pa.RecordBatch:
            many = len(tokens) // size
            lists = pa.ListArray.from_arrays(pa.array(np.arange(many + 1) * size, pa.int32()), pa.array(tokens.astype(np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + many), pa.int64()), lists], ["sequence", "tokens"])

        for name, at, n in partition.pieces:
            with system.open_input_file(f"{root}/{name}") as file:
                file.seek(WIDTH * at)
                while n:
                    take = min(n, AT_ONCE * size)
                    data = file.read(WIDTH * take)
                    if len(data) < WIDTH * take:
                        raise OSError(f"{name} is shorter than the manifest says")
                    held.append(np.frombuffer(data, "<u2"))
                    n, waiting = n - take, waiting + take
                    if waiting >= AT_ONCE * size:
                        tokens = np.concatenate(held)
                        full = waiting - waiting % size
                        yield batch(tokens[:full], number)
                        number, held, waiting = number + full // size, [tokens[full:]], waiting - full
        if waiting:
            yield batch(np.concatenate(held), number)


class TokenShards(DataSource):
    """sequence (from start on), tokens. Options: context; start (0); manifest, the name of a JSON file in the folder; tokens_per_task."""

    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return "sequence long, tokens array<int>"

    def reader(self, schema) -> ShardReader:
        return ShardReader({k: self.options[k] for k in ("path", "context", "start", "tokens_per_task", "manifest") if self.options.get(k) is not None})


def sequences(spark: SparkSession, folder: str, context: int, start: int = 0, manifest: str | None = None, tokens_per_task: int = TOKENS) -> DataFrame:
    """sequence, tokens: the full sequences of the stream from a token on that begins one; what is left at the end isn't returned."""
    if context <= 0 or start < 0 or start % context:
        raise ValueError("start must be a multiple of the context length")
    spark.dataSource.register(TokenShards)
    reader = spark.read.format("token_shards").option("context", context).option("start", start).option("tokens_per_task", tokens_per_task)
    return (reader if manifest is None else reader.option("manifest", manifest)).load(folder)
