"""Writers: JSON lines, splits, ordered corpora, token shards, and small reports."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators.packing import cut


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def write_jsonl(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    rows.write.mode(_mode(overwrite)).json(path)


def write_splits(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """A folder for each split."""
    rows.write.mode(_mode(overwrite)).partitionBy("split").json(path)


def write_ordered(records: DataFrame, path: str, overwrite: bool = False) -> None:
    """Texts in the order of output_key over sorted files; each ends with a line end."""
    text = F.when(F.col("text").endswith("\n"), F.substring(F.col("text"), F.lit(1), F.length("text") - 1)).otherwise(F.col("text"))
    records.repartitionByRange("output_key").sortWithinPartitions("output_key").select(text.alias("value")).write.mode(_mode(overwrite)).text(path)


def write_shards(stream: DataFrame, folder: str, tokens_per_shard: int, target_tokens: int | None = None) -> list[dict]:
    """Writes a token stream (doc_id, ids, n, start) as files of little-endian 16-bit tokens; returns their manifest.

    With a target the stream ends there, in the middle of a document if need be.

    Shards are named by their number and written under temporary names; only those of tasks that
    succeeded are renamed. folder must be one that all executors share.
    """
    if target_tokens is not None:
        left = F.lit(target_tokens) - F.col("start")
        stream = stream.where(left > 0).withColumn("ids", F.slice("ids", F.lit(1), F.least(F.col("n"), left).cast("int"))).withColumn("n", F.size("ids").cast("long"))
    parts = cut(stream, tokens_per_shard, "shard").repartition("shard").sortWithinPartitions("shard", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(f"{root}/temporary", recursive=True)
        now, out, check, size, done = None, None, None, 0, []

        def close() -> None:
            if out is not None:
                out.close()
                done.append((now, at, size // 2, size, check.hexdigest()))

        for batch in batches:
            for shard, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                if shard != now:
                    close()
                    now, at = shard, f"{root}/temporary/{shard}-{uuid.uuid4().hex}"
                    out, check, size = system.open_output_stream(at), hashlib.sha256(), 0
                ids = np.asarray(part.values)
                if len(ids) and (ids.min() < 0 or ids.max() > 65535):
                    raise ValueError("a token doesn't fit into 16 bits")
                data = ids.astype("<u2").tobytes()
                out.write(data)
                check.update(data)
                size += len(data)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], ["shard", "at", "tokens", "bytes", "sha256"])

    from pyarrow import fs

    from quarryline.sources.scratch import materialize

    files = materialize(parts.select("shard", "part").mapInArrow(run, "shard long, at string, tokens long, bytes long, sha256 string"), "shards")
    system, root = fs.FileSystem.from_uri(folder)
    manifest = []
    for f in files.orderBy("shard").toLocalIterator():
        name = f"shard-{f['shard']:06d}.bin"
        system.move(f["at"], f"{root}/{name}")
        manifest.append({"name": name, "tokens": f["tokens"], "bytes": f["bytes"], "sha256": f["sha256"]})
    system.delete_dir(f"{root}/temporary")
    return manifest


def write_json(spark: SparkSession, path: str, payload: dict) -> None:
    """A small report in any store that Spark knows. It takes the place of an old one in one step: a reader sees either."""
    files = spark._jvm.org.apache.hadoop.fs
    to, fresh = files.Path(path), files.Path(f"{path}.{uuid.uuid4().hex}")
    settings = spark._jsc.hadoopConfiguration()
    store = to.getFileSystem(settings)
    stream = store.create(fresh)
    stream.write(bytearray(json.dumps(payload, ensure_ascii=False, sort_keys=True, indent=1), "utf-8"))
    stream.close()
    kind = getattr(files, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    files.FileContext.getFileContext(store.getUri(), settings).rename(store.makeQualified(fresh), store.makeQualified(to), how)


def write_training_text(docs: DataFrame, path: str, overwrite: bool = False) -> None:
    """Texts for a trainer: line ends are plain ones, blank texts are left out, one text a group of lines."""
    text = F.trim(F.regexp_replace("text", r"\r\n?", "\n"))
    docs.select(text.alias("value")).where("value <> ''").write.mode(_mode(overwrite)).text(path)


def write_blocks(blocks: DataFrame, path: str, overwrite: bool = False) -> None:
    """Packed blocks as Parquet with array columns."""
    blocks.write.mode(_mode(overwrite)).parquet(path)


def recover_shards(folder: str, tokens: int, tokens_per_shard: int) -> list[str]:
    """Brings a folder of shards back to its first `tokens` tokens, all that a checkpoint vouches for.

    Later shards and unfinished files go, the shard in which the tokens end is cut. Returns the names left.
    """
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    if system.get_file_info(f"{root}/temporary").type.name == "Directory":
        system.delete_dir(f"{root}/temporary")
    found = {int(f.base_name[6:-4]): f for f in system.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("shard-") and f.base_name.endswith(".bin")}
    left = []
    for shard in range(-(-tokens // tokens_per_shard)):
        size = 2 * min(tokens_per_shard, tokens - shard * tokens_per_shard)
        if shard not in found or found[shard].size < size:
            raise ValueError(f"shard {shard} is shorter than the checkpoint says")
        if found[shard].size > size:
            with system.open_input_stream(found[shard].path) as stream:
                data = stream.read(size)
            fresh = f"{root}/{uuid.uuid4().hex}"
            with system.open_output_stream(fresh) as out:
                out.write(data)
            system.move(fresh, found[shard].path)
        left.append(found.pop(shard).base_name)
    for f in found.values():
        system.delete_file(f.path)
    return left


def publish(spark: SparkSession, source: str, to: str) -> DataFrame:
    """Copies the files below a folder, checks their digests, and writes a marker last; returns name (below the folder), bytes, sha256."""
    from quarryline.sources.readers import check_files, files_with_digests

    named = files_with_digests(spark, source)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        (a, root), (b, target) = fs.FileSystem.from_uri(source), fs.FileSystem.from_uri(to)
        b.create_dir(target, recursive=True)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                b.create_dir(f"{target}/{name}".rpartition("/")[0], recursive=True)
                fs.copy_files(f"{root}/{name}", f"{target}/{name}", source_filesystem=a, destination_filesystem=b)
            yield batch

    from quarryline.sources.scratch import materialize

    copied = materialize(named.select("name", "bytes", "sha256").mapInArrow(copy, "name string, bytes long, sha256 string"), "published")
    wrong = check_files(files_with_digests(spark, to), copied)
    if not wrong.isEmpty():
        raise OSError(f"not copied: {wrong.first()}")
    write_json(spark, f"{to}/COMPLETE", {"files": copied.count()})
    return copied


def markdown(rows: DataFrame, title: str) -> str:
    """A small aggregate as a Markdown table."""
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.collect()]) + "\n"
