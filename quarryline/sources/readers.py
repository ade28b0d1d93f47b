"""Readers of line-delimited JSON, text files, prompts, registries and token shards."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quarryline.functions import text as T
from quarryline.functions.hashing import sha, stable_key
from quarryline.operators.prefix import by_number, running_sum
from quarryline.operators.selection import sendable
from quarryline.sources.scratch import materialize


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str | StructType, lenient: bool = False) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, and broken ones are an error unless lenient."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE" if lenient else "FAILFAST").json(paths)


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, line (from 1, blank lines count), value of text files, however many tasks a file is split over.

    A split's lines are consecutive in its task, so a line's number in its split is a difference of row ids; the numbers of lines
    of the splits before it, summed up, are added. Lines aren't shuffled, only a row for each split is.
    """
    rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), "value", F.monotonically_increasing_id().alias("_row"))
    splits = materialize(rows.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_row").alias("_first")), "splits")
    placed = running_sum(splits, by_number(splits, "_block"), ["_block"], F.col("_n"), "_before", by=("file",))
    joined = rows.join(sendable(placed.select("file", "_block", "_first", "_before")), ["file", "_block"])
    return joined.select("file", (F.col("_row") - F.col("_first") + F.col("_before") + 1).alias("line"), "value")


def read_numbered_jsonl(spark: SparkSession, paths: str | list[str], schema: str, lenient: bool = False) -> DataFrame:
    """file, line and the fields of JSON lines. Blank lines are skipped; a broken one fails the read with its file and number, or is left out if lenient."""
    fields = StructType.fromDDL(schema)
    parsed = F.from_json("value", StructType([*fields.fields, StructField("_broken", StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = numbered_lines(spark, paths).where(T.strip(F.col("value")) != "").withColumn("_parsed", parsed)
    broken = F.col("_parsed").isNull() | F.col("_parsed._broken").isNotNull() | ~F.col("value").rlike(r"^\s*\{")
    fails = F.raise_error(F.concat("file", F.lit(", line "), F.col("line").cast("string"), F.lit(": no JSON object"))).cast("boolean")
    kept = rows.where(~broken) if lenient else rows.where(F.when(broken, fails).otherwise(True))
    return kept.select("file", "line", *[F.col(f"_parsed.{f.name}").alias(f.name) for f in fields.fields])


def read_texts(spark: SparkSession, paths: str | list[str], field: str = "text") -> DataFrame:
    """The stripped texts of one field of JSON lines, without blank ones."""
    rows = read_jsonl(spark, paths, f"`{field}` string").select(T.strip(F.col(field)).alias("text"))
    return rows.where("text <> ''")


def read_training_texts(spark: SparkSession, path: str, field: str = "text") -> DataFrame:
    """The texts of a training file, and of no other: a file or folder that isn't named train.jsonl is refused, as is a path through held-out data."""
    parts = [p.lower() for p in path.rstrip("/").split("/")]
    if parts[-1] != "train.jsonl":
        raise ValueError(f"only train.jsonl may be learnt from, not {path}")
    if held := [p for p in parts if "validation.jsonl" in p or "test.jsonl" in p]:
        raise ValueError(f"{held[0]} is held out: {path}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(path)
    return read_texts(spark, path, field)


def read_text_files(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """path, text of every text file below a folder, in the order of paths; none is an error."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True)
    if not rows.inputFiles():
        raise FileNotFoundError(f"no {pattern} below {folder}")
    return rows.select(F.input_file_name().alias("path"), F.col("value").alias("text")).orderBy("path")


def first_text_file(spark: SparkSession, folder: str, pattern: str = "*.txt") -> str:
    """The path that sorts first among the text files of a folder."""
    found = spark.read.option("pathGlobFilter", pattern).text(folder).inputFiles()
    if not found:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return min(found)


def prompt_texts(spark: SparkSession, path: str) -> DataFrame:
    """prompt: the lines of a small file that aren't blank; its parts between blank lines if it has any such line."""
    text = spark.read.text(path, wholetext=True).select(F.replace("value", F.lit("\r\n"), F.lit("\n")).alias("t"))
    parts = F.split("t", F.when(F.col("t").contains("\n\n"), F.lit("\n\n")).otherwise(F.lit("\n")))
    return text.select(F.explode(F.filter(F.transform(parts, T.strip), lambda x: x != "")).alias("prompt"))


def benchmark_prompts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """prompt: those that are text and not blank; other rows are left out."""
    return read_jsonl(spark, paths, "prompt string", lenient=True).where(T.strip(F.coalesce("prompt", F.lit(""))) != "")


def evaluation_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """domain, text; a row without either fails the read."""
    needed = lambda c: F.when(T.strip(F.coalesce(c, F.lit(""))) == "", F.raise_error(F.lit(f"a record has no {c}"))).otherwise(F.col(c)).alias(c)
    return read_jsonl(spark, paths, "domain string, text string").select(needed("domain"), needed("text"))


def history_marks(spark: SparkSession, folders: list[str], names: list[str], fields: tuple[str, ...] = ("sha256", "id")) -> DataFrame:
    """mark: field and value of the JSON lines files that are there, of folders x names; blank fields have none."""
    hadoop = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    paths = [p for p in (f"{f}/{n}" for f in folders for n in names) if hadoop(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop(p))]
    if not paths:
        return spark.createDataFrame([], "mark string")
    rows = read_jsonl(spark, paths, ", ".join(f"`{f}` string" for f in fields))
    marks = F.array_compact(F.array(*[F.when(T.strip(F.coalesce(f, F.lit(""))) != "", F.concat(F.lit(f"{f}:"), T.strip(F.col(f)))) for f in fields]))
    return rows.select(F.explode(marks).alias("mark")).distinct()


def pinned(spark: SparkSession, root: str, revision: str) -> DataFrame:
    """The Parquet table of one revision, a folder named by 40 hexadecimal digits."""
    if not re.fullmatch("[0-9a-f]{40}", revision):
        raise ValueError("a revision must be 40 hexadecimal digits")
    return spark.read.parquet(f"{root}/{revision}")


def read_blocks(spark: SparkSession, path: str, size: int, vocabulary: int) -> DataFrame:
    """Packed blocks; a block with a wrong width, shape, id, mask or label fails the read. Labels that aren't there are derived."""
    from quarryline.operators.packing import with_labels
    from quarryline.operators.validate import block_problems

    rows = spark.read.parquet(path)
    rows = rows if "labels" in rows.columns else with_labels(rows)
    fails = F.raise_error(F.concat(F.lit("block "), F.col("block_id").cast("string"), F.lit(": "), F.col("_problems"))).cast("boolean")
    return rows.withColumn("_problems", block_problems(size, vocabulary)).where((F.col("_problems") == "") | fails).drop("_problems")


def text_units(files: DataFrame) -> DataFrame:
    """path, unit, text: paragraphs between blank lines, stripped, without empty ones."""
    units = F.filter(F.transform(F.split("text", "\n\n"), T.strip), lambda u: u != "")
    return files.select("path", F.posexplode(units).alias("unit", "text"))


def named_sources(values: list[str]) -> dict[str, str]:
    """SOURCE=PATH arguments as a mapping; blank or repeated names are errors."""
    out: dict[str, str] = {}
    for value in values:
        name, equals, path = (x.strip() for x in value.partition("="))
        if not (name and equals and path) or name in out:
            raise ValueError(f"expected a new SOURCE=PATH, got {value!r}")
        out[name] = path
    return out


def staged_sources(spark: SparkSession, inputs: dict[str, str], seed: str, id_field: str = "id", text_field: str = "text") -> DataFrame:
    """source, record_id, text, text_bytes, text_sha256, selection_key, output_key of all sources.

    A row without an id or text fails the read, as does a broken line.
    """
    parts = []
    for source in sorted(inputs):
        rows = read_jsonl(spark, inputs[source], f"`{id_field}` string, `{text_field}` string")
        record = T.strip(F.coalesce(id_field, F.lit("")))
        checked = F.when(record == "", F.raise_error(F.lit(f"{source}: a record has no id"))).otherwise(record)
        text = F.when(T.strip(F.coalesce(text_field, F.lit(""))) == "", F.raise_error(F.lit(f"{source}: a record has no text"))).otherwise(F.col(text_field))
        parts.append(rows.select(F.lit(source).alias("source"), checked.alias("record_id"), text.alias("text")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    keys = [stable_key(seed, p, F.col("source"), F.col("record_id")).alias(f"{n}_key") for p, n in (("select", "selection"), ("output", "output"))]
    return rows.select("*", F.octet_length("text").cast("long").alias("text_bytes"), sha(F.col("text")).alias("text_sha256"), *keys)


def prompts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """id, prompt, category; prompts are required, ids follow the line if missing."""
    rows = read_jsonl(spark, paths, "id string, prompt string, category string").coalesce(1)  # a handful of lines in one file
    line = F.monotonically_increasing_id() + 1
    prompt = F.when(T.strip(F.coalesce("prompt", F.lit(""))) == "", F.raise_error(F.lit("a prompt is missing"))).otherwise(F.col("prompt"))
    return rows.select(F.coalesce("id", F.format_string("prompt-%03d", line)).alias("id"), prompt.alias("prompt"), F.coalesce("category", F.lit("completion")).alias("category"))


def raw_records(rows: DataFrame, text_fields: dict[str, Column], url_fields: list[Column], dataset: str, subset: str) -> DataFrame:
    """Canonical raw records: the first text that isn't blank, the first address, an id from both, sizes and hashes."""
    from quarryline.functions.hashing import stable_doc_id

    text, field = T.first_nonblank(text_fields)
    url = F.coalesce(*[F.nullif(T.strip(c), F.lit("")) for c in url_fields]) if url_fields else F.lit(None).cast("string")
    found = rows.select(text.alias("text"), field.alias("text_field"), url.alias("source_url"))
    return found.select(stable_doc_id(dataset, subset, F.col("source_url"), F.col("text")).alias("id"), F.lit(dataset).alias("source_dataset"), F.lit(subset).alias("source_subset"), "source_url", "text", "text_field", sha(F.col("text")).alias("raw_text_sha256"), F.octet_length("text").cast("long").alias("raw_text_bytes"))


def registry(path: str | Path) -> dict[str, dict]:
    """A YAML registry of sources by id; needs PyYAML. Blank and repeated ids are errors."""
    import yaml

    out: dict[str, dict] = {}
    for item in (yaml.safe_load(Path(path).read_text("utf-8")) or {}).get("sources") or []:
        name = str(item.get("id", "")).strip()
        if not name or name in out:
            raise ValueError(f"blank or repeated source id {name!r}")
        out[name] = item
    if not out:
        raise ValueError("the registry has no sources")
    return out


#: Bytes of a file that a task holds while it runs them through a digest.
HELD = 1 << 22


def digest_of_file(stream, most: int = HELD) -> str:
    """sha256 of what an open file holds, a bounded piece at a time."""
    digest = hashlib.sha256()
    while data := stream.read(most):
        digest.update(data)
    return digest.hexdigest()


def files_with_digests(spark: SparkSession, folder: str) -> DataFrame:
    """path, name (the path below the folder), bytes, sha256 of every file below a folder, of any size, empty ones too.

    The listing becomes rows, dealt over the tasks, which stream the files through the digest. Names that begin with a dot or an
    underscore, or lie below such, are left out, as Spark's readers do.
    """
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder)
    found = [(f.path[len(base.rstrip("/")) + 1 :], f.size) for f in system.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file]
    seen = [(f"{folder.rstrip('/')}/{name}", name, size) for name, size in found if not any(x[0] in "._" for x in name.split("/"))]
    listed = spark.createDataFrame(seen, "path string, name string, bytes long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for k, name in enumerate(batch.column("name").to_pylist()):
                with system.open_input_stream(f"{base}/{name}") as stream:
                    found = digest_of_file(stream)
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, pa.array([found])], [*batch.schema.names, "sha256"])

    return listed.repartition(spark.sparkContext.defaultParallelism, "path").mapInArrow(run, "path string, name string, bytes long, sha256 string")


def check_files(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """name, problem (missing, size, checksum) of files that don't match a manifest (name, bytes, sha256)."""
    named = found.select("name", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha256"))
    problem = F.when(F.col("_bytes").isNull(), "missing").when(F.col("_bytes") != F.col("bytes"), "size").when(F.col("_sha256") != F.col("sha256"), "checksum")
    return manifest.join(named, "name", "left").select("name", problem.alias("problem")).where("problem is not null")


def located(offset: int, tokens: list[int]) -> tuple[int, int]:
    """The shard in which a token of the stream lies and its place there, from the shards' numbers of tokens."""
    if offset < 0:
        raise ValueError("an offset can't be negative")
    for shard, n in enumerate(tokens):
        if offset < n:
            return shard, offset
        offset -= n
    raise ValueError("the offset lies behind the last shard")


def read_shards(spark: SparkSession, folder: str, context: int, start: int = 0, manifest: str | None = None) -> DataFrame:
    """sequence, tokens: full sequences of a stream that lies in shards of 16-bit tokens, read from where start lies."""
    from quarryline.sources.shards import sequences

    return sequences(spark, folder, context, start, manifest)
