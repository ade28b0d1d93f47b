"""Token shards written by a stream, each token once, however often the run is interrupted.

The documents that pass are token streams, one for each split, in the order of batches and, within a batch, of doc_id. Each
batch finds the places of its tokens behind what the last commit counts, and its tasks write the shards that these
reach into. A shard that the batch doesn't fill stays open: it is written as a part file of that batch, and the next
batch that reaches it copies the part's bytes in front of its own. Then one record commits the batch: tokens, digests and open parts
by split. Files of a batch that wasn't committed are overwritten when it runs again, or taken away when a run begins, so
what is there is what the last record says; a batch that was committed, but that Spark hadn't noted, isn't run again.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import filters
from quarryline.operators.packing import EOS, word_ids
from quarryline.operators.prefix import by_number, running_sum
from quarryline.sources.scratch import materialize, passing
from quarryline.sources.sinks import write_json
from quarryline.streaming.control import Commits, Full, drive
from quarryline.streaming.incremental import SCHEMA, accepted, same_rules

#: Bytes copied at once from the part that a shard begins with.
COPIED = 1 << 22


def shard_name(split: str, shard: int) -> str:
    return f"{split}-{shard:06d}.bin"


def part_name(split: str, shard: int, batch: int) -> str:
    return f"{split}-{shard:06d}.{batch}.part"


def nothing() -> dict:
    return {"tokens": {}, "open": {}, "shards": []}


def slices(rows: DataFrame, size: int) -> DataFrame:
    """split, shard, at (in the shard), part: documents' tokens (ids, from place start, n of them) cut at the borders of shards."""
    spread = rows.where("n > 0").withColumn("shard", F.explode(F.sequence(F.floor(F.col("start") / size).cast("long"), F.floor((F.col("start") + F.col("n") - 1) / size).cast("long"))))
    low = F.greatest(F.col("shard") * size, F.col("start"))
    high = F.least((F.col("shard") + 1) * size, F.col("start") + F.col("n"))
    return spread.select("split", "shard", (low - F.col("shard") * size).alias("at"), F.slice("ids", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("part"))


def write_slices(parts: DataFrame, folder: str, size: int, opened: dict[str, dict], batch: int) -> list[dict]:
    """Writes each shard that parts reach into, under the name that it has after this batch; returns what was written, by split and shard.

    A task writes under a name of its own and renames at its end, so attempts don't meet; a repeated one puts the same bytes in place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(f"{root}/_writing", recursive=True)
        now, done, out, check, tokens, at = None, [], None, None, 0, None

        def close() -> None:
            if out is None:
                return
            out.close()
            split, shard = now
            name = shard_name(split, shard) if tokens == size else part_name(split, shard, batch)
            system.move(at, f"{root}/{name}")
            done.append((split, shard, name, tokens, check.hexdigest()))

        for got in batches:
            for split, shard, place, part in zip(*(got.column(k).to_pylist() for k in range(3)), got.column(3)):
                if (split, shard) != now:
                    close()
                    now, at = (split, shard), f"{root}/_writing/{uuid.uuid4().hex}"
                    out, check, tokens = system.open_output_stream(at), hashlib.sha256(), 0
                    if place:  # the shard was open: it begins with what earlier batches gave it
                        before = opened[split]
                        if before["shard"] != shard or before["tokens"] != place:
                            raise ValueError(f"{split}: shard {shard} goes on at {place}, open is {before}")
                        with system.open_input_stream(f"{root}/{before['name']}") as part_file:
                            while data := part_file.read(COPIED):
                                out.write(data)
                                check.update(data)
                                tokens += len(data) // 2
                if place != tokens:
                    raise ValueError(f"{split}: shard {shard} has {tokens} tokens, the next stand at {place}")
                ids = np.asarray(part.values)
                if len(ids) and (ids.min() < 0 or ids.max() > 65535):
                    raise ValueError("a token doesn't fit into 16 bits")
                data = ids.astype("<u2").tobytes()
                out.write(data)
                check.update(data)
                tokens += len(ids)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()))], ["split", "shard", "name", "tokens", "sha256"])

    ready = parts.repartition("split", "shard").sortWithinPartitions("split", "shard", "at")
    written = materialize(ready.mapInArrow(run, "split string, shard long, name string, tokens long, sha256 string"), "written")
    return [r.asDict() for r in written.orderBy("split", "shard").collect()]  # the shards of one batch


def roll_back(folder: str, record: dict, size: int) -> list[str]:
    """Takes away what the last record doesn't know of: unfinished files, parts of other batches, later shards. Returns their names."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    if system.get_file_info(root).type.name != "Directory":
        return []
    known = {o["name"] for o in record["open"].values()}
    gone = []
    for f in system.get_file_info(fs.FileSelector(root)):
        split, _, number = f.base_name.partition(".")[0].rpartition("-")
        full = f.base_name.endswith(".bin") and number.isdigit() and int(number) < record["tokens"].get(split, 0) // size
        if f.base_name == "_writing":
            system.delete_dir(f.path)
        elif f.base_name.endswith((".bin", ".part")) and not full and f.base_name not in known:
            system.delete_file(f.path)
            gone.append(f.base_name)
    return sorted(gone)


def _clear_older(folder: str, before: dict, now: dict) -> None:
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    for split, o in before["open"].items():
        if now["open"].get(split, {}).get("name") != o["name"] and system.get_file_info(f"{root}/{o['name']}").type.name == "File":
            system.delete_file(f"{root}/{o['name']}")


def run(spark: SparkSession, folder: str, out: str, checkpoint: str, tokens_per_shard: int, targets: dict[str, int] | None = None, rules: filters.StreamRules = filters.StreamRules(), files_per_batch: int = 8, stop_after: int | None = None, progress: str | None = None, every: int | None = None):
    """Appends the documents that new files of a folder hold to the shards of their splits.

    With targets, splits end at so many tokens, in the middle of a document if need be; other splits aren't written, and nothing
    is read once all are met. out must be a folder that all executors share. Returns the query.
    """
    same_rules(spark, checkpoint, rules)
    commits = Commits(spark, out)
    at, system = commits._hadoop(f"{checkpoint}/commits")
    last = commits.last()
    if last is not None and not system.exists(at):
        raise ValueError("the folder holds shards of another checkpoint")
    roll_back(out, last or nothing(), tokens_per_shard)

    def add(batch: DataFrame, number: int) -> None:
        if commits.read(number) is not None:  # committed before a crash, but not noted by Spark, which still has to see it go by
            batch.write.format("noop").mode("overwrite").save()
            return
        before = (commits.read(number - 1) if number else None) or nothing()
        if targets is not None and all(before["tokens"].get(s, 0) >= t for s, t in targets.items()):
            raise Full
        with passing(spark):
            ids = F.concat(word_ids(F.col("text")), F.array(F.lit(EOS)))
            rows = materialize(batch.select("split", "doc_id", "fp", ids.alias("ids")).withColumn("n", F.size("ids").cast("long")), "batch")
            had = spark.createDataFrame(list(before["tokens"].items()), "split string, had long")
            places = running_sum(rows.select("split", "doc_id", "fp", "n"), by_number(rows, "doc_id"), ["doc_id", "fp"], F.col("n"), "before", by=("split",))
            placed = places.join(F.broadcast(had), "split", "left").withColumn("start", F.col("before") + F.coalesce("had", F.lit(0)))  # a row for each split
            whole = rows.select("split", "fp", "ids").join(placed.select("split", "fp", "n", "start"), ["split", "fp"])
            if targets is not None:
                left = F.lit(None).cast("long")
                for s, t in targets.items():
                    left = F.when(F.col("split") == s, F.lit(t) - F.col("start")).otherwise(left)
                whole = whole.withColumn("left", left).where("left > 0").withColumn("n", F.least("n", "left")).withColumn("ids", F.slice("ids", F.lit(1), F.col("n").cast("int")))
            written = write_slices(slices(whole, tokens_per_shard), out, tokens_per_shard, before["open"], number)
        record = {"tokens": dict(before["tokens"]), "open": dict(before["open"]), "shards": []}
        for w in written:
            split = w.pop("split")
            record["tokens"][split] = w["shard"] * tokens_per_shard + w["tokens"]
            record["open"].pop(split, None)
            if w["tokens"] == tokens_per_shard:
                record["shards"].append({"split": split, **w})
            else:
                record["open"][split] = w
        commits.write(number, record)
        _clear_older(out, before, record)

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    writer = accepted(stream, rules).dropDuplicates(["fp"]).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return drive(spark, writer, stop_after, progress, every)[0]


def write_manifests(spark: SparkSession, out: str) -> dict[str, str]:
    """A manifest for each split beside its shards, the open one last, as the reader of token shards takes it; returns their names."""
    commits = Commits(spark, out)
    numbers = commits.numbers()
    if not numbers:
        return {}
    shards: dict[str, list[dict]] = {}
    for number in numbers:  # a shard is full in one batch only
        for s in commits.read(number)["shards"]:
            shards.setdefault(s["split"], []).append(s)
    last = commits.read(numbers[-1])
    names = {}
    for split, total in sorted(last["tokens"].items()):
        mine = sorted(shards.get(split, []), key=lambda s: s["shard"]) + ([last["open"][split]] if split in last["open"] else [])
        names[split] = f"{split}.manifest.json"
        listed = [{"name": s["name"], "tokens": s["tokens"], "bytes": 2 * s["tokens"], "sha256": s["sha256"]} for s in mine]
        write_json(spark, f"{out}/{names[split]}", {"total_tokens": total, "shards": listed})
    return names
