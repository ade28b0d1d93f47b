"""What a running stream has read, when it stops, and what its batches have committed."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from quarryline.sources.sinks import write_json

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Full(Exception):
    """Raised in a batch that comes after all targets were met: it isn't read, and isn't committed either."""


class Progress(StreamingQueryListener):
    """Adds up what each run has read, batch by batch, whatever Spark itself remembers.

    With a path, a report is written there at least each `every` documents, and when a run ends, however it ends.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, every: int | None = None):
        self.spark, self.path, self.every = spark, path, every
        self.read: dict[str, int] = {}
        self.batches: dict[str, int] = {}
        self.ended: dict[str, threading.Event] = {}
        self.written = 0
        self.lock = threading.Lock()

    def _ended(self, run: str) -> threading.Event:
        with self.lock:
            return self.ended.setdefault(run, threading.Event())

    def report(self, run: str, state: str, error: str | None = None) -> None:
        if self.path is not None:
            said = {"documents_read": self.read.get(run, 0), "batches": self.batches.get(run, 0), "state": state, "stopped": state == "stopped"}
            write_json(self.spark, self.path, said if error is None else said | {"error": error})

    def onQueryStarted(self, event) -> None:
        self._ended(str(event.runId))

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        self.read[run] = self.read.get(run, 0) + event.progress.numInputRows
        self.batches[run] = self.batches.get(run, 0) + (event.progress.numInputRows > 0)
        if self.every is not None and self.read[run] // self.every > self.written // self.every:
            self.written = self.read[run]
            self.report(run, "running")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._ended(str(event.runId)).set()


@contextmanager
def keeping_state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep what they have seen in RocksDB, not in the executors' heap; the checkpoint remembers that."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def drive(spark: SparkSession, writer, stop_after: int | None = None, progress: str | None = None, every: int | None = None, once: bool = True):
    """Starts a writer and, if once, stays until all files there are have been read, `stop_after` documents have, or a batch says Full.

    A stop comes after a batch; the one that may have begun meanwhile isn't committed, and is read again by the next run.
    """
    seen = Progress(spark, progress, every)
    spark.streams.addListener(seen)
    query = None
    state, error = "finished", None
    try:
        with keeping_state_on_disk(spark):
            query = (writer.trigger(availableNow=True) if once else writer).start()
        run = str(query.runId)
        if not once:
            return query, seen
        while query.isActive and (stop_after is None or seen.read.get(run, 0) < stop_after):
            query.awaitTermination(0.05)
        if query.isActive:
            state = "stopped"
            query.stop()
        query.awaitTermination()
    except Exception as e:
        if Full.__name__ not in str(e):
            state, error = "failed", str(e)[:2000]
            raise
        state = "full"
    finally:
        if once and query is not None:
            seen._ended(run).wait(30 if state in ("finished", "stopped") else 5)  # the events of its batches come before; after an error it may not come
            if state == "finished" and stop_after is not None and seen.read.get(run, 0) >= stop_after:
                state = "stopped"
            seen.report(run, state, error)
        if once or query is None:
            spark.streams.removeListener(seen)
    return query, seen


class Commits:
    """A record for each batch of a stream, written as a whole after the batch's files and before the stream goes on.

    A record holds what the next batch builds on, so a batch reads one record and none of the earlier output.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, f"{folder}/_commits"

    def _hadoop(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def read(self, batch: int) -> dict | None:
        at, system = self._hadoop(f"{self.folder}/{batch}.json")
        if not system.exists(at):
            return None
        stream = system.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def numbers(self) -> list[int]:
        at, system = self._hadoop(self.folder)
        names = [f.getPath().getName() for f in system.listStatus(at)] if system.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def last(self) -> dict | None:
        numbers = self.numbers()
        return self.read(numbers[-1]) if numbers else None

    def write(self, batch: int, record: dict) -> None:
        write_json(self.spark, f"{self.folder}/{batch}.json", record)


def fresh_name() -> str:
    return uuid.uuid4().hex
