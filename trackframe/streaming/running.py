"""Running a stream: start, wait, stop, callbacks and statistics."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from trackframe.session import shared_folder


@dataclass
class Stats:
    """What has gone through: rows, batches, late rows that were dropped, and the longest batch."""

    rows: int = 0
    batches: int = 0
    dropped: int = 0
    longest_ms: int = 0
    lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def take(self, progress) -> None:
        with self.lock:
            self.rows += progress.numInputRows
            self.batches += 1
            self.dropped += sum(s.numRowsDroppedByWatermark for s in progress.stateOperators)
            self.longest_ms = max(self.longest_ms, progress.batchDuration)


class _Listener(StreamingQueryListener):
    def __init__(self, stats: Stats, done: Callable[[str | None], None] | None):
        self.stats, self.done, self.id = stats, done, None
        self.early: list[tuple[str, Callable[[], None]]] = []  # what happened before the query's id was known
        self.lock = threading.Lock()

    def known(self, query_id: str) -> None:
        with self.lock:
            self.id = query_id
            early, self.early = self.early, []
        for whose, act in early:
            if whose == query_id:
                act()

    def _of(self, whose: str, act: Callable[[], None]) -> None:
        with self.lock:
            if self.id is None:
                self.early.append((whose, act))
                return
        if whose == self.id:
            act()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self._of(str(event.progress.id), lambda: self.stats.take(event.progress))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if self.done:
            self._of(str(event.id), lambda: self.done(event.exception))


class Run:
    """A stream that writes batches to a function, or to a table in memory."""

    def __init__(self, stream: DataFrame, checkpoint: str | None = None):
        self.stream, self.checkpoint, self.stats = stream, checkpoint, Stats()
        self.query: StreamingQuery | None = None
        self._listener: _Listener | None = None

    def start(self, each: Callable[[DataFrame, int], None] | None = None, table: str | None = None, mode: str = "append", done: Callable[[str | None], None] | None = None, available_now: bool = False) -> Run:
        """Begin; ``each`` gets every batch, ``done`` the error, if any, at the end. ``available_now`` takes what is there and ends."""
        spark: SparkSession = self.stream.sparkSession
        self._listener = _Listener(self.stats, done)
        spark.streams.addListener(self._listener)
        writer = self.stream.writeStream.outputMode(mode)
        writer = writer.foreachBatch(each) if each else writer.format("memory").queryName(table or "stream")
        if self.checkpoint:
            writer = writer.option("checkpointLocation", self.checkpoint)
        if available_now:
            writer = writer.trigger(availableNow=True)
        self.query = writer.start()
        self._listener.known(str(self.query.id))
        return self

    def wait(self, seconds: float | None = None) -> bool:
        """Whether it has ended (within so many seconds)."""
        if self.query is None:
            return True
        return bool(self.query.awaitTermination(seconds)) if seconds is not None else self.query.awaitTermination() is None

    def running(self) -> bool:
        return self.query is not None and self.query.isActive

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()
        if self._listener is not None:
            self.stream.sparkSession.streams.removeListener(self._listener)
            self._listener = None

    def reset(self) -> None:
        """Ready to start anew."""
        self.stop()
        self.query, self.stats = None, Stats()


def to_end(stream: DataFrame, name: str = "stream", mode: str = "append") -> DataFrame:
    """All that a stream gives for the files that are there, as a table in the shared folder: runs it to its end.

    Each batch has a folder of its own number, so one that is run again after a failure replaces what it wrote; in complete mode
    each replaces the one before.
    """
    path = shared_folder(stream.sparkSession, name)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/all" if mode == "complete" else f"{path}/batch{number}")

    stream.sparkSession.createDataFrame([], stream.schema).write.parquet(f"{path}/none")
    run = Run(stream, f"{path}-state").start(put, mode=mode, available_now=True)
    run.wait()
    error = run.query.exception() if run.query else None
    run.stop()
    if error is not None:
        raise error
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(path)
