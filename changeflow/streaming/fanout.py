"""One stream, several sinks: each micro-batch is a barrier, each sink keeps a ledger of the batches it has taken."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from changeflow.operators.transforms import Transform, compose

Write = Callable[[DataFrame, int], None]


class Ledger:
    """The batches that a sink has taken, as files named by their numbers on any Hadoop file system: a batch is noted by one
    rename to a name that wasn't there, so there is no moment without a last batch. Isolated sinks are noted likewise."""

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm = spark._jvm
        self.folder = folder.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _names(self, sink: str) -> list[str]:
        at = self._path(sink)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def last(self, sink: str) -> int:
        return max((int(n) for n in self._names(sink) if n.isdigit()), default=-1)

    def _put(self, sink: str, name: str, text: str) -> None:
        self._fs.mkdirs(self._path(sink))
        draft = self._path(f"{sink}/.{name}.draft")
        out = self._fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.rename(draft, self._path(f"{sink}/{name}"))

    def note(self, sink: str, batch: int) -> None:
        self._put(sink, str(batch), json.dumps({"batch": batch}))
        for n in self._names(sink):
            if n.isdigit() and int(n) < batch - 2:
                self._fs.delete(self._path(f"{sink}/{n}"), False)

    def isolate(self, sink: str, why: str, batch: int) -> None:
        self._put(sink, "isolated", json.dumps({"batch": batch, "why": why[:2000]}))

    def isolated(self, sink: str) -> str | None:
        """Why a sink was left out, and from which batch on; null if it wasn't."""
        if "isolated" not in self._names(sink):
            return None
        stream = self._fs.open(self._path(f"{sink}/isolated"))
        try:
            got = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return f"isolated since batch {got['batch']}: {got['why']}"

    def readmit(self, sink: str) -> None:
        """The sink takes part again, from the next batch on; what it missed is for whoever decides this to send."""
        self._fs.delete(self._path(f"{sink}/isolated"), False)


class SinkFailed(RuntimeError):
    pass


class FanOut:
    """Writes a batch to each sink that hasn't taken it. on_failure: `fail` ends the job, `isolate` leaves the sink out from
    then on; with no sink left it fails all the same."""

    def __init__(self, sinks: dict[str, Write], ledger: Ledger | None = None, on_failure: str = "fail"):
        if on_failure not in ("fail", "isolate"):
            raise ValueError(f"unknown on-sink-failure {on_failure!r}")
        self.sinks, self.ledger, self.on_failure = sinks, ledger, on_failure
        # A sink that was left out stays out after a restart, or it would go on behind a gap.
        self.dead: dict[str, str] = {n: why for n in sinks if ledger and (why := ledger.isolated(n))}
        self.seen: dict[str, int] = {}

    def _last(self, name: str) -> int:
        return self.ledger.last(name) if self.ledger else self.seen.get(name, -1)

    def __call__(self, df: DataFrame, batch: int) -> None:
        due = [n for n in self.sinks if n not in self.dead and self._last(n) < batch]
        shared = df.persist() if len(due) > 1 else df
        try:
            for name in due:
                try:
                    self.sinks[name](shared, batch)
                except Exception as e:
                    if self.on_failure == "fail":
                        raise SinkFailed(f"sink {name}: {e}") from e
                    self.dead[name] = str(e)
                    if self.ledger:
                        self.ledger.isolate(name, str(e), batch)
                else:
                    self.seen[name] = batch
                    if self.ledger:
                        self.ledger.note(name, batch)
        finally:
            if shared is not df or len(due) > 1:
                shared.unpersist()
        if len(self.dead) == len(self.sinks):
            raise SinkFailed(f"all sinks failed: {self.dead}")


def guard_restore(spark: SparkSession, checkpoint: str, ledger: Ledger, sinks: list[str], policy: str = "fail") -> bool:
    """Whether batches were taken but the checkpoint that knows their offsets is gone; policy fail raises."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/offsets")
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    lost = not there and any(ledger.last(s) >= 0 for s in sinks)
    if lost and policy == "fail":
        raise SinkFailed("sinks have taken batches, but there is no checkpoint to restore")
    return lost


def run(stream: DataFrame, transforms: list[Transform], sinks: dict[str, Write], checkpoint: str, interval: str | None = None, on_failure: str = "fail") -> StreamingQuery:
    """Without an interval, what is there now is read and the query ends (a bounded run)."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.minBatchesToRetain", "3")
    ledger = Ledger(spark, f"{checkpoint.rstrip('/')}-ledger")
    guard_restore(spark, checkpoint, ledger, list(sinks))
    writer = compose(transforms)(stream).writeStream.foreachBatch(FanOut(sinks, ledger, on_failure)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
