"""Edit logs as streams: debounced, coalesced and undone state by document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def debounced(edits: DataFrame, gap: str = "300 milliseconds", late: str = "10 minutes") -> DataFrame:
    """Last edit of each session of a document; a session ends after a gap without edits."""
    return (
        edits.withWatermark("ts", late)
        .groupBy("doc_id", F.session_window("ts", gap).alias("session"))
        .agg(F.max_by(F.struct("event_id", "op", "item", "value"), F.struct("ts", "event_id")).alias("last"), F.count(F.lit(1)).alias("n"))
        .select("doc_id", F.col("session.start").alias("start"), F.col("session.end").alias("end"), "last.*", "n")
    )


def coalesced(edits: DataFrame) -> DataFrame:
    """First original and last new value of each item; update or complete output. The state has a row for each item."""
    at = F.struct("ts", "event_id")
    return edits.groupBy("doc_id", "item").agg(F.min_by("value", at).alias("original"), F.max_by("value", at).alias("latest"), F.count(F.lit(1)).alias("n"))


def histories(edits: DataFrame, undo: str = "error", redo: str = "view") -> DataFrame:
    """(doc_id, history, cursor) after each batch of edits, with the state kept by document.

    Edits are ordered within a batch; one that comes a batch too late is applied where it comes.
    """
    import pandas as pd

    def step(key, frames, state):
        n, at = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for op in rows["op"]:
            if op == undo:
                at = max(at - 1, 0)
            elif op == redo:
                at = min(at + 1, n)
            else:
                n = at = at + 1
        state.update((n, at))
        yield pd.DataFrame({"doc_id": [key[0]], "history": [n], "cursor": [at]})

    return edits.select("doc_id", "event_id", "ts", "op").groupBy("doc_id").applyInPandasWithState(step, "doc_id long, history long, cursor long", "n long, at long", "update", "NoTimeout")


def autosave(edits: DataFrame, folder: str, checkpoint: str, every: str = "60 seconds"):
    """Writes edits to a folder at a fixed pace; recovery reads what the last day holds."""
    return edits.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def recoverable(saved: DataFrame, now, hours: int = 24) -> DataFrame:
    return saved.where(F.col("ts") > F.lit(now) - F.expr(f"interval {hours} hours"))


def in_event_time(edits: DataFrame, late: str = "10 minutes", idle_hours: int = 24, undo: str = "error", redo: str = "view", save: str | None = None) -> DataFrame:
    """(doc_id, ts, history, cursor): each document's history after what the watermark has passed, in append mode.

    Edits wait in the state until the watermark is beyond them and are then folded in the order of their times
    and ids, so batches may come in any order within ``late``. A save ends a history: it is told with 0, and
    nothing is kept. A document without edits for ``idle_hours`` of event time is forgotten too, so
    the state holds the edits of ``late`` and two numbers for each document of the last day.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    idle = idle_hours * 3_600_000

    class History(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", "ms long, micros long, event_id long, kind int")
            self.done = handle.getValueState("done", "n long, at long, ms long")

        def handleInputRows(self, key, rows, timerValues):
            # timers of one time are one, so a document has as many as its edits' milliseconds
            for frame in rows:
                for ms in frame["ms"].unique().tolist():
                    self.handle.registerTimer(ms)
                self.waiting.appendList([(int(a), int(b), int(c), int(d)) for a, b, c, d in zip(frame["ms"], frame["micros"], frame["event_id"], frame["kind"])])
            yield pd.DataFrame({"doc_id": [], "ms": [], "history": [], "cursor": []}).astype("int64")

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            at_ms = expiredTimerInfo.getExpiryTimeInMs()
            waiting = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
            due, rest = [w for w in waiting if w[0] <= at_ms], [w for w in waiting if w[0] > at_ms]
            held = self.done.get() if self.done.exists() else None
            out = []
            if due:
                n, at, before = held if held is not None else (0, 0, due[0][0])
                ended = False
                for ms, _, _, kind in sorted(due, key=lambda w: (w[1], w[2])):
                    if ms >= before + idle:
                        n = at = 0
                    before, ended = ms, kind == 2
                    if kind == 2:
                        n = at = 0
                    elif kind < 0:
                        at = max(at - 1, 0)
                    elif kind > 0:
                        at = min(at + 1, n)
                    else:
                        n = at = at + 1
                    out.append((key[0], ms, n, at))
                self.waiting.put(rest) if rest else self.waiting.clear()
                if ended:
                    self.done.clear()
                else:
                    self.done.update((n, at, due[-1][0]))
                    self.handle.registerTimer(due[-1][0] + idle)
            elif held is not None and at_ms >= held[2] + idle:
                self.done.clear()
            # one row for each time that is told: the last of a millisecond
            last = {r[1]: r for r in out}
            yield pd.DataFrame([last[k] for k in sorted(last)], columns=["doc_id", "ms", "history", "cursor"]).astype("int64")

        def close(self) -> None:
            pass

    op = F.col("op")
    kind = F.when(op == undo, -1).when(op == redo, 1).when(op == F.lit(save), 2).otherwise(0)
    ts = F.col("ts").cast("timestamp")
    rows = edits.select("doc_id", "event_id", ts.alias("ts"), kind.cast("int").alias("kind")).withWatermark("ts", late)
    rows = rows.withColumn("ms", F.unix_millis("ts")).withColumn("micros", F.unix_micros("ts"))
    told = rows.groupBy("doc_id").transformWithStateInPandas(statefulProcessor=History(), outputStructType="doc_id long, ms long, history long, cursor long", outputMode="Append", timeMode="EventTime")
    return told.select("doc_id", F.timestamp_millis("ms").alias("ts"), "history", "cursor")
