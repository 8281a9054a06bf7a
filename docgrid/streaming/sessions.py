"""Counting sessions: a log of shots with undo, as batch folds and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

OUT = "session long, total long, shots long"
STREAM = "session long, total long, shots long, current long, closed boolean"


def running_total(shots: DataFrame) -> DataFrame:
    """session, seq, total: sum of appended counts so far."""
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return shots.where("op = 'append'").select("session", "seq", F.sum("cnt").over(w).alias("total"))


def applied(log: list[int], op: str, count: int | None) -> None:
    """One operation on a session's log of counts."""
    if op == "append":
        log.append(count or 0)
    elif op == "reset":
        log.clear()
    elif log and op in ("undo", "plus", "minus"):
        last = log.pop()
        if op != "undo":
            log.append(last + 1 if op == "plus" else max(0, last - 1))


def folded(shots: DataFrame) -> DataFrame:
    """session, total, shots after all operations in order: append a count, undo drops
    the last shot, plus and minus change it by one (not below 0), reset clears.

    One shuffle by session; each task walks its sorted rows and holds the log of one session."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log: list[int] = []
        done: list[tuple] = []
        session, begun = None, False

        def ended() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*done) if done else [[]] * 3)], ["session", "total", "shots"])
            done.clear()
            return out

        for batch in batches:
            for s, op, count in zip(*(batch.column(c).to_pylist() for c in ("session", "op", "cnt"))):
                if begun and s != session:
                    done.append((session, sum(log), len(log)))
                    log.clear()
                session, begun = s, True
                applied(log, op, count)
            yield ended()
        if begun:
            done.append((session, sum(log), len(log)))
        yield ended()

    rows = shots.select(F.col("session").cast("long"), "seq", "op", F.col("cnt").cast("long").alias("cnt"))
    return rows.repartition("session").sortWithinPartitions("session", "seq").mapInArrow(run, OUT)


class Log(StatefulProcessor):
    """A session's state: the counts of its log, and shots that wait for the watermark.

    Shots wait until the watermark has passed them and are then applied in order, so a shot may come in a later batch
    than its successors as long as it is not later than the watermark's delay. A session without shots for ``idle``
    milliseconds gives its last figures (closed) and its state goes."""

    def __init__(self, idle: int) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getListState("log", "cnt long")
        self.waiting = handle.getListState("waiting", "seq long, op string, cnt long, at long")
        self.last = handle.getValueState("last", "at long")

    def _figures(self, key: tuple, log: list[int], closed: bool) -> Row:
        return Row(session=key[0], total=sum(log), shots=len(log), current=log[-1] if log else 0, closed=closed)

    def _settled(self, key: tuple, watermark: int) -> Iterator[Row]:
        """Applies what the watermark has passed, and sets the timer for the rest or for the session's end."""
        waiting = list(self.waiting.get())
        ripe = sorted((w for w in waiting if w[3] <= watermark), key=lambda w: w[0])
        if ripe:
            log = [x[0] for x in self.log.get()]
            before = len(log)
            for _, op, count, _ in ripe:
                applied(log, op, count)
            if len(ripe) == 1 and ripe[0][1] == "append" and len(log) == before + 1:
                self.log.appendValue((log[-1],))
            else:
                self.log.put([(x,) for x in log]) if log else self.log.clear()
            rest = [w for w in waiting if w[3] > watermark]
            self.waiting.put(rest) if rest else self.waiting.clear()
            waiting = rest
            yield self._figures(key, log, False)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        (last,) = self.last.get()
        self.handle.registerTimer(min((w[3] for w in waiting), default=last + self.idle))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        new = [(r.seq, r.op, r.cnt, int(r.ts.timestamp() * 1000)) for r in rows]
        self.waiting.appendList(new)
        last = self.last.get()[0] if self.last.exists() else 0
        self.last.update((max(last, *(n[3] for n in new)),))
        yield from self._settled(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        (last,) = self.last.get()
        if last + self.idle > watermark:
            yield from self._settled(key, watermark)
            return
        log = [x[0] for x in self.log.get()]
        for _, op, count, _ in sorted(self.waiting.get()):
            applied(log, op, count)
        yield self._figures(key, log, True)
        for state in (self.log, self.waiting, self.last):
            state.clear()

    def close(self) -> None:
        pass


def streamed(shots: DataFrame, delay: str = "10 minutes", idle: str = "1 day") -> DataFrame:
    """session, total, shots, current (count of the last shot), closed, over a stream of shots (session, seq, op,
    cnt, ts): a row whenever the watermark, ``delay`` behind the newest shot, has passed shots of a session, and
    one when the session has had none for ``idle``. Shots later than the delay are dropped. State is the log and the shots of the
    delay, of sessions that are not idle. Needs the RocksDB state store."""
    rows = shots.select(F.col("session").cast("long").alias("session"), F.col("seq").cast("long").alias("seq"), "op", F.col("cnt").cast("long").alias("cnt"), F.col("ts").cast("timestamp").alias("ts"))
    quiet = int(pd.Timedelta(idle).total_seconds() * 1000)
    return rows.withWatermark("ts", delay).groupBy("session").transformWithState(Log(quiet), STREAM, "Update", "EventTime")


def current_counts(shots: DataFrame) -> DataFrame:
    """session, seq, current, total after each operation: the log as it is shown. One shuffle by session."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log: list[int] = []
        session, total = None, 0
        for batch in batches:
            out = []
            for s, op, count in zip(*(batch.column(c).to_pylist() for c in ("session", "op", "cnt"))):
                if s != session:
                    log.clear()
                    session, total = s, 0
                n, was = len(log), log[-1] if log else 0
                applied(log, op, count)
                total = 0 if not log else total + (log[-1] if len(log) > n else -was if len(log) < n else log[-1] - was)
                out.append((log[-1] if log else 0, total))
            columns = list(zip(*out)) or [[], []]
            yield pa.RecordBatch.from_arrays([batch.column("session"), batch.column("seq"), *[pa.array(c, pa.int64()) for c in columns]], ["session", "seq", "current", "total"])

    rows = shots.select(F.col("session").cast("long"), F.col("seq").cast("long"), "op", F.col("cnt").cast("long").alias("cnt"))
    return rows.repartition("session").sortWithinPartitions("session", "seq").mapInArrow(run, "session long, seq long, current long, total long")
