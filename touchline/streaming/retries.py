"""T2, N13 as a stream: each match that is incomplete is a small state machine fed by the attempts to read it.

Events are rows (match_id, attempt, got, status, at): one or more for an attempt.  ``got``: there is a result;
``status``: it is incomplete again, and how.  An attempt counts as in ``operators.incremental.retry_pass``: it
succeeds with a result and no status, and else the match takes the status, ``timeout_unverified`` if there is
none.  Attempt 0 lists a match that was not known to be incomplete.

State, for open matches only: a value (status, tries, last attempt), the list of statuses so far, and a timer.
A match leaves the state when it is done, when it is verified to be empty (unless dead ones are tried too), after
``passes`` tries, or when the watermark passes its last attempt by ``patience`` (status ``expired``).  What comes
after that, attempts that were seen, and matches nobody listed change nothing, so a replay is harmless.  A null
match_id is a match like others; a null attempt counts for nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..operators import incremental as I

DONE, EXPIRED = "done", "expired"
OUT = "match_id long, attempt int, status string, tries int, final boolean, history string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Retries(StatefulProcessor):
    def __init__(self, passes: int = 3, include_dead: bool = False, patience_ms: int = 7 * 86_400_000):
        self.passes, self.tried, self.patience = passes, {I.OPEN, I.DEAD} if include_dead else {I.OPEN}, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "status string, tries int, attempt int")
        self.past = handle.getListState("past", "status string")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        status = initialState.status or I.OPEN
        if status in self.tried:
            self.now.update((status, 0, 0))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        given: dict[int, list] = {}  # attempt: has a result, the least status, the latest time; of ``passes`` + 1 at most
        for r in rows:
            if r.attempt is None:
                continue
            one = given.setdefault(r.attempt, [False, None, 0])
            one[0] |= bool(r.got)
            one[1] = min(filter(None, (one[1], r.status)), default=None)
            one[2] = max(one[2], int(r.at.timestamp() * 1000) if r.at else 0)
            if len(given) > self.passes + 1:
                held = self.now.get()[2] if self.now.exists() else -1
                late = [a for a in given if a <= held and a]
                del given[late[0] if late else max(given)]
        if not given:
            return
        # each call of the state is a message to the JVM: it is read once and written once, whatever comes between
        held = self.now.get()
        was = now = tuple(held) if held else None
        past, added, wait = None, [], None
        for attempt in sorted(given):
            got, status, at = given[attempt]
            if attempt == 0:
                if now is None and (status or I.OPEN) in self.tried:
                    now, wait = (status or I.OPEN, 0, 0), at
                continue
            if now is None or attempt <= now[2]:
                continue
            tries = now[1] + 1
            status = DONE if got and status is None else status or I.OPEN
            final = status not in self.tried or tries >= self.passes
            if past is None:
                past = [s[0] for s in self.past.get()] if tries > 1 and was is not None else []
            added.append(status)
            history = ";".join([*past, *added])
            if final:
                now, wait = None, None
            else:
                now, wait = (status, tries, attempt), at
            yield Row(match_id=key[0], attempt=attempt, status=status, tries=tries, final=final, history=history)
        if now is None:
            if was is not None:
                self._forget(was[1])
        elif now != was:
            self.now.update(now)
            for status in added:
                self.past.appendValue((status,))
            self._wait(wait)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.now.exists():
            _, tries, last = self.now.get()
            history = ";".join([*(s[0] for s in self.past.get()), EXPIRED])
            self._forget(tries)
            yield Row(match_id=key[0], attempt=last, status=EXPIRED, tries=tries, final=True, history=history)

    def _wait(self, at: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at + self.patience)

    def _forget(self, tries: int) -> None:
        self.now.clear()
        if tries:
            self.past.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)


def retry_states(events: DataFrame, incomplete: DataFrame, passes: int = 3, include_dead: bool = False, patience_days: float = 7, late: str = "0 seconds") -> DataFrame:
    """A row for each attempt that counted, and for each match that ran out of time.

    events: a stream; incomplete: a table (match_id, status), one row a match, the state that it starts with."""
    known = incomplete.groupBy("match_id").agg(F.min("status").alias("status")).groupBy("match_id")
    machine = Retries(passes, include_dead, int(patience_days * 86_400_000))
    timed = events.select("match_id", F.col("attempt").cast("int").alias("attempt"), "got", "status", F.col("at").cast("timestamp").alias("at")).withWatermark("at", late)
    return timed.groupBy("match_id").transformWithState(machine, OUT, "Update", "EventTime", known)


def run_retries(events: DataFrame, incomplete: DataFrame, root: str, checkpoint: str, **options):
    """Start ``retry_states`` over what has come; each micro-batch's rows go to a folder of their own, which a
    replay writes again.  The state lives in RocksDB, whatever the session's own setting for other queries."""
    spark = events.sparkSession
    was = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        states = retry_states(events, incomplete, **options)
        write = lambda batch, k: batch.write.mode("overwrite").parquet(f"{root}/batch={k}")
        return states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, was) if was else spark.conf.unset(PROVIDER)


def latest_states(spark: SparkSession, root: str) -> DataFrame:
    """The last row of each match that was tried."""
    newest = Window.partitionBy("match_id").orderBy(F.desc("batch"), F.desc("attempt"), F.desc("final"))
    return spark.read.option("basePath", root).schema(f"{OUT}, batch long").parquet(root).withColumn("_k", F.row_number().over(newest)).where("_k = 1").drop("_k", "batch")


def after_passes(incomplete: DataFrame, states: DataFrame) -> DataFrame:
    """The table of incomplete matches after the attempts, as ``retry_until_done`` leaves it."""
    now = states.select(F.col("match_id").alias("_id"), F.col("status").alias("_now"))
    left = incomplete.join(now, F.col("match_id").eqNullSafe(F.col("_id")), "left").where(F.coalesce(F.col("_now") != DONE, F.lit(True)))
    fresh = F.when(F.col("_now").isin(I.OPEN, I.DEAD), F.col("_now"))
    return left.select(*[F.coalesce(fresh, F.col("status")).alias("status") if c == "status" else incomplete[c] for c in incomplete.columns])
