"""States of documents, kept while jobs report them: late, repeated and stale reports included.

A stream of changes(document_id, job_id, state, ts) is folded for each document in the order of ts, whatever the order of arrival. What is older than the newest report of
the document by more than the lateness is settled in a few fields; the rest waits in state, so that state does not grow with a document's history. The last job that
was queued owns the document: reports of others count for nothing. A document that stays in `processing` longer than its lease gets a transition that says so, by a timer. Every
transition is one row with a number of its own; a batch of them is one numbered commit, so that a batch that is repeated after a failure writes nothing twice.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestar.operators.content import ENDS, LEASE_SECONDS
from lodestar.sources import commits

CHANGE = "document_id string, job_id string, state string, ts timestamp"
FIELDS = ("owner", "state", "job_id", "at", "queued_at", "started_at", "finished_at", "failures")
FOLDED = "owner string, state string, job_id string, at long, queued_at long, started_at long, finished_at long, failures long"
KEPT = f"{FOLDED}, newest long, late long, number long"
TRANSITION = "document_id string, number long, state string, job_id string, queued_at long, started_at long, finished_at long, failures long, late long, expired boolean"
NOTHING = (None,) * 7 + (0,)
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def folded(before: tuple, changes: list[tuple[int, str, str]]) -> tuple:
    """The fields after changes(ts, job, state) in order. A change that was queued by another job since, or never was, is passed over."""
    owner, state, job, at, queued, started, finished, failures = before
    for ts, own, to in sorted(changes):
        owner = own if to == "queued" else owner
        if owner is None or owner == own:
            state, job, at = to, own, ts
            queued = ts if to == "queued" else queued
            started = ts if to == "processing" else started
            finished = ts if to in ENDS else finished
            failures += to == "failed"
    return owner, state, job, at, queued, started, finished, failures


class DocumentStates(StatefulProcessor):
    """Of one document: the settled fields, the changes that a late one may still go before, and the timer of its lease."""

    def __init__(self, lateness_seconds: float, lease_seconds: float):
        self.lateness, self.lease = int(lateness_seconds * 1_000_000), int(lease_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", KEPT)
        self.open = handle.getListState("open", "ts long, job_id string, state string")

    def _read(self) -> tuple[tuple, int, int, int, list]:
        kept = tuple(self.settled.get()) if self.settled.exists() else (*NOTHING, None, 0, 0)
        return kept[:8], kept[8], kept[9], kept[10], [tuple(r) for r in self.open.get()] if self.open.exists() else []

    def _row(self, key: tuple, fields: tuple, late: int, number: int, expired: bool) -> Row:
        _, state, job, _, queued, started, finished, failures = fields
        return Row(document_id=key[0], number=number, state=state, job_id=job, queued_at=queued, started_at=started, finished_at=finished, failures=failures, late=late, expired=expired)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        settled, newest, late, number, waiting = self._read()
        before, known = folded(settled, waiting), set(waiting)
        horizon = newest - self.lateness if newest is not None else None
        for r in rows:
            change = (r.ts, r.job_id, r.state)
            if horizon is not None and r.ts < horizon:
                late += 1
            else:
                known.add(change)
        newest = max([t for t, _, _ in known] + ([newest] if newest is not None else []), default=None)
        after = folded(settled, list(known))
        if newest is not None:
            old = [c for c in known if c[0] < newest - self.lateness]
            settled, known = folded(settled, old), known.difference(old)
        number += after != before
        self.settled.update((*settled, newest, late, number))
        self.open.put(sorted(known)) if known else self.open.clear()
        if after != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if after[1] == "processing":
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.lease)
            yield self._row(key, after, late, number, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        settled, newest, late, number, waiting = self._read()
        fields = folded(settled, waiting)
        if fields[1] == "processing":
            self.settled.update((*settled, newest, late, number + 1))
            yield self._row(key, fields, late, number + 1, True)

    def close(self) -> None:
        pass


def transitions(changes: DataFrame, lateness_seconds: float = 3600, lease_seconds: float = LEASE_SECONDS) -> DataFrame:
    """The transitions of a stream of changes; those without a document, job, state or time are not changes. Needs a state store with timers, which use_timers() sets."""
    whole = changes.where("document_id is not null and job_id is not null and state is not null and ts is not null")
    micros = whole.select("document_id", "job_id", "state", F.unix_micros("ts").alias("ts"))
    return micros.groupBy("document_id").transformWithState(DocumentStates(lateness_seconds, lease_seconds), TRANSITION, "Update", "ProcessingTime")


def use_timers(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def start(spark: SparkSession, changes: DataFrame, root: str, checkpoint: str, name: str = "states", once: bool = False, lateness_seconds: float = 3600, lease_seconds: float = LEASE_SECONDS, every: str = "5 seconds") -> StreamingQuery:
    """Runs the fold; each batch's transitions are added to the table `transitions` under root in one commit of the batch's number."""
    use_timers(spark)
    # with timers Spark would run one batch after the other without input, and so never end; where it is to end, timers fire in the batches that have some
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(not once).lower())

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is repeated is worked out again too, as its state must be: only its commit changes nothing
        session = batch.sparkSession
        base, made = commits.snapshot(session, root), commits.stage(batch, root, "transitions")
        commits.commit(session, base, added={"transitions": made}, writer=name, number=number)

    writer = transitions(changes, lateness_seconds, lease_seconds).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def current(spark: SparkSession, root: str) -> DataFrame:
    """The last transition of each document."""
    rows = commits.snapshot(spark, root).read(spark, "transitions")
    rest = [c for c in rows.columns if c != "document_id"]
    return rows.groupBy("document_id").agg(F.max_by(F.struct(*rest), "number").alias("l")).select("document_id", "l.*")
