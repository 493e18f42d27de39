"""Live versions of the event-log operators over an event stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliant.sources.shared import delete, exists, shared_folder

EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
TERMINAL = ("purchase", "error")


def stream_events(spark: SparkSession, path: str, glob: str = "*.parquet", delay: str = "1 hour") -> DataFrame:
    """The events of Parquet files as they arrive, with event time and a watermark. ts may be stored with or without zone."""
    kept = spark.read.option("pathGlobFilter", glob).parquet(path).schema
    files = spark.readStream.schema(kept).option("pathGlobFilter", glob).parquet(path)
    return files.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def stream_dedupe(events: DataFrame, key: str) -> DataFrame:
    """Repeats of a key within the watermark's delay are dropped; state is bounded by it."""
    return events.dropDuplicatesWithinWatermark([key])


def stream_step_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


ENDED = ("completed", "failed")
KEEP_MS = 30 * 24 * 3600 * 1000


class TurnState(StatefulProcessor):
    """State of each run: queued, running, waiting, completed, failed; or timed out past its deadline in event time.

    The newest event is one value; the ids of a run's steps are a list that only grows at its end, as long as the run.
    A run that ends gives its row and leaves no state; one that stays open for budget_ms of event time goes too, with a
    row "timed_out" where these are asked for. Events that come for a run that has gone are a run of their own.
    """

    def __init__(self, budget_ms: int, report: bool):
        self.budget_ms, self.report = budget_ms, report

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "status STRING, ms BIGINT, id BIGINT")
        self.steps = handle.getListState("steps", "step BIGINT")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = self.newest.get() if self.newest.exists() else None
        status, *last = before or ("queued", -1, -1)
        last, new = tuple(last), []
        for pdf in rows:
            for ts, event_id, kind in zip(pdf["ts"], pdf["event_id"], pdf["event_type"]):
                new.append((int(event_id),))
                now = (int(ts.timestamp() * 1000), int(event_id))
                if now > last:
                    last, status = now, turn_status(kind)
        ended = status in ENDED
        held = [step for (step,) in self.steps.get()] if before else []
        if before and (ended or last[0] != before[1]):
            self.handle.deleteTimer(before[1] + self.budget_ms)
        if ended:
            self._clear()
        else:
            if not before or last[0] != before[1]:
                self.handle.registerTimer(last[0] + self.budget_ms)
            self.steps.appendList(new)
            self.newest.update((status, *last))
        yield pd.DataFrame({"run_id": [key[0]], "status": [status], "steps": [sorted([*held, *(step for (step,) in new)])]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        steps = sorted(step for (step,) in self.steps.get())
        self._clear()
        if self.report:
            yield pd.DataFrame({"run_id": [key[0]], "status": ["timed_out"], "steps": [steps]})

    def _clear(self) -> None:
        self.newest.clear()
        self.steps.clear()

    def close(self) -> None:
        pass


def turn_status(kind: str) -> str:
    return {"signup": "queued", "view": "running", "click": "waiting", "purchase": "completed", "error": "failed"}.get(kind, "running")


TURN_STATE = "run_id BIGINT, status STRING, steps ARRAY<BIGINT>"


def stream_turn_state(events: DataFrame, keep_ms: int = KEEP_MS) -> DataFrame:
    """One row per run and trigger with its newest state. Rows of a run come in any order; time decides.

    An open run without events for keep_ms of event time is forgotten without a row.
    """
    return events.groupBy("user_id").transformWithStateInPandas(TurnState(keep_ms, False), outputStructType=TURN_STATE, outputMode="Update", timeMode="EventTime")


def stream_deadline(events: DataFrame, budget_ms: int) -> DataFrame:
    """stream_turn_state with a row "timed_out" for runs that stay open for budget_ms of event time."""
    return events.groupBy("user_id").transformWithStateInPandas(TurnState(budget_ms, True), outputStructType=TURN_STATE, outputMode="Update", timeMode="EventTime")


def merge_latest(batch: DataFrame, current: DataFrame | None, key: str, order: list[str]) -> DataFrame:
    """The last row of each key among the batch and the current table."""
    rows = batch if current is None else current.select(*batch.columns).unionByName(batch)
    rest = [c for c in batch.columns if c != key]
    top = rows.groupBy(key).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("x"))
    return top.select(key, *[F.col(f"x.{c}").alias(c) for c in rest])


def stream_latest(changes: DataFrame, path: str, checkpoint: str, key: str, order: list[str], buckets: int = 16):
    """Keep a keyed table at path, partitioned by bucket of the key: each micro-batch rewrites the buckets it touches.

    The merged rows of the touched buckets are written beside the table first, under the batch's number, and then put
    in its place, so a batch that is run again finds them and loses nothing. Those of the batch before, which is
    committed by then, are deleted. Returns the query's writer.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table, merged = f"{path}/table", f"{path}/merged/{batch_id}"
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        if not exists(spark, f"{merged}/_SUCCESS"):
            current = None
            if exists(spark, table):
                touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # buckets at most
                current = spark.read.schema(rows.schema).parquet(table).filter(F.col("bucket").isin(touched))
            elif batch_id:
                raise RuntimeError(f"{table} is gone, but batches before {batch_id} wrote it")
            merge_latest(rows, current, key, order).repartition(buckets, "bucket").write.mode("overwrite").parquet(merged)
        new = spark.read.schema(rows.schema).parquet(merged)
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)
        delete(spark, f"{path}/merged/{batch_id - 1}")

    return changes.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)


def latest_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/table").drop("bucket")


def stream_warnings(paragraphs: DataFrame, rules: DataFrame) -> DataFrame:
    """Numbering warnings on arriving paragraphs, stateless; rules: (role, code), a template's few rows."""
    from foliant.functions.text import numbering_prefix

    found = paragraphs.withColumn("prefix", numbering_prefix("text")).filter("prefix IS NOT NULL")
    return found.join(F.broadcast(rules), "role").select("doc_id", "paragraph_id", "code", "prefix")


def available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and give its rows as a table; for tests and batch replays."""
    import uuid

    spark, name = stream.sparkSession, f"stream_{uuid.uuid4().hex}"
    folder = shared_folder(spark)
    if mode == "append":
        out = f"{folder}/{name}"
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    rows = f"{folder}/{name}"

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{rows}/{batch_id}")

    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{rows}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(rows)
