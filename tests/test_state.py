"""State that streams keep and tables that jobs leave: over several batches, ends, timeouts, retention and buckets."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import functions as F

from foliant.operators import package as pk
from foliant.plans.log_queries import with_state_store
from foliant.sources import shared
from foliant.streaming import events as ev

START = dt.datetime(2024, 1, 1)


def put(spark, folder, batches):
    """Each batch as one file, in order; rows: (event_id, minutes, run, kind)."""
    for i, rows in enumerate(batches):
        full = [(e, START + dt.timedelta(minutes=m), run, kind, 1.0, "") for e, m, run, kind in rows]
        path = f"{folder}/{i}"
        spark.createDataFrame(full, ev.EVENT_SCHEMA).coalesce(1).write.parquet(path)
        part = next(f for f in os.listdir(path) if f.endswith(".parquet"))
        os.makedirs(f"{folder}/in", exist_ok=True)
        os.rename(f"{path}/{part}", f"{folder}/in/{i}.parquet")
        os.utime(f"{folder}/in/{i}.parquet", (1_000_000 + i * 1000, 1_000_000 + i * 1000))
    return f"{folder}/in"


def follow(spark, path, make, folder):
    """Rows of every batch, one file a batch, and the state rows left at the end."""
    files = spark.readStream.schema(ev.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path).withWatermark("ts", "0 seconds")
    out = []

    def keep(batch, batch_id):
        out.append([(r["run_id"], r["status"], list(r["steps"])) for r in batch.collect()])

    def run():
        q = make(files).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        return q.lastProgress.stateOperators[0].numRowsTotal

    left = with_state_store(spark, run)
    return [sorted(b) for b in out if b], left


def test_a_run_that_ends_leaves_no_state(spark, tmp_path):
    path = put(spark, str(tmp_path), [[(1, 0, 7, "signup"), (2, 1, 7, "view"), (3, 1, 8, "signup")], [(5, 9, 8, "click"), (4, 3, 7, "click")], [(6, 20, 7, "purchase"), (7, 21, 8, "error")]])
    batches, left = follow(spark, path, ev.stream_turn_state, str(tmp_path))
    assert batches == [
        [(7, "running", [1, 2]), (8, "queued", [3])], [(7, "waiting", [1, 2, 4]), (8, "waiting", [3, 5])], [(7, "completed", [1, 2, 4, 6]), (8, "failed", [3, 5, 7])],
    ]
    assert left == 0


def test_rows_out_of_order_and_open_runs(spark, tmp_path):
    path = put(spark, str(tmp_path), [[(2, 5, 7, "click")], [(1, 5, 7, "view")]])
    batches, left = follow(spark, path, ev.stream_turn_state, str(tmp_path))
    assert batches == [[(7, "waiting", [2])], [(7, "waiting", [1, 2])]] and left > 0


def test_deadlines_move_with_the_newest_event(spark, tmp_path):
    path = put(spark, str(tmp_path), [[(1, 0, 7, "view"), (2, 0, 8, "view")], [(3, 8, 7, "view")], [(4, 15, 9, "view")], [(5, 40, 9, "purchase")], [(6, 41, 5, "purchase")]])
    batches, left = follow(spark, path, lambda s: ev.stream_deadline(s, 10 * 60_000), str(tmp_path))
    timed_out = [(r, steps) for b in batches for r, status, steps in b if status == "timed_out"]
    assert sorted(timed_out) == [(7, [1, 3]), (8, [2])] and left == 0


def test_merged_folders_of_committed_batches_go(spark, tmp_path):
    path = put(spark, str(tmp_path), [[(i, i, i % 3, "view")] for i in range(5)])
    files = spark.readStream.schema(ev.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    ev.stream_latest(files, f"{tmp_path}/t", f"{tmp_path}/c", "user_id", ["ts", "event_id"], 2).trigger(availableNow=True).start().awaitTermination()
    assert {(r["user_id"], r["event_id"]) for r in ev.latest_table(spark, f"{tmp_path}/t").collect()} == {(0, 3), (1, 4), (2, 2)}
    assert len(os.listdir(tmp_path / "t" / "merged")) == 1


def test_written_tables_go_when_released(spark):
    table = shared.written(spark.range(5))
    path = shared._written[-1][1]
    assert table.count() == 5 and shared.exists(spark, path)
    shared.release()
    assert not shared.exists(spark, path) and not shared._written


def test_materialised_tables_join_without_a_shuffle(spark, tmp_path):
    docs = spark.range(50).withColumnRenamed("id", "doc_id")
    runs = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("style_id"))
    left, n = pk.materialize(runs, docs.filter("doc_id < 40"), f"{tmp_path}/runs", buckets=4)
    right, _ = pk.materialize(runs.withColumn("font", F.lit("f")), docs, f"{tmp_path}/styles", buckets=4)
    pk.join_by_buckets(spark)
    joined = left.join(right.hint("merge"), ["doc_id", "style_id"])
    assert n == 160 and joined.count() == 160
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    again = pk.materialized(spark, "declared_again", f"{tmp_path}/runs", "doc_id BIGINT, style_id INT", 4)
    assert again.count() == 160 and pk.buckets_for(runs, 60) == 4
