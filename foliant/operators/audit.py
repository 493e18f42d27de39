"""Run logs, sessions and events in batch: sequences, final states, traces, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as tx

STRUCTURAL = ("merge_paragraph", "split_paragraph")
PHASE_SIZE = 4


def event_sequence(events: DataFrame) -> DataFrame:
    return events.withColumn("seq", F.row_number().over(Window.partitionBy("run_id").orderBy("ts", "event_id")))


def run_state(events: DataFrame) -> DataFrame:
    """Last status and payload, first and last time and number of events of each run; a map-side aggregation, no window."""
    payload = ["props"] if "props" in events.columns else []
    last = F.max(F.struct("ts", "event_id", "event_type", *payload))
    out = events.groupBy("run_id").agg(last.alias("x"), F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n_events"))
    return out.select("run_id", F.col("x.event_type").alias("status"), *[F.col(f"x.{p}").alias("payload") for p in payload], "started", "ended", "n_events")


def pending_tasks(runs: DataFrame) -> DataFrame:
    """Per task its latest waiting run, if none of its runs was resolved later. runs: task_id, run_id, ts, status."""
    last_wait = F.max(F.when(F.col("status") == "waiting", F.struct("ts", "run_id")))
    last_done = F.max(F.when(F.col("status") == "resolved", F.col("ts")))
    out = runs.groupBy("task_id").agg(last_wait.alias("w"), last_done.alias("done"))
    return out.filter(F.col("w").isNotNull() & (F.col("done").isNull() | (F.col("done") <= F.col("w.ts")))).select("task_id", F.col("w.run_id").alias("run_id"), F.col("w.ts").alias("waiting_since"))


def turn_trace(turns: DataFrame, limit: int = 50, offset: int = 0, run: int | None = None, task: int | None = None, every: bool = False) -> DataFrame:
    """A page of turns by time and turn order, limit 1..200: of one run, of one task, or of every run its own page.

    Without any of these nothing, as a trace of no run has no turns.
    """
    limit = min(200, max(1, limit))
    order = [c for c in ("ts", "turn", "role", "text") if c in turns.columns]
    if every:
        place = F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))
        return turns.withColumn("place", place).filter(F.col("place").between(offset + 1, offset + limit)).drop("place")
    if run is None and task is None:
        return turns.limit(0)
    own = turns if run is None else turns.filter(F.col("conv_id") == run)
    own = own if task is None else own.filter(F.col("task_id") == task)
    return own.orderBy(*order).offset(offset).limit(limit)


def session_list(sessions: DataFrame, goals: DataFrame) -> DataFrame:
    """Sessions with goal and document flag, newest first."""
    out = sessions.join(goals, "session_id", "left")
    return out.withColumn("has_document", F.col("document").isNotNull()).drop("document").orderBy(F.desc("updated"), "session_id")


def session_snapshot(turns: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Each session's turns in order as one array, bounded by a session, beside its goal and document."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    out = turns.groupBy("conv_id").agg(rows.alias("turns"))
    return out if sessions is None else out.join(sessions.select("conv_id", "goal", "document"), "conv_id", "left")


def latest_by_key(changes: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The last write of each key; max of a struct combines on the map side."""
    rest = [v for v in values if v not in order]
    top = changes.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("x"))
    return top.select(key, *[F.col(f"x.{v}").alias(v) for v in values])


def titled(changes: DataFrame, key: str, title: str) -> DataFrame:
    return changes.withColumn(title, F.coalesce(F.nullif(F.trim(title), F.lit("")), F.col(key).cast("string")))


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    return {name: df.join(gone.select(key).distinct(), key, "left_anti") for name, df in tables.items()}


def goal_status(runs: DataFrame) -> DataFrame:
    s = F.col("status")
    return runs.withColumn("goal_status", F.when(s == "purchase", "completed").when(s == "error", "failed").otherwise("active"))


def step_summary(steps: DataFrame) -> DataFrame:
    """Write steps by scope and operation: targets of the successful ones, state and title."""
    writes = steps.filter("NOT read_only")
    out = writes.groupBy("run_id", "scope", "op_type").agg(
        F.sum(F.when(F.col("status") == "succeeded", F.col("n_targets")).otherwise(0)).alias("n_targets"), F.count("*").alias("n_steps"), F.max((F.col("status") == "failed").cast("int")).alias("bad"),
    )
    title = F.concat(F.coalesce(tx.scope_label("scope"), F.col("scope")), tx.operation_label("op_type"))
    return out.withColumn("state", F.when(F.col("bad") == 1, "failed").otherwise("completed")).withColumn("title", title).drop("bad")


def idempotent_steps(steps: DataFrame) -> DataFrame:
    """Write steps with whether a step of the same key has succeeded before."""
    before = Window.partitionBy("idempotency_key").orderBy("ts", "step_id").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.max((F.col("status") == "succeeded").cast("int")).over(before), F.lit(0))
    return steps.filter("NOT read_only").withColumn("skipped", done == 1)


def phase_groups(steps: DataFrame, size: int = PHASE_SIZE) -> DataFrame:
    """Runs of read-only steps as phases in chunks of size; each write step alone."""
    w = Window.partitionBy("run_id").orderBy("ts", "step_id")
    change = F.when(F.col("read_only") & F.coalesce(F.lag("read_only").over(w), F.lit(False)), 0).otherwise(1)
    out = steps.withColumn("change", change).withColumn("phase", F.sum("change").over(w))
    place = F.row_number().over(Window.partitionBy("run_id", "phase").orderBy("ts", "step_id")) - 1
    return out.withColumn("chunk", F.floor(place / size).cast("int")).drop("change")


def run_outcome(steps: DataFrame, dry_run: bool = False) -> DataFrame:
    """The first step that fails or needs an approval it lacks decides a run; later steps don't count."""
    risky = ~F.col("read_only") & F.col("op_type").isin(*STRUCTURAL) & ~F.col("approved")
    stop = F.when(risky, "waiting_user").when(F.col("status") == "failed", "failed")
    order = F.struct("ts", "step_id")
    first = steps.groupBy("run_id").agg(F.min(F.when(stop.isNotNull(), F.struct("ts", "step_id", stop.alias("stop")))).alias("s"))
    joined = steps.join(first, "run_id").withColumn("before", F.col("s").isNull() | (order < F.struct("s.ts", "s.step_id")))
    per = joined.groupBy("run_id").agg(F.first("s").alias("s"), F.count_if("before").alias("n_done"), F.count_if(F.col("before") & ~F.col("read_only")).alias("n_changes"))
    undo = (F.col("s.stop") == "failed") & (F.col("n_changes") > 0) & F.lit(not dry_run)
    return per.select("run_id", F.when(F.col("s").isNull(), "completed").when(undo, "rolled_back").otherwise(F.col("s.stop")).alias("outcome"), "n_done")


def retry_stats(steps: DataFrame, most: int = 3, by: tuple[str, ...] = ("op_type",)) -> DataFrame:
    """Retries used and exhausted and durations by operation, by step, or by any other columns."""
    return steps.groupBy(*by).agg(
        F.sum("retries").alias("n_retries"), F.count_if((F.col("retries") >= most) & (F.col("status") == "failed")).alias("n_exhausted"),
        F.round(F.avg("duration_ms"), 4).alias("mean_ms"), F.max("duration_ms").alias("max_ms"),
    )


def needs_confirmation(steps: DataFrame) -> DataFrame:
    return steps.filter(~F.col("read_only") & F.col("op_type").isin(*STRUCTURAL))


def change_summary(steps: DataFrame) -> DataFrame:
    """Text digest per run: committed or rolled back, the number of changes, a line for each."""
    writes = steps.filter("NOT read_only")
    rows = F.array_sort(F.collect_list(F.struct("ts", "step_id", "op_type", "n_targets")))
    per = writes.groupBy("run_id").agg(rows.alias("rows"), F.max((F.col("status") == "failed").cast("int")).alias("bad"))
    line = lambda x: F.concat(F.lit("- "), x["step_id"].cast("string"), F.lit(": "), x["op_type"], F.lit(" x"), x["n_targets"].cast("string"))
    head = F.concat(F.lit("ChangeSet("), F.col("run_id").cast("string"), F.lit(") "), F.when(F.col("bad") == 1, "rolled back").otherwise("committed"), F.lit(", total="), F.size("rows").cast("string"), F.lit("\n"))
    return per.select("run_id", F.concat(head, F.array_join(F.transform("rows", line), "\n")).alias("summary"))


def log_digest(lines: DataFrame, last: int = 6, width: int = 160, most: int = 1000, phase: str = "k") -> DataFrame:
    """The last lines of each run, JSON objects as key=value in their own order, others cut; and the last value of the phase key."""
    keys, k = F.json_object_keys("line"), F.get_json_object("line", f"$.{phase}")
    pairs = F.array_join(F.transform(keys, lambda x: F.concat(x, F.lit("="), F.coalesce(F.element_at(F.from_json("line", "map<string,string>"), x), F.lit("null")))), " ")
    order = Window.partitionBy("run_id").orderBy(F.desc("ts"), F.desc("event_id"))
    shown = F.when(F.size(keys) > 0, pairs).otherwise(F.substring("line", 1, width))
    top = lines.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= last).withColumn("shown", shown).withColumn("k", k)
    rows = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "shown")))
    return top.groupBy("run_id").agg(F.substring(F.array_join(F.transform(rows, lambda x: x["shown"]), " | "), 1, most).alias("digest"), F.min_by("k", F.when(F.col("k").isNotNull(), F.col("n"))).alias("phase"))


MODES = ("chat", "inspect", "execute")


def normalize_decisions(raw: DataFrame) -> DataFrame:
    """Mode decisions from JSON text: either key spelling, defaults, and the first rule that fails. raw: id, json."""
    pick = lambda *names: F.coalesce(*[F.get_json_object("json", f"$.{n}") for n in names])
    mode, goal = F.lower(tx.strip(pick("mode"))), F.coalesce(tx.strip(pick("goal")), F.lit(""))
    given_doc, given_ask = pick("requiresDocument", "requires_document"), pick("needsClarification", "needs_clarification")
    reason = F.coalesce(tx.strip(pick("clarificationReason", "clarification_reason")), F.lit(""))
    doc = F.coalesce(tx.loose_boolean(given_doc), mode != "chat")
    ask = F.coalesce(tx.loose_boolean(given_ask), F.length(reason) > 0)
    error = (
        F.when(~F.coalesce(mode.isin(*MODES), F.lit(False)), "mode").when(goal == "", "goal")
        .when(given_doc.isNotNull() & tx.loose_boolean(given_doc).isNull(), "requiresDocument").when(given_ask.isNotNull() & tx.loose_boolean(given_ask).isNull(), "needsClarification")
        .when(ask & (mode != "chat"), "clarification_mode").when(ask & (reason == ""), "clarification_reason").when(~ask & (reason != ""), "clarification_unexpected")
    )
    return raw.select("id", mode.alias("mode"), goal.alias("goal"), doc.alias("requires_document"), ask.alias("needs_clarification"), error.alias("error"))


def stage_errors(steps: DataFrame) -> DataFrame:
    bad = steps.filter("status = 'failed'")
    return bad.groupBy(F.col("scope").alias("stage"), F.col("op_type").alias("code")).agg(F.count("*").alias("n"))
