"""Queue and worker state machines: batch reductions of event logs, and their streaming twins.

Events: (key, ts, event_id, kind). Batch functions reduce a bounded log; stream functions take an unbounded one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from tabulark.session import shared_folder


def latest_state(events: DataFrame) -> DataFrame:
    """key, state: the kind of the latest event."""
    return events.groupBy("key").agg(F.max_by("kind", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("since"))


def retry_step(state: Column, kind: Column, max_retries: int) -> Column:
    """struct(status, count) after one event: pick counts before the attempt, a failure is final once the count
    reaches the maximum, a reset starts anew."""
    count = state["count"]
    pick = (kind == "pick") & (state["status"] == "pending") & (count < max_retries)
    fail = (kind == "fail") & (state["status"] == "retrying")
    status = F.when(kind == "reset", "pending").when(pick, "retrying").when((kind == "success") & (state["status"] == "retrying"), "succeeded")
    status = status.when(fail & (count >= max_retries), "failed").when(fail, "pending").otherwise(state["status"])
    return F.struct(status.alias("status"), F.when(kind == "reset", 0).when(pick, count + 1).otherwise(count).cast("int").alias("count"))


def retry_states(events: DataFrame, max_retries: int = 3) -> DataFrame:
    """key, status, count: the retry machine folded over each key's ordered events."""
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "kind")))
    start = F.struct(F.lit("pending").alias("status"), F.lit(0).alias("count"))
    folded = F.aggregate(ordered, start, lambda s, e: retry_step(s, e["kind"], max_retries))
    return events.groupBy("key").agg(folded.alias("s")).select("key", "s.status", "s.count")


def stale_running(events: DataFrame, now: Column, idle_seconds: int = 900, active: list[int] = ()) -> DataFrame:
    """Keys whose latest state is running and older than the idle time, active ones exempt."""
    late = latest_state(events).where((F.col("state") == "running") & (F.col("since") < now - F.make_interval(secs=F.lit(idle_seconds))))
    return late.where(~F.col("key").isin(*active)) if active else late


def consecutive(events: DataFrame, bad: str) -> DataFrame:
    """key, longest: the longest run of `bad` events of each key."""
    order = Window.partitionBy("key").orderBy("ts", "event_id")
    runs = events.withColumn("_bad", F.col("kind") == bad).withColumn("_g", F.sum(F.when(F.col("kind") == bad, 0).otherwise(1)).over(order))
    return runs.where("_bad").groupBy("key", "_g").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max("n").alias("longest"))


def breaker_openings(events: DataFrame, bad: str, limit: int = 2) -> DataFrame:
    """key, ts at which a circuit breaker opens: the `limit`-th bad event in a row."""
    order = Window.partitionBy("key").orderBy("ts", "event_id")
    runs = events.withColumn("_g", F.sum(F.when(F.col("kind") == bad, 0).otherwise(1)).over(order)).where(F.col("kind") == bad)
    return runs.withColumn("_n", F.row_number().over(Window.partitionBy("key", "_g").orderBy("ts", "event_id"))).where(F.col("_n") == limit).select("key", "ts", "event_id")


def pick_next(events: DataFrame, state: str, k: int = 5, newest: bool = False) -> DataFrame:
    """The k keys in `state` that have waited longest, or came last."""
    rows = latest_state(events).where(F.col("state") == state)
    return rows.orderBy(F.desc("since") if newest else F.asc("since"), "key").limit(k).select("key", "since")


def breaker_states(events: DataFrame, bad: str, limit: int = 2, open_seconds: int = 300) -> DataFrame:
    """key, ts, event_id, open: whether the breaker is open when an event arrives: within `open_seconds` after the latest
    opening before it."""
    opened = breaker_openings(events, bad, limit).withColumn("_opens", F.lit(True))
    rows = events.join(opened, ["key", "ts", "event_id"], "left")
    before = Window.partitionBy("key").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("_opens"), F.col("ts"))).over(before)
    return rows.select("key", "ts", "event_id", F.coalesce(F.col("ts") < last + F.make_interval(secs=F.lit(open_seconds)), F.lit(False)).alias("open"))


#: The transitions of a task.
TASK_STEPS = {"queued": ["running", "failed"], "running": ["succeeded", "failed"], "failed": ["queued"], "succeeded": []}


def task_transitions(events: DataFrame) -> DataFrame:
    """key, event_id, before, kind, allowed: every event of a task's log against the state before it. The first event
    must be queued; a retry sends a failed task back to the queue."""
    order = Window.partitionBy("key").orderBy("ts", "event_id")
    before = F.lag("kind").over(order)
    allowed = F.when(F.col("before").isNull(), F.col("kind") == "queued")
    for state, after in TASK_STEPS.items():
        allowed = allowed.when(F.col("before") == state, F.col("kind").isin(*after) if after else F.lit(False))
    return events.withColumn("before", before).select("key", "event_id", "before", "kind", F.coalesce(allowed, F.lit(False)).alias("allowed"))


def by_priority(tasks: DataFrame, k: int = 5) -> DataFrame:
    """The k queued tasks (key, priority, since) that run next: highest priority, then longest waiting."""
    return tasks.orderBy(F.desc("priority"), "since", "key").limit(k)


def first_success(attempts: DataFrame) -> DataFrame:
    """key, provider, result of the first provider in order that has a result."""
    ok = attempts.where("result is not null")
    return ok.groupBy("key").agg(F.min_by(F.struct("provider", "result"), "rank").alias("r")).select("key", "r.provider", "r.result")


def selected_stages(log: DataFrame) -> DataFrame:
    """`log` (key, stage, attempt, seconds) with selected: the last attempt of each stage is the one that counts."""
    last = F.max("attempt").over(Window.partitionBy("key", "stage"))
    return log.withColumn("selected", F.col("attempt") == last)


def stage_durations(log: DataFrame) -> DataFrame:
    """stage, n, mean and median of seconds."""
    return log.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("seconds"), 6).alias("mean"), F.round(F.percentile("seconds", F.lit(0.5)), 6).alias("median"))


# --- streaming -----------------------------------------------------------------------------------------------


def stream_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """start, kind, n per event-time window; rows later than the watermark are dropped."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.withWatermark("ts", delay).groupBy(span.alias("w"), "kind").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def stream_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """key, start, end, n per session."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "key").agg(F.count(F.lit(1)).alias("n")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_retries(events: DataFrame, max_retries: int = 3) -> DataFrame:
    """The retry machine as a stateful operator: (key, status, count) after every batch of a key's events."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, count = state.get if state.exists else ("pending", 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for kind in rows["kind"]:
            if kind == "reset":
                status, count = "pending", 0
            elif kind == "pick" and status == "pending" and count < max_retries:
                status, count = "retrying", count + 1
            elif kind == "success" and status == "retrying":
                status = "succeeded"
            elif kind == "fail" and status == "retrying":
                status = "failed" if count >= max_retries else "pending"
        state.update((status, count))
        yield pd.DataFrame({"key": [key[0]], "status": [status], "count": [count]})

    return events.groupBy("key").applyInPandasWithState(step, "key long, status string, count int", "status string, count int", "update", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, name: str, mode: str, keys: list[str] | None = None, folder: str | None = None) -> DataFrame:
    """Run a stream over all that is available and return its result table. Each batch is written to a folder of its
    number, so a batch that runs again replaces itself, and the checkpoint beside them lets a later run go on where
    this one ended; a `folder` of one's own keeps both. In complete mode the last batch is the table; otherwise all
    batches are, with `keys` the latest row of each key."""
    spark, schema = stream.sparkSession, stream.schema
    root = folder or f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{root}/out/part={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    if not query.lastProgress:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("_batch", T.LongType())])).parquet(f"{root}/out/part=*")
    if mode == "complete":
        return rows.join(F.broadcast(rows.agg(F.max("_batch").alias("_batch"))), "_batch").select(*schema.names)  # one row
    if keys:
        rest = [c for c in schema.names if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, "_r.*").select(*schema.names)
    return rows.select(*schema.names)
