"""Queue, practice and streaming queries on `events` and the practice proxies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulark.operators import practice, vector_index
from tabulark.plans.proxies import read
from tabulark.streaming import states, timers

STATE = {"view": "queued", "click": "running", "purchase": "succeeded", "error": "failed", "signup": "running"}
STATE_SQL = "CASE event_type WHEN 'view' THEN 'queued' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'running' END"
RETRY = {"view": "pick", "click": "pick", "purchase": "success", "error": "fail", "signup": "reset"}


def _kind(table):
    out = F.col("event_type")
    for k, v in table.items():
        out = F.when(F.col("event_type") == k, v).otherwise(out)
    return out


def events(s, d, table=STATE):
    return read(s, d, "events").select(F.col("user_id").alias("key"), "ts", "event_id", _kind(table).alias("kind"))


def _attempts(s, d):
    return read(s, d, "events").select((F.col("event_id") % 800).alias("key"), F.col("event_type").alias("provider"), F.col("event_id").alias("rank"), F.when(F.col("value") > 20, F.col("event_id")).alias("result"))


def answers(s, d):
    rows = read(s, d, "events")
    return rows.select(F.col("user_id").alias("student"), F.col("event_type").alias("node"), "ts", F.col("event_id").alias("answer_id"), (F.col("value") < 60).alias("is_correct"), (F.col("event_id") % 500).alias("question_id"))


ANSWERS_SQL = "answers AS (SELECT user_id AS student, event_type AS node, ts, event_id AS answer_id, value < 60 AS is_correct, event_id % 500 AS question_id FROM events)"


def _stream(s, d, make, name, mode, keys=None):
    source = s.readStream.schema(read(s, d, "events").schema).parquet(d, pathGlobFilter="events.parquet")
    return states.run_available(make(source.withColumn("ts", F.col("ts").cast("timestamp"))), name, mode, keys)


def _tumbling(s, d):
    make = lambda e: states.stream_counts(e.select("ts", F.col("event_type").alias("kind")), "1 hour", None, "0 seconds")
    return _stream(s, d, make, "tumbling_counts_out", "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "kind", "n")


def _timed(machine, table=STATE):
    """A machine's reports on `events`, as a stream with timers."""

    def run(s, d):
        make = lambda e: timers.watched(e.select(F.col("user_id").alias("key"), "ts", "event_id", _kind(table).alias("kind")), machine)
        with timers.rocksdb(s):
            found = _stream(s, d, make, "timed_out", "append")
        return found.withColumn("at", F.col("at").cast("timestamp_ntz"))

    return run


def _similar(s, d):
    rows = read(s, d, "embeddings")
    return practice.similar(rows.where("vec_id % 20 = 0"), rows, 5)


def _indexed(s, d):
    rows = read(s, d, "embeddings")
    return vector_index.search(rows.where("vec_id % 20 = 0"), rows, vector_index.fit(rows))


def _recall(s, d):
    """Whether the index finds nine of ten exact neighbours of the stated queries, and how many there are."""
    found = vector_index.recall(_indexed(s, d), _similar(s, d))
    return found.select("n_true", (F.col("n_found") >= 0.9 * F.col("n_true")).alias("enough"))


QUERIES = {
    "vector_index": _indexed,
    "vector_recall": _recall,
    "task_latest_state": lambda s, d: states.latest_state(events(s, d)).select("key", "state"),
    "retry_state": lambda s, d: states.retry_states(events(s, d, RETRY)),
    "stale_running": lambda s, d: states.stale_running(events(s, d), F.lit("2024-01-31").cast("timestamp"), 900, [3]).select("key"),
    "consecutive_failures": lambda s, d: states.consecutive(events(s, d), "failed"),
    "breaker_openings": lambda s, d: states.breaker_openings(events(s, d), "failed").select("key", "event_id"),
    "pick_next_fifo": lambda s, d: states.pick_next(events(s, d), "queued").select("key"),
    "pick_next_lifo": lambda s, d: states.pick_next(events(s, d), "queued", 1, True).select("key"),
    "first_success": lambda s, d: states.first_success(_attempts(s, d)),
    "stage_durations": lambda s, d: states.stage_durations(read(s, d, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("seconds"))),
    "wrong_stats": lambda s, d: practice.wrong_counts(answers(s, d), "question_id"),
    "weak_points": lambda s, d: practice.weak_points(answers(s, d)),
    "mastery_recent": lambda s, d: practice.mastery(answers(s, d)),
    "kp_share": lambda s, d: practice.shares(read(s, d, "events"), "event_type"),
    "generation_ratio": lambda s, d: practice.shares(read(s, d, "part"), "p_type", "p_brand"),
    "cosine_topk": _similar,
    "stream_stale": _timed(timers.Stale(active=(3,))),
    "stream_breaker": _timed(timers.Breaker("failed", open_for=2 * 86_400_000)),
    "stream_retry_due": _timed(timers.Retry(delay=6 * 3_600_000), RETRY),
    # Extensions beyond the reference: event-time windows, run as streams over what is available.
    "tumbling_counts": _tumbling,
    "session_windows": lambda s, d: _stream(s, d, lambda e: states.stream_sessions(e.select("ts", F.col("user_id").alias("key")), "6 hours", "0 seconds"), "session_windows_out", "complete").select("key", "n"),
    "stream_retry_state": lambda s, d: _stream(s, d, lambda e: states.stream_retries(e.select(F.col("user_id").alias("key"), "ts", "event_id", _kind(RETRY).alias("kind"))), "stream_retry_out", "update", ["key"]),
}

E = f"e AS (SELECT user_id AS key, ts, event_id, {STATE_SQL} AS kind FROM events), latest AS (SELECT key, arg_max(kind, (ts, event_id)) AS state, max(ts) AS since FROM e GROUP BY key)"
# The retry machine as a recursive walk over each key's numbered events.
RETRY_SQL = """WITH RECURSIVE e AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
    CASE event_type WHEN 'view' THEN 'pick' WHEN 'click' THEN 'pick' WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'fail' ELSE 'reset' END AS kind FROM events),
  walk AS (SELECT DISTINCT key, 0::BIGINT AS rn, 'pending' AS status, 0 AS count FROM e UNION ALL
    SELECT w.key, e.rn, CASE WHEN kind = 'reset' THEN 'pending' WHEN kind = 'pick' AND status = 'pending' AND count < 3 THEN 'retrying' WHEN kind = 'success' AND status = 'retrying' THEN 'succeeded'
        WHEN kind = 'fail' AND status = 'retrying' AND count >= 3 THEN 'failed' WHEN kind = 'fail' AND status = 'retrying' THEN 'pending' ELSE status END,
      CASE WHEN kind = 'reset' THEN 0 WHEN kind = 'pick' AND status = 'pending' AND count < 3 THEN count + 1 ELSE count END FROM walk w JOIN e ON e.key = w.key AND e.rn = w.rn + 1)
  SELECT key, arg_max(status, rn) AS status, arg_max(count, rn) AS count FROM walk GROUP BY key"""
RUNS = E + ", r AS (SELECT *, sum(CASE WHEN kind = 'failed' THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY ts, event_id) AS g FROM e)"
#: Events by the millisecond, as streams with timers see them, with the time up to which they come.
T = f"t AS (SELECT user_id AS key, date_trunc('millisecond', ts) AS ts, event_id, {STATE_SQL} AS kind, max(date_trunc('millisecond', ts)) OVER () AS last FROM events)"
TIMED_WALK_SQL = RETRY_SQL[: RETRY_SQL.index("walk AS")].replace("ORDER BY ts, event_id) AS rn,", "ORDER BY date_trunc('millisecond', ts), event_id) AS rn, date_trunc('millisecond', ts) AS ts, event_id, max(date_trunc('millisecond', ts)) OVER () AS last,") + """walk AS (
    SELECT DISTINCT key, 0::BIGINT AS rn, NULL::TIMESTAMP AS ts, NULL::BIGINT AS event_id, NULL::VARCHAR AS was, 'pending' AS status, 0 AS count, NULL::TIMESTAMP AS since, NULL::BIGINT AS of FROM e UNION ALL
    SELECT w.key, e.rn, e.ts, e.event_id, status, CASE WHEN kind = 'reset' THEN 'pending' WHEN kind = 'pick' AND status = 'pending' AND count < 3 THEN 'retrying' WHEN kind = 'success' AND status = 'retrying' THEN 'succeeded'
        WHEN kind = 'fail' AND status = 'retrying' AND count >= 3 THEN 'failed' WHEN kind = 'fail' AND status = 'retrying' THEN 'pending' ELSE status END,
      CASE WHEN kind = 'reset' THEN 0 WHEN kind = 'pick' AND status = 'pending' AND count < 3 THEN count + 1 ELSE count END,
      CASE WHEN kind = 'reset' OR kind = 'pick' AND status = 'pending' AND count < 3 THEN NULL WHEN kind = 'fail' AND status = 'retrying' AND count < 3 THEN e.ts ELSE since END,
      CASE WHEN kind = 'fail' AND status = 'retrying' AND count < 3 THEN e.event_id ELSE of END FROM walk w JOIN e ON e.key = w.key AND e.rn = w.rn + 1),
  steps AS (SELECT w.*, n.ts AS next, (SELECT max(last) FROM e) AS last FROM walk w LEFT JOIN e n ON n.key = w.key AND n.rn = w.rn + 1 WHERE w.rn > 0)
  SELECT key, ts AS at, event_id, status AS what, count AS n FROM steps WHERE was = 'retrying' AND status IN ('succeeded', 'failed')
  UNION ALL SELECT key, since + INTERVAL 6 HOUR, of, 'due', count FROM steps WHERE since + INTERVAL 6 HOUR >= ts AND since + INTERVAL 6 HOUR < coalesce(next, last)"""
ORACLES = {
    "stream_stale": f"WITH {T}, n AS (SELECT *, lead(ts) OVER (PARTITION BY key ORDER BY ts, event_id) AS next FROM t) SELECT key, ts + INTERVAL 900 SECOND AS at, event_id, 'stale' AS what, 0 AS n FROM n WHERE kind = 'running' AND key <> 3 AND (next IS NULL OR next > ts + INTERVAL 900 SECOND) AND ts + INTERVAL 900 SECOND < last",
    "stream_breaker": f"""WITH {T}, r AS (SELECT *, sum(CASE WHEN kind = 'failed' THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY ts, event_id) AS g FROM t), o AS (SELECT key, ts, event_id, last FROM r WHERE kind = 'failed' QUALIFY row_number() OVER (PARTITION BY key, g ORDER BY ts, event_id) = 2),
      n AS (SELECT *, lead(ts) OVER (PARTITION BY key ORDER BY ts, event_id) AS next FROM o) SELECT key, ts AS at, event_id, 'open' AS what, 2 AS n FROM o UNION ALL SELECT key, ts + INTERVAL 2 DAY, event_id, 'closed', 0 FROM n WHERE (next IS NULL OR next > ts + INTERVAL 2 DAY) AND ts + INTERVAL 2 DAY < last""",
    "stream_retry_due": TIMED_WALK_SQL,
    "vector_recall": "SELECT CAST(count(*) * least(5, (SELECT count(*) FROM embeddings) - 1) AS BIGINT) AS n_true, true AS enough FROM embeddings WHERE vec_id % 20 = 0",
    "task_latest_state": f"WITH {E} SELECT key, state FROM latest",
    "retry_state": RETRY_SQL,
    "stream_retry_state": RETRY_SQL,
    "stale_running": f"WITH {E} SELECT key FROM latest WHERE state = 'running' AND since < TIMESTAMP '2024-01-31' - INTERVAL 900 SECOND AND key <> 3",
    "consecutive_failures": f"WITH {RUNS} SELECT key, max(n) AS longest FROM (SELECT key, g, count(*) AS n FROM r WHERE kind = 'failed' GROUP BY key, g) GROUP BY key",
    "breaker_openings": f"WITH {RUNS} SELECT key, event_id FROM r WHERE kind = 'failed' QUALIFY row_number() OVER (PARTITION BY key, g ORDER BY ts, event_id) = 2",
    "pick_next_fifo": f"WITH {E} SELECT key FROM latest WHERE state = 'queued' ORDER BY since, key LIMIT 5",
    "pick_next_lifo": f"WITH {E} SELECT key FROM latest WHERE state = 'queued' ORDER BY since DESC, key LIMIT 1",
    "first_success": "SELECT event_id % 800 AS key, arg_min(event_type, event_id) AS provider, min(event_id) AS result FROM events WHERE value > 20 GROUP BY 1",
    "stage_durations": "SELECT event_type AS stage, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY 1",
    "wrong_stats": f"WITH {ANSWERS_SQL} SELECT question_id, count(*) AS wrong, count(DISTINCT student) AS students FROM answers WHERE NOT is_correct GROUP BY 1",
    "weak_points": f"WITH {ANSWERS_SQL} SELECT student, node, count(*) AS attempts, round(avg(CAST(is_correct AS INT)), 6) AS rate FROM answers GROUP BY 1, 2 HAVING count(*) >= 5",
    "mastery_recent": f"""WITH {ANSWERS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY student, node ORDER BY ts DESC, answer_id DESC) AS rn FROM answers)
      SELECT student, node, count(*) AS attempts, CAST(sum(CAST(is_correct AS INT)) AS BIGINT) AS correct, round(avg(CASE WHEN rn <= 5 THEN CAST(is_correct AS INT) END), 6) AS recent_rate FROM n GROUP BY 1, 2""",
    "kp_share": "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1",
    "generation_ratio": "SELECT p_brand, p_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY p_brand), 6) AS share FROM part GROUP BY 1, 2",
    "cosine_topk": """WITH p AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
      SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p QUALIFY rank <= 5""",
    "tumbling_counts": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2",
    "session_windows": """WITH g AS (SELECT user_id AS key, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
      s AS (SELECT key, sum(fresh) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT key, count(*) AS n FROM s GROUP BY key, session""",
}
