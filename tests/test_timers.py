"""Streams with timers: cut into batches, restarted, late rows, forgotten keys."""

import os
from datetime import datetime, timedelta, timezone

import pytest

from tabulark.session import work_folder
from pyspark.sql import functions as F

from tabulark.streaming import event_log, states, timers, worker

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "key long, ts timestamp, event_id long, kind string"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def wrote(spark, folder, rows, n):
    spark.createDataFrame([(k, at(t), i, kind) for k, t, i, kind in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    files = [f"{folder}/{f}" for f in os.listdir(folder) if f.endswith(".parquet") and not f.startswith("slice")]
    os.rename(files[0], f"{folder}/slice{n}.parquet")
    os.utime(f"{folder}/slice{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))


def run(spark, folder, out, machine, delay="0 seconds", keep_days=90):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder, pathGlobFilter="slice*")
    with timers.rocksdb(spark):
        rows = states.run_available(timers.watched(stream, machine, delay, keep_days), "timers-test", "append", folder=out)
    return sorted((r.key, round((r.at.replace(tzinfo=timezone.utc) - T0).total_seconds()), r.event_id, r.what, r.n) for r in rows.collect())


RETRY = [(1, 0, 1, "pick"), (1, 5, 2, "fail"), (2, 6, 3, "pick"), (2, 7, 4, "success"), (1, 100, 5, "pick"), (1, 101, 6, "fail"), (1, 130, 7, "pick"), (1, 131, 8, "fail"), (3, 140, 9, "pick"), (3, 150, 10, "fail"), (3, 210, 11, "noise"), (9, 500, 12, "pick"), (9, 501, 13, "success")]
WANT = [(1, 65, 2, "due", 1), (1, 131, 8, "failed", 3), (2, 7, 4, "succeeded", 1), (3, 210, 10, "due", 1), (9, 501, 13, "succeeded", 1)]


@pytest.mark.parametrize("cuts", [[], [4, 9]])
def test_batches_and_restarts_do_not_matter(spark, tmp_path, cuts):
    folder, out = str(tmp_path), work_folder(spark, "timers-out")
    edges = [0, *cuts, len(RETRY)]
    for n, (a, b) in enumerate(zip(edges, edges[1:])):
        wrote(spark, folder, RETRY[a:b][::-1], n)  # any order inside a batch
        got = run(spark, folder, out, timers.Retry())  # started anew each time, from the checkpoint
    assert got == WANT


def test_late_rows_are_dropped_and_others_wait(spark, tmp_path):
    folder, out = str(tmp_path), work_folder(spark, "timers-out")
    wrote(spark, folder, [(1, 0, 1, "bad"), (2, 50, 2, "ok")], 0)
    wrote(spark, folder, [(1, 45, 3, "bad"), (2, 90, 4, "ok")], 1)  # within the delay of 20 seconds
    wrote(spark, folder, [(1, 20, 5, "ok"), (2, 900, 6, "ok")], 2)  # too late: would have parted the two
    wrote(spark, folder, [(2, 1000, 7, "ok")], 3)
    assert run(spark, folder, out, timers.Breaker("bad", 2, 300_000), "20 seconds") == [(1, 45, 3, "open", 2), (1, 345, 3, "closed", 0)]


def test_stale_once_and_active_keys_exempt(spark, tmp_path):
    folder, out = str(tmp_path), work_folder(spark, "timers-out")
    wrote(spark, folder, [(1, 0, 1, "running"), (2, 0, 2, "running"), (3, 0, 3, "running"), (3, 900, 4, "running"), (1, 2000, 5, "running"), (1, 2001, 6, "succeeded"), (4, 5000, 7, "queued")], 0)
    assert run(spark, folder, out, timers.Stale(active=(2,))) == [(1, 900, 1, "stale", 0), (3, 1800, 4, "stale", 0)]


def test_resting_keys_are_forgotten(spark, tmp_path):
    folder, out = str(tmp_path), work_folder(spark, "timers-out")
    wrote(spark, folder, [(k, 0, k, "pick") for k in range(10)] + [(k, 1, 100 + k, "success") for k in range(9)], 0)
    wrote(spark, folder, [(50, 3 * 86_400, 200, "pick")], 1)
    wrote(spark, folder, [(50, 3 * 86_400 + 1, 201, "success")], 2)
    run(spark, folder, out, timers.Retry(), keep_days=1)
    left = spark.read.format("statestore").option("stateVarName", "machine").load(f"{out}/checkpoint")
    assert sorted(r.key.key for r in left.select("key").collect()) == [9, 50]


def test_the_log_has_no_doubles_across_restarts(spark, tmp_path):
    folder, out = str(tmp_path), work_folder(spark, "log-test")
    late = event_log.LateRows()
    spark.streams.addListener(late)

    def go():
        query = event_log.append_once(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder, pathGlobFilter="slice*"), out, delay="100 seconds")
        query.awaitTermination()
        return late.of(query)

    wrote(spark, folder, [(1, 500, 2, "b"), (1, 0, 1, "a"), (1, 500, 2, "b")], 0)
    go()
    wrote(spark, folder, [(1, 450, 3, "c"), (1, 500, 2, "b"), (1, 0, 1, "a")], 1)  # a double within the watermark, one behind it
    wrote(spark, folder, [(1, 10, 4, "d"), (1, 700, 5, "e")], 2)  # new, but too late
    n = go()
    spark.streams.removeListener(late)
    log = event_log.read_log(spark, out, SCHEMA)
    assert sorted(r.event_id for r in log.collect()) == [1, 2, 3, 5] and n == 2


TASKS = "key long, since timestamp"


def polled(spark, folder, work, batches, most=None):
    w = worker.Worker(spark, folder, spark.createDataFrame([], TASKS).schema, work, most)
    for n, keys in batches:
        w.poll(spark.createDataFrame([(k, at(k)) for k in keys], TASKS), n)
    return w


def test_a_batch_that_runs_again_claims_the_same(spark):
    folder = work_folder(spark, "worker-test")
    work = lambda rows: rows.select("key", F.lit("done").alias("what"))

    def dies(rows):
        raise RuntimeError("worker died")

    polled(spark, folder, work, [(0, [3, 1, 2, 1])], most=2)
    with pytest.raises(RuntimeError):
        polled(spark, folder, dies, [(1, [9, 8, 2])], most=2)
    # The batch runs again, with arrivals that the first run did not see; its claims stay.
    w = polled(spark, folder, work, [(1, [0]), (2, []), (3, []), (0, [77])], most=2)
    assert sorted((r.key, r.batch) for r in w.claims().collect()) == [(1, 0), (2, 0), (3, 1), (8, 1), (9, 2)]
    results = w.results(spark.createDataFrame([], "key long, what string").schema)
    assert sorted((r.key, r.batch) for r in results.collect()) == [(1, 0), (2, 0), (3, 1), (8, 1), (9, 2)]


def test_half_written_claims_are_made_anew(spark):
    folder = work_folder(spark, "worker-test")
    spark.createDataFrame([(5, at(5))], TASKS).write.parquet(f"{folder}/claims/batch=0")
    os.remove(f"{folder.removeprefix('file://')}/claims/batch=0/_SUCCESS")
    w = polled(spark, folder, lambda rows: rows.select("key"), [(0, [1])])
    assert [r.key for r in w.claims().collect()] == [1]
