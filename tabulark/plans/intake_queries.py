"""Files, objects and logs that are written out from the driver's tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulark import sinks
from tabulark.operators import counts
from tabulark.plans.proxies import read
from tabulark.session import work_folder
from tabulark.sources import docx, objects
from tabulark.streaming import event_log, worker

EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
LIST_LEVELS = [(1, 0, "decimal", "%1.", 1), (1, 1, "upperLetter", "(%1)", 3), (2, 0, "lowerRoman", "%1)", 1)]


def _docx_files(s, d):
    """A file for each document, a block for each of its lines: by place a list item, a row of a table with the first word apart, or plain."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")

    def block(text, i):
        turn = i % 6
        at = F.instr(text, " ")
        item = F.when(turn.isin(0, 1), 1).when(turn == 3, 2)
        cells = F.when(turn == 2, F.array(F.when(at > 0, F.left(text, at - 1)).otherwise(text), F.when(at > 0, F.substr(text, at + 1)).otherwise("")))
        return F.struct(text.alias("text"), item.alias("num_id"), F.when(turn == 1, 1).otherwise(0).alias("level"), cells.alias("cells"))

    levels = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("num_id", "level", "format", "template", "start"), level)]) for level in LIST_LEVELS])
    return read(s, d, "documents").select(F.format_string("%02d/%d", F.col("doc_id") % 16, F.col("doc_id")).alias("file"), F.transform(lines, block).alias("blocks"), levels.alias("numbering"))


def _docx_lines(s, d):
    folder = work_folder(s, "docx")
    docx.write_docx(_docx_files(s, d), folder)
    found = docx.document_lines(docx.read_docx(s, folder))
    return found.select(F.substring_index("file", "/", -1).cast("long").alias("doc_id"), "line_no", "line_id", "text", "block_type")


def _objects(s, d):
    """Pages put as objects and fetched again by name. Contents end in the task that fetches them: only digests meet the index, and by a
    shuffle, since sizes that Spark guesses for what Python returns would send all of it through the driver."""
    folder = work_folder(s, "objects")
    index = objects.put(read(s, d, "pages").select("page_id", "html"), "html", folder)
    got = objects.fetched(index.select("name").distinct(), folder).select("name", F.md5("content").alias("md5"), "error")
    return index.join(got.hint("merge"), "name").select("page_id", "name", "length", "md5", "error")


def _objects_listed(s, d):
    folder = work_folder(s, "objects")
    objects.put(read(s, d, "pages").select("html"), "html", folder)
    objects.put(read(s, d, "pages").where("page_id % 2 = 0").select("html"), "html", folder)  # nothing new
    digests = objects.scanned(s, folder).select("name", F.md5("content").alias("md5"))
    return objects.listed(s, folder).join(digests.hint("merge"), "name").select("name", "length", "md5")


def _slices(rows, column, n):
    """Rows with `slice`, 0 to n - 1: equal spans of a time column."""
    ends = rows.agg(F.min(column).alias("a"), F.max(column).alias("b"))
    share = (F.unix_micros(F.col(column).cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))) / (F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp")))
    return rows.crossJoin(F.broadcast(ends)).withColumn("slice", F.least(F.floor(share * n), F.lit(n - 1)).cast("int")).drop("a", "b")  # one row


def _deliveries(s, d, n=4):
    """Events span by span, each span again beside the next but one, in any order."""
    rows = _slices(read(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type"), "ts", n)
    return [rows.where(F.col("slice").isin(k, k - 2)).drop("slice").repartition("event_id").sortWithinPartitions(F.xxhash64("event_id")) for k in range(n + 2)]


def _log(s, d, delay):
    """A delivery is many files, written by all tasks. It must not be torn, so the stream is started for each, and takes it as one batch;
    batches without rows between them would move the watermark before the next delivery is there."""
    source, folder = work_folder(s, "deliveries"), work_folder(s, "log")
    late, before = event_log.LateRows(), s.conf.get(EMPTY_BATCHES)
    s.streams.addListener(late)
    s.conf.set(EMPTY_BATCHES, "false")
    try:
        for rows in _deliveries(s, d):
            rows.write.mode("append").parquet(source)
            query = event_log.append_once(s.readStream.schema(rows.schema).parquet(source), folder, delay=delay)
            query.awaitTermination()
            n_late = late.of(query)
    finally:
        s.conf.set(EMPTY_BATCHES, before)
        s.streams.removeListener(late)
    return event_log.read_log(s, folder, rows.schema), n_late


def _log_once(s, d):
    return _log(s, d, "20 days")[0].select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type")


def _log_late(s, d):
    rows, late = _log(s, d, "1 day")
    return rows.agg(F.count(F.lit(1)).alias("n_log"), F.count_distinct("event_id").alias("n_events"), F.lit(late).cast("long").alias("n_late"))


class Torn(Exception):
    """The failure that a query plays."""


def _worker(s, d):
    """Open orders as tasks that arrive in four spans. The worker dies once after it has claimed and once before, and is started again."""
    source, folder = work_folder(s, "tasks"), work_folder(s, "worker")
    tasks = read(s, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").cast("date").alias("since"), F.col("o_totalprice").alias("price"))
    spans = _slices(tasks, "since", 4)
    for k in range(4):
        spans.where(F.col("slice") == k).drop("slice").coalesce(1).write.mode("append").parquet(source)
    deaths = {1: "work", 2: "poll"}

    class Frail(worker.Worker):
        def poll(self, arrivals, number):
            if deaths.get(number) == "poll" and deaths.pop(number):
                raise Torn
            super().poll(arrivals, number)

    def work(claimed):
        if "work" in deaths.values() and worker_.claims().select("batch").distinct().count() == 2:
            del deaths[1]
            raise Torn
        return claimed.select("key", F.ceil(F.col("price") / 1000).alias("hours"))

    worker_ = Frail(s, folder, tasks.schema, work)
    for _ in range(3):
        query = worker_.start(s.readStream.schema(tasks.schema).option("maxFilesPerTrigger", 1).parquet(source))
        try:
            query.awaitTermination()
            break
        except Exception as e:  # noqa: BLE001  the played failure comes back as the stream's
            if "Torn" not in str(e):
                raise
    results = worker_.results(work(tasks.limit(0)).schema).withColumnRenamed("batch", "worked")
    return worker_.claims().select("key", F.col("batch").alias("claimed")).join(results, "key", "full")


def _rerun_part(s, d):
    """Instances by document; document 7 is run again with new prices and document 50 for the first time."""
    folder = work_folder(s, "parts")
    rows = read(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"), (F.col("l_orderkey") % 50).alias("document"))
    sinks.replace_parts(rows, folder, ["document"])
    again = rows.where("document IN (7, 8)").withColumn("price", F.lit(1.0)).withColumn("document", F.when(F.col("document") == 8, 50).otherwise(F.col("document")))
    for _ in range(2):  # a repeated rerun changes nothing
        sinks.replace_parts(again, folder, ["document"])
    return s.read.schema(rows.schema).parquet(folder)


def _sketches(s, d):
    """Users per type and day as a stored table, to which the later half of the days is added; by type within four standard errors."""
    rows, folder = read(s, d, "events").withColumn("day", F.to_date("ts")), work_folder(s, "sketches")
    for half in (0, 1):
        counts.sketched(rows.where(F.dayofmonth("day") % 2 == half), ["event_type", "day"], "user_id").write.mode("append").parquet(folder)
    stored = s.read.schema("event_type string, day date, sketch binary").parquet(folder)
    found = counts.estimated(counts.merged(stored, ["event_type"]))
    exact = rows.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    close = F.abs(F.col("estimate") - F.col("users")) <= F.greatest(F.lit(1.0), 4 * counts.RELATIVE_ERROR * F.col("users"))
    return found.join(exact, "event_type").select("event_type", "users", close.alias("close"))


QUERIES = {"w_rerun_partition": _rerun_part, "distinct_sketches": _sketches, "event_log_once": _log_once, "event_log_late": _log_late, "worker_polls": _worker, "docx_lines": _docx_lines, "objects_round_trip": _objects, "objects_listed": _objects_listed}

TRIM_SQL = r"regexp_replace({}, '^[\s\p{{Z}}\x{{0B}}\x{{85}}]+|[\s\p{{Z}}\x{{0B}}\x{{85}}]+$', '', 'g')"
ROMAN_SQL = "repeat('m', n // 1000) || ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][n // 100 % 10 + 1] || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][n // 10 % 10 + 1] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][n % 10 + 1]"

SLICE_SQL = "least(floor((epoch_us({0}::TIMESTAMP) - epoch_us((min({0}) OVER ())::TIMESTAMP)) / (epoch_us((max({0}) OVER ())::TIMESTAMP) - epoch_us((min({0}) OVER ())::TIMESTAMP)) * 4), 3)"
ORACLES = {
    "w_rerun_partition": """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 50 = 7 THEN 1.0 ELSE CAST(l_extendedprice AS DOUBLE) END AS price, l_orderkey % 50 AS document FROM lineitem
      UNION ALL SELECT l_orderkey, l_linenumber, 1.0, 50 FROM lineitem WHERE l_orderkey % 50 = 8""",
    "distinct_sketches": "SELECT event_type, count(DISTINCT user_id) AS users, true AS close FROM events GROUP BY 1",
    "event_log_once": "SELECT event_id, ts, event_type FROM events",
    # Second deliveries come when the watermark for late rows, a batch behind, stands a day before the end of their span.
    "event_log_late": f"""WITH e AS (SELECT *, {SLICE_SQL.format("ts")} AS slice FROM events), w AS (SELECT *, date_trunc('millisecond', max(ts) OVER (PARTITION BY slice)) - INTERVAL 1 DAY AS mark FROM e)
      SELECT count(*) AS n_log, count(DISTINCT event_id) AS n_events, count(*) FILTER (WHERE ts <= mark) AS n_late FROM w""",
    "worker_polls": f"SELECT o_orderkey AS key, CAST({SLICE_SQL.format('o_orderdate')} AS BIGINT) AS claimed, CAST({SLICE_SQL.format('o_orderdate')} AS BIGINT) AS worked, CAST(ceil(o_totalprice / 1000) AS BIGINT) AS hours FROM orders WHERE o_orderstatus = 'O'",
    "docx_lines": f"""
WITH raw AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
counted AS (SELECT *, (pos - 1) % 6 AS turn, row_number() OVER (PARTITION BY doc_id, (pos - 1) % 6 ORDER BY pos) AS n FROM raw),
cells AS (SELECT *, strpos(text, ' ') AS at, {TRIM_SQL.format("CASE WHEN strpos(text, ' ') > 0 THEN left(text, strpos(text, ' ') - 1) ELSE text END")} AS c1, {TRIM_SQL.format("CASE WHEN strpos(text, ' ') > 0 THEN substr(text, strpos(text, ' ') + 1) ELSE '' END")} AS c2 FROM counted),
written AS (
  SELECT doc_id, pos, CASE WHEN turn = 2 THEN 'table' ELSE 'text' END AS block_type, {TRIM_SQL.format(f"CASE turn WHEN 0 THEN n || '.' || text WHEN 1 THEN '(' || CASE WHEN n + 2 <= 26 THEN chr(CAST(64 + n + 2 AS INT)) ELSE CAST(n + 2 AS VARCHAR) END || ')' || text WHEN 3 THEN {ROMAN_SQL} || ')' || text WHEN 2 THEN array_to_string(list_filter([c1, c2], lambda c: c <> ''), ' | ') ELSE text END")} AS text FROM cells),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS line_no FROM written WHERE text <> '')
SELECT doc_id, CAST(line_no AS INT) AS line_no, 'D1L' || CASE WHEN line_no < 1000 THEN lpad(CAST(line_no AS VARCHAR), 3, '0') ELSE CAST(line_no AS VARCHAR) END AS line_id, text, block_type FROM kept""",
    "objects_listed": "SELECT DISTINCT sha256(html) AS name, CAST(strlen(html) AS BIGINT) AS length, md5(html) AS md5 FROM pages WHERE html <> ''",
    "objects_round_trip": "SELECT page_id, sha256(html) AS name, CAST(strlen(html) AS BIGINT) AS length, md5(html) AS md5, CAST(NULL AS VARCHAR) AS error FROM pages WHERE html IS NOT NULL",
}
