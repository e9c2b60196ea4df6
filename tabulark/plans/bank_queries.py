"""Question-bank queries on the proxy star."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulark.operators import bank
from tabulark.operators.bank import Filters
from tabulark.plans.proxies import STAR_SQL, read, star

APPROVED = Filters(status="approved")
NARROW = Filters(status="approved", start_year=1996, end_year=1999)
W = f"WITH {STAR_SQL}"
BASE = W + ", base AS (SELECT * FROM questions WHERE status = 'approved')"
NARROW_BASE = BASE.replace("'approved')", "'approved' AND id IN (SELECT question_id FROM instances WHERE year BETWEEN 1996 AND 1999))")
COLS = "id, subject, grade, qtype, difficulty, score, status, stem, created"


def q(f):
    return lambda spark, sf_dir: f(star(spark, sf_dir))


def _candidates(spark, sf_dir):
    size = F.col("p_size")
    return read(spark, sf_dir, "part").select(F.when(size % 3 == 0, "reject").when(size % 3 == 1, "review").otherwise("approve").alias("decision"))


def _latest(spark, sf_dir):
    latest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = read(spark, sf_dir, "events").withColumn("rn", F.row_number().over(latest)).where("rn = 1")
    return rows.select("user_id", "event_id", "event_type")


def _range(spark, sf_dir):
    rows = star(spark, sf_dir).instances.where(bank.year_range(F.col("year"), 1997, 1998))
    return rows.groupBy("school").agg(F.count(F.lit(1)).alias("n"))


def _lookup(spark, sf_dir):
    s = star(spark, sf_dir)
    wanted = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("document_id"), F.lit(1).alias("number"))
    return bank.lookup_questions(s, wanted).select("document_id", "number", "question_id")


def _status(spark, sf_dir):
    tasks = read(spark, sf_dir, "events").select((F.col("event_id") % 3000).alias("document_id"), F.col("event_id").alias("task_id"), F.col("event_type").alias("status"), F.col("ts").alias("created"))
    documents = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderstatus").alias("status"))
    return bank.document_status(documents, tasks).groupBy("shown").agg(F.count(F.lit(1)).alias("n"))


def _dimension(spark, sf_dir):
    dim = read(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("code").cast("string"))
    rows = read(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("REGION_"), F.col("n_nationkey") % 7).alias("name"))
    return bank.with_dimension(rows, dim, "name", {"REGION_5": "REGION_0"}, "unknown").select("n_nationkey", "name", "code")


def _detail(spark, sf_dir):
    s = star(spark, sf_dir)
    counts = bank.occurrence_count(s).withColumnRenamed("question_id", "id")
    return s.questions.where("id = 42").join(counts, "id", "left").select("id", "stem", F.coalesce("n", F.lit(0)).alias("occurrences"))


QUERIES = {
    "s01_list_page": lambda spark, d: read(spark, d, "customer").orderBy("c_custkey").offset(40).limit(20).select("c_custkey", "c_name"),
    "s02_point_lookup": lambda spark, d: read(spark, d, "customer").where("c_custkey = 77").select("c_custkey", "c_name", "c_mktsegment"),
    "s03_table_count": lambda spark, d: read(spark, d, "orders").agg(F.count(F.lit(1)).alias("n")),
    "stats_total": q(lambda s: bank.total(s, NARROW)),
    "stats_type_dist": q(lambda s: bank.type_distribution(s, NARROW)),
    "stats_difficulty_dist": q(lambda s: bank.difficulty_distribution(s, NARROW)),
    "stats_year_trend": q(lambda s: bank.year_trend(s, NARROW)),
    "kp_top50": q(lambda s: bank.node_top(s, APPROVED)),
    "kp_year_trend": q(lambda s: bank.node_year_trend(s, NARROW)),
    "catalog": q(bank.catalog),
    "catalog_rollup": q(bank.catalog_rollup),
    "catalog_tree": q(lambda s: bank.catalog_tree(s).select("subject", "total", F.size("grades").cast("long").alias("n_grades"))),
    "search_page": q(lambda s: bank.search(s, APPROVED, 3, 20).select(*COLS.split(", "))),
    "search_total": q(lambda s: bank.search_total(s, Filters(status="approved", difficulty=3))),
    "search_instance_filter": q(lambda s: bank.base(s, Filters(status="approved", year=1997, school=3)).select("id", "subject")),
    "search_instance_distinct": q(lambda s: bank.base_by_distinct(s, Filters(status="approved", year=1997, school=3)).select("id", "subject")),
    "search_kp_ilike": q(lambda s: bank.base(s, Filters(node="nation_1")).select("id", "subject")),
    "search_term_wildcard": q(lambda s: bank.base(s, Filters(term="S_all")).select("id", "stem")),
    "search_term_literal": q(lambda s: bank.base(s, Filters(term="Small", wildcards=False)).select("id", "stem")),
    "search_confidence": q(lambda s: bank.base(s, Filters(confidence=0.7)).select("id", F.col("confidence").cast("double").alias("confidence"))),
    "occurrence_count": q(bank.occurrence_count),
    "gate_metrics": lambda spark, d: bank.gate_metrics(star(spark, d).questions, _candidates(spark, d)),
    "latest_per_key": _latest,
    "range_filter": _range,
    "or_filter": lambda spark, d: read(spark, d, "nation").where((F.col("n_name") == "NATION_3") | (F.col("n_regionkey") == 1)).select("n_nationkey", "n_name"),
    "status_macro": lambda spark, d: read(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "P") | (F.col("o_orderpriority") == "1-URGENT")).agg(F.count(F.lit(1)).alias("n")),
    "json_path_filter": lambda spark, d: read(spark, d, "events").where(F.get_json_object("props", "$.k") == "42").select("event_id", "user_id"),
    "column_predicate": lambda spark, d: read(spark, d, "lineitem").where(F.col("l_discount") < F.col("l_tax")).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")),
    "stale_predicate": lambda spark, d: read(spark, d, "events").where((F.col("ts") < F.lit("2024-01-03").cast("timestamp")) & (F.col("event_id") != 5)).agg(F.count(F.lit(1)).alias("n")),
    "lookup_join": _lookup,
    "orphan_questions": q(lambda s: bank.without_instances(bank.Star(s.questions, s.instances.where("year = 1995 and school < 20"), s.mappings)).select("id")),
    "document_status": _status,
    "dimension_unknown": _dimension,
    "question_detail": _detail,
    "stem_preview": q(lambda s: s.questions.select("id", F.substring("stem", 1, 5).alias("preview"))),
    "share_by_kp": q(lambda s: bank.node_year_trend(s, APPROVED).groupBy("node").agg(F.sum("n").alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))),
}

TREND = "SELECT year, count(DISTINCT question_id) AS n FROM instances WHERE year BETWEEN 1996 AND 1999 AND question_id IN (SELECT id FROM base) GROUP BY year"
ORACLES = {
    "s01_list_page": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 40",
    "s02_point_lookup": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 77",
    "s03_table_count": "SELECT count(*) AS n FROM orders",
    "stats_total": NARROW_BASE + " SELECT count(DISTINCT id) AS total FROM base",
    "stats_type_dist": NARROW_BASE + " SELECT qtype, count(DISTINCT id) AS n FROM base GROUP BY qtype",
    "stats_difficulty_dist": NARROW_BASE + " SELECT CAST(difficulty AS VARCHAR) AS difficulty, count(DISTINCT id) AS n FROM base GROUP BY 1",
    "stats_year_trend": NARROW_BASE + TREND.join([" ", ""]),
    "kp_top50": BASE + " SELECT node, count(DISTINCT question_id) AS n FROM mappings WHERE question_id IN (SELECT id FROM base) GROUP BY node ORDER BY n DESC, node LIMIT 50",
    "kp_year_trend": NARROW_BASE + " SELECT node, year, count(*) AS n FROM mappings JOIN instances USING (question_id) WHERE question_id IN (SELECT id FROM base) AND year BETWEEN 1996 AND 1999 GROUP BY node, year",
    "catalog": W + " SELECT subject, grade, count(DISTINCT id) AS n FROM questions GROUP BY subject, grade",
    "catalog_rollup": W + " SELECT subject, coalesce(grade, 'None') AS grade, count(DISTINCT id) AS n, 0 AS level FROM questions GROUP BY 1, 2 UNION ALL SELECT subject, NULL, count(DISTINCT id), 1 FROM questions GROUP BY subject",
    "catalog_tree": W + " SELECT subject, count(*) AS total, count(DISTINCT coalesce(grade, 'None')) AS n_grades FROM questions GROUP BY subject",
    "search_page": BASE + f" SELECT {COLS} FROM base ORDER BY created DESC NULLS FIRST, id LIMIT 20 OFFSET 40",
    "search_total": BASE + " SELECT count(DISTINCT id) AS total FROM base WHERE difficulty = 3",
    "search_instance_filter": BASE + " SELECT DISTINCT id, subject FROM base JOIN instances ON id = question_id WHERE year = 1997 AND school = 3",
    "search_instance_distinct": BASE + " SELECT DISTINCT id, subject FROM base JOIN instances ON id = question_id WHERE year = 1997 AND school = 3",
    "search_kp_ilike": W + " SELECT id, subject FROM questions WHERE id IN (SELECT question_id FROM mappings WHERE node ILIKE '%nation_1%')",
    "search_term_wildcard": W + " SELECT id, stem FROM questions WHERE stem ILIKE '%S_all%'",
    "search_term_literal": W + " SELECT id, stem FROM questions WHERE contains(lower(stem), 'small')",
    "search_confidence": W + " SELECT id, CAST(confidence AS DOUBLE) AS confidence FROM questions WHERE confidence = CAST(0.7 AS DECIMAL(4,3))",
    "occurrence_count": W + " SELECT question_id, count(*) AS n FROM instances GROUP BY question_id",
    "gate_metrics": W + """ SELECT * FROM (SELECT count(*) AS questions, count(*) FILTER (WHERE status = 'approved') AS approved, count(*) FILTER (WHERE status = 'reviewing') AS reviewing FROM questions),
      (SELECT count(*) AS candidates, count(*) FILTER (WHERE p_size % 3 = 1) AS to_review, count(*) FILTER (WHERE p_size % 3 = 0) AS rejected FROM part)""",
    "latest_per_key": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "range_filter": W + " SELECT school, count(*) AS n FROM instances WHERE year BETWEEN 1997 AND 1998 GROUP BY school",
    "or_filter": "SELECT n_nationkey, n_name FROM nation WHERE n_name = 'NATION_3' OR n_regionkey = 1",
    "status_macro": "SELECT count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') OR o_orderpriority = '1-URGENT'",
    "json_path_filter": "SELECT event_id, user_id FROM events WHERE json_extract_string(props, '$.k') = '42'",
    "column_predicate": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_discount < l_tax GROUP BY l_returnflag",
    "stale_predicate": "SELECT count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-03' AND event_id <> 5",
    "lookup_join": W + " SELECT document_id, number, question_id FROM instances JOIN orders ON document_id = o_orderkey WHERE o_orderpriority = '1-URGENT' AND number = 1",
    "orphan_questions": W + " SELECT id FROM questions WHERE id NOT IN (SELECT question_id FROM instances WHERE year = 1995 AND school < 20)",
    "document_status": """WITH latest AS (SELECT event_id % 3000 AS document_id, arg_max(event_type, (ts, event_id)) AS s FROM events GROUP BY 1)
      SELECT coalesce(s, o_orderstatus) AS shown, count(*) AS n FROM orders LEFT JOIN latest ON o_orderkey = document_id GROUP BY 1""",
    "dimension_unknown": """WITH rows AS (SELECT n_nationkey, 'REGION_' || (n_nationkey % 7) AS name FROM nation)
      SELECT n_nationkey, name, coalesce(CAST(r_regionkey AS VARCHAR), 'unknown') AS code FROM rows LEFT JOIN region ON r_name = CASE name WHEN 'REGION_5' THEN 'REGION_0' ELSE name END""",
    "question_detail": W + " SELECT id, stem, (SELECT count(*) FROM instances WHERE question_id = 42) AS occurrences FROM questions WHERE id = 42",
    "stem_preview": W + " SELECT id, substring(stem, 1, 5) AS preview FROM questions",
    "share_by_kp": BASE + " SELECT node, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT node, count(*) AS n FROM mappings JOIN instances USING (question_id) WHERE question_id IN (SELECT id FROM base) GROUP BY node)",
}
ORACLES["stats_year_trend"] = NARROW_BASE + " " + TREND
