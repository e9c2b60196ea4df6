"""The driver's tables seen as a question bank, for queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulark.operators.bank import CONFIDENCE, Star
from tabulark.session import bound_batches

#: The same star in SQL.
STAR_SQL = """
questions AS (
  SELECT p_partkey AS id, p_brand AS subject, CAST(nullif(p_size % 7, 0) AS VARCHAR) AS grade, p_type AS qtype, p_size % 5 + 1 AS difficulty, p_retailprice AS score,
    CASE p_size % 4 WHEN 0 THEN 'reviewing' WHEN 3 THEN 'rejected' ELSE 'approved' END AS status, CAST((p_size % 11) / 10.0 AS DECIMAL(4,3)) AS confidence, p_name AS stem, p_partkey % 97 AS created
  FROM part),
instances AS (SELECT l_partkey AS question_id, l_orderkey AS document_id, l_linenumber AS number, CAST(year(l_shipdate) AS INT) AS year, l_suppkey AS school FROM lineitem),
mappings AS (SELECT DISTINCT l_partkey AS question_id, n_name AS node FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. Whole texts go to Python in batches bounded by bytes, since rows say nothing of their size."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star(spark: SparkSession, sf_dir: str) -> Star:
    part, lineitem = read(spark, sf_dir, "part"), read(spark, sf_dir, "lineitem")
    size = F.col("p_size")
    status = F.when(size % 4 == 0, "reviewing").when(size % 4 == 3, "rejected").otherwise("approved")
    questions = part.select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("subject"), F.nullif(size % 7, F.lit(0)).cast("string").alias("grade"), F.col("p_type").alias("qtype"), (size % 5 + 1).alias("difficulty"),
        F.col("p_retailprice").alias("score"), status.alias("status"), ((size % 11) / F.lit(10)).cast(CONFIDENCE).alias("confidence"), F.col("p_name").alias("stem"), (F.col("p_partkey") % 97).alias("created"),
    )
    instances = lineitem.select(
        F.col("l_partkey").alias("question_id"), F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("number"), F.year("l_shipdate").alias("year"), F.col("l_suppkey").alias("school")
    )
    nodes = read(spark, sf_dir, "supplier").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    pairs = lineitem.select("l_partkey", "l_suppkey").distinct()
    mappings = pairs.join(nodes, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("question_id"), F.col("n_name").alias("node")).distinct()
    return Star(questions, instances, mappings)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines: doc_id, line_no (from 1), text."""
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).select("doc_id", (F.col("pos") + 1).alias("line_no"), "text")


LINES_SQL = """
lines AS (SELECT doc_id, pos AS line_no, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents))
"""
