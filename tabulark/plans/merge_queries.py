"""Merging, gates, geometry, evaluation and taxonomy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulark.functions import similarity as sm
from tabulark.operators import dedup, evals, gates, merge, taxonomy
from tabulark.plans.proxies import LINES_SQL, lines, read


def _two_sides(s, d):
    """Lines of neighbouring documents as two extractions: texts and a kind."""
    a = lines(s, d)
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), "line_no", F.col("text").alias("native_text"))
    out = a.withColumnRenamed("text", "pp_text").join(b, ["doc_id", "line_no"], "left")
    native = F.when(F.col("doc_id") % 5 == 0, F.concat("pp_text", F.lit(" x"))).when(F.col("doc_id") % 5 == 1, F.substring("pp_text", 1, 10)).when(F.col("doc_id") % 5 == 2, F.replace("pp_text", F.lit(" "), F.lit("  "))).otherwise(F.coalesce("native_text", F.lit("")))
    return out.withColumn("native_text", native).withColumn("block_type", F.lit("text"))


SIDES_SQL = f"""WITH {LINES_SQL}, a AS (SELECT * FROM lines),
sides AS (SELECT a.doc_id, a.line_no, a.text AS p, CASE a.doc_id % 5 WHEN 0 THEN a.text || ' x' WHEN 1 THEN substring(a.text, 1, 10) WHEN 2 THEN replace(a.text, ' ', '  ') ELSE coalesce(b.text, '') END AS n
  FROM a LEFT JOIN a b ON b.doc_id = a.doc_id + 1 AND b.line_no = a.line_no),
n AS (SELECT *, regexp_replace(p, '\\s+', '', 'g') AS ps, regexp_replace(n, '\\s+', '', 'g') AS ns FROM sides)"""


def _canonical(s, d):
    main = lines(s, d).withColumn("text", F.when(F.col("line_no") % 3 == 0, F.lit(" ")).otherwise(F.col("text")))
    other = lines(s, d).withColumn("line_id", F.col("line_no"))
    return merge.canonical(main, other, ["doc_id", "line_no"]).groupBy("doc_id").agg(F.sum(F.length("merged")).alias("n"))


def _boxes(s, d, side):
    """One box for each order and side. A page is 40 neighbouring orders, so that it holds few boxes at any size."""
    k, rows = F.col("l_partkey"), read(s, d, "lineitem").where((F.col("l_suppkey") % 2) == side)
    x, y = (F.col("l_suppkey") * 37 % 500).cast("double"), (k * 13 % 700).cast("double")
    one = rows.groupBy("l_orderkey").agg(F.min(F.struct(x.alias("x"), y.alias("y"), F.col("l_quantity").alias("q"))).alias("b"))
    box = F.struct(F.col("b.x").alias("x1"), F.col("b.y").alias("y1"), (F.col("b.x") + 20 + F.col("b.q")).alias("x2"), (F.col("b.y") + 30 + F.col("b.q")).alias("y2"))
    return one.select(F.col("l_orderkey").alias("left_id" if side == 0 else "right_id"), F.floor(F.col("l_orderkey") / 40).alias("page"), box.alias("box"))


def _boxes_sql(side, name):
    return f"""{name} AS (SELECT id, page, b.x AS x1, b.y AS y1, b.x + 20 + b.q AS x2, b.y + 30 + b.q AS y2 FROM (
      SELECT l_orderkey AS id, l_orderkey // 40 AS page, min(struct_pack(x := CAST(l_suppkey * 37 % 500 AS DOUBLE), y := CAST(l_partkey * 13 % 700 AS DOUBLE), q := l_quantity)) AS b FROM lineitem WHERE l_suppkey % 2 = {side} GROUP BY 1, 2))"""


BOXES_SQL = f"WITH {_boxes_sql(0, 'l')}, {_boxes_sql(1, 'r')}"


def _dedup_boxes(s, d):
    """One box for each line of an order on four pages, some of them moved or widened by a few pixels, some missing."""
    k, n = F.col("l_orderkey") * 8 + F.col("l_linenumber"), F.col("l_suppkey") % 10
    x, y, shift = (n * 37).cast("double"), (n * 61 % 100).cast("double"), (F.col("l_partkey") % 7).cast("double")
    box = F.struct((x + shift).alias("x1"), y.alias("y1"), (x + 8 + shift * 5).alias("x2"), (y + 6 + n).alias("y2"))
    return dedup.dedup_boxes(read(s, d, "lineitem").select(k.alias("image_id"), (F.col("l_orderkey") % 4).alias("page"), F.when(F.col("l_partkey") % 50 != 0, box).alias("box")))


DEDUP_SQL = """WITH raw AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey % 4 AS page, l_partkey % 50 = 0 AS bare, CAST(l_suppkey % 10 * 37 AS DOUBLE) AS x, CAST(l_suppkey % 10 * 61 % 100 AS DOUBLE) AS y, l_suppkey % 10 AS n, l_partkey % 7 AS shift FROM lineitem),
  boxes AS (SELECT id, page, bare, x + shift AS x1, y AS y1, x + 8 + shift * 5 AS x2, y + 6 + n AS y2 FROM raw),
  cells AS (SELECT *, first_value({'id': id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}) OVER (PARTITION BY bare, page, round_even(x1 / 10, 0), round_even(y1 / 10, 0), round_even(x2 / 10, 0), round_even(y2 / 10, 0) ORDER BY id) AS f FROM boxes),
  shared AS (SELECT *, greatest(least(x2, f.x2) - greatest(x1, f.x1), 0) * greatest(least(y2, f.y2) - greatest(y1, f.y1), 0) AS common FROM cells),
  judged AS (SELECT id, page, bare OR id = f.id AS kept, CASE WHEN bare OR id = f.id THEN NULL WHEN common / ((x2 - x1) * (y2 - y1) + (f.x2 - f.x1) * (f.y2 - f.y1) - common) >= 0.5 THEN 'iou' ELSE 'distance' END AS method FROM shared)"""


def _gate_rows(s, d):
    """Documents seen as question rows for the gate."""
    t = read(s, d, "documents")
    k, none = F.col("doc_id"), F.lit(None).cast("string")
    option = lambda i: F.struct(F.lit("ABCD"[i]).alias("label"), F.concat(F.lit(f"option {i} "), F.col("source")).alias("text"))
    options = F.slice(F.array(*[option(i) for i in range(4)]), 1, (k % 5).cast("int"))
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    return t.select(
        "doc_id", F.when(k % 17 == 0, F.lit(" ")).otherwise(F.col("text")).alias("stem"), F.when(k % 3 == 0, "single_choice").when(k % 3 == 1, "short_answer").otherwise("true_false").alias("qtype"),
        F.col("lang").alias("section"), F.when(k % 3 == 1, empty("struct<label:string,text:string>")).when(k % 3 == 2, F.slice(options, 1, 2)).otherwise(options).alias("options"),
        F.when(k % 7 == 0, none).when(k % 11 == 0, F.lit("。")).otherwise(F.substring("text", 3, 5)).alias("answer"), F.when(k % 4 == 0, "llm_fallback").when(k % 4 == 1, "llm_annotation").otherwise("document_answer_table").alias("answer_source"),
        F.lit(0.9).alias("answer_confidence"), F.when(k % 6 == 0, empty("string")).otherwise(F.array(F.lit("P1L001"))).alias("answer_line_ids"), F.when(k % 5 == 0, none).otherwise(F.lit("see above")).alias("explanation"),
        F.when(k % 5 == 0, "llm_fallback").otherwise("document").alias("explanation_source"), F.array(F.when(k % 13 == 0, "missing").when(k % 13 == 1, "retry").otherwise("exact")).alias("anchors"),
        F.when(k % 9 == 0, F.array(F.lit("note"))).otherwise(empty("string")).alias("issues"), F.lit(False).alias("is_composite"), empty("string").alias("shared_line_ids"), F.array(F.lit("P1L001")).alias("stem_line_ids"),
        F.col("text").alias("source_lines"), empty("struct<qno:string,stem:string,answer:string>").alias("sub_questions"), empty("struct<page:int,bbox:string,source:string>").alias("images"), empty("string").alias("word_bank"),
        F.lit(5.0).alias("score"), F.lit(3).alias("difficulty"), F.array(F.lit("kp")).alias("nodes"),
    )


#: What blocks publishing, on the rows of _gate_rows: anchors, options, an annotated answer without text or lines, no answer.
BLOCKED_SQL = """k % 13 IN (0, 1) OR (k % 3 = 0 AND n_opt = 0) OR (src = 1 AND (answer IS NULL OR trim(answer) = '' OR regexp_matches(answer, '^[\\s，。；：、.．!！?？\\-—…]+$') OR k % 6 = 0)) OR (src = 0 AND coalesce(answer, '') = '')"""
SCORE_SQL = """WITH q AS (SELECT doc_id AS k, CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE text END AS stem, CASE WHEN doc_id % 3 = 0 THEN doc_id % 5 WHEN doc_id % 3 = 1 THEN 0 ELSE least(2, doc_id % 5) END AS n_opt,
  CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN '。' ELSE substring(text, 3, 5) END AS answer, doc_id % 4 AS src FROM documents),
s AS (SELECT k, 1.0 - CASE WHEN k % 9 = 0 THEN 0.05 ELSE 0 END - CASE k % 13 WHEN 0 THEN 0.5 WHEN 1 THEN 0.4 ELSE 0 END - CASE WHEN trim(stem) = '' THEN 0.5 ELSE 0 END - CASE WHEN length(stem) > CASE WHEN k % 3 = 1 OR contains(stem, '材料') THEN 3000 ELSE 800 END THEN 0.4 ELSE 0 END
  - CASE WHEN k % 3 = 0 AND n_opt = 0 THEN 0.5 WHEN k % 3 = 0 AND n_opt < 4 THEN 0.3 ELSE 0 END - CASE WHEN answer IS NULL AND src = 0 THEN 0.2 ELSE 0 END
  - CASE WHEN src = 1 AND (answer IS NULL OR trim(answer) = '' OR regexp_matches(answer, '^[\\s，。；：、.．!！?？\\-—…]+$')) THEN 0.5 ELSE 0 END - CASE WHEN src = 1 AND k % 6 = 0 THEN 0.4 ELSE 0 END
  - CASE WHEN k % 5 = 0 THEN 0.1 ELSE 0 END - CASE WHEN src = 0 AND coalesce(answer, '') = '' THEN 0.3 ELSE 0 END AS score FROM q)
SELECT k AS doc_id, CAST(round(greatest(0.0, least(1.0, score)), 6) AS DOUBLE) AS confidence FROM s"""


def _nodes(s, d):
    region = read(s, d, "region").select(F.concat(F.lit("R"), F.col("r_regionkey")).alias("code"), F.lit(None).cast("string").alias("parent"), F.lit(1).alias("level"), F.col("r_name").alias("name"), F.array(F.lower("r_name")).alias("keywords"))
    nation = read(s, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("code"), F.concat(F.lit("R"), F.col("n_regionkey")).alias("parent"), F.lit(2).alias("level"), F.col("n_name").alias("name"), F.array(F.lower("n_name")).alias("keywords"))
    supplier = read(s, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("code"), F.concat(F.lit("N"), F.col("s_nationkey")).alias("parent"), F.lit(3).alias("level"), F.col("s_name").alias("name"), F.array(F.lower("s_name")).alias("keywords"))
    return region.unionByName(nation).unionByName(supplier)


NODES_SQL = """nodes AS (SELECT 'R' || r_regionkey AS code, NULL AS parent, 1 AS level, r_name AS name, lower(r_name) AS keyword FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 2, n_name, lower(n_name) FROM nation UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 3, s_name, lower(s_name) FROM supplier),
closure AS (WITH RECURSIVE c AS (SELECT code, code AS ancestor, 0 AS distance FROM nodes UNION ALL SELECT c.code, n.parent, c.distance + 1 FROM c JOIN nodes n ON c.ancestor = n.code WHERE n.parent IS NOT NULL) SELECT * FROM c)"""


def _points(s, d):
    return read(s, d, "customer").select(F.col("c_custkey").alias("question_id"), F.explode(F.array(F.concat(F.lit("nation_"), F.col("c_nationkey")), F.when(F.col("c_custkey") % 3 == 0, F.lit("nowhere")).otherwise(F.lit("region_1")))).alias("point"))


def _fields(s, d):
    part = read(s, d, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    actual = part.where("p_partkey % 10 <> 3").withColumn("p_type", F.when(F.col("p_partkey") % 4 == 0, F.lower("p_type")).when(F.col("p_partkey") % 4 == 1, F.lit("other")).otherwise(F.col("p_type")))
    return evals.field_accuracy(part, actual, ["p_partkey"], ["p_brand", "p_type", "p_name"])


def _graded(s, d):
    t = read(s, d, "documents").select("doc_id", "lang", F.col("text").alias("a"))
    k = F.col("doc_id") % 6
    b = F.when(k == 0, F.col("a")).when(k == 1, F.replace("a", F.lit(" "), F.lit("  "))).when(k == 2, F.replace("a", F.lit("."), F.lit(""))).when(k == 3, F.concat("a", F.lit("zz"))).when(k == 4, F.lit(None).cast("string")).otherwise(F.upper("a"))
    return t.withColumn("b", b)


def _similar_lines(s, d):
    """Every line against the lines of its number on its page. A page is 20 neighbouring documents."""
    rows = lines(s, d).withColumn("page", F.floor(F.col("doc_id") / 20))
    other = rows.select("page", "line_no", F.col("doc_id").alias("other_id"), "text")
    pairs = merge.similar_pairs(rows, other, ["page", "line_no"], 0.6, F.col("doc_id") != F.col("other_id"))
    return pairs.select("doc_id", "other_id", "line_no", F.round("similarity", 6).alias("similarity"))


def _coverage(s, d):
    """Each whole text against its first half, by doc_id."""
    half = F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    return evals.piece_coverage(read(s, d, "documents"), "doc_id", "text", half)


def _overlap(s, d):
    """Even orders against odd ones of the same 20 neighbours, so that a page holds few orders at any size."""
    page = F.floor(F.col("l_orderkey") / 20).alias("page")
    rows = read(s, d, "lineitem").groupBy("l_orderkey").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct(F.col("l_suppkey"), (F.col("l_suppkey") % 5).alias("v"))))).alias("entries"))
    left = rows.where("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("left_id"), page, "entries")
    right = rows.where("l_orderkey % 2 = 1").select(F.col("l_orderkey").alias("right_id"), page, "entries")
    return merge.best_overlap(left, right, "page").select("left_id", "right_id", F.round("score", 6).alias("score"))


def _votes(s, d):
    rows = read(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("v"), F.col("l_linenumber").alias("p"), "l_suppkey")
    return merge.majority(rows, "k", "v", "p")


def _two_tier(s, d):
    left = read(s, d, "customer").select(F.col("c_custkey").alias("left_id"), F.concat(F.lit("x"), F.col("c_custkey") % 300).alias("a"), F.col("c_nationkey").alias("b"))
    right = read(s, d, "supplier").select(F.col("s_suppkey").alias("right_id"), F.concat(F.lit("x"), F.col("s_suppkey")).alias("a"), F.col("s_nationkey").alias("b"))
    return merge.two_tier(left, right, "a", "b")


def _upsert(s, d):
    seed = _nodes(s, d).where("level < 3").withColumn("name", F.when(F.col("code") == "N3", F.lit("renamed")).otherwise(F.col("name")))
    return taxonomy.upsert(seed.where("code <> 'N5'"), _nodes(s, d).where("level < 3 and code <> 'N7'"))


BOTH = "r.page = l.page"
IW, IH = "greatest(0, least(l.x2, r.x2) - greatest(l.x1, r.x1))", "greatest(0, least(l.y2, r.y2) - greatest(l.y1, r.y1))"
IOU = f"({IW} * {IH}) / ((l.x2 - l.x1) * (l.y2 - l.y1) + (r.x2 - r.x1) * (r.y2 - r.y1) - {IW} * {IH})"
DX, DY = "((l.x1 + l.x2) / 2 - (r.x1 + r.x2) / 2)", "((l.y1 + l.y2) / 2 - (r.y1 + r.y2) / 2)"

QUERIES = {
    "canonical_merge": _canonical,
    "arbitrate_lines": lambda s, d: merge.arbitrate(_two_sides(s, d)).select("doc_id", "line_no", "winner", "conflict_type", "confidence", "needs_review"),
    "similarity_join": _similar_lines,
    "coverage_ratio": _coverage,
    "best_overlap_match": _overlap,
    "majority_vote": _votes,
    "two_tier_match": _two_tier,
    "iou_pairs": lambda s, d: merge.best_boxes(_boxes(s, d, 0), _boxes(s, d, 1)).select("left_id", "right_id", F.round("iou", 6).alias("iou")),
    "spatial_anti": lambda s, d: merge.without_near_box(_boxes(s, d, 0), _boxes(s, d, 1)).select("left_id"),
    "nearest_neighbor": lambda s, d: merge.nearest(_boxes(s, d, 0), _boxes(s, d, 1)),
    "point_in_box": lambda s, d: merge.in_box(_boxes(s, d, 0).select(F.col("left_id").alias("point_id"), "page", F.col("box.x1").alias("x"), F.col("box.y1").alias("y")), _boxes(s, d, 1).select(F.col("right_id").alias("box_id"), "page", (F.col("right_id") % 3).alias("priority"), "box")),
    "bucket_dedup": _dedup_boxes,
    "bucket_dedup_stats": lambda s, d: dedup.dedup_statistics(_dedup_boxes(s, d)),
    "grid_key": lambda s, d: read(s, d, "lineitem").groupBy(sm.grid(F.col("l_quantity")).alias("cell")).agg(F.count(F.lit(1)).alias("n")),
    "quality_score": lambda s, d: gates.quality_score(_gate_rows(s, d)).select("doc_id", "confidence"),
    "quality_counters": lambda s, d: gates.quality_counters(gates.quality_score(_gate_rows(s, d))),
    "gate_decision": lambda s, d: gates.admit(_gate_rows(s, d)).select("doc_id", "decision", "reason", "n_checks"),
    "gate_distribution": lambda s, d: gates.decision_distribution(gates.admit(_gate_rows(s, d))),
    "gate_top_reasons": lambda s, d: gates.top_reasons(gates.admit(_gate_rows(s, d))),
    "rule_failures": lambda s, d: gates.rule_failures(gates.rule_checks(_gate_rows(s, d)), ["r01", "r04", "r13", "r16"]),
    "discard_histogram": lambda s, d: gates.discard_histogram(read(s, d, "events").select(F.array("event_type", F.when(F.col("value") > 100, "large").otherwise("small"), "event_type").alias("issues")), "issues"),
    "field_accuracy": _fields,
    "verdict_hist": lambda s, d: evals.verdict_histogram(_graded(s, d).withColumn("verdict", evals.verdict(F.col("a"), F.col("b"))), "lang", "verdict"),
    "ab_pass_rate": lambda s, d: evals.pass_rate(_graded(s, d).withColumn("verdict", evals.verdict(F.col("a"), F.col("b"))), "lang", "verdict", ["exact", "format", "blank_marker", "punct_diff"]),
    "ab_lenient": lambda s, d: evals.verdict_histogram(_graded(s, d).withColumn("verdict", evals.ab_verdict(F.col("a"), F.col("b"))), "lang", "verdict"),
    "set_compare": lambda s, d: evals.set_compare(read(s, d, "lineitem").where("l_suppkey % 2 = 0").select("l_partkey"), read(s, d, "lineitem").where("l_returnflag = 'R'").select("l_partkey"), "l_partkey").groupBy("side").agg(F.count(F.lit(1)).alias("n")),
    "set_diff": lambda s, d: read(s, d, "lineitem").select("l_partkey").subtract(read(s, d, "lineitem").where("l_returnflag = 'A'").select("l_partkey")),
    "set_intersect": lambda s, d: read(s, d, "lineitem").where("l_returnflag = 'R'").select("l_suppkey").intersect(read(s, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))),
    "dup_numbers": lambda s, d: evals.duplicates(read(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]),
    "confidence_buckets": lambda s, d: evals.buckets(read(s, d, "lineitem").withColumn("c", F.col("l_quantity") / 50), "c"),
    "text_coverage": lambda s, d: evals.text_coverage(lines(s, d), "doc_id", "text"),
    "upper_median": lambda s, d: evals.upper_median(read(s, d, "lineitem"), "l_orderkey", "l_quantity"),
    "compare_runs": lambda s, d: evals.compare_runs(read(s, d, "part").select("p_partkey", "p_brand", "p_size"), read(s, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 8 == 0, 0).otherwise(F.col("p_size")).alias("p_size")), "p_partkey", ["p_brand", "p_size"]),
    "tree_closure": lambda s, d: taxonomy.closure(_nodes(s, d)),
    "keyword_index": lambda s, d: taxonomy.keyword_index(_nodes(s, d)),
    "deepest_match": lambda s, d: taxonomy.map_points(_points(s, d), _nodes(s, d)),
    "tree_children": lambda s, d: taxonomy.children(_nodes(s, d)),
    "tree_nested": lambda s, d: taxonomy.nested(_nodes(s, d)).select("code", "name", F.size("groups").alias("n_groups")),
    "tree_problems": lambda s, d: taxonomy.problems(_nodes(s, d).unionByName(_nodes(s, d).where("code in ('N3','R1')")).where("code <> 'R2'")),
    "taxonomy_upsert": _upsert,
}

ORACLES = {
    "canonical_merge": f"WITH {LINES_SQL} SELECT doc_id, CAST(sum(CASE WHEN line_no % 3 = 0 AND trim(text) = '' THEN 0 WHEN line_no % 3 = 0 THEN length(trim(text)) WHEN trim(text) = '' THEN 0 ELSE length(text) END) AS BIGINT) AS n FROM lines GROUP BY doc_id",
    "arbitrate_lines": SIDES_SQL + """ SELECT doc_id, line_no, v.w AS winner, v.t AS conflict_type, v.c AS confidence, v.r AS needs_review FROM (SELECT doc_id, line_no, CASE
      WHEN ps = '' AND ns = '' THEN struct_pack(w := 'ppsv3', t := 'equivalent', c := 1.0::DOUBLE, r := false) WHEN ps = '' THEN struct_pack(w := 'native', t := 'complementary', c := 0.9::DOUBLE, r := false)
      WHEN ns = '' THEN struct_pack(w := 'ppsv3', t := 'partial', c := 0.95::DOUBLE, r := false) WHEN ps = ns THEN struct_pack(w := 'ppsv3', t := 'equivalent', c := 1.0::DOUBLE, r := false)
      WHEN contains(ns, ps) THEN struct_pack(w := 'native', t := 'complementary', c := 0.9::DOUBLE, r := false) WHEN contains(ps, ns) THEN struct_pack(w := 'ppsv3', t := 'partial', c := 0.95::DOUBLE, r := false)
      ELSE struct_pack(w := 'ppsv3', t := 'conflicting', c := 0.5::DOUBLE, r := true) END AS v FROM n)""",
    "coverage_ratio": """WITH t AS (SELECT doc_id, text AS a, substring(text, 1, length(text) // 2) AS b FROM documents), p AS (SELECT doc_id, b, substring(a, i * 40 + 1, 40) AS piece FROM (SELECT *, unnest(range(CAST(ceil(length(a) / 40.0) AS BIGINT))) AS i FROM t))
      SELECT doc_id, avg(CASE WHEN contains(b, piece) THEN 1.0 ELSE 0.0 END) AS coverage FROM p GROUP BY doc_id""",
    "majority_vote": "WITH c AS (SELECT l_orderkey AS k, l_returnflag AS v, count(*) AS n, min(l_linenumber) AS p FROM lineitem GROUP BY 1, 2) SELECT k, arg_min(v, (-n, p, v)) AS value, max(n) AS votes FROM c GROUP BY k",
    "two_tier_match": """WITH l AS (SELECT c_custkey AS left_id, c_custkey % 300 AS a, c_nationkey AS b FROM customer), one AS (SELECT left_id, s_suppkey AS right_id, 1 AS tier FROM l JOIN supplier ON a = s_suppkey)
      SELECT * FROM one UNION ALL SELECT left_id, m, 2 FROM l JOIN (SELECT s_nationkey, min(s_suppkey) AS m FROM supplier GROUP BY 1) ON b = s_nationkey WHERE left_id NOT IN (SELECT left_id FROM one)""",
    "iou_pairs": BOXES_SQL + f" SELECT l.id AS left_id, arg_max(r.id, ({IOU}, -r.id)) AS right_id, round(max({IOU}), 6) AS iou FROM l JOIN r ON {BOTH} WHERE {IOU} > 0.3 GROUP BY l.id",
    "spatial_anti": BOXES_SQL + f" SELECT id AS left_id FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE {BOTH} AND abs({DX}) < 50 AND abs({DY}) < 50)",
    "nearest_neighbor": BOXES_SQL + f" SELECT l.id AS left_id, arg_min(r.id, (sqrt(pow({DX}, 2) + pow({DY}, 2)), r.id)) AS right_id, round(min(sqrt(pow({DX}, 2) + pow({DY}, 2))), 6) AS d FROM l JOIN r ON {BOTH} GROUP BY l.id",
    "point_in_box": BOXES_SQL + f" SELECT l.id AS point_id, arg_min(r.id, (r.id % 3, -r.id)) AS box_id FROM l JOIN r ON {BOTH} AND l.x1 BETWEEN r.x1 - 20 AND r.x2 + 20 AND l.y1 BETWEEN r.y1 - 20 AND r.y2 + 20 GROUP BY l.id",
    "bucket_dedup": DEDUP_SQL + " SELECT id AS image_id, page, kept, method FROM judged",
    "bucket_dedup_stats": DEDUP_SQL + " SELECT count(*) AS original, count(*) FILTER (WHERE kept) AS kept, count(*) FILTER (WHERE NOT kept) AS duplicates FROM judged",
    "grid_key": "SELECT CAST(round_even(l_quantity / 10, 0) * 10 AS INT) AS cell, count(*) AS n FROM lineitem GROUP BY 1",
    "quality_score": SCORE_SQL,
    "quality_counters": SCORE_SQL.replace("ELSE 0 END AS score FROM q)", f"ELSE 0 END AS score, {BLOCKED_SQL} AS blocked FROM q)").rsplit("SELECT", 1)[0] + "SELECT count(*) FILTER (WHERE round(greatest(0.0, score), 6) >= 0.8) AS high, count(*) FILTER (WHERE round(greatest(0.0, score), 6) < 0.5) AS low, count(*) FILTER (WHERE blocked) AS blocked FROM s",
    "best_overlap_match": """WITH k AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem), n AS (SELECT o, count(*) AS n FROM k GROUP BY o),
      p AS (SELECT a.o AS l, b.o AS r, count(*) AS c FROM k a JOIN k b ON a.s = b.s AND a.o // 20 = b.o // 20 WHERE a.o % 2 = 0 AND b.o % 2 = 1 GROUP BY 1, 2)
      SELECT l AS left_id, arg_max(r, (0.6 * c / n + 0.4, -r)) AS right_id, round(max(0.6 * c / n + 0.4), 6) AS score FROM p JOIN n ON o = l GROUP BY l""",
    "deepest_match": f"""WITH {NODES_SQL}, p AS (SELECT DISTINCT c_custkey AS q, unnest(['nation_' || c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN 'nowhere' ELSE 'region_1' END]) AS point FROM customer), d AS (SELECT DISTINCT point FROM p),
      exact AS (SELECT point, code, level FROM d JOIN nodes ON point = keyword), h AS (SELECT * FROM exact UNION ALL SELECT point, code, level FROM d JOIN nodes ON contains(point, keyword) OR contains(keyword, point) WHERE point NOT IN (SELECT point FROM exact)),
      m AS (SELECT q, arg_max(code, (level, code)) FILTER (WHERE code IS NOT NULL) AS best, count(DISTINCT CASE WHEN code IS NOT NULL THEN point END) / count(DISTINCT point) AS c FROM p LEFT JOIN h USING (point) GROUP BY q)
      SELECT q AS question_id, CASE WHEN best IS NOT NULL AND c >= 0.7 THEN best ELSE 'UNKNOWN' END AS code, round(c, 6) AS confidence, best IS NOT NULL AND c >= 0.7 AS known FROM m""",
    "rule_failures": """WITH q AS (SELECT doc_id AS k, CASE WHEN doc_id % 3 = 0 THEN doc_id % 5 WHEN doc_id % 3 = 1 THEN 0 ELSE least(2, doc_id % 5) END AS n_opt, doc_id % 17 = 0 OR trim(text) = '' AS empty FROM documents)
      SELECT 'r01' AS rule, count(*) FILTER (WHERE empty) AS failed, count(*) AS n FROM q UNION ALL SELECT 'r04', count(*) FILTER (WHERE (k % 3 = 2 AND n_opt <> 2) OR (k % 3 = 0 AND n_opt = 0)), count(*) FROM q UNION ALL SELECT 'r13', 0, count(*) FROM q UNION ALL SELECT 'r16', 0, count(*) FROM q""",
    "discard_histogram": "SELECT event_type AS issue, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT CASE WHEN value > 100 THEN 'large' ELSE 'small' END, count(*) FROM events GROUP BY 1",
    "field_accuracy": """WITH r AS (SELECT p_partkey % 10 <> 3 AS there, p_partkey % 4 AS k FROM part) SELECT field, correct, total, round(correct / total, 4) AS accuracy FROM (
      SELECT 'p_brand' AS field, count(*) FILTER (WHERE there) AS correct, count(*) AS total FROM r UNION ALL SELECT 'p_name', count(*) FILTER (WHERE there), count(*) FROM r UNION ALL SELECT 'p_type', count(*) FILTER (WHERE there AND k <> 1), count(*) FROM r)""",
    "set_compare": "WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey % 2 = 0), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R') SELECT CASE WHEN a.l_partkey IS NULL THEN 'right' WHEN b.l_partkey IS NULL THEN 'left' ELSE 'both' END AS side, count(*) AS n FROM a FULL JOIN b ON a.l_partkey = b.l_partkey GROUP BY 1",
    "set_diff": "SELECT l_partkey FROM lineitem EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'",
    "set_intersect": "SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000",
    "dup_numbers": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "confidence_buckets": "SELECT CASE WHEN l_quantity / 50 >= 0.8 THEN 'high' WHEN l_quantity / 50 >= 0.5 THEN 'middle' ELSE 'low' END AS band, count(*) AS n FROM lineitem GROUP BY 1",
    "text_coverage": f"WITH {LINES_SQL} SELECT doc_id, round(avg(CASE WHEN length(trim(text)) > 10 THEN 1.0 ELSE 0.0 END), 4) AS coverage FROM lines GROUP BY doc_id",
    "upper_median": "SELECT l_orderkey, list_sort(list(l_quantity))[count(*) // 2 + 1] AS median FROM lineitem GROUP BY 1",
    "compare_runs": "SELECT 'p_brand' AS \"column\", count(*) AS same, count(*) AS total FROM part UNION ALL SELECT 'p_size', count(*) FILTER (WHERE p_partkey % 8 <> 0 OR p_size = 0), count(*) FROM part",
    "tree_closure": f"WITH {NODES_SQL} SELECT code, ancestor, distance FROM closure",
    "keyword_index": f"WITH {NODES_SQL} SELECT DISTINCT keyword, ancestor AS code FROM closure JOIN nodes USING (code)",
    "tree_children": f"WITH {NODES_SQL} SELECT parent, count(*) AS n, string_agg(code, ',' ORDER BY code) AS codes FROM nodes WHERE parent IS NOT NULL GROUP BY parent",
    "tree_nested": "SELECT 'R' || r_regionkey AS code, r_name AS name, count(*) AS n_groups FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1, 2",
    "tree_problems": f"""WITH {NODES_SQL}, x AS (SELECT * FROM (SELECT * FROM nodes UNION ALL SELECT * FROM nodes WHERE code IN ('N3', 'R1')) WHERE code <> 'R2')
      SELECT code, 'unknown_parent' AS problem FROM x WHERE parent IS NOT NULL AND parent NOT IN (SELECT code FROM x) UNION ALL SELECT code, 'duplicate' FROM x GROUP BY code HAVING count(*) > 1""",
    "taxonomy_upsert": f"""WITH {NODES_SQL}, c AS (SELECT code FROM nodes WHERE level < 3) SELECT code, CASE code WHEN 'N5' THEN 'orphan' WHEN 'N7' THEN 'insert' WHEN 'N3' THEN 'update' ELSE 'keep' END AS change FROM c""",
}
