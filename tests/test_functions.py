"""Fixtures of the text functions, gates and machines."""

import difflib

from pyspark.sql import functions as F

from tabulark.functions import patterns as pt
from tabulark.functions import similarity as sm
from tabulark.functions import text as tx
from tabulark.operators import dedup, evals, gates, lines, merge, practice
from tabulark.plans.merge_queries import _gate_rows
from tabulark.sinks import good_and_quarantine, update_from
from tabulark.sources import readers
from tabulark.streaming import states


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_normalizers(spark):
    assert one(spark, "Ａ B，c.", tx.normalize_text) == "abc"
    assert one(spark, "x=-1", tx.normalize_text) == one(spark, "x=1", tx.normalize_text)
    assert one(spark, r"$\frac{3}{4}$", tx.compact_answer) == "3/4" == one(spark, " 3 / 4", tx.compact_answer)
    assert one(spark, "（1）；a", tx.compact_answer) == "(1);a"
    assert one(spark, "____3____ x", tx.blank_markers) == "[3] x"
    assert one(spark, None, tx.normalize_native) == ""
    assert one(spark, "Ｑ１ “x”", tx.half_width) == 'Q1"x"'


def test_option_order_does_not_change_the_hash(spark):
    kind = "array<struct<label:string,text:string>>"
    a = [("A", "x"), ("B", "y")]
    f = lambda c: tx.content_hash(F.lit("s"), c)
    assert one(spark, a, f, kind) == one(spark, a[::-1], f, kind)


def test_patterns(spark):
    assert one(spark, "A.xB.y", pt.split_options) == [("A", "xB.y")]
    assert one(spark, "甲 B. 乙", pt.split_options) == [("A", "甲"), ("B", "乙")]
    assert one(spark, "12. text", pt.question_number) == 12 and one(spark, "2026.1", pt.question_number) is None
    assert [one(spark, x, pt.line_type) for x in ("(1)A (2)B", "(A) x", "3. y", "z")] == ["answer_table", "option", "question_number", "stem"]
    assert [one(spark, x, pt.difficulty) for x in ("3", "9", None, "x", "5")] == [3, 3, 3, 3, 5]
    assert one(spark, "P12L003", pt.page_of) == 12
    assert one(spark, "3~5", pt.answer_structure).kind == "range"
    assert one(spark, "<tr><td>1</td><td>A</td></tr>", pt.answer_rows) == [["1", "A"]]


def test_similarity(spark):
    df = spark.createDataFrame([("abcd efgh", "abcd efgx"), ("ab", "abcdefghij"), ("", "x")], "a string, b string")
    got = [r[0] for r in df.select(sm.hybrid_similarity(F.col("a"), F.col("b"))).collect()]
    want = 0.7 * difflib.SequenceMatcher(None, "abcd efgh", "abcd efgx").ratio() + 0.3 * (8 / 10)
    assert abs(got[0] - want) < 1e-9 and got[1] == 0.0 and got[2] == 0.0
    assert [one(spark, x, sm.grid, "double") for x in (25.0, 35.0, 14.0)] == [20, 40, 10]


def test_gate_rounds(spark, sf):
    rows = gates.admit(_gate_rows(spark, sf)).select("doc_id", "decision", "reason", "r01", "n_checks").collect()
    assert {r.decision for r in rows} <= {"approve", "review", "reject"}
    empty = [r for r in rows if not r.r01]
    assert empty and all((r.decision, r.reason, r.n_checks) == ("reject", "r01", 1) for r in empty)
    scored = gates.quality_score(_gate_rows(spark, sf)).agg(F.min("confidence"), F.max("confidence")).first()
    assert 0 <= scored[0] <= scored[1] <= 1


def test_arbitration(spark):
    rows = [(1, "", ""), (2, "", "n"), (3, "p", ""), (4, "a b", "ab"), (5, "ab", "xaby"), (6, "xaby", "ab"), (7, "ab", "cd"), (8, "(A) x", "x (A) x")]
    df = spark.createDataFrame([(*r, "text") for r in rows], "k int, pp_text string, native_text string, block_type string")
    got = {r.k: (r.winner, r.conflict_type, r.confidence) for r in merge.arbitrate(df).collect()}
    assert got[1] == ("ppsv3", "equivalent", 1.0) and got[2] == ("native", "complementary", 0.9) and got[3] == ("ppsv3", "partial", 0.95)
    assert got[4][1] == "equivalent" and got[5] == ("native", "complementary", 0.9) and got[6] == ("ppsv3", "partial", 0.95) and got[7][1] == "conflicting"


def test_box_dedup(spark):
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    rows = [(1, 1, (0.0, 0.0, 10.0, 10.0)), (2, 1, (0.0, 0.0, 10.0, 10.0)), (3, 1, None), (4, 1, None), (5, 2, (0.0, 0.0, 10.0, 10.0))]
    got = {r.image_id: (r.kept, r.method) for r in dedup.dedup_boxes(spark.createDataFrame(rows, f"image_id long, page long, box {box}")).collect()}
    assert got == {1: (True, None), 2: (False, "iou"), 3: (True, None), 4: (True, None), 5: (True, None)}


def test_retry_machine(spark):
    log = [(1, i, i, k) for i, k in enumerate(["pick", "fail"] * 3)] + [(2, 0, 0, "pick"), (2, 1, 1, "success"), (3, 0, 0, "fail")]
    got = {r.key: (r.status, r["count"]) for r in states.retry_states(spark.createDataFrame(log, "key long, ts long, event_id long, kind string")).collect()}
    assert got == {1: ("failed", 3), 2: ("succeeded", 1), 3: ("pending", 0)}


def test_verdicts(spark):
    rows = [("a b", "a  b", "format"), ("a", "a", "exact"), (None, None, "exact"), (None, "a", "mismatch"), ("a.b", "ab", "punct_diff"), ("____3____ x", "〔3〕 x", "blank_marker"), ("a", "c", "mismatch")]
    df = spark.createDataFrame(rows, "a string, b string, want string")
    assert all(r[0] == r[1] for r in df.select(evals.verdict(F.col("a"), F.col("b")), "want").collect())


def test_upper_median_and_lines(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4)], "k int, v double")
    assert evals.upper_median(df, "k", "v").first().median == 3.0
    ls = spark.createDataFrame([(1, 1, "<table>"), (1, 2, "x"), (1, 3, "</table>"), (1, 4, "y")], "doc_id int, line_no int, text string")
    got = lines.joined_tables(ls, F.contains("text", F.lit("<table>")), F.contains("text", F.lit("</table>"))).orderBy("line_no").collect()
    assert [r.block for r in got] == [1, 1, 1, 2]


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([('note ```json {"a": 1, "b": [2, 3',), ("none",), ('x {"k": "v"} y',)], "x string")
    got = [r[0] for r in df.select(readers.json_object("x")).collect()]
    assert got == ['{"a": 1, "b": [2, 3]}', None, '{"k": "v"}']
    bad = "语文".encode("gbk").decode("cp1252")
    assert one(spark, bad, readers.repair_gbk) == "语文" and one(spark, "été", readers.repair_gbk) == "été"
    assert one(spark, "[1,2,3,4]", readers.box_of).x2 == 3.0 and one(spark, '{"left":1,"top":2,"right":3,"bottom":4}', readers.box_of).y2 == 4.0
    rows = spark.createDataFrame([(1, None), (2, 5)], "id int, v int")
    good, rest = good_and_quarantine(rows, {"v": F.col("v") > 0})
    assert good.count() == 1 and rest.first()._errors == ["v"]
    assert {tuple(r) for r in update_from(rows, spark.createDataFrame([(1, 9)], "id int, v int"), ["id"], ["v"]).collect()} == {(1, 9), (2, 5)}


def test_similar_is_exact(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = practice.similar(e.where("vec_id = 0"), e, 3).orderBy("rank").collect()
    assert [r.rank for r in got] == [1, 2, 3] and got[0].score >= got[1].score >= got[2].score


def test_shared_material(spark):
    texts = {"A\nfoo": "foo", " B \r\nfoo": "foo", "A": "", "Ａbc ２": "abc", "a\\text{zz}b": "ab", "AB\nfoo": "abfoo", "H\nx": "hx", "中 文_12_x": "中文x", None: ""}
    assert {t: one(spark, t, tx.shared_material) for t in texts} == texts


def test_verdicts_compare_nfkc_and_numbers(spark):
    rows = [("Ａ x", "A x", "format", "format"), ("ab 1 cd", "ab 2 cd", "mismatch", "number_diff"), ("a*b 1 cd", "ab 1 cd", "mismatch", "format_diff"), (None, "x", "mismatch", "mismatch"), (None, None, "exact", "exact"), ("x__3__ y", "x[3] y", "blank_marker", "blank_marker"), ("a, b", "a; b", "punct_diff", "punct_diff"), ("abc", "abd", "mismatch", "mismatch")]
    df = spark.createDataFrame(rows, "a string, b string, want string, shared string")
    got = df.select(evals.verdict(F.col("a"), F.col("b")).alias("v"), evals.verdict_shared(F.col("a"), F.col("b")).alias("s"), "want", "shared").collect()
    assert [(r.v, r.s) for r in got] == [(r.want, r.shared) for r in got]
