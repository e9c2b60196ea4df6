"""Exam-specific rules."""

from pyspark.sql import functions as F

from tabulark.functions import exam


def rows(spark, data, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(data, schema).select(*cols).collect()]


def test_subject_of_file(spark):
    got = rows(spark, [("2025期末数学.pdf",), ("化学老师.pdf",), ("附件一二三四五六七八数学",), (None,)], "x string", exam.subject_of_file(F.col("x")))
    assert got == [("数学",), ("化学",), (None,), (None,)]


def test_mark_blanks(spark):
    data = [("{11} and (12) and __13__", ["14"], "数学"), ("it was 14 here", ["14"], "英语"), ("page 14 and 14th and 14.2", ["14"], "英语"), ("my 5was", ["5"], "英语"), ("it was 14", ["14"], "数学")]
    got = rows(spark, data, "t string, n array<string>, s string", exam.mark_blanks(F.col("t"), F.col("n"), F.col("s")))
    assert got == [("〔11〕 and 〔12〕 and 〔13〕",), ("it was 〔14〕 here",), ("page 14 and 14th and 14.2",), ("my 〔5〕was",), ("it was 14",)]


def test_chemistry(spark):
    assert rows(spark, [("H(2)SO(4)",), ("Ca(2+)",), ("SO(4)(2-)",), (None,)], "x string", exam.chemistry("x")) == [("H₂SO₄",), ("Ca²⁺",), ("SO₄²⁻",), (None,)]


def test_answers(spark):
    got = rows(spark, [("3", "故选 B。"), ("3", "3. x = 1（4分）"), (None, "（2）y")], "q string, t string", exam.clean_answer(F.col("q"), F.col("t")))
    assert got == [("B",), ("x = 1",), ("（2）y",)]
    kind = "a string, o array<struct<label:string,text:string>>"
    opts = [("A", "x"), ("C", "z")]
    assert rows(spark, [("ac", opts), ("B", opts), (None, opts)], kind, exam.answer_with_text(F.col("a"), F.col("o"))) == [("A. x；C. z",), (None,), (None,)]


def test_labels_scores_and_options(spark):
    data = [(4, "upperRoman"), (1994, "lowerRoman"), (2, "lowerLetter"), (30, "upperLetter"), (7, "decimal")]
    assert rows(spark, data, "n int, s string", exam.number_label(F.col("n"), F.col("s"))) == [("IV",), ("mcmxciv",), ("b",), ("30",), ("7",)]
    assert rows(spark, [("共2小题，每小题1.50分，共3.0分",)], "x string", exam.score_sequence(F.col("x"))) == [("1.5|3",)]
    lines = spark.createDataFrame([(1, 1, "A.x B.y C.z", "text"), (1, 2, "A.x B.y", "table"), (1, 3, "plain", None)], "doc_id int, line_no int, text string, block_type string")
    got = [(r.line_no, r.option_text) for r in exam.expand_option_lines(lines).orderBy("line_no", "part").collect()]
    assert got == [(1, "A.x"), (1, "B.y"), (1, "C.z"), (2, "A.x B.y"), (3, "plain")]
    assert rows(spark, [("$a$ b",), ("fine",), (None,)], "x string", exam.leaks_body(F.col("x"))) == [(True,), (False,), (False,)]
