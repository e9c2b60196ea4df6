"""Answers of a document: the table of answers at its end, the results of worked solutions, their verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulark.functions.exam import PAGE_FOOTER, SOLUTION_SCORE
from tabulark.functions.patterns import answer_pairs, strip, table_entries
from tabulark.functions.text import half_width, math_text
from tabulark.operators.gates import blank
from tabulark.operators.lines import in_order, so_far

# Headings that open, stop and interrupt the answers; rows of numbers and answers; marks of results.
SECTION = r"(?i)(?:^|[\s，。；：])(?:参考答案|答案|Answer\s*Key)(?:\s*[:：]|$)"
STOP, DETAIL, RESUME = r"^\s*[一二三四五六七八九十]+\s*[、．]?\s*解答题", r"【(?:导语|详解|解析|分析)|【\d+\s*题详解】", r"【答案】"
NUMBER_ROW, ANSWER_ROW = r"(?U)^\s*题号\s+(.+)$", r"(?U)^\s*答案\s+(.+)$"
SUB_MARK = r"^\s*(?:[（(]\s*[ⅠⅡⅢⅣ一二三四五六七八九十\d]{1,3}\s*[）)]|①|②|③|④|⑤|⑥|⑦|⑧|⑨|⑩)\s*"
RESULT = r"解集是|定义域为|值域(?:是|为)|取值范围(?:是|为)|对称轴方程为|答案是|结论是|最大值为|最小值为|取得最大值|取得最小值|综上|因此|所以|故|解得|可得|可知|即"
EQUALS = r"=|∈|是|为|增大|减小"
SHORT_MATH = r"^[\d.,，。+\-$]*$"
ESSAY = 100


def answer_table(lines: DataFrame) -> DataFrame:
    """doc_id, number, answer, source for lines (doc_id, line_no, text, source native or ocr) behind an answer heading
    and before a heading of worked solutions; explanations are passed over. A table's entry comes before those of lines
    after it, a native answer before a recognized one, a later one before an earlier."""
    text = F.col("text")
    heading = text.rlike(SECTION)
    rows = lines.withColumn("_in", F.max(heading.cast("int")).over(so_far("doc_id"))).where("_in = 1")
    rows = rows.withColumn("_over", F.max((text.rlike(STOP) & ~heading).cast("int")).over(so_far("doc_id"))).where("_over = 0")
    event = F.when(heading | (text.rlike(RESUME) & ~text.rlike(DETAIL)), 0).when(text.rlike(DETAIL), 1)
    rows = rows.withColumn("_detail", F.coalesce(F.last(event, ignorenulls=True).over(so_far("doc_id")), F.lit(0))).where(~heading & (F.col("_detail") == 0))
    words = lambda c, p: F.split(strip(F.regexp_extract(c, p, 1)), r"(?U)\s+")
    asked = F.lag("text").over(in_order("doc_id"))
    numbers = F.filter(words(asked, NUMBER_ROW), lambda t: t.rlike(r"^\d+$"))
    paired = F.filter(F.transform(numbers, lambda q, i: F.struct(q.try_cast("int").alias("number"), F.get(words(text, ANSWER_ROW), i).alias("answer"))), lambda e: e["answer"].isNotNull())
    html = F.transform(answer_pairs(text), lambda p: F.struct(p["number"].try_cast("int").alias("number"), p["answer"].alias("answer")))
    plain = F.when(text.rlike(NUMBER_ROW), F.array().cast("array<struct<number:int,answer:string>>")).otherwise(table_entries(text))
    is_pair = F.coalesce(asked.rlike(NUMBER_ROW) & text.rlike(ANSWER_ROW), F.lit(False))
    rows = rows.withColumn("_table", is_pair | html.isNotNull()).withColumn("_found", F.coalesce(html, F.when(is_pair, paired).otherwise(plain)))
    found = rows.select("doc_id", "line_no", "_table", (F.coalesce("source", F.lit("native")) != "ocr").alias("native"), F.posexplode("_found").alias("pos", "e")).select("*", "e.*")
    first = F.min(F.when(F.col("_table"), F.col("line_no"))).over(Window.partitionBy("doc_id", "number"))
    found = found.withColumn("_first", first).where(F.col("_table") | F.col("_first").isNull() | (F.col("line_no") <= F.col("_first")))
    best = found.groupBy("doc_id", "number").agg(F.max_by(F.struct("answer", "native"), F.struct("native", "line_no", "pos")).alias("b"))
    return best.select("doc_id", "number", "b.answer", F.when(F.col("b.native"), "native").otherwise("ocr").alias("source"))


def clean_segment(text: Column) -> Column:
    return strip(F.regexp_replace(strip(F.regexp_replace(F.coalesce(text, F.lit("")), PAGE_FOOTER, "")), SOLUTION_SCORE, ""))


def is_result(text: Column) -> Column:
    """Whether a segment of a worked solution states a result: a numbered part with a score or of 30 characters at most,
    or a score beside a result's wording."""
    raw = strip(F.regexp_replace(F.coalesce(text, F.lit("")), PAGE_FOOTER, ""))
    clean, scored = clean_segment(text), raw.rlike(r"\d+\s*分")
    part = clean.rlike(SUB_MARK) & (scored | (F.length(clean) <= 30))
    return (clean != "") & ~clean.rlike("理由如下|证明如下") & (part | (scored & clean.rlike(f"{RESULT}|{EQUALS}")))


def solution_answers(segments: DataFrame) -> DataFrame:
    """doc_id, number, answer for segments (doc_id, number, seq, text): the results of each solution in order, each once,
    joined by `；`. Continuations right before a result (short mathematics, or a result's wording that ends in an equals
    sign or the like) belong to it."""
    clean = clean_segment(F.col("text"))
    rows = segments.withColumn("_clean", clean).where("_clean <> ''").withColumn("_result", is_result(F.col("text")))
    goes_on = ((F.length("_clean") <= 8) & F.col("_clean").rlike(SHORT_MATH)) | (F.col("_clean").rlike(RESULT) & F.col("_clean").rlike(r"[=:：+\-]\s*$"))
    rows = rows.withColumn("_goes_on", ~F.col("_result") & goes_on)
    ahead = Window.partitionBy("doc_id", "number").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("_next", F.first(F.when(~F.col("_goes_on"), F.col("_result")), ignorenulls=True).over(ahead))
    kept = rows.where(F.col("_result") | (F.col("_goes_on") & F.coalesce("_next", F.lit(False))))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "_clean"))), lambda r: r["_clean"])
    return kept.groupBy("doc_id", "number").agg(F.array_join(F.array_distinct(ordered), "；").alias("answer"))


def verify(rows: DataFrame) -> DataFrame:
    """`rows` (question, number, answer, expected_table, expected_prefix, expected_inline, blank_cell, sub_matched,
    sub_mismatched, sub_total, free_text_found, parts_found, parts_total, has_section, section) with status (matched,
    mismatched, unverifiable), kind and reason. The first evidence decides: a stated answer, sub-questions, the whole
    text, its numbered parts, the opening of an essay."""
    compact = half_width(F.col("answer"))
    expected = F.coalesce("expected_table", "expected_prefix", "expected_inline")
    kind = F.when(F.col("expected_table").isNotNull(), "table").when(F.col("expected_prefix").isNotNull(), "prefix").otherwise("inline")
    math = lambda c: half_width(math_text(c))
    formula = F.concat(compact, half_width(expected)).rlike(r"[$\\]")
    equal = (compact == half_width(expected)) | (formula & (math(F.col("answer")) != "") & (math(F.col("answer")) == math(expected)))
    state = lambda status, how, why: F.struct(F.lit(status).alias("status"), how.alias("kind"), F.lit(why).cast("string").alias("reason"))
    none = F.lit(None).cast("string")
    matched, why = lambda how: state("matched", F.lit(how), None), lambda reason: state("unverifiable", none, reason)
    subs, parts = F.coalesce("sub_total", F.lit(0)), F.coalesce("parts_found", F.lit(0))
    essay = F.contains(half_width(F.col("section")), F.substring(compact, 1, 40))
    outcome = (
        F.when(compact == "", why("missing_db_answer")).when(F.col("number").try_cast("int").isNull(), why("invalid_question_number"))
        .when(expected.isNotNull() & equal, F.struct(F.lit("matched").alias("status"), kind.alias("kind"), none.alias("reason"))).when(expected.isNotNull(), F.struct(F.lit("mismatched").alias("status"), kind.alias("kind"), none.alias("reason")))
        .when(F.coalesce("blank_cell", F.lit(False)), why("blank_table_cell")).when((subs > 0) & (F.col("sub_mismatched") > 0), state("mismatched", F.lit("composite"), None))
        .when((subs > 0) & (F.col("sub_matched") == subs), matched("composite")).when(F.coalesce("free_text_found", F.lit(False)), matched("free_text"))
        .when((subs == 0) & (parts > 0) & (parts == F.col("parts_total")), matched("structured")).when((subs == 0) & (parts > 0), why("structured_partial")).when(subs > 0, why("composite_subquestion"))
        .when(~F.coalesce("has_section", F.lit(False)), why("missing_answer_evidence")).when(compact.rlike(r"^[A-G]{1,4}$"), why("no_answer_evidence"))
        .when((F.length(compact) >= ESSAY) & F.coalesce(essay, F.lit(False)), matched("essay")).when(F.length(compact) >= ESSAY, why("essay_manual_review")).otherwise(why("free_text_answer"))
    )
    return rows.withColumn("_v", outcome).select("*", "_v.*").drop("_v")


def composite_answers(rows: DataFrame) -> DataFrame:
    """`rows` (answer, sub_questions array<struct<qno,answer>>) with has_summary and n_answered, the sub-questions that
    have an answer."""
    return rows.withColumn("has_summary", ~blank(F.col("answer"))).withColumn("n_answered", F.size(F.filter("sub_questions", lambda s: ~blank(s["answer"]))))
