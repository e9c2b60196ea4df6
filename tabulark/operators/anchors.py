"""Question anchors in a document's lines: where questions start, which lines their stems span, and whether the line ids
of an annotation hold.

Lines: (doc_id, line_id, order, page_no, text). Questions: (doc_id, question_id, number, qtype, is_composite,
shared_line_ids, stem_line_ids, start_marker, end_marker, options map<string,array<string>>). Lines and questions meet by
document, so a document's questions times its lines bounds every join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulark.functions.patterns import DOT_NUMBER, PAREN_NUMBER, question_number, strip
from tabulark.functions.similarity import accept_marker, marker_coverage
from tabulark.functions.text import normalize_marker
from tabulark.operators.gates import CHOICE
from tabulark.operators.lines import best_start

# Answer headings, placeholder lines, option labels at the head of a line.
ANSWER_HEADING = r"(?i)(?:^|[\s，。；：])(?:参考答案|答案|Answer\s*Key)(?:\s*[:：]|$)|^【答案】\s*$"
PLACEHOLDER = r"^\s*[（(]\s*\d{1,3}\s*[）)]\s*[（(]集团(?:校)?自创题[）)]\s*$"
OPTION_LABEL = r"^[（(]?\s*([A-G])\s*(?:[）)]\s*|[.、．]\s*|\s+(?=[0-9$\\\[{(+-])|$)"
SHORT = ["short_answer", "fill_in"]
NO_STOP = 2**31 - 1
LABELS = list("ABCDEFG")


def in_pages(lines: DataFrame, first: int, last: int) -> DataFrame:
    """Lines of the pages from `first` to `last`."""
    return lines.where(F.col("page_no").between(first, last))


def answer_starts(lines: DataFrame) -> DataFrame:
    """doc_id, stop: the first answer heading of each document, NO_STOP without one."""
    return lines.groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.col("text").rlike(ANSWER_HEADING), F.col("order"))), F.lit(NO_STOP)).alias("stop"))


def question_starts(lines: DataFrame) -> DataFrame:
    """doc_id, number, order: the line at which each question starts before the answers. A bare dotted number comes
    before a bare one in parentheses, then dotted and parenthesised ones with text; the earliest on ties."""
    stops = answer_starts(lines)
    rows = lines.where(~F.col("text").rlike(PLACEHOLDER)).join(stops, "doc_id").where(F.col("order") < F.col("stop"))
    dotted, bracketed = F.col("text").rlike(DOT_NUMBER), F.col("text").rlike(PAREN_NUMBER)
    rest = strip(F.regexp_replace("text", F.when(dotted, F.lit(DOT_NUMBER)).otherwise(F.lit(PAREN_NUMBER)), F.lit("")))
    priority = F.when(dotted, F.when(rest == "", 3).otherwise(1)).otherwise(F.when(rest == "", 2).otherwise(0))
    found = rows.where(dotted | bracketed).select("doc_id", question_number(F.col("text")).alias("number"), priority.alias("priority"), F.col("order").alias("line_no"))
    return best_start(found).withColumnRenamed("line_no", "order")


def find_markers(wanted: DataFrame, lines: DataFrame) -> DataFrame:
    """question_id, at, confidence for `wanted` (question_id, doc_id, number, marker, low, high): the first line in
    [low, high) that holds the marker; failing that the line, or pair of neighbouring lines, that covers most of it, if
    that is enough for the marker's length. A line that carries another question's number is never taken."""
    marks = wanted.withColumn("marker", normalize_marker(F.col("marker"))).where("marker <> ''")
    rows = marks.join(lines.select("doc_id", "order", "text"), "doc_id").where("order >= low and order < high")
    own = F.coalesce(question_number(F.col("text")).cast("string") == F.col("number"), F.lit(True)) | (F.coalesce("number", F.lit("")) == "")
    rows = rows.withColumn("own", own).withColumn("line", normalize_marker(F.col("text")))
    exact = rows.where(F.col("own") & F.contains("line", "marker")).groupBy("question_id").agg(F.min("order").alias("at"), F.lit(1.0).alias("confidence"))
    left = rows.join(exact.select("question_id"), "question_id", "left_anti")
    after = F.lead("text").over(Window.partitionBy("question_id").orderBy("order"))
    left = left.withColumn("pair", normalize_marker(F.concat("text", after))).where("own")
    scored = left.withColumn("one", marker_coverage("marker", "line")).withColumn("two", marker_coverage("marker", F.coalesce("pair", F.lit(""))))
    best = scored.groupBy("question_id", "marker").agg(F.max(F.struct("one", -F.col("order"))).alias("one"), F.max(F.when(F.col("two").isNotNull(), F.struct("two", -F.col("order")))).alias("two"))
    pair = F.col("two.two") > F.coalesce("one.one", F.lit(-1.0))
    best = best.select("question_id", "marker", F.when(pair, -F.col("two.col2")).otherwise(-F.col("one.col2")).alias("at"), F.when(pair, F.col("two.two")).otherwise(F.col("one.one")).alias("confidence"))
    fuzzy = best.where(accept_marker(F.col("marker"), F.col("confidence"))).select("question_id", "at", "confidence")
    return exact.unionByName(fuzzy)


def first_options(questions: DataFrame, lines: DataFrame) -> DataFrame:
    """question_id, option_at: for choice questions (with low and stop) the first option line in [low, stop)."""
    labelled = lines.where(F.col("text").rlike(OPTION_LABEL)).select("doc_id", "order")
    rows = questions.where(F.col("qtype").isin(CHOICE)).join(labelled, "doc_id").where("order >= low and order < stop")
    return rows.groupBy("question_id").agg(F.min("order").alias("option_at"))


def _next_starts(questions: DataFrame, starts: DataFrame, other_number: bool) -> DataFrame:
    """question_id, next_at: the first question start behind `low`."""
    rows = questions.join(starts.select("doc_id", "order", F.col("number").alias("_n")), "doc_id").where("order > low")
    rows = rows.where(~(F.col("_n").cast("string") == F.col("number"))) if other_number else rows
    return rows.groupBy("question_id").agg(F.min("order").alias("next_at"))


def resolve_stems(questions: DataFrame, lines: DataFrame) -> DataFrame:
    """question_id, low, high, status, confidence, rule: the lines of a stem by its start and end markers. A choice
    question's stem ends before its first option, a short-answer one before the next question (a composite's at its end
    marker, if that is earlier), any other at its end marker; nothing reaches into the next question, the options or the
    answers. Questions without a usable start marker are left out."""
    stops, starts = answer_starts(lines), question_starts(lines)
    q = questions.join(stops, "doc_id").withColumn("number", F.col("number").cast("string"))
    begun = find_markers(q.select("question_id", "doc_id", "number", F.col("start_marker").alias("marker"), F.lit(-1).alias("low"), F.col("stop").alias("high")), lines)
    q = q.join(begun.select("question_id", F.col("at").alias("start_at"), F.col("confidence").alias("start_sure")), "question_id")
    here = lines.select("doc_id", F.col("order").alias("start_at"), F.col("page_no").alias("_page"), question_number(F.col("text")).cast("string").alias("_own"))
    q = q.join(here, ["doc_id", "start_at"])
    # The bare number line, up to three lines before the marker on its page.
    numbered = lines.select("doc_id", F.col("order").alias("_o"), F.col("page_no").alias("_page"), question_number(F.col("text")).cast("string").alias("number")).where("number is not null")
    before = q.where(~F.col("_own").eqNullSafe(F.col("number"))).select("question_id", "doc_id", "number", "_page", "start_at", "stop").join(numbered, ["doc_id", "number", "_page"])
    before = before.where("_o < start_at and _o >= start_at - 3 and _o < stop").groupBy("question_id").agg(F.max("_o").alias("before"))
    q = q.join(before, "question_id", "left").withColumn("low", F.coalesce("before", "start_at"))
    ended = find_markers(q.select("question_id", "doc_id", "number", F.col("end_marker").alias("marker"), "low", F.col("stop").alias("high")), lines)
    q = q.join(ended.select("question_id", F.col("at").alias("end_at"), F.col("confidence").alias("end_sure")), "question_id", "left")
    q = q.join(lines.select("doc_id", F.col("order").alias("end_at"), F.col("text").rlike(OPTION_LABEL).alias("_end_option")), ["doc_id", "end_at"], "left")
    q = q.join(first_options(q, lines), "question_id", "left").join(_next_starts(q, starts, False), "question_id", "left")
    last = lines.join(stops, "doc_id").where("order < stop").groupBy("doc_id").agg(F.max("order").alias("last"))
    q = q.join(last, "doc_id", "left")
    stop = F.when(F.col("stop") < NO_STOP, F.col("stop") - 1)
    bound = F.coalesce(F.least(F.col("next_at") - 1, F.col("option_at") - 1, stop), F.col("last"))
    marked = F.when(F.col("_end_option"), F.col("end_at") - 1).otherwise(F.col("end_at"))
    by_option, by_next = F.col("qtype").isin(CHOICE) & F.col("option_at").isNotNull(), F.col("qtype").isin(SHORT) & F.col("next_at").isNotNull()
    joint = F.coalesce(F.col("is_composite"), F.lit(False)) | (F.size("shared_line_ids") > 0)
    high = F.when(by_option, F.least(F.col("option_at") - 1, bound)).when(by_next, F.least(F.col("next_at") - 1, F.when(joint, marked), stop)).otherwise(F.least(marked, bound))
    rule = (
        F.when(by_option, "first_option").when(by_next & joint & F.col("end_at").isNotNull(), "end_marker_or_next").when(by_next, "next_question")
        .when(F.col("end_at") > bound, "capped").when(F.col("end_at").isNotNull(), "end_marker").otherwise("boundary")
    )
    sure = F.least("start_sure", F.coalesce("end_sure", F.lit(1.0)))
    out = q.select("question_id", "low", high.alias("high"), F.when(sure >= 0.999, "semantic").otherwise("fuzzy").alias("status"), F.round(sure, 6).alias("confidence"), rule.alias("rule"))
    return out.where("high >= low")


def resolve_composites(questions: DataFrame, lines: DataFrame) -> DataFrame:
    """question_id, low, high, rule for composites without markers: from the first shared or stem line to the first
    option, the next question or the answers, whichever comes first."""
    q = questions.withColumn("number", F.col("number").cast("string")).join(answer_starts(lines), "doc_id")
    ids = q.select("question_id", "doc_id", F.explode(F.array_union("shared_line_ids", "stem_line_ids")).alias("line_id"))
    low = ids.join(lines.select("doc_id", "line_id", "order"), ["doc_id", "line_id"]).groupBy("question_id").agg(F.min("order").alias("low"))
    q = q.join(low, "question_id")
    q = q.join(first_options(q, lines), "question_id", "left").join(_next_starts(q, question_starts(lines), True), "question_id", "left")
    high = F.least(F.col("option_at") - 1, F.col("next_at") - 1, F.when(F.col("stop") < NO_STOP, F.col("stop") - 1))
    rule = F.when(F.col("option_at").isNotNull(), "first_option").when(F.col("next_at").isNotNull(), "next_question").otherwise("answers")
    return q.select("question_id", "low", high.alias("high"), rule.alias("rule")).where("high >= low")


def truncated_stems(questions: DataFrame, lines: DataFrame) -> DataFrame:
    """question_id, stem_line_ids cut before the next question: the first start of a larger number behind the question's
    own start (or its first stem line), or the answers. Numbers that are no digits stay as they are; unknown ids go."""
    own = F.col("number").cast("string").try_cast("int")
    q = questions.withColumn("_n", own).join(answer_starts(lines), "doc_id")
    starts = question_starts(lines)
    ids = q.select("question_id", "doc_id", F.posexplode("stem_line_ids").alias("pos", "line_id")).join(lines.select("doc_id", "line_id", "order"), ["doc_id", "line_id"])
    low = ids.groupBy("question_id").agg(F.min("order").alias("_low"))
    q = q.join(low, "question_id", "left").join(starts.select("doc_id", F.col("number").alias("_n"), F.col("order").alias("_own")), ["doc_id", "_n"], "left")
    later = q.join(starts.select("doc_id", F.col("number").alias("_m"), "order"), "doc_id").where((F.col("_m") > F.col("_n")) & (F.col("order") > F.coalesce("_own", "_low")))
    until = later.groupBy("question_id").agg(F.min("order").alias("_next"))
    q = q.join(until, "question_id", "left").withColumn("_until", F.least(F.coalesce("_next", "stop"), "stop"))
    kept = ids.join(q.select("question_id", "_until"), "question_id").where("order < _until").groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line_id"))), lambda r: r["line_id"]).alias("_kept"))
    untouched = F.col("_n").isNull() | F.col("_low").isNull()
    out = q.join(kept, "question_id", "left")
    return out.select("question_id", F.when(untouched, F.col("stem_line_ids")).otherwise(F.coalesce("_kept", F.array().cast("array<string>"))).alias("stem_line_ids"))


def _first_lines(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """`rows` (doc_id, ids) with `ids` cut to those that exist, and order and text of the first."""
    known = lines.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("line_id", F.struct("order", "text")))).alias("_lines"))
    out = rows.join(known, "doc_id", "left")
    out = out.withColumn("ids", F.filter("ids", lambda i: F.map_contains_key(F.col("_lines"), i)))
    first = F.col("_lines")[F.get("ids", F.lit(0))]
    return out.withColumn("_order", first["order"]).withColumn("_text", first["text"]).drop("_lines")


def validated_anchors(questions: DataFrame, lines: DataFrame) -> DataFrame:
    """question_id, field, line_ids, status (exact or retry), reason for stems and options. A stem must begin, before the
    answers, with the line of its own number (composites and shared material only before the answers); an option with a
    line of its label, at its head or inside."""
    stops = answer_starts(lines)
    stems = questions.select("question_id", "doc_id", F.lit("stem").alias("field"), F.lit(None).cast("string").alias("label"), F.col("number").cast("string").alias("number"), (F.coalesce(F.col("is_composite"), F.lit(False)) | (F.size("shared_line_ids") > 0)).alias("free"), F.col("stem_line_ids").alias("ids"))
    options = questions.select("question_id", "doc_id", F.col("number").cast("string").alias("number"), F.explode("options").alias("label", "ids"))
    options = options.select("question_id", "doc_id", F.concat(F.lit("option_"), F.col("label")).alias("field"), "label", "number", F.lit(False).alias("free"), "ids")
    rows = _first_lines(stems.unionByName(options), lines).join(stops, "doc_id", "left")
    stem_ok = F.col("free") | F.coalesce(question_number(F.col("_text")).cast("string") == F.col("number"), F.lit(False))
    inside = F.regexp_count("_text", F.concat(F.lit("(?<![A-Za-z0-9])"), F.col("label"), F.lit(r"\s*[.．、:：]"))) > 0
    option_ok = (F.regexp_extract("_text", OPTION_LABEL, 1) == F.col("label")) | inside
    reason = (
        F.when(F.size("ids") <= 0, "no_valid_lines").when(F.col("_order") >= F.col("stop"), "in_answers")
        .when(F.when(F.col("label").isNull(), stem_ok).otherwise(option_ok), "ok").otherwise("wrong_first_line")
    )
    none = F.array().cast("array<string>")
    return rows.select("question_id", "field", F.when(reason == "ok", F.col("ids")).otherwise(none).alias("line_ids"), F.when(reason == "ok", "exact").otherwise("retry").alias("status"), reason.alias("reason"))


def stems_without_options(anchors: DataFrame) -> DataFrame:
    """question_id, line_ids: validated stem lines that no validated option of the question holds."""
    options = anchors.where("field <> 'stem'").groupBy("question_id").agg(F.flatten(F.collect_list("line_ids")).alias("_taken"))
    rows = anchors.where("field = 'stem'").join(options, "question_id", "left")
    return rows.select("question_id", F.filter("line_ids", lambda i: ~F.array_contains(F.coalesce("_taken", F.array().cast("array<string>")), i)).alias("line_ids"))


def missing_labels(labels: Column, all_labels: list[str] = LABELS) -> Column:
    """The labels A-G that are not there, in order."""
    return F.array_except(F.array(*map(F.lit, all_labels)), labels)


def anchor_summary(anchors: DataFrame, *keys: str) -> DataFrame:
    """keys, summary: map status -> count."""
    counted = anchors.groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("summary"))


def provenance(rows: DataFrame, column: str) -> DataFrame:
    """column, n: how often each source or status occurs; null is its own."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
