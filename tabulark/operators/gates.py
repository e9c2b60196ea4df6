"""Quality score and admission rules as Column expressions: one pass, no Python.

A question row has: stem, qtype, section, options array<struct<label,text>>, answer, answer_source,
answer_confidence, answer_line_ids, explanation, explanation_source, anchors array<string>, issues array<string>,
is_composite, shared_line_ids, stem_line_ids, source_lines, sub_questions array<struct<qno,stem,answer,options>>,
images array<struct<page,bbox,source>>, word_bank, score, difficulty, nodes array<string>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulark.functions.similarity import ratio_reaches
from tabulark.functions.text import normalize_text

# Limits, deductions and lists of the rules.
STEM_LIMIT, COMPOSITE_LIMIT = 800, 3000
ANCHOR_ORDER = ["missing", "retry", "nearest", "fuzzy", "semantic", "exact"]
TRUSTED = ["document_answer_table", "document_inline_answer", "document_solution_answer", "native_extract", "ocr_extract"]
RELIABLE_TYPES = ["single_choice", "multiple_choice", "true_false", "cloze", "seven_to_five"]
CHOICE = ["single_choice", "multiple_choice"]
WORD_BANK_TYPES = ["word_bank", "word_bank_cloze", "选词填空"]
BAD_CHARS = r"[\uE000-\uF8FF\uFFFD]|[\x{F0000}-\x{FFFFD}]|[\x{100000}-\x{10FFFD}]"
INVISIBLE = r"[\u200B-\u200F\u2028-\u202F\u2060-\u206F\uFEFF]"
PUNCT_ONLY = r"(?U)^[\s，。；：、.．!！?？\-—…]+$"
STRAY_LATEX = r"\\[a-zA-Z]+\s*\{\s*\}|\\(?:begin|end|hline|label|ref)\b"
BLOCK = "禁止自动发布"
FORMULA_HINT = r"\\frac|\\sqrt|\\sum|\\int|sin|cos|tan|log|√|π|°"
SYMBOLS_ONLY = r"^[0-9+\-*/^().,，。;；=<>≤≥∞π√]+$"


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def worst_anchor(anchors: Column) -> Column:
    """The worst status present; exact without anchors."""
    ranks = F.transform(anchors, lambda a: F.array_position(F.array(*map(F.lit, ANCHOR_ORDER)), a).cast("int"))
    known = F.filter(ranks, lambda r: r > 0)
    return F.when(F.size(known) > 0, F.element_at(F.array(*map(F.lit, ANCHOR_ORDER)), F.array_min(known))).otherwise("exact")


def stem_limit(q: DataFrame) -> Column:
    long_form = q["is_composite"] | (F.size("shared_line_ids") > 0) | F.contains(F.coalesce(q["stem"], F.lit("")), F.lit("材料")) | (q["qtype"] == "short_answer")
    return F.when(long_form, COMPOSITE_LIMIT).otherwise(STEM_LIMIT)


def suspicious(answer: Column) -> Column:
    outside_math = F.regexp_replace(answer, r"\$[^$]*\$", "")
    return ~blank(answer) & (answer.rlike(BAD_CHARS) | outside_math.rlike(STRAY_LATEX))


def quality_score(q: DataFrame) -> DataFrame:
    """`q` with confidence in [0, 1], the issues found and whether publishing is blocked."""
    source, n_options = F.coalesce(q["answer_source"], F.lit("")), F.size("options")
    expected = F.when(F.coalesce(q["section"], F.lit("")).rlike("七选五|7选5|7选七"), 7).otherwise(4)
    choice = q["qtype"].isin(CHOICE) & ~q["is_composite"]
    worst = worst_anchor(q["anchors"])
    doubt = F.exists("issues", lambda i: F.contains(i, F.lit("答案可疑"))) | ((source == "document_answer_table") & (q["answer_confidence"] < 0.8)) | suspicious(q["answer"])
    annotated = source == "llm_annotation"
    rules = [  # condition, deduction, issue, blocks
        (worst == "missing", 0.5, "锚点缺失", True),
        (worst == "retry", 0.4, "锚点需重新标注", True),
        (blank(q["stem"]), 0.5, "题干为空", False),
        (F.length(F.coalesce(q["stem"], F.lit(""))) > stem_limit(q), 0.4, "题干异常膨胀", False),
        (choice & (n_options == 0), 0.5, "选项锚点缺失", True),
        (choice & (n_options > 0) & (n_options < expected), 0.3, "选项数量不足", False),
        (choice & (n_options > expected), 0.1, "选项数量过多", False),
        (q["answer"].isNull() & (source == "llm_fallback"), 0.2, "答案依赖兜底", False),
        (doubt, 0.5, "答案可疑", True),
        (annotated & (blank(q["answer"]) | q["answer"].rlike(PUNCT_ONLY)), 0.5, "答案切片为空或仅标点", True),
        (annotated & (F.size("answer_line_ids") <= 0), 0.4, "答案缺少有效行号", True),
        (q["explanation"].isNull() & (F.coalesce(q["explanation_source"], F.lit("")) == "llm_fallback"), 0.1, "详解依赖兜底", False),
        ((source == "llm_fallback") & (F.coalesce(q["answer"], F.lit("")) == ""), 0.3, "答案缺失", True),
    ]
    yes = [F.coalesce(cond, F.lit(False)) for cond, *_ in rules]
    score = F.lit(1.0) - F.size("issues") * 0.05
    for cond, (_, minus, _, _) in zip(yes, rules):
        score = score - F.when(cond, minus).otherwise(0.0)
    found = F.filter(F.array(*[F.when(cond, f"{name}，{BLOCK}" if stop else name) for cond, (_, _, name, stop) in zip(yes, rules)]), lambda x: x.isNotNull())
    all_issues = F.concat(q["issues"], found)
    return q.withColumn("confidence", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)).withColumn("all_issues", all_issues).withColumn(
        "blocked", F.exists("all_issues", lambda i: F.contains(i, F.lit(BLOCK)))
    )


def quality_counters(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count_if(F.col("confidence") >= 0.8).alias("high"), F.count_if(F.col("confidence") < 0.5).alias("low"), F.count_if("blocked").alias("blocked"))


def rule_checks(q: DataFrame, norm=normalize_text) -> DataFrame:
    """`q` with r01..r17: whether each rule passes, as far as built-in expressions tell. R02 and R08 also need
    sequence ratios; see `admit`."""
    stem, answer = norm(q["stem"]), norm(q["answer"])
    n_options, choice = F.size("options"), q["qtype"].isin(CHOICE) & ~q["is_composite"]
    labels = F.sort_array(F.transform("options", lambda o: o["label"]))
    inside = F.size(F.filter("options", lambda o: ~blank(o["text"]) & F.contains(F.coalesce(q["answer"], F.lit("")), o["text"])))
    source, why = F.coalesce(q["answer_source"], F.lit("")), F.coalesce(q["explanation_source"], F.lit(""))
    trusted = source.isin(TRUSTED) | ((source == "llm_annotation") & q["qtype"].isin(RELIABLE_TYPES))
    subs_bad = F.exists("sub_questions", lambda s: blank(s["qno"]) | blank(s["stem"]) | blank(s["answer"]))
    images_bad = F.exists("images", lambda i: i["page"].isNull() | i["bbox"].isNull() | blank(i["source"]))
    checks = {
        "r01": ~blank(q["stem"]),
        "r02": ~((~blank(q["answer"]) & (stem == answer)) | (inside >= 3)),
        "r03": F.length(F.coalesce(q["stem"], F.lit(""))) <= stem_limit(q),
        "r04": ~(((q["qtype"] == "true_false") & (n_options != 2)) | (choice & ((n_options == 0) | (n_options > 7)))),
        "r05": ~choice | (labels == F.slice(F.array(*map(F.lit, "ABCDEFG")), 1, F.greatest(n_options, F.lit(0)))),
        "r06": trusted & (F.coalesce(q["answer_confidence"], F.lit(0.0)) >= 0.5),
        "r07": ~((source.isin(TRUSTED) & why.startswith("llm")) | ((source == "llm_fallback") & (why == "llm_fallback"))),
        "r09": blank(q["explanation"]) | (norm(q["explanation"]) != answer),
        "r10": blank(q["explanation"]) | (F.length(F.trim("explanation")) > 3),
        "r11": q["score"].isNotNull() & q["difficulty"].isNotNull() & ~blank(q["section"]) & (F.size("nodes") > 0),
        "r12": blank(q["answer"]) | ~(q["answer"].rlike(BAD_CHARS) | q["answer"].rlike(INVISIBLE) | q["answer"].rlike(PUNCT_ONLY)),
        "r13": ~q["is_composite"] | ((F.size("sub_questions") > 0) & F.exists("sub_questions", lambda s: ~blank(s["answer"]))),
        "r14": ~q["is_composite"] | ~F.contains(F.coalesce(q["stem"], F.lit("")), F.lit("材料")) | (F.size("shared_line_ids") > 0),
        "r15": ~q["qtype"].isin(WORD_BANK_TYPES) | (F.size("word_bank") > 0),
        "r16": ~images_bad,
        "r17": ~q["is_composite"] | ~subs_bad,
    }
    for name, ok in checks.items():
        q = q.withColumn(name, F.coalesce(ok, F.lit(True)))
    return q


REJECTING, REVIEWING = ["r01", "r02", "r03", "r04", "r08", "r12"], ["r05", "r06", "r07", "r09", "r13", "r14", "r15", "r16", "r17"]


def admit(q: DataFrame, norm=normalize_text) -> DataFrame:
    """`q` with decision (approve, review, reject), reason and the checks recorded. Rejecting rules run first and
    stop at the first failure. Sequence ratios are computed for the rows that the cheap rules let through only."""
    cheap = rule_checks(q, norm)
    go_on = F.col("r01") & F.col("r02") & F.col("r03") & F.col("r04")
    undecided = ~blank(F.col("stem")) & F.coalesce(F.length("stem") <= stem_limit(q), F.lit(True))
    for c, text in (("stem", F.col("stem")), ("answer", F.col("answer")), ("source_lines", F.when(undecided, F.col("source_lines")))):
        cheap = cheap.withColumn(f"_{c}", F.when(go_on, norm(text)))  # the same calls as in rule_checks, so that one Python stage makes them all
    stem, answer, lines = F.col("_stem"), F.col("_answer"), F.col("_source_lines")
    asked = (F.length(stem) > 20) & ~blank(F.col("answer"))
    alike = asked & (F.contains(answer, stem) | ratio_reaches(F.when(asked, stem), answer, 0.8))
    rows = cheap.withColumn("r02", F.col("r02") & ~F.coalesce(alike, F.lit(False)))
    # Without line references the rule is of the reviewing kind and never decides.
    free = (F.size("stem_line_ids") <= 0) | blank(F.col("source_lines"))
    rows = rows.withColumn("r08", stem.isNull() | free | F.contains(lines, stem) | ratio_reaches(F.when(~free, stem), lines, 0.7)).drop("_stem", "_answer", "_source_lines")
    first_reject = F.coalesce(*[F.when(~F.col(r), F.lit(r)) for r in REJECTING])
    reviews = F.filter(F.array(*[F.when(~F.col(r), F.lit(r)) for r in REVIEWING]), lambda x: x.isNotNull())
    decision = F.when(first_reject.isNotNull(), "reject").when(F.size(reviews) > 0, "review").otherwise("approve")
    upto = F.array_position(F.array(*map(F.lit, REJECTING)), first_reject).cast("int")
    n_checks = F.when(first_reject.isNotNull(), upto).otherwise(len(REJECTING) + len(REVIEWING) + 2)
    return rows.withColumn("decision", decision).withColumn("reason", F.coalesce(first_reject, F.array_join(reviews, "; "))).withColumn("n_checks", n_checks)


def decision_distribution(admitted: DataFrame) -> DataFrame:
    return admitted.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


def top_reasons(admitted: DataFrame, k: int = 10) -> DataFrame:
    rows = admitted.where("decision <> 'approve'").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return rows.orderBy(F.desc("n"), "reason").limit(k)


def rule_failures(admitted: DataFrame, rules: list[str]) -> DataFrame:
    rows = admitted.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("passed")) for r in rules])).alias("c"))
    return rows.select("c.*").groupBy("rule").agg(F.count_if(~F.col("passed")).alias("failed"), F.count(F.lit(1)).alias("n"))


def discard_histogram(rows: DataFrame, issues: str) -> DataFrame:
    """Each distinct issue of a row counts once."""
    return rows.select(F.explode(F.array_distinct(issues)).alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


# --- answers -------------------------------------------------------------------------------------------------


def answer_quality(answer: Column, stem: Column) -> Column:
    """struct(confidence, doubts) of a document's answer: 0.95, or 0.4 if formula text was lost on the way: private-use
    or replacement characters, LaTeX outside $...$, or a few symbols where the stem speaks of formulas."""
    text = F.coalesce(answer, F.lit(""))
    bare = F.regexp_replace(text, r"(?U)\s+", "")
    crumbs = F.coalesce(stem, F.lit("")).rlike(FORMULA_HINT) & F.length(bare).between(2, 4) & bare.rlike(SYMBOLS_ONLY)
    doubts = [(text.rlike(r"[\uE000-\uF8FF]"), "private_use"), (text.rlike("\uFFFD"), "replacement"), (F.regexp_replace(text, r"\$[^$]*\$", "").rlike(r"\\[a-zA-Z]+"), "bare_latex"), (crumbs, "lost_symbols")]
    found = F.filter(F.array(*[F.when(cond, F.lit(name)) for cond, name in doubts]), lambda x: x.isNotNull())
    return F.struct(F.when(F.size(found) > 0, 0.4).otherwise(0.95).alias("confidence"), found.alias("doubts"))


def answer_cascade(table: Column, solution: Column, inline: Column, fallback: Column, stem: Column) -> Column:
    """struct(answer, source, confidence, doubts) of the first candidate that is not blank: the answer table, the worked
    solution (both judged by `answer_quality`), an inline answer, the fallback."""
    sure = lambda c: F.struct(F.lit(c).alias("confidence"), F.array().cast("array<string>").alias("doubts"))
    pick = lambda a, s, q: F.struct(a.alias("answer"), F.lit(s).alias("source"), q["confidence"].alias("confidence"), q["doubts"].alias("doubts"))
    return (
        F.when(~blank(table), pick(table, "document_answer_table", answer_quality(table, stem))).when(~blank(solution), pick(solution, "document_solution_answer", answer_quality(solution, stem)))
        .when(~blank(inline), pick(inline, "document_inline_answer", sure(0.9))).otherwise(pick(fallback, "llm_fallback", sure(0.5)))
    )


def choice_override(annotated: Column, table: Column, from_ocr: Column) -> Column:
    """A letter answer of the table replaces the annotated one, unless it comes from OCR and contradicts a
    valid letter."""
    letters = lambda c: F.upper(F.replace(F.trim(c), F.lit(" "), F.lit(""))).rlike(r"^[A-G]{1,7}$")
    keep = from_ocr & letters(annotated) & (F.upper(F.trim(annotated)) != F.upper(F.trim(table)))
    return F.when(letters(table) & ~F.coalesce(keep, F.lit(False)), table).otherwise(annotated)


def match_answers(rows: DataFrame) -> DataFrame:
    """Rows (question, qtype, stem, is_composite, annotated, table, from_ocr, solution, inline) with `final`:
    struct(answer, source, confidence, doubts). A composite with an answer keeps it. Otherwise a letter of the answer
    table comes first unless recognition contradicts a valid annotated letter; then the annotation (of a choice question
    letters only); then the document's own answers in order."""
    letters = lambda c: F.coalesce(F.upper(F.replace(F.trim(c), F.lit(" "), F.lit(""))).rlike(r"^[A-G]{1,7}$"), F.lit(False))
    choice = F.col("qtype").isin(CHOICE)
    annotated = F.when(~blank(F.col("annotated")) & (~choice | letters(F.col("annotated"))), F.col("annotated"))
    document = answer_cascade(F.col("table"), F.col("solution"), F.col("inline"), F.lit(None).cast("string"), F.col("stem"))
    own = F.struct(annotated.alias("answer"), F.lit("llm_annotation").alias("source"), F.lit(0.9).alias("confidence"), F.array().cast("array<string>").alias("doubts"))
    conflict = F.coalesce(F.col("from_ocr"), F.lit(False)) & letters(annotated) & (F.upper(F.trim(annotated)) != F.upper(F.trim("table")))
    by_table = letters(F.col("table")) & ~F.coalesce(conflict, F.lit(False))
    kept = F.col("is_composite") & ~blank(F.col("annotated"))
    return rows.withColumn("final", F.when(kept, own.withField("answer", F.col("annotated"))).when(by_table | annotated.isNull(), document).otherwise(own))
