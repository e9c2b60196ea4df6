"""Exam-specific text rules as Column functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulark.functions.patterns import BREAK, BREAK_2, strip

# Subjects, exam words, and words before or after which a number is no blank.
SUBJECTS = ["化学", "生物", "地理", "语文", "数学", "英语", "物理", "历史", "政治"]
EXAM_WORDS = ["期末", "模拟", "期中", "高考", "中考", "月考", "联考", "统考", "测试", "真题", "教师版", "学生版"]
TEXT_SUBJECTS = ["英语", "语文", "历史", "政治", "地理"]
UNITS_BEFORE = (
    "age ages year years month months week weeks day days hour hours minute minutes second seconds time times score scores grade grades level levels number numbers count counts amount amounts price prices "
    "cost costs distance length height weight page pages chapter chapters section sections version versions part parts percent percentage ratio rate value size population temperature"
).split()
MONTHS = "january february march april may june july august september october november december jan feb mar apr jun jul aug sep oct nov dec".split()
UNITS_AFTER = ["st", "nd", "rd", "th", "%", "％", "号", "岁", "年", "月", "日", "点", "分", "秒"]
PAGE_FOOTER = r"^\s*第\s*\d+\s*页/共\s*\d+\s*页\s*$"
ANSWER_LEADS = [r"^【答案】\s*", r"^\s*(?:故选|答案为|答案是|故答案为|答案[：:]|选(?=\s*[A-D]))\s*"]
SOLUTION_SCORE = r"(?:\s*…+\s*\d+\s*分|\s*[（(]\s*\d+\s*分\s*[）)]|\s*\d+\s*分)\s*$"
DOTTED_INSIDE = r"(?<=[^A-Za-z0-9])(?!\d\.\d)\d{1,3}\s*[.、．]"
PAREN_INSIDE = r"(?<=[^\x00-\x7f]|[\t-\r ])（\s*\d{1,3}\s*）(?![\x00-\x08\x0e-\x1f!-\x7f])"
OPTION_MARK = r"[A-G]\s*[.、．]|[（(]\s*[A-G]\s*[）)]"
MATH_MARK = r"\\(?:frac|sqrt|sum|sin|cos|tan|log|lg|ln|forall|exists|geq|leq|neq)|[\^_]\{"
BODY_KEYS = ["text", "content", "body", "stem", "latex", "formula", "question", "option", "answer_text", "explanation"]
SUBJECT_KEYWORDS = {
    "英语": ["英语", "English", "ENG"], "数学": ["数学", "Mathematics", "MATH"], "语文": ["语文", "Chinese", "CHN"], "物理": ["物理", "Physics", "PHYS"], "化学": ["化学", "Chemistry", "CHEM"],
    "生物": ["生物", "Biology", "BIO"], "政治": ["政治", "Politics", "POLI"], "历史": ["历史", "History", "HIST"], "地理": ["地理", "Geography", "GEOG"],
}
CONTENT_KEYWORDS = {
    "英语": ["完形填空", "阅读理解", "七选五", "语法填空", "书面表达", "Cloze", "Reading"], "数学": ["函数", "导数", "三角", "数列", "概率", "立体几何", "解析几何"],
    "语文": ["现代文阅读", "文言文", "古诗", "默写", "写作"], "物理": ["力学", "电学", "电磁感应", "实验题", "计算题"], "化学": ["化学方程式", "有机化学", "无机化学", "工艺流程"],
}
SUB_DIGITS, SUPER_DIGITS = "₀₁₂₃₄₅₆₇₈₉", "⁰¹²³⁴⁵⁶⁷⁸⁹"


def subject_of_file(name: Column) -> Column:
    """The subject in a file name, if an exam word stands in it or the subject begins in its first seven characters."""
    found = F.regexp_extract(name, "(" + "|".join(SUBJECTS) + ")", 1)
    exam = name.rlike("|".join(EXAM_WORDS))
    return F.when((found != "") & (exam | (F.instr(name, found) <= 7)), found)


def detect_subject(metadata: Column, filename: Column, text: Column) -> Column:
    """The subject that is given, else the first one with a keyword in the file name (letter case ignored), else the
    first one with a keyword in the first 50 lines of the text, else 未知."""
    has = lambda c, words: F.coalesce(F.reduce(F.array(*[F.contains(c, F.lit(w)) for w in words]), F.lit(False), lambda a, b: a | b), F.lit(False))
    given, name, head = strip(F.coalesce(metadata, F.lit(""))), F.lower(filename), F.substring_index(text, "\n", 50)
    out = F.when(given != "", given)
    for subject, words in SUBJECT_KEYWORDS.items():
        out = out.when(has(name, [w.lower() for w in words]), subject)
    for subject, words in CONTENT_KEYWORDS.items():
        out = out.when(has(head, words), subject)
    return out.otherwise("未知")


def mark_blanks(text: Column, numbers: Column, subject: Column) -> Column:
    """Blank positions become 〔N〕: explicit {N}, (N) and __N__ in every subject; in text subjects also a lone
    number that is one of `numbers` (array<string>), unless units, months, ordinals, ranges or decimals protect it."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\{(\d+)\}", "〔$1〕")
    out = F.regexp_replace(out, r"[（(](\d+)[）)]", "〔$1〕")
    out = F.regexp_replace(out, r"_+\s*(\d+)\s*_+", "〔$1〕")
    before = rf"(?<![〔\d%])(?<![-–—/]\s{{0,3}})(?<!(?<![A-Za-z])(?i:{'|'.join(UNITS_BEFORE + MONTHS)})\s{{0,3}})(?<!第\s{{0,3}})"
    after = rf"(?!\.\d|[\d〕%％])(?!\s{{0,3}}(?:[-–—/]|(?i:{'|'.join(UNITS_AFTER)})))"
    lone = F.aggregate(F.coalesce(numbers, F.array().cast("array<string>")), out, lambda t, n: F.regexp_replace(t, F.concat(F.lit(before + "("), n, F.lit(")" + after)), F.lit("〔$1〕")))
    return F.when(subject.isin(TEXT_SUBJECTS), lone).otherwise(out)


def _scripts(text: str | None) -> str | None:
    if not text:
        return text
    low = str.maketrans("0123456789", SUB_DIGITS)
    high = str.maketrans("0123456789+-−﹣－", SUPER_DIGITS + "⁺⁻⁻⁻⁻")
    text = re.sub(r"([A-Za-z]{1,3}|\([A-Za-z0-9]+\))\((\d+)\)", lambda m: m[1] + m[2].translate(low), text)
    return re.sub(r"\((\d*[-+−﹣－]|[-+−﹣－]\d*)\)", lambda m: m[1].translate(high), text)


@F.pandas_udf(T.StringType())
def chemistry(s: pd.Series) -> pd.Series:
    """Parenthesized subscripts and charges as sub- and superscript characters."""
    return s.map(_scripts)


def clean_answer(number: Column, text: Column) -> Column:
    """An answer without its lead-in words, its own question number, a score and closing punctuation."""
    out = strip(F.regexp_replace(F.coalesce(text, F.lit("")), PAGE_FOOTER, ""))
    for lead in ANSWER_LEADS:
        out = strip(F.regexp_replace(out, lead, ""))
    quoted = F.concat(F.lit("\\Q"), number.cast("string"), F.lit("\\E"))
    own = [F.concat(F.lit(r"^[（(]\s*"), quoted, F.lit(r"\s*[）)]\s*")), F.concat(F.lit("^"), quoted, F.lit(r"[.、．](?!\d)\s*"))]
    for p in own:
        out = F.when(F.coalesce(number.cast("string"), F.lit("")) != "", strip(F.regexp_replace(out, p, F.lit("")))).otherwise(out)
    out = strip(F.regexp_replace(out, SOLUTION_SCORE, ""))
    return strip(F.regexp_replace(out, r"[。.．!！?？]+$", ""))


def break_numbers(text: Column) -> Column:
    """array<string>: a line parted before question numbers inside it. A dotted number counts unless it is a decimal,
    follows an ASCII letter or digit, or stands within five characters of a chemical dot; a number in full-width
    parentheses counts if it is the line's only one and has no ASCII neighbour."""
    marked = F.regexp_replace(text, DOTTED_INSIDE, BREAK + "$0")
    paren = F.regexp_replace(marked, PAREN_INSIDE, BREAK_2 + "$0")
    marked = F.when(F.regexp_count(text, F.lit(r"（\s*\d{1,3}\s*）")) == 1, paren).otherwise(marked)
    parts = F.split(marked, f"(?=[{BREAK}{BREAK_2}])")
    bare = lambda p: F.translate(p, BREAK + BREAK_2, "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("tail"))

    def join(state, part):
        piece, out = bare(part), state["out"]
        chemical = F.startswith(part, F.lit(BREAK)) & F.concat(state["tail"], F.substring(piece, 1, 5)).rlike(r"[A-Z][a-z]?\d*·[A-Z]")
        longer = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.concat(F.element_at(out, -1), piece)))
        return F.struct(F.when((F.size(out) > 0) & chemical, longer).otherwise(F.concat(out, F.array(piece))).alias("out"), F.right(F.concat(state["tail"], piece), F.lit(5)).alias("tail"))

    return F.filter(F.transform(F.aggregate(parts, start, join)["out"], strip), lambda p: p != "")


def break_options(text: Column) -> Column:
    """array<string>: a line with two option marks (`A.` or `(A)`) or more, parted before each."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(text, OPTION_MARK, BREAK + "$0"), BREAK), strip), lambda p: p != "")
    return F.when(F.regexp_count(text, F.lit(OPTION_MARK)) >= 2, parts).otherwise(F.array(text))


def _expanded(lines: DataFrame, parts: Column, part: str, name: str) -> DataFrame:
    whole = F.coalesce(F.col("block_type"), F.lit("text")) == "table"
    return lines.select("*", F.posexplode(F.when(whole, F.array("text")).otherwise(parts)).alias(part, name))


def expand_number_lines(lines: DataFrame) -> DataFrame:
    """Lines parted before the question numbers inside them (number_part from 0, number_text); tables stay whole."""
    return _expanded(lines, break_numbers(F.col("text")), "number_part", "number_text")


def expand_option_lines(lines: DataFrame) -> DataFrame:
    """Lines with two option marks or more become one line per option (part from 0); tables stay whole."""
    return _expanded(lines, break_options(F.col("text")), "part", "option_text")


def option_table_lines(html: Column) -> Column:
    """array<string>: a table whose cells are options, one line per option; any other table in one line. Three layouts:
    cells that begin with their labels side by side, a row of labels over rows of texts, or a label at the head of
    each row. Other rows of an option table become lines of their own, cells joined by `，`."""
    cells = lambda row: F.transform(F.regexp_extract_all(row, F.lit(r"(?s)<td[^>]*>(.*?)</td>"), 1), lambda c: strip(F.regexp_replace(c, r"<(?!img\b)[^>]+>", "")))
    rows = F.filter(F.transform(F.regexp_extract_all(html, F.lit(r"(?s)<tr>(.*?)</tr>"), 1), cells), lambda r: F.size(r) > 0)
    tag, prefix = lambda c: c.rlike(r"^\s*[A-G]\s*[.、．]?\s*$"), lambda c: c.rlike(r"^\s*[A-G]\s*[.、．]\s*")
    label = lambda c: F.regexp_extract(c, r"([A-G])", 1)
    count = lambda r, test: F.size(F.filter(r, test))
    head = lambda r: F.get(r, F.lit(0))
    wide = F.filter(rows, lambda r: F.size(r) >= 2)
    filled = lambda r: F.filter(r, lambda c: c != "")
    text_of = lambda r: F.array_join(filled(r), "，")
    labelled = lambda name, content: F.when(content != "", F.concat(name, F.lit(". "), content)).otherwise(F.concat(name, F.lit(".")))
    answers = F.exists(wide, lambda r: F.exists(F.slice(r, 1, 2), lambda c: c.isin("题号", "答案")))
    first = F.get(rows, F.lit(0))
    first_prefixed = F.coalesce((F.size(first) >= 2) & ~tag(head(first)) & prefix(head(first)), F.lit(False))
    is_options = ~answers & ((count(wide, lambda r: tag(head(r))) >= 2) | first_prefixed | F.exists(wide, lambda r: (count(r, prefix) >= 2) | (count(r, tag) >= 2)))
    side_by_side = F.flatten(F.transform(rows, lambda r: F.when(count(r, prefix) >= 2, filled(r)).otherwise(F.array(text_of(r)))))
    rest = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
    under = lambda i: F.array_join(F.filter(F.transform(rest, lambda r: F.coalesce(F.get(r, i), F.lit(""))), lambda c: c != ""), "，")
    columns = F.filter(F.transform(first, lambda c, i: F.when(tag(c), labelled(label(c), under(i)))), lambda x: x.isNotNull())
    tail = lambda r: text_of(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))))
    by_row = F.transform(rows, lambda r: F.when((F.size(r) >= 2) & tag(head(r)), labelled(label(head(r)), tail(r))).otherwise(text_of(r)))
    lines = F.when(F.exists(rows, lambda r: count(r, prefix) >= 2), side_by_side).when((F.size(first) >= 2) & (count(first, tag) >= 2), columns).otherwise(by_row)
    return F.when(is_options, F.filter(lines, lambda x: strip(x) != "")).otherwise(F.array(strip(F.regexp_replace(html, r"(?U)\s+", " "))))


def options_of_lines(refs: DataFrame, lines: DataFrame) -> DataFrame:
    """question_id, label, text from a map label -> line ids: the lines' texts joined in order. `refs` has question_id,
    doc_id and options map<string,array<int>>."""
    rows = refs.select("question_id", "doc_id", F.explode("options").alias("label", "nos")).select("question_id", "doc_id", "label", F.posexplode("nos").alias("pos", "line_no"))
    found = rows.join(lines.select("doc_id", "line_no", "text"), ["doc_id", "line_no"])
    return found.groupBy("question_id", "label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda r: r["text"]), "").alias("text"))


def answer_with_text(answer: Column, options: Column) -> Column:
    """`A. text；C. text` for the letters of an answer; null if none of them is an option."""
    letters = F.regexp_extract_all(F.upper(F.coalesce(answer, F.lit(""))), F.lit("([A-Z])"), 1)
    hit = F.filter(options, lambda o: F.array_contains(letters, F.upper(F.trim(o["label"]))))
    return F.when(F.size(hit) > 0, F.array_join(F.transform(hit, lambda o: F.concat(o["label"], F.lit(". "), o["text"])), "；"))


def number_label(n: Column, style: Column) -> Column:
    """n in decimal, letters (1 to 26) or roman numerals (1 to 3999)."""
    letter = F.when(n.between(1, 26), F.char(F.lit(64) + n))
    digit = lambda unit, one, five, ten: F.element_at(F.array(*map(F.lit, ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten])), (F.floor(n / unit) % 10 + 1).cast("int"))
    roman = F.when(n.between(1, 3999), F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), digit(100, "C", "D", "M"), digit(10, "X", "L", "C"), digit(1, "I", "V", "X")))
    plain = n.cast("string")
    return (
        F.when(style == "upperLetter", F.coalesce(letter, plain)).when(style == "lowerLetter", F.coalesce(F.lower(letter), plain)).when(style == "upperRoman", F.coalesce(roman, plain))
        .when(style == "lowerRoman", F.coalesce(F.lower(roman), plain)).otherwise(plain)
    )


def score_sequence(text: Column) -> Column:
    """All scores of a scoring text, joined by |, whole numbers without a fraction."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\d+(?:\.\d+)?)\s*分"), 1)
    return F.array_join(F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"(\.\d*?)0+$", "$1"), r"\.$", "")), "|")


def leaks_body(text: Column) -> Column:
    """Whether a short note carries body text: too long, or math marks."""
    return F.coalesce((F.length(text) > 200) | text.rlike(MATH_MARK) | (F.regexp_count(text, F.lit(r"\$")) >= 2), F.lit(False))


def answer_leaks(fields: Column) -> Column:
    """Whether an answer about a line (map<string,string>) carries body text: a body field of more than 20 characters,
    evidence of more than 200, or math marks in any field but line_id."""
    body = F.exists(F.map_entries(fields), lambda e: e["key"].isin(BODY_KEYS) & (F.length(e["value"]) > 20))
    math = F.exists(F.map_entries(fields), lambda e: (e["key"] != "line_id") & (e["value"].rlike(MATH_MARK) | (F.regexp_count(e["value"], F.lit(r"\$")) >= 2)))
    return F.coalesce(body, F.lit(False)) | F.coalesce(F.length(fields["evidence"]) > 200, F.lit(False)) | F.coalesce(math, F.lit(False))
