"""Extraction and splitting of question lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of numbered lines, options, answer tables and answer marks.
DOT_NUMBER = r"^\s*(\d{1,3})\s*\\?[.、．，](?!\d+(?:\s*[+\-*/=×÷xX\\]|$))(?!\\)"
PAREN_NUMBER = r"^\s*[（(]\s*(\d{1,3})\s*[）)]"
OPTION = r"[（(]\s*[A-D]\s*[）)]"
TABLE_ENTRY = r"[（(]\s*\d+\s*[）)]\s*[A-D]"
LINE_NUMBERS = [r"^\s*\d+\s*[.](?![\d\\])", r"^\s*\d+\s*、", r"^\s*[（(]\s*\d+\s*[）)]"]
OPTION_TAIL = r"[A-D]\s*[）)]"
FOOTER = r"^\s*第\s*\d+\s*页\s*[/／]?\s*共\s*\d+\s*页\s*$"
ANSWER_MARK = r"[（(]\s*\d{1,3}\s*[）)]|(?<![\d.、．])\d{1,3}[.、．](?!\d)"
ANSWER_LEAD, SCORE_TAIL = r"^【答案】\s*", r"（\d+\s*分）\s*$"
INLINE_OPTION = r"(?<![A-Za-z0-9])([A-G])\s*[.．、:：]\s*"
OCR_BRACKETS = [("ги", "（"), ("Ги", "（"), ("гй", "）"), ("Гй", "）")]
SECTIONS = [r"[一二三四五六七八九十]+、本大题", r"第[一二三四五六七八九十]+部分", r"第[一二三四五六七八九十]+节"]
ANSWER_SECTIONS = [r"参考答案", r"答案[：:]", r"(?i)Answer\s*Key", r"【答案】"]
BREAK, BREAK_2 = "\u0001", "\u0002"


def strip(c: Column) -> Column:
    """Without white space at the ends, Unicode's included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def question_number(text: Column) -> Column:
    """Leading number in dot (an escaped dot and a comma too) or parenthesis form, null without one. A decimal before an
    operator or the end is not a number; `5.2024年` is number 5."""
    dot, paren = F.regexp_extract(text, DOT_NUMBER, 1), F.regexp_extract(text, PAREN_NUMBER, 1)
    return F.coalesce(F.nullif(dot, F.lit("")), F.nullif(paren, F.lit(""))).try_cast("int")


def line_type(text: Column) -> Column:
    """answer_table before option before question_number before stem."""
    dot, comma, paren = (text.rlike(p) for p in LINE_NUMBERS)
    numbered = dot | comma | (paren & ~text.rlike(OPTION_TAIL))
    return F.when(text.rlike(TABLE_ENTRY), "answer_table").when(text.rlike(OPTION), "option").when(numbered, "question_number").otherwise("stem")


def _marked_parts(text: Column) -> Column:
    """Pieces of an answer line, each from its mark on; what stands before the first mark is dropped."""
    parts = F.split(F.regexp_replace(text, ANSWER_MARK, BREAK + "$0"), BREAK)
    return F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))


def table_entries(text: Column) -> Column:
    """array<struct<number, answer>> of a line of answers. Behind `(n)` an answer reaches to the next mark; behind `n.`
    to the next `n.` if that is the next mark, else to the end of the line, sub-steps included. Lead-in words go, and
    from short answers a score in parentheses; empty answers are left out."""
    parts = _marked_parts(text)
    dotted = lambda p: p.rlike(r"^\d")

    def entry(p, i):
        last = i + 1 >= F.size(parts)
        alone = ~dotted(p) | F.when(last, False).otherwise(dotted(F.get(parts, i + 1)))
        whole = F.when(alone, p).otherwise(F.array_join(F.slice(parts, i + 1, F.size(parts)), ""))
        answer = strip(F.regexp_replace(strip(F.regexp_replace(whole, r"^(?:[（(]\s*\d{1,3}\s*[）)]|\d{1,3}[.、．])", "")), ANSWER_LEAD, ""))
        answer = F.when(F.length(answer) <= 6, strip(F.regexp_replace(answer, SCORE_TAIL, ""))).otherwise(answer)
        return F.struct(F.regexp_extract(p, r"(\d+)", 1).try_cast("int").alias("number"), answer.alias("answer"))

    return F.filter(F.transform(parts, entry), lambda e: e["answer"] != "")


def answer_segment(text: Column, number: Column) -> Column:
    """The piece of a line of answers that belongs to question `number`, up to the next mark; null without it. Brackets
    that recognition took for letters count as brackets."""
    for wrong, right in OCR_BRACKETS:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    own = F.filter(_marked_parts(text), lambda p: F.regexp_extract(p, r"(\d+)", 1) == number.cast("string"))
    return strip(F.regexp_replace(F.get(own, F.lit(0)), r"^(?:[（(]\s*\d{1,3}\s*[）)]|\d{1,3}[.、．])", ""))


def is_footer(text: Column) -> Column:
    return text.rlike(FOOTER)


def split_options(text: Column) -> Column:
    """array<struct<label, text>>: options A-G marked by `A.`, `A、` or `A:`, not right after an ASCII letter or digit.
    Text before the first mark is option A; without a mark there is no option."""
    parts = F.split(F.regexp_replace(text, INLINE_OPTION, BREAK + "$1" + BREAK_2), BREAK)
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(F.split_part(p, F.lit(BREAK_2), F.lit(1)).alias("label"), strip(F.split_part(p, F.lit(BREAK_2), F.lit(2))).alias("text")))
    lead = strip(F.element_at(parts, 1))
    first = F.array(F.struct(F.lit("A").alias("label"), lead.alias("text")))
    return F.when((F.size(parts) > 1) & (lead != ""), F.concat(first, rest)).otherwise(rest)


def option_entries(text: Column) -> Column:
    """map label -> text of options A-D written `(A) text` anywhere, or `A. text` behind white space; the last of
    equal labels."""
    parts = F.split(F.regexp_replace(text, r"(?U)[（(]\s*([A-D])\s*[）)]|(?<=\s)([A-D])\.\s*", BREAK + "$1$2" + BREAK_2), BREAK)
    pairs = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(F.substring(p, 1, 1).alias("label"), strip(F.split_part(p, F.lit(BREAK_2), F.lit(2))).alias("text")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda o: o["label"] == p["label"]))
    return F.map_from_entries(last)


def page_of(line_id: Column) -> Column:
    """12 from P12L003."""
    return F.regexp_extract(line_id, r"^[PND](\d+)L", 1).try_cast("int")


def parent_and_sub(number: Column) -> Column:
    """struct(parent int, sub string): 15 and 1 of 15(1) or 15.1, 15 and 一 of 15（一）. Whatever is not wholly of such a form has no sub;
    its parent is the number that it begins with."""
    whole = r"^\s*(\d{1,3})\s*(?:[（(]\s*(\d{1,3}|[一二三四五六七八九十]+)\s*[）)]|[.．]\s*(\d{1,3}))\s*$"
    part = lambda k: F.nullif(F.regexp_extract(number, whole, k), F.lit(""))
    parent = F.coalesce(part(1), F.regexp_extract(number, r"^\s*(\d+)", 1))
    return F.struct(parent.try_cast("int").alias("parent"), F.coalesce(part(2), part(3)).alias("sub"))


def word_bank(text: Column) -> Column:
    """Words of a bank: parted at commas and semicolons if there are any, else at white space; marks and brackets at
    their ends go."""
    raw = strip(F.coalesce(text, F.lit("")))
    parts = F.when(raw.rlike("[;；，,]"), F.split(raw, "[;；，,]+")).otherwise(F.split(raw, r"(?U)\s+"))
    return F.transform(F.filter(F.transform(parts, strip), lambda w: w != ""), lambda w: F.regexp_replace(w, "^[.;；，,()（）]+|[.;；，,()（）]+$", ""))


def answer_structure(text: Column) -> Column:
    """struct(kind, low, high, accepted): the two sides of a first ~ as they stand, if neither is empty, and the accepted forms, if there
    are several of 200 characters at most. An answer can have both; kind is range, list, both or single."""
    body = strip(text)
    side = lambda k: strip(F.regexp_extract(body, r"(?s)^([^~～]*)[~～](.*)$", k))
    ranged = F.coalesce((side(1) != "") & (side(2) != ""), F.lit(False))
    parts = F.filter(F.transform(F.split(body, r"[/|;；]"), strip), lambda x: x != "")
    listed = F.coalesce((F.size(parts) > 1) & F.forall(parts, lambda x: F.length(x) <= 200), F.lit(False))
    kind = F.when(ranged & listed, "both").when(ranged, "range").when(listed, "list").otherwise("single")
    return F.struct(kind.alias("kind"), F.when(ranged, side(1)).alias("low"), F.when(ranged, side(2)).alias("high"), F.when(listed, parts).otherwise(F.array(body)).alias("accepted"))


def difficulty(value: Column) -> Column:
    """An integer from 1 to 5, anything else 3. Numbers lose their fraction, text must be digits alone, booleans are
    not numbers."""
    text = value.cast("string")
    number = F.when(F.typeof(value) == "boolean", None).when(F.typeof(value) == "string", F.when(text.rlike(r"^\s*\d+\s*$"), F.trim(text).try_cast("double"))).otherwise(text.try_cast("double"))
    n = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).try_cast("int")
    return F.when(n.between(1, 5), n).otherwise(3)


def answer_rows(html: Column) -> Column:
    """Cells of each row of an HTML table: array<array<string>>."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1), lambda c: F.trim(F.regexp_replace(c, r"<[^>]+>", ""))))


def answer_pairs(html: Column) -> Column:
    """array<struct<number, answer>> of an HTML table with a row of question numbers (题号) and, below it, a row of
    answers (答案), column by column; null without both."""
    rows = answer_rows(F.nullif(F.regexp_extract(html, r"(?s)(<table>.*?</table>)", 1), F.lit("")))
    of = lambda head: F.filter(rows, lambda r: (F.size(r) > 0) & (F.get(r, F.lit(0)) == head))
    tail = lambda r: F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0)))
    numbers = F.filter(tail(F.element_at(of("题号"), -1)), lambda t: t.rlike(r"^\d+$"))
    answers = tail(F.element_at(of("答案"), -1))
    n = F.least(F.size(numbers), F.size(answers))
    pairs = F.transform(F.slice(numbers, 1, n), lambda q, i: F.struct(q.alias("number"), F.get(answers, i).alias("answer")))
    return F.when((F.size(of("题号")) > 0) & (F.size(of("答案")) > 0) & (n > 0), pairs)


def section_headers(text: Column) -> Column:
    """Headings of parts and sections, white space out, each once: one kind after the other."""
    found = F.concat(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({p})"), 1) for p in SECTIONS])
    return F.array_distinct(F.transform(found, lambda h: F.regexp_replace(h, r"(?U)\s+", "")))


def answer_section(text: Column) -> Column:
    """The text from its first answer heading on; the kinds of heading are tried in order. Empty without one."""
    tried = [F.nullif(F.regexp_extract(text, f"(?s)({p}.*)$", 1), F.lit("")) for p in ANSWER_SECTIONS]
    return F.coalesce(*tried, F.lit(""))
