"""Text normalizers as Column functions. Each is its own equivalence relation; none stands in for another.

Only compatibility normalization (NFKC) has no built-in: `nfkc` is an Arrow UDF, and `normalize_text` skips it for
texts of ASCII, which it cannot change.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that the content hash ignores, besides white space.
PUNCTUATION = " \t\n\r\u3000，。！？；：、（）()【】[]《》〈〉「」『』“”‘’\"'…—–-·•.,!?;:"
# Full-width punctuation and its half-width form, as the answer comparison folds it.
ANSWER_FOLD = {"（": "(", "）": ")", "；": ";", "：": ":", "，": ",", "．": ".", "。": ".", "－": "-", "～": "~"}
# The punctuation that marker texts fold.
MARKER_FOLD = {"．": ".", "（": "(", "）": ")", "：": ":", "；": ";", "，": ",", "。": "."}


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def drop_space(c: Column) -> Column:
    """Remove all white space, Unicode's included."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def fold(c: Column, table: dict[str, str]) -> Column:
    return F.translate(c, "".join(table), "".join(table.values()))


def normalize_native(c: Column) -> Column:
    """`normalize_text` for texts whose NFKC form is themselves."""
    return F.lower(F.translate(drop_space(F.coalesce(c, F.lit(""))), PUNCTUATION, ""))


def normalize_text(c: Column) -> Column:
    """NFKC, no white space or punctuation, lower case; null becomes empty."""
    return normalize_native(nfkc(c))


def normalize_options(options: Column, norm=normalize_native) -> Column:
    """`label:text` of each option, sorted, joined by |; the order of options does not matter."""
    one = F.transform(F.coalesce(options, F.array().cast("array<struct<label:string,text:string>>")), lambda o: F.concat(norm(o["label"]), F.lit(":"), norm(o["text"])))
    return F.array_join(F.sort_array(one), "|")


def normalize_subs(subs: Column, norm=normalize_native) -> Column:
    """`qno:type:answer` of each sub-question, sorted, joined by |."""
    kind = "array<struct<qno:string,question_type:string,answer:string>>"
    one = F.transform(F.coalesce(subs, F.array().cast(kind)), lambda s: F.concat(norm(s["qno"]), F.lit(":"), norm(s["question_type"]), F.lit(":"), norm(s["answer"])))
    return F.array_join(F.sort_array(one), "|")


def content_hash(stem: Column, options: Column | None = None, qtype: Column | None = None, subs: Column | None = None, norm=normalize_native) -> Column:
    """SHA-256 of the four normalized parts joined by NUL. `-` and `.` are ignored, so x=-1 and x=1 collide."""
    parts = [norm(stem), normalize_options(options, norm) if options is not None else F.lit(""), norm(qtype) if qtype is not None else F.lit(""), normalize_subs(subs, norm) if subs is not None else F.lit("")]
    return F.sha2(F.concat_ws("\u0000", *parts), 256)


def compact_answer(c: Column) -> Column:
    """Answers that differ only in layout become equal: white space, circled-number dots, full-width
    punctuation, and, where $ or a backslash occurs, the shells of math commands."""
    out = drop_space(F.coalesce(c, F.lit("")))
    out = F.regexp_replace(out, "([①②③④⑤⑥⑦⑧⑨⑩])[.．、]?", "$1")
    out = F.replace(fold(out, ANSWER_FOLD), F.lit("\\n"), F.lit(";"))
    math = F.translate(out, "$", "")
    # Rewrites of math commands, applied in this order.
    for pattern, into in (
        (r"\\[()\[\]]", ""),
        (r"\\d?frac\{([^{}]*)\}\{([^{}]*)\}", "$1/$2"),
        (r"\\sqrt\{([^{}]*)\}", "sqrt($1)"),
        (r"\\(?:text|mathrm|mathbf|mathit|operatorname)\{([^{}]*)\}", "$1"),
        (r"\\([{}])", "$1"),
        (r"\\pi", "π"),
        (r"\\mid", "|"),
        (r"\\le", "<="),
        (r"\\ge", ">="),
        (r"\\(?:left|right|bigg|Bigg|big|Big|qquad|quad|;|,|!| )", ""),
        (r"\\([a-zA-Z]+)", "$1"),
        (r"[{}]", ""),
    ):
        math = F.regexp_replace(math, pattern, into)
    return F.when(F.contains(out, F.lit("$")) | F.contains(out, F.lit("\\")), math).otherwise(out)


def normalize_marker(c: Column, norm=lambda x: x) -> Column:
    """Lower case, folded punctuation, no white space."""
    return drop_space(fold(F.lower(norm(F.coalesce(c, F.lit("")))), MARKER_FOLD))


def letters_only(c: Column) -> Column:
    """Letters and ideographs, lower-cased; digits go."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z\u4e00-\u9fff]+", ""))


def shared_material(c: Column, norm=None) -> Column:
    """The letters and ideographs of NFKC text, lower-cased, without a first line that is only a label A to G and without \\text{} parts."""
    c = F.coalesce(c, F.lit(""))
    body = F.regexp_replace(c, r"(?U)^[^\S\r\n]*[A-G][^\S\r\n]*(\r\n?|\n|$)", "")
    return letters_only(F.regexp_replace((norm or nfkc)(body), r"\\text\{[^}]*\}", " "))


def format_only(c: Column) -> Column:
    """Quotes, dashes, spaces and brackets in one form; digits stay. Expects NFKC text."""
    out = F.translate(F.coalesce(c, F.lit("")), "“”‘’?？—–", "\"\"''''--")
    out = F.regexp_replace(out, r"(?U)\s+", " ")
    for left, right in ((r"\d", r"\u4e00-\u9fff"), (r"A-Za-z", r"\u4e00-\u9fff")):
        out = F.regexp_replace(out, rf"([{left}]) +([{right}])", "$1$2")
        out = F.regexp_replace(out, rf"([{right}]) +([{left}])", "$1$2")
    out = F.regexp_replace(out, r"([、，。；：）」』】》]) +", "$1")
    out = F.regexp_replace(out, r" +([、，。；：（「『【《])", "$1")
    return F.trim(F.translate(out, "（）〔〕", "()[]"))


def blank_markers(c: Column) -> Column:
    """format_only, and every way to write blank N becomes [N]."""
    return blanks_of_format(format_only(c))


def blanks_of_format(c: Column) -> Column:
    """`blank_markers` of a text that `format_only` has gone over."""
    out = F.regexp_replace(c, r"_+(\d+)_+", "[$1]")
    out = F.regexp_replace(out, r"(\d+)_+(?=[,.;:)\]\s])", "[$1]")
    out = F.regexp_replace(out, r"[〔【［](\d+)[〕】］]", "[$1]")
    out = F.regexp_replace(out, r"([\u4e00-\u9fff])\[(\d+)\]([\u4e00-\u9fff])", "$1$2$3")
    return F.regexp_replace(out, r"(?<=\s)(\d{1,2})(?=[,.;:\]－）\s])", "[$1]")


def strip_punct(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[,.;:!?。，；：！？\-\s]+", "")


def half_width(c: Column) -> Column:
    """Quotes and the full-width ASCII range folded, white space dropped. The table follows from the rule that
    a full-width form lies 0xFEE0 above its ASCII character."""
    full = "".join(map(chr, range(0xFF01, 0xFF5F)))
    return drop_space(F.translate(F.translate(F.coalesce(c, F.lit("")), "“”‘’", "\"\"''"), full, "".join(chr(ord(x) - 0xFEE0) for x in full)))


def scrub_value(c: Column) -> Column:
    """Trim, lower case, no white space or common punctuation: the evaluation's comparison."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s,.;:!?，。；：！？、]+", ""))


def numbers(c: Column) -> Column:
    """All numbers of a text in order."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d+\.?\d*)"), 1)


def same_number_set(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_distinct(numbers(a))) == F.sort_array(F.array_distinct(numbers(b)))


def same_number_list(a: Column, b: Column) -> Column:
    return numbers(a) == numbers(b)


# Rewrites of LaTeX for the comparison of answers and of mathematics, applied in this order.
CIRCLED = {"1": "①", "2": "②", "3": "③", "4": "④", "5": "⑤", "i": "①", "ii": "②", "iii": "③", "iv": "④", "v": "⑤"}
ANSWER_SYMBOLS = {
    r"\bigcup": "U", r"\cup": "U", r"\cap": "n", r"\infty": "inf", r"\in": "in", r"\geqslant": ">=", r"\geq": ">=", r"\leqslant": "<=", r"\leq": "<=", r"\neq": "!=", r"\times": "*",
    r"\cdot": "*", r"\pi": "pi", r"\cos": "cos", r"\sin": "sin", r"\tan": "tan", r"\log": "log", r"\lg": "lg", r"\ln": "ln", r"\{": "{", r"\}": "}", r"\mid": "|",
}
SCORES = [r"[（(][^）)]*\d+\s*分[^）)]*[）)]\s*$", r"(?:…+\s*)?\d+\s*分\s*$"]
RUN_NOISE = [(r"(?<!\d)\d{1,3}\s*[.、．]\s*", " "), (r"[（(]\s*\d{1,3}\s*[）)]\s*", " ")]
RUN_SCORES = [r"\(\d+分\)", r"……\d+分", r"…\d+分", r"\(0\.\d+~0\.\d+均可\)"]


def answer_text(c: Column, norm=nfkc) -> Column:
    """Answers for the comparison with expected ones: quotes, formula shells, fractions and symbols in plain text, no
    score, no leading number, one `/` for every separator, no white space or closing punctuation."""
    out = F.trim(norm(F.coalesce(c, F.lit(""))))
    out = F.translate(out, "’‘“”$", "''\"\"")
    for _ in range(3):
        out = F.regexp_replace(out, r"\\d?frac\{((?:[^{}]|\{[^{}]*\})*)\}\{((?:[^{}]|\{[^{}]*\})*)\}", "$1/$2")
    out = F.regexp_replace(out, r"\\sqrt\{([^{}]+)\}", "sqrt($1)")
    out = F.regexp_replace(out, r"\\(?:left|right|big|Big|bigg|Bigg|text|mathbf|mathbb)\b", "")
    for token, plain in ANSWER_SYMBOLS.items():
        out = F.replace(out, F.lit(token), F.lit(plain))
    for p in SCORES:
        out = F.regexp_replace(out, p, "")
    out = F.regexp_replace(out, r"^(?:\d{1,3}\s*[.、．:：]\s*)+", "")
    out = drop_space(F.regexp_replace(out, r"(?U)(?:\s*##\s*|\s*/\s*|\s*、\s*|\s*[，,;；|]\s*)+", "/"))
    return F.regexp_replace(out, r"""^[。．.;；，,?!？！:："']+|[。．.;；，,?!？！:："']+$""", "")


def math_text(c: Column) -> Column:
    """LaTeX as plain text, where $ or a backslash occurs; other texts as they are."""
    raw = F.coalesce(c, F.lit(""))
    out = F.regexp_replace(F.translate(raw, "$", ""), r"\\[()\[\]]", "")
    for name, sign in CIRCLED.items():
        out = F.regexp_replace(out, rf"(?i)\\textcircled\s*\{{\s*{name}\s*\}}", sign)
    for _ in range(4):
        out = F.regexp_replace(out, r"\\[dt]?frac\{([^{}]*)\}\{([^{}]*)\}", "$1/$2")
    for pattern, into in (
        (r"\\sqrt\s*\{([^{}]*)\}", "sqrt($1)"), (r"\\(?:left|right|bigl|bigr|Bigl|Bigr|bigg|Bigg|big|Big|quad|qquad|;|,|!| )", ""), (r"\\([{}])", "$1"), (r"\\mid", "|"), (r"\\pi", "π"),
        (r"\\text\s*\{([^{}]*)\}", "$1"), (r"\\([a-zA-Z]+)", "$1"), (r"[{}]", ""),
    ):
        out = F.regexp_replace(out, pattern, into)
    return F.when(F.contains(raw, F.lit("$")) | F.contains(raw, F.lit("\\")), out).otherwise(raw)


def run_text(c: Column) -> Column:
    """Texts of two runs for their comparison: without numbering, scores and list separators."""
    out = F.coalesce(c, F.lit(""))
    for pattern, into in RUN_NOISE:
        out = F.regexp_replace(out, pattern, into)
    out = F.translate(out, "（）", "()")
    for pattern in RUN_SCORES:
        out = F.regexp_replace(out, pattern, "")
    return drop_space(F.translate(out, "；、，", "   "))
