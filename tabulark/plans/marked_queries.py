"""Rules on exam lines over every line of all documents, each line given its marks by an expression of its place and text."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulark.functions import exam
from tabulark.functions import patterns as pt
from tabulark.operators import evals
from tabulark.plans.proxies import LINES_SQL, lines


def _marked(s, d):
    """doc_id, line_no, text, n (1 to 150), m (1 to 9), k (the kind of mark)."""
    rows = lines(s, d).withColumn("n", F.col("line_no") % 150 + 1).withColumn("m", F.col("doc_id") % 9 + 1)
    return rows.withColumn("k", (F.col("doc_id") + F.col("line_no")) % 6)


def _kinds(*texts):
    """The text of a line's kind; the last is that of all further kinds."""
    out = F.expr(texts[-1])
    for k, text in enumerate(texts[:-1]):
        out = F.when(F.col("k") == k, F.expr(text)).otherwise(out)
    return out


MARKED_SQL = f"{LINES_SQL.strip()}, marked AS (SELECT *, line_no % 150 + 1 AS n, doc_id % 9 + 1 AS m, (doc_id + line_no) % 6 AS k FROM lines)"


def _kinds_sql(*texts):
    return "CASE k " + " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(texts[:-1])) + f" ELSE {texts[-1]} END"


SUBS = ("n || '(' || m || ')'", "' ' || n || '（ ' || m || '）'", "n || '.' || m", "CAST(n AS STRING)", "n || '（' || substr('一二三四五六七八九', CAST(m AS INT), 1) || '）'", "'x' || n || ' ' || text")
ANSWERS = ("n || ' ~ ' || text", "text || ' / ' || n", "text || '；' || n || '|～'", "'～' || text", "text")
PAGES = ("'P' || n || 'L' || line_no", "'N' || n || 'L' || line_no", "'D' || n || 'L1'", "'X' || n || 'L1'", "'P' || m || text", "text")
HARD = ("CAST(n % 7 AS STRING)", "' ' || n % 7 || ' '", "n % 7 || '.0'", "CAST(NULL AS STRING)", "text")


def _duck(text: str) -> str:
    return text.replace("AS STRING", "AS VARCHAR")


def _structures(s, d):
    found = _marked(s, d).withColumn("a", pt.answer_structure(_kinds(*ANSWERS)))
    return found.select("doc_id", "line_no", "a.kind", "a.low", "a.high", F.when(F.col("a.kind").isin("list", "both"), F.array_join("a.accepted", "¦")).alias("accepted"))


def _natural(s, d):
    key = evals.natural_key(F.concat(F.col("n").cast("string"), F.lit("("), F.col("m") * 7 % 40, F.lit(")")))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("key", "line_no"))
    return _marked(s, d).withColumn("m", F.col("line_no") % 9).withColumn("key", key).select("doc_id", "line_no", rank.alias("rank"))


STYLES = ("upperLetter", "lowerLetter", "upperRoman", "lowerRoman", "decimal")

QUERIES = {
    "sub_numbers_of_lines": lambda s, d: _marked(s, d).withColumn("q", pt.parent_and_sub(_kinds(*SUBS))).select("doc_id", "line_no", "q.parent", "q.sub"),
    "structures_of_lines": _structures,
    "pages_of_lines": lambda s, d: _marked(s, d).select("doc_id", "line_no", pt.page_of(_kinds(*PAGES)).alias("page")),
    "difficulties_of_lines": lambda s, d: _marked(s, d).select("doc_id", "line_no", pt.difficulty(_kinds(*HARD)).alias("difficulty")),
    "natural_order_of_lines": _natural,
    "labels_of_lines": lambda s, d: _marked(s, d).select("doc_id", "line_no", exam.number_label(F.col("n").cast("int"), _kinds(*[f"'{x}'" for x in STYLES])).alias("label")),
}

TRIM_SQL = r"regexp_replace({}, '^[\s\p{{Z}}\x{{0B}}\x{{85}}]+|[\s\p{{Z}}\x{{0B}}\x{{85}}]+$', '', 'g')"
ROMAN_SQL = "repeat('M', n // 1000) || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][n // 100 % 10 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][n // 10 % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1]"

ORACLES = {
    "sub_numbers_of_lines": f"WITH {MARKED_SQL} SELECT doc_id, line_no, CAST(CASE WHEN k < 5 THEN n END AS INT) AS parent, CASE WHEN k IN (0, 1, 2) THEN CAST(m AS VARCHAR) WHEN k = 4 THEN substr('一二三四五六七八九', m, 1) END AS sub FROM marked",
    "structures_of_lines": f"""WITH {MARKED_SQL}, t AS (SELECT doc_id, line_no, {TRIM_SQL.format(_kinds_sql(*ANSWERS))} AS t FROM marked),
      p AS (SELECT *, CASE WHEN regexp_matches(t, '[~～]') THEN regexp_extract(t, '(?s)^([^~～]*)[~～](.*)$', 1) END AS l, CASE WHEN regexp_matches(t, '[~～]') THEN regexp_extract(t, '(?s)^([^~～]*)[~～](.*)$', 2) END AS h,
        list_filter(list_transform(regexp_split_to_array(t, '[/|;；]'), lambda x: {TRIM_SQL.format("x")}), lambda x: x <> '') AS a FROM t),
      q AS (SELECT *, coalesce({TRIM_SQL.format("l")} <> '' AND {TRIM_SQL.format("h")} <> '', false) AS ranged, len(a) > 1 AND len(list_filter(a, lambda x: length(x) > 200)) = 0 AS listed FROM p)
      SELECT doc_id, line_no, CASE WHEN ranged AND listed THEN 'both' WHEN ranged THEN 'range' WHEN listed THEN 'list' ELSE 'single' END AS kind, CASE WHEN ranged THEN {TRIM_SQL.format("l")} END AS low, CASE WHEN ranged THEN {TRIM_SQL.format("h")} END AS high, CASE WHEN listed THEN array_to_string(a, '¦') END AS accepted FROM q""",
    "pages_of_lines": rf"WITH {MARKED_SQL} SELECT doc_id, line_no, TRY_CAST(regexp_extract({_kinds_sql(*PAGES)}, '^[PND](\d+)L', 1) AS INT) AS page FROM marked",
    "difficulties_of_lines": rf"WITH {MARKED_SQL}, v AS (SELECT doc_id, line_no, {_duck(_kinds_sql(*HARD))} AS v FROM marked) SELECT doc_id, line_no, CASE WHEN regexp_full_match(v, '\s*\d+\s*') AND TRY_CAST(trim(v) AS DOUBLE) BETWEEN 1 AND 5 THEN CAST(trim(v) AS INT) ELSE 3 END AS difficulty FROM v",
    "natural_order_of_lines": f"WITH {MARKED_SQL} SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY n, line_no % 9 * 7 % 40, line_no) AS rank FROM marked",
    "labels_of_lines": f"WITH {MARKED_SQL} SELECT doc_id, line_no, CASE WHEN k = 0 AND n <= 26 THEN chr(CAST(64 + n AS INT)) WHEN k = 1 AND n <= 26 THEN chr(CAST(96 + n AS INT)) WHEN k = 2 THEN {ROMAN_SQL} WHEN k = 3 THEN lower({ROMAN_SQL}) ELSE CAST(n AS VARCHAR) END AS label FROM marked",
}
