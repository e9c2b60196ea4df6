"""Rules on lines, answers and documents over literal rows. The driver's tables hold no exam lines, so each rule is shown
on rows written here, and the SQL beside it states the answers that the rule must give, row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulark.functions import exam
from tabulark.functions import patterns as pt
from tabulark.functions import similarity as sm
from tabulark.functions import text as tx
from tabulark.operators import anchors, annotations, answers, evals, gates, lines as ln, merge
from tabulark.plans.rule_cases import ANCHOR_LINES, ANCHOR_QUESTIONS, ANSWER_LINES, SEGMENTS, VERIFY
from tabulark.sources import readers

QUERIES, ORACLES = {}, {}


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return repr(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def values(columns: str, rows: list[tuple]) -> str:
    """SQL of literal rows; the columns carry their types, as `name TYPE`."""
    parts = [c.strip().split() for c in columns.split(",")]
    cast = ", ".join(f"CAST(c{i} AS {kind}) AS {name}" for i, (name, kind) in enumerate(parts))
    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"SELECT {cast} FROM (VALUES {body}) AS t({', '.join(f'c{i}' for i in range(len(parts)))})"


def rule(name: str, f, cases: list[tuple], kind: str = "string") -> None:
    """Register a rule: each case is its inputs, text as a rule, and the answer."""
    width = len(cases[0]) - 1
    schema = "case_id long, " + ", ".join(f"i{k} string" for k in range(width))
    inputs = [(n, *c[:-1]) for n, c in enumerate(cases)]
    QUERIES[name] = lambda s, d: s.createDataFrame(inputs, schema).select("case_id", f(*[F.col(f"i{k}") for k in range(width)]).cast(kind).alias("out"))
    sql_kind = {"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}[kind]
    ORACLES[name] = values(f"case_id BIGINT, out {sql_kind}", [(n, c[-1]) for n, c in enumerate(cases)])


def listed(c):
    return F.array_join(c, " ¦ ")


def pairs(c, a: str, b: str):
    return listed(F.transform(c, lambda e: F.concat(e[a].cast("string"), F.lit("="), e[b].cast("string"))))


# --- X20 to X39: numbers, lines, options, answers -------------------------------------------------------------

rule("question_numbers", pt.question_number, [
    ("16\\. 下列", 16), ("7，选", 7), ("5.2024年的", 5), ("6.1998年夏", 6), ("3.14", None), ("2.5 + 1", None), ("0.\\end{aligned}", None), (" 12、x", 12), ("（8）x", 8), ("( 9 ) y", 9), ("12．", 12), ("text 4.", None), ("1234. x", None),
], "int")
rule("line_kinds", pt.line_type, [
    ("(1)A (2)B", "answer_table"), ("（3） C", "answer_table"), ("(A) x (B) y", "option"), ("（D）", "option"), ("3. y", "question_number"), ("12、设", "question_number"), ("（5）求", "question_number"), ("3.14 is pi", "stem"), ("4.\\frac", "stem"), ("plain", "stem"), ("", "stem"),
])
rule("inline_numbers", lambda t: listed(exam.break_numbers(t)), [
    ("D. 既不充分也不必要条件5.已知", "D. 既不充分也不必要条件 ¦ 5.已知"), ("5. 已知x=3.125求", "5. 已知x=3.125求"), ("结晶水Fe·O 3.求", "结晶水Fe·O 3.求"), ("x5. y", "x5. y"), ("in 2015. 年", "in 2015. 年"),
    ("n的最小数为（16）关于", "n的最小数为 ¦ （16）关于"), ("（5）A（10）D", "（5）A（10）D"), ("答案（16）B", "答案（16）B"), ("甲 3、乙 4．丙", "甲 ¦ 3、乙 ¦ 4．丙"), ("f（2）= 1", "f（2）= 1"), ("plain", "plain"),
])
rule("inline_options", lambda t: listed(exam.break_options(t)), [
    ("A.充分条件B.必要条件C.充要条件", "A.充分条件 ¦ B.必要条件 ¦ C.充要条件"), ("题干 (A) x (B) y", "题干 ¦ (A) x ¦ (B) y"), ("A. only one", "A. only one"), ("D. x E、y", "D. x ¦ E、y"), ("none", "none"),
])
rule("option_splits", lambda t: pairs(pt.split_options(t), "label", "text"), [
    ("A：甲B：乙", "A=甲 ¦ B=乙"), ("甲 C. 丙", "A=甲 ¦ C=丙"), ("甲 B. 乙", "A=甲 ¦ B=乙"), ("A.xB.y", "A=xB.y"), ("件B.必要C、充分", "A=件 ¦ B=必要 ¦ C=充分"), ("no marks", ""), ("E. v F. w G. z", "E=v ¦ F=w ¦ G=z"),
])
rule("table_entries", lambda t: pairs(pt.table_entries(t), "number", "answer"), [
    ("（1）A（2）B", "1=A ¦ 2=B"), ("1. D 2. C 3. A", "1=D ¦ 2=C ¦ 3=A"), ("11.【答案】had gone", "11=had gone"), ("3. B （2分）", "3=B"), ("27． （1）8.25 （3 分） （2）可以", "27=（1）8.25 （3 分） （2）可以 ¦ 1=8.25 （3 分） ¦ 2=可以"),
    ("(7) 3.2x", "7=3.2x"), ("none here", ""), ("4.", ""),
])
rule("option_entries", lambda t: listed(F.transform(F.array_sort(F.map_entries(pt.option_entries(t))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), [
    ("(A) 内容 (B) 其他", "A=内容 ¦ B=其他"), ("x A. one B. two", "A=one ¦ B=two"), ("A. one B. two", "B=two"), ("(C)z（D） w", "C=z ¦ D=w"), ("plain", ""), ("(A) x (A) y", "A=y"),
])
rule("html_answer_tables", lambda t: pairs(pt.answer_pairs(t), "number", "answer"), [
    ("<table><tr><td>题号</td><td>1</td><td>2</td></tr><tr><td>答案</td><td>C</td><td> B </td></tr></table>", "1=C ¦ 2=B"), ("<table><tr><td>题号</td><td>1</td><td>x</td><td>3</td></tr><tr><td>答案</td><td>C</td><td>B</td></tr></table>", "1=C ¦ 3=B"),
    ("<table><tr><td>材料</td><td>1</td></tr></table>", None), ("no table", None), ("<table><tr><td>题号</td><td>4</td></tr></table>", None),
])
rule("option_tables", lambda t: listed(exam.option_table_lines(t)), [
    ("<table><tr><td>选项</td><td>物质</td></tr><tr><td>A</td><td>x</td><td>y</td></tr><tr><td>B</td><td>z</td></tr></table>", "选项，物质 ¦ A. x，y ¦ B. z"),
    ("<table><tr><td>A. 甲</td><td>B. 乙</td></tr><tr><td>C. 丙</td><td>D. 丁</td></tr></table>", "A. 甲 ¦ B. 乙 ¦ C. 丙 ¦ D. 丁"),
    ("<table><tr><td>A</td><td>B</td></tr><tr><td>x</td><td><i>y</i></td></tr><tr><td>u</td><td></td></tr></table>", "A. x，u ¦ B. y"),
    ("<table><tr><td>题号</td><td>1</td></tr><tr><td>A</td><td>B</td></tr></table>", "<table><tr><td>题号</td><td>1</td></tr><tr><td>A</td><td>B</td></tr></table>"),
    ("<table><tr><td>年</td><td>数</td></tr>\n<tr><td>1</td><td>2</td></tr></table>", "<table><tr><td>年</td><td>数</td></tr> <tr><td>1</td><td>2</td></tr></table>"),
    ("<table><tr><td>A. 图<img src='a'/></td><td>甲</td></tr></table>", "A. 图<img src='a'/>，甲"),
])
rule("answer_segments", pt.answer_segment, [
    ("（5）A（10）D", "10", "D"), ("5. x y 6. z", "5", "x y"), ("ги7гйB（8）C", "7", "B"), ("（5）A", "6", None), ("plain", "1", None), ("3.2 and 3. ok", "3", "ok"),
])
rule("clean_answers", exam.clean_answer, [
    ("3", "故选 B。", "B"), ("3", "3. x = 1（4分）", "x = 1"), (None, "（2）y", "（2）y"), ("7", "答案不唯一", "答案不唯一"), ("7", "【答案】故选A", "A"), ("15(1)", "15(1). 5 m/s", "5 m/s"), ("2", "（2）答案：甲", "答案：甲"), ("4", "选C！", "C"), ("9", "x=2……3分", "x=2"), ("1", "答案：1. 对", "对"), ("3", "第 3 页/共 8 页", ""),
])
rule("pages_of_ids", pt.page_of, [("P12L003", 12), ("N1L010", 1), ("D7L999", 7), ("X1L1", None), ("", None)], "int")
rule("parents_and_subs", lambda t: F.concat_ws("/", pt.parent_and_sub(t)["parent"], pt.parent_and_sub(t)["sub"]), [("15(1)", "15/1"), ("15（12）", "15/12"), ("16.1", "16/1"), ("15(一)", "15/一"), ("15(1)x", "15"), ("8", "8"), ("实验一", "")])
rule("word_banks", lambda t: listed(pt.word_bank(t)), [("apple, banana; kiwi", "apple ¦ banana ¦ kiwi"), ("a b  c", "a ¦ b ¦ c"), ("（look after）；take off，", "look after ¦ take off"), ("  ", ""), (None, "")])
rule("answer_structures", lambda t: F.concat_ws("/", pt.answer_structure(t)["kind"], pt.answer_structure(t)["low"], F.size(pt.answer_structure(t)["accepted"]).cast("string")), [("0.43~0.46", "range/0.43/1"), ("A~C", "range/A/1"), (" a ~ b/c", "both/a/2"), ("~3", "single/1"), ("a/b|c", "list/3"), ("plain", "single/1")])
rule("subjects_of_files", exam.subject_of_file, [("2025期末数学.pdf", "数学"), ("化学老师.pdf", "化学"), ("附件一二三四五六七八数学", None), (None, None)])
rule("subjects_found", exam.detect_subject, [
    (" 物理 ", "数学.pdf", "函数", "物理"), (None, "2024 ENGlish.pdf", None, "英语"), ("", "paper.pdf", "求函数的导数", "数学"), (None, "x.pdf", "古诗默写", "语文"), (None, None, "nothing", "未知"), (None, "bio test", "电学", "生物"), (None, "x", "\n" * 50 + "函数", "未知"),
])
rule("section_headings", lambda t: listed(pt.section_headers(t)), [("第一部分 听力 第一节 x 第一节", "第一部分 ¦ 第一节"), ("二、本大题共4题 一、本大题", "二、本大题 ¦ 一、本大题"), ("none", "")])
rule("answer_cuts", pt.answer_section, [("题 参考答案 1.A", "参考答案 1.A"), ("x 答案：B", "答案：B"), ("q ANSWER KEY z", "ANSWER KEY z"), ("t【答案】C", "【答案】C"), ("none", ""), (None, "")])
rule("option_letters", lambda a: exam.answer_with_text(a, F.from_json(F.lit('[{"label":"A","text":"x"},{"label":"C","text":"z"}]'), "array<struct<label:string,text:string>>")), [("ac", "A. x；C. z"), ("C", "C. z"), ("B", None), (None, None)])
rule("number_labels", lambda n, s: exam.number_label(n.cast("int"), s), [("4", "upperRoman", "IV"), ("1994", "lowerRoman", "mcmxciv"), ("2", "lowerLetter", "b"), ("30", "upperLetter", "30"), ("7", "decimal", "7"), ("4000", "upperRoman", "4000")])
rule("blank_marks", lambda t, s: exam.mark_blanks(t, F.array(F.lit("14"), F.lit("5")), s), [
    ("{11} and (12) and __13__", "数学", "〔11〕 and 〔12〕 and 〔13〕"), ("it was 14 here", "英语", "it was 〔14〕 here"), ("page 14 and 14th and 14.2", "英语", "page 14 and 14th and 14.2"), ("my 5was", "英语", "my 〔5〕was"), ("it was 14", "数学", "it was 14"), (None, "英语", ""),
])
rule("chemistry_marks", exam.chemistry, [("H(2)SO(4)", "H₂SO₄"), ("Ca(2+)", "Ca²⁺"), ("SO(4)(2-)", "SO₄²⁻"), ("plain", "plain"), (None, None)])
rule("difficulties", pt.difficulty, [("3", 3), ("4.5", 3), (" 5 ", 5), ("9", 3), ("0", 3), ("x", 3), (None, 3), ("-2", 3)], "int")
rule("number_difficulties", lambda v: pt.difficulty(v.cast("double")), [("4.9", 4), ("5.99", 5), ("6", 3), ("0.5", 3), (None, 3), ("-1.5", 3)], "int")
rule("natural_order", evals.natural_key, [("q2", "q0000000002"), ("q10a3", "q0000000010a0000000003"), ("x", "x")])
rule("body_leaks", exam.leaks_body, [("$a$ b", True), ("fine", False), (None, False), ("x^{2}", True), ("\\frac12", True), ("y" * 201, True)], "boolean")
rule("answer_leaks", lambda t: exam.answer_leaks(F.from_json(t, "map<string,string>")), [
    ('{"line_id":"P1L001","evidence":"short"}', False), ('{"text":"short"}', False), ('{"stem":"a stem with more than twenty characters"}', True), ('{"note":"a $x$"}', True), ('{"line_id":"$x$"}', False), ('{"evidence":"' + "e" * 201 + '"}', True), ('{"b":"x_{1}"}', True),
], "boolean")

# --- X01 to X19: normalizers ----------------------------------------------------------------------------------

rule("texts_normalized", tx.normalize_text, [("Ａ B，c.", "abc"), ("x=-1", "x=1"), ("①②", "12"), (None, ""), ("（）【】", "")])
rule("option_forms", lambda t: tx.normalize_options(F.from_json(t, "array<struct<label:string,text:string>>")), [('[{"label":"B","text":"Y "},{"label":"A","text":"x."}]', "a:x|b:y"), ("[]", ""), (None, "")])
rule("sub_question_forms", lambda t: tx.normalize_subs(F.from_json(t, "array<struct<qno:string,question_type:string,answer:string>>")), [('[{"qno":"2","question_type":"fill","answer":"Z"},{"qno":"1","question_type":null,"answer":"a b"}]', "1::ab|2:fill:z"), (None, "")])
rule("full_hashes", lambda o, s: tx.content_hash(F.lit("Stem."), F.from_json(o, "array<struct<label:string,text:string>>"), F.lit("single_choice"), F.from_json(s, "array<struct<qno:string,question_type:string,answer:string>>")) == F.sha2(F.concat_ws("\u0000", F.lit("stem"), F.lit("a:x|b:y"), F.lit("single_choice"), F.lit("1:t:z")), 256), [
    ('[{"label":"B","text":"y"},{"label":"A","text":"x"}]', '[{"qno":"1","question_type":"t","answer":"Z"}]', True), ('[{"label":"A","text":"y"},{"label":"B","text":"x"}]', '[{"qno":"1","question_type":"t","answer":"Z"}]', False),
], "boolean")
rule("marker_forms", tx.normalize_marker, [("（1） A．", "(1)a."), ("甲：乙；丙，丁。", "甲:乙;丙,丁."), (None, "")])
rule("format_forms", tx.format_only, [("“a”  b", '"a" b'), ("图 1 中", "图1中"), ("（x）〔1〕", "(x)[1]"), ("a 、 b", "a、b"), (None, "")])
rule("scoring_forms", exam.score_sequence, [("共2小题，每小题1.50分，共3.0分", "1.5|3"), ("none", ""), (None, "")])
rule("answer_forms", lambda t: tx.answer_text(t), [
    (r"$\dfrac{1}{2}$", "1/2"), (r"\frac{\sqrt{2}}{2}", r"sqrt(2)/2"), ("B (2分)", "B"), ("44. would attend。", "wouldattend"), ("a、b；c ## d", "a/b/c/d"), ("“x”", "x"), (r"(-\infty,1]", "(-inf/1]"), ("答 3分", "答"), (None, ""), ("ＡＢ", "AB"),
])
rule("math_forms", tx.math_text, [
    (r"$\frac{4}{3}$", "4/3"), (r"\textcircled{2}.", "②."), (r"\frac{\frac{1}{2}}{3}", "1/2/3"), (r"\(\left(x\right)\)", "(x)"), (r"$4.5\text{s}$", "4.5s"), (r"\{x\mid x>\pi\}", "x| x>π"), ("plain {x}", "plain {x}"), (None, ""), (r"$$\sqrt{2}$$", "sqrt(2)"),
])
rule("run_forms", tx.run_text, [("1. 甲；2. 乙（3分）", "甲乙"), ("（2）x……8分", "x"), ("（0.43~0.46均可）y", "(43~46均可)y"), ("3.14、z", "z"), (None, "")])

# --- X50 to X60, S08 to S15: similarities and readers ---------------------------------------------------------

rule("sequence_ratios", lambda a, b: F.round(sm.sequence_ratio(a, b), 6), [("abcd", "bcde", 0.75), ("", "", 1.0), ("abc", None, 0.0), ("ab", "ba", 0.5)], "double")
rule("hybrid_similarities", lambda a, b: F.round(sm.hybrid_similarity(a, b), 6), [("abcd efgh", "abcd efgx", 0.862222), ("ab", "abcdefghij", 0.0), ("", "x", 0.0), ("same", "same", 1.0)], "double")
rule("marker_matches", lambda m, t: F.round(sm.marker_coverage(m, t), 6), [("abc", "xxabcxx", 1.0), ("abcd", "abxd", 0.75), ("", "x", None), ("abc", "xyz", 0.0)], "double")
rule("marker_limits", lambda m, s: sm.accept_marker(m, s.cast("double")), [("abcd", "0.94", False), ("abcd", "0.95", True), ("abcdefgh", "0.9", True), ("abcdefghi", "0.8", True), ("abcdefghi", "0.79", False), ("x", None, False)], "boolean")
rule("line_coverages", lambda a, b: F.round(evals.line_coverage(a, b), 6), [("a b\nc\n\nd", "x ab y d", 0.666667), ("", "x", 1.0), (None, "x", 1.0), ("Ａ１", "a1A1", 1.0)], "double")
rule("mojibake", readers.is_mojibake, [("ÖÐÎÄ", True), ("中文", False), ("plain", False), ("é", False), (None, False)], "boolean")
rule("gbk_repair", readers.repair_gbk, [("ÖÐÎÄ", "中文"), ("中文", "中文"), ("plain", "plain"), ("é", "é"), (None, None)])
rule("cut_json", readers.json_object, [
    ('```json\n{"a": 1}\n``` rest', '{"a": 1}'), ('x {"a": [1, {"b": "c', '{"a": [1, {"b": "c"}]}'), ('{"a": "' + "z" * 5000 + '", "b": ' + "#" * 4000, '{"a": "' + "z" * 5000 + '"}'), ("none", None), (None, None), ('{"a": "}{", "b": tr', '{"a": "}{"}'),
])
rule("boxes_read", lambda t: F.concat_ws(",", readers.box_of(t)["x1"], readers.box_of(t)["y1"], readers.box_of(t)["x2"], readers.box_of(t)["y2"]), [("[1,2,3,4]", "1.0,2.0,3.0,4.0"), ('{"left":1,"top":2,"right":3,"bottom":4}', "1.0,2.0,3.0,4.0"), ('{"x1":5,"y1":6,"x2":7,"y2":8}', "5.0,6.0,7.0,8.0"), ("[1,2]", ""), (None, "")])
rule("boxes_of_names", lambda t: F.concat_ws(",", readers.box_of_name(t)["x1"], readers.box_of_name(t)["y1"], readers.box_of_name(t)["x2"], readers.box_of_name(t)["y2"]), [("img_in_image_box_10_20_30_40.jpg", "10.0,20.0,30.0,40.0"), ("a/b_1_2_3_4.png", "1.0,2.0,3.0,4.0"), ("x.jpg", ""), (None, "")])
rule("footers", pt.is_footer, [("第 3 页/共 8 页", True), ("  第3页／共8页 ", True), ("第3页 共 8 页", True), ("见第3页/共8页", False), ("text", False)], "boolean")
rule("valid_references", lambda ids: listed(ln.valid_refs(F.split(ids, ","), F.array(F.lit("P1L001"), F.lit("P1L002")))), [("P1L002,P9L001,P1L001,P1L002", "P1L002 ¦ P1L001 ¦ P1L002"), ("X", ""), (None, None)])
rule("labels_missing", lambda t: listed(anchors.missing_labels(F.split(t, ","))), [("A,B,D", "C ¦ E ¦ F ¦ G"), ("A,B,C,D,E,F,G", ""), ("x", "A ¦ B ¦ C ¦ D ¦ E ¦ F ¦ G")])
rule("sub_ranges", lambda t: evals.sub_range(F.from_json(t, "array<struct<qno:string,stem:string>>")), [('[{"qno":"12"},{"qno":"（9）"},{"qno":"11"}]', "9-12"), ('[{"qno":"x","stem":"a 〔 21 〕 b"},{"qno":null,"stem":"23. y"}]', "21-23"), ("[]", ""), (None, "")])

# --- G: gates -------------------------------------------------------------------------------------------------

rule("answer_qualities", lambda a, s: gates.answer_quality(a, s)["confidence"], [("x=1", "", 0.95), ("", "", 0.4), ("a�", "", 0.4), ("\\frac12", "", 0.4), ("$\\frac12$", "", 0.95), ("2 2", "求 sin x", 0.4), ("7", "求 sin x", 0.95), ("2 2", "plain", 0.95), (None, None, 0.95)], "double")
rule("answer_order", lambda t, s, i: F.concat_ws("/", gates.answer_cascade(t, s, i, F.lit("guess"), F.lit("stem"))["source"], gates.answer_cascade(t, s, i, F.lit("guess"), F.lit("stem"))["answer"], gates.answer_cascade(t, s, i, F.lit("guess"), F.lit("stem"))["confidence"].cast("string")), [
    ("A", "x", "y", "document_answer_table/A/0.95"), (" ", "\\sin x", "y", "document_solution_answer/\\sin x/0.4"), (None, None, "y", "document_inline_answer/y/0.9"), (None, "", None, "llm_fallback/guess/0.5"),
])
rule("choice_overrides", lambda a, t, o: gates.choice_override(a, t, o.cast("boolean")), [("B", "C", "true", "B"), ("B", "C", "false", "C"), (None, "C", "true", "C"), ("long text", "C", "true", "C"), ("B", "x = 1", "false", "B"), ("a b", "A B", "true", "A B")])
rule("coverage_guards", lambda w, c, k, t: F.concat_ws("/", merge.guard(w, c, F.lit(0.9), k, t)["winner"], F.round(merge.guard(w, c, F.lit(0.9), k, t)["confidence"], 2).cast("string")), [("native", "complementary", "(A) x", "(A) x", "native/0.9"), ("native", "partial", "(A) x", "(A) x", "ppsv3/0.7"), ("native", "complementary", "x", "(A) x", "ppsv3/0.7"), ("ppsv3", "partial", "x", "(A) x", "ppsv3/0.9")])
rule("shared_verdicts", lambda a, b: evals.verdict_shared(a, b), [("a b", "a  b", "format"), ("abc 1", "abc 1", "exact"), ("in 2024, x", "in 2025, x", "number_diff"), ("x!y 1", "x,y 1", "punct_diff"), ("abc", "abd", "mismatch"), (None, None, "exact"), (None, "x", "mismatch")])
rule("field_lists", lambda f, e, a, c: evals.compare_lists(f, F.split(e, ","), F.split(a, ","), c.cast("boolean")), [
    ("stem_line_ids", "P1,P2", "N1,N2", "false", "match"), ("stem_line_ids", "P1", "N1,N2", "true", "granularity"), ("stem_line_ids", "P1", "N1,N2", "false", "mismatch"), ("answer_images", None, None, "false", "match"), ("knowledge", "a", None, "false", "extra"), ("knowledge", None, "a", "false", "missing"), ("knowledge", "a,b", "a,b", "false", "match"), ("knowledge", "a,b", "b,a", "false", "mismatch"),
])
rule("field_texts", lambda e, a: evals.compare_texts(e, a), [("x", "x", "match"), ("a b", "a  b", "format"), ("__1__ a", "[1] a", "blank_marker"), (None, "x", "missing"), ("x", None, "extra"), (None, None, "match"), ("x", "y", "mismatch")])

# --- operators over a literal document ------------------------------------------------------------------------


def _anchor(s):
    lines = s.createDataFrame(ANCHOR_LINES, "doc_id long, line_id string, order int, page_no int, text string")
    schema = "doc_id long, question_id long, number string, qtype string, is_composite boolean, shared_line_ids array<string>, stem_line_ids array<string>, start_marker string, end_marker string, options map<string,array<string>>"
    return s.createDataFrame(ANCHOR_QUESTIONS, schema), lines


def _verify(s, d):
    schema = "question long, number string, answer string, expected_table string, expected_prefix string, expected_inline string, blank_cell boolean, sub_matched int, sub_mismatched int, sub_total int, free_text_found boolean, parts_found int, parts_total int, has_section boolean, section string"
    return answers.verify(s.createDataFrame([r[:-3] for r in VERIFY], schema)).select("question", "status", "kind", "reason")


def _hints(s, d):
    rows = [(1, "1", "", "exact", "single_choice", ["A"], [], False, "A", "x"), (2, "2", "s", "exact", "single_choice", [], [], False, "", "llm_fallback"), (3, "3", "s", "retry", "multiple_choice", ["A"], ["D", "B"], True, "A", "x"), (4, "4", "s", "exact", "fill_in", [], [], False, "", "document_answer_table")]
    schema = "pos int, question_number string, stem string, stem_status string, qtype string, options array<string>, bad_options array<string>, sub_options_bad boolean, answer string, answer_source string"
    return annotations.retry_hints(s.createDataFrame(rows, schema))


def _matched(s, d):
    rows = [(1, "single_choice", "s", False, "B", "C", True, None, None), (2, "single_choice", "s", False, "B", "C", False, None, None), (3, "fill_in", "s", False, "x=1", None, None, "y", None), (4, "single_choice", "s", False, "two words", None, None, "D", None),
            (5, "fill_in", "s", True, "(1) a (2) b", "A", False, None, None), (6, "fill_in", "求 sin x", False, None, "2 2", False, None, None), (7, "fill_in", "s", False, None, None, None, None, None), (8, "fill_in", "s", False, None, None, None, None, "in")]
    found = gates.match_answers(s.createDataFrame(rows, "question long, qtype string, stem string, is_composite boolean, annotated string, table string, from_ocr boolean, solution string, inline string"))
    return found.select("question", "final.answer", "final.source", "final.confidence")


QUERIES |= {
    "question_starts": lambda s, d: anchors.question_starts(_anchor(s)[1]),
    "stem_ranges": lambda s, d: anchors.resolve_stems(*_anchor(s)),
    "composite_stems": lambda s, d: anchors.resolve_composites(*_anchor(s)).where("question_id in (4, 5)"),
    "stems_truncated": lambda s, d: anchors.truncated_stems(*_anchor(s)).select("question_id", F.array_join("stem_line_ids", ",").alias("ids")),
    "anchors_validated": lambda s, d: anchors.validated_anchors(*_anchor(s)).select("question_id", "field", "status", "reason", F.array_join("line_ids", ",").alias("ids")),
    "stems_without_options": lambda s, d: anchors.stems_without_options(anchors.validated_anchors(*_anchor(s))).select("question_id", F.array_join("line_ids", ",").alias("ids")),
    "anchor_summary": lambda s, d: anchors.anchor_summary(anchors.validated_anchors(*_anchor(s))).select(F.array_join(F.transform(F.map_entries("summary"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("summary")),
    "first_options": lambda s, d: anchors.first_options(_anchor(s)[0].withColumn("low", F.lit(1)).withColumn("stop", F.lit(99)), _anchor(s)[1]),
    "answer_tables": lambda s, d: answers.answer_table(s.createDataFrame(ANSWER_LINES, "doc_id long, line_no int, text string, source string")),
    "solution_answers": lambda s, d: answers.solution_answers(s.createDataFrame(SEGMENTS, "doc_id long, number int, seq int, text string")),
    "answers_matched": _matched,
    "answers_verified": _verify,
    "retry_hints": _hints,
}
ORACLES |= {
    "question_starts": values("doc_id BIGINT, number INTEGER, \"order\" INTEGER", [(1, 1, 2), (1, 2, 7), (1, 3, 10), (1, 4, 14)]),
    "stem_ranges": values("question_id BIGINT, low INTEGER, high INTEGER, status VARCHAR, confidence DOUBLE, rule VARCHAR", [(1, 2, 3, "semantic", 1.0, "first_option"), (2, 7, 9, "semantic", 1.0, "next_question"), (3, 10, 11, "fuzzy", 0.916667, "end_marker")]),
    "composite_stems": values("question_id BIGINT, low INTEGER, high INTEGER, rule VARCHAR", [(4, 12, 16, "answers"), (5, 2, 6, "next_question")]),
    "stems_truncated": values("question_id BIGINT, ids VARCHAR", [(1, "P1L002,P1L003,P1L004"), (2, "P1L007"), (3, "P1L010,P1L011"), (4, "P2L001"), (5, "P1L002")]),
    "anchors_validated": values("question_id BIGINT, field VARCHAR, status VARCHAR, reason VARCHAR, ids VARCHAR", [
        (1, "stem", "exact", "ok", "P1L002,P1L003,P1L004"), (1, "option_A", "exact", "ok", "P1L004"), (1, "option_B", "exact", "ok", "P1L004"), (1, "option_C", "retry", "wrong_first_line", ""), (1, "option_D", "retry", "no_valid_lines", ""),
        (2, "stem", "exact", "ok", "P1L007,P1L010"), (3, "stem", "exact", "ok", "P1L010,P1L011,P2L003,P2L007"), (4, "stem", "exact", "ok", "P2L001"), (5, "stem", "exact", "ok", "P1L002"),
    ]),
    "stems_without_options": values("question_id BIGINT, ids VARCHAR", [(1, "P1L002,P1L003"), (2, "P1L007,P1L010"), (3, "P1L010,P1L011,P2L003,P2L007"), (4, "P2L001"), (5, "P1L002")]),
    "anchor_summary": values("summary VARCHAR", [("exact=7,retry=2",)]),
    "first_options": values("question_id BIGINT, option_at INTEGER", [(1, 4)]),
    "answer_tables": values("doc_id BIGINT, number INTEGER, answer VARCHAR, source VARCHAR", [(1, 1, "C", "native"), (1, 2, "B", "native"), (1, 3, "D", "ocr"), (1, 4, "had gone", "native"), (1, 5, "A", "native"), (1, 6, "E", "native"), (2, 1, "B", "native")]),
    "solution_answers": values("doc_id BIGINT, number INTEGER, answer VARCHAR", [(1, 17, "所以 tanθ=；-2；（2）最大值为 3"), (1, 18, "（1）x > 1")]),
    "answers_matched": values("question BIGINT, answer VARCHAR, source VARCHAR, confidence DOUBLE", [(1, "B", "llm_annotation", 0.9), (2, "C", "document_answer_table", 0.95), (3, "x=1", "llm_annotation", 0.9), (4, "D", "document_solution_answer", 0.95), (5, "(1) a (2) b", "llm_annotation", 0.9), (6, "2 2", "document_answer_table", 0.4), (7, None, "llm_fallback", 0.5), (8, "in", "document_inline_answer", 0.9)]),
    "answers_verified": values("question BIGINT, status VARCHAR, kind VARCHAR, reason VARCHAR", [(r[0], *r[-3:]) for r in VERIFY]),
    "retry_hints": values("pos INTEGER, hint VARCHAR", [(1, "question 1: stem lines"), (2, "question 2: all options; answer lines"), (3, "question 3: stem lines; options B/D; sub-question options")]),
}
