"""A literal exam for the rules that need a document: lines, annotated questions, answers, solutions, evidence."""

#: (doc_id, line_id, order, page_no, text)
ANCHOR_LINES = [
    (1, "P1L001", 1, 1, "Exam of the spring term"), (1, "P1L002", 2, 1, "1. Which of the following"), (1, "P1L003", 3, 1, "statements about water is true"), (1, "P1L004", 4, 1, "A. It is wet B. It is dry"), (1, "P1L005", 5, 1, "C. It burns"), (1, "P1L006", 6, 1, "（1）（集团校自创题）"),
    (1, "P1L007", 7, 1, "2."), (1, "P1L008", 8, 1, "Describe the boiling of water"), (1, "P1L009", 9, 1, "in your own words"), (1, "P1L010", 10, 1, "3. Name two gases of the air"), (1, "P1L011", 11, 1, "and give their shares"),
    (1, "P2L001", 12, 2, "Read the passage about rivers"), (1, "P2L002", 13, 2, "The river rises in the hills"), (1, "P2L003", 14, 2, "4. Fill in the blanks"), (1, "P2L004", 15, 2, "(1) the river ___"), (1, "P2L005", 16, 2, "(2) the hills ___"), (1, "P2L006", 17, 2, "参考答案"), (1, "P2L007", 18, 2, "1. A 2. see above 3. nitrogen"),
]
#: (doc_id, question_id, number, qtype, is_composite, shared_line_ids, stem_line_ids, start_marker, end_marker, options)
ANCHOR_QUESTIONS = [
    (1, 1, "1", "single_choice", False, [], ["P1L002", "P1L003", "P1L004"], "Which of the following", "water is true", {"A": ["P1L004"], "B": ["P1L004"], "C": ["P1L002"], "D": ["P9L001"]}),
    (1, 2, "2", "short_answer", False, [], ["P1L007", "P1L010", "P9L009"], "Describe the boiling", None, {}),
    (1, 3, "3", "true_false", False, [], ["P1L010", "P1L011", "P2L003", "P2L007"], "Name two gasxs", "their shares", {}),
    (1, 4, "4", "fill_in", True, ["P2L001"], ["P2L001"], None, None, {}),
    (1, 5, "x", "fill_in", True, [], ["P1L002"], "", "", {}),
]
#: (doc_id, line_no, text, source)
ANSWER_LINES = [
    (1, 1, "1. a question", "native"), (1, 2, "参考答案", "native"), (1, 3, "题号 1 2", "native"), (1, 4, "答案 C B", "native"), (1, 5, "1. D", "native"), (1, 6, "<table><tr><td>题号</td><td>3</td></tr><tr><td>答案</td><td>D</td></tr></table>", "ocr"),
    (1, 7, "4.【答案】had gone", "native"), (1, 8, "4. other", "ocr"), (1, 9, "【详解】 why", "native"), (1, 10, "5. not an answer", "native"), (1, 11, "答案：", "native"), (1, 12, "5. A 6. E （2分）", "native"), (1, 13, "三、解答题", "native"), (1, 14, "7. G", "native"),
    (2, 1, "Answer Key", "native"), (2, 2, "（1）A", "ocr"), (2, 3, "（1）B", "native"), (3, 1, "1. no heading", "native"),
]
#: (doc_id, number, seq, text)
SEGMENTS = [
    (1, 17, 1, "解：设 x"), (1, 17, 2, "所以 tanθ="), (1, 17, 3, "-2 3分"), (1, 17, 4, "（2）最大值为 3（4分）"), (1, 17, 5, "（3）不存在，理由如下：2分"), (1, 17, 6, "所以 y="), (1, 17, 7, "a long line that is no result at all"),
    (1, 18, 1, "（1）x > 1"), (1, 18, 2, "（1）x > 1"), (1, 18, 3, "12"), (1, 19, 1, "nothing"),
]
_ESSAY = "The essay " * 15
#: question .. section, then status, kind, reason
VERIFY = [
    (1, "1", "A", "A", None, None, None, 0, 0, 0, None, 0, 0, True, "", "matched", "table", None), (2, "2", "B", "A", None, None, None, 0, 0, 0, None, 0, 0, True, "", "mismatched", "table", None),
    (3, "3", "$\\frac{4}{3}$", None, "4/3", None, None, 0, 0, 0, None, 0, 0, True, "", "matched", "prefix", None), (4, "4", " ", None, None, None, None, 0, 0, 0, None, 0, 0, True, "", "unverifiable", None, "missing_db_answer"),
    (5, "x", "A", None, None, None, None, 0, 0, 0, None, 0, 0, True, "", "unverifiable", None, "invalid_question_number"), (6, "6", "A", None, None, None, True, 0, 0, 0, None, 0, 0, True, "", "unverifiable", None, "blank_table_cell"),
    (7, "7", "ab", None, None, None, None, 2, 0, 2, None, 0, 0, True, "", "matched", "composite", None), (8, "8", "ab", None, None, None, None, 1, 1, 2, None, 0, 0, True, "", "mismatched", "composite", None),
    (9, "9", "ab", None, None, None, None, 1, 0, 2, None, 0, 0, True, "", "unverifiable", None, "composite_subquestion"), (10, "10", "text", None, None, None, None, 0, 0, 0, True, 0, 0, True, "", "matched", "free_text", None),
    (11, "11", "（1）a；（2）b", None, None, None, None, 0, 0, 0, None, 2, 2, True, "", "matched", "structured", None), (12, "12", "（1）a；（2）b", None, None, None, None, 0, 0, 0, None, 1, 2, True, "", "unverifiable", None, "structured_partial"),
    (13, "13", "A", None, None, None, None, 0, 0, 0, None, 0, 0, False, "", "unverifiable", None, "missing_answer_evidence"), (14, "14", "AB", None, None, None, None, 0, 0, 0, None, 0, 0, True, "", "unverifiable", None, "no_answer_evidence"),
    (15, "15", _ESSAY, None, None, None, None, 0, 0, 0, None, 0, 0, True, "x " + _ESSAY, "matched", "essay", None), (16, "16", _ESSAY, None, None, None, None, 0, 0, 0, None, 0, 0, True, "x", "unverifiable", None, "essay_manual_review"),
    (17, "17", "some words", None, None, None, None, 0, 0, 0, None, 0, 0, True, "x", "unverifiable", None, "free_text_answer"), (18, "18", "a", None, None, "Ａ", None, 0, 0, 0, None, 0, 0, True, "", "mismatched", "inline", None),
]
