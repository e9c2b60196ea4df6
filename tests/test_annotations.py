"""Merging of annotated questions."""

import pytest
from pyspark.sql import functions as F

from tabulark.operators import annotations as an

SCHEMA = (
    "doc_id int, pos int, question_number string, section string, stem_line_ids array<string>, shared_line_ids array<string>, answer string, score double, confidence double, page int, "
    "options array<struct<label:string,text:string>>"
)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [
            (1, 1, "15(1)", "s1", ["a", "b"], ["m1"], None, 2.0, 0.9, 3, [("A", "x")]),
            (1, 2, "15(2)", "s1", ["b", "c"], ["m1", "m2"], "q", 3.0, 0.7, 2, [("A", "y"), ("B", "z")]),
            (1, 3, "16", "s2", ["d"], ["m2"], "r", 1.0, 1.0, 4, []),
            (1, 4, "17", "s2", ["e"], [], "t", 1.0, 1.0, 4, []),
        ],
        SCHEMA,
    )


def test_by_parent(rows):
    got = {r.parent: r for r in an.by_parent(rows).collect()}
    assert got[15].stem_line_ids == ["a", "b", "c"] and got[15].score == 5.0 and got[15].confidence == 0.7 and got[15].page == 2 and got[15].answer == "q" and got[16].n == 1


def test_shared_material_and_composites(rows):
    heads = an.shared_material(rows, 3)
    assert {(r.pos, r.head) for r in heads.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    got = an.composites(rows, heads).collect()
    assert len(got) == 1 and got[0].answer == "(15(2)) q (16) r" and [tuple(o) for o in got[0].options] == [("A", "x"), ("B", "z")] and got[0].numbers == ["15(1)", "15(2)", "16"]


def test_word_bank_groups(rows):
    got = an.word_bank_groups(rows, F.lit(True)).orderBy("pos").collect()
    assert [(r.section, r.n) for r in got] == [("s1", 2), ("s2", 2)]
