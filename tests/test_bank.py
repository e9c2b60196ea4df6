"""The hand-checkable star: three questions, five instances, four mappings."""

import pytest
from pyspark.sql import functions as F

from tabulark.operators import bank
from tabulark.operators.bank import Filters, Star


@pytest.fixture(scope="module")
def star(spark):
    q = spark.createDataFrame(
        [(1, "math", "g2", "single choice", 2, "approved", "a b"), (2, "math", "g2", "fill", 3, "approved", "b%c"), (3, "physics", "g1", "single choice", 4, "reviewing", "c")],
        "id long, subject string, grade string, qtype string, difficulty int, status string, stem string",
    ).withColumn("confidence", F.lit(0.7).cast(bank.CONFIDENCE)).withColumn("created", F.col("id"))
    i = spark.createDataFrame([(1, 1, 1, 2024, "A"), (1, 1, 2, 2025, "B"), (1, 2, 3, 2024, "C"), (2, 1, 4, 2025, "A"), (3, 1, 5, 2024, "A")], "question_id long, document_id long, number int, year int, school string")
    m = spark.createDataFrame([(1, "kp1"), (2, "kp2"), (1, "kp2"), (3, "kp3")], "question_id long, node string")
    return Star(q, i, m)


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_statistics(star):
    s = bank.statistics(star, Filters())
    assert as_set(s["total"]) == {(3,)}
    assert as_set(s["by_type"]) == {("single choice", 2), ("fill", 1)}
    assert as_set(s["by_difficulty"]) == {("2", 1), ("3", 1), ("4", 1)}
    assert [tuple(r) for r in s["nodes"].collect()] == [("kp2", 2), ("kp1", 1), ("kp3", 1)]
    assert as_set(s["year_trend"]) == {(2024, 2), (2025, 2)}
    assert as_set(s["node_year_trend"]) == {("kp1", 2024, 2), ("kp1", 2025, 1), ("kp2", 2024, 2), ("kp2", 2025, 2), ("kp3", 2024, 1)}


def test_same_instance_rule(star):
    assert bank.base(star, Filters(year=2024, school="B")).count() == 0
    assert as_set(bank.base(star, Filters(year=2025, school="B")).select("id")) == {(1,)}


def test_null_rules(star, spark):
    q = star.questions.withColumn("difficulty", F.lit(None).cast("int")).withColumn("qtype", F.lit(None).cast("string"))
    bare = Star(q, star.instances, star.mappings)
    assert as_set(bank.difficulty_distribution(bare, Filters())) == {("None", 3)}
    assert bank.type_distribution(bare, Filters()).count() == 0


def test_search_and_catalog(star):
    assert [r.id for r in bank.search(star, Filters(status="approved")).collect()] == [2, 1]
    assert as_set(bank.catalog(star)) == {("math", "g2", 2), ("physics", "g1", 1)}
    assert as_set(bank.base(star, Filters(term="%")).select("id")) == {(1,), (2,), (3,)}
    assert as_set(bank.base(star, Filters(term="%", wildcards=False)).select("id")) == {(2,)}
    with pytest.raises(ValueError):
        bank.page(star.questions, [F.asc("id")], 0, 10)


def test_duplicate_mapping_counts_twice(star):
    twice = Star(star.questions, star.instances, star.mappings.unionAll(star.mappings.where("node = 'kp3'")))
    assert ("kp3", 2024, 2) in as_set(bank.node_year_trend(twice, Filters()))
