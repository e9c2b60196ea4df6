"""Queries and their SQL read all rows and whole texts, on ids beyond any bound."""

import difflib

import duckdb
import pytest

from tabulark.operators import dedup
from tabulark.plans import line_queries as lq, merge_queries as mq, stream_queries as sq
from tests.test_queries import QUERIES, rows

@pytest.fixture(scope="module")
def far(sf, tmp_path_factory):
    """sf0.001 with the ids of its orders, customers and events moved beyond all former bounds."""
    d, con = str(tmp_path_factory.mktemp("far")), duckdb.connect()
    moved = {
        "lineitem": "* REPLACE (CAST(l_orderkey + 4000 AS BIGINT) AS l_orderkey) FROM {}",
        "customer": "* REPLACE (CAST(c_custkey + 1000 AS BIGINT) AS c_custkey) FROM {}",
        "events": "* REPLACE (CAST(event_id + 6000 AS BIGINT) AS event_id) FROM {}",
    }
    for t in [*moved, "documents", "region", "nation", "supplier"]:
        con.execute(f"COPY (SELECT {moved.get(t, '* FROM {}').format(repr(f'{sf}/{t}.parquet'))}) TO '{d}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return d, con


def same(spark, far, name, sql):
    d, con = far
    got, want = rows(QUERIES[name](spark, d).toPandas()), rows(con.execute(sql).df())
    assert got and got == want


@pytest.mark.parametrize("name", ["iou_pairs", "spatial_anti", "nearest_neighbor", "point_in_box"])
def test_every_order_has_its_box(name, spark, far):
    same(spark, far, name, mq.ORACLES[name])


def test_dedup_sees_every_line(spark, far):
    d, con = far
    same(spark, far, "bucket_dedup", mq.ORACLES["bucket_dedup"])
    assert QUERIES["bucket_dedup_stats"](spark, d).first().original == con.execute("SELECT count(*) FROM lineitem").fetchone()[0]


def test_boxes_of_one_centre_and_other_sizes_stay(spark):
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    rows = [(1, 1, (0.0, 0.0, 100.0, 100.0)), (2, 1, (40.0, 40.0, 60.0, 60.0)), (3, 1, (1.0, 1.0, 101.0, 101.0)), (4, 2, (0.0, 0.0, 100.0, 100.0)), (5, 1, None), (6, 1, (4.0, 0.0, 4.0, 2.0)), (7, 1, (0.0, 0.0, 1.0, 1.0))]
    got = dedup.dedup_boxes(spark.createDataFrame(rows, f"image_id long, page long, box {box}")).collect()
    assert sorted((r.image_id, r.method) for r in got if not r.kept) == [(3, "iou"), (7, "distance")]


@pytest.mark.parametrize("name", ["quality_score", "rule_failures"])
def test_gate_scores_whole_documents(name, spark, far):
    same(spark, far, name, mq.ORACLES[name])


def test_gate_judges_whole_documents(spark, far):
    d, con = far
    got = {r.doc_id: r for r in QUERIES["gate_decision"](spark, d).collect()}
    size = dict(con.execute("SELECT doc_id, length(text) FROM documents").fetchall())
    assert got.keys() == size.keys()
    # Only rules 1 and 2 come before the stem's length; every 17th stem is blank.
    long = {k for k, n in size.items() if k % 17 and n > 3000}
    assert long and all(got[k].reason in ("r02", "r03") and got[k].decision == "reject" for k in long)
    assert QUERIES["gate_distribution"](spark, d).agg({"n": "sum"}).first()[0] == len(size) > 0


def test_coverage_of_whole_texts(spark, far):
    same(spark, far, "coverage_ratio", mq.ORACLES["coverage_ratio"])


def test_coverage_of_repeated_ids_and_empty_texts(spark, tmp_path):
    docs = [(1, "ab" * 100), (1, "ab" * 100), (1, "abc" * 90 + "x"), (2, "xy" * 30 + "é" * 61), (3, ""), (4, None), (5, ""), (5, "z" * 81), (None, "ab" * 100), (None, "abcdefghi" * 37), (None, None)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(spark, (str(tmp_path), con), "coverage_ratio", mq.ORACLES["coverage_ratio"])


def test_verdicts_compare_whole_texts(spark, tmp_path):
    """The second side differs from the first behind 300 characters only."""
    head = "a" * 400
    docs = [(1, head + " b"), (2, head + ".b"), (3, head), (5, head + "b"), (6, head), (8, head + "b"), (11, "A" * 400 + "b")]
    spark.createDataFrame([(k, "en", t) for k, t in docs], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {name: {r.verdict: r.n for r in QUERIES[name](spark, str(tmp_path)).collect()} for name in ("verdict_hist", "ab_lenient")}
    assert found["verdict_hist"] == {"format": 1, "punct_diff": 1, "mismatch": 3, "exact": 2}
    assert found["ab_lenient"] == {"format": 1, "semantic": 3, "format_diff": 1, "raw_exact": 2}
    rate = QUERIES["ab_pass_rate"](spark, str(tmp_path)).first()
    assert (rate.passed, rate.total) == (4, 7)


def test_overlap_meets_every_order(spark, far):
    d, con = far
    found = {}
    for k, v in con.execute("SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem").fetchall():
        found.setdefault(k, set()).add(v)
    want = {}
    for k, own in found.items():
        # Entries agree wherever a supplier is common, so the score is 0.6 of the share in common plus 0.4.
        scores = [(round(0.6 * len(own & found[o]) / len(own) + 0.4, 6), -o) for o in range(k // 20 * 20 + 1, k // 20 * 20 + 20, 2) if own & found.get(o, set())]
        if k % 2 == 0 and scores:
            want[k] = (-max(scores)[1], max(scores)[0])
    assert {r.left_id: (r.right_id, r.score) for r in QUERIES["best_overlap_match"](spark, d).collect()} == want != {}


def test_points_of_every_customer(spark, far):
    d, con = far
    assert {r.question_id for r in QUERIES["deepest_match"](spark, d).collect()} == {r[0] for r in con.execute("SELECT c_custkey FROM customer").fetchall()}


def test_first_success_of_every_event(spark, far):
    same(spark, far, "first_success", sq.ORACLES["first_success"])


@pytest.mark.parametrize("name, oracles", [("arbitrate_lines", mq.ORACLES), ("majority_vote", mq.ORACLES), ("best_pass", lq.ORACLES)])
def test_every_line_takes_part(name, oracles, spark, far):
    same(spark, far, name, oracles[name])


def test_similarity_join_takes_every_line(spark, tmp_path):
    texts = ["one line here\n\nsecond line of text", "one lime here\ny\nsecond line of tent\none more line", "second lime of test\n" + "long " * 13 + "line!", "zzzzzzzzzzzzzzzzzzz"]
    texts += ["second lime of test\n" + "long " * 15 + "line!\nsecond lint of text", None, "one line here"] + ["x"] * 13 + ["one line here"]  # the last stands on the next page
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lines = [(k, i, t) for k, text in enumerate(texts) for i, t in enumerate((text or "").split("\n"), 1)]
    want = []
    for k, i, a in lines:
        for o, j, b in lines:
            x, y = a.strip(" "), b.strip(" ")
            if k // 20 == o // 20 and i == j and k != o and x and y and min(len(x), len(y)) / max(len(x), len(y)) >= 0.3:
                found = 0.7 * difflib.SequenceMatcher(None, x, y).ratio() + 0.3 * len(set(x) & set(y)) / len(set(x) | set(y))
                want += [(k, o, i, round(found, 6))] if found > 0.6 else []
    got = [r for r in map(tuple, QUERIES["similarity_join"](spark, str(tmp_path)).collect())]
    assert sorted(got) == sorted(want) and len(want) >= 12