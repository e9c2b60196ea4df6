"""The vector index against brute force."""

import numpy as np
import pytest

from tabulark.operators import practice, vector_index

SCHEMA = "vec_id long, embedding array<double>"


def clouds(n, dims=8, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, dims)) * 3
    return [(k, (middle[k % 12] + rng.normal(size=dims)).tolist()) for k in range(n)]


def found_share(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    index = vector_index.fit(df, **options)
    q = df.where("vec_id % 20 = 0")
    hit = vector_index.search(q, df, index)
    row = vector_index.recall(hit, practice.similar(q, df, 5)).first()
    return row.n_found / row.n_true, index, hit


def test_clustered_vectors_need_few_lists(spark):
    share, index, _ = found_share(spark, clouds(1500), found=0.95)
    assert share >= 0.9 and index.probes < len(index.centroids) / 2


def test_all_lists_give_the_exact_rows(spark):
    df = spark.createDataFrame(clouds(300), SCHEMA)
    index = vector_index.fit(df, sample_rows=100)
    index.probes = len(index.centroids)
    q = df.where("vec_id % 20 = 0")
    rows = lambda out: sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 5)) for r in out.collect())
    assert rows(vector_index.search(q, df, index)) == rows(practice.similar(q, df, 5))
    assert rows(vector_index.search(q, df, index, block=7)) == rows(practice.similar(q, df, 5))  # many blocks and parts


def test_a_crowded_list_loses_nothing(spark):
    rows = [(k, [1.0, 0.001 * k]) for k in range(400)] + [(1000 + k, [-1.0, 0.1 * k]) for k in range(40)]
    share, _, _ = found_share(spark, rows, lists=8, found=0.99)
    assert share >= 0.9


def test_odd_vectors(spark):
    rows = [*clouds(60), (100, None), (101, [1.0]), (102, [0.0] * 8), (120, [0.0] * 8), (3, clouds(60)[3][1]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, SCHEMA)
    index = vector_index.fit(df)
    index.probes = len(index.centroids)
    hit = vector_index.search(df, df, index).collect()
    assert {r.query_id for r in hit} == set(range(60)) | {102, 120}
    assert all(r.score == 0 for r in hit if r.query_id in (102, 120)) and not any(r.query_id == r.vec_id for r in hit)
    none = df.where("false")
    assert vector_index.search(none, none, vector_index.fit(none)).count() == 0
    assert vector_index.search(df, none, index).count() == 0
