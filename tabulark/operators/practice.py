"""Practice and generation statistics: wrong answers, mastery, ratios, similar items."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def wrong_counts(answers: DataFrame, key: str) -> DataFrame:
    """key, wrong, students."""
    return answers.where(~F.col("is_correct")).groupBy(key).agg(F.count(F.lit(1)).alias("wrong"), F.countDistinct("student").alias("students"))


def wrong_by(answers: DataFrame, mappings: DataFrame, key: str) -> DataFrame:
    """`key`, wrong, questions: wrong answers per node or type. Answers are counted per question before the mappings
    (question_id, key) multiply them."""
    counted = answers.where(~F.col("is_correct")).groupBy("question_id").agg(F.count(F.lit(1)).alias("c"))
    return mappings.join(counted, "question_id").groupBy(key).agg(F.sum("c").alias("wrong"), F.countDistinct("question_id").alias("questions"))


def weak_points(answers: DataFrame, at_least: int = 5) -> DataFrame:
    """student, node, attempts, rate for nodes tried often enough."""
    out = answers.groupBy("student", "node").agg(F.count(F.lit(1)).alias("attempts"), F.round(F.avg(F.col("is_correct").cast("int")), 6).alias("rate"))
    return out.where(F.col("attempts") >= at_least)


def mastery(answers: DataFrame, recent: int = 5) -> DataFrame:
    """student, node, attempts, correct and the rate of the last `recent` answers. The reference length of the
    window is not given anywhere, so it is a parameter."""
    last = Window.partitionBy("student", "node").orderBy(F.desc("ts"), F.desc("answer_id"))
    rows = answers.withColumn("_rn", F.row_number().over(last)).withColumn("_ok", F.col("is_correct").cast("int"))
    return rows.groupBy("student", "node").agg(F.count(F.lit(1)).alias("attempts"), F.sum("_ok").alias("correct"), F.round(F.avg(F.when(F.col("_rn") <= recent, F.col("_ok"))), 6).alias("recent_rate"))


def shares(rows: DataFrame, key: str, within: str | None = None) -> DataFrame:
    """key, n, share of the total (or of the total inside `within`)."""
    keys = [within, key] if within else [key]
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy(within).agg(F.sum("n").alias("_t")) if within else counted.agg(F.sum("n").alias("_t"))
    joined = counted.join(totals, within) if within else counted.join(F.broadcast(totals))  # the second is one row
    return joined.select(*keys, "n", F.round(F.col("n") / F.col("_t"), 6).alias("share"))


def similar(queries: DataFrame, vectors: DataFrame, k: int = 5, block: int = 10_000, part: int = 8_000) -> DataFrame:
    """query_id, vec_id, score, rank: exact nearest vectors by cosine, to six places. Queries are cut into parts and vectors into blocks, and
    each part meets each block in one task, as matrices. Work grows with the product of both, memory does not. A pair has no score
    (null, which ranks last) where a vector is null, holds nulls, is all zeros or differs in length."""

    def cut(df: DataFrame, mine: str, n: int, other: str, others: int) -> DataFrame:
        whole = F.when(~F.exists("embedding", lambda e: e.isNull()), F.col("embedding"))
        rows = df.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("id"), whole.alias("vec"))
        return rows.withColumn(mine, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    blocks, parts = (max(1, -(-df.count() // size)) for df, size in ((vectors, block), (queries, part)))
    left, right = cut(queries, "part", parts, "block", blocks), cut(vectors, "block", blocks, "part", parts)
    met = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(lambda q, v: nearest(q, v, k), "query_id long, vec_id long, score double")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def half_up(x: np.ndarray) -> np.ndarray:
    """Rounded to six places as Spark rounds: halves of the written number go away from zero."""
    scaled = np.abs(x) * 1e6
    out = np.copysign(np.floor(scaled + 0.5) / 1e6, x)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-8):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


def nearest(q: pa.Table, v: pa.Table, k: int, rows: int = 256, pairs: int = 50_000) -> pa.Table:
    """query_id, vec_id, score: the k best of the vectors (id, vec) for each query (id, vec), more only in ties of the end. Products of unit
    rows choose the candidates, with a margin; their scores are summed in the order of the elements, as `cosine` does."""
    sizes = lambda t: pc.fill_null(pc.list_value_length(t.column("vec")), -1).to_numpy()
    ids, names, of_v, of_q, found = v.column("id").to_numpy(), q.column("id").to_numpy(), sizes(v), sizes(q), []

    def matrix(t: pa.Table, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        x = t.column("vec").take(pa.array(at)).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
        return x, np.sqrt(np.cumsum(x * x, 1)[:, -1])

    for size in np.unique(of_q):
        asked = np.flatnonzero(of_q == size)
        at = np.flatnonzero(of_v == size) if size > 0 else asked[:0]
        x, nx = matrix(v, at, size) if len(at) else (np.zeros((0, max(size, 1))), np.zeros(0))
        at, x, nx = at[~(nx <= 0)], x[~(nx <= 0)], nx[~(nx <= 0)]
        without = np.ones(len(ids), bool)
        without[at] = False
        bare = np.sort(ids[without])[: k + 1]
        for i in range(0, len(asked), rows):
            some = asked[i : i + rows]
            y, ny = matrix(q, some, size) if size > 0 else (np.zeros((len(some), 1)), np.zeros(len(some)))
            with np.errstate(all="ignore"):
                rough = (y / ny[:, None]) @ (x / nx[:, None]).T
            rough[np.isnan(rough)] = np.inf
            rough[(names[some][:, None] == ids[at][None]) | (ny <= 0)[:, None]] = -np.inf
            least = np.partition(rough, -k, 1)[:, -k] - 2e-6 if rough.shape[1] > k else np.full(len(some), -np.inf)
            of, to = np.nonzero((rough >= least[:, None]) & (rough > -np.inf))
            score = np.empty(len(of))
            with np.errstate(all="ignore"):
                for j in range(0, len(of), pairs):
                    a, b = of[j : j + pairs], to[j : j + pairs]
                    score[j : j + pairs] = np.cumsum(y[a] * x[b], 1)[:, -1] / (ny[a] * nx[b])
            order = np.lexsort((ids[at][to], -np.where(np.isnan(score), np.inf, half_up(score)), of))
            of, to, score = of[order], to[order], score[order]
            best = np.arange(len(of)) - np.searchsorted(of, of) < k
            found.append((names[some][of[best]], ids[at][to[best]], score[best], np.zeros(best.sum(), bool)))
            few = np.flatnonzero(np.bincount(of, minlength=len(some)) < k) if len(bare) or (ny <= 0).any() else of[:0]
            for f in few:
                rest = bare if ny[f] > 0 or np.isnan(ny[f]) else np.sort(ids)[: k + 1]
                rest = rest[rest != names[some][f]]
                found.append((np.full(len(rest), names[some][f]), rest, np.zeros(len(rest)), np.ones(len(rest), bool)))
    query_id, vec_id, score, bare = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))
    return pa.table({"query_id": pa.array(query_id, pa.int64()), "vec_id": pa.array(vec_id, pa.int64()), "score": pa.array(score, pa.float64(), mask=bare)})
