"""Similar vectors by inverted lists: every vector stands in the list of its nearest centroid, a query looks into the lists nearest to it.

The centroids are fitted on a sample of at most `sample_rows` vectors, and on the same sample the number of lists to look into is
set so that a stated share of true neighbours is found; all vectors are indexed. A list is cut into blocks of vectors and its
queries into parts, by counts of both per list, so that one task holds a block and a part however many vectors crowd one list.
`practice.similar` is the exact way.

Defined cases: vectors that are null, without an id or of another length than most are neither indexed nor searched; a vector of zeros has
similarity 0 to all; equal scores (to six places) rank by id; a query's own id is no result; with no vectors there are none.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 20_000
LISTED = pa.schema([("id", pa.int64()), ("vec", pa.list_(pa.float32())), ("list", pa.int32())])
LISTED_DDL = "id long, vec array<float>, list int"
HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
HITS_DDL = "query_id long, vec_id long, score double"


@dataclass
class Index:
    centroids: np.ndarray
    probes: int

    @property
    def dims(self) -> int:
        return self.centroids.shape[1]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Unit rows; rows of zeros stay."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


def fit(vectors: DataFrame, sample_rows: int = 20_000, lists: int | None = None, found: float = 0.97, k: int = 5, rounds: int = 12, seed: int = 3) -> Index:
    """Centroids by spherical k-means on the sample, and the probes that find the share `found` of the k neighbours inside it."""
    rows = vectors.where("embedding is not null").select("vec_id", "embedding")
    size = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None or not size.d:
        return Index(np.zeros((1, 1)), 1)
    sample = rows.where(F.size("embedding") == size.d).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toArrow()
    x = _matrix(sample.column("embedding").combine_chunks(), size.d)
    n = lists or max(1, min(4096, round(math.sqrt(len(x)) / 2)))
    rng = np.random.default_rng(seed)
    centroids = x[rng.permutation(len(x))[:n]].copy()
    for _ in range(rounds):
        near = (x @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        full = np.linalg.norm(sums, axis=1) > 0
        centroids[full] = sums[full] / np.linalg.norm(sums[full], axis=1, keepdims=True)
    near = (x @ centroids.T).argmax(1)
    asked = rng.permutation(len(x))[:1000]
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-scores, 1)[:, : min(k, len(x) - 1)]
    rank = np.argsort(np.argsort(-(x[asked] @ centroids.T), 1), 1)  # of each list for each query
    needed = np.take_along_axis(rank, near[best], 1).ravel() + 1
    return Index(centroids, int(np.quantile(needed, found, method="higher")) if len(needed) else 1)


def listed(vectors: DataFrame, index: Index, probes: int = 1) -> DataFrame:
    """id, vec (unit), list: a row for each of the `probes` nearest lists of every vector."""

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), index.dims)
            near = np.argsort(-(x @ index.centroids.T), 1, kind="stable")[:, :probes]
            at = np.repeat(np.arange(len(x)), near.shape[1])
            vec = pa.FixedSizeListArray.from_arrays(pa.array(x[at].astype(np.float32).ravel()), index.dims).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), vec, pa.array(near.ravel().astype(np.int32))], schema=LISTED)

    rows = vectors.where((F.size("embedding") == index.dims) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return rows.mapInArrow(run, LISTED_DDL)


def search(queries: DataFrame, vectors: DataFrame, index: Index, k: int = 5, block: int = BLOCK) -> DataFrame:
    """query_id, vec_id, score, rank among the vectors of the lists that each query looks into."""
    rows, asked = listed(vectors, index), listed(queries, index, index.probes)
    count = lambda df, name: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    cuts = F.broadcast(count(rows, "blocks").join(count(asked, "parts"), "list"))  # a row for each list, 4,096 at most
    cut = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(cuts, "list").withColumn("part", cut("parts")).withColumn("block", every("blocks")).select("list", "block", "part", "id", "vec")
    right = rows.join(cuts, "list").withColumn("block", cut("blocks")).withColumn("part", every("parts")).select("list", "block", "part", "id", "vec")

    def meet(q: pa.Table, v: pa.Table) -> pa.Table:
        if not q.num_rows or not v.num_rows:
            return HITS.empty_table()
        ids, found = v.column("id").to_numpy(), []
        x = _matrix(v.column("vec").combine_chunks(), index.dims)
        for at in range(0, q.num_rows, 256):
            some = q.slice(at, 256)
            names = some.column("id").to_numpy()
            scores = np.round(_matrix(some.column("vec").combine_chunks(), index.dims) @ x.T, 6) + 0.0
            scores[names[:, None] == ids[None]] = -np.inf
            of, to = np.nonzero(scores >= np.partition(scores, -k, 1)[:, -k:][:, :1]) if scores.shape[1] > k else np.indices(scores.shape).reshape(2, -1)
            order = np.lexsort((ids[to], -scores[of, to], of))  # only of each row's k best and what equals the last of them
            of, to = of[order], to[order]
            best = np.arange(len(of)) - np.searchsorted(of, of) < k
            found.append((names[of[best]], ids[to[best]], scores[of[best], to[best]]))
        columns = [np.concatenate(c) for c in zip(*found)]
        keep = np.isfinite(columns[2])
        return pa.table([pa.array(c[keep], f.type) for c, f in zip(columns, HITS)], schema=HITS)

    keys = ["list", "block", "part"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, HITS_DDL)
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # repeated rows
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """n_true, n_found: how many of the exact results an index has found. A result as good as the last exact one counts, so that ties
    at the end do not."""
    worst = exact.groupBy("query_id").agg(F.min("score").alias("worst"), F.count(F.lit(1)).alias("n"))
    good = found.join(worst, "query_id", "right").groupBy("query_id", "n").agg(F.count_if(F.col("score") >= F.col("worst") - 2e-6).alias("hits"))
    return good.agg(F.sum("n").alias("n_true"), F.sum(F.least("n", "hits")).alias("n_found"))
