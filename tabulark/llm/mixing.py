"""Mixing sources to target weights by soft membership.

A classifier fitted on a labelled table gives every document posteriors p over domains. Rates r >= lower are then
fitted so that the expected token totals sum_i r_i t_i p_ik match the targets T_k: the minimum of
  1/2 sum_k (sum_i r_i t_i p_ik - T_k)^2 / (T_k T) + mu/2 sum_i (t_i / T) (r_i - 1)^2,   T = sum_k T_k,
where the second term makes the answer unique and keeps rates near one. It is found by distributed projected gradient:
each document takes a step against its gradient, scaled by the K x K second moment of the documents off the bound, and
is projected on r >= lower. A round is two passes over the documents, and only sums over documents go to the driver:
first that second moment and the gradient's moments, then the K totals that steps of several lengths would reach, of
which the best is taken. Rates are a written column, renewed every few rounds. About ten rounds suffice.

Copies are rates rounded so that domains keep their totals: a document's fraction is rounded up if it beats a draw of its
hash by more than its domain's threshold, and thresholds are set to one document by two histograms (`thresholds`).

Defined cases: null text counts as empty; a document without words has rate 1 (or `lower`, if larger) and adds
nothing; conflicting labels of a document are averaged; a domain without mass cannot be reached and is left out of the targets; without labels all documents
share one uniform posterior; repeated rows get equal rates; an empty table stays empty; other columns are kept.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabulark.llm.common import Scratch, sub_batches, tidy
from tabulark.llm.factorisation import DIMS, features, fit
from tabulark.llm.factorisation import rounds as training_rounds

#: Domains of the labelled table: 2 * quality + toxic.
DOMAINS = ["low", "low_toxic", "good", "good_toxic"]


def train_softmax(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int = len(DOMAINS), epochs: int = 6, batch: int = 64, rate: float = 0.3, l2: float = 1e-6, seed: int = 5) -> dict:
    """Multinomial logistic regression by AdaGrad. `y` holds a row of class shares for each document."""
    rng = np.random.default_rng(seed)
    w, g = np.zeros((DIMS, classes)), np.full((DIMS, classes), 1e-6)
    bias = np.log((y.sum(0) + 0.5) / (len(y) + 0.5 * classes)) if len(y) else np.zeros(classes)
    for _ in range(training_rounds(len(y), batch, epochs)):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            ids, x = np.concatenate([rows[i][0] for i in pick]), np.concatenate([rows[i][1] for i in pick])
            sizes = np.array([len(rows[i][0]) for i in pick])
            z = bias + np.add.reduceat(w[ids] * x[:, None], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            err = softmax(z) - y[pick]
            uniq, inverse = np.unique(ids, return_inverse=True)
            e = np.repeat(err, sizes, 0) * x[:, None]
            d = np.stack([np.bincount(inverse, e[:, k], len(uniq)) for k in range(classes)], 1) / len(pick) + l2 * w[uniq]
            g[uniq] += d * d
            w[uniq] -= rate * d / np.sqrt(g[uniq])
    return {"bias": bias, "w": w.astype(np.float32)}


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def domain_model(docs: DataFrame, labels: DataFrame) -> dict:
    domain = 2 * F.col("quality") + F.col("toxic")
    known = labels.where("quality is not null and toxic is not null").select("doc_id", *[(domain == k).cast("double").alias(d) for k, d in enumerate(DOMAINS)])
    return fit(docs, known, DOMAINS, train=train_softmax)


def with_posteriors(docs: DataFrame, model: dict) -> DataFrame:
    """`docs` with _tokens (words) and _p, the posterior of each domain."""

    def run(batches):
        for whole in batches:
            for part in sub_batches(whole, 1_500_000):
                texts = part.column(0).to_pylist()
                rows = [features(t) for t in texts]
                starts = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])[:-1]])
                ids, x = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
                p = softmax(model["bias"] + np.add.reduceat(model["w"][ids] * x[:, None], starts).astype(float))
                tokens = [len((t or "").encode().split()) for t in texts]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(1, part.num_columns)), pa.array(tokens, pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], names=[*part.schema.names[1:], "_tokens", "_p"])

    kept = [f"`{c}`" for c in docs.columns]
    schema = docs.schema
    out = docs.select(F.col("text").cast("string").alias("_text"), *kept)
    full = T.StructType([*schema.fields, T.StructField("_tokens", T.LongType()), T.StructField("_p", T.ArrayType(T.DoubleType()))])
    return out.mapInArrow(tidy(run), full)


def gradient(p: np.ndarray, r: np.ndarray, e: np.ndarray, mu: float, lower: float) -> tuple[np.ndarray, np.ndarray]:
    """The gradient at r, for residuals e = (sum - T_k) / T_k, and whether a document is off the bound or leaves it."""
    g = p @ e + mu * (r - 1)
    return g, (r > lower) | (g < 0)


def move(p: np.ndarray, r: np.ndarray, e: np.ndarray, v: np.ndarray, mu: float, lower: float) -> np.ndarray:
    """The gradient, scaled for documents off the bound: by the inverse of mu I + p diag(1 / T_k) p' t, whose K x K part is in v."""
    g, free = gradient(p, r, e, mu, lower)
    return np.where(free, (g - p @ v) / mu, g)


def rates(p: np.ndarray, r: np.ndarray, steps: list[tuple], mu: float, lower: float) -> np.ndarray:
    """The rates after projected steps (e, v, length) from r."""
    for e, v, length in steps:
        r = np.maximum(lower, r - length * move(p, r, e, v, mu, lower))
    return r


def _posterior_matrix(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def _summed(slim: DataFrame, numbers, size: int) -> np.ndarray:
    """The sum over batches (t, p, r) of what `numbers` gives: `size` numbers a task."""

    def run(batches):
        total = np.zeros(size)
        for b in batches:
            p = _posterior_matrix(b.column(1), len(DOMAINS))
            total += numbers(b.column(0).to_numpy(zero_copy_only=False).astype(float), p, b.column(2).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(range(size)), pa.array(total)], names=["k", "t"])

    out = np.zeros(size)
    for row in slim.select("_tokens", "_p", "_rate").mapInArrow(run, "k long, t double").groupBy("k").agg(F.sum("t").alias("t")).collect():
        out[row.k] = row.t
    return out


def with_rates(slim: DataFrame, steps: list[tuple], mu: float, lower: float) -> DataFrame:
    """`slim` (_tokens, _p, _rate and others) with the rates after `steps`. Documents without tokens keep theirs."""

    def run(batches):
        for whole in batches:
            for b in sub_batches(whole):
                at = b.schema.get_field_index("_rate")
                p, r = _posterior_matrix(b.column("_p"), len(DOMAINS)), b.column(at).to_numpy(zero_copy_only=False)
                r = np.where(b.column("_tokens").to_numpy(zero_copy_only=False) > 0, rates(p, r, steps, mu, lower), r)
                yield b.set_column(at, "_rate", pa.array(r))

    return slim.mapInArrow(tidy(run), slim.schema)


def fit_rates(slim: DataFrame, targets: np.ndarray, mu: float, lower: float, rounds: int, tol: float, scratch: Scratch, every: int = 4) -> list[tuple]:
    """The steps of `rates` that lead from `_rate` to the optimum. Ends once a plain gradient step of length 1 would move rates by
    `tol` at most (root mean square over tokens). `slim` has _tokens, _p and _rate of documents with tokens."""
    k, total = len(targets), float(targets.sum())
    reach = targets > 0
    if total <= 0:
        return []
    scale = np.where(reach, targets, np.inf)  # a domain that cannot be reached has no residual
    lengths = 0.5 ** np.arange(12)
    reached = _summed(slim, lambda t, p, r: (t * r) @ p, k)
    steps, pending, far = [], [], np.inf
    for _ in range(rounds):
        e = (reached - targets) / scale

        def moments(t, p, r, e=e, pending=tuple(pending)):
            r = rates(p, r, pending, mu, lower)
            g, free = gradient(p, r, e, mu, lower)
            unit = np.maximum(lower, r - g) - r
            return np.concatenate([((p * (t * free)[:, None]).T @ p).ravel(), (t * free * g) @ p, [t @ (unit * unit)]])

        found = _summed(slim, moments, k * k + k + 1)
        far = float(np.sqrt(found[-1] / total))
        if far <= tol:
            break
        v = np.linalg.solve(mu * np.eye(k) + found[: k * k].reshape(k, k) / scale, found[k * k : -1]) / scale

        def tries(t, p, r, e=e, v=v, pending=tuple(pending)):
            r = rates(p, r, pending, mu, lower)
            s = move(p, r, e, v, mu, lower)
            ways = [np.maximum(lower, r - length * s) for length in lengths]
            return np.concatenate([np.append((t * x) @ p, t @ (x - 1) ** 2) for x in ways])

        tried = _summed(slim, tries, len(lengths) * (k + 1)).reshape(len(lengths), k + 1)
        values = ((tried[:, :k] - targets)[:, reach] ** 2 / targets[reach]).sum(1) + mu * tried[:, k]
        best = int(values.argmin())
        pending.append((e, v, lengths[best]))
        reached = tried[best, :k]
        if len(pending) == every:
            slim = scratch.write(with_rates(slim, pending, mu, lower), "rates")
            steps, pending = steps + pending, []
    else:
        warnings.warn(f"mixing rates: a unit step still moves them by {far:.2e} after {rounds} rounds", stacklevel=2)
    return steps + pending


DRAW_BITS, DIGIT_BITS = 32, 16


def _gap(rate: Column) -> Column:
    """How far a document's draw lies above its rate's fraction, as a number of 32 bits: the smallest are rounded up first."""
    return F.floor((F.col("_draw") - (rate - F.floor(rate)) + 1) * F.lit(float(1 << (DRAW_BITS - 1)))).cast("long")


def _domain(p: Column) -> Column:
    return F.array_position(p, F.array_max(p))


def thresholds(fitted: DataFrame) -> dict[int, int]:
    """For each dominant domain the gap below which fractions are rounded up, so that the tokens of the copies are those of the rates
    to one document: a histogram of tokens by the gap's first digit, then one by the second inside the digit that crosses the
    fractions' total. Both have 65,536 rows a domain at most; one row a domain reaches the driver."""
    rate, t = F.col("_rate"), F.col("_tokens")
    rows = fitted.select(_domain(F.col("_p")).alias("domain"), _gap(rate).alias("gap"), t.alias("t"), (t * (rate - F.floor(rate))).alias("part"))
    out = {}
    high = rows.groupBy("domain", F.shiftright("gap", DIGIT_BITS).alias("digit")).agg(F.sum("t").alias("t"), F.sum("part").alias("part"))
    over = Window.partitionBy("domain").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
    high = high.withColumn("upto", F.sum("t").over(over)).withColumn("want", F.sum("part").over(Window.partitionBy("domain")))
    crossed = high.where("upto >= want").groupBy("domain").agg(F.min_by(F.struct("digit", (F.col("upto") - F.col("t")).alias("before"), "want"), "digit").alias("c")).select("domain", "c.*")
    low = rows.join(F.broadcast(crossed), "domain").where(F.shiftright("gap", DIGIT_BITS) == F.col("digit"))  # a row per domain
    low = low.groupBy("domain", "before", "want", "gap").agg(F.sum("t").alias("t"))
    low = low.withColumn("upto", F.col("before") + F.sum("t").over(Window.partitionBy("domain").orderBy("gap").rowsBetween(Window.unboundedPreceding, 0)))
    nearest = F.struct(F.abs(F.col("upto") - F.col("want")).alias("off"), F.col("gap"))
    none = F.struct(F.abs(F.col("before") - F.col("want")).alias("off"), (F.shiftleft(F.shiftright("gap", DIGIT_BITS), DIGIT_BITS) - 1).alias("gap"))
    best = low.groupBy("domain").agg(F.least(F.min(nearest), F.min(none)).alias("best"))
    for row in best.collect():
        out[row.domain] = row.best.gap
    return out


def mixture(docs: DataFrame, labels: DataFrame, weights: list[float] | None = None, temperature: float = 0.7, budget: float | None = None,
            keep_text: bool = True, mu: float = 0.001, lower: float = 0.0, rounds: int = 60, tol: float = 1e-6) -> DataFrame:
    """`docs` with _tokens, _p, _rate and _copies.

    `weights` are target shares of the domains; by default shares rise as mass ** temperature. `budget` is the
    total of tokens aimed at; by default the total of the input, or with lower >= 1 the least total for which no
    domain shrinks. Copies are the rate rounded up or down, by a hash of the row and its domain's threshold."""
    scratch = Scratch(docs.sparkSession)
    model = domain_model(docs, labels)
    draw = F.pmod(F.xxhash64(F.lit("copies"), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    first = F.lit(max(1.0, lower))
    scored = with_posteriors(docs, model).withColumn("_draw", draw).withColumn("_rate", first)
    scored = scratch.write(scored if keep_text else scored.drop("text"), "scored")
    slim = scored.where("_tokens > 0").select("_tokens", "_p", "_rate", "_draw")
    t, p = F.col("_tokens").cast("double"), F.col("_p")
    mass = np.array(slim.agg(*[F.coalesce(F.sum(t * p[i]), F.lit(0.0)) for i in range(len(DOMAINS))]).first())
    share = np.array(weights, float) if weights else np.where(mass > 0, np.maximum(mass, 1e-300) ** temperature, 0.0)
    share = np.where(mass > 0, share, 0.0)
    share = share / share.sum() if share.sum() > 0 else share
    if budget is None:
        budget = float(mass.sum()) if lower < 1 else max((m / s for m, s in zip(mass, share) if s > 0), default=0.0)
    steps = fit_rates(slim, share * budget, mu, lower, rounds, tol, scratch)
    up = thresholds(scratch.write(with_rates(slim, steps, mu, lower), "fitted"))
    # The written rates again, by the same steps from the same start, beside the rows they belong to.
    out = with_rates(scored, steps, mu, lower)
    limit = F.lit(-1).cast("long")
    for domain, gap in up.items():
        limit = F.when(_domain(F.col("_p")) == domain, F.lit(gap).cast("long")).otherwise(limit)
    rate = F.col("_rate")
    return out.withColumn("_copies", (F.floor(rate) + F.when(F.col("_tokens") > 0, (_gap(rate) <= limit).cast("int")).otherwise((F.col("_draw") < rate - F.floor(rate)).cast("int"))).cast("long")).drop("_draw")


def mixing_rates(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, source, n_tokens, a posterior per domain, rate and copies, for every row of `docs`."""
    found = mixture(docs.select("doc_id", "source", "text"), labels, keep_text=False, **options)
    return found.select(
        "doc_id", "source", F.col("_tokens").alias("n_tokens"), *[F.col("_p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)], F.col("_rate").alias("rate"), F.col("_copies").alias("copies")
    )


def mixed(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, all columns, each as often as its copies say. Rows travel as one struct, so no column of
    theirs can clash with the operator's own."""
    packed = docs.select("doc_id", "text", F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"))
    found = mixture(packed, labels, **options).where("_copies > 0")
    found = found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return found.select(*[F.col("row")[c].alias(c) for c in docs.columns])
