"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector: its distinct words, hashed to WORD_DIMS places with values log(1 + count) scaled
to length 1, and one indicator per statistic for the bin the statistic falls in. The score is
sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)), linear in the words of the text.

Labels come from rows whose fold (crc32 of doc_id as text, mod 5) is not 0; neither the label, doc_id, lang nor
source is an input. Fitting uses at most `sample_rows` labelled documents, those with the smallest hash of their
id, so the driver's share is bounded; scoring covers every whole text and needs no shuffle. The number of passes over
these rows is a training rule: `epochs`, and more where that would be under 800 batches.

Defined cases: null text counts as empty; an empty text has its statistics only; several label rows of a document
are averaged; with no labels every score is 0.5; repeated rows get equal scores; an empty table stays empty.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulark.llm.common import arrow_rows, bound_batches, fold, string_hashes, sub_batches, tidy
from tabulark.llm.textstats import text_stats

WORD_DIMS, BINS = 8192, 8
#: Upper bounds of the bins of each statistic.
EDGES = {
    "log_words": [1, 2, 3, 4, 5, 6, 7],
    "log_chars": [2, 4, 5, 6, 7, 8, 9],
    "word_length": [2.5, 3.5, 4.2, 5, 6, 8, 12],
    "symbols": [0.001, 0.01, 0.05, 0.1, 0.25, 0.5, 1],
    "letters": [0.3, 0.5, 0.6, 0.7, 0.8, 0.9, 0.96],
    "upper": [0.01, 0.03, 0.06, 0.1, 0.2, 0.4, 0.7],
    "digits": [0.001, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4],
    "repeats": [0.01, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8],
    "dup_lines": [0.01, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8],
    "variety": [0.1, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9],
    "ended_lines": [0.1, 0.2, 0.4, 0.6, 0.8, 0.9, 0.99],
    "punctuation": [0.01, 0.05, 0.1, 0.2, 0.4, 0.8, 1.5],
}
DIMS = WORD_DIMS + BINS * len(EDGES)
_EDGES = [np.array(v) for v in EDGES.values()]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct places and their values."""
    s = text_stats(text)
    n, lines = max(1, s.n_words), max(1, s.n_lines)
    values = (
        math.log1p(s.n_words), math.log1p(s.n_chars), s.word_chars / n, s.n_symbols / n, s.letters / max(1, s.word_chars), s.upper / max(1, s.letters),
        s.digits / max(1, s.word_chars), s.n_repeat_words / n, s.n_dup_lines / lines, len(s.distinct) / n, s.ended_lines / lines, s.punctuation / n,
    )
    places = [WORD_DIMS + BINS * i + int(np.searchsorted(e, v, "right")) for i, (e, v) in enumerate(zip(_EDGES, values, strict=True))]
    if not s.distinct:
        return np.array(places, np.int32), np.ones(len(places), np.float32)
    at = (string_hashes(pa.array(s.distinct, pa.binary())) % np.uint64(WORD_DIMS)).astype(np.int64)
    tf = np.bincount(at, s.counts, WORD_DIMS)
    ids = np.flatnonzero(tf)
    x = np.log1p(tf[ids])
    x /= np.sqrt((x * x).sum())
    return np.concatenate([ids, places]).astype(np.int32), np.concatenate([x, np.ones(len(places))]).astype(np.float32)


def logits(model: dict, ids: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores before the sigmoid of documents whose features begin at `starts`, and the factor sums."""
    vx = model["v"][ids] * x[:, None]
    s = np.add.reduceat(vx, starts)
    q = np.add.reduceat(vx * vx, starts)
    return model["w0"] + np.add.reduceat(model["w"][ids] * x, starts) + 0.5 * (s * s - q).sum(1), s


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def rounds(n: int, batch: int, epochs: int, steps: int = 800) -> int:
    """Passes over n rows: `epochs`, and more where that would be under `steps` batches."""
    return max(epochs, math.ceil(steps * batch / max(n, batch))) if n else 0


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, factors: int = 8, epochs: int = 8, batch: int = 64, rate: float = 0.08, l2: float = 1e-5, seed: int = 7) -> dict:
    """AdaGrad on the logistic loss. Targets may be fractions."""
    rng = np.random.default_rng(seed)
    base = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    model = {"w0": math.log(base / (1 - base)), "w": np.zeros(DIMS), "v": rng.normal(0, 0.02 if len(y) else 0.0, (DIMS, factors))}
    gw, gv, g0 = np.full(DIMS, 1e-6), np.full((DIMS, factors), 1e-6), 1e-6
    for _ in range(rounds(len(y), batch, epochs)):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            ids = np.concatenate([rows[i][0] for i in pick])
            x = np.concatenate([rows[i][1] for i in pick]).astype(float)
            sizes = np.array([len(rows[i][0]) for i in pick])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            z, s = logits(model, ids, x, starts)
            err = sigmoid(z) - y[pick]
            doc = np.repeat(np.arange(len(pick)), sizes)
            uniq, inv = np.unique(ids, return_inverse=True)
            e = err[doc]
            dw = np.bincount(inv, e * x, len(uniq)) / len(pick) + l2 * model["w"][uniq]
            contrib = e[:, None] * (x[:, None] * s[doc] - model["v"][ids] * (x * x)[:, None])
            dv = np.stack([np.bincount(inv, contrib[:, f], len(uniq)) for f in range(factors)], 1) / len(pick) + l2 * model["v"][uniq]
            g0 += float(err.mean()) ** 2
            gw[uniq] += dw * dw
            gv[uniq] += dv * dv
            model["w0"] -= rate * float(err.mean()) / math.sqrt(g0)
            model["w"][uniq] -= rate * dw / np.sqrt(gw[uniq])
            model["v"][uniq] -= rate * dv / np.sqrt(gv[uniq])
    return {"w0": model["w0"], "w": model["w"].astype(np.float32), "v": model["v"].astype(np.float32)}


FEATURE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("y", pa.list_(pa.float64())), ("ids", pa.binary()), ("x", pa.binary())])


def _feature_rows(columns: list[list]):
    for doc_id, text, y in zip(*columns):
        ids, x = features(text)
        yield doc_id, y, ids.tobytes(), x.tobytes()


def fit(docs: DataFrame, labels: DataFrame, label: str | list[str] = "quality", folds: int = 5, sample_rows: int = 8000, train=train) -> dict:
    """A model from at most `sample_rows` labelled documents outside fold 0. Labels of one doc_id are averaged. With a list of
    label columns, `train` gets a column for each."""
    bound_batches(docs.sparkSession)
    columns = [label] if isinstance(label, str) else label
    known = labels.where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != 0))
    for c in columns:
        known = known.where(F.col(c).isNotNull())
    known = known.groupBy("doc_id").agg(F.array(*[F.avg(c) for c in columns]).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(known), "doc_id").select("doc_id", "text", "y")  # sample_rows ids and their labels
    found = found.mapInArrow(arrow_rows(_feature_rows, FEATURE_SCHEMA), "doc_id long, y array<double>, ids binary, x binary").toArrow()
    rows = sorted(zip(*(found.column(c).to_pylist() for c in ("doc_id", "ids", "x", "y"))))
    pairs = [(np.frombuffer(i, np.int32), np.frombuffer(x, np.float32)) for _, i, x, _ in rows]
    y = np.array([r[3] for r in rows], float).reshape(len(rows), len(columns))
    return train(pairs, y[:, 0] if isinstance(label, str) else y)


def scorer(model: dict):
    """A mapInArrow function: (id, text) batches to (id, score) batches."""

    def run(batches):
        for whole in batches:
            for part in sub_batches(whole, 1_500_000):
                rows = [features(t) for t in part.column(1).to_pylist()]
                starts = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])[:-1]])
                z, _ = logits(model, np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), starts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sigmoid(z.astype(float)))], names=[part.schema.field(0).name, "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`."""
    model = fit(docs, labels)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(tidy(scorer(model)), "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs`, all columns, whose score reaches the threshold."""
    model = fit(docs, labels)
    names = docs.columns
    at = names.index("text")
    score = scorer(model)

    def run(batches):
        for whole in batches:
            for part in sub_batches(whole):
                ids = pa.array(range(part.num_rows))
                kept = [s for b in score([pa.RecordBatch.from_arrays([ids, part.column(at)], names=["i", "text"])]) for s in b.column(1).to_pylist()]
                yield part.filter(pa.array([s >= threshold for s in kept]))

    return docs.mapInArrow(tidy(run), docs.schema)
