"""Quality rules combined by weak supervision.

Every rule votes good (1) or bad (0) on a document, or abstains. Expectation-maximisation over the vote
patterns of all documents estimates each rule's accuracy on either class and the share of good documents; the
posterior probability of "good" replaces the demand that all rules pass.

One pass over the texts computes statistics and votes and writes them, without the texts, to the shared folder.
The patterns are then counted; there are at most 3**rules of them, so the driver holds a table whose size does
not depend on the corpus.

Defined cases: null and empty texts have no words and fail the base rule; repeated rows count as often as they
occur; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulark.llm.common import Scratch, arrow_rows
from tabulark.llm.textstats import TextStats, text_stats

ABSTAIN = 2
#: Names of the rules, in the order of their digits in a pattern.
RULES = ["symbols", "letters", "case", "word_length", "repeats", "dup_lines", "variety", "sentences", "length", "markup"]

SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
     ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("pattern", pa.int64())]
)
DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, pattern long"


def three_way(value: float, bad: float, good: float) -> int:
    """Bad beyond `bad`, good on the near side of `good`, no vote between; either may be the larger bound."""
    if (value >= bad) if bad > good else (value <= bad):
        return 0
    return 1 if ((value <= good) if bad > good else (value >= good)) else ABSTAIN


def votes(s: TextStats) -> list[int]:
    """One vote for each of RULES, from statistics of the whole text."""
    n = s.n_words
    if not n:
        return [0] + [ABSTAIN] * (len(RULES) - 1)
    length = s.word_chars / n
    return [
        three_way(s.n_symbols / n, 0.25, 0.05),
        three_way(s.letters / max(1, s.word_chars), 0.6, 0.8),
        three_way(s.upper / max(1, s.letters), 0.4, 0.2),
        0 if not 2.5 <= length <= 15 else 1 if 3.5 <= length <= 11 else ABSTAIN,
        three_way(s.n_repeat_words / n, 0.3, 0.1),
        three_way(s.n_dup_lines / s.n_lines, 0.3, 0.05),
        three_way(len(s.distinct) / n, 0.15, 0.35) if n >= 50 else ABSTAIN,
        three_way(s.ended_lines / s.n_lines, 0.2, 0.6),
        three_way(n, 10, 50),
        three_way(s.markup / n, 0.2, 0.02),
    ]


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 50 or 100 * n_repeat > 50 * n_words


def encode(vote: list[int]) -> int:
    code = 0
    for v in vote:
        code = code * 3 + v
    return code


def decode(codes: np.ndarray, n: int) -> np.ndarray:
    return np.stack([(codes // 3 ** (n - 1 - i)) % 3 for i in range(n)], axis=1)


def rows(columns: list[list]):
    for doc_id, text in zip(*columns):
        s = text_stats(text)
        stats = (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words)
        yield (doc_id, *stats, base_failed(s.n_words, s.n_repeat_words), encode(votes(s)))


def fit(codes: np.ndarray, counts: np.ndarray, n: int = len(RULES), rounds: int = 500, tol: float = 1e-10) -> dict:
    """EM over vote patterns. Unknowns: the share of good documents and, for each rule and class, the chances
    of a bad vote, a good vote and an abstention; a rule's accuracy is its chance of the right vote given that
    it votes. The first posteriors come from a vote count in which one bad vote outweighs several good ones
    (most rules can only see one kind of defect), which also names the classes. Dirichlet pseudo-counts keep
    chances off 0 and vanish against a corpus."""
    v = decode(codes.astype(np.int64), n)
    w = counts.astype(np.float64)
    seen = np.stack([(v == k).astype(float) for k in range(3)])  # bad, good, abstain
    weight = 1.5 * seen[1].sum(1) / n - 2.0 * seen[0].sum(1) + 1.0
    post, last = 1 / (1 + np.exp(-weight)), -np.inf
    prior = {"good": np.array([0.1, 1.0, 0.5]), "bad": np.array([0.6, 0.5, 0.5])}
    for _ in range(rounds):
        share = float(np.clip((w @ post + 8) / (w.sum() + 10), 0.001, 0.999))
        chance = {}
        for name, q in (("good", w * post), ("bad", w * (1 - post))):
            c = np.stack([q @ seen[k] + prior[name][k] for k in range(3)])
            chance[name] = c / c.sum(0)
        lg = np.log(share) + sum(seen[k] @ np.log(chance["good"][k]) for k in range(3))
        lb = np.log1p(-share) + sum(seen[k] @ np.log(chance["bad"][k]) for k in range(3))
        top = np.maximum(lg, lb)
        total = top + np.log(np.exp(lg - top) + np.exp(lb - top))
        post = np.exp(lg - total)
        now = float(w @ total)
        if abs(now - last) <= tol * max(1.0, abs(now)):
            break
        last = now
    accuracy = {name: c[k] / (c[0] + c[1]) for (name, c), k in zip(chance.items(), (1, 0))}
    return {"share": share, "right_good": accuracy["good"], "right_bad": accuracy["bad"], "posterior": post}


def weak_supervision(docs: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept, posterior (probability that the document is good)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    stats = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stats = scratch.write(stats.mapInArrow(arrow_rows(rows, SCHEMA), DDL), "votes")
    patterns = stats.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").toPandas()
    model = fit(patterns["pattern"].to_numpy(), patterns["n"].to_numpy())
    posterior = spark.createDataFrame(
        [(int(p), float(q)) for p, q in zip(patterns["pattern"], model["posterior"])], "pattern long, posterior double"
    )
    # At most 3**10 patterns of 16 bytes: a bound of 1 MB that no corpus can exceed.
    out = stats.join(F.broadcast(posterior), "pattern", "left")
    kept = ~F.col("base_failed") & (F.col("posterior") >= threshold)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "posterior")
