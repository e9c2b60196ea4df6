"""Language-model scoring by deleted interpolation.

P(w | h) = l2 * c(h w) / c(h) + l1 * c(w) / N + l0 / (V + 1); the weights (l2, l1, l0) depend on the frequency
bucket of the context, bit_length(c(h)). They are learned by expectation-maximisation on held-out counts: every
training token in turn is deleted from the counts that predict it. A text is its lower-cased words and one end
token; the context of the first word is the end token.

Counting and scoring cover every token of every text. The vocabulary (hash and count of each word) is sent to the
executors while it has at most `vocabulary_limit` words; bigrams of two of the TOP commonest words are counted in
one dense matrix of fixed size, so that no frequent bigram crosses the network, and all others meet in hash
buckets, packed as sorted byte planes. Any bigram that is left has a word outside the TOP, so its share of the
corpus is bounded. Larger vocabularies take the same model by joins (`_score_by_joins`).

Defined cases: null text counts as empty, which is the end token alone; repeated rows are scored alike, each with
a row of its own; with no training documents every probability is uniform; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulark.llm.common import Scratch, _batch, fold, string_hashes, sub_batches, text_words, tidy, word_hashes

#: The end token's hash; a word's hash is an xxh3 value and equals it with chance 2**-64.
END = np.int64(0x7E3D5A1B9C2F4E61)
TOP = 1024
BUCKETS = 64  # of context counts, by bit length
BATCH_BYTES = 6_000_000  # text of a worker at a time
VOCABULARY_LIMIT = 12_000_000  # words of 12 bytes each in every Python worker
PACKED = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
PACKED_DDL = "bucket long, batch long, kind int, a binary, b binary"
RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
RESULT_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
META, TRAIN, HELD, PART = range(4)


def bit_length(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, np.floor(np.log2(np.maximum(c, 1))).astype(np.int64) + 1, 0)


# --- counting ------------------------------------------------------------------------------------------------


def with_fold(docs: DataFrame, folds: int, held: int) -> DataFrame:
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.withColumn("held_out", fold(F.col("doc_id"), folds) == held)


def unigrams(docs: DataFrame) -> DataFrame:
    """word (hash), c: token counts of `docs`, pre-aggregated in each task."""

    def run(batches):
        def merged():
            keys, place = np.unique(np.concatenate([k for k, _ in seen]), return_inverse=True)
            return keys, np.bincount(place, np.concatenate([n for _, n in seen]), len(keys)).astype(np.int64)

        def flush(keys, values):
            for at in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000]), pa.array(values[at : at + 100_000])], names=["word", "c"])

        seen = []
        for whole in batches:
            for part in sub_batches(whole):
                codes, words, at = text_words(part.column(0))
                counts = np.bincount(codes, minlength=len(words))
                used = counts > 0  # the dictionary may hold the empty word
                seen.append((np.append(string_hashes(words).view(np.int64)[used], END), np.append(counts[used], len(at) - 1)))
                if sum(len(k) for k, _ in seen) > 1_000_000:
                    seen = [merged()]
                    if len(seen[0][0]) > 500_000:
                        yield from flush(*seen.pop())
        if seen:
            yield from flush(*merged())

    return docs.select("text").mapInArrow(tidy(run), "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Word hashes and counts, ranked by count; `place` finds ranks, -1 for unknown words."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        self.total, self.size = int(counts.sum()), len(words)
        order = np.argsort(words)
        self.sorted = words[order]
        counts = counts[order]
        del order
        if self.size and counts.max() < 2**31:
            counts = counts.astype(np.int32)
        by_count = np.argsort(-counts, kind="stable")
        self.counts = counts[by_count]
        self.rank = np.empty(self.size, np.int32)
        self.rank[by_count] = np.arange(self.size, dtype=np.int32)

    def place(self, hashes: np.ndarray) -> np.ndarray:
        if not self.size:
            return np.full(len(hashes), -1, np.int64)
        uniq, inverse = np.unique(hashes, return_inverse=True)
        at = np.minimum(np.searchsorted(self.sorted, uniq), self.size - 1)
        found = np.where(self.sorted[at] == uniq, self.rank[at], -1).astype(np.int64)
        return found[inverse]


# --- the model -----------------------------------------------------------------------------------------------


def cells(c_hw: np.ndarray, c_h: np.ndarray, c_w: np.ndarray, total: int, size: int) -> pd.DataFrame:
    """Held-out statistics of bigram types: with one occurrence deleted, the context bucket and quarter-octave
    classes of the bigram and unigram estimates, weighted by the type's count. Their number has a bound that
    does not depend on the corpus."""
    p0 = 1 / (size + 1)
    p2 = (c_hw - 1) / np.maximum(c_h - 1, 1)
    p1 = (c_w - 1) / max(total - 1, 1)
    q2 = np.where(p2 > 0, np.round(4 * np.log2(np.maximum(p2, 1e-300))), -999).astype(np.int64)
    q1 = np.where(p1 > 0, np.round(4 * np.log2(np.maximum(p1, 1e-300) / p0)), -999).astype(np.int64)
    frame = pd.DataFrame({"b": bit_length(c_h - 1), "q1": q1, "q2": q2, "w": c_hw.astype(float)})
    return frame.groupby(["b", "q1", "q2"], as_index=False)["w"].sum()


def learn_weights(stats: pd.DataFrame, size: int, rounds: int = 200) -> np.ndarray:
    """(BUCKETS, 3) weights of bigram, unigram and uniform estimates by EM; 1 pseudo-count each for buckets
    with little evidence. A context that was never seen has no bigram estimate."""
    p0 = 1 / (size + 1)
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = (0, 0.5, 0.5)
    if len(stats):
        b = stats["b"].to_numpy()
        p2 = np.where(stats["q2"] == -999, 0.0, 2.0 ** (stats["q2"] / 4))
        p1 = np.where(stats["q1"] == -999, 0.0, p0 * 2.0 ** (stats["q1"] / 4))
        p = np.stack([np.where(b == 0, 0.0, p2), p1, np.full(len(b), p0)], 1)
        w = stats["w"].to_numpy()
        for _ in range(rounds):
            r = weights[b] * p
            r *= (w / np.maximum(r.sum(1), 1e-300))[:, None]
            new = np.stack([np.bincount(b, r[:, k], BUCKETS) for k in range(3)], 1) + 1.0
            new[0, 0] = 0
            new /= new.sum(1, keepdims=True)
            if np.abs(new - weights).max() < 1e-7:
                break
            weights = new
    seen = np.zeros(BUCKETS, bool)
    seen[stats["b"].to_numpy() if len(stats) else []] = True
    for k in range(2, BUCKETS):  # a bucket above all evidence takes the weights below it
        if not seen[k]:
            weights[k] = weights[k - 1]
    return weights


def log10_probability(weights, c_hw, c_h, c_w, total: int, size: int) -> np.ndarray:
    l2, l1, l0 = weights[np.minimum(bit_length(c_h), BUCKETS - 1)].T
    p = l2 * c_hw / np.maximum(c_h, 1) + l1 * c_w / max(total, 1) + l0 / (size + 1)
    return np.log10(p)


# --- packed bigrams ------------------------------------------------------------------------------------------


def planes(a: np.ndarray) -> bytes:
    """Bytes by significance, which compress well for sorted numbers."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def from_planes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def _bigrams(texts: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, ...]:
    """Ranks of contexts and words and the text's number, for every token of a batch."""
    codes, words, at = text_words(texts)
    sizes = np.diff(at) + 1
    end = vocabulary.place(np.array([END]))[0]
    w = np.insert(vocabulary.place(string_hashes(words).view(np.int64))[codes], at[1:], end)
    h = np.empty_like(w)
    h[1:], h[0] = w[:-1], end  # the token before a text's first is an end token too
    return h, w, np.repeat(np.arange(len(texts)), sizes), sizes


def _bucket_of(key: np.ndarray, buckets: int, counts: np.ndarray, total: int) -> np.ndarray:
    """Bigrams meet by context, so that a bucket's sorted contexts pack as well however many buckets there are; a
    context too frequent for one bucket is spread over several by its next word."""
    h, w = key >> 32, key & 0xFFFFFFFF
    spread = np.maximum(1, counts[h].astype(np.int64) * 4 * buckets // max(total, 1))
    with np.errstate(over="ignore"):
        sub = (w.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % spread.astype(np.uint64)
        x = (h.astype(np.uint64) + (sub << np.uint64(40))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(29)) % np.uint64(buckets)).astype(np.int64)


def _parted(key: np.ndarray, buckets: int, v: Vocabulary):
    """(bucket, indices in order of key) for each bucket that has any."""
    b = _bucket_of(key, buckets, v.counts, v.total)
    order = np.lexsort((key, b))
    cuts = np.flatnonzero(np.diff(b[order])) + 1
    for at in np.split(order, cuts) if len(order) else []:
        yield int(b[at[0]]), at


def _pack(key: np.ndarray) -> bytes:
    h, w = (key >> 32).astype(np.uint32), (key & 0xFFFFFFFF).astype(np.uint32)
    return planes(h) + planes(w)


def _unpack(data: bytes) -> np.ndarray:
    half = len(data) // 2
    return (from_planes(data[:half], np.uint32).astype(np.int64) << 32) | from_planes(data[half:], np.uint32).astype(np.int64)


def interpolated_scores(docs: DataFrame, folds: int = 7, held: int = 2, vocabulary_limit: int = VOCABULARY_LIMIT, tokens_per_bucket: int = 1_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of `docs`."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = with_fold(docs, folds, held)
    train = docs.where(~F.col("held_out"))
    counts = scratch.write(unigrams(train), "unigrams")
    n_words = counts.count()
    if n_words > vocabulary_limit:
        return _score_by_joins(scratch, docs, counts)
    found = counts.toArrow()
    vocabulary = Vocabulary(found.column("word").to_numpy(), found.column("c").to_numpy())
    del found
    pa.default_memory_pool().release_unused()
    shared = spark.sparkContext.broadcast(vocabulary)
    total, size, top = vocabulary.total, vocabulary.size, min(TOP, vocabulary.size)
    del vocabulary
    buckets = max(8, math.ceil(total / tokens_per_bucket))

    # First pass over the texts: dense counts, and held-out statistics of all other bigram types.
    def count(batches):
        v, dense = shared.value, np.zeros(top * top, np.int64)
        for whole in batches:
            for part in sub_batches(whole, BATCH_BYTES):
                h, w, _, _ = _bigrams(part.column(0), v)
                both = (h < top) & (w < top)
                dense += np.bincount(h[both] * top + w[both], minlength=top * top)
                key = (h[~both] << 32) | w[~both]
                rows = [(b, _pack(key[at])) for b, at in _parted(key, buckets, v)]
                if rows:
                    yield _batch(rows, pa.schema([("bucket", pa.int32()), ("pairs", pa.binary())]))
        at = np.flatnonzero(dense)
        if len(at):  # negative buckets carry slices of the dense counts
            for s in np.unique(at // 4096):
                mine = at[at // 4096 == s]
                yield _batch([(-1 - int(s), mine.astype(np.int64).tobytes() + dense[mine].tobytes())], pa.schema([("bucket", pa.int32()), ("pairs", pa.binary())]))

    def gather(batches):
        v, packed, cell, number = shared.value, [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for bucket, data in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket >= 0:
                    packed.append(_unpack(data))
                else:
                    x = np.frombuffer(data, np.int64).reshape(2, -1)
                    cell, inverse = np.unique(np.concatenate([cell, x[0]]), return_inverse=True)
                    number = np.bincount(inverse, np.concatenate([number, x[1]]), len(cell)).astype(np.int64)
        if packed:
            key, c_hw = np.unique(np.concatenate(packed), return_counts=True)
            yield _stats(cells(c_hw, v.counts[key >> 32], v.counts[key & 0xFFFFFFFF], total, size))
        if len(cell):
            yield _stats(cells(number, v.counts[cell // top], v.counts[cell % top], total, size))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), -1)), pa.array(cell), pa.array(np.zeros(len(cell), np.int64)), pa.array(number.astype(float))], names=["b", "q1", "q2", "w"])

    met = train.select("text").mapInArrow(tidy(count), "bucket int, pairs binary").repartition(buckets, "bucket")
    stats = scratch.write(met.mapInArrow(tidy(gather), "b long, q1 long, q2 long, w double").groupBy("b", "q1", "q2").agg(F.sum("w").alias("w")), "stats")
    found = stats.toPandas()  # bounded: the classes of `cells`, and TOP * TOP dense counts
    dense = np.zeros(max(1, top * top))
    at = found["b"] == -1
    dense[found.loc[at, "q1"].to_numpy()] = found.loc[at, "w"].to_numpy()
    held_out_stats = found[~at].sort_values(["b", "q1", "q2"])
    weights = learn_weights(held_out_stats, size)
    model = spark.sparkContext.broadcast((weights, dense.astype(np.float32 if total < 2**24 else np.float64)))

    # Second pass: texts give their statistics and the scores of what is known on the spot; other bigrams meet
    # their counts in a bucket, and sums per text go back to the batch they came from, packed both ways.
    def emit(batches):
        v = shared.value
        lam, table = model.value
        counted = np.append(v.counts, np.zeros(1, v.counts.dtype))  # place -1 is an unknown word
        for whole in batches:
            for part in sub_batches(whole, BATCH_BYTES):
                doc_ids, texts, held_out = (c.to_pylist() for c in part.columns)
                h, w, doc, sizes = _bigrams(part.column(1), v)
                c_h, c_w = counted[h], counted[w]
                base = np.bincount(doc, np.log10((c_w + 1.0) / (total + size + 1)), len(texts))
                n_known = np.bincount(doc, c_w > 0, len(texts)).astype(np.int64)
                both = (h >= 0) & (w >= 0) & (h < top) & (w < top)
                here = both | (c_h == 0) | (c_w == 0)
                c_hw = np.zeros(len(h))
                c_hw[both] = table[h[both] * top + w[both]]
                local = np.bincount(doc[here], log10_probability(lam, c_hw[here], c_h[here], c_w[here], total, size), len(texts))
                missing = np.array([d is None for d in doc_ids])
                ids = np.array([0 if d is None else d for d in doc_ids], np.int64)
                out = np.array(held_out, bool)
                meta = b"".join(x.tobytes() for x in (ids, missing, out, sizes.astype(np.int64), n_known, base, local))
                # The batch is named by its content: a task that runs again gives the same names.
                name = xxhash.xxh3_64(meta)
                for t in texts:
                    name.update((t or "").encode())
                batch = int(np.uint64(name.intdigest()).view(np.int64))
                yield _batch([(batch % buckets, batch, META, meta, None)], PACKED)
                for kind, pick in ((TRAIN, ~here & ~out[doc]), (HELD, ~here & out[doc])):
                    key, who = (h[pick] << 32) | w[pick], doc[pick].astype(np.uint32)
                    rows = [(b, batch, kind, _pack(key[at]), planes(who[at])) for b, at in _parted(key, buckets, v)]
                    if rows:
                        yield _batch(rows, PACKED)

    def score(batches):
        v, (lam, _) = shared.value, model.value
        keys, who, trains, names = [], [], [], []
        for b in batches:
            for bucket, batch, kind, first, second in zip(*(c.to_pylist() for c in b.columns)):
                if kind == META:
                    yield _batch([(0, batch, META, first, None)], PACKED)
                else:
                    keys.append(_unpack(first))
                    who.append(from_planes(second, np.uint32))
                    trains.append(kind == TRAIN)
                    names.append(batch)
        if not keys:
            return
        sizes = [len(k) for k in keys]
        types, place = np.unique(np.concatenate(keys), return_inverse=True)
        c_hw = np.bincount(place, np.repeat(trains, sizes), len(types))
        lp = log10_probability(lam, c_hw, v.counts[types >> 32], v.counts[types & 0xFFFFFFFF], total, size)[place]
        at = 0
        for n, docs_, batch in zip(sizes, who, names):
            sums = np.bincount(docs_, lp[at : at + n])
            some = np.unique(docs_)
            yield _batch([(0, batch, PART, planes(some.astype(np.uint32)), sums[some].tobytes())], PACKED)
            at += n

    def settle(batches):
        metas: dict[int, list[bytes]] = {}
        parts: dict[int, list[tuple[bytes, bytes]]] = {}
        for b in batches:
            for _, batch, kind, first, second in zip(*(c.to_pylist() for c in b.columns)):
                if kind == META:
                    metas.setdefault(batch, []).append(first)
                else:
                    parts.setdefault(batch, []).append((first, second))
        for batch, found in metas.items():
            n = len(found[0]) // 42
            cut = np.cumsum([0, 8 * n, n, n, 8 * n, 8 * n, 8 * n, 8 * n])
            ids, missing, out, sizes, n_known, base, local = (np.frombuffer(found[0][i:j], t) for i, j, t in zip(cut, cut[1:], (np.int64, bool, bool, np.int64, np.int64, float, float)))
            sums = np.zeros(n)
            for first, second in parts.get(batch, ()):
                sums[from_planes(first, np.uint32)] += np.frombuffer(second, float)
            full = local + sums / len(found)  # batches of equal content share a name, and each sent all its parts
            for _ in found:
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=missing), pa.array(out), pa.array(sizes), pa.array(n_known), pa.array(base), pa.array(full)], schema=RESULT)

    met = docs.mapInArrow(tidy(emit), PACKED_DDL).repartition(buckets, "bucket").mapInArrow(tidy(score), PACKED_DDL)
    rows = met.repartition(max(8, buckets // 2), "batch").mapInArrow(tidy(settle), RESULT_DDL)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _stats(frame: pd.DataFrame) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(frame[c].to_numpy()) for c in ("b", "q1", "q2", "w")], names=["b", "q1", "q2", "w"])


# --- any vocabulary: joins -----------------------------------------------------------------------------------


def _score_by_joins(scratch: Scratch, docs: DataFrame, counts: DataFrame) -> DataFrame:
    """The same model with the vocabulary left in a table: texts are exploded to (uid, context, word, times), and
    counts arrive by shuffle joins, whose skewed keys Spark splits."""
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("h", pa.int64()), ("w", pa.int64()), ("k", pa.int64())])

    def spread(batches):
        for whole in batches:
            for part in sub_batches(whole, 4_000_000):
                hashes, starts = word_hashes(part.column(1))
                for i, (d, t, o) in enumerate(zip(*(c.to_pylist() for c in part.columns))):
                    uid = int(np.uint64(xxhash.xxh3_64_intdigest(f"{d}|{t or ''}".encode())).view(np.int64))
                    tokens = [*hashes[starts[i] : starts[i + 1]].view(np.int64).tolist(), int(END)]
                    pairs = Counter(zip([int(END), *tokens], tokens))
                    rows = [(uid, d, o, h, w, k) for (h, w), k in pairs.items()]
                    for at in range(0, len(rows), 50_000):
                        yield _batch(rows[at : at + 50_000], schema)

    tokens = docs.mapInArrow(spread, "uid long, doc_id long, held_out boolean, h long, w long, k long")
    whole = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, size = int(whole.n or 0), int(whole.v)
    types = tokens.groupBy("h", "w").agg(F.sum(F.when(~F.col("held_out"), F.col("k")).otherwise(0)).alias("c_hw"))
    types = types.join(counts.select(F.col("word").alias("w"), F.col("c").alias("c_w")), "w", "left")
    types = scratch.write(types.join(counts.select(F.col("word").alias("h"), F.col("c").alias("c_h")), "h", "left").na.fill(0, ["c_w", "c_h"]), "types")

    def held_out(batches):
        for b in batches:
            c_hw, c_h, c_w = (b.column(k).to_numpy() for k in range(3))
            yield _stats(cells(c_hw, c_h, c_w, total, size))

    seen = types.where("c_hw > 0").select("c_hw", "c_h", "c_w").mapInArrow(held_out, "b long, q1 long, q2 long, w double")
    weights = learn_weights(seen.groupBy("b", "q1", "q2").agg(F.sum("w").alias("w")).toPandas().sort_values(["b", "q1", "q2"]), size)

    def price(batches):
        for b in batches:
            h, w = b.column(0), b.column(1)
            c_hw, c_h, c_w = (b.column(k).to_numpy() for k in range(2, 5))
            lp = log10_probability(weights, c_hw, c_h, c_w, total, size)
            yield pa.RecordBatch.from_arrays([h, w, pa.array(lp), pa.array(c_w > 0), pa.array(np.log10((c_w + 1) / (total + size + 1)))], names=["h", "w", "lp", "known", "base"])

    priced = types.select("h", "w", "c_hw", "c_h", "c_w").mapInArrow(price, "h long, w long, lp double, known boolean, base double")
    scored = tokens.join(priced, ["h", "w"]).groupBy("uid").agg(
        F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), F.sum("k").alias("n"), F.sum(F.col("k") * F.col("known").cast("long")).alias("known"),
        F.sum(F.col("k") * F.col("base")).alias("base"), F.sum(F.col("k") * F.col("lp")).alias("lp"), F.sum(F.when(F.col("w") == F.lit(int(END)), F.col("k")).otherwise(0)).alias("copies"),
    )
    scored = scored.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return scored.select(
        "doc_id", "held_out", (F.col("n") / F.col("copies")).cast("long").alias("n_tokens"), (F.col("known") / F.col("copies")).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies")).alias("base_score"), (F.col("lp") / F.col("copies")).alias("score"),
    )
