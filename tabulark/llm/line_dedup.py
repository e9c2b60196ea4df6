"""Line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is its 128-bit hash after stripping and lower-casing. `LineIndex` holds, as tables,
  postings  (doc_id, h1, h2)               which document holds which key, once each
  refs      (h1, h2, docs, last)           the exact number of documents of a key, and the largest doc_id
  filters   (shard, buckets)               a cuckoo filter per shard over the keys that are repeated enough
Documents can be added and removed at any time; only keys of the documents that change are counted anew, and
only the filters of shards with a changed key are touched. Removing what was added restores the earlier state.

A document's lines are tested against the filters, in numpy, without a shuffle; the few that pass are joined with
the exact table, so a filter's false positives never reach a result. The filters are broadcast while their total
size is under `broadcast_bytes`; beyond that the same test runs as a join of line keys with filters by shard.

Defined cases: null and empty texts are one empty line; a null doc_id counts as one document below all others;
rows with one doc_id count as one document, and each of them loses the same lines; an empty table gives an empty
result; all other columns are kept as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulark.llm.common import LOWER, SPACE_CHARS, UPPER, Scratch

SLOTS, KICKS = 4, 500
NO_ID = -(2**63)  # stands for a null doc_id; below every other id


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE_CHARS)), UPPER, LOWER)


def postings_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, h1, h2 of the distinct long enough keys of each row of `docs`."""
    keys = F.filter(F.transform(lines_of(F.col("text")), line_key), lambda k: F.char_length(k) >= min_chars)
    key = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.explode(F.array_distinct(keys)).alias("key"))
    return key.select("doc_id", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


def count_refs(postings: DataFrame) -> DataFrame:
    """Exact document counts. Pairs are made distinct before the keys meet, so a key that a third of the corpus
    holds arrives as one partial count per task."""
    distinct = postings.select("h1", "h2", "doc_id").distinct()
    return distinct.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last"))


# --- cuckoo filter -------------------------------------------------------------------------------------------


def _parts(h1: np.ndarray, h2: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints 1..65535 and both buckets. `buckets` is a power of two."""
    u = h2.astype(np.uint64)
    mark = (u % np.uint64(65535)).astype(np.int64) + 1
    first = ((u >> np.uint64(20)) & np.uint64(buckets - 1)).astype(np.int64)
    return mark, first, first ^ _jump(mark, buckets)


def _jump(mark, buckets: int):
    return (mark * 0x5BD1E995) & (buckets - 1)


class CuckooFilter:
    """Partial-key cuckoo filter: four 16-bit marks a bucket, two buckets a key; supports deletion."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(1, math.ceil(math.log2(max(1, keys) / (SLOTS * 0.8))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> CuckooFilter:
        """A filter with all keys; it grows until every key has a place."""
        out = cls.sized(len(h2))
        while not all(out.insert(a, b) for a, b in zip(h1.tolist(), h2.tolist())):
            out = cls(np.zeros((2 * len(out.table), SLOTS), np.uint16))
        return out

    def _one(self, h1: int, h2: int) -> tuple[int, int, int]:
        n, u = len(self.table), h2 & (2**64 - 1)
        mark = u % 65535 + 1
        first = (u >> 20) & (n - 1)
        return mark, first, first ^ _jump(mark, n)

    def insert(self, h1: int, h2: int) -> bool:
        mark, a, b = self._one(h1, h2)
        for at in (a, b):
            row = self.table[at]
            for s in range(SLOTS):
                if row[s] == 0:
                    row[s] = mark
                    return True
        at = a
        for k in range(KICKS):
            s = k % SLOTS
            mark, self.table[at, s] = int(self.table[at, s]), mark
            at ^= _jump(mark, len(self.table))
            row = self.table[at]
            for s in range(SLOTS):
                if row[s] == 0:
                    row[s] = mark
                    return True
        return False

    def delete(self, h1: int, h2: int) -> bool:
        """Remove one mark of a key that was inserted before."""
        mark, a, b = self._one(h1, h2)
        for at in (a, b):
            for s in range(SLOTS):
                if self.table[at, s] == mark:
                    self.table[at, s] = 0
                    return True
        return False

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        mark, a, b = _parts(h1, h2, len(self.table))
        return ((self.table[a] == mark[:, None]) | (self.table[b] == mark[:, None])).any(1)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())


def shard_of(shards: int) -> Column:
    return F.pmod(F.col("h1"), F.lit(shards)).cast("int")


def build_filters(keys: DataFrame, shards: int) -> DataFrame:
    """shard, buckets: one filter per shard; a shard holds total/shards keys, a fixed size by choice of `shards`."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        built = CuckooFilter.build(pdf["h1"].to_numpy(), pdf["h2"].to_numpy())
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "buckets": [built.to_bytes()]})

    return keys.select("h1", "h2", shard_of(shards).alias("shard")).groupBy("shard").applyInPandas(one, "shard int, buckets binary")


def update_filters(filters: DataFrame, added: DataFrame, removed: DataFrame, shards: int) -> DataFrame:
    """Filters after `removed` keys were deleted and `added` keys inserted, shard by shard. A filter that is too
    full for the new keys comes back empty-handed (buckets null) and is rebuilt by the caller."""
    change = added.withColumn("way", F.lit(1)).unionByName(removed.withColumn("way", F.lit(-1)))
    change = change.select("h1", "h2", "way", shard_of(shards).alias("shard"))

    def one(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        shard = int((old if len(old) else new)["shard"].iloc[0])
        f = CuckooFilter.from_bytes(old["buckets"].iloc[0]) if len(old) else CuckooFilter.sized(len(new))
        fits = True
        for h1, h2, way in sorted(zip(new["h1"], new["h2"], new["way"]), key=lambda r: r[2]):
            if way < 0:
                f.delete(h1, h2)
            else:
                fits = fits and f.insert(h1, h2)
        return pd.DataFrame({"shard": [shard], "buckets": [f.to_bytes() if fits else None]})

    return filters.groupBy("shard").cogroup(change.groupBy("shard")).applyInPandas(one, "shard int, buckets binary")


def _probe(tables: dict[int, CuckooFilter], shards: int, pdf: pd.DataFrame) -> np.ndarray:
    h1, h2 = pdf["h1"].to_numpy(), pdf["h2"].to_numpy()
    hit = np.zeros(len(pdf), bool)
    shard = np.mod(h1, shards)
    for s in np.unique(shard):
        if s in tables:
            at = np.flatnonzero(shard == s)
            hit[at] = tables[s].contains(h1[at], h2[at])
    return hit


def filter_hits(postings: DataFrame, filters: DataFrame, shards: int, broadcast_bytes: int) -> DataFrame:
    """The postings whose key the filters may hold."""
    size = filters.agg(F.coalesce(F.sum(F.octet_length("buckets")), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        shared = postings.sparkSession.sparkContext.broadcast({r.shard: bytes(r.buckets) for r in filters.collect()})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tables = {k: CuckooFilter.from_bytes(v) for k, v in shared.value.items()}
            for pdf in batches:
                yield pdf[_probe(tables, shards, pdf)]

        return postings.mapInPandas(run, postings.schema)

    # Too large to send everywhere: postings meet their shard's filter; salting spreads a shard over tasks, and
    # the filter arrives once per salt ahead of nothing larger than its own share of lines.
    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(right) or not len(left):
            return left.iloc[:0][["doc_id", "h1", "h2"]]
        table = CuckooFilter.from_bytes(right["buckets"].iloc[0])
        return left.loc[table.contains(left["h1"].to_numpy(), left["h2"].to_numpy()), ["doc_id", "h1", "h2"]]

    salts = 16
    left = postings.select("doc_id", "h1", "h2", shard_of(shards).alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    right = filters.select("shard", "buckets", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return left.groupBy("shard", "salt").cogroup(right.groupBy("shard", "salt")).applyInPandas(meet, "doc_id long, h1 long, h2 long")


# --- the index -----------------------------------------------------------------------------------------------


@dataclass
class LineIndex:
    """Reversible state of line dedup. `add` and `remove` return a new index; the old one stays valid."""

    scratch: Scratch
    postings: DataFrame
    refs: DataFrame
    filters: DataFrame
    min_chars: int = 40
    min_docs: int = 5
    shards: int = 1
    keys_per_shard: int = 50_000

    @classmethod
    def of(cls, docs: DataFrame, min_chars: int = 40, min_docs: int = 5, keep_postings: bool = True, keys_per_shard: int = 50_000) -> LineIndex:
        """Index `docs`. Without postings the index can answer but not change; without them only keys that
        are repeated enough stay in `refs`."""
        scratch = Scratch(docs.sparkSession)
        postings = postings_of(docs, min_chars)
        if keep_postings:
            postings = scratch.write(postings.distinct(), "postings")
        refs = count_refs(postings)
        refs = scratch.write(refs if keep_postings else refs.where(F.col("docs") >= min_docs), "refs")
        out = cls(scratch, postings, refs, None, min_chars, min_docs, keys_per_shard=keys_per_shard)
        return out._rebuilt()

    def repeated(self) -> DataFrame:
        return self.refs.where(F.col("docs") >= self.min_docs)

    def _rebuilt(self) -> LineIndex:
        self.shards = max(1, math.ceil(self.repeated().count() / self.keys_per_shard))
        self.filters = self.scratch.write(build_filters(self.repeated(), self.shards), "filters")
        return self

    def _changed(self, postings: DataFrame, touched: DataFrame) -> LineIndex:
        """The index with new `postings`, of which only `touched` keys have other counts than before."""
        touched = touched.select("h1", "h2").distinct()
        fresh = self.scratch.write(count_refs(postings.join(touched, ["h1", "h2"], "left_semi")), "fresh")
        refs = self.scratch.write(self.refs.join(touched, ["h1", "h2"], "left_anti").unionByName(fresh), "refs")
        out = LineIndex(self.scratch, postings, refs, self.filters, self.min_chars, self.min_docs, self.shards, self.keys_per_shard)
        before = self.repeated().join(touched, ["h1", "h2"], "left_semi").select("h1", "h2")
        after = fresh.where(F.col("docs") >= self.min_docs).select("h1", "h2")
        added, removed = after.join(before, ["h1", "h2"], "left_anti"), before.join(after, ["h1", "h2"], "left_anti")
        filters = self.scratch.write(update_filters(self.filters, added, removed, self.shards), "filters")
        if filters.where("buckets is null").limit(1).count() or out.repeated().count() > 2 * self.keys_per_shard * self.shards:
            return out._rebuilt()
        out.filters = filters
        return out

    def add(self, docs: DataFrame) -> LineIndex:
        new = self.scratch.write(postings_of(docs, self.min_chars).distinct(), "added")
        postings = self.scratch.write(self.postings.unionByName(new).distinct(), "postings")
        return self._changed(postings, new)

    def remove(self, doc_ids: DataFrame) -> LineIndex:
        gone = doc_ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")).distinct()
        old = self.postings.join(gone, "doc_id", "left_semi")
        postings = self.scratch.write(self.postings.join(gone, "doc_id", "left_anti"), "postings")
        return self._changed(postings, old)

    def drops(self, docs: DataFrame, broadcast_bytes: int = 64 << 20) -> DataFrame:
        """doc_id, drop: the keys whose lines go from each document that loses any."""
        hits = filter_hits(postings_of(docs, self.min_chars), self.filters, self.shards, broadcast_bytes)
        lost = hits.join(self.repeated(), ["h1", "h2"]).where(F.col("doc_id") != F.col("last"))
        return lost.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("drop"))

    def apply(self, docs: DataFrame, broadcast_bytes: int = 64 << 20) -> DataFrame:
        """`docs` with n_lines, n_dropped and kept_text. A document's own lines and drop list are all that one
        row holds."""
        drops = self.drops(docs, broadcast_bytes).select(F.col("doc_id").alias("_id"), F.col("drop").alias("_drop"))
        out = docs.join(drops, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) == F.col("_id"), "left")
        out = out.withColumn("_kept", kept_lines(F.when(F.col("_drop").isNotNull(), F.col("text")), line_hashes(F.col("text"), F.col("_drop")), F.col("_drop")))
        lines = F.size(lines_of(F.col("text"))).cast("long")
        whole = F.coalesce(F.col("text"), F.lit(""))
        return out.withColumn("n_lines", lines).withColumn("n_dropped", F.coalesce("_kept.n_dropped", F.lit(0)).cast("long")).withColumn(
            "kept_text", F.when(F.col("_drop").isNull(), whole).otherwise(F.col("_kept.text"))
        ).drop("_id", "_drop", "_kept")


def line_hashes(text: Column, when_not_null: Column) -> Column:
    """h1 and h2 of every line's key, for the rows that lose lines."""
    keys = F.transform(lines_of(text), lambda x: F.struct(F.xxhash64(line_key(x)).alias("h1"), F.xxhash64(F.lit("line"), line_key(x)).alias("h2")))
    return F.when(when_not_null.isNotNull(), keys)


@F.pandas_udf(T.StructType([T.StructField("n_dropped", T.LongType()), T.StructField("text", T.StringType())]))
def kept_lines(text: pd.Series, hashes: pd.Series, drop: pd.Series) -> pd.DataFrame:
    out = []
    for t, hs, ds in zip(text, hashes, drop):
        if ds is None:
            out.append((0, None))
            continue
        gone = {(d["h1"], d["h2"]) for d in ds}
        lines = (t or "").split("\n")
        kept = [x for x, h in zip(lines, hs, strict=True) if (h["h1"], h["h2"]) not in gone]
        out.append((len(lines) - len(kept), "\n".join(kept)))
    return pd.DataFrame(out, columns=["n_dropped", "text"])


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for every row of `docs`."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    done = LineIndex.of(slim, min_chars, min_docs, keep_postings=False).apply(slim)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def without_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """`docs` with its columns, texts without their repeated lines, n_chars brought up to date. Rows travel as one
    struct, so no column of theirs can clash with the operator's own."""
    packed = docs.select("doc_id", "text", F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"))
    done = LineIndex.of(packed, min_chars, min_docs, keep_postings=False).apply(packed)
    text = F.when(F.col("text").isNull(), F.col("text")).otherwise(F.col("kept_text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_dropped") > 0, F.char_length(text)).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return done.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
