"""Document fingerprints: threshold-scaled sketches of word shingles [native].

A fingerprint holds every shingle hash in the lowest 1/scale of the 64-bit range and nothing else, so a long document
keeps more hashes than a short one, the union of two fingerprints is the fingerprint of the union of their sets, and
|A & B| / |A| estimates how much of A lies in B whatever the lengths. A text with no hash in that range has the empty
fingerprint: `n_hashes` is 0 and its likenesses say nothing.

Written form: 16 upper-case hexadecimal digits per hash, in order, without separators. Equal texts have equal
fingerprints; two fingerprints without hashes are alike with 1.0, one without and one with hashes with 0.0.

Defined cases: null text counts as empty; fewer than `size` words make one shingle; equal doc_ids are ordered by
the hash of their texts, null ids come last; the only document of a table is its own successor; an empty table
gives an empty result; columns other than doc_id and text are not read.

Successors are found without a global sort: documents fall into ranges of doc_id of about `rows_per_bucket` rows,
a window inside each range gives the successor, and the first document of each range is handed to the range
before it. Each text crosses the network once. An id that fills a percentile step or more by itself, and the null id, are
parted further by ranges of their texts' hashes, and equal rows of theirs are counted before they meet: all but one of
them are their own successors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulark.llm.common import SPACE_CHARS, Scratch, range_bucket

#: Range heads sent to every executor, three numbers each; beyond that Spark joins by shuffle.
BROADCAST_HEADS = 500_000
WORD_BREAK = "[\\x20\\x09-\\x0D]+"


def sketch(text: Column, size: int = 5, scale: int = 8) -> Column:
    """Sorted distinct shingle hashes below the threshold."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    words = F.split(bare, WORD_BREAK)
    # An array in an array: the words are then made once and not for every place at which they are used.
    return F.element_at(F.transform(F.array(words), lambda w: _sketch_words(w, size, scale)), 1)


def _sketch_words(w: Column, size: int, scale: int) -> Column:
    n = F.size(w)
    full = F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(size)]))
    short = F.array(F.xxhash64(F.array_join(w, " ")))
    limit = -(2**63) + 2**64 // scale
    low = F.array_sort(F.array_distinct(F.filter(F.when(n >= size, full).otherwise(short), lambda x: x < F.lit(limit))))
    empty = F.array().cast("array<bigint>")
    return F.when((n == 1) & (F.element_at(w, 1) == ""), empty).otherwise(low)


def written(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def read_back(fingerprint: Column) -> Column:
    """The hashes of a written fingerprint, as text of 16 digits each."""
    n = (F.length(fingerprint) / 16).cast("int")
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(fingerprint, i * 16 + 1, F.lit(16)))
    )


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sketches."""
    both, total = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(both / (total - both))


def containment(a: Column, b: Column) -> Column:
    """Share of `a` that `b` holds; 1.0 for an empty `a`."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: Column, b: Column) -> Column:
    """The sketch of two documents together."""
    return F.array_sort(F.array_union(a, b))


def fingerprint_documents(docs: DataFrame, size: int = 5, scale: int = 8, rows_per_bucket: int = 256) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_hashes, and the shares of
    its fingerprint that the edited text's and the next document's hold (in_edited, in_next)."""
    segments = 256
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    known = ids.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("doc_id").isNull()).alias("bare"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
        F.percentile_approx("doc_id", [i / segments for i in range(segments + 1)], 10_000).alias("steps"),
    ).first()
    steps = known.steps or []
    bounds = [*sorted({known.low, *steps, known.high}), known.high + 1] if steps else []
    often = sorted({a for a, b in zip(steps, steps[1:]) if a == b})  # ids that fill a step, 256 at most
    per_segment = max(1, math.ceil(known.total / rows_per_bucket / segments))
    parts = max(1, math.ceil(known.total / rows_per_bucket))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    heavy = F.col("doc_id").isNull() | (F.col("doc_id").isin(*often) if often else F.lit(False))
    grouped = bool(often or known.bare)
    if grouped:
        light = rows.where(~heavy).withColumn("times", F.lit(1).cast("long"))
        equal = rows.where(heavy).groupBy("doc_id", "tie").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("times"))
        rows = light.unionByName(equal)
    # Ascending like (doc_id, tie): null ids, then ranges of ids; an id that fills a step begins its range.
    range_no = F.when(F.col("doc_id").isNull(), F.lit(-2).cast("long")).otherwise(2 * range_bucket(F.col("doc_id"), bounds, per_segment) + F.when(heavy, 0).otherwise(1))
    by_text = F.when(heavy, F.least(F.floor((F.col("tie").cast("double") + 2.0**63) / 2.0**64 * parts), F.lit(parts - 1))).otherwise(0)
    rows = rows.withColumn("bucket", (range_no * parts + by_text).cast("long") if grouped else range_no)
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie").desc()]

    # The first document of each range, and the range that precedes it (the last range for the very first one).
    # doc_id and tie name it; equal rows may both be named and are then the same text.
    heads = rows.select("bucket", F.struct("doc_id", "tie").alias("id")).groupBy("bucket").agg(F.max("id").alias("id"))
    segment = F.floor(F.col("bucket") / F.lit(2 * per_segment * (parts if grouped else 1)))
    by_segment = Window.partitionBy("segment").orderBy(F.col("bucket").asc())
    heads = heads.withColumn("segment", segment).withColumn("above", F.lead("bucket").over(by_segment))
    ends = heads.groupBy("segment").agg(F.min("bucket").alias("low"), F.max("bucket").alias("high"))  # 257 rows at most
    ring = Window.partitionBy(F.lit(1)).orderBy("segment")
    ends = ends.select("high", F.coalesce(F.lead("low").over(ring), F.min("low").over(Window.partitionBy(F.lit(1)))).alias("wrap"))
    heads = heads.join(F.broadcast(ends), F.col("bucket") == F.col("high"), "left")
    heads = heads.select("id.doc_id", "id.tie", F.coalesce("above", "wrap").alias("before"))
    heads = Scratch(docs.sparkSession).write(heads, "heads")
    heads = F.broadcast(heads) if heads.count() <= BROADCAST_HEADS else heads
    donors = rows.alias("r").join(heads.alias("h"), F.expr("r.doc_id <=> h.doc_id and r.tie = h.tie"))
    donors = donors.groupBy("h.before").agg(F.first("r.text").alias("head_text"))

    own = rows.withColumn("sketch", sketch(F.col("text"), size, scale))
    inside = Window.partitionBy("bucket").orderBy(*order)
    own = own.withColumn("next", F.lead(F.struct("text", "sketch")).over(inside))
    head = F.struct(F.col("head_text").alias("text"), sketch(F.col("head_text"), size, scale).alias("sketch"))
    own = own.join(donors.select(F.col("before").alias("bucket"), head.alias("head")), "bucket", "left").withColumn("next", F.coalesce("next", "head"))

    times = F.lit(1).cast("long")
    if grouped:  # of equal rows all but one are followed by an equal row
        own = own.withColumn("_self", F.explode(F.when(F.col("times") > 1, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
        own = own.withColumn("next", F.when(F.col("_self"), F.struct("text", "sketch")).otherwise(F.col("next")))
        times = F.when(F.col("_self"), F.col("times") - 1).otherwise(1)
    n = F.length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - half).cast("int")), F.substring(F.col("next.text"), F.lit(1), half))
    own = own.select("doc_id", n.alias("n_chars"), "sketch", F.col("next.sketch").alias("next_sketch"), edited.alias("edited"), times.alias("times"))
    own = own.select("doc_id", "n_chars", "sketch", "next_sketch", "times", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("edited"), size, scale).alias("edited_sketch"))
    out = own.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("sketch")).alias("fingerprint"), written(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"), F.size("sketch").cast("long").alias("n_hashes"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("in_edited"), containment(F.col("sketch"), F.col("next_sketch")).alias("in_next"), "times",
    )
    return out.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("_", "times") if grouped else out.drop("times")
