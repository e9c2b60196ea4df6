"""Sharding by weighted rendezvous hashing of stable record keys [native].

Every shard draws a score from hash(key, shard); the best score wins. Adding a shard can only win rows for
itself, and a change of one shard's weight only moves rows to or from that shard. All work is DataFrame
expressions: one exchange of narrow rows to number the rows inside each shard.

Defined cases: a null key is a key of its own; null text has size 1; equal rows are interchangeable and get
neighbouring slots; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Digits of the md5 that are used: 13 hexadecimal digits are 52 bits, which a double holds exactly.
DIGITS, BITS = 13, 52


def _draw(key: Column, salt: str) -> Column:
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f"|{salt}")).cast("binary"))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long")


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard of a key: argmin of -ln(u)/w over shards with weight w > 0, the smallest shard on ties."""
    if not any(w > 0 for w in weights):
        raise ValueError("at least one shard needs a positive weight")
    scores = [
        F.struct((-F.log((_draw(key, str(s)).cast("double") + 0.5) / 2.0**BITS) / F.lit(float(w))).alias("score"), F.lit(s).alias("shard"))
        for s, w in enumerate(weights)
        if w > 0
    ]
    return F.array_min(F.array(*scores))["shard"]


def number_rows(df: DataFrame, shard: str, order: list[str], count: str, rows_per_bucket: int = 8192) -> DataFrame:
    """Gapless slots 0.. inside each shard without bringing a shard to one task. `df` has one row for each
    distinct record and its `count`; the result has one row per record with `slot`.

    Records fall into hash buckets of about `rows_per_bucket` rows; bucket totals (a table of buckets, not of
    rows) give each bucket's first slot, and a window numbers the rows of one bucket. Runs of equal records are
    expanded in pieces, so a record that fills a third of the table is never sorted row by row."""
    n = df.count()
    bits = max(6, math.ceil(math.log2(max(1, n) / rows_per_bucket))) if n else 6
    keyed = df.withColumn("_k", _draw(F.concat_ws("|", *[F.col(c).cast("string") for c in order]), "slot"))
    keyed = keyed.withColumn("_b", F.shiftright("_k", BITS - bits))
    before = Window.partitionBy(shard).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        keyed.groupBy(shard, "_b").agg(F.sum(count).alias("_n"))
        .select(shard, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    )
    inside = Window.partitionBy(shard, "_b").orderBy("_k", *order).rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("_at", F.coalesce(F.sum(count).over(inside), F.lit(0))).join(first, [shard, "_b"])
    piece = 4096
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / piece)))
    placed = placed.withColumn("_c", chunk)
    start = F.col("_first") + F.col("_at") + F.col("_c") * piece
    end = F.col("_first") + F.col("_at") + F.least(F.col(count), (F.col("_c") + 1) * piece) - 1
    return placed.withColumn("slot", F.explode(F.sequence(start, end))).drop("_k", "_b", "_at", "_first", "_c", count)


def shard_documents(docs: DataFrame, shards: int = 16, weights: list[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of `docs`.

    `weights` has a weight for each of shards+1 shards at most; the last counts only for `grown_shard`."""
    weights = weights or [1.0] * (shards + 1)
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    records = slim.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_rows"))
    records = records.withColumn("shard", rendezvous(F.col("doc_id"), weights[:shards])).withColumn(
        "grown_shard", rendezvous(F.col("doc_id"), weights[: shards + 1])
    )
    out = number_rows(records, "shard", ["doc_id", "text_crc32", "size"], "_rows")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.col("grown_shard").cast("int")
    )
