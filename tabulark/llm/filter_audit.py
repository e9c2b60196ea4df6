"""Filter interaction audit: what each filter removes, and what others have left it to remove, in every order.

Direct relational replay: every document's flags are crossed with the 120 orders of five filters (a broadcast table of
120 rows, whatever the corpus), the first filter of the order that the document fails is found, its five steps are
exploded and conditional sums count what happens at each. The 600 rows of a document never leave their task: sums
per part, order and step are combined where they arise, and only those cross the network.

Only the filter on identical texts looks beyond a document. It needs the smallest doc_id of each text: a combined
minimum by the text's SHA-256. Texts that more than one row in `HOT_SHARE` holds (so at most HOT_SHARE texts) are
looked up in a broadcast table, all others by a shuffled join, in which no text has more rows than that.

Defined cases: null text counts as empty; a null source is the part ''; a null doc_id is identical to no smaller one
and carries no labels; rows that repeat a doc_id count as documents of their own, none of them smaller; of several labels
of a doc_id any 1 counts; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulark.llm.common import Scratch

FILTERS = "ABCDE"
#: A text is hot if it fills more than 1 / HOT_SHARE of the table. So at most HOT_SHARE texts of 44 bytes are broadcast.
HOT_SHARE = 50_000


def own_flags(text: Column) -> Column:
    """The filters that look at one text only, as bits 0 to 3 of an int."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    few = F.size(words) < 50
    repeated = 100 * F.size(F.array_distinct(words)) < 65 * F.size(words)
    loud = 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 5 * F.char_length(text).cast("long")
    marked = text.rlike(r"[#$%&*|]")
    return sum((F.when(bad, 1 << k).otherwise(0) for k, bad in enumerate((few, repeated, loud, marked))), F.lit(0))


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id, good, toxic: one row per doc_id."""
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))


def flagged(docs: DataFrame, labels: DataFrame, hot_share: int = HOT_SHARE) -> DataFrame:
    """part, mask (a bit for each failed filter), good, toxic: one narrow row for every row of `docs`."""
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    row = F.monotonically_increasing_id().alias("row")  # written below, so that it stays
    slim = scratch.write(slim.select(row, "doc_id", "part", own_flags(F.col("text")).alias("mask"), F.unhex(F.sha2("text", 256)).alias("key")), "flags")
    texts = slim.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = scratch.write(texts.where("n > 1"), "shared")
    most = max(2, math.ceil(slim.count() / hot_share))
    hot, cold = shared.where(F.col("n") > most), shared.where(F.col("n") <= most)
    # At most hot_share rows by the choice of `most`.
    firsts = slim.join(F.broadcast(hot.select("key", F.col("first").alias("_hot"))), "key", "left")
    # A hot text's rows look for a key of their own, which finds nothing, instead of meeting at the text's.
    own = F.when(F.col("_hot").isNotNull(), F.col("row").cast("string").cast("binary")).otherwise(F.col("key"))
    firsts = firsts.withColumn("key", own).join(cold.select("key", F.col("first").alias("_cold")), "key", "left")
    later = F.coalesce(F.col("doc_id") > F.coalesce("_hot", "_cold"), F.lit(False))
    # Rows without an id look for their row number among ids that are marked as none, which finds nothing either.
    out = firsts.select("part", (F.col("mask") + F.when(later, 16).otherwise(0)).alias("mask"), F.coalesce("doc_id", "row").alias("id"), F.col("doc_id").isNotNull().alias("known"))
    out = out.join(known_labels(labels).select(F.col("doc_id").alias("id"), F.lit(True).alias("known"), "good", "toxic"), ["id", "known"], "left")
    return out.select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def replay(flags: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and the counts of each, from part, mask, good and toxic of every document."""
    spark, n = flags.sparkSession, len(filters)
    orders = spark.createDataFrame([("".join(filters[k] for k in o), list(o)) for o in permutations(range(n))], "filter_order string, turn array<int>")
    crossed = flags.crossJoin(F.broadcast(orders))  # n! rows
    fails = lambda at: F.expr(f"(mask >> turn[{at}]) & 1 = 1")
    first = F.lit(n + 1)
    for at in reversed(range(n)):
        first = F.when(fails(at), at + 1).otherwise(first)
    steps = crossed.withColumn("first", first).withColumn("step", F.explode(F.array(*[F.lit(s) for s in range(1, n + 1)])))
    bit = F.expr("(mask >> turn[step - 1]) & 1 = 1")
    here = F.col("first") == F.col("step")
    count = lambda test: F.sum(F.when(test, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    found = steps.groupBy("part", "filter_order", "step").agg(
        count(F.col("first") > F.col("step")).alias("kept"),
        count(here).alias("removed"),
        count(bit & (F.col("first") < F.col("step"))).alias("redundant"),
        count(F.expr("mask = 1 << turn[step - 1]")).alias("unique_fails"),
        count(here & (F.col("good") == 1)).alias("good_lost"),
        count(here & (F.col("toxic") == 1)).alias("toxic_lost"),
    )
    each = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))  # a row for each order
    return found.withColumn("shapley", F.sum("removed").over(each))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    flags = Scratch(docs.sparkSession).write(flagged(docs, labels), "masks")
    return replay(flags)
