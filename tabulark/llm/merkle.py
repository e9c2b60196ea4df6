"""Merkle manifest of a dataset: a digest per row, per group of rows and of the whole, and each row's proof.

A group's rows ascend by key, and every 16 consecutive nodes have a parent. A node's place is thus its rank, written in
digits to base 16, and its parent's is the rank without the last digit: a trie of ranks, whose longest prefixes are
reduced first, one aggregation a level, each with a sixteenth of the rows of the one before.

Exact ranks come without a sort of any group. The bits of the key are cut into digits, and rows are counted per prefix
of digits (`group_ranks`): a row's rank is the sum, over the prefixes of its key, of the counts of the smaller sibling
prefixes. Each of these sums runs among the children of one prefix, of which there are at most 2**20 (2**24 at the top),
whatever the group's size. Equal rows are counted, ranked as one and spread again.

Proofs are handed down from the root: a node's path is that of its parent behind its own siblings. A row's path is then
folded with the row's present digest, which gives the root exactly if the row is unchanged.

Defined cases: any column may be null (written as `-`); null groups come first; null keys come first in their group; rows
of equal key and group are ordered by their digest, so that equal rows are interchangeable; an empty text is `0:`; a
group of one row has that row's digest; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulark.llm.common import LOWER, UPPER, Scratch

FANOUT_BITS, FANOUT = 4, 16
DIGEST_BYTES = 32
ROWS_PER_RANGE = 50_000


def digest(data: Column) -> Column:
    return F.unhex(F.sha2(data, 256))


def as_text(digests: Column) -> Column:
    """One digest, or several laid end to end, as lowercase hexadecimal digits."""
    return F.lower(F.hex(digests))


def field(value: Column) -> Column:
    """UTF-8 byte count, `:`, value; `-` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(values: list[Column]) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def group_ranks(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """`rows` (g, key long, h binary and others, repeated rows too) with `rank`, from 0 in each g by key (null first) and h, and `m`,
    the rows of the group."""
    key, h = F.col("key"), F.col("h")
    digits = {
        "d1": F.coalesce(F.shiftright(key, 40), F.lit(-(1 << 24))),  # less than any other for a null key
        "d2": F.coalesce(F.shiftright(key, 24).bitwiseAND(0xFFFF), F.lit(0)),
        "d3": F.coalesce(F.shiftright(key, 8).bitwiseAND(0xFFFF), F.lit(0)),
        # The key's last eight bits, then twelve of the digest's, so that no key gathers in one place.
        "d4": F.coalesce(key.bitwiseAND(0xFF), F.lit(0)) * 4096 + F.conv(F.substring(F.hex(h), 1, 3), 16, 10).cast("long"),
    }
    at = list(digits)
    records = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")).withColumns(digits)
    records = scratch.write(records, "records")
    counts = [records.groupBy("g", *at).agg(F.sum("n").alias("n"))]
    counts.append(scratch.write(counts[0].groupBy("g", *at[:3]).agg(F.sum("n").alias("n")), "prefixes"))
    for k in (2, 1, 0):
        counts.append(counts[-1].groupBy("g", *at[:k]).agg(F.sum("n").alias("n")))
    sizes = counts.pop().withColumnRenamed("n", "m")
    starts = sizes.withColumn("first", F.lit(0).cast("long"))
    for k, count in enumerate(reversed(counts), 1):  # from one digit to four
        smaller = Window.partitionBy("g", *at[: k - 1]).orderBy(at[k - 1]).rowsBetween(Window.unboundedPreceding, -1)
        inside = count.select("g", *at[:k], F.coalesce(F.sum("n").over(smaller), F.lit(0)).alias("_in"))
        starts = inside.join(starts, ["g", *at[: k - 1]]).select("g", *at[:k], (F.col("first") + F.col("_in")).alias("first"), "m")
    before = Window.partitionBy("g", *at).orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    placed = records.withColumn("_at", F.coalesce(F.sum("n").over(before), F.lit(0))).join(starts, ["g", *at])
    start, piece = F.col("first") + F.col("_at"), 4096
    placed = placed.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / piece))))
    begin, end = F.col("_piece") * piece, F.least(F.col("n"), (F.col("_piece") + 1) * piece) - 1
    return placed.withColumn("rank", F.explode(F.sequence(start + begin, start + end))).select(*rows.columns, "rank", "m")


def ordered_ranks(rows: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """`rows` with `rank`, from 0 by a distinct string key: ranges of about ROWS_PER_RANGE rows, each ranked by itself behind the
    sizes of those before (a row per range). Written between, since another run may draw other bounds."""
    parts = max(1, math.ceil(rows.count() / ROWS_PER_RANGE))
    placed = scratch.write(rows.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return placed.withColumn("_in", inside).join(first, "_part").withColumn("rank", (F.col("_first") + F.col("_in") - 1).cast("long")).drop("_part", "_in", "_first")


def reduced(nodes: DataFrame, others: list[str], scratch: Scratch, name: str) -> list[DataFrame]:
    """The runs of each level, from the leaves up, of nodes (g, rank, m, h and `others`): g, p (the rank of their parent), m (nodes of
    the group on the level), hs (their digests end to end), node (the parent's digest; of a lone leaf its own) and, of leaves,
    kids (their other columns, in order)."""
    most = nodes.agg(F.max("m")).first()[0] or 0
    levels = []
    while not levels or most > 1:
        kids = F.array_sort(F.collect_list(F.struct("rank", "h", *(others if not levels else []))))
        found = nodes.groupBy("g", F.shiftright("rank", FANOUT_BITS).alias("p"), "m").agg(kids.alias("kids"))
        found = found.withColumn("hs", F.unhex(F.array_join(F.transform("kids", lambda kid: F.hex(kid["h"])), "")))
        found = found.withColumn("node", F.when(F.col("m") == 1, F.col("hs")).otherwise(digest(as_text(F.col("hs")))))
        levels.append(scratch.write(found if not levels else found.drop("kids"), f"{name}{len(levels)}"))
        most = (most + FANOUT - 1) // FANOUT
        nodes = levels[-1].where(f"m > {FANOUT}").select("g", F.col("p").alias("rank"), F.expr(f"(m + {FANOUT - 1}) div {FANOUT}").alias("m"), F.col("node").alias("h"))
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """g, root and depth (the number of levels that have runs of the group, 1 for a lone leaf) of each group."""
    found = [runs.where(f"m <= {FANOUT}").select("g", F.col("node").alias("root"), F.lit(k + 1).alias("depth")) for k, runs in enumerate(levels)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def paths(levels: list[DataFrame], roots: DataFrame) -> DataFrame:
    """g, kid (the leaf's other columns), h, root and path of each leaf: an array with the siblings before and behind (left, right)
    level by level, upon which the path that `roots` (g, root, depth, path) has for the group follows."""
    above = None
    for k in reversed(range(len(levels))):
        own = roots.where(F.col("depth") == k + 1).select("g", F.lit(0).cast("long").alias("p"), "root", "path")
        above = own if above is None else above.unionByName(own)
        n = (F.octet_length("hs") / DIGEST_BYTES).cast("int")
        runs = levels[k].join(above, ["g", "p"]).withColumn("i", F.explode(F.sequence(F.lit(0), n - 1)))
        cut = lambda begin, size: F.substring(F.col("hs"), begin * DIGEST_BYTES + 1, size * DIGEST_BYTES)
        i = F.col("i")
        siblings = F.array(F.struct(cut(F.lit(0), i).alias("left"), cut(i + 1, n - 1 - i).alias("right")))
        path = F.when(F.col("m") > 1, F.concat(siblings, F.col("path"))).otherwise(F.col("path"))
        own_columns = [F.col("kids")[i].alias("kid"), cut(i, F.lit(1)).alias("h")] if not k else []
        above = runs.select("g", (F.col("p") * FANOUT + i).alias("p"), "root", path.alias("path"), *own_columns)
    return above


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest gives with its path."""
    return F.aggregate(path, leaf, lambda found, s: digest(F.concat(as_text(s["left"]), as_text(found), as_text(s["right"]))))


def proof(path: Column) -> Column:
    """All siblings of a path, from the leaf's to the root's, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(as_text(s["left"]), as_text(s["right"]))), "")


def proofs(rows: DataFrame, others: list[str]) -> DataFrame:
    """For rows (g string, null allowed; key long; h binary; `others`): kid, h, subroot, root and path of each.

    Groups are ordered bytewise, null first; the tree over their roots is built like those of the groups."""
    scratch = Scratch(rows.sparkSession)
    named = F.coalesce(F.concat(F.lit("+"), F.col("g")), F.lit(""))  # never null, in the order of the groups
    levels = reduced(group_ranks(rows.withColumn("g", named), scratch), others, scratch, "runs")
    subroots = scratch.write(tops(levels), "subroots")
    ranked = ordered_ranks(subroots, "g", scratch).select(F.lit("").alias("g"), "rank", F.lit(subroots.count()).cast("long").alias("m"), F.col("root").alias("h"), F.col("g").alias("of"), "depth")
    over = reduced(ranked, ["of", "depth"], scratch, "groups")
    none = F.array().cast("array<struct<left:binary,right:binary>>")
    groups = paths(over, tops(over).withColumn("path", none))
    groups = groups.select(F.col("kid.of").alias("g"), F.col("h").alias("subroot"), "root", "path", F.col("kid.depth").alias("depth"))
    groups = scratch.write(groups.withColumn("root", F.struct("subroot", "root")).drop("subroot"), "tops")
    return paths(levels, groups).select("kid", "h", F.col("root.subroot").alias("subroot"), F.col("root.root").alias("root"), "path")


def document_leaves(docs: DataFrame) -> DataFrame:
    """doc_id, g (source), h (the row's digest) and changed: where 5 divides the checksum of the id, the digest of the row with
    its text's A-Z in lower case."""
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate(F.col("text"), UPPER, LOWER)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("g"), row_digest(columns).alias("h"), F.when(hit, row_digest([*columns[:-1], lowered])).alias("changed"))


def document_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of `docs`."""
    leaves = document_leaves(docs).withColumn("key", F.col("doc_id"))
    found = proofs(leaves, ["doc_id", "changed"])
    back = folded(F.coalesce("kid.changed", "h"), F.col("path"))
    found = found.select(F.col("kid.doc_id").alias("doc_id"), as_text(F.col("h")).alias("leaf"), as_text(F.col("subroot")).alias("subroot"), as_text(F.col("root")).alias("root"), F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), as_text(back).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
