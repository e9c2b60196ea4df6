"""Near-duplicate classes from bottom-k sketches of one hash function.

Texts become sets of word-shingle hashes. Texts with one set share a node. Each node keeps the k smallest hashes of
its set. Nodes that retain a common value meet in that value's inverted list, where the union of two sketches
estimates their Jaccard similarity; pairs whose estimate could belong to a link (chance of a miss below
MISS) become candidates. Candidate groups are verified exactly on full sets, and links give the classes.

Frequent values need other handling, since a list must not make all its pairs. For lists longer than `list_bound`:
  * only nodes that meet nobody else but in such lists ("touched": as many of their retained values are frequent as
    a linked pair shares) are looked at again, over their full sets;
  * shingles are reordered, those frequent among touched nodes last, and each node keeps the prefix that any
    linked partner must hit (n - ceil(s n) + 1 values): exact, so a shared passage or line no longer brings
    unrelated texts together;
  * nodes whose prefix reaches frequent shingles consist of them almost wholly; they join the groups of the
    frequent values they keep.
Verification works on groups cut by set size (linked sets differ in size by the similarity at most) and by
hash into blocks of bounded size; every two blocks that can hold a link meet once, their intersections come from
matrix products, and a spanning forest of the links leaves the task instead of the links. No pair of a large
group is ever a row.

Defined cases: null and empty texts have no shingles and stand alone; fewer words than a shingle make one shingle;
null ids take part and never name a class unless nothing else does; repeated rows with an id share a class and are
kept or dropped alike; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabulark.llm.common import Scratch, _batch, shingles, sub_batches, tidy, word_hashes

SKETCH, MISS = 16, 2e-6
NO_ID = -(2**63)
BROADCAST_IDS = 2_000_000  # ids sent to every executor, 16 MB; beyond that Spark joins by shuffle
BROADCAST_VALUES = 4_000_000  # frequent shingles sent to every executor, 32 MB; beyond that they are joined
BLOCK_SETS, BLOCK_HASHES = 512, 1_000_000


def least_shared(similarity: float, k: int = SKETCH, miss: float = MISS) -> int:
    """The largest c with P(Binomial(k, similarity) < c) <= miss."""
    total, c = 0.0, 0
    while True:
        total += math.comb(k, c) * similarity**c * (1 - similarity) ** (k - c)
        if total > miss:
            return c
        c += 1


def as_id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


SET_DDL = "doc_id long, n long, key binary, hashes binary"
SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("hashes", pa.binary())])


def shingle_sets(docs: DataFrame, size: int, keep: int | None) -> DataFrame:
    """doc_id, n, key, hashes: the size of each text's set, its 128-bit name, and its `keep` smallest hashes in
    order (all of them for None)."""

    def run(batches):
        for whole in batches:
            for part in sub_batches(whole, 1_500_000):
                hashes, at = word_hashes(part.column(1))
                out = []
                for i, doc_id in enumerate(part.column(0).to_pylist()):
                    s = shingles(hashes[at[i] : at[i + 1]], size)
                    out.append((doc_id, len(s), xxhash.xxh3_128_digest(s), s[:keep].tobytes()))
                yield _batch(out, SETS)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(tidy(run), SET_DDL)


def full_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """key, n, hashes of `nodes` (key, doc_id), made again from the texts of one document each."""
    ids = nodes.select(as_id(F.col("doc_id")).alias("_id")).distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.join(ids, as_id(F.col("doc_id")) == F.col("_id"), "left_semi")
    found = shingle_sets(texts, size, None).groupBy("key").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes"))
    return found.join(nodes.select("key"), "key", "left_semi")


def list_pairs(entries: DataFrame, shared: int, percent: int) -> DataFrame:
    """a, b: pairs inside each value's list whose sizes and union sketch allow a link. `entries` has lists of
    bounded length only: value, key, n, sketch."""

    def estimate(x, y) -> bool:
        n, m = sorted((x["n"], y["n"]))
        if 100 * n < percent * m:
            return False
        s, t = np.frombuffer(x["sketch"], np.uint64), np.frombuffer(y["sketch"], np.uint64)
        union = np.union1d(s, t)[:SKETCH]
        both = len(np.intersect1d(s[s <= union[-1]], t[t <= union[-1]], assume_unique=True))
        return both >= max(1, shared * len(union) // SKETCH)

    def run(batches):
        for batch in batches:
            for part in sub_batches(batch, 2_000_000):
                out = set()
                for members in part.column(0).to_pylist():
                    for x, y in combinations(sorted(members, key=lambda m: m["key"]), 2):
                        if x["key"] != y["key"] and (x["key"], y["key"]) not in out and estimate(x, y):
                            out.add((x["key"], y["key"]))
                if out:
                    yield _batch(sorted(out), pa.schema([("a", pa.binary()), ("b", pa.binary())]))

    lists = entries.groupBy("value").agg(F.collect_list(F.struct("key", "n", "sketch")).alias("members")).where(F.size("members") > 1)
    return lists.select("members").mapInArrow(tidy(run), "a binary, b binary").distinct()


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """node, label for every end of an edge: the smallest node of its component. Each round sends every node to
    its smallest neighbour and contracts the edges; tables in the shared folder cut the lineage."""
    edges = scratch.write(edges.where("a <> b").distinct(), f"{name}-edges0")
    label, n = None, 0
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = scratch.write(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), f"{name}-step{n}")
        if label is None:
            label = step.select(F.col("a").alias("node"), F.col("to").alias("label"))
        else:
            moved = label.join(step, F.col("label") == F.col("a"), "left").select("node", F.coalesce("to", "label").alias("label"))
            label = moved
        label = scratch.write(label, f"{name}-label{n}")
        scratch.drop(f"{name}-label{n - 1}")
        left = edges.join(step, "a").select(F.col("to").alias("x"), "b")
        both = left.join(step.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        edges = scratch.write(both.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{name}-edges{n + 1}")
        scratch.drop(f"{name}-step{n}", f"{name}-edges{n}")
        n += 1
    if label is None:
        kind = edges.schema["a"].dataType
        return scratch.spark.createDataFrame([], T.StructType([T.StructField("node", kind), T.StructField("label", kind)]))
    return label


def block_links(a: list[np.ndarray], b: list[np.ndarray] | None, percent: int, slab: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Indices of linked sets: of `a` with each other (b None), or of `a` with `b`."""
    other = a if b is None else b
    rows = np.repeat(np.arange(len(a)), [len(x) for x in a])
    cols = np.repeat(np.arange(len(other)), [len(x) for x in other])
    va, vb = np.concatenate(a), np.concatenate(other)
    if b is None:
        values, counts = np.unique(va, return_counts=True)
        values = values[counts > 1]
    else:
        values = np.intersect1d(va, vb)
    inter = np.zeros((len(a), len(other)), np.float32)
    pa_, pb = np.searchsorted(values, va), np.searchsorted(values, vb)
    ina = pa_ < len(values)
    ina[ina] = values[pa_[ina]] == va[ina]
    inb = pb < len(values)
    inb[inb] = values[pb[inb]] == vb[inb]
    pa_, rows, pb, cols = pa_[ina], rows[ina], pb[inb], cols[inb]
    oa, ob = np.argsort(pa_, kind="stable"), np.argsort(pb, kind="stable")
    pa_, rows, pb, cols = pa_[oa], rows[oa], pb[ob], cols[ob]
    for at in range(0, len(values), slab):
        la, ra = np.searchsorted(pa_, [at, at + slab])
        lb, rb = np.searchsorted(pb, [at, at + slab])
        x, y = np.zeros((len(a), slab), np.float32), np.zeros((len(other), slab), np.float32)
        x[rows[la:ra], pa_[la:ra] - at] = 1
        y[cols[lb:rb], pb[lb:rb] - at] = 1
        inter += x @ y.T
    na, nb = np.array([len(x) for x in a])[:, None], np.array([len(x) for x in other])[None, :]
    found = 100 * inter >= percent * (na + nb - inter)
    return np.nonzero(np.triu(found, 1)) if b is None else np.nonzero(found)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """(root, member) pairs that connect what the links connect."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        while (label != label[label]).any():
            label = label[label]
        if (label == before).all():
            break
    return [(int(r), i) for i, r in enumerate(label) if r != i]


def verified_links(scratch: Scratch, groups: DataFrame, percent: int) -> DataFrame:
    """a, b: a spanning forest of the exact links inside each group. `groups` has group, key, n, hashes."""
    ratio = math.log(100 / percent)
    # Linked sets lie in one size class or in neighbouring ones.
    base = groups.withColumn("c", F.floor(F.log(F.col("n").cast("double")) / F.lit(ratio) * F.lit(1 - 1e-9)))
    totals = base.groupBy("group", "c").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("hashes"))
    parts = totals.select("group", "c", F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("hashes") / BLOCK_HASHES)).cast("long").alias("parts"))
    parts = scratch.write(parts, "parts")
    up, down = (parts.select("group", (F.col("c") - d).alias("c"), F.col("parts").alias(n)) for d, n in ((1, "up"), (-1, "down")))
    sized = parts.join(up, ["group", "c"], "left").join(down, ["group", "c"], "left").na.fill(0, ["up", "down"])
    alone = scratch.write(groups.groupBy("group").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("group"), "many")
    # Rows of 40 bytes, one per group and size class: broadcast, a large group stays spread as it is.
    if parts.count() <= BROADCAST_IDS:
        sized, alone = F.broadcast(sized), F.broadcast(alone)
    base = base.join(alone, "group", "left_semi").join(sized, ["group", "c"])
    base = base.withColumn("i", F.pmod(F.xxhash64("key"), F.col("parts")))

    def blocks(count: Column, make) -> Column:
        empty = F.array().cast("array<struct<c:bigint,i:bigint,d:bigint,j:bigint,side:int>>")
        return F.when(count > 0, F.transform(F.sequence(F.lit(0).cast("long"), count - 1), make)).otherwise(empty)

    def block(c, i, d, j, side):
        return F.struct(c.alias("c"), i.alias("i"), d.alias("d"), j.alias("j"), F.lit(side).alias("side")) if isinstance(side, int) else F.struct(c.alias("c"), i.alias("i"), d.alias("d"), j.alias("j"), side.alias("side"))

    c, i = F.col("c"), F.col("i")
    same = blocks(F.col("parts"), lambda j: block(c, F.least(i, j), c, F.greatest(i, j), F.when(i <= j, 0).otherwise(1)))
    above = blocks(F.col("up"), lambda j: block(c, i, c + 1, j, 0))
    below = blocks(F.col("down"), lambda j: block(c - 1, j, c, i, 1))
    placed = base.select("group", "key", "hashes", F.explode(F.concat(same, above, below)).alias("at")).select("group", "at.c", "at.i", "at.d", "at.j", "at.side", "key", "hashes")

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        inner = first["c"] == first["d"] and first["i"] == first["j"]
        sets = [np.frombuffer(h, np.uint64) for h in pdf["hashes"]]
        keys, side = list(pdf["key"]), pdf["side"].to_numpy()
        if inner:
            at = np.arange(len(sets))
            left, right = block_links(sets, None, percent) if len(sets) > 1 else (at[:0], at[:0])
        else:
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            left, right = (a[:0], b[:0])
            if len(a) and len(b):
                x, y = block_links([sets[k] for k in a], [sets[k] for k in b], percent)
                left, right = a[x], b[y]
        tree = forest(len(sets), left, right)
        return pd.DataFrame({"a": [keys[x] for x, _ in tree], "b": [keys[y] for _, y in tree]}, columns=["a", "b"])

    return placed.groupBy("group", "c", "i", "d", "j").applyInPandas(links, "a binary, b binary")


def near_duplicate_classes(docs: DataFrame, size: int = 5, percent: int = 80, list_bound: int = 50, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, key, component_id, kept, chosen for every row of `docs`. Texts are linked when
    100 |A & B| >= percent |A | B| for their sets of `size`-word shingles. Of the kept rows of a class, `chosen` marks
    those of the smallest key."""
    scratch = scratch or Scratch(docs.sparkSession)
    shared = least_shared(percent / 100)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = scratch.write(shingle_sets(docs, size, SKETCH), "sketches")
    nodes = sketches.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("hashes").alias("sketch"))
    nodes = scratch.write(nodes, "nodes")

    def run(batches):
        for batch in batches:
            for part in sub_batches(batch, 2_000_000):
                out = [(int(v), key, n, sketch) for key, n, sketch in zip(*(c.to_pylist() for c in part.columns)) for v in np.frombuffer(sketch, np.int64)]
                yield _batch(out, pa.schema([("value", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("sketch", pa.binary())]))

    entry_ddl = "value long, key binary, n long, sketch binary"
    entries = nodes.select("key", "n", "sketch").mapInArrow(run, entry_ddl)
    counts = scratch.write(entries.groupBy("value").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "counts")
    entries = scratch.write(entries.join(counts, "value"), "entries")
    scratch.drop("counts")
    edges = list_pairs(entries.where(F.col("m") <= list_bound).drop("m"), shared, percent)
    # Two linked sets share at least `shared` of their union's 16 smallest values. If a node retains fewer frequent
    # values than that, one of those it shares is not frequent, and the pair has met in a short list.
    often = entries.where(F.col("m") > list_bound).groupBy("key").agg(F.count(F.lit(1)).alias("often"), F.first("n").alias("n"))
    needed = F.greatest(F.lit(1), F.floor(F.lit(shared) * F.least(F.col("n"), F.lit(SKETCH)) / SKETCH))
    touched = scratch.write(often.where(F.col("often") >= needed).select("key"), "touched")
    if touched.limit(1).count():
        edges = edges.unionByName(_frequent_edges(scratch, docs, nodes, touched, size, percent, shared, list_bound))
    groups = components(scratch, edges, "groups")
    scratch.drop("entries", "touched", "touched-sets", "frequent", "prefixes", "groups-edges*", "groups-step*")

    members = scratch.write(groups.join(nodes.select(F.col("key").alias("node"), "doc_id"), "node"), "members")
    sets = full_sets(docs, members.select(F.col("node").alias("key"), "doc_id"), size)
    grouped = scratch.write(sets.join(members.select(F.col("node").alias("key"), F.col("label").alias("group")), "key"), "grouped")
    scratch.drop("members", "groups-label*")
    links = verified_links(scratch, grouped, percent)
    classes = components(scratch, links, "classes")
    scratch.drop("grouped", "parts", "many", "classes-edges*")
    named = nodes.join(classes, F.col("key") == F.col("node"), "left").select("key", "doc_id", F.coalesce("label", "key").alias("class"))
    named = scratch.write(named, "named")
    scratch.drop("nodes", "classes-label*", "classes-step*")
    lowest = named.groupBy("class").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "key"))["key"].alias("head"))
    out = sketches.select("doc_id", "n", "key").join(named.join(lowest, "class").select("key", "component_id", (F.col("key") == F.col("head")).alias("head")), "key", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    kept = F.col("doc_id").eqNullSafe(own)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "key", own.alias("component_id"), kept.alias("kept"), (kept & ((F.col("n") == 0) | F.col("head"))).alias("chosen"))


def _frequent_edges(scratch: Scratch, docs: DataFrame, nodes: DataFrame, touched: DataFrame, size: int, percent: int, shared: int, list_bound: int, broadcast_values: int = BROADCAST_VALUES) -> DataFrame:
    """Edges among the nodes that meet in lists longer than the bound."""
    known = nodes.join(touched, "key", "left_semi")
    sets = scratch.write(full_sets(docs, known, size), "touched-sets")

    def spread(batches):
        for batch in batches:
            for part in sub_batches(batch, 1_000_000):
                for key, n, hashes in zip(*(c.to_pylist() for c in part.columns)):
                    values = np.frombuffer(hashes, np.int64)
                    for at in range(0, len(values), 100_000):
                        piece = values[at : at + 100_000]
                        yield pa.RecordBatch.from_arrays([pa.array([key] * len(piece), pa.binary()), pa.array([n] * len(piece), pa.int64()), pa.array(piece)], names=["key", "n", "value"])

    columns = sets.select("key", "n", "hashes")
    rows = columns.mapInArrow(spread, "key binary, n long, value long")
    frequent = rows.groupBy("value").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > list_bound).select("value", F.lit(1).alias("often"))
    frequent = scratch.write(frequent, "frequent")
    if frequent.count() <= broadcast_values:
        shared_values = docs.sparkSession.sparkContext.broadcast(np.sort(frequent.select("value").toArrow().column(0).to_numpy()))

        def prefixes(batches):
            often = shared_values.value
            for batch in batches:
                for part in sub_batches(batch, 1_000_000):
                    for key, n, hashes in zip(*(c.to_pylist() for c in part.columns)):
                        values = np.sort(np.frombuffer(hashes, np.int64))
                        common = np.zeros(len(values), bool)
                        if len(often):
                            common = often[np.minimum(np.searchsorted(often, values), len(often) - 1)] == values
                        order = np.argsort(common, kind="stable")[: n + (-n * percent // 100) + 1]
                        marks = pa.array([1 if c else None for c in common[order]], pa.int32())
                        yield pa.RecordBatch.from_arrays([pa.array([key] * len(order), pa.binary()), pa.array([n] * len(order), pa.int64()), pa.array(values[order]), marks], names=["key", "n", "value", "often"])

        ranked = columns.mapInArrow(prefixes, "key binary, n long, value long, often int")
    else:
        order = Window.partitionBy("key").orderBy(F.col("often").asc_nulls_first(), "value")
        prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
        ranked = rows.join(frequent, "value", "left").withColumn("at", F.row_number().over(order)).where(F.col("at") <= prefix).select("key", "n", "value", "often")
    ranked = scratch.write(ranked, "prefixes")
    rare = ranked.where("often is null").select("value", "key", "n")
    pairs = rare.groupBy("value").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("value")
    rare = rare.join(pairs, "value", "left_semi").join(nodes.select("key", "sketch"), "key").select("value", "key", "n", "sketch")
    common = ranked.where("often = 1").select("value", "key")
    hubs = common.groupBy("value").agg(F.min("key").alias("a"))
    stars = common.join(hubs, "value").select("a", F.col("key").alias("b")).where("a <> b").distinct()
    return list_pairs(rare, shared, percent).unionByName(stars)


def with_keys(docs: DataFrame, size: int) -> DataFrame:
    """n, key, row: the set size and name of each row's text, and the row."""

    def run(batches):
        for whole in batches:
            for part in sub_batches(whole, 1_500_000):
                hashes, at = word_hashes(part.column(0))
                sets = [shingles(hashes[i:j], size) for i, j in zip(at, at[1:])]
                keys = [xxhash.xxh3_128_digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(map(len, sets), pa.int64()), pa.array(keys, pa.binary()), part.column(1)], names=["n", "key", "row"])

    packed = docs.select(F.col("text").cast("string").alias("text"), F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"))
    return packed.mapInArrow(tidy(run), T.StructType([T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()), packed.schema["row"]]))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, all columns, that stand for their class: those of the smallest id, and of several texts with
    that id those of the smallest key. Each row is judged by its own text, so that one id (or no id) on several texts
    loses the copies only. Repeated rows of one id stay together; of copies without any id one stays."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.write(near_duplicate_classes(docs, size, percent, scratch=scratch).select(as_id(F.col("doc_id")).alias("__id"), "n_shingles", "key", "chosen"), "judged")
    scratch.drop("sketches", "named")
    fates = found.groupBy("__id").agg(F.bool_or("chosen").alias("stays"), F.bool_or(~F.col("chosen")).alias("goes"), F.count_if(F.col("n_shingles") > 0).alias("n"))
    bare = (F.col("__id") == NO_ID) & (F.col("n") > 1)
    fates = scratch.write(fates.where(F.col("goes") | bare).select("__id", (F.col("stays") & (F.col("goes") | bare)).alias("mixed")), "fates")
    clear = docs.join(fates.select("__id"), as_id(docs["doc_id"]) == F.col("__id"), "left_anti")
    mixed = fates.where("mixed").select("__id")
    if not mixed.limit(1).count():
        scratch.drop("judged")
        return clear
    rows = with_keys(docs.join(mixed, as_id(docs["doc_id"]) == F.col("__id"), "left_semi"), size)
    gone = found.where(~F.col("chosen")).select("__id", F.col("key").alias("__key")).distinct()
    rows = rows.join(gone, (as_id(F.col("row.doc_id")) == F.col("__id")) & (F.col("key") == F.col("__key")), "left_anti")
    none = F.col("row.doc_id").isNull() & (F.col("n") > 0)
    first = rows.where(none).groupBy("key").agg(F.min_by("row", "row.text").alias("row"))
    rows = rows.where(~none).select("row").unionByName(first.select("row"))
    return clear.unionByName(rows.select(*[F.col("row")[c].alias(c) for c in docs.columns]))
