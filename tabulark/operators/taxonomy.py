"""Trees and the keyword index. Nodes: (code, parent, level, name, subject, keywords array<string>)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def closure(nodes: DataFrame) -> DataFrame:
    """code, ancestor, distance; every node is its own ancestor at 0. One join per level of the tree, as many as the
    tree is deep: levels are looked at until a step finds no parent. A cycle is an error."""
    edges = nodes.where("parent is not null").select(F.col("code").alias("child"), "parent")
    step = nodes.select("code", F.col("code").alias("ancestor"), F.lit(0).alias("distance"))
    out = step
    for depth in range(_depth(edges)):
        step = step.join(edges, F.col("ancestor") == F.col("child")).select("code", F.col("parent").alias("ancestor"), F.lit(depth + 1).alias("distance"))
        out = out.unionByName(step)
    return out


def _depth(edges: DataFrame) -> int:
    """Steps from the deepest node to the last parent that exists as a node or by name only: the nodes that are left
    after removing those that are no parent, level by level."""
    left, depth, n = edges.select("child", "parent").distinct(), 0, -1
    while True:
        now = left.count()
        if now == 0:
            return depth
        if now == n:
            raise ValueError("the tree has a cycle")
        depth, n = depth + 1, now
        # Edges whose parent hangs below another one reach one level further up.
        left = left.join(edges.select(F.col("child").alias("_c"), F.col("parent").alias("_p")), F.col("parent") == F.col("_c")).select("child", F.col("_p").alias("parent")).distinct()


def keyword_index(nodes: DataFrame) -> DataFrame:
    """keyword, code: each node's keywords lead to it and its ancestors."""
    words = nodes.select("code", F.explode("keywords").alias("keyword"))
    return words.join(closure(nodes).select("code", "ancestor"), "code").select("keyword", F.col("ancestor").alias("code")).distinct()


def map_points(points: DataFrame, nodes: DataFrame, threshold: float = 0.7, unknown: str = "UNKNOWN") -> DataFrame:
    """question_id, code, confidence, known. Points (question_id, point) match keywords exactly, else by containment
    either way; the deepest candidate wins, and confidence is the share of points that matched. A text that another one
    contains begins with a piece of up to three characters that the other one contains too: points without an exact
    match and keywords meet by these pieces, never all with all."""
    index = nodes.select("code", "level", F.explode("keywords").alias("keyword"))
    distinct = points.select("point").distinct()
    exact = distinct.join(index, F.col("point") == F.col("keyword")).select("point", "code", "level")
    rest = distinct.join(exact.select("point"), "point", "left_anti")
    loose = _contained(rest, index).select("point", "code", "level").distinct()
    hits = points.join(exact.unionByName(loose), "point", "left")
    out = hits.groupBy("question_id").agg(
        F.max_by("code", F.when(F.col("code").isNotNull(), F.struct("level", "code"))).alias("best"),
        (F.countDistinct(F.when(F.col("code").isNotNull(), F.col("point"))) / F.countDistinct("point")).alias("confidence"),
    )
    known = F.col("best").isNotNull() & (F.col("confidence") >= threshold)
    return out.select("question_id", F.when(known, F.col("best")).otherwise(unknown).alias("code"), F.round("confidence", 6).alias("confidence"), known.alias("known"))


def _pieces(c: Column) -> Column:
    """All pieces of one to three characters of a text."""
    of = lambda k: F.when(F.length(c) >= k, F.transform(F.sequence(F.lit(1), F.length(c) - (k - 1)), lambda i: F.substring(c, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(of(1), of(2), of(3)))


def _contained(points: DataFrame, index: DataFrame) -> DataFrame:
    """Points and keywords of which one contains the other."""
    head = lambda c: F.substring(c, F.lit(1), F.least(F.length(c), F.lit(3)))
    holds = points.select("point", F.explode(_pieces(F.col("point"))).alias("_p")).join(index.where("keyword <> ''").withColumn("_p", head(F.col("keyword"))), "_p").where(F.contains("point", "keyword"))
    held = points.where("point <> ''").withColumn("_p", head(F.col("point"))).join(index.select("*", F.explode(_pieces(F.col("keyword"))).alias("_p")), "_p").where(F.contains("keyword", "point"))
    return holds.select("point", "code", "level").unionByName(held.select("point", "code", "level"))


def children(nodes: DataFrame) -> DataFrame:
    """parent, n, codes in order."""
    return nodes.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("code")), ",").alias("codes"))


def nested(nodes: DataFrame, subject: str | None = None) -> DataFrame:
    """Three-level trees as nested structs: one row per root, of one `subject` if given."""
    nodes = nodes if subject is None else nodes.where(F.col("subject") == subject)
    leaf = nodes.where("level = 3").groupBy("parent").agg(F.sort_array(F.collect_list(F.struct("code", "name"))).alias("items"))
    mid = nodes.where("level = 2").alias("m").join(leaf.alias("l"), F.col("m.code") == F.col("l.parent"), "left")
    mid = mid.groupBy("m.parent").agg(F.sort_array(F.collect_list(F.struct("m.code", "m.name", "l.items"))).alias("groups"))
    return nodes.where("level = 1").alias("r").join(mid.alias("g"), F.col("r.code") == F.col("g.parent"), "left").select("r.code", "r.name", "g.groups")


def problems(nodes: DataFrame) -> DataFrame:
    """code, problem: unknown parents, wrong level order, repeated codes."""
    parents = nodes.select(F.col("code").alias("p"), F.col("level").alias("p_level"))
    lost = nodes.where("parent is not null").join(parents, F.col("parent") == F.col("p"), "left_anti").select("code", F.lit("unknown_parent").alias("problem"))
    order = nodes.join(parents, F.col("parent") == F.col("p")).where("level <> p_level + 1").select("code", F.lit("level_order").alias("problem"))
    twice = nodes.groupBy("code").count().where("count > 1").select("code", F.lit("duplicate").alias("problem"))
    return lost.unionByName(order).unionByName(twice)


def related(links: DataFrame, codes: DataFrame) -> DataFrame:
    """Cross links (source, target, relation) of the given codes, in both directions."""
    both = links.unionByName(links.select(F.col("target").alias("source"), F.col("source").alias("target"), "relation"))
    return both.join(codes.select(F.col("code").alias("source")), "source", "left_semi")


def upsert(seed: DataFrame, stored: DataFrame) -> DataFrame:
    """code and change (insert, update, keep, orphan) of a seed against the stored rows, by name and parent."""
    s = seed.select("code", F.struct("name", "parent").alias("new"))
    t = stored.select("code", F.struct("name", "parent").alias("old"))
    change = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "orphan").when(F.col("new").eqNullSafe(F.col("old")), "keep").otherwise("update")
    return s.join(t, "code", "full").select("code", change.alias("change"))


def applied(seed: DataFrame, stored: DataFrame) -> DataFrame:
    """The stored rows (code, name, parent) after an upsert of the seed, orphans kept, each with parent_code resolved
    (null for a parent that does not exist) and the level at which it is inserted: parents before children."""
    rows = stored.select("code", "name", "parent").join(seed.select("code"), "code", "left_anti").unionByName(seed.select("code", "name", "parent"))
    known = rows.select(F.col("code").alias("parent"), F.col("code").alias("parent_code"))
    level = closure(rows).groupBy("code").agg((F.max("distance") + 1).alias("level"))
    return rows.join(known, "parent", "left").join(level, "code").select("code", "name", "parent_code", "level")


def sub_points(questions: DataFrame) -> DataFrame:
    """question_id, sub, point, is_primary: the points of a question, and below a composite the distinct points of each
    sub-question (blank ones left out) as mappings of the second rank. Rows: question_id, is_composite, points
    array<string>, subs array<struct<qno,points>>."""
    own = questions.select("question_id", F.lit(None).cast("string").alias("sub"), F.explode("points").alias("point"), F.lit(True).alias("is_primary"))
    subs = questions.where("is_composite").select("question_id", F.explode("subs").alias("s"))
    below = subs.select("question_id", F.col("s.qno").alias("sub"), F.explode(F.array_distinct(F.filter(F.transform(F.col("s.points"), lambda p: F.trim(p)), lambda p: p != ""))).alias("point"), F.lit(False).alias("is_primary"))
    return own.unionByName(below)
