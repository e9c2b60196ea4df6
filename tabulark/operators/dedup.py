"""Exact and geometric deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulark.functions.similarity import box_iou
from tabulark.functions.text import compact_answer, content_hash


def first_per_hash(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key combination; rows without a hash all stay."""
    best = rows.where(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(F.min(order).alias(order))
    kept = rows.join(best, [*keys, order], "left_semi")
    return kept.unionByName(rows.where(F.col(keys[-1]).isNull()))


def duplicate_groups(rows: DataFrame, key: str, id_col: str) -> DataFrame:
    """Keys found more than once: count and smallest id."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id")).where("n > 1")


def ingest(new: DataFrame, store: DataFrame) -> DataFrame:
    """Outcome of each new row against the store on (subject, content_hash): new_question, new_instance, or
    conflict when the answers differ beyond layout."""
    known = store.groupBy("subject", "content_hash").agg(F.min("id").alias("question_id"), F.min_by("answer", "id").alias("known_answer"))
    out = new.join(known, ["subject", "content_hash"], "left")
    same = compact_answer(F.col("answer")) == compact_answer(F.col("known_answer"))
    return out.withColumn("outcome", F.when(F.col("question_id").isNull(), "new_question").when(same, "new_instance").otherwise("conflict"))


def conflicts(rows: DataFrame, key: str, answer: str) -> DataFrame:
    """Keys whose rows carry more than one distinct answer."""
    return rows.groupBy(key).agg(F.countDistinct(answer).alias("answers"), F.count(F.lit(1)).alias("n")).where("answers > 1")


def hash_collisions(rows: DataFrame, hash_col: str, text: str) -> DataFrame:
    """Hashes that stand for more than one text: what the normalization merges."""
    return rows.groupBy(hash_col).agg(F.countDistinct(text).alias("texts")).where("texts > 1")


def dedup_boxes(images: DataFrame, iou_at_least: float = 0.5, step: int = 10) -> DataFrame:
    """image_id, page, kept, method of images (image_id, page, box). Boxes of one page whose four coordinates round to the same steps are
    one image: their centres are at most `step` apart on each axis, nearer than the 50 pixels that make a duplicate, so the smallest id stays
    and each other one goes, for its overlap or else its distance. Images without a box stay."""
    cell = F.struct(*[F.bround(F.col("box")[k] / step).alias(k) for k in ("x1", "y1", "x2", "y2")])
    slim = images.select(F.col("image_id").cast("long").alias("image_id"), F.col("page").cast("long").alias("page"), "box")
    boxed = slim.where("box is not null").withColumn("_cell", cell)
    first = boxed.groupBy("page", "_cell").agg(F.min_by(F.struct("image_id", "box"), "image_id").alias("_first"))
    found = boxed.join(first, ["page", "_cell"])
    kept = F.col("image_id") == F.col("_first.image_id")
    method = F.when(~kept, F.when(box_iou(F.col("_first.box"), F.col("box")) >= iou_at_least, "iou").otherwise("distance"))
    bare = slim.where("box is null").select("image_id", "page", F.lit(True).alias("kept"), F.lit(None).cast("string").alias("method"))
    return found.select("image_id", "page", kept.alias("kept"), method.alias("method")).unionByName(bare)


def dedup_statistics(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("original"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("duplicates"))


def figure_ids(images: DataFrame) -> DataFrame:
    """FIG001.. for the images of a document that have no id yet, counted on from the highest id there is."""
    taken = F.coalesce(F.regexp_extract("figure_id", r"^FIG(\d+)$", 1).try_cast("int"), F.lit(0))
    rows = images.withColumn("_top", F.max(taken).over(Window.partitionBy("doc_id")))
    order = Window.partitionBy("doc_id", F.col("figure_id").isNull()).orderBy("page", "image_id")
    fresh = F.format_string("FIG%03d", F.col("_top") + F.row_number().over(order))
    return rows.withColumn("figure_id", F.coalesce("figure_id", fresh)).drop("_top")


def merge_duplicates(instances: DataFrame, groups: DataFrame) -> DataFrame:
    """Instances with their question replaced by the group's head. `groups` has question_id and head."""
    return instances.join(groups, "question_id", "left").withColumn("question_id", F.coalesce("head", "question_id")).drop("head")


def others_with_hash(rows: DataFrame) -> DataFrame:
    """id, other_id: for each question the smallest other id of its subject with its content hash. Ids meet their
    group's two smallest, so a large group makes no pairs."""
    keys = ["subject", "content_hash"]
    low = rows.where("content_hash is not null").groupBy(*keys).agg(F.min("id").alias("first"), F.max("id").alias("last"))
    second = rows.join(low, keys).where("id <> first").groupBy(*keys).agg(F.min("id").alias("second"))
    pairs = rows.join(low.where("first <> last").join(second, keys), keys)
    return pairs.select("id", F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("other_id"))


def candidate_dedup(new: DataFrame, stored: DataFrame) -> DataFrame:
    """`new` candidates with candidate_id: the stored candidate of the document and hash, else the first new one."""
    keys = ["document_id", "content_hash"]
    known = stored.groupBy(*keys).agg(F.min("id").alias("_known"))
    return new.join(known, keys, "left").withColumn("candidate_id", F.coalesce("_known", F.min("id").over(Window.partitionBy(*keys)))).drop("_known")


def content_updates(questions: DataFrame, updates: DataFrame) -> DataFrame:
    """`questions` (id, subject, stem, options, qtype, sub_questions, answer, status, content_hash) after `updates` (id,
    stem, options, sub_questions, answer; null leaves a field). The hash is computed anew only where hashed content
    changed; a changed hash that another question of the subject has, with another answer, sends an approved question
    back to review, outcome `conflict`; with the same answer it is `same`."""
    fields = ["stem", "options", "sub_questions", "answer"]
    rows = questions.join(updates.select("id", *[F.col(c).alias(f"_n_{c}") for c in fields]), "id", "left")
    changed = F.lit(False)
    for c in fields[:3]:
        changed = changed | (F.col(f"_n_{c}").isNotNull() & ~F.col(f"_n_{c}").eqNullSafe(F.col(c)))
    rows = rows.withColumn("_changed", changed)
    for c in fields:
        rows = rows.withColumn(c, F.coalesce(f"_n_{c}", c))
    rows = rows.drop(*[f"_n_{c}" for c in fields])
    fresh = content_hash(F.col("stem"), F.col("options"), F.col("qtype"), F.col("sub_questions"))
    rows = rows.withColumn("content_hash", F.when(F.col("_changed"), fresh).otherwise(F.col("content_hash")))
    stored = questions.select("subject", "content_hash", F.struct("id", F.trim(F.coalesce("answer", F.lit(""))).alias("answer")).alias("_o"))
    # Two stored ids a hash are enough to find one that is not the question itself.
    stored = stored.groupBy("subject", "content_hash").agg(F.min("_o").alias("_first"), F.max("_o").alias("_last"))
    rows = rows.join(stored, ["subject", "content_hash"], "left")
    other = F.when(F.col("_first.id") != F.col("id"), F.col("_first")).when(F.col("_last.id") != F.col("id"), F.col("_last"))
    own = F.trim(F.coalesce("answer", F.lit("")))
    differ = (own != "") & (other["answer"] != "") & (compact_answer(own) != compact_answer(other["answer"]))
    outcome = F.when(~F.col("_changed"), "kept").when(other.isNull(), "updated").when(differ, "conflict").otherwise("same")
    rows = rows.withColumn("outcome", outcome).withColumn("status", F.when((F.col("outcome") == "conflict") & (F.col("status") == "approved"), "reviewing").otherwise(F.col("status")))
    return rows.drop("_changed", "_first", "_last")


def backfill_hashes(questions: DataFrame, types: DataFrame) -> DataFrame:
    """`questions` (id, stem, options, sub_questions, type_id, content_hash) whose null hashes are computed, with the type
    code of `types` (type_id, qtype); the hash of the bare stem where that gives none. 'types' is a closed dimension."""
    rows = questions.join(types.select("type_id", "qtype"), "type_id", "left")
    full = content_hash(F.col("stem"), F.col("options"), F.col("qtype"), F.col("sub_questions"))
    return rows.withColumn("content_hash", F.coalesce("content_hash", full, F.sha2("stem", 256)))
