"""Merging of annotated questions: sub-questions, word-bank groups, shared material, composites.

Rows: (doc_id, pos, question_number, section, qtype, stem_line_ids, shared_line_ids, answer, score, confidence, page,
options array<struct<label,text>>); pos orders the questions of a document.
"""

from __future__ import annotations

import warnings
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulark.functions.patterns import parent_and_sub
from tabulark.operators.lines import in_order, so_far
from tabulark.session import bound_batches


def ordered(column: str, *more: str) -> Column:
    """Values of a group in order of pos."""
    return F.transform(F.array_sort(F.collect_list(F.struct("pos", column, *more))), lambda r: r[column])


def ordered_unique(column: str) -> Column:
    """Distinct elements of a group's arrays, in order of first appearance."""
    return F.array_distinct(F.flatten(ordered(column)))


def merged(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per group: line ids united in order, scores summed, the least confidence and page, the first answer."""
    return rows.groupBy(*keys).agg(
        F.min("pos").alias("pos"), ordered("question_number").alias("numbers"), ordered_unique("stem_line_ids").alias("stem_line_ids"), ordered_unique("shared_line_ids").alias("shared_line_ids"),
        F.sum("score").alias("score"), F.min("confidence").alias("confidence"), F.min("page").alias("page"), F.min_by("answer", F.when(F.col("answer").isNotNull(), F.col("pos"))).alias("answer"), F.count(F.lit(1)).alias("n"),
    )


def by_parent(rows: DataFrame) -> DataFrame:
    """Rows such as 15(1), 15(2) come together under 15."""
    return merged(rows.withColumn("parent", parent_and_sub(F.col("question_number"))["parent"]), "doc_id", "parent")


def word_bank_groups(rows: DataFrame, is_bank: Column, at_least: int = 2) -> DataFrame:
    """Runs of neighbouring word-bank questions of one section, of `at_least` questions."""
    w = in_order("doc_id", order="pos")
    marked = rows.withColumn("_bank", F.coalesce(is_bank, F.lit(False)))
    same = F.lag("_bank").over(w) & F.lag("section").over(w).eqNullSafe(F.col("section"))
    marked = marked.withColumn("_start", F.when(F.col("_bank") & F.coalesce(same, F.lit(False)), 0).otherwise(1))
    marked = marked.withColumn("run", F.sum("_start").over(so_far("doc_id", order="pos"))).where("_bank")
    return merged(marked, "doc_id", "section", "run").where(F.col("n") >= at_least)


def shared_material(rows: DataFrame, rounds: int | None = None, small: int = 10_000) -> DataFrame:
    """doc_id, pos, head: questions that share a line of material, directly or over others, and the first of them. Documents of at
    most `small` questions and lines, nearly all, are each settled where their rows meet, in one shuffle; the labels of larger ones
    spread in rounds. Rows with one pos count as one question. `rounds` sends all documents through so many rounds at most, with a
    warning if labels still change; by default nothing stops them."""
    rows = rows.where("doc_id is not null and pos is not null").select("doc_id", "pos", "shared_line_ids")
    if rounds is not None:
        return _spread(rows, rounds)
    bound_batches(rows.sparkSession)
    weight = F.greatest(F.size("shared_line_ids"), F.lit(0)) + 1
    large = rows.groupBy("doc_id").agg(F.sum(weight).alias("n")).where(F.col("n") > small).select("doc_id").persist()
    many = not large.isEmpty()
    rest = rows.join(F.broadcast(large), "doc_id", "left_anti") if many else rows  # at most one in `small` rows and lines
    met = rest.groupBy("doc_id").agg(F.collect_list("pos").alias("pos"), F.collect_list(F.coalesce("shared_line_ids", F.array().cast("array<string>"))).alias("lines"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    found = met.mapInArrow(_settled, f"doc_id {kinds['doc_id']}, pos {kinds['pos']}, head {kinds['pos']}")
    if many:
        found = found.unionByName(_spread(rows.join(F.broadcast(large), "doc_id", "left_semi"), None))
    large.unpersist()
    return found


def _settled(batches):
    """doc_id, pos, head of documents (doc_id, their pos, their lines), a batch of documents at once."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column(1)).to_numpy()
        of, pos, lines = np.repeat(np.arange(len(sizes)), sizes), batch.column(1).flatten(), batch.column(2).flatten()
        rank = np.unique(pos.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        node, first, number = np.unique(of * (rank.max(initial=0) + 1) + rank, return_index=True, return_inverse=True)
        coded = lines.flatten().dictionary_encode()
        there = coded.indices.is_valid().to_numpy(zero_copy_only=False)
        question = np.repeat(np.arange(len(of)), pc.list_value_length(lines).to_numpy())[there]
        code = coded.indices.drop_null().to_numpy()
        line = np.unique(of[question] * (len(coded.dictionary) + 1) + code, return_inverse=True)[1]
        at, head = number[question], np.arange(len(node))  # nodes go by document and pos, so the least is the first question
        while True:
            low, before = np.full(line.max(initial=-1) + 1, len(node)), head.copy()
            np.minimum.at(low, line, head[at])
            np.minimum.at(head, at, low[line])
            head = head[head]
            if (head == before).all():
                break
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[first])), pos.take(pa.array(first)), pos.take(pa.array(first[head]))], names=["doc_id", "pos", "head"])


def _spread(rows: DataFrame, rounds: int | None) -> DataFrame:
    """Labels spread along shared lines until no label changes; each round about doubles the reach by following labels of labels.
    Rounds are cut by checkpoints where a checkpoint folder is set."""
    links = rows.select("doc_id", "pos", F.explode("shared_line_ids").alias("line")).distinct()
    label = rows.select("doc_id", "pos").distinct().withColumn("head", F.col("pos"))
    reliable = rows.sparkSession.sparkContext.getCheckpointDir() is not None
    for done in count(1):
        before = label
        low = links.join(label, ["doc_id", "pos"]).groupBy("doc_id", "line").agg(F.min("head").alias("low"))
        near = links.join(low, ["doc_id", "line"]).groupBy("doc_id", "pos").agg(F.min("low").alias("low"))
        label = label.join(near, ["doc_id", "pos"], "left").select("doc_id", "pos", F.least("head", F.coalesce("low", "head")).alias("head"))
        up = label.select("doc_id", F.col("pos").alias("head"), F.col("head").alias("over"))
        label = label.join(up, ["doc_id", "head"]).select("doc_id", "pos", F.col("over").alias("head"))
        label = label.checkpoint() if reliable else label.persist()
        changed = label.join(before.withColumnRenamed("head", "_old"), ["doc_id", "pos"]).where("head <> _old").limit(1).count()
        if before.is_cached:
            before.unpersist()
        if not changed or done == rounds:
            if changed:
                warnings.warn(f"shared material: labels still change after {rounds} rounds", stacklevel=2)
            return label


def composites(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Groups of shared material with two questions or more as composites: numbers in order, options of each label
    once (the first), answers written `(q) a` and joined, the least confidence."""
    grouped = rows.join(heads, ["doc_id", "pos"])
    out = merged(grouped, "doc_id", "head").where("n > 1").drop("answer")
    parts = grouped.where("answer is not null").groupBy("doc_id", "head").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "question_number", "answer"))), lambda r: F.concat(F.lit("("), r["question_number"], F.lit(") "), r["answer"])), " ").alias("answer")
    )
    options = grouped.select("doc_id", "head", "pos", F.posexplode("options").alias("i", "o")).groupBy("doc_id", "head", F.col("o.label").alias("label")).agg(F.min_by("o.text", F.struct("pos", "i")).alias("text"))
    options = options.groupBy("doc_id", "head").agg(F.array_sort(F.collect_list(F.struct("label", "text"))).alias("options"))
    return out.join(parts, ["doc_id", "head"], "left").join(options, ["doc_id", "head"], "left")


def candidates_for(new: DataFrame, stored: DataFrame, k: int = 50) -> DataFrame:
    """For each new question the k latest stored ones of its subject. A subject's latest k are taken first, so the
    join never meets a whole subject."""
    latest = Window.partitionBy("subject").orderBy(F.desc("created"), F.asc("id"))
    top = stored.withColumn("_rn", F.row_number().over(latest)).where(F.col("_rn") <= k).select("subject", F.col("id").alias("stored_id"), F.col("stem").alias("stored_stem"))
    return new.join(top, "subject")


def retryable(rows: DataFrame | None = None, ingested: int = 0) -> Column:
    """Whether a document's pass should run again: nothing was ingested, or some questions are blocked or empty."""
    return (F.col("ingested") <= ingested) | (F.col("blocked") > 0) | (F.col("empty") > 0)


def retry_hints(rows: DataFrame, most: int = 20) -> DataFrame:
    """pos, hint for the first `most` questions of a pass that a second pass should mend: a stem without valid lines, a
    choice question's options, sub-question options, an answer that nothing supports. Rows: pos, question_number, stem,
    stem_status, qtype, options (array), bad_options array<string>, sub_options_bad, answer, answer_source."""
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    choice = F.col("qtype").isin("single_choice", "multiple_choice")
    none = choice & (F.coalesce(F.size("options"), F.lit(0)) <= 0) & (F.coalesce(F.size("bad_options"), F.lit(0)) <= 0)
    bad = F.concat(F.lit("options "), F.array_join(F.sort_array("bad_options"), "/"))
    parts = F.filter(F.array(
        F.when(empty("stem") | F.coalesce("stem_status", F.lit("missing")).isin("retry", "missing"), F.lit("stem lines")), F.when(none, F.lit("all options")), F.when(choice & (F.size("bad_options") > 0), bad),
        F.when(F.coalesce("sub_options_bad", F.lit(False)), F.lit("sub-question options")), F.when(empty("answer") & (F.col("answer_source") == "llm_fallback"), F.lit("answer lines")),
    ), lambda p: p.isNotNull())
    found = rows.select("pos", F.concat(F.lit("question "), "question_number", F.lit(": "), F.array_join(parts, "; ")).alias("hint"), F.size(parts).alias("_n")).where("_n > 0")
    return found.orderBy("pos").limit(most).select("pos", "hint")


def without_placeholders(rows: DataFrame) -> DataFrame:
    """Annotated questions without those that are placeholders: no stem lines, no answer, no options."""
    return rows.where((F.size("stem_line_ids") > 0) | (F.trim(F.coalesce("answer", F.lit(""))) != "") | (F.size("options") > 0))
