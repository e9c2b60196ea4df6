"""Writers, readers and document reports on the driver's tables: what a write leaves behind is the query's result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulark import sinks
from tabulark.functions import patterns as pt
from tabulark.operators import anchors, annotations, answers, bank, dedup, evals, lines as ln, merge, practice, taxonomy
from tabulark.plans.line_queries import NORM_SQL, hashed
from tabulark.plans.proxies import LINES_SQL, lines, read
from tabulark.plans.stream_queries import ANSWERS_SQL, STATE_SQL, answers as answer_log, events
from tabulark.session import shared_folder
from tabulark.sources import readers
from tabulark.streaming import states

BLOCK = "BLOCK"
HASHED_SQL = f"hashed AS (SELECT doc_id, text, source, lang, sha256({NORM_SQL}) AS h FROM documents)"


def orders(s, d):
    return read(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def _questions(s, d):
    """Parts as stored questions."""
    k = F.col("p_partkey")
    status = F.when(k % 3 == 0, "approved").when(k % 3 == 1, "reviewing").otherwise("rejected")
    issues = F.when(k % 4 == 0, F.array(F.lit("answer missing, BLOCK"))).when(k % 4 == 1, F.array(F.lit("short"))).otherwise(F.array().cast("array<string>"))
    subs = F.when(k % 5 == 0, F.array(F.struct(F.lit("1").alias("qno"), F.col("p_brand").alias("answer")), F.struct(F.lit("2").alias("qno"), F.lit(" ").alias("answer")))).otherwise(F.array().cast("array<struct<qno:string,answer:string>>"))
    return read(s, d, "part").select(
        k.alias("id"), F.when(k % 7 == 0, F.lit(" ")).otherwise(F.col("p_name")).alias("stem"), F.when(k % 6 == 0, None).otherwise(F.col("p_brand")).alias("answer"), ((k % 11) / 10).alias("confidence"),
        status.alias("status"), issues.alias("issues"), (k % 5 == 0).alias("is_composite"), subs.alias("sub_questions"),
    )


def _instances(s, d):
    return read(s, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("instance_id"), F.col("l_partkey").alias("question_id"), (F.col("l_orderkey") % 50).alias("document_id"))


def _rerun(s, d):
    questions, left = sinks.rerun_cleanup(_questions(s, d).select("id", "status"), _instances(s, d), 7)
    return questions.select("id", "occurrences")


def _promote(s, d):
    rows = hashed(s, d).select("doc_id", F.col("h").alias("content_hash"))
    taken, refused = bank.promote(rows.where("doc_id % 2 = 1"), rows.where("doc_id % 2 = 0"))
    return taken.select("doc_id", F.lit("new").alias("fate")).unionByName(refused.select("doc_id", F.lit("refused").alias("fate")))


def _move(s, d):
    rows = read(s, d, "events").select("user_id", "event_id", "event_type")
    moved, left = sinks.move(rows, F.col("event_type") == "error", "user_id", "event_id")
    return moved.select("event_id", F.lit("moved").alias("fate")).unionByName(left.select("event_id", F.lit("left").alias("fate")))


def _json_round_trip(s, d):
    import uuid

    path = f"{shared_folder(s)}/dump-{uuid.uuid4().hex}"
    rows = read(s, d, "nation").select("n_nationkey", "n_name", F.struct("n_regionkey").alias("nested"))
    sinks.write_json(rows, path)
    return s.read.schema(rows.schema).json(path).select("n_nationkey", "n_name", F.col("nested.n_regionkey").alias("n_regionkey"))


def _append_round_trip(s, d):
    import uuid

    path = f"{shared_folder(s)}/events-{uuid.uuid4().hex}"
    rows = read(s, d, "events").select("event_id", "event_type")
    sinks.append_events(rows.where("event_id % 2 = 0"), path)
    sinks.append_events(rows.where("event_id % 2 = 1"), path)
    return s.read.schema(rows.schema).parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def _dimension(s, d):
    dim = read(s, d, "region").where("r_regionkey < 3").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("int").alias("code"))
    names = read(s, d, "nation").join(read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.when(F.col("n_nationkey") == 3, "AMERICAS").when(F.col("n_nationkey") == 5, None).otherwise(F.col("r_name")).alias("name"))
    rows, grown = bank.with_created(names, dim, "name", {"AMERICAS": "AMERICA"}, unknown="unknown")
    return rows, grown


def _tree(s, d):
    region = read(s, d, "region").select(F.concat(F.lit("R"), F.col("r_regionkey")).alias("code"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    nation = read(s, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("code"), F.concat(F.lit("R"), F.col("n_regionkey")).alias("parent"), F.col("n_name").alias("name"))
    return region.unionByName(nation)


def _applied(s, d):
    seed = _tree(s, d).where("code <> 'N5'").withColumn("name", F.when(F.col("code") == "N3", F.lit("renamed")).otherwise(F.col("name")))
    return taxonomy.applied(seed, _tree(s, d).where("code not in ('N7', 'R2')").withColumn("name", F.lower("name")))


def _updates(s, d):
    """Documents as questions; a third takes over its successor's text, with its own answer or the successor's."""
    t = read(s, d, "documents")
    empty_options, empty_subs = F.array().cast("array<struct<label:string,text:string>>"), F.array().cast("array<struct<qno:string,question_type:string,answer:string>>")
    rows = hashed(s, d).select(
        F.col("doc_id").alias("id"), F.lit("s").alias("subject"), F.col("text").alias("stem"), empty_options.alias("options"), F.lit("q").alias("qtype"), empty_subs.alias("sub_questions"),
        F.concat(F.lit("a"), (F.col("doc_id") % 4).cast("string")).alias("answer"), F.lit("approved").alias("status"), F.concat(F.lit("old"), F.col("doc_id").cast("string")).alias("content_hash"),
    )
    rows = rows.withColumn("content_hash", dedup.content_hash(F.col("stem"), F.col("options"), F.col("qtype"), F.col("sub_questions")))
    new = t.select((F.col("doc_id") - 1).alias("id"), F.col("text").alias("stem")).where("id >= 0 and id % 3 = 0")
    new = new.withColumn("options", F.lit(None).cast(empty_options_type())).withColumn("sub_questions", F.lit(None).cast("array<struct<qno:string,question_type:string,answer:string>>"))
    return dedup.content_updates(rows, new.withColumn("answer", F.when(F.col("id") % 2 == 0, F.lit("a1")))).select("id", "outcome", "status")


def empty_options_type() -> str:
    return "array<struct<label:string,text:string>>"


def _backfill(s, d):
    part = read(s, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("stem"), F.lit(None).cast(empty_options_type()).alias("options"), F.lit(None).cast("array<struct<qno:string,question_type:string,answer:string>>").alias("sub_questions"),
        (F.col("p_partkey") % 4).alias("type_id"), F.when(F.col("p_partkey") % 3 == 0, F.lit("known")).alias("content_hash"),
    )
    types = s.createDataFrame([(0, "choice"), (1, "fill"), (2, "essay")], "type_id long, qtype string")
    return dedup.backfill_hashes(part, types).select("id", "content_hash")


def _option_rows(s, d, side):
    """Orders as option lines: the line numbers are labels."""
    rows = read(s, d, "lineitem").where(F.col("l_orderkey") % 2 == side).groupBy("l_orderkey").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct((F.col("l_suppkey") % 9).alias("k"), F.lit("x").alias("v"))))).alias("entries"))
    return rows.select(F.col("l_orderkey").alias("left_id" if side == 0 else "right_id"), F.floor(F.col("l_orderkey") / 10).alias("page"), "entries")


def _range_match(s, d):
    """Customers against suppliers: by a key of text, else by the range of their numbers."""
    subs = lambda k, n: F.array(*[F.struct((k % n + i).cast("string").alias("qno"), F.lit("").alias("stem")) for i in range(3)])
    left = read(s, d, "customer").select(F.col("c_custkey").alias("left_id"), F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("t"), F.col("c_custkey") % 200)).otherwise(F.concat(F.lit("none"), F.col("c_custkey"))).alias("a"), evals.sub_range(subs(F.col("c_custkey"), 40)).alias("b"))
    right = read(s, d, "supplier").select(F.col("s_suppkey").alias("right_id"), F.concat(F.lit("t"), F.col("s_suppkey")).alias("a"), evals.sub_range(subs(F.col("s_suppkey"), 30)).alias("b"))
    return merge.two_tier(left, right, "a", "b")


def _images(s, d):
    return bank.image_order(read(s, d, "lineitem").select(F.col("l_partkey").alias("question_id"), (F.col("l_orderkey") % 9).alias("page"), F.col("l_quantity").alias("top"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("image_id")))


def _anchor_rows(s, d):
    return read(s, d, "events").select(F.col("user_id").alias("doc_id"), F.when(F.col("value") > 80, "exact").when(F.col("value") > 40, "fuzzy").otherwise("retry").alias("status"))


def _structure(s, d):
    rows = read(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("question_number"), (F.col("o_orderkey") % 4 == 0).alias("is_composite"), F.array((F.col("o_custkey") % 50).cast("string"), F.lit("b")).alias("subs"), (F.col("o_orderkey") % 8 == 0).alias("relative"))
    return evals.structure_stats(rows)


def _structure_report(s, d):
    rows = read(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("question_number"), F.when(F.col("o_orderkey") % 3 == 0, "composite").otherwise("independent").alias("kind"), F.array((F.col("o_custkey") % 3).cast("string")).alias("subs"))
    other = rows.where("cast(question_number as int) % 10 <> 1").withColumn("kind", F.when(F.col("question_number").endswith("5"), "composite").otherwise(F.col("kind"))).withColumn("subs", F.when(F.col("question_number").endswith("7"), F.array(F.lit("9"))).otherwise(F.col("subs")))
    return evals.structure_report(rows.where("cast(question_number as int) % 10 <> 2"), other).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def _figures(s, d):
    rows = read(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.col("l_suppkey").alias("image_id"), F.when(F.col("l_linenumber") == 2, F.lit("FIG007")).alias("figure_id"))
    return dedup.figure_ids(rows).select("doc_id", "page", "figure_id")


def _word_banks(s, d):
    """Lines as word-bank questions: runs of neighbouring short lines in one document."""
    rows = lines(s, d).select(
        "doc_id", F.col("line_no").alias("pos"), F.col("line_no").cast("string").alias("question_number"), F.lit("s").alias("section"), F.array(F.col("line_no").cast("string")).alias("stem_line_ids"),
        F.array(F.lit("w")).alias("shared_line_ids"), F.lit(1.0).alias("score"), F.lit(0.9).alias("confidence"), F.lit(1).alias("page"), F.lit("a").alias("answer"), F.length("text").alias("len"),
    )
    return annotations.word_bank_groups(rows, F.col("len") < 60).select("doc_id", "run", "n", "pos", "score", F.array_join("stem_line_ids", ",").alias("ids"))


def _by_parent(s, d):
    one = read(s, d, "lineitem").groupBy("l_orderkey", "l_partkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_suppkey", "l_quantity", "l_discount", "l_returnflag")])
    rows = one.select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("pos"), F.concat(F.floor(F.col("l_linenumber") / 3).cast("string"), F.lit("("), F.col("l_linenumber").cast("string"), F.lit(")")).alias("question_number"),
        F.array((F.col("l_suppkey") % 3).cast("string"), (F.col("l_suppkey") % 5).cast("string")).alias("stem_line_ids"), F.array(F.lit("s")).alias("shared_line_ids"), F.col("l_quantity").alias("score"), F.col("l_discount").alias("confidence"), F.col("l_linenumber").alias("page"),
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_returnflag")).alias("answer"),
    )
    return annotations.by_parent(rows).select("doc_id", "parent", "n", "score", "confidence", "answer", F.array_join("stem_line_ids", ",").alias("ids"))


def _material(s, d):
    """Lines of one document that share a supplier's group, over each other."""
    rows = read(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.array((F.col("l_suppkey") % 6).cast("string"), (F.col("l_partkey") % 6).cast("string")).alias("shared_line_ids"))
    return annotations.shared_material(rows)


def _candidates(s, d):
    stored = read(s, d, "orders").select(F.col("o_orderpriority").alias("subject"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created"), F.lit("x").alias("stem"))
    new = read(s, d, "customer").select(F.col("c_custkey").alias("new_id"), F.when(F.col("c_custkey") % 2 == 0, "1-URGENT").otherwise("5-LOW").alias("subject"))
    return annotations.candidates_for(new, stored, 3).groupBy("stored_id").agg(F.count(F.lit(1)).alias("n"))


def _merged_duplicates(s, d):
    instances = _instances(s, d)
    groups = read(s, d, "part").select(F.col("p_partkey").alias("question_id"), (F.col("p_partkey") - F.col("p_partkey") % 3).alias("head")).where("question_id % 2 = 0")
    return dedup.merge_duplicates(instances, groups).groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))


def _related(s, d):
    links = read(s, d, "nation").select(F.col("n_name").alias("source"), F.col("n_regionkey").cast("string").alias("target"), F.lit("in").alias("relation"))
    return taxonomy.related(links, s.createDataFrame([("1",), ("FRANCE",)], "code string"))


def _ocr_lines(s, d):
    """Documents as recognized pages: each line is a block."""
    blocks = lines(s, d).select("doc_id", (F.floor((F.col("line_no") - 1) / 4) + 1).cast("int").alias("page"), F.col("line_no").alias("block_no"), F.when(F.col("line_no") % 5 == 0, "table").otherwise("text").alias("label"), F.concat("text", F.lit("\nmore\n\n")).alias("content"))
    return readers.numbered_lines(blocks, document=["doc_id"]).select("doc_id", "line_id", "order", "block_type", F.length("text").alias("n"))


def _placed_images(s, d):
    images = read(s, d, "lineitem").select((F.col("l_orderkey") % 200).alias("doc_id"), F.col("l_linenumber").alias("page"), (F.col("l_suppkey") % 60).cast("double").alias("x"), (F.col("l_partkey") % 80).cast("double").alias("y"), F.col("l_orderkey").alias("xref"))
    refs = read(s, d, "orders").select(F.col("o_orderkey").alias("ref_id"), (F.col("o_orderkey") % 200).alias("doc_id"), F.lit(1).alias("page"), (F.col("o_custkey") % 60).cast("double").alias("x"), (F.col("o_orderkey") % 80).cast("double").alias("y"))
    return readers.images_for_refs(refs, images)


def _text_blocks(s, d):
    rows = read(s, d, "lineitem").select((F.col("l_orderkey") % 500).alias("doc_id"), F.col("l_linenumber").alias("page"), (F.col("l_orderkey") + F.col("l_partkey") / 1e6).alias("x"), (F.col("l_suppkey") * 9 % 900).cast("double").alias("y"), F.lit("t").alias("text"))
    return readers.text_blocks(rows).groupBy("doc_id", "page").agg(F.max("line_no_in_page").alias("n"), F.min_by("y", "line_no_in_page").alias("top"))


def _paragraphs(s, d):
    rows = read(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.when(F.col("l_linenumber") != 3, F.lit(1)).alias("num_id"), F.lit(0).alias("level"), F.when(F.col("l_orderkey") % 2 == 0, "upperRoman").otherwise("lowerLetter").alias("format"), F.lit("t").alias("text"))
    return readers.numbered_paragraphs(rows).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


def _tables_joined(s, d):
    rows = ln.joined_tables(lines(s, d), F.length("text") % 7 == 0, F.length("text") % 5 == 0)
    return rows.groupBy("doc_id").agg(F.max("block").alias("blocks"))


def _carry_pages(s, d):
    """Numbers carried on a page; before a page's first number its virtual bucket, page times 1000."""
    rows = lines(s, d).withColumn("page_no", F.floor((F.col("line_no") - 1) / 6).cast("int") + 1)
    return ln.carry_on_page(rows, F.when(F.length("text") < 50, F.col("line_no"))).select("doc_id", "line_no", "carried")


def _events_log(s, d):
    return read(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("stage"), F.col("event_id").alias("attempt"), F.col("value").alias("seconds"))


def _points(s, d):
    subs = F.when(F.col("p_size") % 2 == 0, F.array(F.struct(F.lit("1").alias("qno"), F.array(F.col("p_brand"), F.lit(" "), F.col("p_brand")).alias("points")), F.struct(F.lit("2").alias("qno"), F.array(F.lit("  "), F.lit("")).alias("points")))).otherwise(F.array().cast("array<struct<qno:string,points:array<string>>>"))
    return taxonomy.sub_points(read(s, d, "part").select(F.col("p_partkey").alias("question_id"), (F.col("p_size") % 2 == 0).alias("is_composite"), F.array("p_type").alias("points"), subs.alias("subs")))


def _composites_first(s, d):
    rows = read(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"))
    return merge.composites_first(rows.where("pos % 2 = 0"), rows.where("pos % 2 = 1"))


def _quarantine(s, d):
    good, bad = sinks.good_and_quarantine(orders(s, d), {"price": F.col("o_totalprice") > 50000, "status": F.col("o_orderstatus") != "P"})
    return good.select("o_orderkey", F.lit("").alias("errors")).unionByName(bad.select("o_orderkey", F.array_join("_errors", ",").alias("errors")))


QUERIES = {
    "w_insert": _append_round_trip,
    "w_delete": lambda s, d: sinks.delete(orders(s, d), read(s, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"]),
    "w_upsert": lambda s, d: sinks.upsert(orders(s, d), orders(s, d).where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.lit(1.0)), ["o_orderkey"]),
    "w_update_where": lambda s, d: sinks.update_where(orders(s, d), read(s, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"], {"o_orderstatus": F.lit("X")}),
    "w_backfill": lambda s, d: sinks.update_from(orders(s, d).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus"))), read(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("o_orderstatus")), ["o_custkey"], ["o_orderstatus"]),
    "w_quarantine": _quarantine, "w_rerun_cleanup": _rerun, "w_promote": _promote, "w_move": _move, "w_json": _json_round_trip,
    "w_dimension_rows": lambda s, d: _dimension(s, d)[0].select("n_nationkey", "code"), "w_dimension": lambda s, d: _dimension(s, d)[1],
    "w_taxonomy": _applied, "w_hash_backfill": _backfill,
    "hash_neighbours": lambda s, d: dedup.others_with_hash(hashed(s, d).select(F.col("doc_id").alias("id"), F.col("lang").alias("subject"), F.col("h").alias("content_hash"))),
    "page_range": lambda s, d: anchors.in_pages(lines(s, d).withColumn("page_no", F.floor((F.col("line_no") - 1) / 5) + 1), 2, 3).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")),
    "ingestable": lambda s, d: _questions(s, d).groupBy(bank.ingestable(BLOCK).alias("ingestable")).agg(F.count(F.lit(1)).alias("n")),
    "image_order": lambda s, d: _images(s, d).select("image_id", "image_order"), "question_images": lambda s, d: bank.images_of(_images(s, d), 7).select("image_id", "image_order"),
    "content_updates": _updates,
    "candidate_dedup": lambda s, d: dedup.candidate_dedup(hashed(s, d).where("doc_id % 2 = 1").select(F.col("doc_id").alias("id"), F.col("lang").alias("document_id"), F.col("h").alias("content_hash")), hashed(s, d).where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("lang").alias("document_id"), F.col("h").alias("content_hash"))).select("id", "candidate_id"),
    "best_key_coverage": lambda s, d: merge.best_key_coverage(_option_rows(s, d, 0), _option_rows(s, d, 1), ["page"]).select("left_id", "right_id", F.round("coverage", 6).alias("coverage")),
    "range_match": _range_match, "composites_first": _composites_first, "sub_points": _points,
    "anchor_summaries": lambda s, d: anchors.anchor_summary(_anchor_rows(s, d), "doc_id").select("doc_id", F.array_join(F.transform(F.map_entries("summary"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("summary")),
    "provenance": lambda s, d: anchors.provenance(_anchor_rows(s, d), "status"),
    "health": lambda s, d: evals.health(_questions(s, d), BLOCK),
    "run_stats": lambda s, d: evals.run_stats(_questions(s, d), read(s, d, "lineitem").select(F.when(F.col("l_linenumber") != 1, F.struct("l_linenumber")).alias("box"), F.col("l_returnflag").alias("placement")), BLOCK),
    "structure_stats": _structure, "structure_report": _structure_report,
    "composite_answers": lambda s, d: answers.composite_answers(_questions(s, d)).groupBy("has_summary", "n_answered").agg(F.count(F.lit(1)).alias("n")),
    "figure_ids": _figures, "word_bank_runs": _word_banks, "sub_question_merge": _by_parent, "shared_material": _material, "subject_candidates": _candidates, "merged_duplicates": _merged_duplicates, "related_nodes": _related,
    "ocr_lines": _ocr_lines, "placed_images": _placed_images, "text_blocks": _text_blocks, "numbered_paragraphs": _paragraphs, "tables_joined": _tables_joined, "carry_on_page": _carry_pages,
    "retryable": lambda s, d: _questions(s, d).select("id", (F.col("id") % 3).alias("ingested"), (F.col("id") % 2).alias("blocked"), F.lit(0).alias("empty")).select("id", annotations.retryable(None).alias("again")),
    "task_transitions": lambda s, d: states.task_transitions(events(s, d)).groupBy("before", "kind", "allowed").agg(F.count(F.lit(1)).alias("n")),
    "breaker_states": lambda s, d: states.breaker_states(events(s, d), "failed", 2, 86400).groupBy("key").agg(F.count_if("open").alias("n_open")),
    "priority_queue": lambda s, d: states.by_priority(states.latest_state(events(s, d)).where("state = 'queued'").withColumn("priority", F.col("key") % 3)).select("key", "priority"),
    "selected_stages": lambda s, d: states.selected_stages(_events_log(s, d)).where("selected").select("key", "stage", "attempt"),
    "set_diff_rows": lambda s, d: read(s, d, "part").select("p_partkey").subtract(read(s, d, "lineitem").where("l_quantity > 25").select(F.col("l_partkey").alias("p_partkey"))),
    "hash_collisions_found": lambda s, d: dedup.hash_collisions(hashed(s, d).select("h", "text").unionByName(hashed(s, d).select("h", F.concat(F.lit(" "), "text", F.lit(".")).alias("text"))), "h", "text"),
    "footers_dropped": lambda s, d: lines(s, d).withColumn("text", F.when(F.col("line_no") % 9 == 0, F.concat(F.lit("第 "), F.col("line_no").cast("string"), F.lit(" 页/共 99 页"))).otherwise(F.col("text"))).where(~pt.is_footer(F.col("text"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")),
    "canonical_fill": lambda s, d: merge.canonical(lines(s, d).withColumn("text", F.when(F.col("line_no") % 3 == 0, F.lit(" ")).otherwise(F.col("text"))), lines(s, d).withColumn("doc_id", F.col("doc_id") - 1).withColumn("line_id", F.col("line_no")), ["doc_id", "line_no"]).groupBy("doc_id").agg(F.sum(F.length("merged")).alias("n")),
    "wrong_by_node": lambda s, d: practice.wrong_by(answer_log(s, d), answer_log(s, d).select("question_id", "node").distinct(), "node"),
}

KEPT = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"
SOME = "SELECT c_custkey FROM customer WHERE c_nationkey < 5"
QUESTIONS_SQL = """questions AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE p_name END AS stem, CASE WHEN p_partkey % 6 <> 0 THEN p_brand END AS answer, (p_partkey % 11) / 10 AS confidence,
  CASE p_partkey % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'reviewing' ELSE 'rejected' END AS status, p_partkey % 4 AS issue, p_partkey % 5 = 0 AS composite FROM part)"""
TREE_SQL = "tree AS (SELECT 'R' || r_regionkey AS code, NULL AS parent, r_name AS name, 1 AS level FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_name, 2 FROM nation)"
OPTIONS_SQL = "o AS (SELECT l_orderkey AS id, l_orderkey // 10 AS page, list_distinct(list(l_suppkey % 9)) AS k FROM lineitem GROUP BY 1)"
ANCHORS_SQL = "a AS (SELECT user_id AS doc_id, CASE WHEN value > 80 THEN 'exact' WHEN value > 40 THEN 'fuzzy' ELSE 'retry' END AS status FROM events)"
EVENTS_SQL = f"e AS (SELECT user_id AS key, ts, event_id, {STATE_SQL} AS kind FROM events)"
ROMAN_SQL = "repeat('X', CAST(n // 10 AS INT)) || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1]  /* to 39 */"

ORACLES = {
    "w_insert": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "w_delete": f"{KEPT} WHERE o_custkey NOT IN ({SOME})",
    "w_upsert": "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE o_totalprice END AS o_totalprice FROM orders",
    "w_update_where": f"SELECT o_orderkey, o_custkey, CASE WHEN o_custkey IN ({SOME}) THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders",
    "w_backfill": "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'n' || c_nationkey END AS o_orderstatus, o_totalprice FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    "w_quarantine": "SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice <= 50000 THEN 'price' END, CASE WHEN o_orderstatus = 'P' THEN 'status' END) AS errors FROM orders",
    "w_rerun_cleanup": f"""WITH {QUESTIONS_SQL}, i AS (SELECT l_partkey AS q, l_orderkey % 50 AS doc FROM lineitem), gone AS (SELECT i.* FROM i JOIN questions ON q = id WHERE doc = 7 AND status <> 'approved'),
      kept AS (SELECT q, count(*) AS n FROM i JOIN questions ON q = id WHERE NOT (doc = 7 AND status <> 'approved') GROUP BY q)
      SELECT id, coalesce(n, 0) AS occurrences FROM questions LEFT JOIN kept ON q = id WHERE n IS NOT NULL OR id NOT IN (SELECT q FROM gone)""",
    "w_promote": f"WITH {HASHED_SQL} SELECT doc_id, CASE WHEN h IN (SELECT h FROM hashed WHERE doc_id % 2 = 0) THEN 'refused' ELSE 'new' END AS fate FROM (SELECT doc_id, h, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS rn FROM hashed WHERE doc_id % 2 = 1)",
    "w_move": "SELECT min(event_id) AS event_id, 'moved' AS fate FROM events WHERE event_type = 'error' GROUP BY user_id UNION ALL SELECT event_id, 'left' FROM events WHERE event_type <> 'error'",
    "w_json": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "w_dimension_rows": """WITH n AS (SELECT n_nationkey, CASE WHEN n_nationkey = 5 THEN 'unknown' ELSE r_name END AS name FROM nation JOIN region ON n_regionkey = r_regionkey),
      fresh AS (SELECT name, 2 + row_number() OVER (ORDER BY name) AS code FROM (SELECT DISTINCT CASE WHEN n_nationkey = 3 THEN 'AMERICA' ELSE name END AS name FROM n) WHERE name NOT IN (SELECT r_name FROM region WHERE r_regionkey < 3))
      SELECT n_nationkey, CAST(coalesce(r_regionkey, code) AS INT) AS code FROM (SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'AMERICA' ELSE name END AS name FROM n) LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON r_name = name LEFT JOIN fresh USING (name)""",
    "w_dimension": """SELECT r_name AS name, CAST(r_regionkey AS INT) AS code FROM region WHERE r_regionkey < 3 UNION ALL SELECT name, CAST(2 + row_number() OVER (ORDER BY name) AS INT) FROM (SELECT r_name AS name FROM region WHERE r_regionkey >= 3 UNION ALL SELECT 'unknown')""",
    "w_taxonomy": f"WITH {TREE_SQL} SELECT code, CASE code WHEN 'N5' THEN lower(name) WHEN 'N3' THEN 'renamed' ELSE name END AS name, parent AS parent_code, level FROM tree",
    "w_hash_backfill": """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'known' ELSE sha256(lower(replace(p_name, ' ', '')) || chr(0) || chr(0) || CASE p_partkey % 4 WHEN 0 THEN 'choice' WHEN 1 THEN 'fill' WHEN 2 THEN 'essay' ELSE '' END || chr(0)) END AS content_hash FROM part""",
    "hash_neighbours": f"WITH {HASHED_SQL} SELECT a.doc_id AS id, min(b.doc_id) AS other_id FROM hashed a JOIN hashed b ON a.h = b.h AND a.lang = b.lang AND a.doc_id <> b.doc_id GROUP BY 1",
    "page_range": f"WITH {LINES_SQL} SELECT doc_id, count(*) AS n FROM lines WHERE (line_no - 1) // 5 + 1 BETWEEN 2 AND 3 GROUP BY 1",
    "ingestable": f"WITH {QUESTIONS_SQL} SELECT confidence >= 0.8 AND issue <> 0 AND trim(stem) <> '' AND answer IS NOT NULL AS ingestable, count(*) AS n FROM questions GROUP BY 1",
    "image_order": "SELECT l_orderkey * 10 + l_linenumber AS image_id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey % 9, l_quantity, l_orderkey * 10 + l_linenumber) - 1 AS image_order FROM lineitem",
    "question_images": "SELECT l_orderkey * 10 + l_linenumber AS image_id, row_number() OVER (ORDER BY l_orderkey % 9, l_quantity, l_orderkey * 10 + l_linenumber) - 1 AS image_order FROM lineitem WHERE l_partkey = 7",
    "content_updates": f"""WITH {HASHED_SQL}, q AS (SELECT doc_id AS id, text, h, 'a' || doc_id % 4 AS answer FROM hashed), u AS (SELECT q.id, n.text AS text, n.h AS h, CASE WHEN q.id % 2 = 0 THEN 'a1' ELSE q.answer END AS answer, q.text <> n.text AS changed FROM q JOIN q n ON n.id = q.id + 1 WHERE q.id % 3 = 0),
      o AS (SELECT u.id, u.changed, u.answer, (SELECT min(struct_pack(id := q.id, answer := q.answer)) FROM q WHERE q.h = u.h AND q.id <> u.id) AS a, (SELECT max(struct_pack(id := q.id, answer := q.answer)) FROM q WHERE q.h = u.h) AS z, (SELECT min(struct_pack(id := q.id, answer := q.answer)) FROM q WHERE q.h = u.h) AS f FROM u),
      p AS (SELECT id, changed, answer, CASE WHEN f.id <> id THEN f WHEN z.id <> id THEN z END AS other FROM o), r AS (SELECT id, CASE WHEN NOT changed THEN 'kept' WHEN other IS NULL THEN 'updated' WHEN other.answer <> answer THEN 'conflict' ELSE 'same' END AS outcome FROM p)
      SELECT q.id, coalesce(outcome, 'kept') AS outcome, CASE WHEN outcome = 'conflict' THEN 'reviewing' ELSE 'approved' END AS status FROM q LEFT JOIN r ON q.id = r.id""",
    "candidate_dedup": f"WITH {HASHED_SQL} SELECT a.doc_id AS id, coalesce((SELECT min(b.doc_id) FROM hashed b WHERE b.doc_id % 2 = 0 AND b.lang = a.lang AND b.h = a.h), min(a.doc_id) OVER (PARTITION BY a.lang, a.h)) AS candidate_id FROM hashed a WHERE a.doc_id % 2 = 1",
    "best_key_coverage": f"""WITH {OPTIONS_SQL}, p AS (SELECT a.id AS l, b.id AS r, len(list_intersect(a.k, b.k)) / len(a.k) AS c FROM o a JOIN o b ON a.page = b.page WHERE a.id % 2 = 0 AND b.id % 2 = 1)
      SELECT l AS left_id, arg_max(r, (c, -r)) AS right_id, round(max(c), 6) AS coverage FROM p WHERE c > 0 GROUP BY l""",
    "range_match": """WITH l AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 200 END AS a, c_custkey % 40 AS b FROM customer), one AS (SELECT id AS left_id, s_suppkey AS right_id, 1 AS tier FROM l JOIN supplier ON a = s_suppkey)
      SELECT * FROM one UNION ALL SELECT id, m, 2 FROM l JOIN (SELECT s_suppkey % 30 AS b, min(s_suppkey) AS m FROM supplier GROUP BY 1) USING (b) WHERE id NOT IN (SELECT left_id FROM one)""",
    "composites_first": "SELECT l_orderkey AS doc_id, l_linenumber AS pos, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 2, l_linenumber) AS place FROM lineitem",
    "sub_points": "SELECT p_partkey AS question_id, NULL AS sub, p_type AS point, true AS is_primary FROM part UNION ALL SELECT p_partkey, '1', p_brand, false FROM part WHERE p_size % 2 = 0",
    "anchor_summaries": f"WITH {ANCHORS_SQL} SELECT doc_id, string_agg(status || '=' || n, ',' ORDER BY status) AS summary FROM (SELECT doc_id, status, count(*) AS n FROM a GROUP BY 1, 2) GROUP BY 1",
    "provenance": f"WITH {ANCHORS_SQL} SELECT status, count(*) AS n FROM a GROUP BY 1",
    "health": f"""WITH {QUESTIONS_SQL} SELECT count(*) AS questions, count(answer) AS answered, count(*) FILTER (WHERE answer IS NULL) AS empty, count(*) FILTER (WHERE confidence >= 0.8) AS high,
      count(*) FILTER (WHERE confidence >= 0.5 AND confidence < 0.8) AS middle, count(*) FILTER (WHERE confidence < 0.5) AS low, count(*) FILTER (WHERE issue = 0) AS blocked FROM questions""",
    "run_stats": f"""WITH {QUESTIONS_SQL}, i AS (SELECT count(*) FILTER (WHERE l_linenumber <> 1) AS images, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS placements FROM lineitem)
      SELECT q.*, i.* FROM (SELECT count(*) AS questions, count(answer) AS answered, round(avg(CASE WHEN answer IS NULL THEN 1.0 ELSE 0.0 END), 4) AS empty_ratio, count(*) FILTER (WHERE issue < 2) AS with_issues, count(*) FILTER (WHERE issue < 2) AS issues,
      count(*) FILTER (WHERE issue = 0) AS blocked, count(*) FILTER (WHERE composite) AS composites, 2 * count(*) FILTER (WHERE composite) AS subs FROM questions) q, i""",
    "structure_stats": """WITH b AS (SELECT CASE WHEN o_orderkey % 8 = 0 THEN o_orderkey || x ELSE x END AS b FROM (SELECT o_orderkey, unnest([CAST(o_custkey % 50 AS VARCHAR), 'b']) AS x FROM orders WHERE o_orderkey % 4 = 0) UNION ALL SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 4 <> 0),
      c AS (SELECT b, count(*) AS n FROM b GROUP BY b) SELECT (SELECT count(*) FROM orders) AS top, (SELECT count(*) FROM orders WHERE o_orderkey % 4 = 0) AS composites, (SELECT count(*) FROM orders WHERE o_orderkey % 4 <> 0) AS independent, CAST(sum(n) AS BIGINT) AS bottom, count(*) FILTER (WHERE n > 1) AS repeated FROM c""",
    "structure_report": """SELECT CASE WHEN k = 1 THEN 'missing' WHEN k = 2 THEN 'unexpected' WHEN k = 5 AND o % 3 <> 0 THEN 'kind' WHEN k = 7 THEN 'subs' ELSE 'ok' END AS verdict, count(*) AS n FROM (SELECT o_orderkey AS o, o_orderkey % 10 AS k FROM orders) GROUP BY 1""",
    "composite_answers": f"WITH {QUESTIONS_SQL} SELECT answer IS NOT NULL AS has_summary, CASE WHEN composite THEN 1 ELSE 0 END AS n_answered, count(*) AS n FROM questions GROUP BY 1, 2",
    "figure_ids": """SELECT l_orderkey AS doc_id, l_linenumber AS page, CASE WHEN l_linenumber = 2 THEN 'FIG007' ELSE 'FIG' || lpad(CAST(t + row_number() OVER (PARTITION BY l_orderkey, l_linenumber = 2 ORDER BY l_linenumber, l_suppkey) AS VARCHAR), 3, '0') END AS figure_id
      FROM (SELECT l_orderkey, l_linenumber, l_suppkey, max(CASE WHEN l_linenumber = 2 THEN 7 ELSE 0 END) OVER (PARTITION BY l_orderkey) AS t FROM lineitem)""",
    "word_bank_runs": f"""WITH {LINES_SQL}, m AS (SELECT doc_id, line_no, length(text) < 60 AS b, CASE WHEN length(text) < 60 AND lag(length(text) < 60) OVER (PARTITION BY doc_id ORDER BY line_no) THEN 0 ELSE 1 END AS start FROM lines),
      r AS (SELECT *, CAST(sum(start) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS run FROM m) SELECT doc_id, run, count(*) AS n, min(line_no) AS pos, CAST(count(*) AS DOUBLE) AS score, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS ids FROM r WHERE b GROUP BY 1, 2 HAVING count(*) >= 2""",
    "sub_question_merge": """WITH one AS (SELECT l_orderkey, l_partkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity, min(l_discount) AS l_discount, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2, 3), r AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber // 3 AS INT) AS parent, l_partkey * 10 + l_linenumber AS pos, unnest([l_suppkey % 3, l_suppkey % 5]) AS x, generate_subscripts([1, 2], 1) AS i FROM one),
      f AS (SELECT doc_id, parent, x, min(pos * 10 + i) AS place FROM r GROUP BY 1, 2, 3), ids AS (SELECT doc_id, parent, string_agg(CAST(x AS VARCHAR), ',' ORDER BY place) AS ids FROM f GROUP BY 1, 2)
      SELECT g.*, ids FROM (SELECT l_orderkey AS doc_id, CAST(l_linenumber // 3 AS INT) AS parent, count(*) AS n, sum(l_quantity) AS score, min(l_discount) AS confidence, arg_min(l_returnflag, l_partkey * 10 + l_linenumber) FILTER (WHERE l_linenumber % 3 <> 0) AS answer FROM one GROUP BY 1, 2) g JOIN ids USING (doc_id, parent)""",
    "shared_material": """WITH RECURSIVE x AS (SELECT l_orderkey AS d, l_linenumber AS p, unnest([l_suppkey % 6, l_partkey % 6]) AS s FROM lineitem), e AS (SELECT DISTINCT a.d, a.p, b.p AS q FROM x a JOIN x b ON a.d = b.d AND a.s = b.s),
      reach AS (SELECT d, p, p AS q FROM e UNION SELECT r.d, r.p, e.q FROM reach r JOIN e ON r.d = e.d AND r.q = e.p) SELECT d AS doc_id, p AS pos, min(q) AS head FROM reach GROUP BY 1, 2""",
    "subject_candidates": """WITH t AS (SELECT o_orderpriority AS subject, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders), n AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN '1-URGENT' ELSE '5-LOW' END AS subject, count(*) AS n FROM customer GROUP BY 1)
      SELECT o_orderkey AS stored_id, n FROM t JOIN n USING (subject) WHERE rn <= 3""",
    "merged_duplicates": "SELECT CASE WHEN l_partkey % 2 = 0 THEN l_partkey - l_partkey % 3 ELSE l_partkey END AS question_id, count(*) AS n FROM lineitem GROUP BY 1",
    "related_nodes": "SELECT n_name AS source, CAST(n_regionkey AS VARCHAR) AS target, 'in' AS relation FROM nation WHERE n_name = 'FRANCE' UNION ALL SELECT CAST(n_regionkey AS VARCHAR), n_name, 'in' FROM nation WHERE n_regionkey = 1",
    "ocr_lines": f"""WITH {LINES_SQL}, b AS (SELECT doc_id, line_no, (line_no - 1) // 4 + 1 AS page, line_no % 5 = 0 AS t, text FROM lines), p AS (SELECT doc_id, line_no, page, t, 1 AS i, CASE WHEN t THEN text || chr(10) || 'more' || chr(10) || chr(10) ELSE text END AS text FROM b UNION ALL SELECT doc_id, line_no, page, t, 2, 'more' FROM b WHERE NOT t), k AS (SELECT * FROM p WHERE trim(text) <> '')
      SELECT doc_id, 'P' || page || 'L' || lpad(CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no, i) AS VARCHAR), 3, '0') AS line_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, i) AS "order", CASE WHEN t THEN 'table' ELSE 'text' END AS block_type, length(text) AS n FROM k""",
    "placed_images": """SELECT o_orderkey AS ref_id, min(l_orderkey) AS xref FROM orders JOIN lineitem ON o_orderkey % 200 = l_orderkey % 200 AND l_linenumber = 1 AND abs(o_custkey % 60 - l_suppkey % 60) < 5 AND abs(o_orderkey % 80 - l_partkey % 80) < 5 GROUP BY 1""",
    "text_blocks": """SELECT l_orderkey % 500 AS doc_id, l_linenumber AS page, count(*) AS n, CAST(min(l_suppkey * 9 % 900) AS DOUBLE) AS top FROM lineitem WHERE l_suppkey * 9 % 900 BETWEEN 15 AND 800 GROUP BY 1, 2""",
    "numbered_paragraphs": f"""WITH x AS (SELECT l_orderkey, l_linenumber = 3 AS bare, row_number() OVER (PARTITION BY l_orderkey, l_linenumber = 3 ORDER BY l_linenumber) AS n FROM lineitem)
      SELECT CASE WHEN bare THEN 't' WHEN l_orderkey % 2 = 0 THEN ({ROMAN_SQL}) || '. t' ELSE chr(CAST(96 + n AS INT)) || '. t' END AS text, count(*) AS n FROM x GROUP BY 1""",
    "tables_joined": f"""WITH {LINES_SQL}, x AS (SELECT doc_id, line_no, sum(CASE WHEN length(text) % 7 = 0 THEN 1 ELSE 0 END - CASE WHEN length(text) % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS depth FROM lines),
      y AS (SELECT doc_id, coalesce(lag(depth) OVER (PARTITION BY doc_id ORDER BY line_no), 0) > 0 AS inside FROM x) SELECT doc_id, count(*) FILTER (WHERE NOT inside) AS blocks FROM y GROUP BY 1""",
    "carry_on_page": f"""WITH {LINES_SQL} SELECT doc_id, line_no, coalesce(last_value(CASE WHEN length(text) < 50 THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id, (line_no - 1) // 6 ORDER BY line_no), ((line_no - 1) // 6 + 1) * 1000) AS carried FROM lines""",
    "retryable": "SELECT p_partkey AS id, p_partkey % 3 = 0 OR p_partkey % 2 > 0 AS again FROM part",
    "task_transitions": f"""WITH {EVENTS_SQL}, x AS (SELECT lag(kind) OVER (PARTITION BY key ORDER BY ts, event_id) AS before, kind FROM e)
      SELECT before, kind, CASE WHEN before IS NULL THEN kind = 'queued' WHEN before = 'queued' THEN kind IN ('running', 'failed') WHEN before = 'running' THEN kind IN ('succeeded', 'failed') WHEN before = 'failed' THEN kind = 'queued' ELSE false END AS allowed, count(*) AS n FROM x GROUP BY 1, 2, 3""",
    "breaker_states": f"""WITH {EVENTS_SQL}, g AS (SELECT *, sum(CASE WHEN kind = 'failed' THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY ts, event_id) AS g FROM e), o AS (SELECT key, ts, event_id, kind = 'failed' AND row_number() OVER (PARTITION BY key, g, kind = 'failed' ORDER BY ts, event_id) = 2 AS opens FROM g),
      l AS (SELECT key, ts, max(CASE WHEN opens THEN ts END) OVER (PARTITION BY key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM o) SELECT key, count(*) FILTER (WHERE ts < last + INTERVAL 1 DAY) AS n_open FROM l GROUP BY key""",
    "priority_queue": f"WITH {EVENTS_SQL}, s AS (SELECT key, arg_max(kind, (ts, event_id)) AS state, max(ts) AS since FROM e GROUP BY key) SELECT key, key % 3 AS priority FROM s WHERE state = 'queued' ORDER BY key % 3 DESC, since, key LIMIT 5",
    "selected_stages": "SELECT user_id AS key, event_type AS stage, max(event_id) AS attempt FROM events GROUP BY 1, 2",
    "set_diff_rows": "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 25",
    "hash_collisions_found": f"WITH {HASHED_SQL} SELECT h, count(DISTINCT t) AS texts FROM (SELECT h, text AS t FROM hashed UNION ALL SELECT h, ' ' || text || '.' FROM hashed) GROUP BY h HAVING count(DISTINCT t) > 1",
    "footers_dropped": f"WITH {LINES_SQL} SELECT doc_id, count(*) AS n FROM lines WHERE line_no % 9 <> 0 GROUP BY doc_id",
    "canonical_fill": f"""WITH {LINES_SQL} SELECT a.doc_id, CAST(sum(CASE WHEN a.line_no % 3 <> 0 AND trim(a.text) <> '' THEN length(a.text) WHEN trim(coalesce(b.text, '')) = '' THEN 0 ELSE length(trim(b.text)) END) AS BIGINT) AS n
      FROM lines a LEFT JOIN lines b ON b.doc_id = a.doc_id + 1 AND b.line_no = a.line_no GROUP BY a.doc_id""",
    "wrong_by_node": f"""WITH {ANSWERS_SQL}, w AS (SELECT question_id, count(*) AS c FROM answers WHERE NOT is_correct GROUP BY 1), m AS (SELECT DISTINCT question_id, node FROM answers) SELECT node, CAST(sum(c) AS BIGINT) AS wrong, count(DISTINCT question_id) AS questions FROM m JOIN w USING (question_id) GROUP BY 1""",
}
