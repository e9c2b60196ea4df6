"""Ordered-line operators. Each partitions by document and orders by line, so documents run side by side and one
exchange on the document key serves a chain of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def in_order(*keys: str, order: str = "line_no"):
    return Window.partitionBy(*keys).orderBy(order)


def so_far(*keys: str, order: str = "line_no"):
    return in_order(*keys, order=order).rowsBetween(Window.unboundedPreceding, 0)


def renumber(lines: DataFrame, prefix: str = "P", page: str = "page_no") -> DataFrame:
    """Numbers per page and per document, and ids such as P3L007."""
    out = lines.withColumn("line_no_in_page", F.row_number().over(in_order("doc_id", page)))
    out = out.withColumn("order", F.row_number().over(Window.partitionBy("doc_id").orderBy(page, "line_no")))
    return out.withColumn("line_id", F.format_string("%s%dL%03d", F.lit(prefix), F.col(page), F.col("line_no_in_page")))


def carry_forward(lines: DataFrame, value: Column, name: str, default: Column | None = None) -> DataFrame:
    """The last non-null value up to each line; `default` before the first."""
    carried = F.last(value, ignorenulls=True).over(so_far("doc_id"))
    return lines.withColumn(name, F.coalesce(carried, default) if default is not None else carried)


def latch(lines: DataFrame, on: Column, off: Column | None = None, name: str = "inside") -> DataFrame:
    """True from a line where `on` holds until a line where `off` holds; the later event wins."""
    event = F.when(on, True)
    if off is not None:
        event = event.when(off, False)
    return lines.withColumn(name, F.coalesce(F.last(event, ignorenulls=True).over(so_far("doc_id")), F.lit(False)))


def segments(lines: DataFrame, header: Column, name: str = "segment") -> DataFrame:
    """Blocks numbered from 1; a header opens a block, lines before the first header are in block 0."""
    return lines.withColumn(name, F.sum(F.when(header, 1).otherwise(0)).over(so_far("doc_id")))


def blocks(lines: DataFrame, header: Column) -> DataFrame:
    """doc_id, segment, n_lines, text of each block."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    out = segments(lines, header).where("segment > 0").groupBy("doc_id", "segment").agg(F.count(F.lit(1)).alias("n_lines"), ordered.alias("rows"))
    return out.select("doc_id", "segment", "n_lines", F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("text"))


def islands(lines: DataFrame, key: Column, name: str = "island") -> DataFrame:
    """Runs of neighbouring lines with an equal key, numbered from 1."""
    changed = F.coalesce((F.lag(key).over(in_order("doc_id")).eqNullSafe(key) & (F.row_number().over(in_order("doc_id")) > 1)), F.lit(False))
    return lines.withColumn("_new", F.when(changed, 0).otherwise(1)).withColumn(name, F.sum("_new").over(so_far("doc_id"))).drop("_new")


def next_boundary(lines: DataFrame, is_boundary: Column, name: str = "next_at") -> DataFrame:
    """The number of the next boundary line after each line, null without one."""
    after = in_order("doc_id").rowsBetween(1, Window.unboundedFollowing)
    return lines.withColumn(name, F.min(F.when(is_boundary, F.col("line_no"))).over(after))


def adjacent_pair(lines: DataFrame, name: str = "pair") -> DataFrame:
    """Each line's text with the next one's, for marks that a line break divides."""
    return lines.withColumn(name, F.concat("text", F.coalesce(F.lead("text").over(in_order("doc_id")), F.lit(""))))


def previous_within(lines: DataFrame, value: Column, reach: int = 3, name: str = "before") -> DataFrame:
    """The nearest non-null value among the `reach` lines before."""
    return lines.withColumn(name, F.last(value, ignorenulls=True).over(in_order("doc_id").rowsBetween(-reach, -1)))


def header_pairs(lines: DataFrame, is_header: Column) -> DataFrame:
    """Lines right after a header line, with that header's text."""
    out = lines.withColumn("_h", is_header)
    out = out.withColumn("header", F.when(F.lag("_h").over(in_order("doc_id")), F.lag("text").over(in_order("doc_id"))))
    return out.where("header is not null and not _h").drop("_h")


def section_start(lines: DataFrame, matches: Column, none: int = 2**31 - 1) -> DataFrame:
    """First matching line of each document, `none` without one."""
    return lines.groupBy("doc_id").agg(F.coalesce(F.min(F.when(matches, F.col("line_no"))), F.lit(none)).alias("start"))


def slice_lines(refs: DataFrame, lines: DataFrame) -> DataFrame:
    """Texts of referenced line ids, in the order of reference, joined by newlines; unknown ids are skipped.
    `refs` has ref_id, doc_id and line_nos."""
    wanted = refs.select("ref_id", "doc_id", F.posexplode("line_nos").alias("pos", "line_no"))
    rows = wanted.join(lines.select("doc_id", "line_no", "text"), ["doc_id", "line_no"])
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return rows.groupBy("ref_id").agg(F.array_join(F.transform(ordered, lambda r: r["text"]), "\n").alias("text"), F.count(F.lit(1)).alias("n_lines"))


def valid_refs(ids: Column, known: Column) -> Column:
    """The ids that exist, order and repetitions kept."""
    return F.filter(ids, lambda x: F.array_contains(known, x))


def best_start(candidates: DataFrame) -> DataFrame:
    """The line of highest priority for each (doc_id, number), the earliest on ties."""
    return candidates.groupBy("doc_id", "number").agg(F.max_by("line_no", F.struct("priority", -F.col("line_no"))).alias("line_no"))


def section_spans(lines: DataFrame, section: str = "section") -> DataFrame:
    """First and last line of each section, and the start of the next one."""
    spans = lines.groupBy("doc_id", section).agg(F.min("line_no").alias("low"), F.max("line_no").alias("high"))
    return spans.withColumn("until", F.lead("low").over(in_order("doc_id", order="low")))


def joined_tables(lines: DataFrame, opens: Column, closes: Column) -> DataFrame:
    """Lines of one multi-line table come together: block is the line where the table opened."""
    depth = F.sum(F.when(opens, 1).otherwise(0) - F.when(closes, 1).otherwise(0)).over(so_far("doc_id"))
    out = lines.withColumn("_after", depth).withColumn("_open", opens)
    inside = F.coalesce(F.lag("_after").over(in_order("doc_id")), F.lit(0)) > 0
    out = out.withColumn("_new", F.when(inside, 0).otherwise(1)).withColumn("block", F.sum("_new").over(so_far("doc_id")))
    return out.drop("_after", "_open", "_new")


def best_pass(runs: DataFrame) -> DataFrame:
    """Of several passes over a document the one with most ingested, then fewest blocked, empty and missing;
    the earlier on ties."""
    rank = F.struct(F.col("ingested"), -F.col("blocked"), -F.col("empty"), -F.col("missing"), -F.col("pass"))
    return runs.groupBy("doc_id").agg(F.max_by("pass", rank).alias("pass"))


def carry_on_page(lines: DataFrame, value: Column, name: str = "carried") -> DataFrame:
    """The last non-null value on the line's page; before the first one the page's virtual bucket, 1000 times its
    number. Nothing is carried from page to page."""
    carried = F.last(value, ignorenulls=True).over(so_far("doc_id", "page_no"))
    return lines.withColumn(name, F.coalesce(carried, F.col("page_no") * 1000))
