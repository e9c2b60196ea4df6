"""Question-bank analytics over a star of DataFrames: search, catalog, statistics, gate metrics.

Null rules: a null difficulty is reported under the key "None"; a null type never joins and so is not counted;
a null year is dropped after aggregation. Every ordered result ends in a key that makes the order total, and
nulls sort last when ascending and first when descending.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

CONFIDENCE = T.DecimalType(4, 3)


@dataclass
class Star:
    """questions(id, subject, grade, qtype, difficulty, score, status, confidence, stem, created)
    instances(question_id, document_id, number, year, school); mappings(question_id, node)."""

    questions: DataFrame
    instances: DataFrame
    mappings: DataFrame


@dataclass
class Filters:
    """Search filters; None means no restriction. `wildcards` keeps % and _ of the term active."""

    subject: str | None = None
    grade: str | None = None
    qtype: str | None = None
    difficulty: int | None = None
    status: str | None = None
    confidence: float | None = None
    year: int | None = None
    school: int | None = None
    start_year: int | None = None
    end_year: int | None = None
    node: str | None = None
    term: str | None = None
    wildcards: bool = True


def contains(column: Column, term: str, wildcards: bool = True) -> Column:
    """Case-insensitive containment."""
    if wildcards:
        return column.ilike(f"%{term}%")
    return F.contains(F.lower(column), F.lit(term.lower()))


def year_range(column: Column, start: int | None, end: int | None) -> Column:
    """Inclusive range, open where a bound is None."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (column >= start)
    if end is not None:
        cond = cond & (column <= end)
    return cond


def base(star: Star, f: Filters) -> DataFrame:
    """The questions that pass all filters, each once. Filters on instances and mappings are semi-joins, so no
    fan-out arises; year and school must hold on one and the same instance."""
    q = star.questions
    for name in ("subject", "grade", "qtype", "difficulty", "status"):
        value = getattr(f, name)
        if value is not None:
            q = q.where(F.col(name) == value)
    if f.confidence is not None:
        q = q.where(F.col("confidence") == F.lit(f.confidence).cast(CONFIDENCE))
    if f.term is not None:
        q = q.where(contains(F.col("stem"), f.term, f.wildcards))
    wanted = [F.col(c) == v for c, v in (("year", f.year), ("school", f.school)) if v is not None]
    if f.start_year is not None or f.end_year is not None:
        wanted.append(year_range(F.col("year"), f.start_year, f.end_year))
    if wanted:
        rows = star.instances
        for cond in wanted:
            rows = rows.where(cond)
        q = q.join(rows.select(F.col("question_id").alias("id")), "id", "left_semi")
    if f.node is not None:
        rows = star.mappings.where(contains(F.col("node"), f.node, f.wildcards))
        q = q.join(rows.select(F.col("question_id").alias("id")), "id", "left_semi")
    return q


def base_by_distinct(star: Star, f: Filters) -> DataFrame:
    """The same rows by inner join and DISTINCT, for parity tests."""
    plain = Filters(**{k.name: getattr(f, k.name) for k in fields(f) if k.name not in ("year", "school")})
    q = base(star, plain)
    rows = star.instances.where((F.lit(f.year).isNull() | (F.col("year") == f.year)) & (F.lit(f.school).isNull() | (F.col("school") == f.school)))
    return q.join(rows.select(F.col("question_id").alias("id")), "id").distinct()


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """Page `number` (from 1) of `size` (1..100) rows."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page starts at 1 and size lies between 1 and 100")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def search(star: Star, f: Filters, number: int = 1, size: int = 20) -> DataFrame:
    """One page, newest first."""
    return page(base(star, f), [F.desc_nulls_first("created"), F.asc("id")], number, size)


def search_total(star: Star, f: Filters) -> DataFrame:
    return base(star, f).agg(F.countDistinct("id").alias("total"))


def catalog(star: Star) -> DataFrame:
    """Distinct questions by subject and grade, whatever their status."""
    return star.questions.groupBy("subject", "grade").agg(F.countDistinct("id").alias("n"))


def catalog_rollup(star: Star) -> DataFrame:
    """Subject totals over the grades (level 1) above the single cells (level 0)."""
    rows = star.questions.select("id", "subject", F.coalesce(F.col("grade").cast("string"), F.lit("None")).alias("grade"))
    rows = rows.rollup("subject", "grade").agg(F.countDistinct("id").alias("n"), F.grouping_id().alias("g"))
    return rows.where("g < 3").select("subject", "grade", "n", F.when(F.col("g") == 1, 1).otherwise(0).alias("level"))


def catalog_tree(star: Star) -> DataFrame:
    """Subjects with their total and an ordered array of grades."""
    cells = catalog(star)
    grades = F.sort_array(F.collect_list(F.struct(F.col("grade").isNull().alias("none"), "grade", "n")))
    return cells.groupBy("subject").agg(F.sum("n").alias("total"), F.transform(grades, lambda g: F.struct(g["grade"].alias("grade"), g["n"].alias("n"))).alias("grades"))


def total(star: Star, f: Filters) -> DataFrame:
    return base(star, f).agg(F.countDistinct("id").alias("total"))


def type_distribution(star: Star, f: Filters) -> DataFrame:
    return base(star, f).where("qtype is not null").groupBy("qtype").agg(F.countDistinct("id").alias("n"))


def difficulty_distribution(star: Star, f: Filters) -> DataFrame:
    key = F.coalesce(F.col("difficulty").cast("string"), F.lit("None"))
    return base(star, f).groupBy(key.alias("difficulty")).agg(F.countDistinct("id").alias("n"))


def node_top(star: Star, f: Filters, k: int = 50) -> DataFrame:
    """The k nodes with most distinct questions, ties by name."""
    ids = base(star, f).select(F.col("id").alias("question_id"))
    rows = star.mappings.join(ids, "question_id", "left_semi").groupBy("node").agg(F.countDistinct("question_id").alias("n"))
    return rows.orderBy(F.desc("n"), F.asc("node")).limit(k)


def year_trend(star: Star, f: Filters) -> DataFrame:
    """Distinct questions per year. start/end restrict these rows too; year and school only choose questions."""
    ids = base(star, f).select(F.col("id").alias("question_id"))
    rows = star.instances.where(year_range(F.col("year"), f.start_year, f.end_year)).join(ids, "question_id", "left_semi")
    return rows.groupBy("year").agg(F.countDistinct("question_id").alias("n")).where("year is not null")


def node_year_trend(star: Star, f: Filters) -> DataFrame:
    """Occurrences (instance times mapping) per node and year."""
    ids = base(star, f).select(F.col("id").alias("question_id"))
    rows = star.instances.where(year_range(F.col("year"), f.start_year, f.end_year)).join(ids, "question_id", "left_semi")
    # Instances of one question and year are counted before the mappings multiply them.
    counted = rows.groupBy("question_id", "year").agg(F.count(F.lit(1)).alias("c"))
    return star.mappings.join(counted, "question_id").groupBy("node", "year").agg(F.sum("c").alias("n")).where("year is not null")


def statistics(star: Star, f: Filters) -> dict[str, DataFrame]:
    """The six parts of the statistics bundle over one shared set of questions."""
    kept = base(star, f).persist()
    inner = Star(kept, star.instances, star.mappings)
    rest = Filters(start_year=f.start_year, end_year=f.end_year)
    return {
        "total": total(inner, Filters()),
        "by_type": type_distribution(inner, Filters()),
        "by_difficulty": difficulty_distribution(inner, Filters()),
        "nodes": node_top(inner, Filters()),
        "year_trend": year_trend(inner, rest),
        "node_year_trend": node_year_trend(inner, rest),
    }


def occurrence_count(star: Star) -> DataFrame:
    return star.instances.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))


def gate_metrics(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Six conditional counts in one pass over each table."""
    q = questions.agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.col("status") == "approved").alias("approved"), F.count_if(F.col("status") == "reviewing").alias("reviewing"))
    c = candidates.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("decision") == "review").alias("to_review"), F.count_if(F.col("decision") == "reject").alias("rejected"))
    return q.join(F.broadcast(c))  # one row each


def lookup_questions(star: Star, wanted: DataFrame) -> DataFrame:
    """(document_id, number) -> question."""
    return wanted.join(star.instances.select("document_id", "number", "question_id"), ["document_id", "number"])


def without_instances(star: Star) -> DataFrame:
    """Questions that no instance refers to."""
    return star.questions.join(star.instances.select(F.col("question_id").alias("id")), "id", "left_anti")


def with_dimension(df: DataFrame, dim: DataFrame, key: str, aliases: dict[str, str] | None = None, unknown: str | None = None) -> DataFrame:
    """Left join to a closed dimension (`key`, `code`) after alias folding; unmatched keys take `unknown`."""
    folded = F.col(key)
    for old, new in (aliases or {}).items():
        folded = F.when(F.col(key) == old, F.lit(new)).otherwise(folded)
    out = df.withColumn("_key", folded).join(dim.withColumnRenamed(key, "_key"), "_key", "left")
    return out.withColumn("code", F.coalesce("code", F.lit(unknown))).drop("_key") if unknown is not None else out.drop("_key")


def document_status(documents: DataFrame, tasks: DataFrame) -> DataFrame:
    """A document's status: its latest task's, else its own."""
    latest = tasks.groupBy("document_id").agg(F.max_by("status", F.struct("created", "task_id")).alias("task_status"))
    return documents.join(latest, "document_id", "left").withColumn("shown", F.coalesce("task_status", "status"))


def promote(candidates: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates become questions unless their hash is taken: (new questions, refused candidates)."""
    taken = questions.select("content_hash")
    return candidates.join(taken, "content_hash", "left_anti"), candidates.join(taken, "content_hash", "left_semi")


def ingestable(block: str) -> Column:
    """Whether a question may be stored: confidence from 0.8 on, no blocking issue, stem and answer not blank."""
    full = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    free = ~F.exists(F.coalesce("issues", F.array().cast("array<string>")), lambda i: F.contains(i, F.lit(block)))
    return (F.coalesce("confidence", F.lit(0.0)) >= 0.8) & free & full("stem") & full("answer")


def image_order(images: DataFrame) -> DataFrame:
    """`images` with image_order, their place inside a question from 0 on by page, top and id."""
    order = Window.partitionBy("question_id").orderBy("page", "top", "image_id")
    return images.withColumn("image_order", F.row_number().over(order) - 1)


def images_of(images: DataFrame, question_id: int) -> DataFrame:
    """A question's images in their order."""
    return images.where(F.col("question_id") == question_id).orderBy("image_order")


def with_created(df: DataFrame, dim: DataFrame, key: str, aliases: dict[str, str] | None = None, closed: list[str] | None = None, unknown: str = "未知") -> tuple[DataFrame, DataFrame]:
    """get-or-create: (`df` with code, the dimension with what it lacked). Aliases are folded; with a `closed` domain
    anything else becomes `unknown`; new names get codes counted on from the highest."""
    folded = F.trim(F.coalesce(F.col(key), F.lit("")))
    for old, new in (aliases or {}).items():
        folded = F.when(folded == old, F.lit(new)).otherwise(folded)
    folded = F.when(folded == "", unknown).otherwise(folded)
    folded = F.when(folded.isin(*closed), folded).otherwise(unknown) if closed is not None else folded
    rows = df.withColumn("_key", folded)
    lacking = rows.select(F.col("_key").alias(key)).distinct().join(dim.select(key), key, "left_anti")
    top = dim.agg(F.coalesce(F.max("code"), F.lit(0)).alias("_top"))
    fresh = lacking.join(F.broadcast(top)).select(key, (F.col("_top") + F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(key))).cast(dim.schema["code"].dataType).alias("code"))  # names of a dimension
    grown = dim.select(key, "code").unionByName(fresh)
    return rows.join(grown.withColumnRenamed(key, "_key"), "_key", "left").drop("_key"), grown
