"""Write operators on immutable tables: each gives the table that should be there afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def delete(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(keys.select(*on).distinct(), on, "left_anti")


def update_from(rows: DataFrame, source: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Null columns of `rows` filled from `source` by key."""
    s = source.select(*on, *[F.col(c).alias(f"_s_{c}") for c in columns])
    out = rows.join(s, on, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(c, f"_s_{c}"))
    return out.drop(*[f"_s_{c}" for c in columns])


def update_where(rows: DataFrame, keys: DataFrame, on: list[str], values: dict[str, Column]) -> DataFrame:
    """`rows` with `values` set where the key is among `keys`."""
    hit = rows.join(keys.select(*on).distinct().withColumn("_hit", F.lit(True)), on, "left")
    return hit.select(*[F.when(F.col("_hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns])


def upsert(rows: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    return delete(rows, new, on).unionByName(new)


def good_and_quarantine(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all checks, and the others with the names of those they fail; one bad row fails alone."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())
    marked = rows.withColumn("_errors", failed)
    return marked.where(F.size("_errors") == 0).drop("_errors"), marked.where(F.size("_errors") > 0)


def rerun_cleanup(questions: DataFrame, instances: DataFrame, document_id: int) -> tuple[DataFrame, DataFrame]:
    """Before a document is processed again: its unreviewed instances go, questions left without any go too, and
    the occurrence counts of the others are taken anew."""
    unreviewed = questions.where("status <> 'approved'").select(F.col("id").alias("question_id"))
    gone = instances.where(F.col("document_id") == document_id).join(unreviewed, "question_id", "left_semi")
    left = delete(instances, gone, ["instance_id"])
    counts = left.groupBy("question_id").agg(F.count(F.lit(1)).alias("occurrences"))
    orphans = delete(gone.select("question_id").distinct(), counts, ["question_id"])
    kept = delete(questions, orphans.withColumnRenamed("question_id", "id"), ["id"])
    return kept.join(counts.withColumnRenamed("question_id", "id"), "id", "left").na.fill(0, ["occurrences"]), left


def move(rows: DataFrame, where: Column, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Rows that leave a table (one per key, the first by `order`) and the rows that stay."""
    leaving = rows.where(where)
    first = leaving.groupBy(key).agg(F.min(order).alias(order))
    return leaving.join(first, [key, order], "left_semi"), rows.where(~F.coalesce(where, F.lit(False)))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def replace_parts(rows: DataFrame, folder: str, by: list[str]) -> None:
    """Write `rows` into a table partitioned by `by`: the partitions that `rows` has are replaced whole, the files of all others stay as they
    are. Spark moves new files in when the job commits, so a task that runs again and a whole rerun leave the same table."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(folder)
