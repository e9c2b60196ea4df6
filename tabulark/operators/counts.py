"""Distinct counts that add up: sketches per group as a stored table, beside the exact way (`count_distinct`).

A sketch has 2**LG_K registers, whatever it counts, and is off by RELATIVE_ERROR (one standard error) in the mean. Sketches of new
rows are merged with stored ones, and of finer groups into coarser ones, without the rows being read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 12
RELATIVE_ERROR = 1.04 / 2 ** (LG_K / 2)


def sketched(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, sketch of the distinct values. Nulls do not count."""
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(value, LG_K).alias("sketch"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """One sketch per group of any subset of the keys that the sketches have."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimated(sketches: DataFrame) -> DataFrame:
    return sketches.withColumn("estimate", F.hll_sketch_estimate("sketch")).drop("sketch")
