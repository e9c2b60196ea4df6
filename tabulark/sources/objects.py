"""An object store in a folder: contents under their SHA-256, put and fetched by tasks.

A name says what is in it, so putting a content twice, by a retried or speculative task or by two jobs at once, leaves one
object, and whoever reads can check it. Objects lie in 256 folders by the first byte of their name, so that a listing and a scan
can be cut to some of them. Listing never opens contents: `content` is pruned from Spark's binaryFile scan. That scan passes over
files without bytes, so the empty object can be put and fetched but is in no listing.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulark.sources.docx import located

PUT = pa.schema([("name", pa.string()), ("length", pa.int64()), ("fresh", pa.bool_())])
GOT = pa.schema([("name", pa.string()), ("content", pa.binary()), ("error", pa.string())])


def place(root: str, name: str) -> str:
    return f"{root}/{name[:2]}/{name}"


def _put(system: fs.FileSystem, root: str, content: bytes) -> tuple[str, int, bool]:
    name = hashlib.sha256(content).hexdigest()
    target = place(root, name)
    there = system.get_file_info(target)
    if there.is_file and there.size == len(content):
        return name, len(content), False
    folder = target.rpartition("/")[0]
    system.create_dir(folder, recursive=True)
    half = f"{folder}/_{uuid.uuid4().hex}"  # hidden from scans until it is whole
    with system.open_output_stream(half) as sink:
        sink.write(content)
    system.move(half, target)
    return name, len(content), True


def put(rows: DataFrame, content: str, folder: str) -> DataFrame:
    """Put the contents of a binary or string column (nulls are passed over). The other columns with name, length and fresh (whether the
    object was not there yet), from an index that is written beside the objects once all are there."""
    spark, others = rows.sparkSession, [c for c in rows.columns if c != content]

    def run(batches):
        system, root = located(folder)
        for batch in batches:
            found = [_put(system, root, c) for c in batch.column(0).to_pylist()]
            columns = [pa.array(c, f.type) for c, f in zip(zip(*found), PUT)] if found else [pa.array([], f.type) for f in PUT]
            yield pa.RecordBatch.from_arrays([batch.column(1), *columns], schema=pa.schema([batch.schema.field(1), *PUT]))

    packed = rows.where(F.col(content).isNotNull()).select(F.col(content).cast("binary").alias("_content"), F.struct(*others, F.lit(0).alias("_none")).alias("_row"))
    schema = packed.select("_row").schema.add("name", "string").add("length", "long").add("fresh", "boolean")
    index = f"{folder}/_index-{uuid.uuid4().hex}"
    packed.mapInArrow(run, schema).write.parquet(index)
    return spark.read.schema(schema).parquet(index).select(*[F.col("_row")[c].alias(c) for c in others], "name", "length", "fresh")


def _named(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def listed(spark: SparkSession, folder: str, prefix: str = "[0-9a-f][0-9a-f]") -> DataFrame:
    """name, length, modified of the objects; `prefix` is a pattern for the first two digits of names."""
    found = spark.read.format("binaryFile").load(f"{folder}/{prefix}")
    return found.select(_named(F.col("path")).alias("name"), "length", F.col("modificationTime").alias("modified"))


def scanned(spark: SparkSession, folder: str, prefix: str = "[0-9a-f][0-9a-f]") -> DataFrame:
    """name and content of all objects with such names, in partitions of files packed by size."""
    return spark.read.format("binaryFile").load(f"{folder}/{prefix}").select(_named(F.col("path")).alias("name"), "content")


def fetched(names: DataFrame, folder: str) -> DataFrame:
    """name, content, error for each row of `names`: each task opens the objects of its rows alone. An object that is missing or does not
    match its name has an error instead of its content."""

    def run(batches):
        system, root = located(folder)

        def get(name):
            try:
                with system.open_input_stream(place(root, name or "")) as source:
                    content = source.read()
            except OSError as e:
                return name, None, type(e).__name__
            return (name, content, None) if hashlib.sha256(content).hexdigest() == name else (name, None, "content does not match its name")

        for batch in batches:
            for name in batch.column(0).to_pylist():  # one object in memory at a time
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(get(name), GOT)], schema=GOT)

    return names.select("name").mapInArrow(run, "name string, content binary, error string")
