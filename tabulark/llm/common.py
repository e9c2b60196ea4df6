"""Helpers that the corpus operators share: tables, shared storage, words, hashing."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulark.session import BATCH_BYTES, BATCH_SETTING, bound_batches, shared_folder  # noqa: F401

#: The characters that separate words, and that lines are stripped of: [\x20\x09-\x0D].
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables written in the shared folder to cut lineage: a lost executor then costs a re-read, not a rerun."""

    def __init__(self, spark: SparkSession):
        bound_batches(spark)
        self.spark, self.root, self.paths, self.n = spark, f"{shared_folder(spark)}/tabulark-{uuid.uuid4().hex}", {}, 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{name}-{self.n}"
        schema = df.schema
        df.write.parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete the tables written under these names, or under names that begin with one that ends in `*`. Only for
        tables that nothing still to be run reads."""
        for name in [n for n in self.paths if any(n == m or (m.endswith("*") and n.startswith(m[:-1])) for m in names)]:
            for path in self.paths.pop(name):
                _delete(self.spark, path)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def text_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of a string array, A-Z lower-cased if asked for: a code per word, the distinct words,
    and where each text's words begin, with their total at the end. Null texts have no words."""
    texts = pc.fill_null(texts, "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = split.flatten().dictionary_encode()
    codes, at = coded.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64)
    at -= at[0]
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()  # beside leading and trailing space
    if empty >= 0:
        real = codes != empty
        at = np.concatenate([[0], np.cumsum(real)])[at]
        codes = codes[real]
    return codes, coded.dictionary, at


def string_hashes(words: pa.Array) -> np.ndarray:
    """64-bit multilinear hashes of strings: a fixed multiplier for each place of a byte, then a finalizer."""
    if not len(words):
        return np.zeros(0, np.uint64)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    sizes, begins = np.diff(ends), ends[:-1] - ends[0]
    place = (np.arange(len(data)) - np.repeat(begins, sizes)).astype(np.uint64)
    sums = np.zeros(len(words), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        terms = (data.astype(np.uint64) + np.uint64(1)) * (mix((place + np.uint64(1)) * _M1) | np.uint64(1))
        sums[full] = np.add.reduceat(terms, begins[full])
    return mix(sums + _M1)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash per lower-cased word of a string array, and where each text's words begin (one more at the end)."""
    codes, words, at = text_words(texts)
    return string_hashes(words)[codes], at


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library keeps its own counsel
    _trim = None


def release_memory() -> None:
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def tidy(run):
    """A mapInArrow function that gives freed memory back to the system when its partition ends: Python workers live
    on, and what one stage has freed would otherwise stay with them while others need it."""

    @functools.wraps(run)
    def inner(batches):
        yield from run(batches)
        release_memory()

    return inner


_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of `size` words; with fewer words, of the whole sequence."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    acc = np.full(n, size, np.uint64)
    for k in range(size):
        acc = mix(acc * _M1 + hashes[k : k + n])
    return np.unique(acc)


def arrow_rows(fn, schema: pa.Schema):
    """Wrap a generator of row tuples from a list of column lists into a mapInArrow function that emits
    record batches of bounded size: `fn(columns: list[list]) -> Iterator[tuple]`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, weight = [], 0
            for row in fn([c.to_pylist() for c in batch.columns]):
                out.append(row)
                weight += 64 + sum(len(v) for v in row if isinstance(v, (bytes, str)))
                if len(out) >= 20_000 or weight > 8_000_000:
                    yield _batch(out, schema)
                    out, weight = [], 0
            if out:
                yield _batch(out, schema)

    return tidy(run)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def sub_batches(batch: pa.RecordBatch, most_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of about `most_bytes`, so that memory follows the longest text and not the row count."""
    if not batch.num_rows:
        return
    per_row = max(1, batch.nbytes // batch.num_rows)
    step = max(1, most_bytes // per_row)
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def range_bounds(df: DataFrame, key: str, parts: int = 256) -> list[int]:
    """`parts`+1 cut points of a long column by approximate percentiles; empty for an empty table.
    The driver gets `parts`+1 numbers, whatever the input."""
    row = df.agg(
        F.percentile_approx(key, [i / parts for i in range(parts + 1)], 10_000).alias("p"),
        F.min(key).alias("lo"),
        F.max(key).alias("hi"),
    ).first()
    if row.lo is None:
        return []
    return sorted({row.lo, *row.p, row.hi})


def range_bucket(key: Column, bounds: list[int], per_segment: int) -> Column:
    """A bucket number that never falls as `key` grows: the percentile segment, then equal steps inside it.
    Buckets stay even for clustered keys, and their number can follow the input while the bounds do not."""
    if len(bounds) < 2:
        return F.lit(0).cast("long")
    los, his = F.array(*[F.lit(int(b)) for b in bounds[:-1]]), F.array(*[F.lit(int(b)) for b in bounds[1:]])
    seg = F.greatest(F.size(F.filter(los, lambda b: b <= key)), F.lit(1))
    lo, hi = F.element_at(los, seg).cast("double"), F.element_at(his, seg).cast("double")
    inside = F.floor((key.cast("double") - lo) / F.greatest(hi - lo, F.lit(1.0)) * per_segment)
    return (seg - 1).cast("long") * per_segment + F.greatest(F.lit(0), F.least(inside, F.lit(per_segment - 1)))
