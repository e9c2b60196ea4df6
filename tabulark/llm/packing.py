"""Packing along a space-filling curve.

A document's tokens are hashed to random directions; their mean is a point in three dimensions, and the Hilbert
key of that point orders the corpus so that neighbours on the curve are alike. The ordered token streams are laid
end to end and cut every `length` tokens, so that only the very last sequence is padded, and neighbouring
documents share sequences.

Nothing is sorted in one place: documents fall into ranges of the curve key (percentile bounds), each range's
token total gives its first position, and a window inside the range places its documents. Low bits of the key
come from a hash of the document, so any number of equal texts spreads over many ranges.

Defined cases: null text counts as empty and is its end token alone; equal rows are placed side by side, each
once; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulark.llm.common import Scratch, _batch, range_bounds, range_bucket, sub_batches, text_words, tidy

END_ID = 1
DIMS, BITS, TIE_BITS = 3, 10, 22
#: The vocabulary file's own rules, by which words can be taken apart outside the library.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": PIECE}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}
#: A character for which lower-casing alone may not be the normalizer's answer, or the opening of a special token.
UNUSUAL = r"[^\x20-\x7e¡-įı-ňŊ-ž]|<\|"


class WordTokenizer:
    """Ids as the tokenizers library gives them. For a file with the rules above: the pre-tokenizer's pieces never reach
    over white space and a piece's ids do not depend on its neighbours, so each distinct word of some parts of texts is
    taken apart once, each distinct piece is looked up once, and new pieces go to the library's model, many to a call; a
    piece's last token is the only one whose name has the word-end suffix. Words with UNUSUAL characters go to the library
    whole. For files with other rules all texts do. Where more than `most` pieces are remembered, those that the words at
    hand do not have are forgotten."""

    SUFFIX = "</w>"

    def __init__(self, path: str, most: int = 120_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.library, self.most = Tokenizer.from_file(path), most
        self.library.no_truncation()
        self.library.no_padding()
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        model, size = self.library.model, self.library.get_vocab_size()
        rules = lambda part: part and json.loads(part.__getstate__())
        own = isinstance(model, models.BPE) and model.end_of_word_suffix == self.SUFFIX and not model.dropout and not model.ignore_merges
        every_byte = own and all(model.token_to_id(b + end) is not None for b in pre_tokenizers.ByteLevel.alphabet() for end in ("", self.SUFFIX))
        self.by_words = every_byte and rules(self.library.normalizer) == NORMALIZER and rules(self.library.pre_tokenizer) == PRE_TOKENIZER
        if self.by_words:
            self.ends = np.array([(self.library.id_to_token(i) or "").endswith(self.SUFFIX) for i in range(size)])
            self.parts, self.ascii_parts = Tokenizer(model), Tokenizer(model)  # the same model, without the normalizer
            self.parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ascii_parts.pre_tokenizer = pre_tokenizers.WhitespaceSplit()  # a printable ASCII byte is its own letter
            # Pieces have numbers: piece k has the ids of the k-th run of the pool. Number 0 is the empty piece.
            self.numbers, self.pool, self.sizes = {"": 0}, np.zeros(0, self.dtype), np.zeros(1, np.int64)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.frombuffer(b"".join(found), self.dtype), np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize

    def _learn(self, pieces: list[str], group: int = 1000) -> None:
        plain, rest = [p for p in pieces if p.isascii()], [p for p in pieces if not p.isascii()]
        found = [self.pool[:0]]
        for parts, some in ((self.ascii_parts, plain), (self.parts, rest)):
            for at in range(0, len(some), group):
                text = " ".join(some[at : at + group])
                found.append(np.array(parts.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype))
        ids = np.concatenate(found)
        sizes = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        self.numbers.update(zip(plain + rest, range(len(self.sizes), len(self.sizes) + len(sizes)), strict=True))
        self.pool, self.sizes = np.concatenate([self.pool, ids]), np.concatenate([self.sizes, sizes])

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """The numbers of distinct pieces; they hold until the next call."""
        if len(self.numbers) > self.most:
            kept = ["", *(p for p in pieces if p and p in self.numbers)]
            self.pool, self.sizes = gathered(self.pool, self.sizes, np.fromiter(map(self.numbers.__getitem__, kept), np.int64, len(kept)))
            self.numbers = dict(zip(kept, range(len(kept))))
        self._learn([p for p in pieces if p not in self.numbers])
        return np.fromiter(map(self.numbers.__getitem__, pieces), np.int64, len(pieces))

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each has."""
        odd = pc.match_substring_regex(words, UNUSUAL)
        lower = pc.utf8_lower(words.filter(pc.invert(odd)))
        mixed = pc.invert(pc.utf8_is_alpha(lower))
        parted = pc.replace_with_mask(lower, mixed, pc.replace_substring_regex(lower.filter(mixed), PIECE, r"\0 "))
        codes, pieces, at = text_words(parted, lower=False)
        numbers = self._numbers(strings(pieces))
        plain, plain_sizes = gathered(self.pool, self.sizes, numbers[codes])
        plain_sizes = np.diff(np.concatenate([[0], np.cumsum(plain_sizes)])[at])
        odd = odd.to_numpy(zero_copy_only=False)
        if not odd.any():
            return plain, plain_sizes
        rest, rest_sizes = self._whole(strings(words.filter(pa.array(odd))))
        order = np.empty(len(words), np.int64)  # word -> its place in plain, then rest
        order[~odd], order[odd] = np.arange(len(plain_sizes)), len(plain_sizes) + np.arange(len(rest_sizes))
        return gathered(np.concatenate([plain, rest]), np.concatenate([plain_sizes, rest_sizes]), order)

    def ids_of_parts(self, parts: list[pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each part, an array of texts: the ids of its texts, one after another, without end tokens, and how many
        each has. The words of all parts are taken apart together."""
        if not self.by_words:
            yield from (self._whole(strings(pc.fill_null(texts, ""))) for texts in parts)
            return
        split = [text_words(texts, lower=False) for texts in parts]
        words = pa.concat_arrays([words for _, words, _ in split]).dictionary_encode()
        (pool, sizes), place, first = self._words(words.dictionary), words.indices.to_numpy(), 0
        for codes, own, at in split:
            out, n = gathered(pool, sizes, place[first : first + len(own)][codes])
            first += len(own)
            yield out, np.diff(np.concatenate([[0], np.cumsum(n)])[at])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, without end tokens, and how many each has."""
        return next(self.ids_of_parts([texts]))


def strings(texts: pa.Array) -> list[str]:
    """As `to_pylist`, several times as fast."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def gathered(pool: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`pool` holds runs of the given sizes; the runs numbered by `codes`, one after another, and their sizes."""
    begins = np.cumsum(sizes) - sizes
    n = sizes[codes]
    ends = np.cumsum(n)
    return pool[np.repeat(begins[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], n


_WORKER: dict[str, WordTokenizer] = {}


def worker_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this Python worker with what it remembers; a worker serves many tasks."""
    if path not in _WORKER:
        _WORKER.clear()
        _WORKER[path] = WordTokenizer(path)
    return _WORKER[path]


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys of integer points (n, dims) by Gray-code transposition, for all points at once."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(set_, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def directions(seed: int = 11) -> np.ndarray:
    """A direction for each token id, from a fixed seed."""
    return np.random.default_rng(seed).normal(size=(1 << 16, DIMS)).astype(np.float32)


def curve_keys(ids: np.ndarray, sizes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents whose ids, one at least, lie one after another."""
    mean = np.add.reduceat(table[ids & (len(table) - 1)], np.cumsum(sizes) - sizes) / sizes[:, None]
    unit = 0.5 * (1 + np.tanh(mean / 0.35))
    return hilbert(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


TOKEN_DDL = "doc_id long, n long, key long, crc long, ids binary"
TOKENS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("crc", pa.int64()), ("ids", pa.binary())])
PIECE_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PIECES = pa.schema([(c.split()[0], pa.int64()) for c in PIECE_DDL.split(", ")])


def part_lists(batches: Iterator[pa.RecordBatch], list_bytes: int, part_bytes: int = 1_000_000) -> Iterator[list[pa.RecordBatch]]:
    """All rows in lists of small parts, each list with about `list_bytes`: what its parts share is done once for all."""
    parts, weight = [], 0
    for batch in batches:
        for part in sub_batches(batch, part_bytes):
            parts.append(part)
            weight += part.nbytes
            if weight >= list_bytes:
                yield parts
                parts, weight = [], 0
    if parts:
        yield parts


#: Bytes of texts whose words are taken apart together, and pieces remembered at most: more of both costs a Python worker
#: memory and saves it work (they hold about 260 MB in all, and 360 to 420 MB).
LEAN, ROOMY = (4_000_000, 120_000), (24_000_000, 400_000)


def tokens_of(path: str, room: tuple[int, int] = LEAN):
    """A mapInArrow function from doc_id and text to TOKENS."""
    list_bytes, most = room

    def run(batches):
        tokenizer, table = worker_tokenizer(path), directions()
        tokenizer.most = most
        for parts in part_lists(batches, list_bytes):
            for part, (bare, n) in zip(parts, tokenizer.ids_of_parts([p.column(1) for p in parts]), strict=True):
                ends = np.cumsum(n + 1)
                ids = np.full(ends[-1], END_ID, bare.dtype)
                here = np.ones(len(ids), bool)
                here[ends - 1] = False
                ids[here] = bare
                keys, bytes_at = curve_keys(ids, n + 1, table), ids.itemsize * np.append(0, ends)
                data = memoryview(ids.tobytes())
                crcs = [zlib.crc32(data[i:j]) for i, j in zip(bytes_at, bytes_at[1:])]
                ties = [xxhash.xxh3_64_intdigest(f"{d}|{c}".encode()) >> (64 - TIE_BITS) for d, c in zip(part.column(0).to_pylist(), crcs)]
                raw = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(bytes_at.astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n + 1), pa.array((keys << TIE_BITS) | np.array(ties, np.int64)), pa.array(crcs, pa.int64()), raw], schema=TOKENS)

    return run


def tokenized(docs: DataFrame, path: str, room: tuple[int, int] = LEAN) -> DataFrame:
    """doc_id, n, key, crc, ids: the tokens of each document with its end token, and its place on the curve."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(tidy(tokens_of(path, room)), TOKEN_DDL)


def cut(length: int):
    """A mapInArrow function from placed documents to pieces."""

    def pieces(doc_id, ids, n, at):
        data = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4")
        start = 0
        while start < len(data):
            take = min(len(data) - start, length - (at + start) % length)
            crc = zlib.crc32(data[start : start + take].tobytes())
            yield doc_id, start, take, crc, len(data), (at + start) // length, (at + start) % length
            start += take

    def run(batches):
        for whole in batches:
            for part in sub_batches(whole):
                out = [p for row in zip(*(c.to_pylist() for c in part.columns)) for p in pieces(*row)]
                for at in range(0, len(out), 50_000):
                    yield _batch(out[at : at + 50_000], PIECES)

    return run


def running_starts(totals: DataFrame, bucket: str, segment: str, amount: str) -> DataFrame:
    """`bucket` and `_first`, the sum of `amount` over all earlier buckets: inside segments by a window, and over
    the segments, of which there are 256 at most, by another."""
    inside = Window.partitionBy(segment).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = totals.groupBy(segment).agg(F.sum(amount).alias("_all"))
    before = Window.partitionBy(F.lit(1)).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(segment, F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_before"))
    placed = totals.withColumn("_in", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return placed.join(F.broadcast(whole), segment).select(bucket, (F.col("_before") + F.col("_in")).alias("_first"))  # 256 rows


def pack_documents(docs: DataFrame, tokenizer: str | None = None, length: int = 2048, rows_per_bucket: int = 256, room: tuple[int, int] = LEAN) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: the pieces of all documents."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    scratch = Scratch(docs.sparkSession)
    tokens = scratch.write(tokenized(docs, tokenizer, room), "tokens")
    bounds = range_bounds(tokens, "key")
    per_segment = max(1, math.ceil(tokens.count() / rows_per_bucket / 256))
    tokens = tokens.withColumn("bucket", range_bucket(F.col("key"), bounds, per_segment))
    totals = tokens.groupBy("bucket").agg(F.sum("n").alias("n")).withColumn("segment", F.floor(F.col("bucket") / F.lit(per_segment)))
    first = running_starts(totals, "bucket", "segment", "n")
    inside = Window.partitionBy("bucket").orderBy("key", "doc_id", "crc").rowsBetween(Window.unboundedPreceding, -1)
    placed = tokens.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(first, "bucket")
    return placed.select("doc_id", "ids", "n", (F.col("_first") + F.col("_in")).alias("at")).mapInArrow(tidy(cut(length)), PIECE_DDL)
