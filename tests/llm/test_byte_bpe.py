"""Byte-level BPE against the tiktoken library."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tabulark.llm import byte_bpe

PARTS = list("abcXYZ  \n\t\x0b\x0c\r\x1c\x85\xa0'’.,0123²½ßÄéñİıſσς中文🙂́‍　<|>|-=_") + ["<|endoftext|>", "'s", "'LL", "'re", " 0 ", "the", " ther", "ing", "    ", "\n\n", "ation", "----", "aaaa"]
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def random_text(rng, most=80):
    return "".join(rng.choice(PARTS) for _ in range(rng.randint(0, most)))


def library(path):
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def known():
    return library(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary(PATH, public_tokenizers.PATTERN)


def ids(vocabulary, text):
    return np.frombuffer(vocabulary.encode(text), "<u4").tolist()


def test_ids_are_the_library_s(known, vocabulary):
    rng = random.Random(1)
    for text in [random_text(rng) for _ in range(3000)] + ["", " ", "a" * 5000, "-" * 3000, " " * 3000 + "x", "ab" * 2000, "\n" * 999]:
        assert ids(vocabulary, text) == known.encode_ordinary(text), text
        assert vocabulary.decode(vocabulary.encode(text)) == text.encode()
    for data in [bytes(rng.choice(b"aetn -\x80\xff") for _ in range(rng.randint(1, 60))) for _ in range(1500)]:  # pieces of any bytes
        assert byte_bpe.PrefixTable(vocabulary, data).ids() == known._core_bpe.encode_single_piece(data)


def test_other_ranks_and_every_token():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    known, vocabulary = library(path), byte_bpe.Vocabulary(path, public_tokenizers.PATTERN, most=100)
    rng = random.Random(2)
    assert all(ids(vocabulary, t) == known.encode_ordinary(t) for t in (random_text(rng) for _ in range(1000)))
    assert all(byte_bpe.PrefixTable(vocabulary, t).ids() == [r] for t, r in list(vocabulary.ranks.items())[::7])


def test_parts_end_at_borders(vocabulary):
    rng = random.Random(3)
    for _ in range(300):
        text = random_text(rng, 200)
        parts = list(vocabulary.parts(text, 10))
        assert "".join(parts) == text
        assert [p for part in parts for p in vocabulary.pattern.findall(part)] == vocabulary.pattern.findall(text)


def test_tables_hold_every_prefix(known, vocabulary):
    data = "internationalisation----====aaaaaaa".encode()
    table = byte_bpe.PrefixTable(vocabulary, data)
    assert list(table.last) == [known._core_bpe.encode_single_piece(data[:n])[-1] for n in range(1, len(data) + 1)]


def test_appends_and_edits_are_exact(known, vocabulary):
    rng = random.Random(5)
    for _ in range(150):
        text = random_text(rng)
        held = byte_bpe.EncodedText(vocabulary, text)
        for _ in range(8):
            more = random_text(rng, 6)
            if rng.random() < 0.4:
                held.append(more)
                text += more
            else:
                a = rng.randint(0, len(text))
                b = min(len(text), a + rng.choice([0, 1, 3, 20]))
                held.replace(a, b, more)
                text = text[:a] + more + text[b:]
            assert held.text == text and held.ids() == known.encode_ordinary(text)
            assert held.starts == [m.start() for m in vocabulary.pattern.finditer(text)]


def test_little_is_computed_anew(known, vocabulary):
    rng = random.Random(6)
    data = bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))
    table = byte_bpe.PrefixTable(vocabulary, data)
    table.work = 0
    table.append(b"tail")
    assert table.work == 4
    table.replace(9_000, 9_003, b"edited")
    data = data[:9_000] + b"edited" + data[9_003:] + b"tail"
    assert table.work < 2_000 and table.ids() == known._core_bpe.encode_single_piece(data)


def test_rows(spark, known):
    rng = random.Random(7)
    texts = [None, "", " ", "word " * 70_000, "x" * 100_000, *[random_text(rng) for _ in range(40)]]
    rows = [(k if k % 9 else None, t) for k, t in enumerate(texts)] + [(3, texts[3])] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("decoded", F.lit("own"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(d, len(i := known.encode_ordinary(t or "")), sha(np.array(i, "<u4").tobytes()), sha((t or "").encode())) for d, t in rows]
    got = byte_bpe.round_trip(df)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert byte_bpe.round_trip(df.where("false")).count() == 0


def test_edits_of_a_table(spark, known):
    docs = spark.createDataFrame([(1, "one two three"), (2, None), (3, "left alone"), (None, "no id")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 2, 99, 99, " four"), (1, 1, 4, 7, "2"), (2, 1, 0, 0, "new"), (2, 2, 1, 2, None), (9, 1, 0, 0, "x")], "doc_id long, seq int, start int, stop int, text string")
    got = {r.doc_id: (r.text, np.frombuffer(r.ids, "<u4").tolist()) for r in byte_bpe.edited(docs, edits).collect()}
    assert got == {1: ("one 2 three four", known.encode_ordinary("one 2 three four")), 2: ("nw", known.encode_ordinary("nw"))}


def test_corpus(spark, sf, known):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in byte_bpe.encoded(docs).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == known.encode_ordinary(texts[r.doc_id] or "")
