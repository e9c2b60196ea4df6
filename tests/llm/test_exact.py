"""Corpus operators against other ways to the same rows: brute force, the tokenizers library, held counts by hand."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tabulark.llm import factorisation, fingerprints, html_text, interpolated_lm, near_dedup, packing
from tabulark.llm.common import string_hashes, text_words, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = list("abcXYZ  \n\t\x0b\x0c\r\x1c\x85\xa0'’.,0123²½ßÄéñİıŉſΣσς中文🙂́‍　<|>|") + ["<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", " 0 "]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(n)] + [None, "", " ", "a" * 3000]


def test_words_are_split_as_stated():
    texts = odd_texts(500)
    codes, words, at = text_words(pa.array(texts), lower=False)
    listed = words.to_pylist()
    assert [[listed[c] for c in codes[i:j]] for i, j in zip(at, at[1:])] == [WORD.findall(t or "") for t in texts]
    hashes, at = word_hashes(pa.array(["The the", "THE É"]))
    assert len(set(hashes[:3].tolist())) == 1 and hashes[3] != hashes[0] and at.tolist() == [0, 2, 4]
    many = sorted({f"{a}{b}" for a in range(3000) for b in ("", "\0", "x", "xx")})
    assert len(set(string_hashes(pa.array(many)).tolist())) == len(many)


def test_tokenizer_gives_the_library_its_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), packing.WordTokenizer(path, most=50)
    assert own.by_words
    for seed in (1, 2):
        texts = odd_texts(1000, seed)
        ids, n = own.ids(pa.array(texts))
        at = np.append(0, np.cumsum(n))
        assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    other = packing.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    ids, n = other.ids(pa.array(["Other rules", None]))
    assert not other.by_words and ids.tolist() == Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode("Other rules").ids and n.tolist()[1] == 0


def test_words_that_parts_share_are_taken_apart_once(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, taken, learned = public_tokenizers.path("word_bpe_49k.json"), [], []
    words, learn = packing.WordTokenizer._words, packing.WordTokenizer._learn
    monkeypatch.setattr(packing, "_WORKER", {})
    monkeypatch.setattr(packing.WordTokenizer, "_words", lambda self, w: (taken.extend(w.to_pylist()), words(self, w))[1])
    monkeypatch.setattr(packing.WordTokenizer, "_learn", lambda self, p: (learned.extend(p), learn(self, p))[1])
    rng = random.Random(4)
    bank = ["".join(rng.choice("abcdeéßÄ") for _ in range(9)) for _ in range(3000)] + ["İx", "don't", "a1,b2", "\x7f"]
    texts = [" ".join(rng.choice(bank) for _ in range(1000)) for _ in range(280)] + [None, ""]  # 4 MB at most, as Spark sends them
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    assert 3_000_000 < batch.nbytes < 4_000_000
    empty = batch.slice(0, 0)
    rows = [r for b in packing.tokens_of(path)(iter([empty, batch, empty])) for r in b.to_pylist()]
    assert len(taken) == len(set(taken)) and set(taken) - {""} == set(bank)
    assert len(learned) == len(set(learned))
    library = Tokenizer.from_file(path)
    assert [r["doc_id"] for r in rows] == list(range(len(texts)))
    for r, t in zip(rows, texts):
        assert np.frombuffer(r["ids"], "<u2").tolist() == [*library.encode(t or "", add_special_tokens=False).ids, packing.END_ID]


def test_forgotten_pieces_are_learned_again():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), packing.WordTokenizer(path, most=20)
    lists = [[f"w{i} a{'bcdé'[i % 4]}x{'yz' * (i % 3)}" for i in range(k, k + 40)] for k in (0, 30, 0, 500, 10)] + [[None], [], ["", " "]]
    for texts in lists:
        parts = [pa.array(texts[:25], pa.string()), pa.array(texts[25:], pa.string())]
        for part, (ids, n) in zip(parts, own.ids_of_parts(parts), strict=True):
            at = np.append(0, np.cumsum(n))
            assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == [library.encode(t or "", add_special_tokens=False).ids for t in part.to_pylist()]
    assert len(own.numbers) <= 20 + 200 and len(own.sizes) == len(own.numbers)


def test_every_id_lies_in_one_piece(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = odd_texts(60, 3) + ["word " * 5000, "word " * 5000]
    rows = [(None if i % 20 == 7 else i // 2, t, "x") for i, t in enumerate(texts)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, start string"), rows_per_bucket=4).toPandas()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for d, t, _ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        want[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    # Documents in one piece are known by their ids; those in several by their pieces, end to end.
    whole = got[got.length == got.doc_tokens]
    found = Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.doc_tokens, r.ids_crc32) for r in whole.itertuples())
    assert not found - want
    tokens = {k: library.encode(t or "", add_special_tokens=False).ids + [packing.END_ID] for k, t in enumerate(texts)}
    for r in got[got.length < got.doc_tokens].itertuples():
        assert any(len(ids) == r.doc_tokens and zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for ids in tokens.values())
    assert got.length.sum() == sum(len(ids) for ids in tokens.values())
    for (d, n), g in got[got.length < got.doc_tokens].groupby(["doc_id", "doc_tokens"]):
        assert g.length.sum() % n == 0


def brute_sketch(text, size=5, scale=8):
    def chained(words):
        h = 42
        for w in words:
            h = xxhash.xxh64_intdigest(w.encode(), seed=h)
        return h - 2**64 if h >= 2**63 else h

    words = WORD.findall(text or "")
    runs = [words[i : i + size] for i in range(len(words) - size + 1)] or ([[" ".join(words)]] if words else [])
    return {h for h in map(chained, runs) if h < -(2**63) + 2**64 // scale}


def written(hashes):
    return "".join(f"{h % 2**64:016X}" for h in sorted(hashes))


def share(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("heavy", [False, True])
def test_fingerprints_by_brute_force(spark, heavy):
    rng = random.Random(5)
    bank = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(bank) for _ in range(n))
    rows = [(i, text(rng.randint(0, 120))) for i in range(40)] + [(100, None), (101, ""), (102, "one two"), (103, "one two")]
    if heavy:  # one id on many texts, null ids, and equal rows among both
        rows += [(20, text(30)) for _ in range(30)] + [(20, "same text for all of them here")] * 12 + [(None, "a null one " * 4)] * 9 + [(None, text(50)) for _ in range(9)] + [(103, "last")] * 3
    got = fingerprints.fingerprint_documents(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, bucket string"), rows_per_bucket=3).collect()

    def tie(t):
        h = xxhash.xxh64_intdigest((t or "").encode(), seed=42)
        return h - 2**64 if h >= 2**63 else h

    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -tie(r[1])))
    want = Counter()
    for k, (i, t) in enumerate(order):
        a, b = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        x, y, z = brute_sketch(a), brute_sketch(edited), brute_sketch(b)
        inside = lambda u, v: len(u & v) / len(u) if u else 1.0
        want[i, len(a), hashlib.sha256(edited.encode()).hexdigest(), written(x), written(y), round(share(x, y), 9), round(share(x, z), 9), len(x), round(inside(x, y), 9), round(inside(x, z), 9)] += 1
    found = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9), r.n_hashes, round(r.in_edited, 9), round(r.in_next, 9)) for r in got)
    assert found == want


def test_fingerprints_merge_and_contain(spark):
    a, b = " ".join(f"a{i}" for i in range(4000)), " ".join(f"b{i}" for i in range(400))
    row = spark.createDataFrame([(a, b, a + " " + b)], "a string, b string, both string").select(*[fingerprints.sketch(F.col(c)).alias(c) for c in ("a", "b", "both")])
    row = row.select("*", fingerprints.merged(F.col("a"), F.col("b")).alias("m"), fingerprints.containment(F.col("b"), F.col("both")).alias("inside"), fingerprints.containment(F.col("both"), F.col("b")).alias("share"), fingerprints.likeness(F.col("b"), F.col("both")).alias("like")).first()
    assert set(row.m) <= set(row.both) and len(row.both) - len(row.m) <= 4  # the shingles over the seam
    assert row.inside == 1.0 and abs(row.share - 396 / 4396) < 0.05 and row.like < 0.2
    back = spark.createDataFrame([(a,)], "t string").select(fingerprints.read_back(fingerprints.written(fingerprints.sketch(F.col("t")))).alias("r"), fingerprints.sketch(F.col("t")).alias("s")).first()
    assert [int(x, 16) for x in back.r] == [h % 2**64 for h in back.s]


def test_language_model_by_hand(spark):
    """Counts, base score and probabilities as the docstring states them; EM's weights raise the held-out likelihood."""
    rng = random.Random(2)
    bank = [f"w{int(rng.paretovariate(0.8)) % 60}" for _ in range(400)]
    rows = [(i, " ".join(rng.choice(bank) for _ in range(rng.randint(0, 30)))) for i in range(150)] + [(None, "null id w1"), (200, None), (3, "w1 W1 w1")]
    got = interpolated_lm.interpolated_scores(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r.doc_id, r.n_tokens, round(r.base_score, 6)): r for r in got.collect()}
    fold = lambda d: zlib.crc32(str(d).encode() if d is not None else b"") % 7
    tokens = lambda t: [*(w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(t or "")), "\0end"]
    train = [tokens(t) for d, t in rows if fold(d) != 2]
    uni = Counter(w for t in train for w in t)
    bi = Counter(p for t in train for p in zip(["\0end", *t], t))
    n, v = sum(uni.values()), len(uni)
    stats = interpolated_lm.cells(np.array(list(bi.values())), np.array([uni[h] for h, _ in bi]), np.array([uni[w] for _, w in bi]), n, v)
    weights = interpolated_lm.learn_weights(stats, v)
    assert np.allclose(weights.sum(1), 1) and (weights >= 0).all()

    def held_out(lam):
        return sum(k * math.log(lam[min((uni[h] - 1).bit_length(), 63)] @ np.array([(k - 1) / max(uni[h] - 1, 1), (uni[w] - 1) / (n - 1), 1 / (v + 1)])) for (h, w), k in bi.items())

    even = np.full((64, 3), 1 / 3)
    even[0] = (0, 0.5, 0.5)
    assert held_out(weights) > held_out(even)
    for d, t in rows:
        ws = tokens(t)
        base = sum(math.log10((uni[w] + 1) / (n + 1 * (v + 1))) for w in ws)
        r = got[d, len(ws), round(base, 6)]
        score = sum(math.log10(weights[min(uni[h].bit_length(), 63)] @ np.array([bi[h, w] / max(uni[h], 1), uni[w] / n, 1 / (v + 1)])) for h, w in zip(["\0end", *ws], ws))
        assert r.held_out == (fold(d) == 2) and r.n_known == sum(uni[w] > 0 for w in ws) and r.train_tokens == n and abs(r.score - score) < 1e-5 * max(1, abs(score))


def test_no_labels_no_opinion(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None), (None, "x" * 50_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in factorisation.quality_scores(docs, none).collect()} == {0.5}


def test_near_duplicates_over_several_blocks(spark, monkeypatch):
    """A group of 60 near copies of three sizes in blocks of four sets: pairs meet inside, across and beside blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", 4)
    rng = random.Random(8)
    base = [f"v{k}" for k in range(200)]
    rows = []
    for i in range(60):
        w = base[: 200 - 12 * (i % 3)]
        for k in rng.sample(range(len(w)), rng.randint(0, 6)):
            w = [*w[:k], f"e{i}_{k}", *w[k + 1 :]]
        rows.append((None if i % 13 == 5 else i, " ".join(w)))
    rows += [(100 + i, " ".join(f"u{i}_{k}" for k in range(60))) for i in range(8)]
    got = near_dedup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, list_bound=10).collect()
    sets = {k: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for k, w in ((k, t.split()) for k, (_, t) in enumerate(rows))}
    label = list(range(len(rows)))
    for _ in range(len(rows)):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    named = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            named[label[k]] = min(d, named.get(label[k], 10**9))
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((d, named.get(label[k])) for k, (d, _) in enumerate(rows))


def test_long_pages():
    assert html_text.html_to_text("<br>" * 200_000 + "end") == "end"
    page = "<table style='visibility:hidden'><tr><td>no</td><td style='visibility:visible'>yes</td></tr></table>"
    assert "yes" in html_text.html_to_text(page) and "no" not in html_text.html_to_text(page)
    spanned = html_text.html_to_text("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>").split("\n")
    assert spanned[0].index("b") == spanned[1].index("c")


PIPELINE = "doc_id long, text string, lang string, source string, n_chars long, _id string, key string, row string, n_lines string, _tokens string, kept string, bucket string"


def stages(spark, rows):
    import corpus_pipeline

    docs = spark.createDataFrame(rows, PIPELINE)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 30)] + [(40, 0, 0)], "doc_id long, quality int, toxic int")
    folder = f"{spark.sparkContext.getCheckpointDir() or '/tmp'}/pipeline-{random.getrandbits(64):x}"
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return corpus_pipeline, folder


def test_pipeline_on_odd_rows(spark):
    line = "a line of more than forty characters that very many documents share"
    text = lambda i: f"{line}\n" + " ".join(f"word{(i * 7 + k) % 97}" for k in range(60)) + "."
    rows = [(i, text(i), "en", "s", 1) for i in range(1, 30)] + [(1, text(1), "en", "s", 1), (None, None, None, None, None), (None, "", "en", "s", 0), (30, text(2), "en", "s", 1), (31, "", "de", "s", 0), (32, None, "de", None, None), (33, "long " * 30_000, "en", "s", 5)]
    rows = [(*r, *["x"] * 7) for r in rows]
    pipeline, folder = stages(spark, rows)
    got = pipeline.run(spark, folder).toPandas()
    assert set(got.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    assert got.groupby("sequence_id").length.sum().le(2048).all() and got.length.sum() > 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    after = docs
    for name, stage in pipeline.STAGES[:-1]:
        before, after = after, stage(spark, after, folder).cache()
        assert after.columns == docs.columns and after.schema == docs.schema, name
    kept = {r.doc_id for r in after.collect()}
    assert 30 not in kept or 2 not in kept  # one of the two copies goes
    assert pipeline.STAGES[-1][1](spark, after, folder).agg(F.countDistinct("doc_id")).first()[0] == len(kept - {None})


def test_pipeline_without_rows(spark):
    pipeline, folder = stages(spark, [])
    assert pipeline.run(spark, folder).count() == 0


def test_cut_off_settings_are_errors(spark, monkeypatch):
    from tabulark import session

    class Fake:
        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getCheckpointDir():
                return None

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(ValueError):
        session.shared_folder(Fake)
