"""The manifest against a tree built in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tabulark.llm import merkle
from tabulark.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(d, t, lang, source, n):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, t)))


def tree(leaves):
    """Levels from the leaves to the root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        run = i // 16 * 16
        yield level[run:i], level[i + 1 : run + 16]
        i //= 16


def lowered(t):
    return t if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
    trees = {g: tree([leaf_of(*r) for r in groups[g]]) for g in order}
    over = tree([trees[g][-1][0] for g in order])
    out = []
    for at, g in enumerate(order):
        for i, (d, t, lang, source, n) in enumerate(groups[g]):
            steps = [*siblings(trees[g], i), *siblings(over, at)]
            hit = d is not None and zlib.crc32(str(d).encode()) % 5 == 0
            h = leaf_of(d, lowered(t) if hit else t, lang, source, n)
            for left, right in steps:
                h = sha("".join([*left, h, *right]))
            root = over[-1][0]
            out.append((d, trees[g][0][i], trees[g][-1][0], root, sha("".join("".join(a + b) for a, b in steps)), h, h == root))
    return out


def some_rows(sizes, seed=3):
    rng = random.Random(seed)
    ids = rng.sample(range(-(1 << 40), 1 << 62), 40) + list(range(200))
    for g, n in sizes.items():
        for _ in range(n):
            yield rng.choice(ids), rng.choice(["Text A", "small", "Ünï ÄZ", "", None, "x" * 300 + "Y"]), rng.choice(["en", None]), g, rng.choice([None, 3, -1])


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 17, "b": 16, None: 1, "": 2}, {"a": 700, "Zz": 257, "é": 40, None: 33}, {f"s{k}": 1 + k % 3 for k in range(40)}])
def test_manifest_by_brute_force(spark, sizes):
    rows = list(some_rows(sizes))
    if len(sizes) > 3:
        rows += [(None, f"No id {k}", None, "a", None) for k in range(30)] + [(-1 << 63, "Least", "en", "a", 1)] + [(7, "Same", "en", "a", 4)] * 50
    df = spark.createDataFrame(rows, SCHEMA).withColumn("h", F.lit(1)).withColumn("rank", F.lit("own")).withColumn("g", F.lit(None).cast("string"))
    got = merkle.document_manifest(df)
    assert got.columns == COLUMNS
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute(rows)))


def test_no_rows(spark):
    assert merkle.document_manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ranges_rank_as_a_sort_does(spark, monkeypatch):
    monkeypatch.setattr(merkle, "ROWS_PER_RANGE", 7)
    names = sorted({f"+{random.Random(k).random()}" for k in range(100)} | {""})
    shuffled = random.Random(1).sample(names, len(names))
    got = merkle.ordered_ranks(spark.createDataFrame([(n,) for n in shuffled], "g string"), "g", Scratch(spark)).collect()
    assert sorted((r["rank"], r.g) for r in got) == list(enumerate(names))


def test_any_changed_field_is_found(spark):
    rows = [(k, f"text {k}", "en", f"s{k % 3}", k) for k in range(60)]
    leaf = merkle.row_digest([F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    before = spark.createDataFrame(rows, SCHEMA).select(F.col("source").alias("g"), F.col("doc_id").alias("key"), leaf.alias("h"))
    found = merkle.proofs(before, ["key"]).select("kid.key", "root", "path")
    changed = {4: (4, "text 5", "en", "s1", 4), 9: (9, "text 9", None, "s0", 9), 30: (30, "text 30", "en", "s0", 31)}
    now = spark.createDataFrame([changed.get(r[0], r) for r in rows], SCHEMA).select(F.col("doc_id").alias("key"), leaf.alias("now"))
    bad = found.join(now, "key").where(merkle.folded(F.col("now"), F.col("path")) != F.col("root"))
    assert sorted(r.key for r in bad.collect()) == sorted(changed)
