"""The filter audit against a replay in plain Python."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tabulark.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(rows, labels):
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    out = Counter()
    parts = {s or "" for _, _, s in rows}
    shapley = Counter()
    for d, t, s in rows:
        t, s = t or "", s or ""
        words = WORD.findall(t)
        caps = sum("A" <= c <= "Z" for c in t)
        bad = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * caps > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > first[t]}
        good = d is not None and any(q == 1 for x, q, _ in labels if x == d)
        toxic = d is not None and any(x == 1 for i, _, x in labels if i == d)
        for order in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                key = (s, "".join(order), step)
                if bad[f] and sum(bad.values()) == 1:
                    out[*key, "unique_fails"] += 1
                if gone:
                    out[*key, "redundant"] += bad[f]
                elif bad[f]:
                    gone = True
                    out[*key, "removed"] += 1
                    out[*key, "good_lost"] += good
                    out[*key, "toxic_lost"] += toxic
                    shapley[s, f] += 1
                else:
                    out[*key, "kept"] += 1
    return sorted((s, "".join(o), k, *[out[s, "".join(o), k, c] for c in COLUMNS[:-1]], shapley[s, o[k - 1]]) for s in parts for o in permutations("ABCDE") for k in range(1, 6))


def some_rows(n=60, seed=4):
    rng = random.Random(seed)
    texts = [None, "", " \t\n", "one two", "A" * 30, "word " * 60, " ".join(f"w{k}" for k in range(80)), " ".join(f"W{k}" for k in range(60)), " ".join(f"é{k}" for k in range(70)) + " #", "x y " * 55, "Á# " * 3]
    texts += [" ".join(f"v{rng.randint(0, 90)}" for _ in range(rng.randint(40, 160))) for _ in range(8)]
    return [(rng.choice([None, rng.randint(0, 50)]) if rng.random() < 0.2 else k, rng.choice(texts), rng.choice([None, "", "a", "b"])) for k in range(n)]


@pytest.mark.parametrize("hot_share", [50_000, 10])
def test_replay_by_brute_force(spark, hot_share, monkeypatch):
    monkeypatch.setattr(filter_audit, "HOT_SHARE", hot_share)
    rows = some_rows()
    rows += [(100 + k, "the very same text", "b") for k in range(30)] + [(100, "the very same text", "b")] * 2
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 60, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (8, None, None), (8, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mask", F.lit("own")).withColumn("first", F.lit(3)).withColumn("good", F.lit(9))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("own"))
    flags = filter_audit.flagged(docs, known, hot_share)
    got = sorted(tuple(r) for r in filter_audit.replay(flags).select("part", "filter_order", "step", *COLUMNS).collect())
    assert got == brute(rows, labels)
    if hot_share > 10:
        assert sorted(map(tuple, filter_audit.audit_filters(docs, known).collect())) == got


def test_no_rows(spark):
    docs, known = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(docs, known).count() == 0
    one = spark.createDataFrame([(1, None, None)], docs.schema)
    assert filter_audit.audit_filters(one, known).where("removed = 1").count() == 120


def test_nothing_but_sums_crosses_the_network(spark, capsys):
    flags = spark.createDataFrame([("a", 3, 1, 0)] * 5, "part string, mask int, good int, toxic int")
    filter_audit.replay(flags).explain()
    plan = capsys.readouterr().out
    assert "BroadcastNestedLoopJoin" in plan and plan.index("partial_sum") > plan.index("Exchange hashpartitioning(part")
