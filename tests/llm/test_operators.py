"""Each corpus operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables
and clashing columns."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulark.llm import factorisation, html_text, line_dedup, mixing, near_dedup, quality_rules
from tabulark.llm.common import Scratch, fold
from tabulark.llm.fingerprints import fingerprint_documents
from tabulark.llm.interpolated_lm import interpolated_scores
from tabulark.llm.packing import hilbert, pack_documents
from tabulark.llm.sharding import rendezvous, shard_documents
from tabulark.llm.textstats import text_stats

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again.\nA line of more than forty characters that many share.\nshort", "a"),
    (2, "A line of more than forty characters that many share.  \nother words here", "a"),
    (3, "  a LINE of more than forty characters that many share.", None),
    (4, "A line of more than forty characters that many share.\nA line of more than forty characters that many share.", "b"),
    (5, "A line of more than forty characters that many share.\nlast", "b"),
    (6, None, "b"), (7, "", "b"), (8, " \t\n", "b"), (9, LONG, "b"), (9, LONG, "b"), (None, "a null id", "b"), (10, "# $ % odd | <signs> {here}", "a"),
]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    extra = ["_id", "_k", "key", "n", "kept_text", "n_lines", "bucket", "_tokens", "_p", "row", "shard", "kept", "__gone"]
    return spark.createDataFrame(ROWS, SCHEMA).select("*", *[F.lit("x").alias(c) for c in extra], F.length("text").cast("long").alias("n_chars")).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i != 10), 0) for i in range(1, 11)] + [(3, 0, 1), (None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")


def test_rendezvous_moves_rows_into_the_new_shard_only(spark):
    ids = spark.range(3000).select(rendezvous(F.col("id"), [1.0] * 5).alias("a"), rendezvous(F.col("id"), [1.0] * 6).alias("b"), rendezvous(F.col("id"), [1.0, 3.0]).alias("w")).toPandas()
    moved = ids[ids.a != ids.b]
    assert (moved.b == 5).all() and 350 < len(moved) < 650
    assert 0.7 < (ids.w == 1).mean() < 0.8


def test_sharding(docs, none):
    got = shard_documents(docs).toPandas()
    assert len(got) == len(ROWS) and got.groupby("shard").slot.apply(lambda s: sorted(s) == list(range(len(s)))).all()
    by_id = {r.doc_id: r for r in got.itertuples() if r.doc_id == r.doc_id}
    assert by_id[6].size == 1 and by_id[6].text_crc32 == 0 and by_id[1].text_crc32 == zlib.crc32(ROWS[0][1].encode())
    assert shard_documents(none).count() == 0


def brute_stats(text):
    text = text or ""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


@pytest.mark.parametrize("text", [r[1] for r in ROWS[:8]] + ["a b c a b c", "x x x x", "a b c d a b", "é\x1cé\x85 ü y", "l\nl\n\nl"])
def test_text_statistics(text):
    s = text_stats(text)
    assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words) == brute_stats(text)


def test_quality_rules(docs, none, spark, sf):
    got = quality_rules.weak_supervision(docs).toPandas()
    assert len(got) == len(ROWS) and not got.kept[got.base_failed].any()
    assert quality_rules.weak_supervision(none).count() == 0
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    found = quality_rules.weak_supervision(whole).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").toPandas()
    assert (found.kept == (found.quality == 1)).mean() > 0.95
    # The fitted model is the one that EM over the vote patterns gives, pattern by pattern.
    rows = list(quality_rules.rows([[1, 2], ["a " * 60, "good words that differ " * 20]]))
    codes = np.array([r[-1] for r in rows])
    assert (quality_rules.decode(codes, len(quality_rules.RULES)) <= 2).all()


def test_em_finds_planted_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.75, 0.9])
    votes = np.where(rng.random((20_000, 6)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random((20_000, 6)) < 0.2] = 2
    codes, counts = np.unique([quality_rules.encode(v) for v in votes.tolist()], return_counts=True)
    model = quality_rules.fit(codes, counts, 6)
    assert abs(model["share"] - 0.8) < 0.03 and np.abs(model["right_good"] - right).max() < 0.05


def test_factorisation_machine(spark, sf, docs, none, labels):
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = factorisation.quality_scores(d, lab).join(lab, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.9 and got.score.between(0, 1).all()
    small = factorisation.quality_scores(docs, labels).toPandas()
    assert len(small) == len(ROWS) and small.score.notna().all() and small[small.doc_id == 9].score.nunique() == 1
    assert factorisation.quality_scores(none, labels).count() == 0
    assert factorisation.quality_scores(docs, labels.limit(0)).select("score").distinct().count() >= 1
    kept = factorisation.keep_good(docs, labels)
    assert kept.columns == docs.columns


def test_pairwise_term_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    model = {"w0": 0.3, "w": rng.normal(size=20), "v": rng.normal(size=(20, 3))}
    ids, x = np.array([2, 5, 11]), np.array([1.0, 0.5, 2.0])
    z, _ = factorisation.logits(model, ids, x, np.array([0]))
    pairs = sum(model["v"][i] @ model["v"][j] * a * b for k, (i, a) in enumerate(zip(ids, x)) for j, b in list(zip(ids, x))[k + 1 :])
    assert abs(z[0] - (0.3 + model["w"][ids] @ x + pairs)) < 1e-9


def test_line_dedup_edges(docs, none):
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert [got[i].n_dropped for i in (1, 2, 3, 4, 5)] == [1, 1, 1, 2, 0] and got[6].n_lines == 1 and got[7].n_lines == 1
    assert got[3].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert line_dedup.dedup_lines(none).count() == 0
    kept = line_dedup.without_repeated_lines(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 2").first().text == "other words here" and kept.where("doc_id = 1").first().n_lines == "x"


def test_line_index_is_reversible(spark):
    line = "this line has certainly more than forty characters {}"
    rows = [(i, "\n".join(line.format(j) for j in range(12) if (i + j) % 3)) for i in range(30)]
    old, new = spark.createDataFrame(rows[:20], "doc_id long, text string"), spark.createDataFrame(rows[20:], "doc_id long, text string")
    whole = spark.createDataFrame(rows, "doc_id long, text string")
    first = line_dedup.LineIndex.of(old, keys_per_shard=4)
    grown = first.add(new)
    scratch = line_dedup.LineIndex.of(whole, keys_per_shard=4)

    def refs(ix):
        return {tuple(r) for r in ix.refs.collect()}

    def texts(ix, d):
        return {(r.doc_id, r.kept_text) for r in ix.apply(d).collect()}

    assert refs(grown) == refs(scratch) and texts(grown, whole) == texts(scratch, whole)
    back = grown.remove(new)
    assert refs(back) == refs(first) and texts(back, old) == texts(first, old)
    assert texts(first, old) == {(r.doc_id, r.kept_text) for r in first.apply(old, broadcast_bytes=0).collect()}


def test_cuckoo_filter():
    rng = np.random.default_rng(3)
    h = rng.integers(-(2**63), 2**63, (5000, 2))
    f = line_dedup.CuckooFilter.build(h[:, 0], h[:, 1])
    assert f.contains(h[:, 0], h[:, 1]).all()
    other = rng.integers(-(2**63), 2**63, (20_000, 2))
    assert f.contains(other[:, 0], other[:, 1]).mean() < 0.002
    assert all(f.delete(int(a), int(b)) for a, b in h[:2500])
    assert f.contains(h[2500:, 0], h[2500:, 1]).all() and f.contains(h[:2500, 0], h[:2500, 1]).mean() < 0.01


def test_fingerprints(docs, none):
    got = fingerprint_documents(docs, rows_per_bucket=2).toPandas()
    assert len(got) == len(ROWS)
    order = sorted([r for r in ROWS if r[0] is not None], key=lambda r: -r[0]) + [r for r in ROWS if r[0] is None]
    want = Counter()
    for i, r in enumerate(order):
        text, donor = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        want[hashlib.sha256((text[: len(text) - half] + donor[:half]).encode()).hexdigest()] += 1
    assert Counter(got.edited_sha256) == want
    assert got[got.doc_id == 9].fingerprint.nunique() == 1 and got.near_next.between(0, 1).all()
    assert fingerprint_documents(none).count() == 0
    one = fingerprint_documents(docs.where("doc_id = 1")).first()
    assert one.near_next == 1.0


def test_packing(docs, none):
    got = pack_documents(docs, rows_per_bucket=2).toPandas()
    spans = got.sort_values(["sequence_id", "offset"])
    assert got.length.sum() == sum(r.doc_tokens for r in got.itertuples() if r.start == 0)
    for _, g in spans.groupby("sequence_id"):
        assert g.offset.iloc[0] == 0 and (g.offset.to_numpy()[1:] == g.length.cumsum().to_numpy()[:-1]).all() and g.length.sum() <= 2048
    assert (got.groupby("sequence_id").length.sum() < 2048).sum() <= 1
    assert pack_documents(none).count() == 0


def test_hilbert_neighbours_touch():
    g = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    k = hilbert(g, 3)
    assert sorted(k.tolist()) == list(range(512)) and np.abs(np.diff(g[np.argsort(k)], axis=0)).sum(1).max() == 1


def test_language_model_paths_agree(docs, none, spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    a = interpolated_scores(d).toPandas().sort_values(["doc_id", "n_tokens"]).reset_index(drop=True)
    b = interpolated_scores(d, vocabulary_limit=0).toPandas().sort_values(["doc_id", "n_tokens"]).reset_index(drop=True)
    assert len(a) == len(b) == d.count()
    for c in ("score", "base_score", "n_known", "n_tokens", "train_tokens"):
        assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=1e-6)
    held = a[a.held_out]
    assert held.score.sum() > held.base_score.sum()
    assert interpolated_scores(none).count() == 0


def brute_classes(rows, size, percent):
    import re

    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    links = [(i, j) for i in ids for j in ids if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return label, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize(("bound", "sent"), [(50, 10), (2, 10**6), (2, 0)])
def test_near_duplicates(spark, bound, sent, monkeypatch):
    frequent = near_dedup._frequent_edges
    monkeypatch.setattr(near_dedup, "_frequent_edges", lambda *a: frequent(*a, broadcast_values=sent))
    rng = np.random.default_rng(4)
    base = [f"v{k}" for k in range(120)]
    rows = []
    for i in range(60):
        w = list(base) if i % 2 else [f"u{i}_{k}" for k in range(80)] + base[:40]
        for k in rng.choice(len(w), int(rng.integers(0, 9)), replace=False):
            w[k] = f"e{i}_{k}"
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, ""), (102, "two words"), (103, "two words"), (104, rows[1][1])]
    want, sizes = brute_classes(rows, 3, 85)
    got = near_dedup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, list_bound=bound).collect()
    assert {r.doc_id: r.component_id for r in got} == want and {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicate_edges(docs, none):
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 9").count() == 2 and kept.where("doc_id is null").count() == 1
    assert near_dedup.near_duplicate_classes(none).count() == 0


def test_block_links_equal_brute_force():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(40)]
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 40 * len(np.union1d(sets[i], sets[j]))}
    assert set(zip(*(x.tolist() for x in near_dedup.block_links(sets, None, 40, slab=7)))) == want
    left, right = near_dedup.block_links(sets[:20], sets[20:], 40, slab=7)
    assert {(i, j + 20) for i, j in zip(left.tolist(), right.tolist())} == {(i, j) for i, j in want if i < 20 <= j}


def test_mixing_meets_targets(spark, sf, docs, none, labels):
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = mixing.mixing_rates(d, lab, mu=0.001, rounds=300, tol=1e-7).toPandas()
    p = got[[f"p_{k}" for k in mixing.DOMAINS]].to_numpy()
    mass = (got.n_tokens.to_numpy()[:, None] * p).sum(0)
    target = mass**0.7 / (mass**0.7).sum() * mass.sum()
    reached = ((got.rate * got.n_tokens).to_numpy()[:, None] * p).sum(0)
    assert np.abs(reached / target - 1).max() < 0.05 and (got.rate >= 0).all()
    small = mixing.mixed(docs, labels, lower=1.0)
    assert small.columns == docs.columns and small.select("doc_id").distinct().count() == len({r[0] for r in ROWS})
    assert mixing.mixing_rates(none, labels).count() == 0 and mixing.mixing_rates(docs, labels.limit(0)).count() == len(ROWS)


@pytest.mark.parametrize("lower,every", [(0.0, 4), (1.0, 2)])
def test_projected_gradient_satisfies_optimality(spark, lower, every):
    rng = np.random.default_rng(6)
    p, t = rng.dirichlet(np.ones(4) / 2, 300), rng.integers(1, 50, 300)
    target, mu = np.array([0.5, 0.3, 0.2, 0.0]) * t.sum() * (1 + lower), 0.05
    slim = spark.createDataFrame([(int(a), b.tolist(), 1.0) for a, b in zip(t, p)], "_tokens long, _p array<double>, _rate double")
    steps = mixing.fit_rates(slim, target, mu, lower, 300, 1e-7, Scratch(spark), every)
    r = np.array([x._rate for x in mixing.with_rates(slim.coalesce(1), steps, mu, lower).collect()])
    p, t = np.array([x._p for x in slim.coalesce(1).collect()]), np.array([x._tokens for x in slim.coalesce(1).collect()])
    e = np.where(target > 0, ((r * t) @ p - target) / np.where(target > 0, target, 1), 0)
    grad = p @ e + mu * (r - 1)
    assert np.abs(grad[r > lower + 1e-9]).max() < 1e-4 and (grad[r <= lower + 1e-9] > -1e-4).all() and (r >= lower).all()
    assert len(steps) < 20, len(steps)


HTML = {
    "<p>a <b>b</b>  c<p>d<br>e": "a b c\n\nd\ne",
    "<ul><li>x<li>y<ul><li>z</ul><li>w</ul>": "- x\n- y\n  - z\n- w",
    "<ol start=3><li>q<li>r</ol>": "3. q\n4. r",
    "<table><tr><th>Name<th>Qty<tr><td>Apple pie<td>3</table>": "Name       Qty\nApple pie  3",
    "<pre>\n a\n  b</pre>": " a\n  b",
    "x<div style='display: none'>no</div><p hidden>no</p><script>no</script><!-- no -->y": "xy",
    "<span style='visibility:hidden'>no<i style='visibility:visible'>yes</i></span>": "yes",
    "<head><title>no</title></head>text &amp; &lt;more&gt;": "text & <more>",
    "<dl><dt>T<dd>D</dl>": "T\n  D",
    "a<script>var t='</p>';": "a",
    "<p>cut <b": "cut",
}


@pytest.mark.parametrize("html", sorted(HTML))
def test_html(html):
    assert html_text.html_to_text(html) == HTML[html]


def test_html_edges(spark):
    deep = "<div>" * 20_000 + "deep" + "<table><tr><td>" * 60 + "cell"
    pages = spark.createDataFrame([(1, None, None), (2, "u", deep), (3, "u", ""), (3, "u", "")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_pages(pages.withColumn("text", F.lit("x"))).collect()}
    assert got[1] == "" and got[3] == "" and "deep" in got[2] and "cell" in got[2]
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_fold(spark):
    df = spark.createDataFrame([(5,), (None,)], "doc_id long").select("doc_id", fold(F.col("doc_id"), 7).alias("f")).collect()
    assert {r.doc_id: r.f for r in df} == {5: zlib.crc32(b"5") % 7, None: 0}


def test_queries_match_sql(spark, sf):
    import duckdb

    from tabulark.llm import queries

    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, sf).toPandas(), con.sql(sql).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        assert sorted(map(str, got[cols].itertuples(index=False, name=None))) == sorted(map(str, want[cols].astype(got[cols].dtypes.to_dict()).itertuples(index=False, name=None))), name


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = defaultdict(int)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf).cache()
        assert docs.columns == before.columns
        seen[name] = docs.count()
    assert seen["quality_classifier"] >= seen["near_dedup"] and seen["line_dedup"] == seen["quality_classifier"] and seen["mixing"] >= seen["near_dedup"]
