"""Corpus operators do the whole of their job."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulark.llm import html_text, mixing, near_dedup


def text(name, changed=()):
    return " ".join(f"{name}{k}" if k not in changed else f"new{k}" for k in range(100))


def test_each_row_is_judged_by_its_own_text(spark):
    a, b, c, d = (text(x) for x in "abcd")
    rows = [(1, a), (5, a), (5, b), (5, None), (None, a), (None, c), (None, ""), (None, d), (None, d), (7, text("e")), (7, text("e", [50])), (8, "Same words"), (8, "Same words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("own"))
    got = near_dedup.drop_near_duplicates(df)
    assert got.columns == df.columns
    kept = sorted(map(str, [(r.doc_id, r.text) for r in got.collect()]))
    options = [[(1, a), (5, b), (5, None), (None, c), (None, ""), (None, d), (7, e), (8, "Same words"), (8, "Same words")] for e in (text("e"), text("e", [50]))]
    assert kept in [sorted(map(str, x)) for x in options]


def newton(p, t, target, mu, lower):
    """The optimum by another way: damped Newton steps on the residuals e, of which r = max(lower, 1 - p e / mu)."""
    share, total = target / target.sum(), target.sum()

    def look(e):
        s = p @ e
        r, low = np.maximum(lower, 1 - s / mu), np.minimum(s, mu * (1 - lower))
        value = (t @ (low * low / (2 * mu) - low - lower * (s - low)) + (target * (e * e / 2 + e)).sum()) / total
        return value, (target * (1 + e) - (t * r) @ p) / total, (p * (t * (s < mu * (1 - lower)))[:, None]).T @ p / (mu * total)

    e = np.zeros(len(target))
    for _ in range(300):
        value, slope, square = look(e)
        if np.abs(slope / share).max() < 1e-10:
            break
        step, part = np.linalg.solve(np.diag(share) + square, -slope), 1.0
        while look(e + part * step)[0] > value + 1e-4 * part * (slope @ step) + 1e-14 and part > 1e-9:
            part /= 2
        e = e + part * step
    return np.maximum(lower, 1 - p @ e / mu)


@pytest.mark.parametrize("temperature,lower,within", [(0.7, 0.0, 0.01), (0.9, 1.0, 0.01), (0.3, 0.0, 0.02)])  # the last asks for rates far from one
def test_default_mixing_meets_targets(spark, sf, temperature, lower, within):
    got = mixing.mixing_rates(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), temperature=temperature, lower=lower, tol=1e-8).toPandas()
    p, t = got[[f"p_{k}" for k in mixing.DOMAINS]].to_numpy(), got.n_tokens.to_numpy()
    mass = (t[:, None] * p).sum(0)
    share = mass**temperature / (mass**temperature).sum()
    target = share * (mass.sum() if lower < 1 else (mass / share).max())
    off = ((got.rate * t).to_numpy()[:, None] * p).sum(0) / target - 1
    # The optimum: rates follow from the residuals, and are those that Newton's method finds.
    assert np.abs(got.rate - np.maximum(lower, 1 - p @ off / 0.001))[t > 0].max() < 1e-3
    assert np.abs(got.rate - newton(p, t.astype(float), target, 0.001, lower))[t > 0].max() < 1e-3
    assert np.abs(off).max() < within
    # Copies: rates rounded up or down, the tokens of each dominant domain those of its rates to one document.
    assert np.abs(got.copies - got.rate).max() < 1
    domain, odd = p.argmax(1), (got.copies - got.rate).to_numpy() * t
    for k in set(domain):
        assert abs(odd[domain == k].sum()) <= t[domain == k].max(), (k, odd[domain == k].sum())


def test_conflicting_labels_are_averaged(spark):
    docs = spark.createDataFrame([(k, text("ab"[k % 2])) for k in range(40)], "doc_id long, text string").withColumn("source", F.lit("s"))
    labels = spark.createDataFrame([(k, q, x) for k in range(40) for q, x in ([(0, 0), (1, 1)] if k % 2 else [(1, 0), (1, 0), (None, 1)])], "doc_id long, quality int, toxic int")
    got = mixing.mixing_rates(docs, labels).where("doc_id % 2 = 1").first()
    assert got.p_low > 0.4 and got.p_good_toxic > 0.4 and got.p_low_toxic < 0.05


def test_tied_documents_keep_totals(spark):
    from tabulark.llm.common import Scratch

    rows = [(10, [0.9, 0.1, 0.0, 0.0], 1.25, 0.5)] * 16 + [(7, [0.2, 0.8, 0.0, 0.0], 0.0, 0.1)] * 3
    up = mixing.thresholds(Scratch(spark).write(spark.createDataFrame(rows, "_tokens long, _p array<double>, _rate double, _draw double"), "tied"))
    assert set(up) == {1, 2}  # equal draws are rounded alike: all or none of 16


HIDDEN, SHOWN = "style='visibility:hidden'", "style='visibility:visible'"
TABLES = {
    "<table><tr><td rowspan=2>aa<td>b<td>c<tr><td>dd<td>e</table>": "aa  b   c\n    dd  e",
    "<table><tr><td>a<td rowspan=2>bb<td>c<tr><td>dd<td>e</table>": "a   bb  c\ndd      e",
    "<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</tbody><tbody><tr><td>e<td>f</tbody></table>": "a  b\n   c\n   d\ne  f",
    "<table><tr><td rowspan=2 colspan=2>wide<td>b<tr><td>c<tr><td>x<td>y<td>z</table>": "wide  b\n      c\nx  y  z",
    f"<table {HIDDEN}><tr><td>no<td {SHOWN}>yes<tr><td>no</table>": "yes",
    f"<div {HIDDEN}>no<table><tr {SHOWN}><td>a<td>b<tr><td>no</table></div>": "a  b",
    f"<table><thead {HIDDEN}><tr><td>no<tbody><tr style='visibility:collapse'><td>no<tr><td>a</table>": "a",
    f"<table><tr {HIDDEN}><td>no<td {SHOWN}>yes</table>": "yes",
    f"x<table {HIDDEN}><tr><td>no</table>": "x",
}


@pytest.mark.parametrize("page", TABLES)
def test_tables_span_rows_and_inherit_visibility(page):
    assert html_text.html_to_text(page).replace("\n\n", "\n").strip() == TABLES[page]


STYLES = {
    "<p style='display:none !important'>no</p><p>yes</p>": "yes",
    "<p style='visibility:hidden!important'>no</p><p>yes</p>": "yes",
    "<p style='display:none ! IMPORTANT; display:block'>no</p><p>yes</p>": "yes",
    "<p style='display:block !important; display:none'>yes</p>": "yes",
    "<p style='display:none; display:block'>yes</p>": "yes",
    "<p style='display:block; display:none'>no</p><p>yes</p>": "yes",
    "<p style='color:red !importantly; display'>yes</p>": "yes",
    "<div style='visibility:hidden !important'>no<b style='visibility:visible'>yes</b></div>": "yes",
}


@pytest.mark.parametrize("page", STYLES)
def test_important_declarations_win(page):
    assert html_text.html_to_text(page).strip() == STYLES[page]


def test_wide_cells_count_a_thousand_columns():
    node = lambda v: html_text._span(type("N", (), {"attrs": {"colspan": v}})(), "colspan")
    assert [node(v) for v in ("2", "99999", "9" * 400, "0", "000003", "-1", "x", "")] == [2, 1000, 1000, 1, 3, 1, 1, 1]
