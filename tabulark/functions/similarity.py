"""Similarities of texts and boxes. Sequence similarity is CPython's difflib, in Arrow batches, so callers must
narrow the pairs by keys first."""

from __future__ import annotations

import difflib
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """SequenceMatcher ratio, with its junk rule for long texts; not symmetric. Null counts as empty. A batch is gone through by its
    second texts, since the index that the matcher makes of one serves all pairs with it."""
    first, second, out = a.fillna("").tolist(), b.fillna("").tolist(), [0.0] * len(a)
    matcher, held = difflib.SequenceMatcher(), None
    for i in sorted(range(len(second)), key=second.__getitem__):
        if second[i] != held:
            matcher.set_seq2(held := second[i])
        matcher.set_seq1(first[i])
        out[i] = matcher.ratio()
    return pd.Series(out, dtype=float)


def ratio_reaches(a: Column, b: Column, at_least: float) -> Column:
    """Whether `sequence_ratio` is `at_least`; false where a side is null. Lengths and then counts of characters bound the
    ratio from above, so most pairs of long texts need no alignment, and equal texts none either."""

    @F.pandas_udf(T.BooleanType())
    def reaches(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(s, t):
            if s is None or t is None or s == t:
                return s is not None and s == t
            m = difflib.SequenceMatcher(None, s, t)
            return m.real_quick_ratio() >= at_least and m.quick_ratio() >= at_least and m.ratio() >= at_least

        return pd.Series([one(s, t) for s, t in zip(x, y)], dtype=bool)

    return reaches(a, b)


@F.pandas_udf(T.DoubleType())
def marker_coverage(marker: pd.Series, text: pd.Series) -> pd.Series:
    """Matched characters of the marker over its length; 1.0 when contained, null when either is empty."""

    def one(m, t):
        if not m or not t:
            return None
        if m in t:
            return 1.0
        return sum(k.size for k in difflib.SequenceMatcher(None, m, t).get_matching_blocks()) / len(m)

    return pd.Series([one(m, t) for m, t in zip(marker, text)], dtype=object)


def accept_marker(marker: Column, score: Column) -> Column:
    """Shorter markers need closer matches."""
    n = F.length(marker)
    return F.coalesce(score >= F.when(n <= 4, 0.95).when(n <= 8, 0.9).otherwise(0.8), F.lit(False))


def char_jaccard(a: Column, b: Column) -> Column:
    x, y = (F.array_distinct(F.split(F.trim(c), "")) for c in (a, b))
    both = F.size(F.array_intersect(x, y))
    return both / (F.size(x) + F.size(y) - both)


def hybrid_similarity(a: Column, b: Column) -> Column:
    """0.7 sequence ratio + 0.3 character Jaccard; 0 for empty texts and for length ratios under 0.3."""
    la, lb = F.length(F.trim(a)), F.length(F.trim(b))
    short = (la == 0) | (lb == 0) | (F.least(la, lb) / F.greatest(la, lb) < 0.3)
    return F.when(short, 0.0).otherwise(0.7 * sequence_ratio(F.trim(a), F.trim(b)) + 0.3 * char_jaccard(a, b))


BUCKETS, PAIRS = 128, 2048  # character counts of a text; pairs whose counts are compared at once


def hybrid_above(a: Column, b: Column, at_least: float) -> Column:
    """`hybrid_similarity` where it is above `at_least`, else null. Counts of characters, taken once for each text of a batch,
    bound the ratio from above; alignment then stops as soon as the blocks found and the counts of what lies between them
    cannot reach `at_least` any more."""

    @F.pandas_udf(T.DoubleType())
    def similarity(x: pd.Series, y: pd.Series) -> pd.Series:
        x, y, out = x.tolist(), y.tolist(), [None] * len(x)
        rows = []
        for i, (s, t) in enumerate(zip(x, y)):
            if s is not None and t is not None:
                if min(len(s), len(t)) == 0 or min(len(s), len(t)) / max(len(s), len(t)) < 0.3:
                    out[i] = 0.0 if at_least < 0 else None
                else:
                    rows.append(i)
        rows.sort(key=y.__getitem__)  # what the matcher makes of a second text serves all pairs with it
        texts = {t: k for k, t in enumerate(dict.fromkeys(t for i in rows for t in (x[i], y[i])))}
        codes, sets = [(np.frombuffer(t.encode("utf-32-le"), np.uint32) % BUCKETS).astype(np.intp) for t in texts], [set(t) for t in texts]
        counts = np.array([np.bincount(c, minlength=BUCKETS) for c in codes], np.int32).reshape(-1, BUCKETS)
        kinds = np.array([np.bincount([ord(c) % BUCKETS for c in s], minlength=BUCKETS) for s in sets], np.int32).reshape(-1, BUCKETS)
        matcher, held = difflib.SequenceMatcher(), None
        for at in range(0, len(rows), PAIRS):
            part, grams = rows[at : at + PAIRS], {}
            left, right = (np.array([texts[side[i]] for i in part]) for side in (x, y))
            most = np.minimum(counts[left], counts[right]).sum(1)
            both = np.minimum(kinds[left], kinds[right]).sum(1)
            length, kind = counts[left].sum(1) + counts[right].sum(1), kinds[left].sum(1) + kinds[right].sum(1)
            for k in np.flatnonzero(1.4 * most / length + 0.3 * both / (kind - both) > at_least - 1e-9).tolist():
                i, l, r, n = part[k], int(left[k]), int(right[k]), int(length[k])
                common = len(sets[l] & sets[r])
                jaccard = common / (len(sets[l]) + len(sets[r]) - common)
                if held != r:
                    matcher.set_seq2(y[i])
                    held = r
                matcher.set_seq1(x[i])
                own = (grams.setdefault(l, {}), grams.setdefault(r, {})) if len(y[i]) < 200 else None
                matched = _matched(matcher, codes[l], codes[r], own, int(most[k]), (at_least - 1e-9 - 0.3 * jaccard) / 1.4 * n)
                if matched is not None and (found := 0.7 * (2.0 * matched / n) + 0.3 * jaccard) > at_least:
                    out[i] = found
        return pd.Series(out, dtype=object)

    return similarity(a, b)


def _matched(matcher: difflib.SequenceMatcher, a: np.ndarray, b: np.ndarray, grams: tuple | None, most: int, above: float) -> int | None:
    """Characters in the matcher's blocks; None once they cannot be more than `above`. Spans with most to gain come first, which changes
    no block, since the blocks of one span do not depend on another's."""
    spans, reach = [(-most, 0, len(a), 0, len(b))], most
    while spans and reach > above:
        gain, alo, ahi, blo, bhi = heapq.heappop(spans)
        i, j, n = _longest(matcher.a, matcher.b, *grams) if grams else matcher.find_longest_match(alo, ahi, blo, bhi)
        grams, reach = None, reach + gain + n
        for span in ((alo, i, blo, j), (i + n, ahi, j + n, bhi)) if n else ():
            if span[0] < span[1] and span[2] < span[3]:
                own = int(np.minimum(np.bincount(a[span[0] : span[1]], minlength=BUCKETS), np.bincount(b[span[2] : span[3]], minlength=BUCKETS)).sum())
                if own:
                    heapq.heappush(spans, (-own, *span))
                    reach += own
    return reach if reach > above else None


def _longest(s: str, t: str, own: dict[int, set], others: dict[int, set]) -> tuple[int, int, int]:
    """What difflib finds first in texts without popular characters: their longest common part, first in s and then in t. Sets of
    parts of one length are kept for all pairs of a text."""

    def parts(text: str, held: dict[int, set], k: int) -> set:
        if k not in held:
            held[k] = {text[p : p + k] for p in range(len(text) - k + 1)}
        return held[k]

    n, over, found, k = 0, min(len(s), len(t)) + 1, (), min(6, len(s), len(t))
    while n + 1 < over:
        common = parts(s, own, k) & parts(t, others, k)
        n, over, found = (k, over, common) if common else (n, k, found)
        k = n + 1 if 0 < n < 12 else min(2 * n or over, (n + over) // 2)
    i = min(map(s.find, found), default=0)
    return i, t.find(s[i : i + n]), n


def chunks_found(text: Column, other: Column, size: int = 40) -> Column:
    """Number of the text's `size`-character pieces that `other` contains, of `n_chunks`; repeated pieces count each time. Pieces are looked up
    among the windows of `other`, so that work follows the lengths of both and not their product."""

    @F.pandas_udf(T.LongType())
    def found_in(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(s, t):
            s, t = s or "", t or ""
            pieces = [s[i : i + size] for i in range(0, len(s), size)]
            found = set(pieces).intersection(t[i : i + size] for i in range(len(t) - size + 1))
            if pieces and len(pieces[-1]) < size and pieces[-1] in t:
                found.add(pieces[-1])
            return sum(p in found for p in pieces)

        return pd.Series([one(s, t) for s, t in zip(a, b)], dtype="int64")

    return found_in(text, other)


def n_chunks(text: Column, size: int = 40) -> Column:
    """Number of the text's `size`-character pieces, the last one of any length; null for a null text."""
    return F.ceil(F.length(text) / size)


def chunk_coverage(text: Column, other: Column, size: int = 40) -> Column:
    """Share of the text's `size`-character pieces that `other` contains; null for an empty text."""
    return F.when(F.length(text) > 0, chunks_found(text, other, size) / n_chunks(text, size))


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of structs (x1, y1, x2, y2); 0 for empty boxes."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    inter = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    area = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - inter
    return F.when(area > 0, inter / area).otherwise(0.0)


def center(box: Column) -> Column:
    return F.struct(((box["x1"] + box["x2"]) / 2).alias("x"), ((box["y1"] + box["y2"]) / 2).alias("y"))


def center_distance(a: Column, b: Column) -> Column:
    p, q = center(a), center(b)
    return F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2))


def grid(x: Column, step: int = 10) -> Column:
    """Nearest multiple of `step`, halves to the even multiple."""
    return (F.bround(x / step) * step).cast("int")


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.when(norm(a) * norm(b) > 0, dot / (norm(a) * norm(b)))
