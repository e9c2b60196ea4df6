"""Exact statistics of one text, shared by the quality operators."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np

SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
DIGITS = np.frombuffer(b"0123456789", np.uint8)
PUNCTUATION = np.frombuffer(b".,;:!?", np.uint8)
ENDS = (".", "!", "?", '"', "”", "»")


@dataclass
class TextStats:
    """Statistics of a whole text. Letters beyond ASCII are counted as characters beyond ASCII; capitals are
    A-Z and those of Latin-1."""

    n_chars: int = 0
    n_words: int = 0
    word_chars: int = 0
    n_symbols: int = 0
    n_dup_lines: int = 0
    n_repeat_words: int = 0
    letters: int = 0
    upper: int = 0
    digits: int = 0
    punctuation: int = 0
    markup: int = 0
    n_lines: int = 0
    ended_lines: int = 0
    distinct: list[bytes] = field(default_factory=list)
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def repeat_words(ids: np.ndarray, distinct: int) -> int:
    """Words in a window of three words that is found twice or more, the first one included. `ids` number the
    words of the text; a window is one exact integer while distinct**3 fits in 63 bits."""
    if len(ids) < 4:
        return 0
    if distinct < 2**21:
        key = (ids[:-2] * distinct + ids[1:-1]) * distinct + ids[2:]
        ordered = np.sort(key)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            return 0
        hit = np.isin(key, twice)
    else:
        windows = list(zip(ids[:-2].tolist(), ids[1:-1].tolist(), ids[2:].tolist()))
        seen = Counter(windows)
        hit = np.array([seen[w] > 1 for w in windows])
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def text_stats(text: str | None) -> TextStats:
    if not text:
        return TextStats()
    raw = text.encode()
    words = raw.split()
    n = len(words)
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, n)
    counts = np.bincount(ids, minlength=len(numbers)) if n else np.zeros(0, np.int64)
    data = np.frombuffer(raw, np.uint8)
    hist = np.bincount(data, minlength=256)
    spaces = int(hist[32] + hist[9:14].sum())
    latin = data[1:][data[:-1] == 0xC3] if hist[0xC3] else data[:0]
    seen, dup, lines, ended = set(), 0, 0, 0
    for line in text.split("\n"):
        bare = line.rstrip(" \t\x0b\x0c\r")
        if not bare:
            continue
        lines += 1
        ended += bare.endswith(ENDS)
        if line in seen:
            dup += 1
        else:
            seen.add(line)
    return TextStats(
        n_chars=len(text), n_words=n, word_chars=len(text) - spaces, n_symbols=int(hist[SYMBOLS].sum()), n_dup_lines=dup,
        n_repeat_words=repeat_words(ids, len(numbers)), letters=int(hist[65:91].sum() + hist[97:123].sum() + hist[0xC3:].sum()),
        upper=int(hist[65:91].sum() + (latin < 0x9F).sum()), digits=int(hist[DIGITS].sum()), punctuation=int(hist[PUNCTUATION].sum()),
        markup=int(hist[124] + hist[60] + hist[123]), n_lines=lines, ended_lines=ended, distinct=list(numbers), counts=counts,
    )
