"""Byte-level BPE by prefix dynamic programming, and back.

A piece of text (a match of the vocabulary's pattern) has one encoding, and so has every prefix of its bytes. For each
prefix its last token is stored. The last token of the next prefix is the one token ending there that may stand behind
the last token of what remains without it: `stands` undoes the merges inside both tokens, latest first, and sees
whether the bytes at the border would have been merged before. The ids follow by walking back from the end.

The table makes changes cheap and exact: what is appended only adds entries, and behind an edit the entries are the old
ones again once as many in a row as the longest token has bytes agree (`PrefixTable.replace`). `EncodedText` does the
same for whole texts, whose pieces are found anew only next to the edit.

Inside a task the distinct new pieces of a batch are encoded in sorted order, so that each takes over the entries of the
prefix it shares with the one before, and are remembered, within a bound. Long texts are taken in parts that end where
white space begins, which is always a border of pieces, and long pieces need a pass over their bytes.

Defined cases: null and empty texts have no tokens; equal rows get equal ids; a table without rows gives none; other
columns are not read. A text's ids must fit an Arrow value (2 GB, 500 million tokens).
"""

from __future__ import annotations

import base64
from array import array
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulark.llm.common import _batch, bound_batches, sub_batches, tidy

NONE = 1 << 32


class Vocabulary:
    """The tokens of a rank file (`base64 rank` in each line), the merge that makes each, and the pattern of pieces. `most` bounds
    each of the memories: of pieces (two generations), of pairs and of the automaton's steps."""

    def __init__(self, path: str, pattern: str, most: int = 150_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("every byte must be a token")
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, self.ranks))
        self.pattern, self.border = regex.compile(pattern), regex.compile(r"(?<=\S)(?=\s)")
        self.young, self.old, self.pairs, self.most = {}, {}, {}, most
        # made[t]: when t comes about; -1 for bytes, which are there from the start.
        self.made, self.left, self.right = [-1] * size, [0] * size, [0] * size
        # No merges make the other tokens; each of them only ever is a whole piece.
        self._automaton([r for r, token in enumerate(self.tokens) if token and (len(token) == 1 or self._split(r, token))])

    def _split(self, rank: int, token: bytes) -> bool:
        for at in range(1, len(token)):
            a, b = self.ranks.get(token[:at], NONE), self.ranks.get(token[at:], NONE)
            if a < rank and b < rank and self.stands(a, b, rank):
                self.made[rank], self.left[rank], self.right[rank] = rank, a, b
                return True
        return False

    def _automaton(self, tokens: list[int]) -> None:
        """Places in a trie of the tokens: where a byte leads, the longest token that ends at a place (`ending`), and the next
        shorter one that ends where a token does (`shorter`)."""
        self.child, nodes, place = {}, 1, {}
        for t in tokens:
            at = 0
            for byte in self.tokens[t]:
                if (key := at << 8 | byte) not in self.child:
                    self.child[key], nodes = nodes, nodes + 1
                at = self.child[key]
            place[at] = t
        self.fail, self.ending, self.shorter, self.steps = [0] * nodes, [-1] * nodes, [-1] * len(self.tokens), {}
        below = {}
        for key, at in self.child.items():
            below.setdefault(key >> 8, []).append((key & 255, at))
        level = below[0]  # these fall back on the root
        while level:
            for _, at in level:
                back = self.ending[self.fail[at]]
                if at in place:
                    self.ending[at] = place[at]
                    self.shorter[place[at]] = back
                else:
                    self.ending[at] = back
                for byte, deeper in below.get(at, ()):
                    self.fail[deeper] = self.step(self.fail[at], byte)
            level = [pair for _, at in level for pair in below.get(at, ())]

    def step(self, at: int, byte: int) -> int:
        child, fail, start = self.child, self.fail, at
        while at and (at << 8 | byte) not in child:
            at = fail[at]
        found = child.get(at << 8 | byte, 0)
        if start != at:
            if len(self.steps) > self.most:
                self.steps.clear()
            self.steps[start << 8 | byte] = found
        return found

    def stands(self, a: int, b: int, before: int = NONE) -> bool:
        """Whether a and b come out side by side if merges are made up to rank `before`."""
        made, tokens, ranks = self.made, self.tokens, self.ranks
        while True:
            joined = ranks.get(tokens[a] + tokens[b])
            if joined is not None and joined < before:
                return False
            if made[a] > made[b]:
                before, a = made[a], self.right[a]
            elif made[b] >= 0:  # of equal merges the left one comes first, so the border would come before b's
                before, b = made[b] + 1, self.left[b]
            else:
                return True

    def extend(self, last: list[int], places: list[int], data: bytes, until=None) -> None:
        """Add the entries of data's prefixes that `last` does not have yet; `places` are those of the automaton behind each prefix,
        the empty one first. With `until`, stop once until(last) says so."""
        child, steps, ending, tokens, shorter, pairs = self.child, self.steps, self.ending, self.tokens, self.shorter, self.pairs
        n = len(last)
        at = places[n]
        for byte in data[n:]:
            key = at << 8 | byte
            at = child.get(key) or steps.get(key)
            if at is None:
                at = self.step(key >> 8, byte)
            places.append(at)
            n += 1
            token = ending[at]
            while (rest := n - len(tokens[token])) > 0:
                pair = last[rest - 1] << 32 | token
                ok = pairs.get(pair)
                if ok is None:
                    if len(pairs) > self.most:
                        pairs.clear()
                    ok = pairs[pair] = self.stands(last[rest - 1], token)
                if ok:
                    break
                token = shorter[token]
            last.append(token)
            if until and until(last):
                return

    def walk(self, last: list[int], data: bytes) -> list[int]:
        """The ids of a piece from its table."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        ids, at = [], len(last)
        while at:
            ids.append(last[at - 1])
            at -= len(self.tokens[ids[-1]])
        ids.reverse()
        return ids

    def learn(self, pieces: set[str], short: int = 64) -> dict[str, bytes]:
        """The ids, as little-endian 32-bit numbers, of pieces that are not known. Short ones are remembered."""
        found, last, places, before = {}, [], [0], b""
        for data in sorted(p.encode() for p in pieces):
            shared, most = 0, min(len(before), len(data))
            while shared < most and before[shared] == data[shared]:
                shared += 1
            del last[shared:], places[shared + 1 :]
            self.extend(last, places, data)
            found[data.decode()] = array("I", self.walk(last, data)).tobytes()
            before = data
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        self.young.update((p, ids) for p, ids in found.items() if len(p) <= short)
        return found

    def parts(self, text: str, size: int = 1 << 20):
        """The text in parts of about `size` characters that end at borders of pieces."""
        at = 0
        while at < len(text):
            found = self.border.search(text, at + size) if len(text) - at > size else None
            end = found.start() if found else len(text)
            yield text[at:end]
            at = end

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, one after another."""
        out = [[] for _ in texts]
        split, waiting, held = self.pattern.findall, [], 0

        def settle():
            seen = {p for _, pieces in waiting for p in pieces}
            known = {p: ids for p in seen if (ids := self.young.get(p) or self.old.get(p))}
            self.young.update((p, ids) for p, ids in known.items() if p not in self.young)
            known |= self.learn(seen - known.keys())
            for k, pieces in waiting:
                out[k].append(b"".join(map(known.__getitem__, pieces)))
            waiting.clear()

        for k, text in enumerate(texts):
            for part in self.parts(text or ""):
                waiting.append((k, split(part)))
                held += len(part)
                if held > 1 << 21:
                    settle()
                    held = 0
        settle()
        return [b"".join(found) for found in out]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


class PrefixTable:
    """The last token of every prefix of one piece's bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes):
        self.vocabulary, self.data, self.last, self.work = vocabulary, b"", array("I"), 0  # four bytes an entry
        self.append(data)

    def append(self, data: bytes) -> None:
        self.replace(len(self.data), len(self.data), data)

    def replace(self, start: int, stop: int, data: bytes) -> None:
        """Put `data` in the place of bytes start to stop. `work` counts the entries computed."""
        old, shift = self.last, len(data) - (stop - start)
        self.data = self.data[:start] + data + self.data[stop:]
        last, clear, alike = old[:start].tolist(), start + len(data), 0

        def again(found: list[int]) -> bool:
            nonlocal alike
            at = len(found)
            alike = alike + 1 if at > clear and found[-1] == old[at - 1 - shift] else 0
            return alike >= self.vocabulary.longest

        at, places = 0, [0] * (start + 1)
        for byte in self.data[max(0, start - self.vocabulary.longest) : start]:  # no token is longer
            at = self.vocabulary.step(at, byte)
        places[start] = at
        self.vocabulary.extend(last, places, self.data, again)
        self.work += len(last) - start
        self.last = array("I", last)
        if len(last) < len(self.data):
            self.last += old[len(last) - shift :]

    def ids(self) -> list[int]:
        return self.vocabulary.walk(self.last, self.data)


class EncodedText:
    """A text whose ids stay exact through appends and edits."""

    def __init__(self, vocabulary: Vocabulary, text: str):
        self.vocabulary, self.text = vocabulary, text
        self.starts, self.tables = [], []
        for m in vocabulary.pattern.finditer(text):
            self.starts.append(m.start())
            self.tables.append(PrefixTable(vocabulary, m.group().encode()))

    def append(self, text: str) -> None:
        self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, stop: int, text: str) -> None:
        """Put `text` in the place of characters start to stop. A piece is fixed by its own characters and at most one behind
        its end and the next, so pieces that end two characters before the edit stay; behind it they stay from the first border that
        is an old one."""
        shift, old = len(text) - (stop - start), self.starts
        self.text = self.text[:start] + text + self.text[stop:]
        first = max(0, bisect_right(old, max(0, start - 2)) - 1)
        begin = old[first] if old else 0
        place = {s: k for k, s in enumerate(old[first:], first) if s >= stop}
        starts, tables, rest = [], [], len(old)
        for m in self.vocabulary.pattern.finditer(self.text, begin):
            if m.start() >= start + len(text) and m.start() - shift in place:
                rest = place[m.start() - shift]
                break
            data = m.group().encode()
            if not starts and first < len(old) and begin < start:  # a piece that the edit may have hit: its own table goes on
                table = self.tables[first]
                head, tail = alike(table.data, data)
                table.replace(head, len(table.data) - tail, data[head : len(data) - tail])
            else:
                table = PrefixTable(self.vocabulary, data)
            starts.append(m.start())
            tables.append(table)
        self.starts = old[:first] + starts + [s + shift for s in old[rest:]]
        self.tables = self.tables[:first] + tables + self.tables[rest:]

    def ids(self) -> list[int]:
        return [i for table in self.tables for i in table.ids()]


def alike(a: bytes, b: bytes) -> tuple[int, int]:
    """How many bytes a and b share at their beginning and, apart from these, at their end."""
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    differ = np.flatnonzero(x[:n] != y[:n])
    head = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(x[len(x) - (n - head) :][::-1] != y[len(y) - (n - head) :][::-1])
    return head, int(differ[0]) if len(differ) else n - head


_WORKER: dict[tuple[str, str], Vocabulary] = {}


def worker_vocabulary(path: str, pattern: str) -> Vocabulary:
    """The vocabulary of this Python worker with what it remembers; a worker serves many tasks."""
    if (path, pattern) not in _WORKER:
        _WORKER.clear()
        _WORKER[path, pattern] = Vocabulary(path, pattern)
    return _WORKER[path, pattern]


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


ENCODED_DDL, ENCODED = "doc_id long, n_tokens long, ids binary", pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
DECODED_DDL, DECODED = f"{ENCODED_DDL}, decoded binary", ENCODED.append(pa.field("decoded", pa.binary()))


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian, 32 bits each) for every row of `docs`."""
    bound_batches(docs.sparkSession)
    path, pattern = (path, pattern) if path else public_vocabulary()

    def run(batches):
        vocabulary = worker_vocabulary(path, pattern)
        for whole in batches:
            for part in sub_batches(whole, 3_000_000):
                found = vocabulary.encode_all(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(ids) // 4 for ids in found], pa.int64()), pa.array(found, pa.binary())], schema=ENCODED)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(tidy(run), ENCODED_DDL)


def decoded(tokens: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The rows of `encoded` with `decoded`, the bytes that the ids stand for."""
    path, pattern = (path, pattern) if path else public_vocabulary()

    def run(batches):
        vocabulary = worker_vocabulary(path, pattern)
        for whole in batches:
            for part in sub_batches(whole, 3_000_000):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([vocabulary.decode(ids) for ids in part.column(2).to_pylist()], pa.binary())], schema=DECODED)

    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(tidy(run), DECODED_DDL)


def edited(docs: DataFrame, edits: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids, text of the documents that have edits (doc_id, seq, start, stop, text: characters start to stop of what the
    earlier edits left are replaced), re-encoded near the edits only. Null ids have no edits; an edit past the end appends."""
    bound_batches(docs.sparkSession)
    path, pattern = (path, pattern) if path else public_vocabulary()
    steps = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "stop", F.coalesce("text", F.lit("")).alias("text")))).alias("steps"))
    both = docs.select("doc_id", "text").join(steps, "doc_id")

    def run(batches):
        vocabulary = worker_vocabulary(path, pattern)
        for whole in batches:
            for part in sub_batches(whole, 3_000_000):
                rows = []
                for doc_id, text, changes in zip(*(c.to_pylist() for c in part.columns)):
                    held = EncodedText(vocabulary, text or "")
                    for e in changes:
                        held.replace(min(e["start"], len(held.text)), min(e["stop"], len(held.text)), e["text"])
                    ids = np.array(held.ids(), "<u4").tobytes()
                    rows.append((doc_id, len(ids) // 4, ids, held.text))
                yield _batch(rows, ENCODED.append(pa.field("text", pa.string())))

    return both.mapInArrow(tidy(run), f"{ENCODED_DDL}, text string")


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of `docs`."""
    found = decoded(encoded(docs))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
