"""Byte-level BPE, encoding and decoding, from a public rank file.

A text is split by the vocabulary's pattern. Each piece is looked up whole in a
minimal perfect hash of the vocabulary (first tier). A piece that is no
vocabulary entry is merged from single bytes: a heap holds the ranks of
neighbouring parts, a linked list holds the parts (second tier), so a piece of
n bytes takes O(n log n) however long it is.

Defined cases: a null or empty text has no ids and decodes to the empty string;
null ids and repeated rows are passed on, each row by itself; a very long text,
or one without a break, is encoded whole by the heap; of pairs that tie in rank
the leftmost merges first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import xxhash
from pyspark.sql import DataFrame

from gridloom.llm.common import few_rows

RANK_FILE = "byte_bpe_50k.tiktoken"
#: Encodings of recent pieces that a worker remembers; a memory bound only.
REMEMBERED = 400_000

_ANY = regex.compile(public_tokenizers.PATTERN)


def _narrow_pattern(below: int = 0x250) -> tuple[re.Pattern, re.Pattern]:
    """The same pattern for texts whose code points are all under ``below``."""
    kinds: dict[str, list[str]] = {"L": [], "N": []}
    for c in map(chr, range(below)):
        kinds.setdefault(unicodedata.category(c)[0], []).append(c)
    letters, numbers = ("".join(map(re.escape, kinds[k])) for k in "LN")
    space = "".join(re.escape(chr(c)) for c in range(below) if regex.match(r"\s", chr(c)))
    pattern = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")
    return re.compile(pattern), re.compile(f"[^\x00-{chr(below - 1)}]")


_NARROW, _WIDE_CHAR = _narrow_pattern()


def pieces(text: str) -> list[str]:
    """The matches of the vocabulary's pattern, in order."""
    return (_ANY if _WIDE_CHAR.search(text) else _NARROW).findall(text)


@dataclass
class PerfectHash:
    """Hash and displace: every key has a slot of its own, no slot is free.

    Keys fall into buckets; for each bucket, largest first, a displacement is
    searched that sends its keys to free slots. One-key buckets take what is
    left: their displacement names the slot itself, as a negative number.
    """

    displace: list[int]
    keys: list[bytes]
    ids: list[int]

    @classmethod
    def build(cls, entries: dict[bytes, int]) -> PerfectHash:
        n = len(entries)
        buckets: list[list[tuple[int, bytes]]] = [[] for _ in range(max(1, n // 3))]
        for key in entries:
            h = xxhash.xxh3_64_intdigest(key)
            buckets[h % len(buckets)].append((h, key))
        displace, keys = [0] * len(buckets), [b""] * n
        free = bytearray(b"\1") * n
        order = sorted(range(len(buckets)), key=lambda b: -len(buckets[b]))
        for b in order:
            if len(buckets[b]) < 2:
                break
            d = 0
            while True:
                slots = {cls._slot(h, d, n) for h, _ in buckets[b]}
                if len(slots) == len(buckets[b]) and all(free[s] for s in slots):
                    break
                d += 1
            displace[b] = d
            for h, key in buckets[b]:
                s = cls._slot(h, d, n)
                free[s], keys[s] = 0, key
        left = iter([s for s in range(n) if free[s]])
        for b in order:
            if len(buckets[b]) == 1:
                s = next(left)
                displace[b], keys[s] = -s - 1, buckets[b][0][1]
        return cls(displace, keys, [entries[k] for k in keys])

    @staticmethod
    def _slot(h: int, d: int, n: int) -> int:
        x = h ^ (d * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        return (x >> 32) % n

    def get(self, key: bytes) -> int | None:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displace[h % len(self.displace)]
        s = -d - 1 if d < 0 else self._slot(h, d, len(self.keys))
        return self.ids[s] if self.keys[s] == key else None


class Vocabulary:
    """Ranks with both tiers; sent to the workers once, bounded by its file."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.whole = PerfectHash.build(self.ranks)
        self.prepare()

    def __getstate__(self):
        return {"whole": self.whole}

    def __setstate__(self, state):
        self.whole = state["whole"]
        self.ranks = dict(zip(self.whole.keys, self.whole.ids, strict=True))
        self.prepare()

    def prepare(self) -> None:
        self.by_decimal = {str(i): b for b, i in self.ranks.items()}
        self.lengths = np.zeros(max(self.ranks.values(), default=0) + 1, np.int64)
        for b, i in self.ranks.items():
            self.lengths[i] = len(b)
        self.known = _Remembered(self)

    def merge(self, piece: bytes) -> list[int]:
        """Second tier: merge the neighbours of lowest rank, leftmost first."""
        get, n = self.ranks.get, len(piece)
        end = list(range(1, n + 1))  # of the part that starts here; 0 if it was merged away
        before = list(range(-1, n))
        bits = n.bit_length()
        twice, low = 2 * bits, (1 << bits) - 1
        # heap entries are (rank, start, stop) packed into one integer
        heap = [r << twice | i << bits | i + 2 for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            x = heappop(heap)
            stop = x & low
            i = x >> bits & low
            mid = end[i]
            if not mid or mid >= stop or end[mid] != stop:
                continue  # one of the two parts has been merged meanwhile
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := get(piece[i : (e := end[stop])])) is not None:
                    heappush(heap, r << twice | i << bits | e)
            if i and (r := get(piece[(j := before[i]) : stop])) is not None:
                heappush(heap, r << twice | j << bits | stop)
        return [get(piece[i:e]) for i, e in enumerate(end) if e]

    def encode_piece(self, piece: bytes) -> list[int]:
        found = self.whole.get(piece)
        return [found] if found is not None else self.merge(piece)

    def encode_decimal(self, text: str | None) -> str:
        """The ids as decimals, joined by single spaces."""
        return " ".join(map(self.known.__getitem__, pieces(text))) if text else ""

    def encode(self, text: str | None) -> np.ndarray:
        return np.array(self.encode_decimal(text).split(), np.int32)

    def decode_decimal(self, ids: str) -> bytes:
        return b"".join(map(self.by_decimal.__getitem__, ids.split())) if ids else b""

    def decode(self, ids) -> bytes:
        return b"".join(self.by_decimal[str(i)] for i in ids)


class _Remembered(dict):
    """Piece to decimal ids; forgets everything when it gets too large."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> str:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = " ".join(map(str, self.vocabulary.encode_piece(piece.encode("utf-8", "replace"))))
        if len(piece) <= 64:
            self[piece] = ids
        return ids


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str | None = None) -> Vocabulary:
    """On the driver: the vocabulary of a rank file, built once."""
    path = path or public_tokenizers.path(RANK_FILE)
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


class Shipped:
    """A vocabulary on its way to the tasks, broadcast; its size is its file's.

    A worker keeps one vocabulary, with what it remembers, over all tasks and
    broadcasts of the same file.
    """

    def __init__(self, docs: DataFrame, path: str | None):
        self.path = path or public_tokenizers.path(RANK_FILE)
        self.sent = docs.sparkSession.sparkContext.broadcast(vocabulary(self.path))

    @property
    def value(self) -> Vocabulary:
        if self.path not in _LOADED:
            _LOADED.clear()
            _LOADED[self.path] = self.sent.value
        return _LOADED[self.path]


def shipped(docs: DataFrame, path: str | None = None) -> Shipped:
    return Shipped(docs, path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) for every row of ``docs``."""
    sent = shipped(docs, path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            ids = [sent.value.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); bytes that are no UTF-8 are replaced."""
    sent = shipped(encoded, path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            texts = [sent.value.decode(ids or ()).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")


def summarize(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Token count, digest of the ids and digest of what they decode to."""
    sent = shipped(docs, path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids = sent.value.encode_decimal(text)
                n.append(ids.count(" ") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(sent.value.decode_decimal(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
