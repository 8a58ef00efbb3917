"""Token counts of the sections of a document, from one encoding of the whole.

A document is encoded once. Token spans, in characters, are joined with section
spans; a token that crosses a boundary is allocated by a stated rule:

* ``majority``: the section with most of its characters, the earlier in a tie;
* ``first``: the section with its first character;
* ``split``: shares in proportion to the characters in each section.

Characters in no section count for the section named null. Defined cases: a null
or empty text gives one row with section null and zero counts; rows with null or
repeated ids each give their own rows; other columns are ignored. A very long
text is encoded whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm import bpe
from gridloom.llm.common import few_rows

RULES = ("majority", "first", "split")
Section = tuple[str | None, int, int]


def line_sections(text: str) -> list[Section]:
    """The first line is the title; others are table rows or body."""
    out: list[Section] = []
    start = 0
    while start < len(text):
        end = text.find("\n", start) + 1 or len(text)
        name = "title" if start == 0 else "table" if text.count("|", start, end) > 1 else "body"
        if out and out[-1][0] == name:
            out[-1] = (name, out[-1][1], end)
        else:
            out.append((name, start, end))
        start = end
    return out


def token_spans(text: str, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of every token; bytes of one character share it."""
    ends = lengths[ids].cumsum()
    starts = ends - lengths[ids]
    if text.isascii():
        return starts, ends
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    char = ((raw & 0xC0) != 0x80).cumsum() - 1
    return char[starts], char[ends - 1] + 1


def allocate(starts: np.ndarray, ends: np.ndarray, sections: list[Section], length: int, rule: str) -> list[tuple[str | None, float, int, int]]:
    """(section, tokens, characters, crossing tokens) by name; spans in order."""
    spans: list[Section] = []
    done = 0
    for name, a, b in sorted(sections, key=lambda s: s[1]):
        if a > done:
            spans.append((None, done, a))
        if b > max(a, done):
            spans.append((name, max(a, done), b))
        done = max(done, b)
    if done < length:
        spans.append((None, done, length))
    left = np.array([s[1] for s in spans])
    first, last = (np.searchsorted(left, x, side="right") - 1 for x in (starts, ends - 1))
    inside = first == last
    tokens = np.bincount(first[inside], minlength=len(spans)).astype(float)
    crossing = np.zeros(len(spans), np.int64)
    for i in np.flatnonzero(~inside):
        held = [(min(ends[i], spans[k][2]) - max(starts[i], spans[k][1]), k) for k in range(first[i], last[i] + 1)]
        if rule == "split":
            for n, k in held:
                tokens[k] += n / (ends[i] - starts[i])
            to = first[i]
        else:
            to = first[i] if rule == "first" else max(held, key=lambda x: (x[0], -x[1]))[1]
            tokens[to] += 1
        crossing[to] += 1
    out: dict[str | None, list] = {}
    for k, (name, a, b) in enumerate(spans):
        row = out.setdefault(name, [0.0, 0, 0])
        row[0] += tokens[k]
        row[1] += b - a
        row[2] += int(crossing[k])
    return [(name, *row) for name, row in out.items()]


def attribute(docs: DataFrame, sections: Callable[[str], list[Section]] = line_sections, rule: str = "majority", path: str | None = None) -> DataFrame:
    """(doc_id, section, n_tokens, n_chars, n_crossing) by document and section."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}; known: {', '.join(RULES)}")
    sent = bpe.shipped(docs, path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            out: list[list] = [[] for _ in range(5)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(None, 0.0, 0, 0)]
                if text:
                    spans = token_spans(text, sent.value.encode(text), sent.value.lengths)
                    rows = allocate(*spans, sections(text), len(text), rule)
                for row in rows:
                    for column, value in zip(out, (doc_id, *row), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "section", "n_tokens", "n_chars", "n_crossing"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, section string, n_tokens double, n_chars long, n_crossing long")
