"""Personal data: patterns propose spans, checksums confirm, context scores.

Kinds ``email``, ``ip``, ``card`` and ``phone`` are the base: a match of the
pattern that passes its check is always a span. Kinds ``iban``, ``ssn`` and
``local_phone`` are proposed by looser patterns and stay only if their own check
holds (length by country and mod-97; number ranges that are given out; area codes
that exist), their score, adjusted by nearby context words, reaches ``THRESHOLD``,
and no base span or earlier kind covers a part of them.

Defined cases: a null or empty text has no spans; a null id is passed on; rows
with the same id each get their own result; a very long text is searched whole, in
time that grows with its length and the logarithm of its number of spans;
of added spans that tie for a place the earlier kind stays; an empty table gives
no rows; other columns of the input, whatever their names, are ignored by
:func:`find_spans` and untouched by :func:`redact`.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.common import few_rows

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban", "local_phone", "ssn")
KINDS = BASE_KINDS + EXTRA_KINDS
#: A span counts if its score reaches this; base kinds start above it.
THRESHOLD = 0.5
#: Context words are looked for in so many characters on either side.
REACH = 40

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?=\x20?[A-Z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")

#: Characters of an international account number, by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29,
    "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22,
    "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: What follows country and check digits, by the number of characters.
_IBAN_REST = {n: re.compile(rf"(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in set(IBAN_LENGTHS.values())}

#: Words near a span that make its kind likelier, by kind.
CONTEXT = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "payment", "pay"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer", "konto", "compte"),
    "local_phone": ("phone", "call", "tel", "mobile", "fax", "cell", "telefon"),
    "ssn": ("ssn", "social", "security", "insurance"),
}
_NEARBY = {kind: re.compile(rf"(?<![a-z])(?:{'|'.join(words)})") for kind, words in CONTEXT.items()}
#: Score of a proposal before context, by kind. Context adds 0.3.
PRIOR = {"email": 0.7, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.6, "local_phone": 0.3, "ssn": 0.3}


def luhn(digits: str) -> bool:
    """Whether the last digit is the Luhn check digit of the others."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        n = ord(digit) - 48
        total += n if place % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The check of international account numbers (remainder 1 modulo 97)."""
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def issued_ssn(digits: str) -> bool:
    """Whether area, group and serial number are of those given out."""
    area, group, serial = digits[:3], digits[3:5], digits[5:]
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def area_code(digits: str) -> bool:
    """Whether ten digits start with a code of an area: no 0 or 1 first, no 9 in the middle, no N11."""
    return digits[0] >= "2" and digits[1] != "9" and digits[1:3] != "11"


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches, found from each '@' so that long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        found = _EMAIL.match(text, start) if start < at else None
        if found:
            yield found.span()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _digits(m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m.group())) <= 15:
                yield m.span()


def _score(kind: str, text: str, start: int, end: int) -> float:
    near = f"{text[max(0, start - REACH):start]} {text[end:end + REACH]}".lower()
    return min(1.0, PRIOR[kind] + 0.3 * bool(_NEARBY[kind].search(near)))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in _IBAN.finditer(text):
        length = IBAN_LENGTHS.get(m.group(1))
        rest = _IBAN_REST[length].match(text, m.end()) if length and m.start() >= done else None
        if rest and mod97(text[m.start() : rest.end()].replace(" ", "")):
            yield m.start(), rest.end()
            done = rest.end()


def _local_phones(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in _LOCAL_PHONE.finditer(text) if area_code(_digits(m.group())))


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in _SSN.finditer(text) if issued_ssn(_digits(m.group())))


def _stretches(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint stretches that the spans cover, in order."""
    starts, ends = [], []
    for s, e in sorted(spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def spans_of(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as listed, then start; ends exclusive."""
    if not text:
        return []
    found = []
    for kind, search in zip(BASE_KINDS, (_emails, _ips, _cards, _phones), strict=True):
        found += [(kind, s, e, _score(kind, text, s, e)) for s, e in search(text)]
    for kind, search in zip(EXTRA_KINDS, (_ibans, _local_phones, _ssns), strict=True):
        more = [(kind, s, e, _score(kind, text, s, e)) for s, e in search(text)]
        if more:  # spans of one kind never overlap, so a kind is held against those before it
            starts, ends = _stretches([x[1:3] for x in found])
            last = [bisect_left(starts, e) - 1 for _, _, e, _ in more]
            found += [x for x, i in zip(more, last, strict=True) if x[3] >= THRESHOLD and (i < 0 or ends[i] <= x[1])]
    return found


SPANS_SCHEMA = "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row of ``docs``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            spans = [[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in spans_of(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPAN)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(work, SPANS_SCHEMA)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def summarize(docs: DataFrame) -> DataFrame:
    """Counts by base kind, digest of the base spans, and all spans as text."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, top_score double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            out: list[list] = [[] for _ in range(8)]
            for text in batch.column(1).to_pylist():
                found = spans_of(text)
                plain = [(k, s, e) for k, s, e, _ in found]
                base = [x for x in plain if x[0] in BASE_KINDS]
                for i, kind in enumerate(BASE_KINDS):
                    out[i].append(sum(x[0] == kind for x in base))
                out[4].append(hashlib.sha256(digest(base).encode()).hexdigest())
                out[5].append(digest(plain))
                out[6].append(len(plain))
                out[7].append(max((x[3] for x in found), default=None))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "top_score"])

    return docs.select("doc_id", "text").mapInArrow(work, schema)


def redact_text(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets."""
    if not text:
        return text
    out, done = [], 0
    for kind, start, end, _ in sorted(spans_of(text), key=lambda x: (x[1], -x[2])):
        if start >= done:
            out += [text[done:start], f"<{kind}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``; spans in ``text`` are masked.

    A column ``n_chars`` is brought up to date if there is one.
    """
    names = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            at = names.index("text")
            texts = [redact_text(t) for t in batch.column(at).to_pylist()]
            columns = [batch.column(i) for i in range(batch.num_columns)]
            columns[at] = pa.array(texts, pa.string())
            if "n_chars" in names:
                n = names.index("n_chars")
                old = columns[n].to_pylist()
                columns[n] = pa.array([o if t is None else len(t) for o, t in zip(old, texts, strict=True)], batch.column(n).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(work, docs.schema)
