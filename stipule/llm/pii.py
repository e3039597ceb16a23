"""Personal data: patterns propose spans, checksums confirm, context scores.

Each kind has a pattern.  A checksum or range validator drops proposals that
cannot be real: Luhn for cards, parts of at most 255 for addresses, mod-97 for
bank account numbers, number ranges for social security numbers.  Words near a
span raise or lower its score.

The base kinds ``email ip card phone`` are kept whatever their score; the
further kinds ``iban ssn`` need a score of at least ``KEEP``.

Defined results: a null or empty text has no spans; a null id passes through;
repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from stipule.llm.common import arrow_map, small_batches, table

# Kinds in their order, patterns, context words.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: The base pattern, but begun at the start of a digit run only, each run taken whole: inside a run
#: no start can succeed where the first fails, as a match ends with a whole run.  This keeps it linear.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
RAISES = {
    "email": ("email", "e-mail", "mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "credit", "debit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer", "konto"),
    "ssn": ("ssn", "social security", "security number", "taxpayer"),
}
LOWERS = {
    "email": ("example", "noreply"),
    "ip": ("version", "release", "section"),
    "card": ("isbn", "serial", "order", "token"),
    "phone": ("isbn", "serial", "version"),
    "iban": ("serial", "token"),
    "ssn": ("isbn", "serial", "part number", "order"),
}
STEP, WINDOW, KEEP = 0.3, 40, 0.5


class Span(NamedTuple):
    """A confirmed span in code points, end exclusive."""

    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Whether a digit string passes the Luhn check."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number, spaces removed, leaves 1 modulo 97."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # Anchored at each '@': the local part is the run before it, so no start is tried twice.
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_PART:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        free = m.end() if m else at + 1
        if m:
            yield start, m.end()
        at = text.find("@", free)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m[0].split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in IBAN.finditer(text):
        plain = m[0].replace(" ", "")
        if 15 <= len(plain) <= 34 and mod97(plain):
            yield m.span()


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


PROPOSE = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "ssn": _ssns}


def context_score(kind: str, text: str, start: int, end: int) -> float:
    """The kind's prior, moved by the words within ``WINDOW`` code points."""
    return _near_score(kind, f"{text[max(0, start - WINDOW) : start]} {text[end : end + WINDOW]}".lower())


@lru_cache(maxsize=1 << 14)
def _near_score(kind: str, near: str) -> float:
    words = set(re.findall(r"[a-z-]+", near))
    hit = lambda terms: any(t in near if " " in t else t in words for t in terms)
    moved = PRIOR[kind] + STEP * hit(RAISES[kind]) - STEP * hit(LOWERS[kind])
    return round(min(1.0, max(0.0, moved)), 2)


def find_spans(text: str | None) -> list[Span]:
    """All confirmed spans, by kind in ``KINDS`` order, then by start."""
    if not text:
        return []
    has_digit = re.search("[0-9]", text) is not None
    found = []
    for kind in KINDS:
        if kind == "email" or has_digit:
            for start, end in PROPOSE[kind](text):
                score = context_score(kind, text, start, end)
                if kind in BASE_KINDS or score >= KEEP:
                    found.append(Span(kind, start, end, score))
    return found


def redact(text: str | None, spans: list[Span] | None = None) -> str | None:
    """Replace each span by its kind in angle brackets; overlaps become one mark.

    The mark of a merged run is that of the span which starts first.
    """
    if not text:
        return text
    out, done = [], 0
    for s in sorted(find_spans(text) if spans is None else spans, key=lambda s: (s.start, -s.end)):
        if s.start >= done:
            out += [text[done : s.start], f"<{s.kind.upper()}>"]
        done = max(done, s.end)
    return "".join([*out, text[done:]])


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


SPAN_SCHEMA = (
    "{id} {id_type}, n_email long, n_ip long, n_card long, n_phone long, "
    "base_sha256 string, spans string, scores string"
)


def pii_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts of the base kinds, a digest of the base spans, all spans, their scores."""
    id_type = df.schema[id_col].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_spans(t) for t in batch.column(1).to_pylist()]
            base = [[s for s in spans if s.kind in BASE_KINDS] for spans in found]
            counts = [pa.array([sum(s.kind == k for s in spans) for spans in base], pa.int64()) for k in BASE_KINDS]
            digest = [hashlib.sha256(_joined(spans).encode()).hexdigest() for spans in base]
            scores = [",".join(f"{s.score:.2f}" for s in spans) for spans in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(digest, pa.string()), pa.array(map(_joined, found), pa.string()), pa.array(scores, pa.string())],
                names=[id_col, *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "scores"],
            )

    schema = SPAN_SCHEMA.format(id=f"`{id_col}`", id_type=id_type.simpleString())
    return arrow_map(df, [id_col, text_col], scan, schema)


def redacted(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with every confirmed span of its text replaced; all columns stay."""
    small_batches(df.sparkSession)
    at = df.columns.index(text_col)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([redact(t) for t in batch.column(at).to_pylist()], batch.column(at).type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], texts, *batch.columns[at + 1 :]], schema=batch.schema)

    return df.mapInArrow(rewrite, df.schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    return pii_spans(table(spark, sf_dir, "documents"))
