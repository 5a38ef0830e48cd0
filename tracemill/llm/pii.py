"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust a score.

Kinds: email, ip, card (Luhn), phone, and iban (mod-97), which is this method's own addition. Each kind's spans are
leftmost and non-overlapping; a proposal that its validator refuses is dropped without another try. Searches start
only where a span can start (at an `@`, `+`, or the first digit of a run), so a text costs time in proportion to its
length. A span's score is its kind's base score, raised by a fitting word in the 40 characters before or after it.

Offsets are code points, ends exclusive. A null text is an empty one. Texts are read whole. Repeated rows give equal
results, each for itself; an empty table gives an empty result. A column function reads its own column alone, so other columns
may have any name."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import functions as F

from tracemill.llm.base import text_udf

# Kinds in order, their patterns, base scores and context words.
KINDS = ("email", "ip", "card", "phone")
EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_HEAD = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
CONTEXT = {
    "email": ("mail", "contact", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment", "karte", "tarjeta", "carte"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
}
NEAR = 40


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    out, end = [], 0
    for m in EMAIL_TAIL.finditer(text):
        start = at = m.start()
        while start > end:  # by steps, so that nothing before the run is read
            step = text[max(end, start - 64) : start]
            head = EMAIL_HEAD.search(step)
            if not head:
                break
            start -= len(head[0])
            if head.start():
                break
        if start < at:
            end = m.end()
            out.append((start, end))
    return out


def _small(part: str) -> bool:
    return len(part := part.lstrip("0")) <= 3 and int(part or 0) <= 255


def _cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def found(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all confirmed spans, by kind as listed (iban last), then start."""
    out = []
    if "@" in text:
        out += [("email", *s) for s in _emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
    out += [("card", *s) for s in _cards(text)]
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(map(m[0].count, "0123456789")) <= 15]
    out += [("iban", *m.span()) for m in IBAN.finditer(text) if 15 <= len(m[0].replace(" ", "")) <= 34 and mod97(m[0].replace(" ", ""))]
    return out


def score(text: str, kind: str, start: int, end: int) -> float:
    near = (text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]).lower()
    return min(1.0, SCORE[kind] + 0.2 * any(re.search(rf"\b{w}", near) is not None for w in CONTEXT[kind]))


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each stretch that spans cover replaced by [KIND] of the span that begins it."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def spans():
    """A column function: text -> its spans with scores."""

    @text_udf("array<struct<kind:string,start:int,stop:int,score:double>>")
    def pii_spans(text: pa.Array) -> pa.Array:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())])
        rows = [[{"kind": k, "start": a, "stop": b, "score": score(x, k, a, b)} for k, a, b in found(x)] if x else [] for x in text.to_pylist()]
        return pa.array(rows, pa.list_(kind))

    return pii_spans


def redaction():
    """A column function: text -> text with its personal data replaced; null stays null."""

    @text_udf("string")
    def pii_redacted(text: pa.Array) -> pa.Array:
        return pa.array([x and redacted(x, found(x)) for x in text.to_pylist()], pa.string())

    return pii_redacted


def digest():
    """A column function: text -> counts by base kind, the SHA-256 of the list of base spans, the list of all spans and
    the highest score (0 without spans)."""

    @text_udf("n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, top_score double")
    def pii_digest(text: pa.Array) -> pa.Array:
        rows = []
        for x in text.to_pylist():
            every = found(x) if x else []
            base = [s for s in every if s[0] in KINDS]
            row = {f"n_{k}": sum(s[0] == k for s in base) for k in KINDS}
            row |= {"base_sha256": hashlib.sha256(listed(base).encode()).hexdigest(), "spans": listed(every), "top_score": max((score(x, *s) for s in every), default=0.0)}
            rows.append(row)
        kinds = pa.struct([*((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("top_score", pa.float64())])
        return pa.array(rows, kinds)

    return pii_digest
