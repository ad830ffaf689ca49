"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust a score.

Spans count code points, end exclusive. Email, ip, card and phone spans are kept whatever their score; the kinds that this
method adds (iban by mod-97, and national ids in the form 3-2-4) need a score of at least ``LEAST`` and must not overlap others.

Defined results: null text counts as empty and has no spans; rows are searched one by one, so repeated rows get equal
results; matches that fail their check are dropped and the search goes on behind them. Tables may be empty.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tokens import ranges

KINDS = ("email", "ip", "card", "phone", "iban", "id")
BASE = KINDS[:4]
LEAST = 0.6
#: Characters before and after a span in which context words count.
NEARBY = 48

# The patterns of the four base kinds, written so that no start is tried twice.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Words that speak for or against a kind.
FOR = {
    "email": ("mail", "contact", "write", "kontakt", "correo", "courriel"),
    "ip": ("ip", "address", "server", "host", "adresse", "login"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "telefon", "fax"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "id": ("ssn", "social", "security", "taxpayer", "identification"),
}
AGAINST = ("example", "sample", "version", "order", "isbn", "beispiel", "exemple", "ejemplo")
#: Score by pattern alone, and after a passed checksum.
PRIOR = {"email": (0.9, 0.9), "ip": (0.6, 0.6), "card": (0.3, 0.8), "phone": (0.6, 0.6), "iban": (0.2, 0.9), "id": (0.4, 0.4)}
STEP = 0.25


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    doubled = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(doubled[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def mod97(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str):
    # a local part may not reach back into the match before it
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def propose(text: str):
    """(kind, start, end, confirmed by a checksum) of all spans that pass their checks."""
    for a, b in _emails(text):
        yield "email", a, b, False
    if not re.search("[0-9]", text):
        return
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0")[:4] or 0) <= 255 for x in m[0].split(".")):
            yield "ip", *m.span(), False
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield "card", *m.span(), True
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield "phone", *m.span(), False
    for m in IBAN.finditer(text):
        code = m[0].replace(" ", "")
        if 15 <= len(code) <= 34 and mod97(code):
            yield "iban", *m.span(), True
    for m in ID.finditer(text):
        yield "id", *m.span(), False


def score(text: str, kind: str, start: int, end: int, confirmed: bool) -> float:
    near = (text[max(0, start - NEARBY) : start] + " " + text[end : end + NEARBY]).lower()
    near_words = set(re.findall(r"[^\W\d_]+", near))
    value = PRIOR[kind][confirmed] + STEP * bool(near_words.intersection(FOR[kind])) - STEP * bool(near_words.intersection(AGAINST))
    return round(min(1.0, max(0.0, value)), 2)


def find(text: str) -> list[Span]:
    """All spans by kind as listed, then start."""
    found: list[Span] = []
    for kind, a, b, confirmed in propose(text):
        s = Span(kind, a, b, score(text, kind, a, b, confirmed))
        if kind in BASE or (s.score >= LEAST and not any(x.start < b and a < x.end for x in found)):
            found.append(s)
    return found


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span, overlapping ones as one, replaced by its kind in brackets."""
    out, at, until = [], 0, 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= until:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        until = max(until, s.end)
        at = until
    return "".join([*out, text[at:]])


def _joined(spans) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def _row(text: str) -> tuple:
    spans = find(text)
    base = [s for s in spans if s.kind in BASE]
    return (*(sum(s.kind == k for s in spans) for k in BASE), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), ",".join(f"{s.score:.2f}" for s in spans))


_EMPTY = _row("")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores (in the order of spans)."""
    return _mapped(docs, lambda t: _row(t) if _suspect(t) else _EMPTY, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string", "doc_id")


def masked(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with every span in ``text`` masked; null stays null. Other columns are as they were."""
    clean = docs["text"].isNull() | ~docs["text"].rlike("[0-9@]")
    packed = docs.where(~clean).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    out = _mapped(packed, lambda t: (mask(t, find(t)),), "_masked string", "_row")
    return docs.where(clean).unionByName(out.select(*[F.col("_masked").alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]))


def _suspect(text: str) -> bool:
    return "@" in text or re.search("[0-9]", text) is not None


def _mapped(docs: DataFrame, row, made: str, *keep: str) -> DataFrame:
    from pyspark.sql import types as T

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    full = T.StructType([*rows.drop("_text").schema.fields, *T.StructType.fromDDL(made).fields])

    def work(frames):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(full)
        for batch in frames:
            for a, b in ranges(batch.column(len(keep))):
                cols = zip(*map(row, batch.column(len(keep)).slice(a, b - a).to_pylist()), strict=True)
                arrays = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                arrays += [pa.array(c, wanted.field(len(keep) + i).type) for i, c in enumerate(cols)]
                yield pa.RecordBatch.from_arrays(arrays, [f.name for f in full])

    return rows.mapInArrow(work, full)
