"""Personal data: patterns propose spans, checksums confirm them, context words near them adjust the score."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm._common import ship, table, text_or_empty

#: The kinds in the order in which spans are listed.  The first four stay whatever their score.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "national_id", "phone_local")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is tried from its first digit only: from a later one it fails or ends alike.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_SIGN = re.compile(r"[A-Za-z0-9]")
_NATIONAL_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_PHONE_LOCAL = re.compile(r"(?<![0-9+(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9-])")

# Lengths of account numbers by country, from the public registry of ISO 13616.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29,
    "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19,
    "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29,
    "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24,
    "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
    "YE": 30,
}

#: Score of a span whose pattern alone matched; what a passed checksum and a context word near it add to it.
PATTERN_SCORE = {
    "email": 0.9, "ip": 0.6, "card": 0.4, "phone": 0.6, "iban": 0.3, "national_id": 0.4, "phone_local": 0.4,
}
CHECKSUM_BONUS, CONTEXT_BONUS, COUNTER_MALUS = 0.5, 0.35, 0.3
_PHONE_WORDS = (
    "phone", "phones", "telephone", "tel", "call", "mobile", "cell", "telefon", "handy", "téléphone", "tél", "teléfono", "móvil",
)
CONTEXT = {
    "email": ("mail", "email", "emails", "contact", "kontakt", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "visa", "credit", "karte", "kreditkarte", "carte", "tarjeta"),
    "phone": _PHONE_WORDS,
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank"),
    "national_id": ("ssn", "social security", "national id", "tax id"),
    "phone_local": _PHONE_WORDS,
}
COUNTER_CONTEXT = ("version", "isbn", "order no", "serial", "invoice")
_REACH = 40


def _words(words: tuple[str, ...]) -> re.Pattern:
    """Any of the words, whole and in any case."""
    return re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, words))})(?!\w)", re.IGNORECASE)


_NEAR = {kind: _words(words) for kind, words in CONTEXT.items()}
_COUNTER = _words(COUNTER_CONTEXT)

_SPANS = "array<struct<kind string, start long, end long, score double, confirmed boolean>>"
_SPAN = pa.struct(
    [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("confirmed", pa.bool_())]
)


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit)
        if place % 2:
            value = value * 2 - 9 if value > 4 else value * 2
        total += value
    return total % 10 == 0


def mod97(account: str) -> bool:
    turned = account[4:] + account[:4]
    rest = 0
    for sign in turned:  # digit by digit, so that no long integer is built
        for digit in str(int(sign, 36)):
            rest = (rest * 10 + int(digit)) % 97
    return rest == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What the address pattern finds from the left, from one at-sign to the next: time follows the text's length."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def _digits(text: str) -> str:
    return "".join(x for x in text if "0" <= x <= "9")


def _accounts(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers of the length of their country whose checksum holds; the search goes on behind each one."""
    at = 0
    while m := _IBAN.search(text, at):
        at = m.start() + 1
        size = IBAN_LENGTHS.get(m[0][:2])
        places = [i for i, x in enumerate(m[0]) if x != " "]
        if size and len(places) >= size:
            end = m.start() + places[size - 1] + 1
            if not _SIGN.match(text, end) and mod97("".join(m[0][i] for i in places[:size])):
                yield m.start(), end
                at = end


def _proposals(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, whether a checksum confirms it); what a base kind's own test rejects is left out."""
    for start, end in _emails(text):
        yield "email", start, end, False
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
            yield "ip", m.start(), m.end(), False
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            yield "card", m.start(), m.end(), True
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            yield "phone", m.start(), m.end(), False
    for start, end in _accounts(text):
        yield "iban", start, end, True
    for m in _NATIONAL_ID.finditer(text):
        yield "national_id", m.start(), m.end(), False
    for m in _PHONE_LOCAL.finditer(text):
        yield "phone_local", m.start(), m.end(), False


def _is_near(words: re.Pattern, text: str, start: int, end: int) -> bool:
    """Whether one of the words begins in ``start:end``; a word that the end cuts is looked at whole."""
    m = words.search(text, max(0, start), min(len(text), end + _REACH))
    return bool(m) and m.start() < end


def find_spans(text: str, threshold: float = 0.7) -> list[tuple[str, int, int, float, bool]]:
    """Spans by kind, then start.  A further kind's span is kept if its score reaches ``threshold`` and no base span
    overlaps it.  Context words count up to 40 signs before a span or behind it, words against it only before it."""
    found, further = [], []
    for kind, start, end, confirmed in _proposals(text):
        score = PATTERN_SCORE[kind] + CHECKSUM_BONUS * confirmed
        score += CONTEXT_BONUS * (_is_near(_NEAR[kind], text, start - _REACH, start) or _is_near(_NEAR[kind], text, end, end + _REACH))
        score -= COUNTER_MALUS * _is_near(_COUNTER, text, start - _REACH, start)
        span = kind, start, end, round(min(1.0, max(0.0, score)), 4), confirmed
        if kind in BASE_KINDS:
            found.append(span)
        elif score >= threshold:
            further.append(span)
    base = sorted((start, end) for _, start, end, *_ in found)
    starts, reach = [s for s, _ in base], list(accumulate((e for _, e in base), max))
    for span in further:
        before = bisect_left(starts, span[2])  # base spans that start before this one ends
        if not before or reach[before - 1] <= span[1]:
            found.append(span)
    return sorted(found, key=lambda x: (KINDS.index(x[0]), x[1]))


def masked(text: str, spans: list[tuple]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans make one gap, named by the first."""
    out, free = [], 0
    for kind, start, end, *_ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= free:
            out += [text[free:start], f"[{kind.upper()}]"]
        free = max(free, end)
    return "".join([*out, text[free:]])


def _has_proposal(text: str) -> bool:
    return "@" in text or _DIGIT.search(text) is not None


def detect_pii(docs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id and ``spans`` (kind, start, end in code points, score, confirmed) of every row of ``docs``.

    Null and empty texts have no spans; null and repeated doc_ids are answered row by row; other columns are ignored,
    whatever their names.  An empty table gives no rows."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            spans = [find_spans(x, threshold) if _has_proposal(x) else [] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([[dict(zip(_SPAN.names, s)) for s in x] for x in spans], pa.list_(_SPAN))],
                ["doc_id", "spans"],
            )

    return docs.select("doc_id", text_or_empty()).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {_SPANS}")


def mask_pii(docs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``docs`` with every span masked in ``text`` and ``n_chars``, where there is one, counted anew.

    All rows and all other columns stay; a null text stays null."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = [
                masked(x, find_spans(x, threshold)) if x and _has_proposal(x) else x
                for x in batch.column(at).to_pylist()
            ]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, by ``detect_pii``: null texts are empty and have no spans, an empty table gives no rows."""
    found = detect_pii(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))
