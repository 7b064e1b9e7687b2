"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust the score.

Base kinds (email, ip, card, phone) follow fixed patterns and are always reported. The method adds
kinds whose patterns alone say little: bank accounts (IBAN, confirmed by mod 97), US social security
numbers (confirmed by their number ranges), telephone numbers without a country sign (which need
a word such as "call" nearby), and secrets: keys of well-known forms, and values given to a word such as
"token" (confirmed if they are as irregular as drawn ones). Each span has a score: the kind's base value, raised by a passed
checksum and by context words within CONTEXT_CHARS before or after it; added spans need THRESHOLD.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from brindle.llm.common import field, map_arrow

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "tel", "secret")
KINDS = BASE_KINDS + ADDED_KINDS
CONTEXT_CHARS, THRESHOLD = 40, 0.6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that starts inside a run of digits is never leftmost; the look-behind keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_TEL = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_DIGIT = re.compile("[0-9]")
#: Forms of access keys that their issuers have published, and the head of a private key file.
_KEY = re.compile(r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Z])|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,}|-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----)")
_GIVEN = re.compile(r"""(?i)(?<![a-z0-9])(?:token|secret|password|passwd|pwd|(?:api|access|auth|private|secret)[_ -]?key)["']?[ \t]{0,3}[:=][ \t]{0,3}["']?([a-z0-9+/_=.-]{16,})""")
_GIVES = re.compile("[:=]")
#: Bits of a character that a drawn value has at least, on average over its characters.
SECRET_BITS = 2.8
#: Characters of an account number by its country (the IBAN registry's lengths), and of any at least.
IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}
IBAN_LEAST = 15

#: Base value of each kind, and words nearby that raise or lower it.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.7, "ssn": 0.45, "tel": 0.4, "secret": 0.45}
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social", "security"),
    "tel": ("phone", "call", "tel", "mobile", "fax", "contact"),
    "secret": ("token", "secret", "password", "passwd", "pwd", "key", "credentials"),
}
AGAINST = ("version", "isbn", "order", "example", "invoice")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064: the number made of the account and then its head leaves 1."""
    plain = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _ibans(text: str):
    """Accounts that leave 1: as long as the country's are, or, for a country not listed, the longest reading that ends at a border.

    Words and numbers in capitals after an account look like more of it, so each possible end is tried;
    after an account the search goes on at its end, and where there is none, at the next possible start.
    """
    m = _IBAN.search(text)
    while m:
        head, length, end = m[0][:4], IBAN_LENGTHS.get(m[0][:2]), None
        first = int("".join(str(int(c, 36)) for c in head))
        size, rest = 4, 0  # characters so far, and what those after the head leave modulo 97
        for at in range(m.start() + 4, m.end()):
            if text[at] == " ":
                continue
            size += 1
            value = int(text[at], 36)
            rest = (rest * (10 if value < 10 else 100) + value) % 97
            if (size == length if length else size >= IBAN_LEAST) and (rest * 1_000_000 + first) % 97 == 1:
                after = text[at + 1 : at + 2]
                if not (after.isascii() and after.isalnum()):
                    end = at + 1
        if end:
            yield m.start(), end
        m = _IBAN.search(text, end or m.start() + 1)


def drawn(value: str) -> bool:
    """Whether a value has letters and digits and is as irregular as a random one."""
    n = Counter(value)
    bits = -sum(k / len(value) * log2(k / len(value)) for k in n.values())
    return bits >= SECRET_BITS and any(c.isdigit() for c in n) and any(c.isalpha() for c in n)


def _secrets(text: str):
    """(start, end) of keys of known forms, and of drawn values given to a word for a secret; of two that overlap, the first."""
    found = [m.span() for m in _KEY.finditer(text)]
    if _GIVES.search(text):
        found += [m.span(1) for m in _GIVEN.finditer(text) if drawn(m[1])]
    over = 0
    for start, end in sorted(found):
        if start >= over:
            yield start, end
            over = end


def _emails(text: str):
    over = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > over and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            over = m.end()
            yield start, over
            at = text.find("@", over)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base kinds, leftmost and non-overlapping within a kind."""
    out = [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in m[0].split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _score(text: str, kind: str, start: int, end: int, confirmed: bool) -> float:
    near = (text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]).lower()
    words = set(re.findall(r"[a-z-]+", near))
    score = SCORES[kind] + 0.2 * confirmed + 0.25 * any(w in words for w in CONTEXT[kind]) - 0.25 * any(w in words for w in AGAINST)
    return round(min(1.0, max(0.0, score)), 4)


def added_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
    """Spans of further kinds that pass their check and the threshold; but for secrets, they overlap no base span."""
    found = [(s, 7, e, True) for s, e in _secrets(text)]
    if not found and not _DIGIT.search(text):
        return []
    found += [(s, 4, e, True) for s, e in _ibans(text)]
    for m in _SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            found.append((m.start(), 5, m.end(), True))
    found += [(m.start(), 6, m.end(), False) for m in _TEL.finditer(text)]
    taken = sorted((s, e) for s, _, e in base)
    reach, furthest = [], 0
    for _, e in taken:
        furthest = max(furthest, e)
        reach.append(furthest)
    out = []
    for start, kind, end, confirmed in sorted(found):
        k = bisect_left(taken, (end, 0))  # base spans that begin before this one's end
        if kind != 7 and k and reach[k - 1] > start:
            continue
        score = _score(text, KINDS[kind], start, end, confirmed)
        if score >= THRESHOLD:
            out.append((start, kind, end, score))
    return out


def spans_of(text: str) -> list[tuple[int, int, int, float]]:
    """All spans (start, kind, end, score) in order of start, then kind."""
    base = base_spans(text)
    scored = [(s, k, e, _score(text, KINDS[k], s, e, k in (1, 2, 3))) for s, k, e in base]
    return sorted(scored + added_spans(text, base))


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in spans)


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id and found, an array of (kind, start, end, score) in code points.

    A null or empty text has an empty array; the whole of a text is searched, however long; a null id is
    carried along; repeated rows each have a row. Columns besides id and text are not read. An empty
    table gives an empty result.
    """
    schema = T.StructType([field(df, id_col), T.StructField("found", T.ArrayType(SPAN))])
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            rows = [[{"kind": KINDS[k], "start": s, "end": e, "score": v} for s, k, e, v in spans_of(x or "")] for x in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(rows, pa.list_(kind))], names=[id_col, "found"])

    return map_arrow(df.select(id_col, text_col), run, schema)


def pii_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, counts of the base kinds, the SHA-256 of the base spans, all spans as text, and how many they are, for each row of df.

    The spans are those of ``find_pii``, taken in the same pass over the texts. A null or empty text has
    counts of 0, the digest of nothing and an empty string; the rest is as in ``find_pii``.
    """
    schema = T.StructType([field(df, id_col), *(T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_spans", T.LongType())])

    def run(batches):
        for b in batches:
            spans = [spans_of(x or "") for x in b.column(text_col).to_pylist()]
            base = [[x for x in row if x[1] < len(BASE_KINDS)] for row in spans]
            columns = [pa.array([sum(x[1] == k for x in row) for row in base], pa.int64()) for k in range(len(BASE_KINDS))]
            shas = pa.array([hashlib.sha256(_joined(row).encode()).hexdigest() for row in base], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(id_col), *columns, shas, pa.array(map(_joined, spans), pa.string()), pa.array(map(len, spans), pa.int64())], names=schema.names)

    return map_arrow(df.select(id_col, text_col), run, schema)
