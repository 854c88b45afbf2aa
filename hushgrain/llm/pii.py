"""Personal data: patterns propose spans, validators confirm them, context words adjust the score.

Every text is read whole. Patterns that could rescan a long run of characters are replaced by
equivalent single passes (a dotted number is cut into addresses part by part, an address is looked
for around each @). Offsets are code points, ends exclusive.

Base kinds (email, ip, card, phone) always stay; further kinds (iban, local_phone, national_id,
secret) stay if their score reaches `threshold` and no span kept before them overlaps. An account number
is as long as its country's are, whatever follows it. Context is whole words (or parts of names like
api_key) within 40 characters on either side of a span.

Nulls and ties: a null text is an empty one and has no spans; rows with null or repeated ids are
scanned like any other; other columns are left as they are. An empty table gives no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from hushgrain.llm.worker import each, release

# Patterns and bounds of the base kinds.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "local_phone", "national_id", "secret")
KINDS = BASE_KINDS + ADDED_KINDS
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Patterns of the further kinds.
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?=\x20?[A-Z0-9])")
# Lengths of account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18,
    "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23,
    "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28,
    "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
    "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
_LOCAL_PHONE = re.compile(r"(?<![\w+(])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?!\w)")
_NATIONAL_ID = re.compile(r"(?<![\w-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\w-])")
_SECRET = re.compile(r"[:=][\x20\t]{0,4}[\"']?([A-Za-z0-9_-]{16,})")
#: Words that raise a kind's score if they stand near a span, and by how much.
CONTEXT = {
    "email": (("mail", "email", "contact", "write to"), 0.05),
    "ip": (("ip", "host", "server", "address"), 0.1),
    "card": (("card", "visa", "credit", "payment"), 0.05),
    "phone": (("phone", "telephone", "call", "tel", "mobile", "fax"), 0.1),
    "iban": (("iban", "account", "bank"), 0.05),
    "local_phone": (("phone", "telephone", "call", "tel", "mobile", "fax"), 0.4),
    "national_id": (("ssn", "social security", "national id", "tax id"), 0.4),
    "secret": (("token", "secret", "api_key", "apikey", "api-key", "password", "passwd"), 0.5),
}
#: Scores before context.
PRIOR = {"email": 0.9, "ip": 0.8, "card": 0.9, "phone": 0.8, "iban": 0.9, "local_phone": 0.3, "national_id": 0.3, "secret": 0.3}
_WINDOW = 40
_NEAR = {k: re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(map(re.escape, words)) + r")(?![A-Za-z0-9])", re.I | re.A) for k, (words, _) in CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """ISO 13616: the first four characters go last, letters count from 10."""
    moved = account[4:] + account[:4]
    return 15 <= len(account) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _addresses(text: str):
    for m in _DOTTED.finditer(text):
        if m.end() - m.start() < 7:
            continue
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            n = sum(map(len, four)) + 3
            if all((x.lstrip("0") or "0").isdigit() and len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in four):
                yield at, at + n
            at += n + 1


def _cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 8 <= sum(map(str.isdigit, m.group())) <= 15:
            yield m.span()


def _ibans(text: str):
    done = 0
    for m in _IBAN.finditer(text):
        n, at = IBAN_LENGTHS.get(m.group(1), 0) - 4, m.end()
        if n < 0 or m.start() < done:
            continue
        spaced, left = text[at] == " ", n
        while left and at < len(text):  # in groups of four after spaces, or without any
            if spaced and (n - left) % 4 == 0 and text[at] == " ":
                at += 1
            elif text[at].isascii() and (text[at].isdigit() or text[at].isupper()) and not (spaced and (n - left) % 4 == 0 and text[at - 1] != " "):
                at, left = at + 1, left - 1
            else:
                break
        if not left and not text[at : at + 1].isalnum() and mod97(text[m.start() : at].replace(" ", "")):
            yield m.start(), at
            done = at


def _secrets(text: str):
    for m in _SECRET.finditer(text):
        value = m.group(1)
        if any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
            yield m.span(1)


def _score(kind: str, text: str, start: int, end: int) -> float:
    """A word counts if all of it is within the window; the characters beyond tell where it ends."""
    near, upto = _NEAR[kind], end + _WINDOW
    found = any(m.end() <= start for m in near.finditer(text, max(0, start - _WINDOW), start + 1))
    found = found or any(m.end() <= upto for m in near.finditer(text, end, upto + 1))
    return min(1.0, PRIOR[kind] + CONTEXT[kind][1] * found)


def find_spans(text: str | None, threshold: float = 0.6) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), by kind as in KINDS, then start."""
    if not text:
        return []
    digits, plus = bool(_DIGIT.search(text)), "+" in text
    found = {
        "email": _emails(text) if "@" in text else (),
        "ip": _addresses(text) if digits and "." in text else (),
        "card": _cards(text) if digits else (),
        "phone": _phones(text) if digits and plus else (),
        "iban": _ibans(text) if digits else (),
        "local_phone": ((m.start(), m.end()) for m in _LOCAL_PHONE.finditer(text)) if digits else (),
        "national_id": ((m.start(), m.end()) for m in _NATIONAL_ID.finditer(text)) if digits and "-" in text else (),
        "secret": _secrets(text) if digits and ("=" in text or ":" in text) else (),
    }
    out = [(k, a, b, _score(k, text, a, b)) for k in BASE_KINDS for a, b in found[k]]
    taken = None
    for k in ADDED_KINDS:
        for a, b in found[k]:
            score = _score(k, text, a, b)
            if score < threshold:
                continue
            if taken is None:  # a mark for each character
                taken = bytearray(len(text))
                for _, x, y, _ in out:
                    taken[x:y] = b"\1" * (y - x)
            if not any(taken[a:b]):
                out.append((k, a, b, score))
                taken[a:b] = b"\1" * (b - a)
    return out


SPANS = "array<struct<kind:string,start:int,end:int,text:string,score:double>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("score", pa.float64())]))


def spans(text: Column, threshold: float = 0.6) -> Column:
    """Column of the spans of a text column."""

    @arrow_udf(SPANS)
    def run(texts: pa.Array) -> pa.Array:
        release()
        return pa.array([[{"kind": k, "start": a, "end": b, "text": x[a:b], "score": s} for k, a, b, s in find_spans(x, threshold)] for x in each(texts)], _SPANS)

    return run(text)


def redact_text(text: str | None, threshold: float = 0.6) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, which
    bears the first one's kind."""
    found = sorted((a, b, k) for k, a, b, _ in find_spans(text, threshold))
    if not found:
        return text
    out, done = [], 0
    for a, b, k in found:
        if a >= done:
            out += [text[done:a], f"[{k.upper()}]"]
        done = max(done, b)
    return "".join(out) + text[done:]


def redacted(text: Column, threshold: float = 0.6) -> Column:
    @arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        release()
        return pa.array([redact_text(x, threshold) for x in each(texts)], pa.string())

    return run(text)


def described(found: Column) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
