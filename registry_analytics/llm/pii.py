"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Candidates are found by pattern and validated (Luhn digit, IBAN remainder, calendar, octet
range, number plan); what fails stays as it is. A valid value becomes an integer of its
format's domain, a keyed Feistel network permutes the domain (cycle walking keeps it
inside and valid), and the result is written back in the same format: same separators,
same length, check digits right. The permutation depends on key and kind only, so equal
values get equal pseudonyms in all documents, in whatever spelling, and different values
never meet.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship_code

KEY = b"example key; give your own"
_ROUNDS = 8
_SLICE = 512
_CACHE = 200_000

_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2099, 12, 31).toordinal() - _FIRST_DAY + 1


def permute(value: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of range(size): Feistel rounds on a rectangle a x b that covers
    the range, repeated until the value falls into the range again."""
    a = 1
    while a * a < size:
        a <<= 1  # a power of two near the root
    b = -(-size // a)
    seed = tweak + size.to_bytes(40, "big")
    while True:
        left, right = divmod(value, b)
        for i in range(_ROUNDS):
            half = (right if i % 2 == 0 else left).to_bytes(40, "big")
            word = int.from_bytes(hashlib.blake2b(
                bytes([i]) + seed + half, key=key, digest_size=32).digest(), "big")
            if i % 2 == 0:
                left = (left + word) % a
            else:
                right = (right + word) % b
        value = left * b + right
        if value < size:
            return value


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _digits(text: str) -> str:
    return "".join([c for c in text if c.isdigit()])


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    it = iter(digits)
    return "".join([next(it) if c.isdigit() else c for c in shape])


def _permute_digits(digits: str, key: bytes, kind: bytes) -> str:
    return str(permute(int(digits), 10 ** len(digits), key, kind)).zfill(len(digits))


def _card(match: str, key: bytes) -> str | None:
    digits = _digits(match)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    new = _permute_digits(digits[:-1], key, b"card")
    return _refill(match, new + luhn_digit(new))


def _ssn_valid(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(match: str, key: bytes) -> str | None:
    digits = _digits(match)
    if not _ssn_valid(digits):
        return None
    digits = _permute_digits(digits, key, b"ssn")
    while not _ssn_valid(digits):
        digits = _permute_digits(digits, key, b"ssn")
    return _refill(match, digits)


# country codes of two digits; 1 and 7 have one, all others three
_TWO = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 "
           "62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _phone(match: str, key: bytes) -> str | None:
    digits = _digits(match)
    at = len(digits) - 10
    if match[0] == "+":
        at = 1 if digits[0] in "17" else 2 if digits[:2] in _TWO else 3
    country, own = digits[:at], digits[at:]
    return _refill(match, country + _permute_digits(own, key, b"phone"))


def _ip(match: str, key: bytes) -> str | None:
    octets = match.split(".")
    if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
        return None
    value = int.from_bytes(bytes(map(int, octets)), "big")
    new = permute(value, 1 << 32, key, b"ip").to_bytes(4, "big")
    return ".".join(map(str, new))


def _classes(text: str, key: bytes, kind: bytes) -> str:
    """Digits stay digits and letters letters (case kept), permuted as one mixed-radix
    number."""
    radix = [10 if "0" <= c <= "9" else 26 if c.isascii() and c.isalpha() else 1 for c in text]
    value, size = 0, 1
    for c, r in zip(text, radix):
        value = value * r + (int(c) if r == 10 else ord(c.lower()) - 97 if r == 26 else 0)
        size *= r
    if size == 1:
        return text
    # long texts: the network works on numbers of up to 40 bytes
    if size.bit_length() > 300:
        half = len(text) // 2
        return _classes(text[:half], key, kind) + _classes(text[half:], key, kind)
    shape = "".join(["d" if r == 10 else "a" if r == 26 else c for c, r in zip(text, radix)])
    value = permute(value, size, key, kind + shape.encode())
    out = []
    for c, r in zip(reversed(text), reversed(radix)):
        value, d = divmod(value, r)
        out.append(str(d) if r == 10 else c if r == 1 else
                   (chr(65 + d) if c.isupper() else chr(97 + d)))
    return "".join(reversed(out))


def _iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _iban(match: str, key: bytes) -> str | None:
    plain = match.replace(" ", "")
    country, check, rest = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or _iban_check(country, rest) != check:
        return None
    rest = _classes(rest, key, b"iban" + country.encode())
    new = iter(country + _iban_check(country, rest) + rest)
    return "".join([c if c == " " else next(new) for c in match])


def _email(match: str, key: bytes) -> str | None:
    local, domain = match.split("@")
    low = _classes(local.lower(), key, b"email")
    return "".join([n.upper() if o.isupper() else n for o, n in zip(local, low)]) + "@" + domain


def _secret(match: str, key: bytes) -> str | None:
    if match.isdigit() or not any(c.isdigit() for c in match):
        return None
    value = permute(int(match, 16), 16 ** len(match), key, b"hex")
    new = f"{value:0{len(match)}x}"
    return new.upper() if match.isupper() else new


def _shift_day(y: int, m: int, d: int, key: bytes) -> datetime.date | None:
    try:
        day = datetime.date(y, m, d).toordinal() - _FIRST_DAY
    except ValueError:
        return None
    if not 0 <= day < _DAYS:
        return None
    return datetime.date.fromordinal(_FIRST_DAY + permute(day, _DAYS, key, b"date"))


def _date(match: str, key: bytes) -> str | None:
    parts = re.split(r"\D", match)
    a, b, c = map(int, parts)
    sep = match[len(parts[0])]
    # one-digit days or months: written without leading zeros
    w = 1 if min(map(len, parts)) == 1 else 2
    if len(parts[0]) == 4:
        new = _shift_day(a, b, c, key)
        return new and f"{new.year:04d}{sep}{new.month:0{w}d}{sep}{new.day:0{w}d}"
    new = _shift_day(c, b, a, key) if b <= 12 else None
    if new:  # day first
        return f"{new.day:0{w}d}{sep}{new.month:0{w}d}{sep}{new.year:04d}"
    new = _shift_day(c, a, b, key)
    return new and f"{new.month:0{w}d}{sep}{new.day:0{w}d}{sep}{new.year:04d}"


# kinds in order of preference at one place
KINDS = {
    "email": (r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
              _email),
    "iban": (r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)", _iban),
    "date": (r"(?<![\w.-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})"
             r"(?:(?=T\d\d:?\d\d)|(?![\w-]))", _date),
    "ip": (r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", _ip),
    "phone": (r"(?<![\w+])(?:(?:\+?1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[.-])\d{3}[.-]\d{4}"
              r"|\+[1-9](?:[ .()-]{0,2}\d){7,14})(?!\w)", _phone),
    "ssn": (r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", _ssn),
    "card": (r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])", _card),
    "key": (r"(?<!\w)(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?!\w)", _secret),
}
_PATTERNS = [(k, re.compile(p), f) for k, (p, f) in KINDS.items()]
_MAYBE = re.compile(r"[0-9@]")


def pseudonymise(text: str, key: bytes = KEY, cache: dict | None = None
                 ) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its personal values replaced, and (kind, start, end) of each in the
    new text. At one place the kind listed first wins."""
    if not _MAYBE.search(text):
        return text, []
    found: list[tuple[int, int, str, str]] = []
    for kind, pattern, work in _PATTERNS:
        for m in pattern.finditer(text):
            ends = [m.end()]
            if kind == "card":  # other digits may follow: shorter runs up to a separator
                ends += [i for i in range(m.end() - 1, m.start(), -1) if text[i] in " -"]
            for end in ends:
                if any(m.start() < e and s < end for s, e, _, _ in found):
                    continue
                value = (kind, text[m.start():end])
                if cache is not None and value in cache:
                    new = cache[value]
                else:
                    new = work(value[1], key)
                    if cache is not None:
                        cache[value] = new
                if new is not None:
                    found.append((m.start(), end, kind, new))
                    break
    found.sort()
    out, spans, at, size = [], [], 0, 0
    for start, end, kind, new in found:
        out += [text[at:start], new]
        size += start - at
        spans.append((kind, size, size + len(new)))
        size += len(new)
        at = end
    return "".join(out) + text[at:], spans


_SPAN = T.StructType().add("kind", "string").add("start", "integer").add("end", "integer")


def pseudonyms(df: DataFrame, key: bytes = KEY, text_col: str = "text") -> DataFrame:
    """``df`` with its text column replaced by the pseudonymised text and ``found``: kind,
    first and last (exclusive) code point of each pseudonym. NULL stays NULL with nothing
    found; a column ``found`` of ``df`` is replaced; rows are treated one by one, on their
    whole text. The key is part of the plan: keep it out of logs by passing a derived one."""
    ship_code(df.sparkSession)
    kept = [c for c in df.columns if c != "found"]
    schema = df.select(*[F.col(f"`{c}`") for c in kept]).schema.add("found", T.ArrayType(_SPAN))
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()),
                                     ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                if len(cache) > _CACHE:
                    cache.clear()
                part = batch.slice(at, _SLICE)
                done = [(None, []) if t is None else pseudonymise(t, key, cache)
                        for t in part.column(text_col).to_pylist()]
                spans = pa.array([[dict(zip(("kind", "start", "end"), s)) for s in sp]
                                  for _, sp in done], spans_type)
                texts = pa.array([t for t, _ in done], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [texts if c == text_col else part.column(c) for c in kept] + [spans],
                    names=kept + ["found"])

    return df.mapInArrow(run, schema)
