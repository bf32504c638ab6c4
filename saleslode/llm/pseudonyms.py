"""Format-preserving pseudonyms for personal data, by a keyed Feistel network.

Candidates are found by shape and then validated (check digits, number ranges, calendar), so
that look-alikes stay. A valid value is numbered within all valid values of its format,
the number is permuted by a keyed Feistel network on that range (walking on while it falls
outside), and the permuted number is written in the same format: same length, layout and
validity. The permutation depends on the key and the kind only, so equal values have equal
pseudonyms in all documents, different ones stay different, and the key holder can undo
them.
Kinds: e-mail addresses (local part), payment cards (Luhn), IBANs (modulo 97), IPv4
addresses, US phone and social security numbers, ISO and slashed dates, access key ids,
secrets after ``password=`` and the like, quoted hexadecimal tokens.

Edge cases: NULL stays NULL with zero values; empty texts stay; repeated rows give repeated
results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import id_and_text, map_arrow, table

KEY = b"replace this key before release"
ROUNDS = 8
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2100, 1, 1).toordinal() - FIRST_DAY


def _feistel(number: int, size: int, key: bytes, undo: bool) -> int:
    """One pass of an unbalanced Feistel network on at least ``size`` numbers."""
    low = isqrt(size - 1) + 1
    high = -(-size // low)
    left, right = divmod(number, low)
    for turn in range(ROUNDS - 1, -1, -1) if undo else range(ROUNDS):
        even = turn % 2 == 0
        source, modulus = (right, high) if even else (left, low)
        digest = hashlib.blake2b(b"%d|%d|%d" % (turn, size, source), key=key).digest()
        shift = int.from_bytes(digest[:32], "big")
        shift = -shift if undo else shift
        if even:
            left = (left + shift) % modulus
        else:
            right = (right + shift) % modulus
    return left * low + right


@lru_cache(maxsize=1 << 16)
def permute(number: int, size: int, key: bytes, undo: bool = False) -> int:
    """Keyed permutation of range(size); cycle walking keeps the result below ``size``."""
    if size < 2:
        return number
    value = number
    while True:
        value = _feistel(value, size, key, undo)
        if value < size:
            return value


def luhn_digit(payload: str) -> int:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def classes_permuted(text: str, key: bytes, undo: bool, letters: str | None = None) -> str:
    """Permute letters among letters of the same case and digits among digits.

    ``letters`` limits lower-case letters to an alphabet, as for hexadecimal strings."""
    def alphabet(c):
        if c.isdigit() and c.isascii():
            return "0123456789"
        if "a" <= c <= "z":
            return letters or "abcdefghijklmnopqrstuvwxyz"
        if "A" <= c <= "Z":
            return letters.upper() if letters else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        return None

    number, size = 0, 1
    for c in text:
        if (a := alphabet(c)) and c in a:
            number, size = number * len(a) + a.index(c), size * len(a)
    number = permute(number, size, key, undo)
    out = []
    for c in reversed(text):
        if (a := alphabet(c)) and c in a:
            number, i = divmod(number, len(a))
            c = a[i]
        out.append(c)
    return "".join(reversed(out))


def _refill(layout: str, digits: str) -> str:
    source = iter(digits)
    return "".join(next(source) if c.isdigit() else c for c in layout)


def _ranged(parts: list[tuple[int, int, int]], key: bytes, undo: bool) -> list[int]:
    """Permute mixed-radix numbers: each part is (value, lowest, count)."""
    number, size = 0, 1
    for value, low, count in parts:
        number, size = number * count + value - low, size * count
    number = permute(number, size, key, undo)
    out = []
    for _, low, count in reversed(parts):
        number, digit = divmod(number, count)
        out.append(low + digit)
    return out[::-1]


def card(found: str, key: bytes, undo: bool) -> str | None:
    digits = re.sub("[ -]", "", found)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != int(digits[-1]):
        return None
    size = 10 ** (len(digits) - 1)
    payload = f"{permute(int(digits[:-1]), size, key, undo):0{len(digits) - 1}d}"
    return _refill(found, payload + str(luhn_digit(payload)))


def iban(found: str, key: bytes, undo: bool) -> str | None:
    plain = found.replace(" ", "")
    if not 15 <= len(plain) <= 34:
        return None

    def remainder(country, check, account):
        return int("".join(str(int(c, 36)) for c in account + country + check)) % 97

    country, check, account = plain[:2], plain[2:4], plain[4:]
    if remainder(country, check, account) != 1:
        return None
    account = classes_permuted(account, key, undo)
    plain = country + f"{98 - remainder(country, '00', account):02d}" + account
    source = iter(plain)
    return "".join(c if c == " " else next(source) for c in found)


def ipv4(found: str, key: bytes, undo: bool) -> str | None:
    parts = found.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    # Octets of one width stay in it, so the layout is kept: 0-9, 10-99, 100-255.
    spans = {1: (0, 10), 2: (10, 90), 3: (100, 156)}
    return ".".join(map(str, _ranged([(int(p), *spans[len(p)]) for p in parts], key, undo)))


def phone(found: str, key: bytes, undo: bool) -> str | None:
    digits = re.sub(r"\D", "", found)
    digits = digits[1:] if len(digits) == 11 else digits
    area, exchange, line = int(digits[:3]), int(digits[3:6]), int(digits[6:])
    if area < 100 or exchange < 100:
        return None
    out = _ranged([(area, 100, 900), (exchange, 100, 900), (line, 0, 10_000)], key, undo)
    new = f"{out[0]:03d}{out[1]:03d}{out[2]:04d}"
    kept = re.sub(r"\D", "", found)[:-10]
    return _refill(found, kept + new)


def social(found: str, key: bytes, undo: bool) -> str | None:
    area, group, serial = (int(p) for p in found.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    area -= 1 + (area > 666)
    area, group, serial = _ranged([(area, 0, 898), (group, 1, 99), (serial, 1, 9999)], key, undo)
    area += 1
    return f"{area + (area >= 666):03d}-{group:02d}-{serial:04d}"


def _day(year: int, month: int, day: int) -> int | None:
    try:
        number = datetime.date(year, month, day).toordinal() - FIRST_DAY
    except ValueError:
        return None
    return number if 0 <= number < DAYS else None


def date(found: str, key: bytes, undo: bool) -> str | None:
    mark = re.search(r"\D", found)[0]
    parts = found.split(mark)
    year_first = len(parts[0]) == 4
    orders = ("ymd",) if year_first else ("dmy",) if mark == "." else ("mdy", "dmy")
    for order in orders:
        value = dict(zip(order, map(int, parts), strict=True))
        if (number := _day(value["y"], value["m"], value["d"])) is None:
            continue
        if order != orders[-1] or len(orders) == 1:
            new = datetime.date.fromordinal(FIRST_DAY + permute(number, DAYS, key, undo))
        else:
            # Day first only where month first is no date; the result must be such a day too.
            while True:
                number = permute(number, DAYS, key, undo)
                new = datetime.date.fromordinal(FIRST_DAY + number)
                if new.day > 12:
                    break
        width = {"y": 4, "m": 2, "d": 2}
        text = {"y": new.year, "m": new.month, "d": new.day}
        return mark.join(f"{text[c]:0{width[c]}d}" for c in order)
    return None


def email(found: str, key: bytes, undo: bool) -> str | None:
    local, _, domain = found.partition("@")
    return f"{classes_permuted(local, key, undo)}@{domain}"


def access_key(found: str, key: bytes, undo: bool) -> str | None:
    return found[:4] + classes_permuted(found[4:], key, undo)


def secret(found: str, key: bytes, undo: bool) -> str | None:
    name, mark, value = re.match(r"([^=:]*)([=:]\s*)(.*)", found, re.S).groups()
    hexadecimal = re.fullmatch(r"[0-9a-f]+", value)
    return name + mark + classes_permuted(value, key, undo, "abcdef" if hexadecimal else None)


def token(found: str, key: bytes, undo: bool) -> str | None:
    return found[0] + classes_permuted(found[1:-1], key, undo, "abcdef") + found[-1]


# Three digits in a row or with single separators, which every longer number has.
DIGITS = r"\d[ -]?\d[ -]?\d"

# Name, shape, change, and a short pattern that every text with the shape holds.
KINDS = [
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
     email, "@"),
    ("secret", r"\b(?:password|passwd|pwd|secret|api_?key|token)\s*[=:]\s*[^\s\"',;]{5,}[^\s\"',;.]",
     secret, "[=:]"),
    ("access_key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", access_key, "AKIA|ASIA"),
    ("token", r"(?:\"[0-9a-f]{32,64}\"|'[0-9a-f]{32,64}')", token, "[\"'][0-9a-f]{32}"),
    ("iban", r"\b[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b",
     iban, r"[A-Z]{2}\d{2}[ A-Z0-9]"),
    ("ipv4", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", ipv4, r"\d\.\d+\.\d"),
    ("date", r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}"
             r"|\d{2}\.\d{2}\.\d{4})(?![\d/-])", date, DIGITS),
    ("phone", r"(?<![\d-])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d-])",
     phone, DIGITS),
    ("social", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", social, DIGITS),
    ("card", r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])", card, DIGITS),
]
PATTERN = re.compile("|".join(f"(?P<{name}>{shape})" for name, shape, _, _ in KINDS))
CHANGE = {name: change for name, _, change, _ in KINDS}
# A text without any of these has no candidate and is passed over.
HINT = re.compile("|".join(dict.fromkeys(hint for *_, hint in KINDS)))


def kind_key(key: bytes, name: str) -> bytes:
    return hashlib.blake2b(name.encode(), key=key[:64], digest_size=32).digest()


def pseudonymise(text: str, key: bytes = KEY, undo: bool = False) -> tuple[str, list]:
    """(new text, [(kind, start, end in the new text)])."""
    if not text or not HINT.search(text):
        return text, []
    out, spans, at, size = [], [], 0, 0
    for match in PATTERN.finditer(text):
        name = match.lastgroup
        new = CHANGE[name](match[0], kind_key(key, name), undo)
        if new is None:
            continue
        out += (text[at:match.start()], new)
        size += match.start() - at
        spans.append((name, size, size + len(new)))
        size += len(new)
        at = match.end()
    return ("".join([*out, text[at:]]), spans) if spans else (text, spans)


def pseudonymous_texts(docs: DataFrame, key: bytes = KEY, undo: bool = False) -> DataFrame:
    """doc_id, text with pseudonyms, number of values, and the kind and place of each."""

    def run(batch):
        texts, counts, spans = [], [], []
        for value in batch["text"]:
            value = value.as_py()
            new, found = (None, []) if value is None else pseudonymise(value, key, undo)
            texts.append(new)
            counts.append(len(found))
            spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
        yield {"doc_id": batch["doc_id"], "text": pa.array(texts, pa.string()),
               "n_values": pa.array(counts, pa.int64()), "spans": spans}

    return map_arrow(docs, run, "doc_id long, text string, n_values long, "
                                "spans array<struct<kind:string,start:int,end:int>>")


def replaced_column(docs: DataFrame, column: str = "text", key: bytes = KEY) -> DataFrame:
    """The table with pseudonyms in one column and all other columns as they are."""
    schema, at = docs.schema, docs.columns.index(column)

    def run(batches):
        for batch in batches:
            new = [None if v is None else pseudonymise(v, key)[0]
                   for v in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, schema)


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymous_texts(id_and_text(table(spark, sf_dir, "documents")))
