"""PII: format-preserving Feistel pseudonyms of validated numbers, dates, and addresses.

Found values are replaced by others of the same format. Each is read as a whole number below
the size of its format's domain and permuted there by a keyed Feistel network with cycle
walking, a bijection: equal values get equal pseudonyms in all documents, different values
different ones, and the key's holder can undo it.

kind      what is found                                        what changes
card      13 to 19 digits with a right check digit (Luhn)      all but the first and the check digit,
                                                               which is computed anew
iban      country, check digits right modulo 97                the account part, letters stay letters;
                                                               check digits are computed anew
ssn       3-2-4 digits in the assigned ranges                  the number, within the assigned ranges
phone     +1 and 10 digits, area code from 200                 the ten digits, within the same rule
ip        four numbers up to 255                               the address
date      year-month-day or day.month.year, day/month/year     the day, among all days of 1900 to 2099
email     local@domain with a top-level domain                 letters and digits of the local part

Separators, letter case and visible zero padding stay. A date is one value in every way of
writing it.
Values that fail their check are left alone, so clean texts do not change. Where two kinds
overlap the first in the table wins.

Defined results: null texts stay null and empty ones empty; neither has findings. Rows are
handled one by one: repeated rows get equal results, and other columns are untouched.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = b"failscope example key"
ROUNDS = 8
_FIRST, _LAST = dt.date(1900, 1, 1), dt.date(2099, 12, 31)

PATTERNS = {
    "card": r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\w)",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)",
    "date": r"(?<![\w./-])(?:\d{4}(?P<s1>[./-])\d{1,2}(?P=s1)\d{1,2}"
            r"|\d{1,2}(?P<s2>[./-])\d{1,2}(?P=s2)\d{4})(?![\w/-]|\.\d)",
    "email": r"(?<![\w.+%-])[A-Za-z0-9][\w.+%-]*@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}(?!\w)",
}
_ANY = re.compile("|".join(f"(?P<{kind}>{p})" for kind, p in PATTERNS.items()), re.ASCII)


class Permutation:
    """A keyed bijection of range(size): balanced Feistel rounds and cycle walking."""

    def __init__(self, key: bytes, name: str, size: int) -> None:
        self.size = size
        self.half = max(1, ((size - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.mac = hmac.new(key, f"{name}:{size}".encode(), hashlib.sha256)

    def _round(self, number: int, half: int) -> int:
        mac = self.mac.copy()
        mac.update(bytes([number]) + half.to_bytes((self.half + 7) // 8, "little"))
        digest = mac.digest()
        while len(digest) * 8 < self.half:
            digest += hashlib.sha256(digest).digest()
        return int.from_bytes(digest, "little") & self.mask

    def _once(self, value: int, order: range) -> int:
        left, right = value >> self.half, value & self.mask
        if order.step == 1:
            for i in order:
                left, right = right, left ^ self._round(i, right)
        else:
            for i in order:
                left, right = right ^ self._round(i, left), left
        return left << self.half | right

    def __call__(self, value: int) -> int:
        value = self._once(value, range(ROUNDS))
        while value >= self.size:
            value = self._once(value, range(ROUNDS))
        return value

    def undo(self, value: int) -> int:
        value = self._once(value, range(ROUNDS - 1, -1, -1))
        while value >= self.size:
            value = self._once(value, range(ROUNDS - 1, -1, -1))
        return value


def luhn_digit(digits: str) -> str:
    """The check digit that makes ``digits`` + it right."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return str(-total % 10)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _refill(shape: str, new: str, take: Callable[[str], bool]) -> str:
    """``shape`` with its characters that ``take`` accepts replaced by those of ``new``."""
    rest = iter(new)
    return "".join(next(rest) if take(c) else c for c in shape)


class Pseudonyms:
    """Replace or restore values under one key."""

    def __init__(self, key: bytes = KEY) -> None:
        self.key = key
        self.permutation = lru_cache(4096)(lambda name, size: Permutation(key, name, size))

    def _move(self, name: str, value: int, size: int, back: bool) -> int:
        p = self.permutation(name, size)
        return p.undo(value) if back else p(value)

    def card(self, found: str, back: bool) -> str | None:
        digits = re.sub(r"\D", "", found)
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        body = digits[1:-1]
        moved = self._move("card", int(body), 10 ** len(body), back)
        body = digits[0] + str(moved).zfill(len(body))
        if len(set(body + luhn_digit(body))) == 1:  # such numbers count as no card
            return None
        return _refill(found, body + luhn_digit(body), str.isdigit)

    def iban(self, found: str, back: bool) -> str | None:
        plain = found.replace(" ", "")
        if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
            return None
        account = self._characters("iban" + plain[:2], plain[4:], back)
        check = 98 - _mod97(account + plain[:2] + "00")
        return _refill(found, f"{plain[:2]}{check:02d}{account}", lambda c: c != " ")

    def _characters(self, name: str, text: str, back: bool) -> str:
        """Letters to letters of their case and digits to digits, all as one number."""
        bases = [10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 1 for c in text]
        value, size = 0, 1
        for c, base in zip(text, bases):
            at = int(c) if base == 10 else ord(c.lower()) - 97 if base == 26 else 0
            value, size = value * base + at, size * base
        shape = "".join("9" if b == 10 else "a" if b == 26 else c for c, b in zip(text, bases))
        value = self._move(name + shape, value, size, back)
        out = []
        for c, base in zip(reversed(text), reversed(bases)):
            value, at = divmod(value, base)
            if base == 1:
                out.append(c)
            elif base == 10:
                out.append(str(at))
            else:
                out.append(chr(at + (65 if c.isupper() else 97)))
        return "".join(reversed(out))

    def ssn(self, found: str, back: bool) -> str | None:
        area, group, serial = (int(x) for x in found.split("-"))
        if not 1 <= area <= 899 or area == 666 or not group or not serial:
            return None
        area -= 1 + (area > 666)
        value = (area * 99 + group - 1) * 9999 + serial - 1
        value, serial = divmod(self._move("ssn", value, 898 * 99 * 9999, back), 9999)
        area, group = divmod(value, 99)
        area += 1 + (area >= 665)
        return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"

    def phone(self, found: str, back: bool) -> str | None:
        digits = re.sub(r"\D", "", found)[1:]
        if digits[0] in "01" or digits[3] in "01":
            return None
        area, office, line = int(digits[:3]) - 200, int(digits[3:6]) - 200, int(digits[6:])
        value = self._move("phone", (area * 800 + office) * 10_000 + line, 800 * 800 * 10_000, back)
        value, line = divmod(value, 10_000)
        area, office = divmod(value, 800)
        return found[:2] + _refill(
            found[2:], f"{area + 200}{office + 200}{line:04d}", str.isdigit)

    def ip(self, found: str, back: bool) -> str | None:
        parts = [int(x) for x in found.split(".")]
        if max(parts) > 255 or any(x[0] == "0" and len(x) > 1 for x in found.split(".")):
            return None
        value = int.from_bytes(bytes(parts), "big")
        return ".".join(map(str, self._move("ip", value, 1 << 32, back).to_bytes(4, "big")))

    def date(self, found: str, back: bool) -> str | None:
        parts = re.split(r"[./-]", found)
        separator = re.search(r"[./-]", found)[0]
        first = len(parts[0]) == 4
        year, month, day = (int(x) for x in (parts if first else parts[::-1]))
        try:
            value = dt.date(year, month, day)
        except ValueError:
            return None
        if not _FIRST <= value <= _LAST:
            return None
        days = (_LAST - _FIRST).days + 1
        moved = _FIRST + dt.timedelta(self._move("date", (value - _FIRST).days, days, back))
        small = parts[1:] if first else parts[:2]
        padded = any(x[0] == "0" for x in small) or all(len(x) == 2 for x in small)
        width = "02d" if padded else "d"
        m, d = f"{moved.month:{width}}", f"{moved.day:{width}}"
        return separator.join([f"{moved.year}", m, d] if first else [d, m, f"{moved.year}"])

    def email(self, found: str, back: bool) -> str | None:
        local, domain = found.split("@", 1)
        return f"{self._characters('email@' + domain.lower(), local, back)}@{domain}"

    def replace(self, text: str, back: bool = False) -> tuple[str, list[tuple[str, int, int, str]]]:
        """The new text, and (kind, start, end, pseudonym) of each value, in order."""
        found: list[tuple[str, int, int, str]] = []
        out, at, search = [], 0, 0
        while m := _ANY.search(text, search):
            new = getattr(self, m.lastgroup)(m[0], back)
            if new is None:
                # what failed one check may hold another kind behind its start
                search = m.start() + 1
                while search < m.end() and text[search].isdigit() and text[search - 1].isdigit():
                    search += 1
                continue
            found.append((m.lastgroup, m.start(), m.end(), new))
            out += [text[at: m.start()], new]
            at = search = m.end()
        return "".join([*out, text[at:]]), found


def pseudonymise(docs: DataFrame, key: bytes = KEY, back: bool = False) -> DataFrame:
    """``docs`` with the text replaced (``back``: restored); all other columns as they are."""

    @F.pandas_udf("string")
    def swap(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tool = Pseudonyms(key)
        for part in texts:
            yield pd.Series([t if t is None else tool.replace(t, back)[0] for t in part.tolist()],
                            dtype=object)

    return docs.withColumn("text", swap("text"))


def findings(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """A row for each document that holds values: doc_id, n_found, kinds, pseudonyms, text.

    ``kinds`` and ``pseudonyms`` are lists in the order of the text, which is the new text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Pseudonyms(key)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                new, found = tool.replace(text or "")
                if found:
                    rows.append((doc, len(found), [f[0] for f in found], [f[3] for f in found], new))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([
                pa.array(c, kind) for c, kind in zip(columns, (
                    pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()),
                    pa.string()))], names=["doc_id", "n_found", "kinds", "pseudonyms", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_found long, kinds array<string>, pseudonyms array<string>, text string")
