"""Pseudonyms for personal numbers and dates that keep their format.

Card numbers (Luhn), IBANs (mod 97), US social security numbers, phone numbers, IPv4 addresses, dates
and the local parts of e-mail addresses are found by pattern and validated. A candidate that runs into the
text behind it is cut at the ends of its parts (an IBAN to its country's length; a phone number before
another valid value, to its country's number of digits, or else to as many as are valid); where none is
valid the search goes on at the candidate's next character, and only what is in no valid value stays as it
is. The number of digits is known for the countries of ``PHONE_DIGITS`` only: elsewhere digits that follow
a phone number after one separator may be taken for its end. A valid value is taken as a number within the domain of its format (digits of that
length, days of two centuries, ...), permuted there by a keyed Feistel network (the walk goes on while it
is outside the domain or not valid), and written back in its own layout. The permutation depends on the
key, the kind and the number of characters only: equal values get equal pseudonyms in all documents,
also when written with other separators, and different values of a format stay different.

NULL text stays NULL, with nothing found; empty text stays empty. Rows are independent, so repeated rows
give repeated results and an empty table gives none. Extra columns are kept (``n_replaced`` and
``kinds`` excepted, which are replaced).
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from weekpulse.llm.tables import by_batch

ROUNDS = 10
DIGITS = "0123456789"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

FOUND = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9]))"
    r"|(?P<phone>\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"
    r"|(?<![0-9+])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
    r"|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9]))"
    r"|(?P<card>(?<![0-9])(?:[0-9]{4}(?P<sep>[ -])[0-9]{4}(?P=sep)[0-9]{4}(?P=sep)[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9]))"
    r"|(?P<ip>(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9]))"
    r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
    r"|(?P<date>(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{4})(?![0-9]|[/.-][0-9]))"
)

# Characters of an IBAN, by country.
IBAN_LENGTH = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
        21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO EG GT HN HU LB NI PL SV", 29: "BR PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
        32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
# Digits of a phone number with its country's code, where there are one or two counts.
PHONE_DIGITS = {
    "1": (11,), "7": (11,), "27": (11,), "30": (12,), "31": (11,), "32": (10, 11), "33": (11,), "34": (11,),
    "40": (11,), "41": (11,), "44": (11, 12), "45": (10,), "47": (10,), "48": (11,), "52": (12,), "61": (11,),
    "63": (12,), "65": (10,), "90": (12,), "91": (12,), "351": (12,), "380": (12,), "420": (12,), "421": (12,),
}
FEWEST, MOST = 8, 15


def permuted(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0..size-1: a Feistel network on two digits of about the root of size."""
    if size < 2:
        return value
    high = math.isqrt(size - 1) + 1
    low = -(-size // high)
    while True:
        left, right = divmod(value, low)
        for turn in range(ROUNDS):
            text = f"{tweak}|{size}|{turn}|{left if turn % 2 else right}".encode()
            mixed = int.from_bytes(hashlib.blake2b(text, key=key, digest_size=16).digest())
            if turn % 2:
                right = (right + mixed) % low
            else:
                left = (left + mixed) % high
        value = left * low + right
        if value < size:
            return value


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def laid_out(digits: str, layout: str) -> str:
    """The digits in the places where the layout has some."""
    own = iter(digits)
    return "".join(next(own) if c in DIGITS else c for c in layout)


def luhn(digits: str) -> int:
    """0 for a valid number."""
    total = 0
    for at, c in enumerate(reversed(digits)):
        double = int(c) * (1 + at % 2)
        total += double - 9 * (double > 9)
    return total % 10


def card(text: str, key: bytes) -> str | None:
    digits = digits_of(text)
    if not 13 <= len(digits) <= 19 or luhn(digits) or digits.count(digits[0]) == len(digits):
        return None
    inner = digits[1:-1]
    new = digits[0] + str(permuted(int(inner), 10 ** len(inner), key, "card")).zfill(len(inner))
    return laid_out(new + str(-luhn(new + "0") % 10), text)


def phone(text: str, key: bytes) -> str | None:
    digits = digits_of(text)
    # The country's code stays: one digit for +1 and +7, else two.
    kept = (1 if digits[0] in "17" else 2) if text[0] == "+" else 0
    own = digits[kept:]
    if not FEWEST <= len(digits) <= MOST:
        return None
    new = permuted(int(own), 10 ** len(own), key, f"phone{digits[:kept] or '1'}")
    return laid_out(digits[:kept] + str(new).zfill(len(own)), text)


def ip(text: str, key: bytes) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255:
        return None
    new = permuted(int.from_bytes(bytes(parts)), 1 << 32, key, "ip")
    return ".".join(map(str, new.to_bytes(4)))


def valid_ssn(value: int) -> bool:
    area, group, serial = value // 1_000_000, value // 10_000 % 100, value % 10_000
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def ssn(text: str, key: bytes) -> str | None:
    value = int(digits_of(text))
    if not valid_ssn(value):
        return None
    value = permuted(value, 10**9, key, "ssn")
    while not valid_ssn(value):
        value = permuted(value, 10**9, key, "ssn")
    return laid_out(str(value).zfill(9), text)


def date(text: str, key: bytes) -> str | None:
    """Year first, or day before month unless only the other way is a date."""
    mark = next(c for c in text if c not in DIGITS)
    parts = text.split(mark)
    for order in ((0, 1, 2),) if mark == "-" else ((2, 1, 0), (2, 0, 1)):
        try:
            day = datetime.date(*(int(parts[at]) for at in order)).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        new = datetime.date.fromordinal(FIRST_DAY + permuted(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date"))
        values = dict(zip(order, (new.year, new.month, new.day)))
        # Written without leading zeros only where the text is.
        wide = all(len(x) > 1 for x in parts)
        return mark.join(str(values[at]).zfill(2 if wide else 1) for at in range(3))
    return None


def within_classes(text: str, key: bytes, tweak: str) -> str:
    """Digits, small and capital letters each permuted to their like; all else stays."""
    value, size = 0, 1
    for c in text:
        for start, n in (("0", 10), ("a", 26), ("A", 26)):
            at = ord(c) - ord(start)
            if 0 <= at < n:
                value, size = value * n + at, size * n
    value = permuted(value, size, key, tweak)
    out = []
    for c in reversed(text):
        for start, n in (("0", 10), ("a", 26), ("A", 26)):
            if 0 <= ord(c) - ord(start) < n:
                value, at = divmod(value, n)
                c = chr(ord(start) + at)
                break
        out.append(c)
    return "".join(reversed(out))


def email(text: str, key: bytes) -> str | None:
    local, _, domain = text.partition("@")
    return f"{within_classes(local, key, 'email')}@{domain}"


def iban_check(country: str, rest: str) -> int:
    return int("".join(str(int(c, 36)) for c in f"{rest}{country}00")) % 97


def iban(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "")
    country, check, rest = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or 98 - iban_check(country, rest) != int(check):
        return None
    rest = within_classes(rest, key, f"iban{country}")
    new = iter(f"{country}{98 - iban_check(country, rest):02d}{rest}")
    return "".join(c if c == " " else next(new) for c in text)


KINDS: dict[str, Callable[[str, bytes], str | None]] = {
    "email": email, "iban": iban, "phone": phone, "card": card, "ip": ip, "ssn": ssn, "date": date,
}


def borders(found: re.Match, marks: str) -> list[int]:
    """Where the candidate's parts end, the longest first."""
    text, start, end = found.string, *found.span()
    return [end, *(at for at in range(end - 1, start, -1) if text[at] in marks and text[at - 1].isalnum())]


def iban_ends(found: re.Match) -> list[int]:
    text, start = found.string, found.start()
    ends = borders(found, " ")
    known = IBAN_LENGTH.get(text[start : start + 2])
    if known is None:
        return ends
    return [end for end in ends if len(text[start:end].replace(" ", "")) == known] + ends[:1]


def phone_ends(found: re.Match, key: bytes) -> list[int]:
    text, start = found.string, found.start()
    ends = borders(found, " .-")
    if text[start] != "+":
        return ends
    n_digits = {end: len(digits_of(text[start:end])) for end in ends}
    digits = digits_of(found[0])
    known = next((PHONE_DIGITS[digits[:n]] for n in (1, 2, 3) if digits[:n] in PHONE_DIGITS), ())
    valid = [end for end in ends if FEWEST <= n_digits[end] <= MOST]
    # One in ten runs of groups has a card's check digit, so that it yields to a known number of digits.
    passed = {"phone", "card"} if any(n_digits[end] in known for end in ends) else {"phone"}
    # The number ends before another value, as a date, or with all of it when too short without.
    for at in reversed(ends[1:]):
        if (other := FOUND.match(text, at + 1)) and other.lastgroup not in passed:
            if KINDS[other.lastgroup](other[0], key) is not None:
                whole = n_digits[at] < FEWEST
                valid = [end for end in valid if end <= at or whole and end >= other.end()]
                break
    return [end for end in valid if n_digits[end] in known] + valid


def valid_value(found: re.Match, key: bytes) -> tuple[int, str] | None:
    """Where the candidate's value ends, and its pseudonym."""
    kind = found.lastgroup
    ends = phone_ends(found, key) if kind == "phone" else iban_ends(found) if kind == "iban" else [found.end()]
    for end in ends:
        new = KINDS[kind](found.string[found.start() : end], key)
        if new is not None:
            return end, new
    return None


def pseudonymised(text: str, key: bytes) -> tuple[str, list[str]]:
    """The text with its pseudonyms, and the kind of each value replaced."""
    kinds: list[str] = []
    parts: list[str] = []
    done = at = 0
    while found := FOUND.search(text, at):
        value = valid_value(found, key)
        if value is None:
            at = found.start() + 1
            continue
        end, new = value
        parts += (text[done : found.start()], new)
        kinds.append(found.lastgroup)
        done = at = end
    return "".join((*parts, text[done:])), kinds


HAS_DIGIT_OR_AT = re.compile(r"[0-9@]")


def pii_pseudonyms(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """The rows with pseudonyms in their text, n_replaced and the kinds replaced."""
    docs = docs.drop("n_replaced", "kinds")
    names = docs.columns
    at = names.index(text_col)
    places = [f"c{k}" for k in range(len(names))]
    placed = docs.toDF(*places)

    def to_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [
            pseudonymised(text, key) if text and HAS_DIGIT_OR_AT.search(text) else (text, [])
            for text in batch.column(at).to_pylist()
        ]
        columns = [
            *batch.columns,
            pa.array([len(kinds) for _, kinds in rows], pa.int64()),
            pa.array([sorted(set(kinds)) for _, kinds in rows], pa.list_(pa.string())),
        ]
        columns[at] = pa.array([text for text, _ in rows], pa.string())
        return pa.RecordBatch.from_arrays(columns, [*places, "n_replaced", "kinds"])

    schema = StructType(
        [*placed.schema, StructField("n_replaced", LongType()), StructField("kinds", ArrayType(StringType()))]
    )
    return by_batch(placed, to_batch, schema).toDF(*names, "n_replaced", "kinds")
