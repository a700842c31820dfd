"""Operator 2: personal data as format-preserving Feistel pseudonyms.

Numbers and dates that pass their format's validation are replaced by others of
the same format: a keyed Feistel network permutes the values of a format among
themselves, so a value has one pseudonym in all documents (however it is
punctuated), different values have different ones, and who holds the key can go back.
Values outside the valid ones are skipped by walking the permutation's cycle.

=========  ==============================  ==================================================
kind       valid                           permuted
=========  ==============================  ==================================================
card       13 to 19 digits, Luhn sum       all digits but the last, which is computed anew
iban       2 letters, mod-97 check         the account's digits; the check digits computed anew
phone      10 digits, area and office 2-9  these 10 digits; a country code 1 stays
ssn        area, group and serial in use   the 9 digits
ip         four numbers up to 255          the 32 bits
date       days of 1900 to 2099            the day, written in the same form
email      name and domain                 letters and digits of the name, by case
=========  ==============================  ==================================================

Numeric dates with slashes or dots are read as day first if the first number
cannot be a month, or the separator is a dot; else as month first.

A space may part an IBAN's groups or end it, so where the longest reading is not
valid the shorter ones up to a space are tried (of a known country its own length first), and the search
goes on right behind a valid value, or behind the first character of an invalid one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date
from hashlib import blake2b
from math import isqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, table, with_values

ROUNDS = 10
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November",
          "December")
_MONTH = "|".join(f"{m}|{m[:3]}" for m in MONTHS)
PATTERN = re.compile(rf"""
    (?P<email>(?<![\w.%+-])[A-Za-z0-9._%+-]{{1,64}}+@(?:[A-Za-z0-9-]{{1,63}}\.){{1,4}}[A-Za-z]{{2,24}}(?![\w-]))
  | (?P<iban>(?<!\w)[A-Z]{{2}}[0-9]{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,3}})?(?!\w))
  | (?P<ip>(?<![\w.])(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}(?!\w|\.[0-9]))
  | (?P<iso>(?<![\w-])[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(?:(?=[Tt][0-9])|(?![\w-])))
  | (?P<ssn>(?<![\w-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![\w-]))
  | (?P<phone>(?<![\w+])(?:\+?1[ .-]?)?(?:\([0-9]{{3}}\)[ ]?|[0-9]{{3}}[ .-])[0-9]{{3}}[ .-][0-9]{{4}}(?!\w))
  | (?P<card>(?<![\w-])(?:[0-9]{{13,19}}|[0-9]{{4}}(?P<gap>[ -])[0-9]{{4}}(?P=gap)[0-9]{{4}}(?P=gap)[0-9]{{4}}
        |[0-9]{{4}}(?P<gap2>[ -])[0-9]{{6}}(?P=gap2)[0-9]{{5}})(?![\w-]))
  | (?P<numeric>(?<![\w./])[0-9]{{1,2}}(?P<sep>[./])[0-9]{{1,2}}(?P=sep)[0-9]{{4}}(?![\w/]))
  | (?P<named>(?<!\w)(?:[0-9]{{1,2}}[ ](?:{_MONTH})|(?:{_MONTH})[ ][0-9]{{1,2}},)[ ][0-9]{{4}}(?!\w))
""", re.X)

# fixed values: characters of an IBAN by country
IBAN_LENGTH = {country: n for n, names in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for country in names.split()}
SHORTEST_IBAN = 12

_HINT = re.compile("[0-9@]")
BEFORE, AFTER = 80, 400  # every match lies so near before and after each of its digits or its @


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Where matches of ``PATTERN`` can lie: around digits and @."""
    at = upto = 0
    for hint in _HINT.finditer(text):
        if hint.start() >= upto + BEFORE and upto:
            yield at, upto
            upto = 0
        if not upto:
            at = max(0, hint.start() - BEFORE)
        upto = hint.start() + AFTER
    if upto:
        yield at, upto


def matches(text: str) -> Iterator[re.Match]:
    """All matches of ``PATTERN``, looked for only in ``windows``."""
    for at, upto in windows(text):
        yield from PATTERN.finditer(text, at, upto)


def readings(m: re.Match) -> list[str]:
    """What a match may be: itself, and for an IBAN also its beginnings up to a space."""
    if m.lastgroup != "iban":
        return [m[0]]
    ends = [len(m[0]), *(x.start() for x in re.finditer(" ", m[0]))]
    size = {end: end - m[0].count(" ", 0, end) for end in ends}
    usual = IBAN_LENGTH.get(m[0][:2])
    return [m[0][:end] for end in sorted(ends, key=lambda end: (size[end] != usual, -end)) if size[end] >= SHORTEST_IBAN]


class Feistel:
    """A keyed permutation of 0 .. size - 1, by alternating Feistel rounds on a grid of two halves."""

    def __init__(self, key: bytes, size: int, tweak: str):
        self.size, self.seed = size, key
        self.left = max(1, isqrt(size - 1) + 1)
        self.right = -(-size // self.left)
        self.tweak = f"{tweak}/{size}/".encode()

    def _round(self, i: int, half: int) -> int:
        data = self.tweak + i.to_bytes(1, "big") + half.to_bytes((half.bit_length() + 7) // 8 + 1, "big")
        return int.from_bytes(blake2b(data, key=self.seed, digest_size=32).digest(), "big")

    def _once(self, x: int, back: bool) -> int:
        a, b = divmod(x, self.right)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if i % 2:
                b = (b + (-1 if back else 1) * self._round(i, a)) % self.right
            else:
                a = (a + (-1 if back else 1) * self._round(i, b)) % self.left
        return a * self.right + b

    def permute(self, x: int, valid: Callable[[int], bool] = lambda x: True, back: bool = False) -> int:
        """The image of ``x`` (of which ``valid`` must hold) among the valid values; ``back``: its origin."""
        while True:
            x = self._once(x, back)
            if x < self.size and valid(x):
                return x


def luhn_digit(payload: str) -> str:
    """The digit that completes ``payload`` to a Luhn sum of 0 modulo 10."""
    doubled = (int(c) * (2 if i % 2 == 0 else 1) for i, c in enumerate(reversed(payload)))
    return str(-sum(d - 9 if d > 9 else d for d in doubled) % 10)


def iban_check(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    fresh = iter(digits)
    return "".join(next(fresh) if c.isdigit() else c for c in shape)


class Pseudonyms:
    """The pseudonyms of one key; ``back`` gives the originals of pseudonyms."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back, self.ways = key, back, {}

    def _permute(self, kind: str, x: int, size: int, valid: Callable[[int], bool] = lambda x: True) -> int:
        way = self.ways.get((kind, size))
        if way is None:
            way = self.ways[kind, size] = Feistel(self.key, size, kind)
        return way.permute(x, valid, self.back)

    def card(self, value: str) -> str | None:
        digits = re.sub(r"\D", "", value)
        n = len(digits) - 1
        if digits[0] == "0" or luhn_digit(digits[:-1]) != digits[-1]:
            return None
        new = str(self._permute("card", int(digits[:-1]), 10 ** n, lambda x: x >= 10 ** (n - 1)))
        return _refill(value, new + luhn_digit(new))

    def iban(self, value: str) -> str | None:
        plain = value.replace(" ", "")
        country, check, account = plain[:2], plain[2:4], plain[4:]
        digits = re.sub(r"\D", "", account)
        if not digits or iban_check(country, account) != check:
            return None
        letters = re.sub(r"\d", "#", account)
        new = f"{self._permute(f'iban {country}{letters}', int(digits), 10 ** len(digits)):0{len(digits)}d}"
        return _refill(value, iban_check(country, _refill(account, new)) + new)

    def phone(self, value: str) -> str | None:
        digits = re.sub(r"\D", "", value)
        lead, digits = digits[:-10], digits[-10:]
        valid = lambda x: x // 10 ** 9 >= 2 and x // 10 ** 6 % 10 >= 2
        if not valid(int(digits)):
            return None
        return _refill(value, f"{lead}{self._permute('phone', int(digits), 10 ** 10, valid):010d}")

    def ssn(self, value: str) -> str | None:
        valid = lambda x: (x // 10 ** 6 not in (0, 666) and x // 10 ** 6 < 900
                           and x // 10 ** 4 % 100 > 0 and x % 10 ** 4 > 0)
        x = int(value.replace("-", ""))
        return _refill(value, f"{self._permute('ssn', x, 10 ** 9, valid):09d}") if valid(x) else None

    def ip(self, value: str) -> str | None:
        parts = [int(p) for p in value.split(".")]
        if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in value.split(".")):
            return None
        x = self._permute("ip", int.from_bytes(bytes(parts), "big"), 1 << 32)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _day(self, year: int, month: int, day: int) -> date | None:
        try:
            at = date(year, month, day).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= at <= LAST_DAY:
            return None
        return date.fromordinal(FIRST_DAY + self._permute("date", at - FIRST_DAY, LAST_DAY - FIRST_DAY + 1))

    def iso(self, value: str) -> str | None:
        new = self._day(*map(int, value.split("-")))
        return new and new.isoformat()

    def numeric(self, value: str) -> str | None:
        a, sep, b, _, year = re.split(r"([./])", value)
        day_first = sep == "." or int(a) > 12
        new = self._day(int(year), int(b), int(a)) if day_first else self._day(int(year), int(a), int(b))
        if new is None:
            return None
        if not day_first or sep == "." or new.day > 12:
            one, two = (new.day, new.month) if day_first else (new.month, new.day)
        else:  # a day up to 12 in front would be read as a month
            one, two = new.month, new.day
        return f"{one:0{len(a)}d}{sep}{two:0{len(b)}d}{sep}{new.year}"

    def named(self, value: str) -> str | None:
        name = re.search("[A-Za-z]+", value)[0]
        month = next(i for i, m in enumerate(MONTHS, 1) if name in (m, m[:3]))
        day, year = map(int, re.findall("[0-9]+", value))
        new = self._day(year, month, day)
        if new is None:
            return None
        full = MONTHS[new.month - 1]
        written = full if name == MONTHS[month - 1] else full[:3]
        return f"{written} {new.day}, {new.year}" if value[0].isalpha() else f"{new.day} {written} {new.year}"

    def email(self, value: str) -> str | None:
        name, _, domain = value.partition("@")
        radix = [10 if c.isdigit() else 26 if c.isalpha() else 1 for c in name]
        lowest = [ord("0") if c.isdigit() else ord("a") if c.islower() else ord("A") if c.isupper() else ord(c) for c in name]
        size = x = 0
        for c, r, low in zip(name, radix, lowest):
            x, size = x * r + ord(c) - low, (size or 1) * r
        if size < 2:
            return None
        x = self._permute("email " + "".join(f"{r}/{low} " for r, low in zip(radix, lowest)), x, size)
        out = []
        for r, low in zip(reversed(radix), reversed(lowest)):
            x, d = divmod(x, r)
            out.append(chr(low + d))
        return "".join(reversed(out)) + "@" + domain

    def replace(self, text: str | None) -> dict:
        """The text with pseudonyms, and (kind, start, length, pseudonym) of each in the original."""
        if text is None:
            return {"text": None, "found": []}
        found, out, at = [], [], 0
        for near, upto in windows(text):
            while m := PATTERN.search(text, near, upto):
                near = m.start() + 1
                for value in readings(m):
                    new = getattr(self, m.lastgroup)(value)
                    if new is not None:
                        kind = "date" if m.lastgroup in ("iso", "numeric", "named") else m.lastgroup
                        found.append({"kind": kind, "start": m.start(), "length": len(value), "pseudonym": new})
                        out += [text[at:m.start()], new]
                        at = near = m.start() + len(value)
                        break
        return {"text": "".join([*out, text[at:]]) if found else text, "found": found}


FOUND = T.StructType([T.StructField("text", T.StringType()), T.StructField("found", T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("pseudonym", T.StringType())])))])


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", into: str = "pii", back: bool = False) -> DataFrame:
    """``docs`` with ``text`` replaced and the array ``into`` of (kind, start, length, pseudonym).

    ``start`` and ``length`` are in characters of the original text. ``back`` undoes it with the same key, but
    for day-first slash dates whose pseudonym is written month first, and for a value that stands by groups with which
    its pseudonym happens to pass the check of a longer or earlier card or IBAN.
    Null texts stay null and empty ones empty, with an empty array; repeated rows
    are treated alike; an empty table gives no rows; other columns are kept. A clashing ``into`` gets underscores.
    """
    into = free_name(docs, into)
    names = Pseudonyms(key, back)
    done = with_values(docs, text, lambda ts: [names.replace(t) for t in ts], into, FOUND, keep_text=False)
    return done.select(*[F.col(f"{into}.text").alias(c) if c == text else done[c] for c in docs.columns],
                       F.col(f"{into}.found").alias(into))


def op2_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("tillroll.pii.key", "a key for tests only").encode()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, key).select("doc_id", "text", F.size("pii").alias("n_replaced"), "pii")
