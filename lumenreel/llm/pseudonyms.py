"""Format-preserving pseudonyms for personal data and secrets.

A value that passes the check of its kind (Luhn, mod 97, octets, calendar, ...) is read as a number
below the number of valid values of its format and moved by a keyed Feistel permutation of just that
range; the result is written in the same format and passes the same check. The permutation depends
on the key and the kind alone, so equal values stay equal in all documents and different ones stay
different.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import math
import re
import warnings
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, free_name

ROUNDS = 8
KEY_SETTING = "spark.lumenreel.pii.key"
DEMONSTRATION_KEY = "set-a-secret-of-your-own"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def permute(n: int, size: int, key: bytes, kind: str) -> int:
    """A keyed permutation of range(size): Feistel rounds over two residues, walked until the value is in range."""
    if size < 2:
        return n
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)

    def noise(r: int, x: int, most: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{kind}|{size}|{r}|{x}".encode(), key=key, digest_size=16 + (most.bit_length() + 7) // 8).digest(), "big") % most

    while True:
        x, y = divmod(n, b)
        for r in range(0, ROUNDS, 2):
            x = (x + noise(r, y, a)) % a
            y = (y + noise(r + 1, x, b)) % b
        n = x * b + y
        if n < size:
            return n


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def permute_classes(s: str, key: bytes, kind: str, classes: tuple[str, ...] = _CLASSES) -> str:
    """Move the string within all strings whose digits, small and capital letters stand in the same places."""
    at = [(i, c, c.index(ch)) for i, ch in enumerate(s) for c in classes if ch in c]
    n, size = 0, 1
    for _, c, v in at:
        n, size = n * len(c) + v, size * len(c)
    n = permute(n, size, key, f"{kind}|{''.join(str(classes.index(c)) for _, c, _ in at)}")
    out = list(s)
    for i, c, _ in reversed(at):
        n, v = divmod(n, len(c))
        out[i] = c[v]
    return "".join(out)


def _digits_into(s: str, digits: str) -> str:
    """The string with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c in "0123456789" else c for c in s)


def luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def card(s: str, key: bytes) -> str | None:
    d = re.sub(r"[ -]", "", s)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    body = str(permute(int(d[:-1]), 10 ** (len(d) - 1), key, "card")).zfill(len(d) - 1)
    return _digits_into(s, body + luhn_digit(body))


def iban(s: str, key: bytes) -> str | None:
    v = s.replace(" ", "")
    number = lambda x: int("".join(str(int(c, 36)) for c in x))
    if not 15 <= len(v) <= 34 or number(v[4:] + v[:4]) % 97 != 1:
        return None
    body = permute_classes(v[4:], key, "iban")
    made = v[:2] + f"{98 - number(body + v[:2] + '00') % 97:02d}" + body
    new = iter(made)
    return "".join(" " if c == " " else next(new) for c in s)


#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}


def card_ends(text: str, m: re.Match) -> list[int]:
    """Where a number that begins as `m` may end: the longest first, then before each digit group; a month of an expiry date comes last."""
    ends = [m.end(), *(m.start() + g.start() for g in reversed(list(re.finditer("[ -]", m[0]))))]
    return ends[1:] + ends[:1] if re.match(r"/\d", text[m.end() : m.end() + 2]) else ends


def iban_ends(text: str, m: re.Match) -> list[int]:
    """Where the country's length ends, if a group or word does, then the longest, then before each group."""
    ends = [m.end(), *(m.start() + g.start() for g in reversed(list(re.finditer(" ", m[0]))))]
    n = IBAN_LENGTHS.get(m[0][:2])
    return sorted(ends, key=lambda e: len(text[m.start() : e].replace(" ", "")) != n)


#: For kinds whose expression may take in what stands behind the value.
ENDS: dict[str, Callable[[str, re.Match], list[int]]] = {"iban": iban_ends, "card": card_ends}


def _moved(kind: str, pattern: re.Pattern, move: Callable[[str, bytes], str | None], text: str, key: bytes):
    """(start, end, new value, kind) of the values of a kind, in order of place."""
    if kind not in ENDS:
        for m in pattern.finditer(text):
            if (to := move(m[0], key)) is not None:
                yield m.start(), m.end(), to, kind
        return
    at = 0
    while m := pattern.search(text, at):
        for end in ENDS[kind](text, m):
            if (to := move(text[m.start() : end], key)) is not None:
                yield m.start(), end, to, kind
                at = end
                break
        else:  # a value may begin at the next group
            at = m.start() + len(re.match(r"[^ -]+", m[0])[0])


def ip(s: str, key: bytes) -> str | None:
    try:
        n = int(ipaddress.IPv4Address(s))
    except ValueError:
        return None
    return str(ipaddress.IPv4Address(permute(n, 1 << 32, key, "ip")))


def ssn(s: str, key: bytes) -> str | None:
    area, group, serial = (int(s[0:3]), int(s[4:6]), int(s[7:11]))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    areas = [a for a in range(1, 900) if a != 666]
    n = permute((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, len(areas) * 99 * 9999, key, "ssn")
    n, serial = divmod(n, 9999)
    area, group = divmod(n, 99)
    return f"{areas[area]:03d}{s[3]}{group + 1:02d}{s[6]}{serial + 1:04d}"


def phone(s: str, key: bytes) -> str | None:
    m = re.match(r"\+\d{1,3}(?=[ .(-])", s)
    head = m[0] if m else "+" if s[0] == "+" else ""
    d = re.sub(r"\D", "", s[len(head) :])
    if not 6 <= len(d) <= 14:
        return None
    # the first digit is never 0 if it wasn't: the number stays one that can be dialled
    low = 10 ** (len(d) - 1) if d[0] != "0" else 0
    size = 10 ** len(d) - low if low else 10 ** (len(d) - 1)
    return head + _digits_into(s[len(head) :], str(permute(int(d) - low, size, key, f"phone{len(d)}{bool(low)}") + low).zfill(len(d)))


_DATES = ((r"(\d{4})([-/.])(\d{2})\2(\d{2})", (0, 2, 3)), (r"(\d{2})([-/.])(\d{2})\2(\d{4})", (3, 2, 0)))


def date(s: str, key: bytes) -> str | None:
    """Year first, or day first and else month first; the order of the parts stays."""
    for pattern, (y, m, d) in _DATES:
        if found := re.fullmatch(pattern, s):
            g = found.groups()
            orders = ((y, m, d), (y, d, m)) if y else ((y, m, d),)
            for yy, mm, dd in orders:
                try:
                    n = datetime.date(int(g[yy]), int(g[mm]), int(g[dd])).toordinal()
                except ValueError:
                    continue
                if not FIRST_DAY <= n <= LAST_DAY:
                    return None
                to = datetime.date.fromordinal(FIRST_DAY + permute(n - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date"))
                out = [""] * 4
                out[yy], out[mm], out[dd] = f"{to.year:04d}", f"{to.month:02d}", f"{to.day:02d}"
                return g[1].join(x for x in out if x)
    return None


def email(s: str, key: bytes) -> str | None:
    name, _, host = s.rpartition("@")
    left, dot, top = host.rpartition(".")
    return permute_classes(name + "@" + left, key, "email") + dot + top


def secret(s: str, key: bytes) -> str | None:
    m = re.match(r"(?i)(?:AKIA|(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*)?", s)
    value = s[m.end() :]
    if not m[0] and not (re.search("[0-9]", value) and re.search("[a-f]", value)):
        return None
    hexa = re.fullmatch(r"[0-9a-f]+", value) and re.search(r"[a-f]", value)
    return m[0] + permute_classes(value, key, "secret", ("0123456789abcdef",) if hexa else _CLASSES)


#: In this order; where two kinds overlap the earlier one holds.
KINDS: tuple[tuple[str, re.Pattern, Callable[[str, bytes], str | None]], ...] = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"), email),
    ("secret", re.compile(r"\bAKIA[0-9A-Z]{16}\b|(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*[^\s,;]+)|\b[0-9a-f]{32,}\b"), secret),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), iban),
    ("card", re.compile(r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])"), card),
    ("date", re.compile(r"(?<!\d)(?:\d{4}[-/.]\d{2}[-/.]\d{2}|\d{2}[-/.]\d{2}[-/.]\d{4})(?!\d)"), date),
    ("ip", re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"), ip),
    ("ssn", re.compile(r"(?<![\d-])\d{3}[- ]\d{2}[- ]\d{4}(?![\d-])"), ssn),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{3}[ .-])\d{3}[ .-]?\d{4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)"), phone),
)
#: A text with none of these has no value of the kind: an at sign, a mark of assignment, a digit.
_DIGIT = frozenset("0123456789")
GATES = {k: frozenset("@") if k == "email" else _DIGIT | frozenset("=:") if k == "secret" else _DIGIT for k, *_ in KINDS}
_HINTS = re.compile(r"[0-9@=:]")


def pseudonymise_text(text: str | None, key: bytes) -> tuple[str | None, list[str]]:
    """The text with its values replaced, and the kinds replaced, in order of place."""
    if not text or not _HINTS.search(text):
        return text, []
    found: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []
    hints = set(_HINTS.findall(text))
    for kind, pattern, move in KINDS:
        if not hints & GATES[kind]:
            continue
        new = list(_moved(kind, pattern, move, text, key))
        if new and taken:
            marks = sorted(taken)
            k, free = 0, []
            for x in new:  # both in order of place
                while k < len(marks) and marks[k][1] <= x[0]:
                    k += 1
                if k == len(marks) or marks[k][0] >= x[1]:
                    free.append(x)
            new = free
        found += new
        taken += [(s, e) for s, e, _, _ in new]
    if not found:
        return text, []
    found.sort()
    parts, at = [], 0
    for s, e, to, _ in found:
        parts += [text[at:s], to]
        at = e
    return "".join([*parts, text[at:]]), [k for *_, k in found]


@lru_cache(maxsize=4)
def _key(secret_key: str) -> bytes:
    return hashlib.blake2b(secret_key.encode(), digest_size=32).digest()


def session_key(spark: SparkSession) -> str:
    """The key that the session names in KEY_SETTING. Without one the demonstration key is taken, which hides nothing from who reads this file."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms are made with the demonstration key", stacklevel=2)
    return key or DEMONSTRATION_KEY


def pseudonymise(docs: DataFrame, secret_key: str | None = None, column: str = "text", report: bool = True) -> DataFrame:
    """`docs` with pseudonyms in `column`; with report also n_pii (bigint) and pii_kinds (array of distinct kinds, sorted).

    All other columns and all rows stay as they are (n_pii and pii_kinds replace columns of those
    names). Null text: null, n_pii 0. Rows are independent, so repeated rows get equal results. Without
    secret_key the session's key is used. A text is worked on whole, however long it is.
    """
    secret_key = secret_key or session_key(docs.sparkSession)

    @F.arrow_udf("struct<text:string,kinds:array<string>>")
    def move(texts: pa.Array) -> pa.Array:
        key = _key(secret_key)
        out, kinds = [], []
        for t in texts:
            o, k = pseudonymise_text(t.as_py(), key)
            out.append(o)
            kinds.append(k)
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(kinds, pa.list_(pa.string()))], ["text", "kinds"])

    replaced = {column.lower(), *(("n_pii", "pii_kinds") if report else ())}
    at = free_name(docs, "moved")
    named = dict(zip(docs.columns, columns_of(docs), strict=True))
    done = docs.select(*[c for n, c in named.items() if n == column or n.lower() not in replaced], move(named[column].cast("string")).alias(at))
    moved = done[f"`{at}`"]
    cols = [moved["text"].alias(n) if n == column else c for n, c in zip(done.columns, columns_of(done), strict=True) if n != at]
    extra = [F.size(moved["kinds"]).cast("bigint").alias("n_pii"), F.array_sort(F.array_distinct(moved["kinds"])).alias("pii_kinds")] if report else []
    return done.select(*cols, *extra)
