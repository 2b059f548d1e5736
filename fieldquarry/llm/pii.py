"""Format-preserving pseudonyms for personal data and secrets in text.

Found values are validated (Luhn, mod 97, calendar, ranges) and permuted within their format by a keyed Feistel network:
a value is an integer below the number of values of its format, its halves are mixed by keyed hashes, and results out
of range are sent through again. Equal values get equal pseudonyms in every document, different ones different ones,
and the key's holder can invert them. There is no shared state: each text is rewritten on its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, slices

ROUNDS = 8


class Feistel:
    """A keyed permutation of the integers below ``size``, one for each ``tweak``."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _mix(self, value: int, turn: int, bits: int, tweak: bytes) -> int:
        told = b"%d|%d|%b" % (turn, value, tweak)
        out, k = b"", 0
        while 8 * len(out) < bits:
            out += hashlib.blake2b(told, key=self.key, salt=k.to_bytes(4, "big")).digest()
            k += 1
        return int.from_bytes(out, "big") & ((1 << bits) - 1)

    def _once(self, x: int, half: int, tweak: bytes, back: bool) -> int:
        mask = (1 << half) - 1
        a, b = x >> half, x & mask
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                a, b = b ^ self._mix(a, turn, half, tweak), a
            else:
                a, b = b, a ^ self._mix(b, turn, half, tweak)
        return a << half | b

    def walk(self, x: int, size: int, tweak: bytes, fits: Callable[[int], bool] = lambda _: True, back: bool = False) -> int:
        """The next value of x's cycle that is below ``size`` and fits; x itself must."""
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        while True:
            x = self._once(x, half, tweak, back)
            if x < size and fits(x):
                return x


def luhn(digits: str) -> bool:
    return _luhn_sum(digits) % 10 == 0


def _luhn_sum(digits: str) -> int:
    return sum(int(c) if i % 2 == 0 else (2 * int(c)) // 10 + (2 * int(c)) % 10 for i, c in enumerate(reversed(digits)))


def _fill(shape: str, digits: str) -> str:
    """``digits`` in the places of the digits of ``shape``."""
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in shape)


_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _letters(f: Feistel, text: str, tweak: bytes, back: bool, hexadecimal: bool = False) -> str:
    """Digits, lower-case and upper-case letters of ``text`` permuted together, each within its own alphabet, or all as hexadecimal digits."""
    alphabets = ["0123456789abcdef" if hexadecimal else next((a for a in _ALPHABETS if c in a), c) for c in text]
    x, size = 0, 1
    for c, a in zip(text, alphabets):
        x, size = x * len(a) + a.index(c), size * len(a)
    if size == 1:
        return text

    def spelt(x: int) -> str:
        out = []
        for a in reversed(alphabets):
            x, i = divmod(x, len(a))
            out.append(a[i])
        return "".join(reversed(out))

    # the tweak names the format, so the permutation is one of the texts of this format only
    form = "".join("h" if hexadecimal else a[0] if len(a) > 1 else a + "." for a in alphabets)
    fits = (lambda x: _hexadecimal(spelt(x))) if hexadecimal else lambda _: True
    return spelt(f.walk(x, size, tweak + form.encode(), fits, back))


def _hexadecimal(text: str) -> bool:
    return len(text) >= 8 and re.fullmatch(r"[0-9a-f]*[a-f][0-9a-f]*", text) is not None and any(c.isdigit() for c in text)


def email(f: Feistel, text: str, back: bool = False) -> str | None:
    """All but the last label of the host is permuted, without regard to case, which stays where it is."""
    head, dot, top = text.rpartition(".")
    new = _letters(f, head.lower(), b"email", back)
    return "".join(c.upper() if old.isupper() else c for old, c in zip(head, new)) + dot + top


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Where addresses stand, looked for outward from each @, within the lengths that local parts and hosts may have."""
    at, after = text.find("@"), 0
    while at >= 0:
        local, host = _LOCAL.search(text, max(after, at - 64), at), _HOST.match(text, at + 1, at + 254)
        if local and host:
            after = host.end()
            yield local.start(), after
        at = text.find("@", max(at + 1, after))


# fixed values: first digits of payment card numbers and how long these may be
NETWORKS = [
    ("4", (13, 16, 19)),
    ("5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)", (16,)),
    ("3[47]", (15,)),
    ("3[0689]", (14, 15, 16, 17, 18, 19)),
    ("35", (16, 17, 18, 19)),
    ("5[0678]|6", (13, 14, 15, 16, 17, 18, 19)),
]
_NETWORKS = [(re.compile(first), sizes) for first, sizes in NETWORKS]


def issued(digits: str) -> bool:
    """Whether a network has numbers that begin so and are so long."""
    return any(len(digits) in sizes and first.match(digits) for first, sizes in _NETWORKS)


def card(f: Feistel, text: str, back: bool = False) -> str | None:
    """A number of a payment network with a right Luhn sum: the digits between the first and the check digit are permuted among its networks' numbers."""
    digits = re.sub(r"\D", "", text)
    if not issued(digits) or not luhn(digits):
        return None
    n = len(digits) - 2
    fits = lambda x: issued(f"{digits[0]}{x:0{n}d}0")
    inner = f"{f.walk(int(digits[1:-1]), 10**n, b'card' + digits[0].encode(), fits, back):0{n}d}"
    return _fill(text, digits[0] + inner + str(-_luhn_sum(digits[0] + inner + "0") % 10))


def phone(f: Feistel, text: str, back: bool = False) -> str | None:
    """North American numbers keep their country code and rule of first digits; others keep the country code's first digit."""
    digits = re.sub(r"\D", "", text)
    abroad = text.startswith("+") and not digits.startswith("1")
    if abroad:
        if not 8 <= len(digits) <= 15:
            return None
        n = len(digits) - 1
        return _fill(text, digits[0] + f"{f.walk(int(digits[1:]), 10**n, b'abroad' + digits[0].encode(), back=back):0{n}d}")
    if len(digits) == 11 and digits[0] == "1":
        code, digits = "1", digits[1:]
    else:
        code = ""
    if len(digits) != 10 or digits[0] in "01" or digits[3] in "01":
        return None
    fits = lambda x: x // 10**9 > 1 and x // 10**6 % 10 > 1
    return _fill(text, code + str(f.walk(int(digits), 10**10, b"nanp", fits, back)))


def ssn(f: Feistel, text: str, back: bool = False) -> str | None:
    """Area, group and serial numbers that are issued, permuted among those."""

    def fits(x: int) -> bool:
        area, group, serial = x // 10**6, x // 10**4 % 100, x % 10**4
        return 0 < area < 900 and area != 666 and group > 0 and serial > 0

    digits = int(re.sub(r"\D", "", text))
    return _fill(text, f"{f.walk(digits, 10**9, b'ssn', fits, back):09d}") if fits(digits) else None


def ip(f: Feistel, text: str, back: bool = False) -> str | None:
    octets = [int(x) for x in text.split(".")]
    if max(octets) > 255:
        return None
    x = f.walk(int.from_bytes(bytes(octets), "big"), 1 << 32, b"ip", back=back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def iban(f: Feistel, text: str, back: bool = False) -> str | None:
    """A right mod 97 sum: what follows the check digits is permuted and they are made anew."""
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34:
        return None
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = _letters(f, plain[4:], b"iban" + plain[:2].encode(), back)
    left = iter(plain[:2] + f"{98 - number(body + plain[:2] + '00') % 97:02d}" + body)
    return "".join(" " if c == " " else next(left) for c in text)


def day(f: Feistel, text: str, back: bool = False) -> str | None:
    """A calendar date: permuted among the days of its century, whatever the form it is written in.

    Of day and month, the order that is a date is taken, day first if both are. Days up to the 12th and later ones
    are permuted apart, so a date that can only be read month first stays one. A date without leading zeros stays so.
    """
    given, seps = re.split(r"\D", text), re.findall(r"\D", text)
    parts = [int(x) for x in given]
    for y, m, d in [(0, 1, 2)] if len(given[0]) == 4 else [(2, 1, 0), (2, 0, 1)]:
        try:
            found = date(parts[y], parts[m], parts[d])
        except ValueError:
            continue
        century = found.year // 100 * 100
        lo, hi = date(max(1, century), 1, 1).toordinal(), date(century + 99, 12, 31).toordinal()
        late = found.day > 12
        fits = lambda x: (date.fromordinal(lo + x).day > 12) == late
        new = date.fromordinal(lo + f.walk(found.toordinal() - lo, hi - lo + 1, b"date%d" % lo, fits, back))
        out, width = ["", "", ""], 1 if min(len(given[m]), len(given[d])) == 1 else 2
        out[y], out[m], out[d] = f"{new.year:04d}", f"{new.month:0{width}d}", f"{new.day:0{width}d}"
        return out[0] + seps[0] + out[1] + seps[1] + out[2]
    return None


def secret(f: Feistel, text: str, back: bool = False) -> str | None:
    return _letters(f, text, b"secret", back, _hexadecimal(text))


_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_NAMED = re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9+/_.~-]{6,})")


def named(text: str) -> Iterator[tuple[int, int]]:
    """Values after words that announce a secret."""
    return (m.span(1) for m in _NAMED.finditer(text))


# fixed values: the forms that are looked for, as patterns or functions that find them, each with the check it must pass.
# No pattern can match one text in two ways, so none tries more than a line's length from any place.
FORMS: list[tuple[str, str | Callable, Callable]] = [
    ("secret", named, secret),
    ("email", emails, email),
    ("secret", r"(?<=AKIA)[A-Z0-9]{16}\b|(?<=ASIA)[A-Z0-9]{16}\b|(?<=\bgh[pousr]_)[A-Za-z0-9]{36,}|(?<=\bsk-)(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{20,}", secret),
    ("iban", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]*(?: [A-Z0-9]+)*\b", iban),
    ("date", r"(?<![\w.-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?:(?=T[0-9])|(?![\w-]))|(?<![\w./-])[0-9]{4}(?P<y>[./])[0-9]{1,2}(?P=y)[0-9]{1,2}(?![\w/-]|\.[0-9])|(?<![\w./-])[0-9]{1,2}(?P<d>[./-])[0-9]{1,2}(?P=d)[0-9]{4}(?![\w/-]|\.[0-9])", day),
    ("ssn", r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", ssn),
    ("ip", r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])", ip),
    ("card", r"(?<![\w+])[0-9]+(?:[ -][0-9]+)*(?!\w)", card),
    ("phone", r"(?<![\w.])\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?!\w)|(?<!\w)\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?!\w)|(?<![\w.+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?!\w)|(?<![\w.+-])1[ .-]\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?!\w)", phone),
]
#: What every line with a value of one of the forms holds.
_MAYBE = re.compile(r"[0-9@=:]|A[KS]IA|sk-|gh[pousr]_")


def _spans(pattern: str) -> Callable[[str], Iterator[tuple[int, int]]]:
    find = re.compile(pattern).finditer
    return lambda text: (m.span() for m in find(text))


def _compiled() -> list[tuple[str, Callable, Callable]]:
    return [(kind, _spans(how) if isinstance(how, str) else how, rule) for kind, how, rule in FORMS]


#: Kinds whose values may be written in groups, and so run into what is written after them, with their least and most characters.
_GROUPED = {"card": (13, 19), "iban": (15, 34)}


def _groups(text: str, a: int, b: int, sizes: tuple[int, int], found: Callable[[int, int], bool]) -> None:
    """Try the run from each group on, longest first, up to the most characters; go on after what was found."""
    groups = [(a + m.start(), a + m.end()) for m in re.finditer(r"[^ -]+", text[a:b])]
    i = 0
    while i < len(groups):
        ends, n = [], 0
        for j in range(i, len(groups)):
            n += groups[j][1] - groups[j][0]
            if n > sizes[1]:
                break
            if n >= sizes[0]:
                ends.append(j)
        i = next((j + 1 for j in reversed(ends) if found(groups[i][0], groups[j][1])), i + 1)


def _line(text: str, f: Feistel, forms, counts: dict[str, int]) -> str:
    spans: list[tuple[int, int, str]] = []
    taken = bytearray(len(text))

    def found(kind: str, a: int, b: int, rule: Callable) -> bool:
        if taken.find(1, a, b) >= 0 or (new := rule(f, text[a:b])) is None:
            return False
        spans.append((a, b, new))
        taken[a:b] = b"\1" * (b - a)
        counts[kind] = counts.get(kind, 0) + 1
        return True

    for kind, find, rule in forms:
        for a, b in find(text):
            if kind in _GROUPED:
                _groups(text, a, b, _GROUPED[kind], lambda x, y: found(kind, x, y, rule))
            else:
                found(kind, a, b, rule)
    out, at = [], 0
    for a, b, new in sorted(spans):
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


def pseudonymise_text(text: str, f: Feistel, forms=None) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many values of each kind were replaced.

    Values lie within a line; what one form took is not looked at again.
    """
    counts: dict[str, int] = {}
    if not _MAYBE.search(text):
        return text, counts
    forms = forms or _compiled()
    return "\n".join(_line(x, f, forms, counts) if _MAYBE.search(x) else x for x in text.split("\n")), counts


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", counts_col: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in ``text_col``; ``counts_col`` adds a map from kind to values replaced.

    Looked for: e-mail and IPv4 addresses, payment cards (network and Luhn), IBANs (mod 97), North American and international phone
    numbers, social security numbers, calendar dates, access keys, and values after password, token, secret or api key.
    All other columns, rows and their number stay as they are, whatever they are called; a column called ``counts_col``
    is replaced. A null text stays null, an empty one empty; numbers that don't pass their check stay.
    """
    docs = docs.drop(counts_col) if counts_col else docs
    names, at = docs.columns, docs.columns.index(text_col)
    fields = [T.StructField(f"c{i}", x.dataType) for i, x in enumerate(docs.schema.fields)]
    kind = pa.map_(pa.string(), pa.int64())
    extra = [T.StructField("n", T.MapType(T.StringType(), T.LongType()))] if counts_col else []
    text_name = f"c{at}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, forms = Feistel(key.encode()), _compiled()
        for batch in slices(batches, text_name, 8 << 20):
            texts, counts = [], []
            for text in batch.column(at).to_pylist():
                new, n = (None, {}) if text is None else pseudonymise_text(text, f, forms)
                texts.append(new)
                counts.append(list(n.items()))
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            if counts_col:
                columns.append(pa.array(counts, kind))
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(names))] + ["n"] * bool(counts_col))

    plain = docs.toDF(*[x.name for x in fields]).withColumn(text_name, F.col(text_name).cast("string"))
    out = in_batches(plain, run, T.StructType([x if i != at else T.StructField(text_name, T.StringType()) for i, x in enumerate(fields)] + extra))
    return out.toDF(*names, *[counts_col] * bool(counts_col))
