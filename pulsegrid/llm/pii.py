"""Personal numbers and dates, replaced by format-preserving pseudonyms.

What looks like a card, account, social security or phone number, an address on the net or a date is
validated (check digits, ranges, the calendar) and then permuted within its own format by a keyed
Feistel network: the pseudonym of a card number is a card number with a right check digit. The same
value has the same pseudonym in every document, so links between documents stay; who has the key can
undo it, nobody else.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _arrow_type, _batches, _rows
from .common import released, whole_text

ROUNDS = 8
# For trials; a real run passes its own secret.
DEMO_KEY = b"pulsegrid demonstration key"


@dataclass(frozen=True)
class Feistel:
    """A keyed permutation of 0 .. size - 1; ``tweak`` keeps kinds of values apart."""

    key: bytes
    tweak: str
    size: int

    @property
    def _half(self) -> int:
        return max(1, -(-(self.size - 1).bit_length() // 2))

    def _round(self, number: int, value: int) -> int:
        width = (self._half + 7) // 8
        message = f"{self.tweak}|{self.size}|{number}|".encode() + value.to_bytes(width, "big")
        digest = hashlib.blake2b(message, key=self.key[:64], digest_size=max(8, width + 1)).digest()
        return int.from_bytes(digest, "big") & ((1 << self._half) - 1)

    def _once(self, value: int, back: bool) -> int:
        mask = (1 << self._half) - 1
        left, right = value >> self._half, value & mask
        for number in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ self._round(number, left), left
            else:
                left, right = right, left ^ self._round(number, right)
        return left << self._half | right

    def permute(self, value: int, back: bool = False) -> int:
        """Again and again until the result is below size: still one to one."""
        if self.size < 2:
            return value
        value = self._once(value, back)
        while value >= self.size:
            value = self._once(value, back)
        return value


def luhn_digit(payload: str) -> str:
    """The check digit that makes payload + digit pass Luhn's test."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _fill(shape: str, digits: str) -> str:
    """The shape with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _permuted(key: bytes, kind: str, digits: str, back: bool) -> str:
    return f"{Feistel(key, kind, 10 ** len(digits)).permute(int(digits), back):0{len(digits)}d}"


def _card(found: str, key: bytes, back: bool) -> str | None:
    digits = "".join(c for c in found if c.isdigit())
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    payload = digits[0] + _permuted(key, "card" + digits[0], digits[1:-1], back)
    return _fill(found, payload + luhn_digit(payload))


def _iban_check(country: str, account: str) -> str:
    number = int("".join(str(int(c, 36)) for c in account + country + "00"))
    return f"{98 - number % 97:02d}"


def _iban(found: str, key: bytes, back: bool) -> str | None:
    packed = found.replace(" ", "")
    country, check, account = packed[:2], packed[2:4], packed[4:]
    if not 11 <= len(account) <= 30 or _iban_check(country, account) != check:
        return None
    digits = "".join(c for c in account if c.isdigit())
    account = _fill(account, _permuted(key, "iban" + country, digits, back)) if digits else account
    it = iter(country + _iban_check(country, account) + account)
    return "".join(" " if c == " " else next(it) for c in found)


def _ssn_number(found: str) -> int | None:
    """The number of a valid social security number among all valid ones."""
    area, group, serial = int(found[:3]), int(found[4:6]), int(found[7:])
    if area in (0, 666) or area >= 900 or group == 0 or serial == 0:
        return None
    return ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1


def _ssn(found: str, key: bytes, back: bool) -> str | None:
    number = _ssn_number(found)
    if number is None:
        return None
    number = Feistel(key, "ssn", 898 * 99 * 9999).permute(number, back)
    rest, serial = divmod(number, 9999)
    area, group = divmod(rest, 99)
    area += 1 + (area + 1 >= 666)
    return f"{area:03d}{found[3]}{group + 1:02d}{found[6]}{serial + 1:04d}"


def _phone(found: str, key: bytes, back: bool) -> str | None:
    """North American numbers: area and exchange start with 2 to 9, and so do a pseudonym's. Others count
    only with +1 in front, and are permuted among themselves. The country code stays."""
    digits = "".join(c for c in found if c.isdigit())
    prefix, own = digits[:-10], digits[-10:]
    if prefix not in ("", "1"):
        return None
    if own[0] not in "01" and own[3] not in "01":
        number = ((int(own[0]) - 2) * 100 + int(own[1:3])) * 8_000_000 + int(own[3:]) - 2_000_000
        number = Feistel(key, "phone", 800 * 8_000_000).permute(number, back)
        area, rest = divmod(number, 8_000_000)
        return _fill(found, prefix + f"{area + 200:03d}{rest + 2_000_000:07d}")
    if not found.startswith("+1"):
        return None
    own = _permuted(key, "phone, any", own, back)
    while own[0] not in "01" and own[3] not in "01":
        own = _permuted(key, "phone, any", own, back)
    return _fill(found, prefix + own)


def _abroad(found: str, key: bytes, back: bool) -> str | None:
    """Other international numbers: the first two digits, which hold the country code, stay."""
    digits = "".join(c for c in found if c.isdigit())
    if not 9 <= len(digits) <= 15 or digits[0] in "01":
        return None
    return _fill(found, digits[:2] + _permuted(key, "abroad" + digits[:2], digits[2:], back))


def _ipv4(found: str, key: bytes, back: bool) -> str | None:
    parts = found.split(".")
    if any(int(p) > 255 or (p[0] == "0" and len(p) > 1) for p in parts):
        return None
    number = Feistel(key, "ipv4", 1 << 32).permute(int.from_bytes(bytes(map(int, parts)), "big"), back)
    return ".".join(map(str, number.to_bytes(4, "big")))


def _email(found: str, key: bytes, back: bool) -> str | None:
    """Letters and digits of the name are permuted among themselves, position by position one number;
    the domain stays."""
    name, domain = found.rsplit("@", 1)
    sizes = [26 if c.isascii() and c.isalpha() else 10 if c.isascii() and c.isdigit() else 1 for c in name]
    size, number = 1, 0
    for c, s in zip(name, sizes):
        size *= s
        number = number * s + ((ord(c.lower()) - 97) if s == 26 else int(c) if s == 10 else 0)
    shape = "".join("a" if s == 26 else "0" if s == 10 else c for c, s in zip(name, sizes))
    number = Feistel(key, f"email|{shape}|{domain.lower()}", size).permute(number, back)
    out = []
    for c, s in zip(reversed(name), reversed(sizes)):
        number, d = divmod(number, s)
        new = chr(97 + d) if s == 26 else str(d) if s == 10 else c
        out.append(new.upper() if s == 26 and c.isupper() else new)
    return "".join(reversed(out)) + "@" + domain


# Dates are permuted among those of one era, one range of months and one range of days. So a part of one digit
# stays one, a day above 12 stays above 12, and every way to write a date gives it the same pseudonym.
_ERAS, _MONTHS, _MONTH_DAYS = (1, 1900, 2100, 10_000), (1, 10, 13), (1, 10, 13, 32)


def _range(value: int, starts: tuple[int, ...]) -> tuple[int, int]:
    """First number and length of the range that a value is in."""
    return next((low, high - low) for low, high in zip(starts, starts[1:]) if low <= value < high)


def _is_day(year: int, month: int, day: int) -> bool:
    try:
        return bool(datetime.date(year, month, day))
    except ValueError:
        return False


def _other_day(year: int, month: int, day: int, key: bytes, back: bool) -> tuple[int, int, int]:
    """The pseudonym of a day of the calendar: again and again until the result is such a day."""
    (y0, years), (m0, months), (d0, days) = _range(year, _ERAS), _range(month, _MONTHS), _range(day, _MONTH_DAYS)
    network = Feistel(key, f"date|{y0}|{m0}|{d0}", years * months * days)
    number = ((year - y0) * months + month - m0) * days + day - d0
    while True:
        number = network.permute(number, back)
        rest, d = divmod(number, days)
        y, m = divmod(rest, months)
        if _is_day(y + y0, m + m0, d + d0):
            return y + y0, m + m0, d + d0


def _date(order: str, above: int = 0) -> Callable[[str, bytes, bool], str | None]:
    """Dates with their parts in an order, and with a day above a number; every part keeps its width."""

    def replace(found: str, key: bytes, back: bool) -> str | None:
        parts = dict(zip(order, map(int, re.findall(r"\d+", found))))
        if parts["d"] <= above or not _is_day(parts["y"], parts["m"], parts["d"]):
            return None
        new = dict(zip("ymd", _other_day(parts["y"], parts["m"], parts["d"], key, back)))
        values = iter(new[c] for c in order)
        return re.sub(r"\d+", lambda old: f"{next(values):0{len(old.group())}d}", found)

    return replace


#: Kind, pattern, replacement; at one place the first that validates counts.
KINDS: list[tuple[str, str, Callable[[str, bytes, bool], str | None]]] = [
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}", _email),
    ("iban", r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", _iban),
    ("date", r"\d{4}-\d{2}-\d{2}", _date("ymd")),
    ("date", r"\d{1,2}\.\d{1,2}\.\d{4}", _date("dmy")),
    ("date", r"\d{1,2}/\d{1,2}/\d{4}", _date("mdy")),
    ("date", r"\d{1,2}/\d{1,2}/\d{4}", _date("dmy", 12)),
    ("ipv4", r"\d{1,3}(?:\.\d{1,3}){3}", _ipv4),
    ("ssn", r"\d{3}[- ]\d{2}[- ]\d{4}", _ssn),
    ("card", r"\d{13,19}", _card),
    ("card", r"\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}", _card),
    ("card", r"\d{4}([ -])\d{6}\1\d{5}", _card),
    ("phone", r"(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}", _phone),
    ("phone", r"\+[2-9]\d{0,2}(?:[ .-]?(?:\(\d{1,5}\)|\d{1,5})){2,6}", _abroad),
]
# A value neither starts nor ends inside a word or a longer number.
_EDGE, _END = r"(?<![\w.@+-])", r"(?![\w@]|[.,-]\d)"
_COMPILED = [(kind, re.compile(pattern + _END), replace) for kind, pattern, replace in KINDS]
_STARTS = re.compile(_EDGE + r"(?=[+(\d]|[A-Z]{2}\d{2}|[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@)")


_DECIMALS = [chr(c) for c in range(128, 0x110000) if chr(c).isdecimal()]
_AS_ASCII = str.maketrans({c: str(int(c)) for c in _DECIMALS})
_OTHER_DECIMAL = re.compile(r"(?![0-9])\d")


def _in_script(found: str, new: str) -> str:
    """A pseudonym with its digits in the scripts of the digits that it replaces, number by number."""
    numbers = iter(re.findall(r"\d+", found))

    def written(number: re.Match) -> str:
        old = next(numbers)
        zeros = [ord(c) - int(c) for c in old]
        return "".join(chr(zeros[min(k, len(old) - 1)] + int(c)) for k, c in enumerate(number.group()))

    return re.sub("[0-9]+", written, new)


def findings(text: str, key: bytes, back: bool = False) -> Iterator[tuple[str, int, int, str]]:
    """kind, start, end, pseudonym of every personal value, in order and without overlaps.

    Decimal digits of any script count; a pseudonym is written in those of the value.
    """
    other = not text.isascii() and _OTHER_DECIMAL.search(text)
    read, at = text.translate(_AS_ASCII) if other else text, 0
    while start := _STARTS.search(read, at):
        at = start.start() + 1
        for kind, pattern, replace in _COMPILED:
            match = pattern.match(read, start.start())
            new = replace(match.group(), key, back) if match else None
            if new is not None:
                found = text[match.start() : match.end()]
                yield kind, match.start(), match.end(), _in_script(found, new) if other else new
                at = match.end()
                break


def pseudonymised(text: str, key: bytes, back: bool = False) -> str:
    """The text with every personal value replaced; ``back`` undoes it."""
    out, at = [], 0
    for _, start, end, new in findings(text, key, back):
        out += text[at:start], new
        at = end
    return "".join(out) + text[at:]


def personal_values(
    docs: DataFrame, key: bytes = DEMO_KEY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, kind, start, end (characters), pseudonym: one row for each personal value of each row.

    Texts without any, null and empty ones, have no row; repeated rows give their rows again; a null id
    stays null; an empty table gives no rows; other columns are not read. Texts of any length are searched
    whole. The values themselves are not part of the result.
    """
    id_type, arrow_id = docs.schema[id_col].dataType.simpleString(), _arrow_type(docs, id_col)
    ints = pa.int32()
    schema = pa.schema([(id_col, arrow_id), ("kind", pa.string()), ("start", ints), ("end", ints), ("pseudonym", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((i, *f) for i, text in _rows(batches) for f in findings(text, key))
        yield from _batches(found, schema)

    rows = docs.select(F.col(id_col), whole_text(text_col).alias("text_of"))
    # Nothing personal is without a digit of some script or an @. What Java's Unicode version does not know
    # (Cn) may be a digit to Python.
    rows = rows.where(F.col("text_of").rlike(r"[@\p{Nd}\p{Cn}]"))
    return rows.mapInArrow(released(run), f"`{id_col}` {id_type}, kind string, start int, end int, pseudonym string")


def pseudonymise(docs: DataFrame, key: bytes = DEMO_KEY) -> DataFrame:
    """The documents, all columns, with personal values replaced in the text; a null text stays null."""

    @F.pandas_udf("string")
    def replaced(texts):
        return texts.map(lambda text: pseudonymised(text, key))

    text = F.when(F.col("text").isNull(), F.col("text")).otherwise(replaced(whole_text()))
    return docs.withColumn("text", text)
