"""Base58 membership codes.

A cluster of entities is a bit mask, highest bit first: the entity with ordinal 0 owns bit
``width - 1``. The code is the mask written in Base58 digits. Up to 63 entities a mask is a BIGINT and codes
are Spark SQL expressions. A wider one is a set of pieces of 24 bits; a code is one number of as many bits as
there are entities, so a cluster's pieces meet in one row (WIDEST bounds it), where the number is halved until
its parts are short. The codes are those of the same rule.
"""

from __future__ import annotations

import numpy as np

MAX_WIDTH = 63
WIDEST = 1 << 22

# The digits of the widely used Base58 alphabet, in digit order.
ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

# The fifty states in the order in which codes already in circulation are read
# (by state name).
STATE_ORDER = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA",
    "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD",
    "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ",
    "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC",
    "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY",
]

_DIGITS = 11  # 58**11 > 2**63
# Wide masks: bits of a piece, digits that are written one by one.
PIECE, _CHUNK = 24, 64


def check_width(width: int) -> int:
    if not 1 <= width <= WIDEST:
        raise ValueError(f"cluster codes hold 1 to {WIDEST} entities, not {width}")
    return width


def encode_sql(mask: str) -> str:
    """SQL text: BIGINT ``mask`` to its Base58 code without leading zero digits."""
    digits = ", ".join(
        f"substr('{ALPHABET}', cast(({mask}) div {58 ** place}L % 58L as int) + 1, 1)"
        for place in range(_DIGITS - 1, -1, -1)
    )
    return f"regexp_replace(concat({digits}), '^1+(?=.)', '')"


def decode_sql(code: str) -> str:
    """SQL text: Base58 ``code`` to BIGINT mask; null if it has a foreign character or overflows."""
    value = (
        f"aggregate(split({code}, ''), 0L, (value, digit) -> "
        f"try_add(try_multiply(value, 58L), cast(locate(digit, '{ALPHABET}') - 1 as bigint)))"
    )
    return f"case when {code} rlike '^[{ALPHABET}]+$' then {value} end"


def _power(length: int) -> tuple[int, int]:
    """The number of digits to cut off a code of about that length, and 58 to that power."""
    low = _CHUNK
    while 2 * low < length:
        low *= 2
    return low, 58**low


def decimal_to_code(mask: int) -> str:
    """The code of a mask of any width, halved until it is short."""

    def digits(value: int, length: int) -> str:
        if length <= _CHUNK:
            out = ""
            for _ in range(length):
                value, digit = divmod(value, 58)
                out = ALPHABET[digit] + out
            return out
        low, power = _power(length)
        above, below = divmod(value, power)
        return digits(above, length - low) + digits(below, low)

    return digits(mask, longest_code(mask.bit_length())).lstrip(ALPHABET[0]) or ALPHABET[0]


def longest_code(width: int) -> int:
    """Digits that are enough for so many bits (58 is more than 2 to the power of 5.857)."""
    return 1 + width * 1000 // 5857


def code_to_decimal(code: str) -> int:
    """The mask that a code of any length names; a foreign character raises ValueError."""
    if len(code) <= _CHUNK:
        value = 0
        for digit in code:
            value = value * 58 + ALPHABET.index(digit)
        return value
    low, power = _power(len(code))
    return code_to_decimal(code[:-low]) * power + code_to_decimal(code[-low:])


def pieces_to_code(places: np.ndarray, pieces: np.ndarray) -> str:
    """The code of a mask in pieces of ``PIECE`` bits at their places, the lowest being 0."""
    whole = np.zeros((int(places.max()) + 1, PIECE // 8), np.uint8)
    for byte in range(PIECE // 8):
        whole[places, byte] = pieces >> 8 * byte & 255
    return decimal_to_code(int.from_bytes(whole.tobytes(), "little"))


def code_to_ordinals(code: str | None, width: int) -> np.ndarray | None:
    """Ordinals named by a code, ascending; None if it has a foreign character or does not fit ``width`` entities."""
    digits = (code or "").lstrip(ALPHABET[0])
    if not code or len(digits) > longest_code(width) or not set(digits) <= set(ALPHABET):
        return None
    mask = code_to_decimal(digits)
    if mask >> width:
        return None
    size = -(-width // 8)
    bits = np.unpackbits(np.frombuffer(mask.to_bytes(size, "big"), np.uint8))
    return np.flatnonzero(bits[8 * size - width :]).astype(np.int32)


def decode_positions(code: str, width: int) -> list[int]:
    """Ordinals named by one literal code, for filters that should reach the scan as constants."""
    check_width(width)
    if not code or any(c not in ALPHABET for c in code):
        raise ValueError(f"not a Base58 cluster code: {code!r}")
    mask = code_to_decimal(code)
    if mask >> width:
        raise ValueError(f"code {code!r} does not fit {width} entities")
    return code_to_ordinals(code, width).tolist()
