"""Column functions over 256-bit hashes held as 64 lower-case hex digits.

The digits are those of four 64-bit words, most significant digit first within
a word; the raw bytes hold each word least significant byte first. Digits order
like the words do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO, MARKER = "0" * 64, "f" * 64
DEDUP_FLAG = 1 << 31


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _words_reversed(hex_digits: Column) -> Column:
    """The digit pairs of each of the four words in the opposite order."""
    pairs = [F.substring(hex_digits, 16 * w + 2 * b + 1, 2) for w in range(4) for b in reversed(range(8))]
    return F.concat(*pairs)


def to_raw(h: Column | str) -> Column:
    return F.unhex(_words_reversed(col(h)))


def from_raw(raw: Column | str) -> Column:
    return _words_reversed(F.lower(F.hex(col(raw))))


def is_hash(h: Column | str) -> Column:
    return col(h).rlike("^[0-9a-f]{64}$")


def to_base64(h: Column | str) -> Column:
    """URL-safe, without padding, of the raw bytes."""
    return F.rtrim(F.translate(F.base64(to_raw(h)), "+/", "-_"), F.lit("="))


def from_base64(text: Column | str) -> Column:
    t = F.translate(col(text), "-_", "+/")
    return from_raw(F.unbase64(F.concat(t, F.lit("="))))


def low_bits(h: Column | str, modulus: int) -> Column:
    """Remainder by a power of two: that of the last word."""
    if modulus & (modulus - 1) or modulus > 1 << 60:
        raise ValueError("modulus must be a power of two up to 2**60")
    return F.conv(F.right(col(h), F.lit(15)), 16, 10).cast("long").bitwiseAND(F.lit(modulus - 1))


def natural_cut(h: Column | str, fanout: int = 4) -> Column:
    return low_bits(h, fanout) == 0


def truncated(h: Column | str) -> Column:
    return F.substring(col(h), 1, 16)


def has_flag(flags: Column | str, bit: int) -> Column:
    return col(flags).bitwiseAND(F.lit(1 << bit)) != 0


def dedup_eligible(h: Column | str, modulus: int = 1024, flags: Column | None = None) -> Column:
    by_hash = low_bits(h, modulus) == 0
    return by_hash if flags is None else by_hash | has_flag(flags, 31)
