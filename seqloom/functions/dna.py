"""DNA text and integer codes as Column expressions.

A code is the base-4 number of a k-mer's letters (A 0, C 1, G 2, T 3), first letter most
significant; text order is code order. Codes are BIGINT up to k = 31, DECIMAL(20,0) at 32.
"""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("f", "r", "both", "min", "max")
MAX_K = 32


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def shape(k: int | Sequence[int]) -> tuple[int, ...]:
    """Offsets of a contiguous (int) or spaced shape, checked: increasing from 0, at most 32."""
    offsets = tuple(range(k)) if isinstance(k, int) else tuple(k)
    if not 1 <= len(offsets) <= MAX_K or offsets[0] != 0 or any(b <= a for a, b in zip(offsets, offsets[1:])):
        raise ValueError(f"a shape needs 1 to {MAX_K} increasing offsets from 0, not {k!r}")
    return offsets


def mode(name: str) -> str:
    if name not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}, not {name!r}")
    return name


def bases(seq) -> Column:
    """Upper case with U read as T; everything but A, C, G, T stays invalid, and lengths stay."""
    return F.translate(_col(seq), "acgtuU", "ACGTTT")


def two_bits(seq) -> Column:
    """Digits 0-3 of the valid letters, 4 for all others."""
    return F.translate(F.regexp_replace(bases(seq), "[^ACGT]", "4"), "ACGT", "0123")


def letters(digits) -> Column:
    """Letters of digits 0-3, N for 4, # for others."""
    return F.translate(F.regexp_replace(_col(digits), "[^0-4]", "#"), "01234", "ACGTN")


def reverse_complement(seq) -> Column:
    """Of text in either case; invalid symbols stay."""
    return F.reverse(F.translate(_col(seq), "ACGTacgt", "TGCAtgca"))


def canonical(kmer, how: str) -> Column:
    """The k-mer (f), its reverse complement (r), or the lesser or greater of both (min, max)."""
    kmer, other = _col(kmer), reverse_complement(kmer)
    return {"f": kmer, "r": other, "min": F.least(kmer, other), "max": F.greatest(kmer, other)}[how]


def code(kmer, k: int) -> Column:
    """The code of valid text of k letters."""
    number = F.conv(F.translate(_col(kmer), "ACGT", "0123"), 4, 10)
    return number.cast("bigint" if k < MAX_K else "decimal(20,0)")


def text(value, k: int) -> Column:
    """The k letters of a code."""
    return F.translate(F.lpad(F.conv(_col(value).cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def reverse_complement_code(value, k: int) -> Column:
    """By swapping bit pairs, for k up to 31; at 32 by way of text."""
    if k == MAX_K:
        return code(reverse_complement(text(value, k)), k)
    x = F.bitwise_not(_col(value).cast("bigint"))
    for width, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        low = F.lit(mask).cast("bigint")
        x = F.shiftrightunsigned(x, width).bitwiseAND(low).bitwiseOR(F.shiftleft(x.bitwiseAND(low), width))
    return F.shiftrightunsigned(x, 64 - 2 * k)


def canonical_code(value, k: int, how: str) -> Column:
    value, other = _col(value), reverse_complement_code(value, k)
    return {"f": value, "r": other, "min": F.least(value, other), "max": F.greatest(value, other)}[how]


def pack(c1, c2, bits: int) -> Column:
    """Two counters in one number, the first in the low bits."""
    return F.shiftleft(_col(c2).cast("bigint"), bits) + _col(c1)


def unpack(value, bits: int) -> tuple[Column, Column]:
    value = _col(value).cast("bigint")
    return value.bitwiseAND(F.lit((1 << bits) - 1)), F.shiftrightunsigned(value, bits)


def count_compatible(observed, stored, nvalues: int) -> Column:
    """Can a stored saturating counter hold what was observed?"""
    return _col(stored) % nvalues >= _col(observed) % nvalues


def pairs_compatible(observed, stored) -> Column:
    return _col(stored) >= _col(observed)


def letter_distance(a, b) -> Column:
    """Number of differing letters of two codes."""
    x = _col(a).bitwiseXOR(_col(b))
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
