"""64-bit perceptual fingerprints as signed BIGINT columns.

The bits are the 8x8 matrix of a hash, row by row, most significant first. BIGINT is the canonical
form; texts (bits, hex) are derived. All functions stay inside Catalyst.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = "0123456789abcdef"


def to_bits(fp: Column) -> Column:
    """64 binary digits."""
    return F.lpad(F.bin(fp), 64, "0")


def to_hex(fp: Column) -> Column:
    """16 hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def to_short_hex(fp: Column) -> Column:
    """0x and the digits without padding, as the fingerprint importer renders it."""
    return F.concat(F.lit("0x"), F.lower(F.hex(fp)))


def to_bytes(fp: Column) -> Column:
    """Eight bytes, most significant first."""
    return F.unhex(F.lpad(F.hex(fp), 16, "0"))


def from_bytes(raw: Column) -> Column:
    """The fingerprint of eight bytes."""
    return from_hex(F.hex(raw))


def from_hex(text: Column) -> Column:
    """The fingerprint of up to 16 hexadecimal digits, with or without 0x."""
    return F.conv(F.regexp_replace(text, "^0[xX]", ""), 16, -10).cast("bigint")


def hex_to_binary_text(text: Column) -> Column:
    """Binary digits of a hexadecimal text, without padding."""
    return F.conv(F.regexp_replace(text, "^0[xX]", ""), 16, 2)


def from_matrix(bits: Column) -> Column:
    """The fingerprint of an array of 64 booleans."""
    digits = F.array_join(F.transform(bits, lambda b: F.when(b, "1").otherwise("0")), "")
    return F.conv(digits, 2, -10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits."""
    return F.bit_count(a.bitwiseXOR(b)).cast("bigint")


def popcount(fp: Column) -> Column:
    """Number of set bits."""
    return F.bit_count(fp).cast("bigint")


def entropy(text: Column, alphabet: str = HEX_DIGITS, base: float | None = None) -> Column:
    """Shannon entropy of a text's letters (natural logarithm unless base is given); 0 for one letter or none.

    The alphabet is fixed, so the sum is one expression over its letters and needs no explode.
    """
    size = F.length(text).cast("double")

    def part(letter: str) -> Column:
        share = (F.length(text) - F.length(F.translate(text, letter, ""))) / size
        return F.when(share > 0, -share * F.ln(share)).otherwise(F.lit(0.0))

    total = reduce(lambda a, b: a + b, (part(c) for c in alphabet))
    total = total / F.ln(F.lit(float(base))) if base else total
    return F.when(F.length(text) <= 1, F.lit(0.0)).otherwise(total)


def from_coefficients(values: Column) -> Column:
    """Last step of the perceptual hash: of 64 coefficients, which exceed their median.

    The median is bound once for a row, as the variable of a transform over one element."""
    wide = values.cast("array<double>")
    ordered = F.sort_array(wide, asc=False)
    median = (F.element_at(ordered, 32) + F.element_at(ordered, 33)) / F.lit(2.0)
    row = F.array(F.struct(wide.alias("v"), median.alias("m")))
    digits = F.transform(row, lambda r: F.array_join(F.transform(r["v"], lambda x: F.when(x > r["m"], "1").otherwise("0")), ""))
    return F.conv(F.element_at(digits, 1), 2, -10).cast("bigint")
