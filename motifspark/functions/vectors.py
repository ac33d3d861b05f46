"""Vectors and hashes as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def unit(v: Column) -> Column:
    """L2-normalised; a norm under 1e-12 counts as that. Vector and norm are variables, so each is worked out once a row, not once a component."""
    scaled = lambda w: F.transform(F.array(F.greatest(norm(w), F.lit(1e-12))), lambda n: F.transform(w, lambda x: x / n))[0]
    return F.transform(F.array(v), scaled)[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def fuse(a: Column, b: Column, alpha: float) -> Column:
    """Unit vector of sqrt(alpha) * a and sqrt(1 - alpha) * b side by side."""
    return unit(F.concat(F.transform(a, lambda x: x * alpha**0.5), F.transform(b, lambda x: x * (1 - alpha) ** 0.5)))


def pack_bits(bits: Column) -> Column:
    """64 booleans to a long, the first one lowest."""
    return F.aggregate(F.transform(bits, lambda b, i: F.when(b, F.expr("1L")).otherwise(F.expr("0L"))), F.struct(F.lit(0).alias("i"), F.expr("0L").alias("h")), lambda s, b: F.struct((s["i"] + 1).alias("i"), s["h"].bitwiseOR(F.call_function("shiftleft", b, s["i"])).alias("h")), lambda s: s["h"])


def coefficient_hash(coefficients: Column) -> Column:
    """Perceptual hash of 64 low-frequency coefficients: bit i says that it is over the median of all but the first.
    Coefficients and median are variables, so each is worked out once a row, not once a coefficient."""
    packed = lambda c: F.transform(F.array(F.element_at(F.array_sort(F.slice(c, 2, 63)), 32)), lambda m: pack_bits(F.transform(c, lambda x: x > m)))[0]
    return F.transform(F.array(coefficients), packed)[0]


def hex_hash(text: Column) -> Column:
    """Long of a 16-digit hexadecimal hash: bytes in order, bits of a byte lowest first."""
    value = [F.shiftleft(F.conv(F.substring(text, 2 * i + 1, 2), 16, 10).cast("long"), 8 * i) for i in range(8)]
    out = value[0]
    for v in value[1:]:
        out = out.bitwiseOR(v)
    return out


def bit_signs(h: Column) -> Column:
    """The 64 bits of a hash as -1 and 1, as a unit vector."""
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.call_function("shiftright", h, i).bitwiseAND(F.lit(1)) == 1, 0.125).otherwise(-0.125))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
