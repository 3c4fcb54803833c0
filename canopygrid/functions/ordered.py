"""Doubles as whole numbers in the same order, so that selections can go by digits."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of one digit, and digits of a key.
DIGIT_BITS = 16
DIGITS = 64 // DIGIT_BITS
_SMALLEST_NORMAL = 2.0**-1022
_INFINITY_BITS = 0x7FF << 52
_LAST = (1 << 63) - 1


def ordered_bits(value: Column) -> Column:
    """The bits of a double as a long that grows with it; zeros are equal, NaN comes last, NULL stays.

    Built from exact operations only: the exponent is a rounded logarithm set right
    by one comparison, and scaling by a power of two loses nothing.
    """
    v = value.cast("double")
    size = F.abs(v)
    guess = F.floor(F.log2(size)).cast("int")
    guess = F.least(F.greatest(guess, F.lit(-1022)), F.lit(1023))
    scaled = size * F.pow(F.lit(2.0), -guess)
    exponent = guess + F.when(scaled >= 2.0, 1).when(scaled < 1.0, -1).otherwise(0)
    fraction = F.when(scaled >= 2.0, scaled / 2.0).when(scaled < 1.0, scaled * 2.0).otherwise(scaled)
    normal = F.shiftleft((exponent + 1023).cast("long"), 52) + ((fraction - 1.0) * float(1 << 52)).cast("long")
    tiny = (size * 2.0**537 * 2.0**537).cast("long")
    bits = (
        F.when(size == 0.0, F.lit(0).cast("long"))
        .when(size == float("inf"), F.lit(_INFINITY_BITS))
        .when(size < _SMALLEST_NORMAL, tiny)
        .otherwise(normal)
    )
    return F.when(F.isnan(v), F.lit(_LAST)).when(v < 0.0, -bits).otherwise(F.when(v.isNotNull(), bits))


def from_ordered(key: int) -> float:
    """The double of a key."""
    if key == _LAST:
        return math.nan
    value = struct.unpack("<d", struct.pack("<q", abs(key)))[0]
    return -value if key < 0 else value


def to_ordered(value: float) -> int:
    """The key of a double that is a number."""
    bits = struct.unpack("<q", struct.pack("<d", abs(value)))[0]
    return -bits if value < 0 else bits


def midpoint(a: float, b: float) -> float:
    """Half the sum, also where the sum is out of range."""
    total = a + b
    return total / 2 if math.isfinite(total) or not (math.isfinite(a) and math.isfinite(b)) else a / 2 + b / 2
