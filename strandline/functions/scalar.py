"""Scalar arithmetic with fixed widths: unsigned views, shifts, conversions, generators.

64-bit results wrap around; the session needs ``spark.sql.ansi.enabled=false`` for that, or the
``try_`` free forms here, which go through decimals where Spark would raise.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SIGN = -(1 << 63)
#: Multiplier and increment of the 64-bit linear congruential generator (fixed values).
LCG_MULTIPLIER, LCG_INCREMENT = 6364136223846793005, 0x14057B7EF767814F


def _flip(c: Column) -> Column:
    return c.cast("bigint").bitwiseXOR(F.lit(SIGN))


def unsigned_less(a: Column, b: Column) -> Column:
    return _flip(a) < _flip(b)


def unsigned_greater(a: Column, b: Column) -> Column:
    return _flip(a) > _flip(b)


def unsigned_less_equal(a: Column, b: Column) -> Column:
    return _flip(a) <= _flip(b)


def unsigned_greater_equal(a: Column, b: Column) -> Column:
    return _flip(a) >= _flip(b)


def as_unsigned(c: Column) -> Column:
    """A bigint's bits as a number from 0 to 2^64 - 1 (decimal)."""
    d = c.cast("decimal(20,0)")
    return F.when(c < 0, d + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(d)


def as_signed(c: Column) -> Column:
    """A decimal from 0 to 2^64 - 1 as the bigint with the same bits."""
    return F.when(c >= F.lit("9223372036854775808").cast("decimal(20,0)"), c - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(c).cast("bigint")


def unsigned_divide(a: Column, b: Column) -> Column:
    """Whole quotient of unsigned 64-bit numbers; null where b is 0."""
    x, y = as_unsigned(a), as_unsigned(b)
    return as_signed(F.when(b != 0, F.floor((x - F.pmod(x, y)) / y).cast("decimal(20,0)")))


def unsigned_remainder(a: Column, b: Column) -> Column:
    x, y = as_unsigned(a), as_unsigned(b)
    return as_signed(F.when(b != 0, F.pmod(x, y)).cast("decimal(20,0)"))


def multiply_wrapping(a: Column, b: Column) -> Column:
    """Product modulo 2^64 of bigints from halves of 32 bits, exact with ANSI mode on or off."""
    low_a, low_b = a.bitwiseAND(F.lit(0xFFFFFFFF)), b.bitwiseAND(F.lit(0xFFFFFFFF))
    high_a, high_b = F.shiftright(a, 32), F.shiftright(b, 32)
    quarter = lambda x: (x.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(x, 16))
    b0, b1 = quarter(low_b)
    low = add_wrapping(low_a * b0, F.shiftleft(low_a * b1, 16))
    cross = lambda x, y: F.shiftleft(add_wrapping(x * (y.bitwiseAND(F.lit(0xFFFF))), F.shiftleft((x * F.shiftrightunsigned(y, 16)).bitwiseAND(F.lit(0xFFFFFFFF)), 16)), 32)
    return add_wrapping(add_wrapping(low, cross(low_b, high_a.bitwiseAND(F.lit(0xFFFFFFFF)))), cross(low_a, high_b.bitwiseAND(F.lit(0xFFFFFFFF))))


def add_wrapping(a: Column, b: Column) -> Column:
    """Sum modulo 2^64 of bigints, from halves that cannot overflow."""
    low = a.bitwiseAND(F.lit(0xFFFFFFFF)) + b.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftright(a, 32) + F.shiftright(b, 32) + F.shiftright(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))


def lcg_next(state: Column) -> Column:
    """The generator's next state."""
    return add_wrapping(multiply_wrapping(state, F.lit(LCG_MULTIPLIER).cast("bigint")), F.lit(LCG_INCREMENT).cast("bigint"))


def lcg_after(seed: Column, steps: Column) -> Column:
    """The state after some steps, as a fold in the row."""
    return F.when(steps <= 0, seed).otherwise(F.aggregate(F.sequence(F.lit(1), steps), seed, lambda s, _: lcg_next(s)))


def lcg_value(state: Column) -> Column:
    """The 63 bits of a state that are used."""
    return F.shiftrightunsigned(state, 1)


def select(test: Column, a: Column, b: Column) -> Column:
    return F.when(test, a).otherwise(b)


def convert(c: Column, kind: str) -> Column:
    """kind: I, L, F or D for 32- and 64-bit integers and floats."""
    return c.cast({"I": "int", "L": "bigint", "F": "float", "D": "double"}[kind])


def unsigned_convert(c: Column, kind: str) -> Column:
    """From an unsigned integer of 32 bits."""
    return convert(c.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)), kind)


def gather(values: Column, at: Column) -> Column:
    """values[at], from 0; null outside."""
    return F.get(values, at)


def scatter(values: Column, at: Column, value: Column) -> Column:
    """values with values[at] = value; unchanged where at lies outside."""
    return F.transform(values, lambda x, i: F.when(i == at, value).otherwise(x))


def loop(start: Column, steps: Column, step) -> Column:
    """``step(state, i)`` for i = 0 .. steps - 1, as a fold in the row."""
    return F.when(steps <= 0, start).otherwise(F.aggregate(F.sequence(F.lit(0), steps - 1), start, step))
