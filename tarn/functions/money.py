"""Sums of money that do not depend on the order in which partitions arrive.

A float sum changes in its last digits with the number of partitions, and a report rounded to cents then flips
now and then. Here no row is rounded: an amount is cut into its whole part and the fraction, which is
a whole number of 2**-60ths (exact for all amounts of 1/256 and more), and both are summed in pieces of at most 27 bits. Each
piece is a plain integer sum that cannot overflow below some 10**11 rows. Only the sum is rounded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FRACTION_BITS, PIECE_BITS, HIGH_BITS = 60, 20, 26
# Doubles from here on have no fraction; beyond the second limit they do not fit a decimal.
WHOLE_FROM, LARGEST = float(1 << 53), 1e37
WIDE = "decimal(38,0)"


def _pieces(value: Column, bits: int, count: int) -> Column:
    """Sum of whole numbers, formed from ``count`` sums of ``bits`` bits each, the highest with the sign."""
    mask, whole = (1 << bits) - 1, None
    for i in range(count):
        piece = F.shiftright(value, bits * i)
        piece = piece if i == count - 1 else piece.bitwiseAND(mask)
        part = F.sum(piece).cast("decimal(20,0)") * F.lit(str(1 << (bits * i))).cast("decimal(18,0)")
        whole = part if whole is None else whole + part
    return whole.cast(WIDE)


def exact_sum(amount: Column, where: Column | None = None) -> Column:
    """Sum of amounts as a double that is the same for every partitioning; NULL when no row qualifies.

    Decimals are summed as decimals, of up to ten digits after the point. Amounts that are no number, or too large
    for a decimal, make the sum what a float sum would: NaN or infinity, or a very large number.
    """
    if where is not None:
        amount = F.when(where, amount)
    is_decimal = F.typeof(amount).startswith("decimal")
    value = F.when(~is_decimal, amount.cast("double"))
    size = F.abs(value)
    plain = F.when(size < WHOLE_FROM, value)
    large = F.when((size >= WHOLE_FROM) & (size < LARGEST), value)
    odd = F.when(F.isnan(value) | (size >= LARGEST), value)
    low = F.rint((plain - F.rint(plain)) * float(1 << FRACTION_BITS)).cast("bigint")
    units = F.coalesce(_pieces(low, PIECE_BITS, 3), F.lit(0).cast(WIDE))
    whole = F.coalesce(_pieces(F.rint(plain).cast("bigint"), HIGH_BITS, 2), F.lit(0).cast(WIDE))
    carried = F.floor(units.cast("double") / float(1 << FRACTION_BITS))
    rest = units - carried.cast(WIDE) * F.lit(str(1 << FRACTION_BITS)).cast("decimal(19,0)")
    fraction = (rest.cast("double") / float(1 << FRACTION_BITS)).cast("decimal(14,12)")
    whole = (whole + carried.cast(WIDE)).cast("decimal(26,0)")
    # Beyond what a decimal of twelve digits holds, a double has no fraction either.
    exact = (whole.cast("decimal(38,12)") + fraction).cast("double")
    with_large = exact + F.sum(large.cast(WIDE)).cast("double")
    decimals = F.sum(F.when(is_decimal, amount.cast("decimal(28,10)"))).cast("double")
    return (
        F.when(F.count(odd) > 0, F.sum(odd))
        .when(F.count(large) > 0, with_large)
        .when(F.count(plain) > 0, exact)
        .otherwise(decimals)
    )


def rounded(value: Column, digits: int) -> Column:
    """Half up on the sum as it is meant: the last bits of its doubles, some 1e-9, do not decide."""
    settled = F.when(F.abs(value) < 1e20, F.round(F.round(value.cast("decimal(38,12)"), 6), digits).cast("double"))
    return F.when(F.isnan(value) | (F.abs(value) >= 1e20), value).otherwise(settled)


def total(amount: Column, where: Column | None = None) -> Column:
    """``round(sum(amount), 2)``."""
    return rounded(exact_sum(amount, where), 2)


def mean(amount: Column, digits: int = 2) -> Column:
    """``round(avg(amount), digits)`` over non-null amounts."""
    return rounded(exact_sum(amount) / F.nullif(F.count(amount), F.lit(0)), digits)


def count_where(condition: Column) -> Column:
    """``count(*) FILTER (WHERE condition)``: zero, not NULL, when nothing qualifies."""
    return F.count(F.when(condition, F.lit(1)))
