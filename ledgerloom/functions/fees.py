"""Settled amounts as intervals over integer minor units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom import params as P


def fee_and_tax(amount: Column) -> tuple[Column, Column]:
    """2.2 % fee and 18 % tax on it, each rounded half to even."""
    base = F.bround(amount * F.lit(0.022)).cast("long")
    return base, F.bround(base * F.lit(0.18)).cast("long")


def net_interval(amount: Column, fee: Column) -> tuple[Column, Column, Column]:
    """(lo, hi, certain): a known fee leaves the rounding slack, an unknown one the rate band."""
    lo = amount - F.ceil(F.lit(P.RATE_HIGH) * amount * F.lit(1 + P.GST)).cast("long")
    hi = amount - F.floor(F.lit(P.RATE_LOW) * amount * F.lit(1 + P.GST)).cast("long")
    known = fee.isNotNull()
    return (
        F.when(known, amount - fee - P.KNOWN_FEE_SLACK).otherwise(lo),
        F.when(known, amount - fee + P.KNOWN_FEE_SLACK).otherwise(hi),
        known,
    )


def residual(credit: Column, lo: Column, hi: Column) -> Column:
    """Signed distance to the nearest edge; 0 inside."""
    return F.when(credit < lo, credit - lo).when(credit > hi, credit - hi).otherwise(F.lit(0)).cast("long")


def fits(credit: Column, lo: Column, hi: Column) -> Column:
    return F.abs(residual(credit, lo, hi)) <= P.TOLERANCE


def tightness(res: Column, width: Column, certain: Column) -> Column:
    """1 for a residual of 0, falling to 0 at the tolerance; an uncertain interval costs up to half by its width."""
    t = F.greatest(F.lit(0.0), 1 - F.abs(res) / F.lit(float(P.TOLERANCE)))
    return F.when(certain, t).otherwise(t * (1 - 0.5 * F.least(F.lit(1.0), width / F.lit(2.0 * P.TOLERANCE))))


def gross_for(net: Column) -> Column:
    """The least gross amount whose exact fees leave ``net``, null where none does: the fee model turned round."""
    guess = F.floor(net / F.lit(1 - 0.022 * 1.18)).cast("long")

    def left(gross: Column) -> Column:
        base, tax = fee_and_tax(gross)
        return gross - base - tax

    near = F.transform(F.sequence(F.lit(-3), F.lit(3)), lambda d: guess + d)
    return F.array_min(F.filter(near, lambda g: left(g) == net)).cast("long")


def implied_rate_note(credit: Column, gross: Column) -> Column:
    """What deduction a residual implies, where the rate lies outside the band; else nothing."""
    rate = (gross - credit) / gross
    said = F.concat(F.lit("implies a "), F.format_number(100 * rate, 2), F.lit("% deduction, "))
    band = f"{100 * P.RATE_LOW:.1f}-{100 * P.RATE_HIGH:.1f}%"
    return (
        F.when(gross <= 0, "").when(rate > P.RATE_HIGH, F.concat(said, F.lit(f"above the {band} band: a charge on top of the fee")))
        .when(rate < P.RATE_LOW, F.concat(said, F.lit(f"below the {band} band: more arrived than a settlement would bring"))).otherwise("")
    )


def rupees(amount: Column) -> Column:
    """Minor units as text with two decimals."""
    return F.concat(F.when(amount < 0, "-").otherwise(""), (F.abs(amount) / 100).cast("long").cast("string"), F.lit("."), F.lpad((F.abs(amount) % 100).cast("string"), 2, "0"))
