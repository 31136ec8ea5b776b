"""Column functions over numbers, severities, vectors and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(col: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def saturating_sub(a: Column, b) -> Column:
    """a - b, never below zero; null stays null (greatest alone would turn it into zero)."""
    return F.when(a.isNotNull(), F.greatest(a - b, F.lit(0)))


def int_div(a: Column, b) -> Column:
    """Whole-number quotient, null for a zero divisor."""
    divisor = b if isinstance(b, Column) else F.lit(b)
    return F.try_divide(a - F.try_mod(a, divisor), divisor).cast("bigint")


# Severity rank, label and the label's share of a score.
SEVERITY = {5: "CRITICAL", 4: "HIGH", 3: "MEDIUM", 2: "LOW", 1: "INFO"}
RANK_10 = {5: 9, 4: 7, 3: 5, 2: 3, 1: 1}


def severity_label(col: Column) -> Column:
    out = F.lit(SEVERITY[1])
    for rank, label in sorted(SEVERITY.items()):
        out = F.when(col == rank, F.lit(label)).otherwise(out)
    return out


def severity_rank(label: Column) -> Column:
    out = F.lit(1)
    for rank, name in sorted(SEVERITY.items()):
        out = F.when(F.upper(label) == name, F.lit(rank)).otherwise(out)
    return out


def export_rank(severity: Column) -> Column:
    out = F.lit(1)
    for rank, value in sorted(RANK_10.items()):
        out = F.when(severity == rank, F.lit(value)).otherwise(out)
    return out


def band(col: Column, threshold) -> Column:
    """Medium above the threshold, High above twice, Critical above three times it."""
    t = F.lit(threshold)
    return (
        F.when(col > t * 3, "Critical").when(col > t * 2, "High").when(col > t, "Medium")
    )


# Grade bands.
GRADES = ((95, "A+"), (90, "A"), (85, "A-"), (80, "B+"), (75, "B"), (70, "B-"), (65, "C+"), (60, "C"), (50, "D"))


def grade(col: Column, bands=GRADES, lowest: str = "F") -> Column:
    out = F.lit(lowest)
    for floor, name in reversed(bands):
        out = F.when(col >= floor, F.lit(name)).otherwise(out)
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def rms_deviation(a: Column, centre: Column) -> Column:
    total = F.aggregate(
        F.zip_with(a, centre, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    return F.sqrt(total / F.size(a))


# Intervals are structs<lo,hi> of DECIMAL(38,0); a null bound means "no limit on that side".
U64_MAX = (1 << 64) - 1
_WIDE = "decimal(38,0)"


def interval(lo, hi) -> Column:
    return F.struct(lo.cast(_WIDE).alias("lo"), hi.cast(_WIDE).alias("hi"))


def interval_add(a: Column, b: Column) -> Column:
    return F.struct((a.lo + b.lo).cast(_WIDE).alias("lo"), (a.hi + b.hi).cast(_WIDE).alias("hi"))


def interval_sub(a: Column, b: Column) -> Column:
    return F.struct((a.lo - b.hi).cast(_WIDE).alias("lo"), (a.hi - b.lo).cast(_WIDE).alias("hi"))


def _all_known(parts) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p.isNotNull()
    return out


def _corners(parts) -> Column:
    parts = [p.cast(_WIDE) for p in parts]
    known = _all_known(parts)
    return F.struct(F.when(known, F.least(*parts)).alias("lo"), F.when(known, F.greatest(*parts)).alias("hi"))


def interval_mul(a: Column, b: Column) -> Column:
    return _corners([F.try_multiply(x, y) for x in (a.lo, a.hi) for y in (b.lo, b.hi)])


def interval_div(a: Column, b: Column) -> Column:
    """Quotients of the corners; null when the divisor may be zero."""
    safe = (b.lo > 0) | (b.hi < 0)
    corners = _corners([F.try_divide(x, F.nullif(y, F.lit(0))) for x in (a.lo, a.hi) for y in (b.lo, b.hi)])
    return F.when(safe, corners)


def interval_join(a: Column, b: Column) -> Column:
    return F.struct(
        F.when(_all_known([a.lo, b.lo]), F.least(a.lo, b.lo)).alias("lo"),
        F.when(_all_known([a.hi, b.hi]), F.greatest(a.hi, b.hi)).alias("hi"),
    )


def interval_meet(a: Column, b: Column) -> Column:
    lo, hi = F.greatest(a.lo, b.lo), F.least(a.hi, b.hi)
    return F.when(F.coalesce(lo <= hi, F.lit(True)), F.struct(lo.alias("lo"), hi.alias("hi")))


def interval_widen(old: Column, new: Column) -> Column:
    """Bounds that still move are dropped (null)."""
    return F.struct(
        F.when(new.lo >= old.lo, old.lo).alias("lo"), F.when(new.hi <= old.hi, old.hi).alias("hi")
    )
