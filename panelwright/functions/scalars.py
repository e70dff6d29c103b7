"""Scalar column functions. All of them keep NULL as NULL unless they say otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from panelwright import fixed_values as fixed


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_nan(c) -> Column:
    """NaN and NULL are one thing here: NULL."""
    c = _col(c)
    return F.when(~F.isnan(c), c)


def to_number(c, text: bool = True) -> Column:
    """Tolerant cast to DOUBLE: what is not a number becomes NULL (SC1).

    Java also reads "1d" and "2.5f" as numbers, so text with such an ending is refused.
    """
    c = _col(c)
    number = null_if_nan(c.try_cast("double"))
    if not text:
        return number
    return F.when(~c.cast("string").rlike(r"[0-9.][dDfF]\s*$"), number)


def is_true(c) -> Column:
    """TRUE for boolean true and for any spelling of the word (FLT1); never NULL."""
    return F.coalesce(F.lower(_col(c).cast("string")) == "true", F.lit(False))


def falsy_default(c, default) -> Column:
    """NULL and 0 become the default (SC2)."""
    return F.coalesce(F.nullif(_col(c).cast("double"), F.lit(0.0)), F.lit(float(default)))


def clip(c, low=None, high=None) -> Column:
    """Bound a value on one or both sides (SC3)."""
    c = _col(c)
    out = c
    if low is not None:
        out = F.when(c < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(c > high, F.lit(high)).otherwise(out)
    return out


def round_half_even(c, digits: int) -> Column:
    """Half-even rounding of the scaled double (SC4); differs from both round and bround."""
    scale = float(10**digits)
    return F.rint(_col(c) * scale) / scale


def value_ratio(points, price, floor: float = fixed.MIN_PRICE) -> Column:
    """Points per unit of price, price bounded below (PRJ6)."""
    return _col(points) / clip(_col(price), low=floor)


def masked(c, condition) -> Column:
    """c where the condition holds, 0 elsewhere; a NULL c stays NULL (SC7)."""
    return _col(c) * F.coalesce(_col(condition), F.lit(False)).cast("int")


def update_where(c, condition, value) -> Column:
    """New value where the condition holds, old value elsewhere (SC10)."""
    value = value if isinstance(value, Column) else F.lit(value)
    return F.when(F.coalesce(_col(condition), F.lit(False)), value).otherwise(_col(c))


def lookup(c, table: Mapping, default=None) -> Column:
    """Literal table lookup; absent and NULL keys give the default."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    found = F.try_element_at(F.create_map(*entries), _col(c))
    return found if default is None else F.coalesce(found, F.lit(default))


def map_codes(c, table: Mapping = fixed.POSITIONS, default: str = fixed.UNKNOWN_LABEL) -> Column:
    """Code to label (PRJ4)."""
    return lookup(c, table, default)


def canonical_code(c, aliases: Mapping[str, str] = fixed.POSITION_ALIASES) -> Column:
    """Case-insensitive alias to code, NULL when unknown (PRJ5)."""
    return lookup(F.upper(_col(c)), aliases)


def availability(status, chance, average_minutes) -> Column:
    """Three-tier availability (SC8): ruled out, stated chance, minutes band."""
    minutes = _col(average_minutes)
    out = F.when(_col(status).isin(fixed.UNAVAILABLE), F.lit(0.0))
    out = out.when(_col(chance).isNotNull(), _col(chance) / 100.0)
    for least, score in fixed.MINUTE_BANDS:
        out = out.when(minutes >= least, F.lit(score))
    return out.otherwise(F.lit(fixed.LOWEST_AVAILABILITY))


def price_signal(momentum, points) -> Column:
    """Rise / fall / stable from momentum and form (SC9)."""
    momentum, points = _col(momentum), _col(points)
    rise = (momentum > fixed.SIGNAL_MOMENTUM) & (points > fixed.SIGNAL_GOOD_FORM)
    fall = (momentum < -fixed.SIGNAL_MOMENTUM) | (points < fixed.SIGNAL_POOR_FORM)
    return (
        F.when(rise, fixed.SIGNAL_RISE).when(fall, fixed.SIGNAL_FALL).otherwise(fixed.SIGNAL_STABLE)
    )


def scale_by_max(c, largest) -> Column:
    """c / largest, 0 when the largest is not positive (SC11); NULL c gives 0."""
    c, largest = _col(c), _col(largest)
    return F.when(largest > 0, F.coalesce(c / largest, F.lit(0.0))).otherwise(F.lit(0.0))


def scale_min_max(c, low, high, epsilon: float = fixed.SHARE_EPSILON) -> Column:
    """(c - low) / (high - low + epsilon) (SC12)."""
    return (_col(c) - _col(low)) / (_col(high) - _col(low) + F.lit(epsilon))


def coalesce_present(columns: Sequence[str], names: Sequence[str]) -> Column:
    """First of the named columns that exists; NULL when none does (PRJ3)."""
    for name in names:
        if name in columns:
            return F.col(name)
    return F.lit(None)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
