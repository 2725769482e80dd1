"""Elementwise helpers: guarded ratios, returns, prices by unit, codes. Null, NaN and infinite operands give null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timeseries import EPS


def finite(x: Column) -> Column:
    """Null for anything that isn't a finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def safe_div(a: Column, b: Column) -> Column:
    """a / b; null where b is about zero."""
    return F.when(F.abs(finite(b)) > EPS, finite(a) / b)


ratio = div = safe_div


def ret(now: Column, before: Column) -> Column:
    """now / before - 1."""
    return safe_div(now, before) - 1


arithmetic_return = ret


def log_return(now: Column, before: Column) -> Column:
    return F.when((finite(now) > EPS) & (finite(before) > EPS), F.log(now / before))


def daily_vwap(amount: Column, vol: Column) -> Column:
    """Price from an amount in thousands and a volume in lots of 100."""
    return F.when(finite(vol) > EPS, finite(amount) * 10 / vol)


def minute_vwap(amount: Column, vol: Column) -> Column:
    """Price from an amount and a volume in single units."""
    return F.when(finite(vol) > EPS, finite(amount) / vol)


def percent_to_decimal(x: Column) -> Column:
    return finite(x) / 100


def adjusted(price: Column, factor: Column) -> Column:
    """A price times its adjustment factor."""
    return finite(price) * finite(factor)


def sign_adjust(x: Column, by: Column) -> Column:
    """x with the sign of `by`: kept, turned round, or zero."""
    return finite(x) * F.signum(finite(by))


def on_exchange(code: Column, exchange: str) -> Column:
    """Whether a code ends in an exchange's suffix, as in 430047.BJ."""
    return F.upper(code).endswith(f".{exchange}")


def without_exchange(value: Column, code: Column, exchange: str = "BJ") -> Column:
    """Null for the codes of one exchange."""
    return F.when(~on_exchange(code, exchange), value)


def product_of(contract: Column) -> Column:
    """The letters that a futures contract's code begins with, in capitals; null without any."""
    found = F.upper(F.regexp_extract(contract, r"^([A-Za-z]+)", 1))
    return F.when(found != "", found)


def is_share_code(code: Column) -> Column:
    """Six digits and one of the exchanges SH, SZ, BJ."""
    return F.coalesce(code.rlike(r"^\d{6}\.(SH|SZ|BJ)$"), F.lit(False))


def file_stem(name: Column) -> Column:
    """A name fit for a file: anything but letters, digits, - and _ becomes _."""
    return F.regexp_replace(name, r"[^A-Za-z0-9_-]", "_")


def all_of(masks: Sequence[Column]) -> Column:
    """True where every mask is; a null counts as false."""
    out = F.lit(True)
    for m in masks:
        out = out & F.coalesce(m, F.lit(False))
    return out


def allowed_by_limit(side: str, limit_up: Column, limit_down: Column) -> Column:
    """Whether an entry may be made: `both` limits block, or only `up`, or only `down`."""
    blocked = {"both": limit_up | limit_down, "up": limit_up, "down": limit_down}[side]
    return ~F.coalesce(blocked, F.lit(False))
