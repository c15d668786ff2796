"""Scalar column functions; all stay inside whole-stage code generation unless noted."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskgraph.schema import (
    DAY, DISPOSABLE_MARKERS, FREE_EMAIL_DOMAINS, HIGH_RISK_TLDS, HOUR,
)


def flag(cond: Column) -> Column:
    """Boolean to 0/1, null counts as 0."""
    return F.coalesce(cond, F.lit(False)).cast("tinyint")


#: Types whose values are the same double with and without the way through text (a float's are not).
PLAIN_NUMBERS = ("double", "bigint", "int", "smallint", "tinyint")


def number(col: Column, default: float | None = 0.0, kind: str | None = None) -> Column:
    """Numeric coercion: text that is no number, null and NaN become ``default``.

    ``kind`` is the column's type, if known: plain numbers are not written as text and parsed again.
    """
    if kind in PLAIN_NUMBERS:
        x = col.cast("double")
    else:
        x = col.cast("string").try_cast("double") if isinstance(col, Column) else col
    x = F.when(~F.isnan(x), x)
    return x if default is None else F.coalesce(x, F.lit(default))


# -- time of day ----------------------------------------------------------------------------

def hour_of(seconds: Column) -> Column:
    return F.floor(F.pmod(seconds, F.lit(DAY)) / HOUR).cast("int")


def day_of_week(seconds: Column) -> Column:
    return F.pmod(F.floor(seconds / DAY), F.lit(7)).cast("int")


def cycle(x: Column, period: int) -> tuple[Column, Column]:
    angle = x * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def is_night(hour: Column) -> Column:
    return flag((hour < 6) | (hour >= 22))


def is_business_hours(hour: Column, dow: Column) -> Column:
    return flag((hour >= 9) & (hour <= 17) & (dow < 5))


def is_suspicious_hour(hour: Column) -> Column:
    return flag(hour.between(2, 5))


# -- amounts --------------------------------------------------------------------------------

def log_amount(amount: Column) -> Column:
    return F.log1p(F.greatest(amount, F.lit(0.0)))


def cents(amount: Column) -> Column:
    return (amount * 100) % 100


def position_between(amount: Column, low: float, high: float) -> Column:
    """Linear position between two quantiles, clipped to 0..1."""
    x = (amount - low) / max(high - low, 1e-9)
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


# -- keys and text --------------------------------------------------------------------------

def device_key(type_col: Column, info_col: Column, unknown: str = "unknown") -> Column:
    """``type|info`` with missing parts empty; both missing gives ``unknown``."""
    key = F.concat_ws("|", F.coalesce(type_col, F.lit("")), F.coalesce(info_col, F.lit("")))
    return F.when(key == "|", F.lit(unknown)).otherwise(key)


def address_key(a: Column, b: Column) -> Column:
    """Address pair as a struct; a missing part is -1."""
    return F.struct(
        F.coalesce(a.cast("double"), F.lit(-1.0)).alias("a1"),
        F.coalesce(b.cast("double"), F.lit(-1.0)).alias("a2"),
    )


def tld(domain: Column) -> Column:
    return F.lower(F.substring_index(domain, ".", -1))


def is_high_risk_tld(domain: Column, tlds=HIGH_RISK_TLDS) -> Column:
    return flag(tld(domain).isin(*tlds))


def is_free_provider(domain: Column) -> Column:
    return flag(F.lower(domain).isin(*FREE_EMAIL_DOMAINS))


def is_disposable(domain: Column) -> Column:
    return flag(domain.rlike("|".join(DISPOSABLE_MARKERS)))


def email_mismatch(a: Column, b: Column) -> Column:
    known = (a != "unknown") & (b != "unknown")
    return flag(a.isNotNull() & b.isNotNull() & known & (a != b))


def os_flags(info: Column) -> dict[str, Column]:
    low = F.lower(info)
    # Device text patterns.
    return {
        "windows": flag(low.contains("windows")),
        "ios": flag(low.rlike("iphone|ipad|ios")),
        "android": flag(low.rlike("android|sm-|moto")),
    }


# -- risk decisions -------------------------------------------------------------------------

def risk_level(score: Column) -> Column:
    return (
        F.when(score >= 0.9, "CRITICAL").when(score >= 0.7, "HIGH")
        .when(score >= 0.4, "MEDIUM").otherwise("LOW")
    )


def alert_level(score: Column) -> Column:
    """Level shown on an alert: a low-scored alert is raised to MEDIUM."""
    level = risk_level(score)
    return F.when(level == "LOW", F.lit("MEDIUM")).otherwise(level)


def recommended_action(level: Column, score: Column) -> Column:
    return (
        F.when((level == "CRITICAL") | (score >= 0.9), "decline")
        .when(level == "HIGH", "escalate").when(level == "MEDIUM", "review").otherwise("approve")
    )


def valid_action(action: Column) -> Column:
    a = F.lower(F.trim(action))
    return F.when(a.isin("approve", "review", "decline", "escalate"), a).otherwise("review")


def investigation_depth(level: Column) -> Column:
    return F.when(level == "CRITICAL", "deep").when(level == "HIGH", "standard").otherwise("quick")


def needs_human_review(level: Column) -> Column:
    return F.coalesce(level.isin("HIGH", "CRITICAL"), F.lit(False))


# -- bins -----------------------------------------------------------------------------------

def bin_index(value: Column, edges) -> Column:
    """Bin of ``value`` among sorted ``edges``: right-open, clamped to the ends, null gives -1."""
    inner = list(edges)[1:-1]
    idx = F.lit(0)
    for e in inner:
        idx = idx + (value >= F.lit(float(e))).cast("int")
    return F.when(value.isNull(), F.lit(-1)).otherwise(idx)


def equal_bin(value: Column, low: float, high: float, n: int) -> Column:
    """Equal-width bin 0..n-1 with the last bin closed."""
    step = (high - low) / n
    if step <= 0:
        return F.when(value.isNotNull(), F.lit(0))
    i = F.floor((value - low) / step)
    # The quotient may be one step off at an edge; the edges low + i * step decide.
    i = i + (value >= (i + 1) * step + low).cast("int") - (value < i * step + low).cast("int")
    return F.least(F.greatest(i, F.lit(0)), F.lit(n - 1)).cast("int")


# -- vectors (higher-order functions, interpreted per element) -------------------------------

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    # The norm goes along in a struct: inside the function of an element it would be added up for each of them.
    one = F.array(F.struct(a.alias("a"), norm(a).alias("n")))
    return F.transform(one, lambda s: F.transform(
        s["a"], lambda x: x.cast("double") / F.when(s["n"] == 0, F.lit(1.0)).otherwise(s["n"])))[0]


def fit_length(a: Column, dim: int) -> Column:
    """Pad with zeros or truncate to ``dim`` elements."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(0).cast("float"), dim)), 1, dim)


def similarity(cosine: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cosine + 1.0) / 2.0))
