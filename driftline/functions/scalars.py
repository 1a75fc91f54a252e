"""Weights, decay, association measures, evidence strengths, dates and rounding; no Python UDFs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.model import EDGE_KINDS, RESOLUTIONS

DAY = 86400.0


def commit_weight(n: Column, excluded: Column) -> Column:
    """1/n, or 0 for an excluded or empty commit."""
    return F.when(excluded | (n <= 0), F.lit(0.0)).otherwise(F.lit(1.0) / n)


def decay(age_days: Column, half_life: float) -> Column:
    """0.5 to the age in half-lives; 1 without a half-life; negative ages count as 0."""
    return F.lit(1.0) if half_life <= 0 else F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / F.lit(float(half_life)))


def confidence(w_both: Column, w_one: Column) -> Column:
    return F.when(w_one <= 0, F.lit(0.0)).otherwise(F.least(w_both / w_one, F.lit(1.0)))


def lift(w_both: Column, w_a: Column, w_b: Column, w_total: Column) -> Column:
    """How often two things change together, over what chance predicts; 0 if that is 0."""
    expected = F.when(w_total > 0, w_a * w_b / w_total).otherwise(F.lit(0.0))
    return F.when(expected > 0, w_both / expected).otherwise(F.lit(0.0))


def ghost_score(conf: Column, n: Column, age_days: Column, lifetime: Column, half_life: float) -> Column:
    return conf * F.log1p(n.cast("double")) * decay(age_days, half_life) * F.log1p(lifetime.cast("double"))


def structural_strength(kind: Column, alive: Column) -> Column:
    by_kind = {0: 0.55, 4: 0.50, 1: 0.45, 2: 0.40, 3: 0.25}
    known = reduce(lambda c, kv: c.when(kind == kv[0], F.lit(kv[1])), by_kind.items(), F.when(F.lit(False), F.lit(0.0)))
    return F.when(alive, known.otherwise(F.lit(0.0))).otherwise(F.lit(0.0))


def ghost_strength(conf: Column, n: Column) -> Column:
    import math

    return F.least(F.lit(0.35) + F.lit(0.55) * F.least(conf * F.log1p(n.cast("double")) / F.lit(math.log(3.0)), F.lit(1.0)), F.lit(0.9))


def cochange_strength(conf: Column, lift_: Column) -> Column:
    return F.least(conf * F.least(lift_ / F.lit(5.0), F.lit(1.0)), F.lit(0.85))


def transitive_strength(distance: Column) -> Column:
    return F.lit(0.25) / F.greatest(distance, F.lit(1))


def drift_strength(behind: Column) -> Column:
    return F.least(F.lit(0.1) + F.lit(0.05) * F.log1p(behind.cast("double")), F.lit(0.4))


def noisy_or(strengths: Column) -> Column:
    """Blend of an array: 1 minus the product of the complements, each strength held to 0..0.999."""
    held = F.transform(strengths, lambda s: F.least(F.greatest(s, F.lit(0.0)), F.lit(0.999)))
    return F.lit(1.0) - F.aggregate(F.array_sort(held), F.lit(1.0), lambda acc, s: acc * (F.lit(1.0) - s))


def round_to(x: Column, places: int) -> Column:
    """Scaled, rounded half away from zero, and scaled back, in doubles."""
    scale = F.lit(float(10**places))
    return F.round(x * scale) / scale


def days_between(later: Column, earlier: Column) -> Column:
    return (later - earlier) / F.lit(DAY)


def whole_days(later: Column, earlier: Column) -> Column:
    """Truncated toward zero."""
    return days_between(later, earlier).cast("long")


def date_str(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def quarter_str(seconds: Column) -> Column:
    t = F.timestamp_seconds(seconds)
    return F.concat(F.date_format(t, "yyyy"), F.lit("-Q"), F.quarter(t).cast("string"))


def civil(seconds: Column) -> Column:
    """Struct (year, month, day) in UTC."""
    t = F.timestamp_seconds(seconds)
    return F.struct(F.year(t).alias("year"), F.month(t).alias("month"), F.dayofmonth(t).alias("day"))


def short_oid(oid: Column, n: int = 12) -> Column:
    return F.substring(oid, 1, n)


def hex_oid(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def edge_kind_name(code: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, EDGE_KINDS)), code.cast("int") + 1)


def resolution_name(code: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, RESOLUTIONS)), code.cast("int") + 1)


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def line_total(added: Column, removed: Column) -> Column:
    return F.coalesce(added, F.lit(0)) + F.coalesce(removed, F.lit(0))


def xml_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def parse_days(text: str) -> float:
    """`365d` or `365` as a number of days."""
    return float(text[:-1] if text.endswith("d") else text)

