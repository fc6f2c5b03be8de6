"""Scoring formulas as column expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from engramite.functions.normalize import clamp

TINY = 1e-12


def _dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors over their common length, not clamped; 0 if one is null, empty or shorter than 1e-12."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    x, y = F.sqrt(_dot(a, a)), F.sqrt(_dot(b, b))
    return F.when((n > 0) & (x > TINY) & (y > TINY), _dot(a, b) / (x * y)).otherwise(F.lit(0.0))


def l2_normalize(v: Column) -> Column:
    """Scaled to length 1; a vector shorter than 1e-12 stays as it is."""
    norm = F.sqrt(_dot(v, v))
    return F.when(norm > TINY, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(v.cast("array<double>"))


def fit_dimension(v: Column, dim: int) -> Column:
    """Cut or padded with zeros to ``dim`` numbers, then scaled to length 1."""
    padded = F.concat(v.cast("array<double>"), F.array_repeat(F.lit(0.0), dim))
    return l2_normalize(F.slice(padded, 1, dim))


def status_signal(status: Column) -> Column:
    return F.when(status == "success", 1.0).when(status == "partial_success", 0.4).when(status == "timeout", -0.25).otherwise(-0.5)


def learning_target(status: Column, confidence: Column) -> Column:
    """What an outcome pulls the confidence of its causes towards."""
    return clamp((status_signal(status) * confidence + 1.0) / 2.0)


def ema(old: Column, target: Column, rate: float) -> Column:
    return clamp(old * (1.0 - rate) + target * rate)


def saturation(value: Column, target: float) -> Column:
    return F.lit(1.0) - F.exp(-F.greatest(value.cast("double"), F.lit(0.0)) / max(float(target), 1.0))


def freshness(updated_us: Column, as_of_us: int, hours: float) -> Column:
    """exp(-age / hours) over whole seconds of age; 0.5 without a time, 1 for a time to come."""
    age = F.greatest(F.floor((F.lit(as_of_us) - updated_us) / 1e6), F.lit(0)) / 3600.0
    return F.coalesce(F.exp(-age / max(float(hours), 1.0)), F.lit(0.5))


def hop_score(parent: Column, weight: Column, decay: float, hop: int) -> Column:
    """Score of a neighbour at a hop: the parent's own, decayed score times weight times decay to the power of the hop."""
    return F.greatest(parent * weight * (decay**hop), F.lit(0.0))


def event_confidence(kind: Column) -> Column:
    return F.when(kind == "added", 0.65).when(kind == "modified", 0.70).otherwise(0.60)


def three_decimals(x: Column) -> Column:
    """Halves go up even if float noise has them just below."""
    return F.format_string("%.3f", F.round(x + 1e-10, 3))
