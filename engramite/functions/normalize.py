"""Normalising column expressions, and their counterparts for driver-side options."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?"
_EDGE_SPACE = r"(?U)^\s+|\s+$"


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """``x`` kept within bounds; null stays null and NaN becomes ``high``."""
    return F.when(x.isNotNull(), F.least(F.greatest(x.cast("double"), F.lit(float(low))), F.lit(float(high))))


def trimmed(x: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(x.cast("string"), _EDGE_SPACE, "")


def number(x: Column, default: float | None = None, trim: bool = False) -> Column:
    """A number from a numeric or a string column, whose longest numeric prefix counts."""
    text = trimmed(x) if trim else x.cast("string")
    found = F.regexp_extract(text, _NUMBER, 0).try_cast("double")
    return found if default is None else F.coalesce(found, F.lit(float(default)))


def probability(x: Column, default: float = 0.5, trim: bool = False) -> Column:
    """Numbers and numeric prefixes within 0 and 1; anything else is the default. Goals trim and use 0."""
    return clamp(number(x, default, trim))


def enum(x: Column, allowed: Iterable[str], default: str) -> Column:
    """A known value, told apart from case and white space, or the default."""
    key = F.lower(trimmed(x))
    return F.when(key.isin(*allowed), key).otherwise(F.lit(default))


def optional_string(x: Column) -> Column:
    """Trimmed; the empty string is null."""
    return F.nullif(trimmed(x), F.lit(""))


def string_list(xs: Column) -> Column:
    """Trimmed strings without empty ones; the first of equals stays. Null is the empty list."""
    clean = F.filter(F.transform(xs, trimmed), lambda v: v != "")
    return F.coalesce(F.array_distinct(clean), F.array().cast("array<string>"))


def json_list(x: Column) -> Column:
    """A JSON list of strings; bad JSON is the empty list."""
    return string_list(F.from_json(x, "array<string>"))


def json_map(x: Column) -> Column:
    """JSON text of an object; anything else is ``{}``."""
    return F.when(F.get_json_object(x, "$").startswith("{"), x).otherwise(F.lit("{}"))


def timestamp(x: Column, fallback: Column) -> Column:
    """A time with an explicit offset in ISO-8601, or the fallback."""
    text = x.cast("string")
    return F.coalesce(F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(text)), fallback)


def epoch_seconds(us: Column) -> Column:
    """Whole seconds of epoch microseconds."""
    return F.floor(us / F.lit(1_000_000))


def _prefix(value: object) -> int | None:
    if isinstance(value, bool):
        return None
    if isinstance(value, int):
        return value
    m = re.match(r"[+-]?\d+", value) if isinstance(value, str) else None
    return int(m[0]) if m else None


def unit(value: object, default: float) -> float:
    """A number, or the numeric prefix of a text, within 0 and 1; anything else is the default."""
    if isinstance(value, str) and (m := re.match(_NUMBER, value.strip())):
        value = m[0]
    if isinstance(value, bool):
        return default
    try:
        return min(max(float(value), 0.0), 1.0)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return default


def graph_limit(value: object, default: int = 10) -> int:
    """A positive whole number or its textual prefix; anything else is the default."""
    n = _prefix(value)
    return n if n is not None and n > 0 else default


def goal_limit(value: object) -> int | None:
    """A positive whole number, or None for no limit."""
    n = _prefix(value)
    return n if n is not None and n > 0 else None


def boolean(value: object, default: bool = False) -> bool:
    if isinstance(value, bool):
        return value
    return default if value is None else str(value).strip().lower() in ("1", "true", "yes", "y")


def choice(value: object, allowed: Iterable[str]) -> str | None:
    """A known value of an option, or None, which filters take as off."""
    key = str(value).strip().lower() if value is not None else None
    return key if key in tuple(allowed) else None
