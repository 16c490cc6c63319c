"""Names, labels, paths, days and text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _mapping(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]) if pairs else F.create_map().cast("map<string,string>")


def canonical_class(name: Column, aliases: dict[str, str] | None = None, dash: bool = False) -> Column:
    """Trimmed, lower case, spaces (and dashes) as underscores, then the alias."""
    plain = F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit("_"))
    plain = F.replace(plain, F.lit("-"), F.lit("_")) if dash else plain
    return F.coalesce(F.try_element_at(_mapping(aliases or {}), plain), plain)


def label_of(code: Column, mapping: dict[str, str]) -> Column:
    """The label of a code, or the code itself."""
    return F.coalesce(F.try_element_at(_mapping(mapping), code), code)


def utc_day(ts: Column) -> Column:
    return F.to_date(ts)


def iso_z(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def percent_text(value: Column) -> Column:
    """Shares up to 1 as percent, other numbers as they are, with one decimal."""
    return F.format_string("%.1f%%", F.when(value <= 1, value * 100).otherwise(value))


def path_parts(path: Column) -> dict[str, Column]:
    """name, stem and lower-case suffix with its dot of the last part of a path."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    return {"name": name, "stem": F.substring(name, F.lit(1), F.length(name) - F.length(suffix)), "suffix": F.lower(suffix)}


def map_text(values: Column, first: int | None = None, decimals: int | None = None) -> Column:
    """`k: v / k: v` in key order; the first entries only, numbers with fixed decimals, if asked."""
    entries = F.array_sort(F.map_entries(values))
    entries = entries if first is None else F.slice(entries, 1, first)
    shown = lambda v: F.format_string(f"%.{decimals}f", v.cast("double")) if decimals is not None else v.cast("string")
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), shown(e["value"]))), " / ")


def total_ms(timings: Column) -> Column:
    """Sum of the finite values of a map of step timings, null without any."""
    good = F.filter(F.map_values(timings), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(F.size(good) > 0, F.aggregate(good, F.lit(0.0), lambda a, x: a + x))
