"""Classes, directions and sentences as column expressions. Wording is in German where reports are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Class bounds and names of the reports.
SLOPE = [(1.1, "nicht"), (3.0, "sehr schwach"), (5.0, "schwach"), (8.5, "mäßig"), (16.5, "stark"), (24.0, "sehr stark"), (35.0, "steil"), (45.0, "sehr steil")]
SLOPE_LAST = "extrem steil"
SLOPE_STD = [(5.0, "kaum"), (10.0, "etwas"), (15.0, "deutlich")]
SLOPE_STD_LAST = "stark"
PART = [(10.0, "kaum"), (33.0, "teilweise"), (66.0, "zur Hälfte"), (90.0, "größtenteils")]
PART_LAST = "fast vollständig"
DEPTH = [(10.0, "0-10 m"), (20.0, "10-20 m"), (50.0, "20-50 m"), (100.0, "50-100 m")]
DEPTH_LAST = "> 100 m"
COMPASS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]
COMPASS_EN = {"N": "north", "NNE": "north-northeast", "NE": "northeast", "ENE": "east-northeast", "E": "east", "ESE": "east-southeast", "SE": "southeast", "SSE": "south-southeast", "S": "south", "SSW": "south-southwest", "SW": "southwest", "WSW": "west-southwest", "W": "west", "WNW": "west-northwest", "NW": "northwest", "NNW": "north-northwest"}


def classed(v: Column, bounds: list[tuple[float, str]], last: str) -> Column:
    """The first class whose bound the value stays below; null for null."""
    out = F.when(v.isNull(), F.lit(None).cast("string"))
    for limit, name in bounds:
        out = out.when(v < limit, name)
    return out.otherwise(last)


def slope_class(v: Column) -> Column:
    return classed(v, SLOPE, SLOPE_LAST)


def slope_std_class(v: Column) -> Column:
    return classed(v, SLOPE_STD, SLOPE_STD_LAST)


def part_class(v: Column) -> Column:
    return classed(v, PART, PART_LAST)


def depth_class(v: Column) -> Column:
    return classed(v, DEPTH, DEPTH_LAST)


def compass(d: Column) -> Column:
    """One of 16 sectors; a sector's upper limit 11.25 + 22.5 k belongs to it."""
    i = F.greatest(F.ceil((d - 11.25) / 22.5), F.lit(0)) % 16
    return F.element_at(F.array(*map(F.lit, COMPASS)), (i + 1).cast("int"))


def translated(v: Column, names: dict[str, str], strict: bool = False) -> Column:
    """Look up in a fixed dictionary; an unknown key is null, or an error if strict."""
    found = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), v)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no name for "), v)).cast("string")) if strict else found


def volume_verdict(v: Column) -> Column:
    """Only exactly 1000 counts as no change (as the reports have it)."""
    return F.when(v > 1000, "added").when(v < 1000, "removed").when(v == 1000, "unchanged")


def list_sentence(items: Column) -> Column:
    """Items joined by ', ', the last by ' und '."""
    n = F.size(items)
    return F.when(n == 0, "").when(n == 1, F.element_at(items, 1)).otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(" und "), F.element_at(items, -1)))


def keyword_class(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The first class one of whose keywords occurs, whatever the case; null if none does."""
    low, out = F.lower(text), None
    for name, words in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def first_present(address: Column, keys: list[str]) -> Column:
    """The first of the JSON fields that is there."""
    return F.coalesce(*[F.nullif(F.get_json_object(address, f"$.{k}"), F.lit("")) for k in keys])
