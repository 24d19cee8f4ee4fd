"""Column expressions that several operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, places: int = 2) -> Column:
    """Half away from zero in a form that other engines repeat exactly."""
    scale = 10**places
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that holds; a null condition counts as one that does not."""
    return reduce(lambda found, rule: F.when(F.coalesce(rule[1], F.lit(False)), rule[0]).otherwise(found), reversed(rules), F.lit(None).cast("string"))


def holds(condition: Column) -> Column:
    """A condition with null as false."""
    return F.coalesce(condition, F.lit(False))


def district(code: Column, prefix: str = "751", most: int = 20) -> Column:
    """The district of a five-character code: the prefix and two digits from 01 on; all else is null."""
    number = F.try_element_at(F.split(F.regexp_extract(code, rf"^{prefix}([0-9]{{2}})$", 1), ","), F.lit(1))
    number = F.when(number != "", number.cast("int"))
    return F.when(number.between(1, most), number)


def cleaned_id(x: Column) -> Column:
    """An identifier without the `.0` that a detour through numbers leaves."""
    return F.regexp_replace(x, r"\.0$", "")


def number(x: Column) -> Column:
    """A number, null for what is none, and for NaN."""
    value = x.try_cast("double")
    return F.when(~F.isnan(value), value)


def label(x: Column, labels: tuple[str, ...]) -> Column:
    value = F.upper(F.trim(x))
    return F.when(value.isin(*labels), value)


def building_type(x: Column) -> Column:
    value = F.lower(F.trim(x))
    return F.when(value.isin("maison", "appartement", "immeuble"), value)


def population(kind: Column) -> Column:
    return F.when(kind.isin("appartement", "maison"), "dwelling_unit").when(kind == "immeuble", "whole_building").otherwise("unknown")


def geopoint(x: Column) -> Column:
    """struct(latitude, longitude) of "lat,lon"; both null unless both are numbers in range."""
    parts = F.split(x, ",")
    lat, lon = (F.trim(F.get(parts, F.lit(i))).try_cast("double") for i in (0, 1))
    good = holds((F.size(parts) == 2) & lat.between(-90, 90) & lon.between(-180, 180))
    return F.struct(F.when(good, lat).alias("latitude"), F.when(good, lon).alias("longitude"))


def only_value(x: Column) -> Column:
    """The single distinct value that a group has, null if it has none or several. Min and max need no distinct sets."""
    return F.when(F.min(x) == F.max(x), F.min(x))


def at_most_one(x: Column) -> Column:
    return F.coalesce(F.min(x) == F.max(x), F.lit(True))


def exactly_one(x: Column) -> Column:
    return F.coalesce(F.min(x) == F.max(x), F.lit(False))


def percent(part: Column, whole: Column) -> Column:
    """A share in percent, 0.0 of nothing."""
    return F.when(whole > 0, rounded(part / whole * 100)).otherwise(F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """The cosine of two arrays, within [-1, 1]; null where a length is zero or lengths differ."""
    a, b = (F.transform(x, lambda v: v.cast("double")) for x in (a, b))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm)))
