"""What the analytics take for granted, in one value; nothing else holds years, districts or bands."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Policy:
    first_year: int = 2021
    last_year: int = 2025
    complete_years: tuple[int, ...] = (2021, 2022, 2023, 2024, 2025)
    partial_years: tuple[int, ...] = (2026,)
    least_price: float = 1000.0
    most_price: float = 50000.0
    districts: int = 20
    least_sample: int = 30
    labels: tuple[str, ...] = ("A", "B", "C", "D", "E", "F", "G")
    most_areas: int = 20
    most_areas_of_a_tool: int = 5


DEFAULT = Policy()


class InputError(ValueError):
    """A question that the analytics do not answer."""


def checked_years(start: int, end: int, policy: Policy = DEFAULT) -> tuple[int, int]:
    known = (*policy.complete_years, *policy.partial_years)
    for year in (start, end):
        if isinstance(year, bool) or not isinstance(year, int) or year not in known:
            raise InputError(f"year {year!r} is not between {min(known)} and {max(known)}")
    if start > end:
        raise InputError(f"the period {start} to {end} runs backwards")
    return start, end


def checked_district(district: int | None, policy: Policy = DEFAULT) -> int | None:
    if district is None:
        return None
    if isinstance(district, bool) or not isinstance(district, int) or not 1 <= district <= policy.districts:
        raise InputError(f"district {district!r} is not between 1 and {policy.districts}")
    return district


def checked_areas(areas: list[int], policy: Policy = DEFAULT, most: int | None = None) -> list[int]:
    """The areas without repeats, in the order of their first mention; at least two."""
    found = list(dict.fromkeys(checked_district(a, policy) for a in areas))
    most = most or policy.most_areas
    if None in found or not 2 <= len(found) <= most:
        raise InputError(f"a comparison takes 2 to {most} different districts")
    return found


def includes_partial(start: int, end: int, policy: Policy = DEFAULT) -> bool:
    return any(start <= y <= end for y in policy.partial_years)
