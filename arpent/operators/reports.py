"""Whole quality reports as rows of section, key, value and text, and as Markdown.

Counts by the values of several columns come from one pass in grouping sets, quantiles of several columns from one count
of their values, all single numbers from one aggregate. Reports are aggregates only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arpent.functions.columns import percent, rounded
from arpent.operators import energy
from arpent.operators.quality import SUMMARY_QUANTILES
from arpent.operators.quantiles import exact

SHAPE = "section string, key string, value double, text string"


def section_counts(rows: DataFrame, sections: dict[str, Column]) -> DataFrame:
    """section, key, n: for each section how often each value of its column occurs, null included, in one pass."""
    n = len(sections)
    own = rows.select(*(c.cast("string").alias(f"_{i}") for i, c in enumerate(sections.values())))
    sets = [[F.col(f"_{i}")] for i in range(n)]
    found = own.groupingSets(sets, *(F.col(f"_{i}") for i in range(n))).agg(F.count("*").alias("n"), F.grouping_id().alias("_set"))
    at = F.lit(None).cast("string")
    key = F.lit(None).cast("string")
    for i, name in enumerate(sections):  # the set's bit is the one that is not set; the first column has the highest
        mine = F.col("_set") == (1 << n) - 1 - (1 << (n - 1 - i))
        at, key = F.when(mine, F.lit(name)).otherwise(at), F.when(mine, F.col(f"_{i}")).otherwise(key)
    return found.select(at.alias("section"), key.alias("key"), "n")


def _rows(one: DataFrame, entries: list[tuple[str, str, Column, Column | None]]) -> DataFrame:
    """A frame of one row as rows of section, key, value, text."""
    none = F.lit(None)
    each = (F.struct(F.lit(s).alias("section"), F.lit(k).alias("key"), (none if v is None else v).cast("double").alias("value"), (none if t is None else t).cast("string").alias("text")) for s, k, v, t in entries)
    return one.select(F.inline(F.array(*each)))


#: The fields whose missing values a report of diagnostics tells.
CHECKED = (
    "numero_dpe", "date_etablissement_dpe", "etiquette_dpe", "etiquette_ges", "surface_habitable_logement",
    "conso_5_usages_par_m2_ep", "emission_ges_5_usages_par_m2", "code_insee_ban", "_geopoint",
)
MEASURED = {"surface": "surface_habitable_logement", "consumption": "conso_5_usages_par_m2_ep", "emissions": "emission_ges_5_usages_par_m2"}
OUTLIERS = "values of surface, consumption and emission stay as they are; extremes are reported, not left out"


def energy_sections(rows: DataFrame, raw: DataFrame, snapshot: dict | None = None, districts: int = 20) -> DataFrame:
    """section, key, value, text over curated diagnostics and the raw rows they come from: what was retrieved (of a
    snapshot's manifest), duplicates, totals, dates, counts by population, year, district, labels, types, period and reasons,
    the types as observed, quantiles, missing values and the districts that do not occur."""
    date, flag = F.col("date_etablissement_dpe"), lambda c: F.count_if(F.col(c)).alias(c)
    district = F.when(F.col("arrondissement").between(1, districts), F.col("arrondissement"))
    flags = {
        "label_analysis_eligible_rows": "is_label_analysis_eligible", "intensity_analysis_eligible_rows": "is_intensity_analysis_eligible",
        "complete_analysis_year_count": "is_complete_analysis_year", "partial_year_count": "is_partial_year",
    }
    kinds = {"apartment_count": "appartement", "house_count": "maison", "whole_building_count": "immeuble"}
    one = rows.agg(
        F.count("*").alias("n"), *(flag(c) for c in flags.values()), *(F.count_if(F.col("type_batiment_norm") == k).alias(n) for n, k in kinds.items()),
        F.count_if(~F.col("is_geography_consistent")).alias("inconsistent"), F.min(date).alias("date_min"), F.max(date).alias("date_max"),
        *(F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in CHECKED),
        F.array_sort(F.array_compact(F.collect_set(district))).alias("seen"),  # at most as many as there are districts
    )
    gone = F.array_except(F.sequence(F.lit(1), F.lit(districts)), "seen")
    entries = [("totals", "processed_rows", F.col("n"), None), *(("totals", n, F.col(c), None) for n, c in flags.items()), *(("totals", n, F.col(n), None) for n in kinds)]
    entries += [("totals", "geography_inconsistencies", F.col("inconsistent"), None), ("totals", "coordinate_coverage_pct", percent(F.col("n") - F.col("no__geopoint"), F.col("n")), None)]
    entries += [("totals", "districts_covered", F.size("seen"), None), ("totals", "districts_missing", F.size(gone), F.array_join(gone.cast("array<string>"), ","))]
    entries += [("establishment_date", k, None, F.col(f"date_{k}")) for k in ("min", "max")]
    entries += [("missing_pct", c, percent(F.col(f"no_{c}"), F.col("n")), None) for c in CHECKED]
    entries += [("outlier_policy", None, None, F.lit(OUTLIERS))]
    parts = [_rows(one, entries)]
    counts = {
        "population": F.col("analysis_population"), "year": F.year(date), "district": F.col("arrondissement"), "dpe_label": F.col("etiquette_dpe_norm"),
        "ges_label": F.col("etiquette_ges_norm"), "building_type": F.col("type_batiment_norm"), "construction_period": F.col("periode_construction"),
        "label_exclusions": F.col("label_exclusion_reason"), "intensity_exclusions": F.col("intensity_exclusion_reason"),
    }
    counted = section_counts(rows, counts).unionByName(section_counts(raw, {"building_type_observed": F.col("type_batiment")}))
    parts.append(counted.select("section", "key", F.col("n").cast("double").alias("value"), F.lit(None).cast("string").alias("text")))
    asked = {"min": 0.0, "max": 1.0} | SUMMARY_QUANTILES
    spread = exact(rows, {m: F.col(c) for m, c in MEASURED.items()}, {f"{m}_{k}": (m, q) for m in MEASURED for k, q in asked.items()})
    parts.append(_rows(spread, [*((f"{m}_quantiles", k, rounded(F.col(f"{m}_{k}")), None) for m in MEASURED for k in asked), *((f"{m}_quantiles", "count", F.col(f"n_{m}"), None) for m in MEASURED)]))
    twice = energy.duplicate_counts(raw)
    names = {"exact_duplicates": "exact_duplicates", "unique_keys": "unique_numero_dpe", "missing_key": "missing_numero_dpe", "conflicting": "conflicting_duplicates"}
    parts.append(_rows(twice, [("retrieval", "rows_retrieved", F.col("rows_before"), None), *(("duplicates", n, F.col(c), None) for c, n in names.items())]))
    if snapshot:
        told = [("retrieval", str(k), float(v) if isinstance(v, int | float) else None, None if isinstance(v, int | float) else str(v)) for k, v in snapshot.items()]
        parts.append(rows.sparkSession.createDataFrame(told, SHAPE))
    return reduce(DataFrame.unionByName, parts)


def as_markdown(rows: DataFrame, title: str, note: str = "", most: int = 10_000) -> str:
    """A report of sections as Markdown: a list for each section, by key. Reports are of bounded size; a larger one than
    `most` rows is an error, not cut."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report of more than {most} rows")
    lines, plain = [f"# {title}", ""] + ([f"> {note}", ""] if note else []), lambda v: f"{v:,.2f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)
    for section in dict.fromkeys(r.section for r in found):
        lines += [f"## {section.replace('_', ' ').capitalize()}", ""]
        own = sorted((r for r in found if r.section == section), key=lambda r: (r.key is None, r.key or ""))
        for r in own:
            said = "; ".join(plain(x) for x in (r.value, r.text) if x not in (None, ""))
            lines.append(f"- {r.key}: {said}" if r.key is not None or r.value is not None else f"- {said}")
        lines.append("")
    return "\n".join(lines)
