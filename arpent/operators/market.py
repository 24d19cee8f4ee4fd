"""Sales: from raw rows, several to a mutation, to one row for each mutation with a price per square metre.

A raw row is not a sale: the value stands on every row of its mutation and is never summed. Residential units are rows
that are left after exact duplicates go, not distinct types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arpent.functions.columns import at_most_one, district, exactly_one, first_reason, holds, only_value, rounded
from arpent.operators.dealing import dealt

#: Fixed values of the sales data.
SALE = "Vente"
APARTMENT, HOUSE = "Appartement", "Maison"
DEPENDENCY = "Dépendance"
COMMERCIAL = "Local industriel. commercial ou assimilé"
REQUIRED = (
    "id_mutation", "date_mutation", "nature_mutation", "valeur_fonciere", "code_commune", "code_departement",
    "id_parcelle", "type_local", "surface_reelle_bati", "nombre_pieces_principales", "longitude", "latitude",
)
#: What UTF-8 read in a wrong code page leaves.
CORRUPT = ("�", "Θ", "Φ", "Γ", "α", "Ã©", "Ã¨", "Ã ")

COMPONENT_COLUMNS = (
    "id_mutation", "date_mutation", "valeur_fonciere", "type_local", "surface_reelle_bati", "nombre_pieces_principales",
    "code_commune", "code_postal", "arrondissement", "id_parcelle", "longitude", "latitude", "nombre_lots",
    "source_year", "source_file", "source_sha256",
)


class SchemaError(ValueError):
    """Columns are missing, or their values are not readable."""


def with_lineage(rows: DataFrame, year: int, file: str, sha256: str) -> DataFrame:
    return rows.withColumns({"source_year": F.lit(year).cast("int"), "source_file": F.lit(file), "source_sha256": F.lit(sha256)})


def corrupt_values(rows: DataFrame, *columns: str) -> DataFrame:
    """column, value: the distinct category values that hold a sign of broken encoding."""
    names = [c for c in columns if c in rows.columns]
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in names))).alias("x"))
    bad = [F.col("x.value").contains(m) for m in CORRUPT]
    found = bad[0]
    for b in bad[1:]:
        found = found | b
    return long.filter(found).select("x.column", "x.value").distinct()


def check_schema(rows: DataFrame) -> None:
    missing = [c for c in REQUIRED if c not in rows.columns]
    if missing:
        raise SchemaError(f"missing columns: {missing}")
    broken = corrupt_values(rows, "nature_mutation", "type_local").limit(5).collect()
    if broken:
        raise SchemaError(f"broken encoding: {[r['value'] for r in broken]}")


#: What makes a mutation; duplicates, mutations and their parcels all lie within one.
KEY = ("source_year", "id_mutation")


def without_duplicates(rows: DataFrame) -> DataFrame:
    """Exact duplicates once; nulls equal nulls. Rows are dealt by the key of mutations, which all that follows can keep."""
    return dealt(rows, *KEY).dropDuplicates()


#: How often a row without duplicates was there.
COPIES = "n_copies"


def counted_rows(rows: DataFrame) -> DataFrame:
    """Exact duplicates once, with how often each row was there; dealt by the key of mutations as well."""
    return dealt(rows, *KEY).groupBy(*rows.columns).agg(F.count("*").alias(COPIES))


def is_residential() -> Column:
    return F.col("type_local").isin(APARTMENT, HOUSE)


def components(rows: DataFrame) -> DataFrame:
    """The residential rows of sales."""
    found = rows.filter((F.col("nature_mutation") == SALE) & is_residential()).withColumn("arrondissement", district(F.col("code_commune")))
    return found.select(*(c for c in COMPONENT_COLUMNS if c in found.columns))


def mutations(rows: DataFrame) -> DataFrame:
    """One row for each mutation with a residential unit, by year and id; null ids are a group too.

    All is one aggregation: min and max tell whether a group has one value, so no distinct sets are built but for parcels."""
    sales = rows.filter(F.col("nature_mutation") == SALE).withColumns({"arrondissement": district(F.col("code_commune")), "_res": holds(is_residential())})
    count = lambda c: F.count_if(c).cast("int")
    of_unit = lambda c: F.when(F.col("_res"), F.col(c))
    found = sales.groupBy(*KEY).agg(
        count(F.col("_res")).alias("residential_unit_count"),
        count(F.col("type_local") == APARTMENT).alias("apartment_count"),
        count(F.col("type_local") == HOUSE).alias("house_count"),
        count(F.col("type_local") == DEPENDENCY).alias("dependency_count"),
        count(F.col("type_local") == COMMERCIAL).alias("commercial_unit_count"),
        F.count("*").cast("int").alias("total_component_count"),
        F.count_distinct("id_parcelle").cast("int").alias("distinct_parcel_count"),
        only_value(F.col("valeur_fonciere")).alias("mutation_value"),
        only_value(F.col("date_mutation")).alias("mutation_date"),
        at_most_one(F.col("valeur_fonciere")).alias("value_consistent"),
        exactly_one(F.col("code_commune")).alias("geo_consistent"),
        only_value(F.col("arrondissement")).alias("arrondissement"),
        F.max(of_unit("type_local")).alias("residential_property_type"),
        F.max(of_unit("surface_reelle_bati")).alias("residential_surface"),
        F.max(of_unit("nombre_pieces_principales")).alias("residential_rooms"),
        F.max(of_unit("longitude")).alias("longitude"),
        F.max(of_unit("latitude")).alias("latitude"),
        F.min("source_file").alias("source_file"),
        F.min("source_sha256").alias("source_sha256"),
    )
    single = F.col("residential_unit_count") == 1
    alone = {c: F.when(single, F.col(c)) for c in ("residential_property_type", "residential_surface", "residential_rooms", "longitude", "latitude")}
    return found.filter("residential_unit_count >= 1").withColumns(alone)


def with_eligibility(found: DataFrame, districts: int = 20) -> DataFrame:
    """The first reason against a price, whether there is none, and the price to two places."""
    value, surface = F.col("mutation_value"), F.col("residential_surface")
    missing = lambda x: ~holds(x > 0)
    reason = first_reason(
        ("not_single_residential_unit", F.col("residential_unit_count") != 1),
        ("inconsistent_mutation_value", ~F.col("value_consistent")),
        ("missing_or_nonpositive_value", missing(value)),
        ("missing_or_nonpositive_surface", missing(surface)),
        ("invalid_date", F.col("mutation_date").isNull()),
        ("invalid_arrondissement", ~holds(F.col("arrondissement").between(1, districts))),
    )
    found = found.withColumn("price_ineligibility_reason", reason)
    eligible = F.col("price_ineligibility_reason").isNull()
    price = F.when(eligible, rounded(value / F.when(surface > 0, surface)))
    return found.withColumns({"is_price_per_m2_eligible": eligible, "price_per_m2_raw": price})


def curated(rows: DataFrame, districts: int = 20) -> DataFrame:
    """Raw rows to mutations with eligibility, in one shuffle of the sales."""
    return with_eligibility(mutations(without_duplicates(rows.filter(F.col("nature_mutation") == SALE))), districts)
