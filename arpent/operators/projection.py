"""What is loaded of curated tables: the columns and types of the stored facts.

A number that arrives as another type, or as NaN, is cast or null; dates that arrive as times lose them; coordinates are
read from the point of a diagnostic. Missing columns and address columns are errors, columns that are not stored go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, DoubleType, IntegerType, StructType

from arpent.functions.columns import geopoint
from arpent.operators.loading import LoadError, forbidden_columns

#: The stored facts.
SALES = """id_mutation string, residential_unit_count int, apartment_count int, house_count int, dependency_count int, commercial_unit_count int,
total_component_count int, distinct_parcel_count int, mutation_value decimal(14,2), mutation_date date, value_consistent boolean, geo_consistent boolean,
residential_property_type string, residential_surface decimal(10,2), residential_rooms decimal(5,1), arrondissement int, longitude double, latitude double,
source_year int, source_file string, source_sha256 string, is_price_per_m2_eligible boolean, price_ineligibility_reason string, price_per_m2_raw decimal(14,2)"""
DIAGNOSTICS = """numero_dpe string, date_etablissement_dpe date, date_fin_validite_dpe date, diagnostic_year int, etiquette_dpe_norm string, etiquette_ges_norm string,
surface_habitable_logement decimal(10,2), conso_5_usages_par_m2_ep double, emission_ges_5_usages_par_m2 double, type_batiment_norm string, analysis_population string,
periode_construction string, arrondissement int, latitude double, longitude double, is_valid_arrondissement boolean, is_geography_consistent boolean,
is_valid_dpe_label boolean, is_valid_ges_label boolean, is_valid_surface boolean, is_valid_consumption boolean, is_valid_emission boolean,
is_residential_unit_type boolean, is_label_analysis_eligible boolean, is_intensity_analysis_eligible boolean, is_complete_analysis_year boolean,
is_partial_year boolean, label_exclusion_reason string, intensity_exclusion_reason string"""


def _as(x: Column, kind, given: str) -> Column:
    if isinstance(kind, IntegerType | DoubleType | DecimalType):
        number = x.try_cast("double")
        number = F.when(~F.isnan(number), number)
        exact = x.try_cast(kind) if given.startswith(("decimal", "int", "bigint")) else number.try_cast(kind)
        return F.when(number == F.floor(number), exact) if isinstance(kind, IntegerType) else exact
    return x.try_cast("timestamp").cast("date") if isinstance(kind, DateType) else x.try_cast(kind)


def projected(rows: DataFrame, schema: str) -> DataFrame:
    """rows with exactly the columns and types of a schema."""
    if bad := forbidden_columns(rows):
        raise LoadError(f"address columns {bad}")
    if "_geopoint" in rows.columns:
        rows = rows.withColumn("_point", geopoint(F.col("_geopoint"))).withColumns({c: F.col(f"_point.{c}") for c in ("latitude", "longitude")})
    wanted, given = StructType.fromDDL(schema), dict(rows.dtypes)
    if missing := [f.name for f in wanted if f.name not in given]:
        raise LoadError(f"missing columns {missing}")
    return rows.select(*(_as(F.col(f.name), f.dataType, given[f.name]).alias(f.name) for f in wanted))


def sales(rows: DataFrame) -> DataFrame:
    return projected(rows, SALES)


def diagnostics(rows: DataFrame) -> DataFrame:
    return projected(rows, DIAGNOSTICS)
