import datetime

import pytest
from pyspark.sql import functions as F

from arpent.operators import market

DEFAULT = dict(
    id_mutation="2025-1", date_mutation=datetime.date(2025, 3, 1), nature_mutation="Vente", valeur_fonciere=500000.0, code_commune="75115",
    code_departement="75", id_parcelle="p1", type_local="Appartement", surface_reelle_bati=50.0, nombre_pieces_principales=3.0,
    longitude=2.29, latitude=48.84, source_year=2025, source_file="f", source_sha256="s",
)
SCHEMA = (
    "id_mutation string, date_mutation date, nature_mutation string, valeur_fonciere double, code_commune string, code_departement string, "
    "id_parcelle string, type_local string, surface_reelle_bati double, nombre_pieces_principales double, longitude double, latitude double, "
    "source_year int, source_file string, source_sha256 string"
)


def frame(spark, *changes):
    return spark.createDataFrame([tuple((DEFAULT | c).values()) for c in changes], SCHEMA)


def one(spark, *changes):
    rows = market.curated(frame(spark, *changes)).collect()
    assert len(rows) == 1
    return rows[0]


def test_single_sale(spark):
    r = one(spark, {})
    assert (r.residential_unit_count, r.price_per_m2_raw, r.price_ineligibility_reason, r.arrondissement) == (1, 10000.0, None, 15)


def test_two_apartments_are_two_units(spark):
    r = one(spark, {}, {"surface_reelle_bati": 60.0})
    assert (r.residential_unit_count, r.apartment_count, r.price_ineligibility_reason, r.residential_surface) == (2, 2, "not_single_residential_unit", None)


def test_dependency_keeps_the_price(spark):
    r = one(spark, {}, {"type_local": "Dépendance", "surface_reelle_bati": None})
    assert (r.dependency_count, r.total_component_count, r.price_per_m2_raw) == (1, 2, 10000.0)


def test_exact_duplicate_counts_once(spark):
    assert one(spark, {}, {}).residential_unit_count == 1


@pytest.mark.parametrize(
    "change, reason",
    [
        ({"valeur_fonciere": None}, "missing_or_nonpositive_value"),
        ({"valeur_fonciere": 0.0}, "missing_or_nonpositive_value"),
        ({"surface_reelle_bati": None}, "missing_or_nonpositive_surface"),
        ({"surface_reelle_bati": 0.0}, "missing_or_nonpositive_surface"),
        ({"date_mutation": None}, "invalid_date"),
        ({"code_commune": "92050"}, "invalid_arrondissement"),
        ({"code_commune": None}, "invalid_arrondissement"),
    ],
)
def test_first_reason(spark, change, reason):
    r = one(spark, change)
    assert r.price_ineligibility_reason == reason and r.price_per_m2_raw is None and not r.is_price_per_m2_eligible


def test_inconsistent_value(spark):
    r = one(spark, {}, {"type_local": "Dépendance", "valeur_fonciere": 1.0})
    assert (r.value_consistent, r.mutation_value, r.price_ineligibility_reason) == (False, None, "inconsistent_mutation_value")


def test_all_null_codes_are_not_consistent_but_null_values_are(spark):
    r = one(spark, {"code_commune": None, "valeur_fonciere": None})
    assert (r.geo_consistent, r.value_consistent) == (False, True)


def test_null_id_is_a_group(spark):
    assert one(spark, {"id_mutation": None}).residential_unit_count == 1


def test_years_are_apart_and_other_natures_go(spark):
    rows = market.curated(frame(spark, {}, {"source_year": 2024}, {"nature_mutation": "Adjudication", "id_mutation": "x"}, {"type_local": None, "id_mutation": "y"}))
    assert {(r.source_year, r.id_mutation) for r in rows.collect()} == {(2025, "2025-1"), (2024, "2025-1")}


def test_empty(spark):
    assert market.curated(frame(spark, {}).limit(0)).count() == 0


def test_schema_checks(spark):
    with pytest.raises(market.SchemaError, match="longitude"):
        market.check_schema(frame(spark, {}).drop("longitude"))
    with pytest.raises(market.SchemaError, match="encoding"):
        market.check_schema(frame(spark, {"type_local": "DΘpendance"}))
    market.check_schema(frame(spark, {}))


def test_components_keep_present_columns(spark):
    found = market.components(frame(spark, {}, {"type_local": "Dépendance"}).withColumn("other", F.lit(1)))
    assert found.count() == 1 and "other" not in found.columns and "arrondissement" in found.columns
