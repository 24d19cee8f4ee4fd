import datetime as dt

import pytest

from arpent.operators import energy
from arpent.policy import Policy

BASE = dict(
    _id="id1", numero_dpe="DPE-1", date_etablissement_dpe=dt.date(2023, 5, 1), etiquette_dpe="D", etiquette_ges="C", conso_5_usages_par_m2_ep=250.0,
    emission_ges_5_usages_par_m2=30.0, surface_habitable_logement=45.0, type_batiment="appartement", code_postal_ban="75015", code_insee_ban="75115", _geopoint="48.84,2.29",
)
SCHEMA = (
    "_id string, numero_dpe string, date_etablissement_dpe date, etiquette_dpe string, etiquette_ges string, conso_5_usages_par_m2_ep double, "
    "emission_ges_5_usages_par_m2 double, surface_habitable_logement double, type_batiment string, code_postal_ban string, code_insee_ban string, _geopoint string"
)


def frame(spark, *changes):
    return spark.createDataFrame([tuple((BASE | c).values()) for c in changes], SCHEMA)


def one(spark, change):
    return energy.curated(frame(spark, change)).collect()[0]


@pytest.mark.parametrize(
    "change, label, intensity",
    [
        ({}, None, None),
        ({"numero_dpe": None}, "missing_numero_dpe", "missing_numero_dpe"),
        ({"code_insee_ban": "92050", "code_postal_ban": "92100"}, "invalid_arrondissement", "invalid_arrondissement"),
        ({"etiquette_dpe": "X"}, "invalid_dpe_label", "invalid_dpe_label"),
        ({"type_batiment": "immeuble"}, "not_dwelling_unit", "not_dwelling_unit"),
        ({"surface_habitable_logement": None}, None, "invalid_surface"),
        ({"surface_habitable_logement": 0.0}, None, "invalid_surface"),
        ({"conso_5_usages_par_m2_ep": -1.0}, None, "invalid_consumption"),
        ({"emission_ges_5_usages_par_m2": None}, None, "invalid_emission"),
    ],
)
def test_reasons(spark, change, label, intensity):
    r = one(spark, change)
    assert (r.label_exclusion_reason, r.intensity_exclusion_reason, r.exclusion_reason) == (label, intensity, intensity)
    assert r.is_label_analysis_eligible == (label is None) and r.is_analysis_eligible == (intensity is None)


def test_district_sources(spark):
    assert (one(spark, {}).arrondissement, one(spark, {}).arrondissement_source) == (15, "insee")
    r = one(spark, {"code_insee_ban": None})
    assert (r.arrondissement, r.arrondissement_source, r.is_geography_consistent) == (15, "postal", True)
    assert not one(spark, {"code_postal_ban": "75016"}).is_geography_consistent


def test_normalisation(spark):
    r = one(spark, {"etiquette_dpe": " g ", "type_batiment": "Maison "})
    assert (r.etiquette_dpe_norm, r.type_batiment_norm, r.analysis_population) == ("G", "maison", "dwelling_unit")
    assert one(spark, {"type_batiment": "chateau"}).analysis_population == "unknown"


def test_years(spark):
    r = one(spark, {"date_etablissement_dpe": dt.date(2026, 1, 1)})
    assert (r.is_partial_year, r.is_complete_analysis_year) == (True, False)
    r = one(spark, {"date_etablissement_dpe": None})
    assert (r.diagnostic_year, r.is_partial_year, r.is_complete_analysis_year) == (None, False, False)


def test_newest_and_ties(spark):
    rows = energy.newest(frame(spark, {"_id": "a", "date_etablissement_dpe": dt.date(2022, 1, 1)}, {"_id": "b"}, {"_id": "c", "date_etablissement_dpe": None}))
    assert [r._id for r in rows.collect()] == ["b"]
    assert [r._id for r in energy.newest(frame(spark, {"_id": "b"}, {"_id": "a"})).collect()] == ["a"]
    assert energy.newest(frame(spark, {"numero_dpe": None}, {"numero_dpe": None, "_id": "z"})).count() == 2


def test_duplicate_counts(spark):
    r = energy.duplicate_counts(frame(spark, {}, {}, {"_id": "b"}, {"numero_dpe": "n2"}, {"numero_dpe": None})).first()
    assert (r.rows_before, r.exact_duplicates, r.missing_key, r.conflicting, r.unique_keys, r.rows_after) == (5, 1, 1, 1, 2, 3)


def test_missing_column(spark):
    with pytest.raises(ValueError, match="etiquette_ges"):
        energy.curated(frame(spark, {}).drop("etiquette_ges"))


def test_policy_years(spark):
    r = energy.with_flags(frame(spark, {}), Policy(complete_years=(2020,), partial_years=(2023,))).first()
    assert (r.is_complete_analysis_year, r.is_partial_year) == (False, True)
