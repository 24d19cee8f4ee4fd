"""The load's columns and types, from values of other types."""

import datetime as dt
import decimal
import math

import pytest
from pyspark.sql import functions as F

from arpent.operators import projection
from arpent.operators.loading import LoadError
from arpent.sources.adapters import ENERGY_POLICY, raw_diagnostics
from arpent.operators import energy


def test_values_get_the_stored_types(spark):
    rows = spark.createDataFrame(
        [(15.0, "2023-01-02 10:00:00", 12.345, "7", 1e20), (math.nan, "x", math.nan, "7.5", 2.0), (3.5, None, None, None, None)],
        "arrondissement double, mutation_date string, price_per_m2_raw double, apartment_count string, mutation_value double",
    )
    found = projection.projected(rows, "arrondissement int, mutation_date date, price_per_m2_raw decimal(14,2), apartment_count int, mutation_value decimal(14,2)")
    assert [tuple(r) for r in found.collect()] == [
        (15, dt.date(2023, 1, 2), decimal.Decimal("12.35"), 7, None), (None, None, None, None, decimal.Decimal("2.00")), (None, None, None, None, None),
    ]


def test_facts_have_their_columns(spark, sf_dir):
    found = projection.diagnostics(energy.curated(raw_diagnostics(spark, sf_dir), ENERGY_POLICY))
    assert len(found.columns) == 29 and dict(found.dtypes)["surface_habitable_logement"] == "decimal(10,2)" and "_geopoint" not in found.columns
    assert len(projection.SALES.split(", ")) + projection.SALES.count(",\n") == 24


def test_bad_tables_are_not_loaded(spark):
    rows = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(LoadError, match="missing columns \\['b'\\]"):
        projection.projected(rows, "a int, b int")
    with pytest.raises(LoadError, match="address columns"):
        projection.projected(rows.withColumn("adresse_brut", F.lit("x")), "a int")
