"""Energy diagnostics: one row for each diagnostic number, with validity flags and reasons of exclusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arpent.functions.columns import building_type, district, first_reason, holds, label, population
from arpent.operators.dealing import dealt
from arpent.policy import DEFAULT, Policy

#: The columns of the source, and those of curated diagnostics.
STRINGS = (
    "_id", "numero_dpe", "etiquette_dpe", "etiquette_ges", "type_batiment", "periode_construction", "code_postal_ban",
    "code_insee_ban", "code_departement_ban", "_geopoint",
)
NUMBERS = ("conso_5_usages_par_m2_ep", "emission_ges_5_usages_par_m2", "surface_habitable_logement")
DATES = ("date_etablissement_dpe", "date_reception_dpe", "date_fin_validite_dpe")
#: Diagnostics are wide, and are told apart by all of their columns: so many times less of the files is a task's share.
FINER = 4
REQUIRED = ("numero_dpe", "date_etablissement_dpe", "etiquette_dpe", "etiquette_ges", "code_insee_ban", "surface_habitable_logement")
PROCESSED = (
    "numero_dpe", "date_etablissement_dpe", "date_reception_dpe", "date_fin_validite_dpe", "diagnostic_year",
    "etiquette_dpe", "etiquette_dpe_norm", "etiquette_ges", "etiquette_ges_norm", "conso_5_usages_par_m2_ep",
    "emission_ges_5_usages_par_m2", "surface_habitable_logement", "type_batiment", "type_batiment_norm",
    "analysis_population", "periode_construction", "code_insee_ban", "code_postal_ban", "arrondissement",
    "arrondissement_source", "_geopoint", "is_valid_dpe_number", "is_valid_arrondissement", "is_geography_consistent",
    "is_valid_dpe_label", "is_valid_ges_label", "is_valid_surface", "is_valid_consumption", "is_valid_emission",
    "is_residential_unit_type", "is_complete_analysis_year", "is_partial_year", "is_label_analysis_eligible",
    "label_exclusion_reason", "is_intensity_analysis_eligible", "intensity_exclusion_reason", "is_analysis_eligible",
    "exclusion_reason",
)


def newest(rows: DataFrame, key: str = "numero_dpe", date: str = "date_etablissement_dpe", tie: str = "_id") -> DataFrame:
    """Of rows of equal key the newest, of equal dates that of the least tie; rows without a key all stay. Rows are dealt once,
    by their key or, without one, each by itself; removing duplicates and ranking both keep to that."""
    own = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("\0"), F.xxhash64(*rows.columns).cast("string")))
    rows = dealt(rows.withColumn("_own", own), "_own", finer=FINER).dropDuplicates()
    order = Window.partitionBy("_own").orderBy(F.col(date).desc_nulls_last(), F.col(tie).asc_nulls_last())
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col(key).isNull() | (F.col("_n") == 1)).drop("_own", "_n")


def duplicate_counts(rows: DataFrame, key: str = "numero_dpe") -> DataFrame:
    """One row: rows_before, exact_duplicates, missing_key, conflicting, unique_keys, rows_after."""
    whole = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    hashed = rows.select(F.col(key).alias("k"), F.sha2(whole, 256).alias("h")).groupBy("k", "h").agg(F.count("*").alias("n"))
    by_key = hashed.groupBy("k").agg(F.sum("n").alias("n"), F.count("*").alias("d"))
    total = by_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum(F.col("n") - F.col("d")), F.lit(0)).alias("exact_duplicates"),
        F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("d"))), F.lit(0)).alias("missing_key"),
        F.count_if(F.col("k").isNotNull() & (F.col("d") > 1)).alias("conflicting"),
        F.count("k").alias("unique_keys"),
    )
    return total.withColumn("rows_after", F.col("unique_keys") + F.col("missing_key"))


def with_flags(rows: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    insee, postal = district(F.col("code_insee_ban"), "751", policy.districts), district(F.col("code_postal_ban"), "750", policy.districts)
    rows = rows.withColumns({
        "arrondissement": F.coalesce(insee, postal),
        "arrondissement_source": F.when(insee.isNotNull(), "insee").when(postal.isNotNull(), "postal"),
        "is_geography_consistent": ~holds(insee != postal),
        "etiquette_dpe_norm": label(F.col("etiquette_dpe"), policy.labels),
        "etiquette_ges_norm": label(F.col("etiquette_ges"), policy.labels),
        "type_batiment_norm": building_type(F.col("type_batiment")),
        "diagnostic_year": F.year("date_etablissement_dpe"),
    })
    rows = rows.withColumns({
        "analysis_population": population(F.col("type_batiment_norm")),
        "is_valid_dpe_number": F.col("numero_dpe").isNotNull(),
        "is_valid_arrondissement": F.col("arrondissement").isNotNull(),
        "is_valid_dpe_label": F.col("etiquette_dpe_norm").isNotNull(),
        "is_valid_ges_label": F.col("etiquette_ges_norm").isNotNull(),
        "is_valid_surface": holds(F.col("surface_habitable_logement") > 0),
        "is_valid_consumption": holds(F.col("conso_5_usages_par_m2_ep") >= 0),
        "is_valid_emission": holds(F.col("emission_ges_5_usages_par_m2") >= 0),
        "is_residential_unit_type": holds(F.col("type_batiment_norm").isin("maison", "appartement")),
        "is_complete_analysis_year": holds(F.col("diagnostic_year").isin(*policy.complete_years)),
        "is_partial_year": holds(F.col("diagnostic_year").isin(*policy.partial_years)),
    })
    rules = [
        ("missing_numero_dpe", ~F.col("is_valid_dpe_number")),
        ("invalid_arrondissement", ~F.col("is_valid_arrondissement")),
        ("invalid_dpe_label", ~F.col("is_valid_dpe_label")),
        ("not_dwelling_unit", F.col("analysis_population") != "dwelling_unit"),
    ]
    more = [(f"invalid_{x}", ~F.col(f"is_valid_{x}")) for x in ("surface", "consumption", "emission")]
    rows = rows.withColumns({"label_exclusion_reason": first_reason(*rules), "intensity_exclusion_reason": first_reason(*rules, *more)})
    intensity = F.col("intensity_exclusion_reason")
    return rows.withColumns({
        "is_label_analysis_eligible": F.col("label_exclusion_reason").isNull(),
        "is_intensity_analysis_eligible": intensity.isNull(),
        "is_analysis_eligible": intensity.isNull(),
        "exclusion_reason": intensity,
    })


def curated(rows: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    missing = [c for c in REQUIRED if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    found = with_flags(newest(rows), policy)
    return found.select(*(c for c in PROCESSED if c in found.columns))
