"""The test tables seen as sales and diagnostics, for queries that have no domain data at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arpent.operators.dealing import dealt_alike
from arpent.operators.market import APARTMENT, COMMERCIAL, DEPENDENCY, HOUSE, SALE
from arpent.policy import Policy

#: The years of the sales; the last is cut short.
SALES_POLICY = Policy(1995, 2000, (1995, 1996, 1997, 1998, 1999, 2000), (2001,))
ENERGY_POLICY = Policy()
EXCHANGE = "Échange"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as raw sale rows: the order's total stands on every line, as a sale's value on every row."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    part = table(spark, sf_dir, "part").select("p_partkey", F.substring_index("p_type", " ", 1).alias("kind"))
    line = line.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    order = order.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")  # each side's own first, while rows are few and narrow
    line, order = dealt_alike(line, order, "l_orderkey", "o_orderkey")
    rows = line.join(order, F.col("l_orderkey") == F.col("o_orderkey"))
    kind = F.col("kind")
    kinds = F.when(kind == "ECONOMY", APARTMENT).when(kind == "STANDARD", HOUSE).when(kind == "SMALL", DEPENDENCY).when(kind == "LARGE", COMMERCIAL)
    code = F.when(F.col("c_nationkey") < 20, F.format_string("751%02d", F.col("c_nationkey") + 1)).otherwise("92050")
    return rows.select(
        F.col("l_orderkey").cast("string").alias("id_mutation"),
        F.col("o_orderdate").cast("date").alias("date_mutation"),
        F.when(F.col("o_orderstatus") == "P", EXCHANGE).otherwise(SALE).alias("nature_mutation"),
        F.col("o_totalprice").alias("valeur_fonciere"),
        code.alias("code_commune"),
        F.lit("75").alias("code_departement"),
        F.col("l_partkey").cast("string").alias("id_parcelle"),
        kinds.alias("type_local"),
        F.col("l_quantity").cast("double").alias("surface_reelle_bati"),
        F.col("l_linenumber").cast("double").alias("nombre_pieces_principales"),
        (F.col("l_suppkey") % 25 / 4).alias("longitude"),
        (F.col("l_suppkey") % 20 / 4 + 44).alias("latitude"),
        F.year("o_orderdate").alias("source_year"),
        F.lit("lineitem").alias("source_file"),
        F.lit("deadbeef").alias("source_sha256"),
    )


def raw_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as diagnostics: a user and kind of event is one number with many versions."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    types = F.when(kind == "view", "appartement").when(kind == "click", "maison").when(kind == "signup", " Appartement ").when(kind == "purchase", "immeuble").otherwise("chateau")
    user = F.col("user_id")
    return e.select(
        F.format_string("%012d", F.col("event_id")).alias("_id"),
        F.concat_ws("-", user.cast("string"), kind).alias("numero_dpe"),
        F.col("ts").cast("date").alias("date_etablissement_dpe"),
        F.col("ts").cast("date").alias("date_reception_dpe"),
        F.lit(None).cast("date").alias("date_fin_validite_dpe"),
        F.char(65 + k % 9).alias("etiquette_dpe"),
        F.lower(F.char(65 + k % 8)).alias("etiquette_ges"),
        F.col("value").alias("conso_5_usages_par_m2_ep"),
        (k - 3).cast("double").alias("emission_ges_5_usages_par_m2"),
        F.when(k % 10 != 7, k.cast("double")).alias("surface_habitable_logement"),
        types.alias("type_batiment"),
        F.lit(None).cast("string").alias("periode_construction"),
        F.when(user % 22 < 21, F.format_string("751%02d", (user % 22 + 1).cast("int"))).alias("code_insee_ban"),
        F.format_string("750%02d", (user % 20 + 1).cast("int")).alias("code_postal_ban"),
        F.lit("75").alias("code_departement_ban"),
        F.concat_ws(",", (k - 5).cast("string"), (k * 3).cast("string")).alias("_geopoint"),
    )


#: The same as DuckDB SQL: common table expressions for the oracles.
SALES_SQL = """
raw AS (SELECT CAST(l_orderkey AS VARCHAR) AS id_mutation, CAST(o_orderdate AS DATE) AS date_mutation,
    CASE WHEN o_orderstatus = 'P' THEN 'Échange' ELSE 'Vente' END AS nature_mutation, o_totalprice AS valeur_fonciere,
    CASE WHEN c_nationkey < 20 THEN '751' || lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0') ELSE '92050' END AS code_commune,
    CAST(l_partkey AS VARCHAR) AS id_parcelle,
    CASE split_part(p_type, ' ', 1) WHEN 'ECONOMY' THEN 'Appartement' WHEN 'STANDARD' THEN 'Maison' WHEN 'SMALL' THEN 'Dépendance'
      WHEN 'LARGE' THEN 'Local industriel. commercial ou assimilé' END AS type_local,
    CAST(l_quantity AS DOUBLE) AS surface_reelle_bati, CAST(l_linenumber AS DOUBLE) AS nombre_pieces_principales,
    (l_suppkey % 25) / 4.0 AS longitude, (l_suppkey % 20) / 4.0 + 44 AS latitude, CAST(year(o_orderdate) AS INTEGER) AS source_year
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN part ON l_partkey = p_partkey),
dd AS (SELECT DISTINCT * FROM raw),
sales AS (SELECT *, CASE WHEN code_commune LIKE '751%' THEN CAST(substr(code_commune, 4, 2) AS INTEGER) END AS arrondissement,
    coalesce(type_local IN ('Appartement', 'Maison'), false) AS res FROM dd WHERE nature_mutation = 'Vente'),
mut0 AS (SELECT source_year, id_mutation, CAST(count(*) FILTER (WHERE res) AS INTEGER) AS residential_unit_count,
    CAST(count(*) FILTER (WHERE type_local = 'Appartement') AS INTEGER) AS apartment_count, CAST(count(*) FILTER (WHERE type_local = 'Maison') AS INTEGER) AS house_count,
    CAST(count(*) FILTER (WHERE type_local = 'Dépendance') AS INTEGER) AS dependency_count,
    CAST(count(*) FILTER (WHERE type_local LIKE 'Local%') AS INTEGER) AS commercial_unit_count, CAST(count(*) AS INTEGER) AS total_component_count,
    CAST(count(DISTINCT id_parcelle) AS INTEGER) AS distinct_parcel_count,
    CASE WHEN count(DISTINCT valeur_fonciere) = 1 THEN min(valeur_fonciere) END AS mutation_value,
    CASE WHEN count(DISTINCT date_mutation) = 1 THEN min(date_mutation) END AS mutation_date,
    count(DISTINCT valeur_fonciere) <= 1 AS value_consistent, count(DISTINCT code_commune) = 1 AS geo_consistent,
    CASE WHEN count(DISTINCT arrondissement) = 1 THEN min(arrondissement) END AS arrondissement,
    max(type_local) FILTER (WHERE res) AS t, max(surface_reelle_bati) FILTER (WHERE res) AS s, max(nombre_pieces_principales) FILTER (WHERE res) AS r,
    max(longitude) FILTER (WHERE res) AS lon, max(latitude) FILTER (WHERE res) AS lat
  FROM sales GROUP BY source_year, id_mutation HAVING count(*) FILTER (WHERE res) >= 1),
mut1 AS (SELECT * EXCLUDE (t, s, r, lon, lat), CASE WHEN residential_unit_count = 1 THEN t END AS residential_property_type,
    CASE WHEN residential_unit_count = 1 THEN s END AS residential_surface, CASE WHEN residential_unit_count = 1 THEN r END AS residential_rooms,
    CASE WHEN residential_unit_count = 1 THEN lon END AS longitude, CASE WHEN residential_unit_count = 1 THEN lat END AS latitude FROM mut0),
mut2 AS (SELECT *, CASE WHEN residential_unit_count <> 1 THEN 'not_single_residential_unit' WHEN NOT value_consistent THEN 'inconsistent_mutation_value'
    WHEN mutation_value IS NULL OR mutation_value <= 0 THEN 'missing_or_nonpositive_value'
    WHEN residential_surface IS NULL OR residential_surface <= 0 THEN 'missing_or_nonpositive_surface'
    WHEN mutation_date IS NULL THEN 'invalid_date' WHEN arrondissement IS NULL THEN 'invalid_arrondissement' END AS price_ineligibility_reason FROM mut1),
mut AS (SELECT *, price_ineligibility_reason IS NULL AS is_price_per_m2_eligible,
    CASE WHEN price_ineligibility_reason IS NULL THEN floor(mutation_value / residential_surface * 100 + 0.5) / 100 END AS price_per_m2_raw FROM mut2)
"""

ENERGY_SQL = """
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
draw0 AS (SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS _id, CAST(user_id AS VARCHAR) || '-' || event_type AS numero_dpe, CAST(ts AS DATE) AS date_etablissement_dpe,
    chr(65 + k % 9) AS etiquette_dpe, lower(chr(65 + k % 8)) AS etiquette_ges, value AS conso, CAST(k - 3 AS DOUBLE) AS emission,
    CASE WHEN k % 10 <> 7 THEN CAST(k AS DOUBLE) END AS surface,
    CASE event_type WHEN 'view' THEN 'appartement' WHEN 'click' THEN 'maison' WHEN 'signup' THEN 'appartement' WHEN 'purchase' THEN 'immeuble' END AS type_norm,
    CASE WHEN user_id % 22 < 20 THEN CAST(user_id % 22 + 1 AS INTEGER) END AS insee, CAST(user_id % 20 + 1 AS INTEGER) AS postal,
    CAST(k - 5 AS VARCHAR) || ',' || CAST(k * 3 AS VARCHAR) AS _geopoint FROM ev),
dnew AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY numero_dpe ORDER BY date_etablissement_dpe DESC NULLS LAST, _id) AS n FROM draw0) z WHERE n = 1),
d1 AS (SELECT *, coalesce(insee, postal) AS arrondissement, CASE WHEN insee IS NOT NULL THEN 'insee' WHEN postal IS NOT NULL THEN 'postal' END AS arrondissement_source,
    NOT coalesce(insee <> postal, false) AS is_geography_consistent, CASE WHEN etiquette_dpe BETWEEN 'A' AND 'G' THEN etiquette_dpe END AS etiquette_dpe_norm,
    CASE WHEN upper(etiquette_ges) BETWEEN 'A' AND 'G' THEN upper(etiquette_ges) END AS etiquette_ges_norm, CAST(year(date_etablissement_dpe) AS INTEGER) AS diagnostic_year,
    CASE WHEN type_norm IN ('appartement', 'maison') THEN 'dwelling_unit' WHEN type_norm = 'immeuble' THEN 'whole_building' ELSE 'unknown' END AS analysis_population FROM dnew),
d2 AS (SELECT *, CASE WHEN arrondissement IS NULL THEN 'invalid_arrondissement' WHEN etiquette_dpe_norm IS NULL THEN 'invalid_dpe_label'
    WHEN analysis_population <> 'dwelling_unit' THEN 'not_dwelling_unit' END AS label_exclusion_reason FROM d1),
diag AS (SELECT *, label_exclusion_reason IS NULL AS is_label_analysis_eligible,
    coalesce(label_exclusion_reason, CASE WHEN surface IS NULL OR surface <= 0 THEN 'invalid_surface' WHEN conso IS NULL OR conso < 0 THEN 'invalid_consumption'
      WHEN emission IS NULL OR emission < 0 THEN 'invalid_emission' END) AS intensity_exclusion_reason FROM d2)
"""
