"""All queries of the library's core by name, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from arpent.functions import text
from arpent.functions.columns import cleaned_id, district, geopoint, rounded
from arpent.functions.html_elements import page_elements
from arpent.operators import analytics, chunking, conversation, energy, loading, market, projection, quality, reports, vectors
from arpent.plans import answers, corpus, runs, tools
from arpent.sources import files
from arpent.sources.adapters import ENERGY_POLICY, ENERGY_SQL, SALES_POLICY, SALES_SQL, raw_diagnostics, raw_sales, table

QUERIES: dict = {}
ORACLE: dict = {}

Y0, Y1 = SALES_POLICY.first_year, SALES_POLICY.last_year
E0, E1 = ENERGY_POLICY.first_year, ENERGY_POLICY.last_year


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def sales(spark, sf_dir):
    return market.curated(raw_sales(spark, sf_dir))


def diagnostics(spark, sf_dir):
    return energy.curated(raw_diagnostics(spark, sf_dir), ENERGY_POLICY)


def r2(x: str) -> str:
    return f"(sign({x}) * floor(abs({x}) * 100 + 0.5) / 100)"


def pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN floor({part} * 1.0 / {whole} * 100 * 100 + 0.5) / 100 ELSE 0.0 END"


M = "is_price_per_m2_eligible AND price_per_m2_raw BETWEEN 1000 AND 50000"


def price(q: float) -> str:
    return f"quantile_cont(price_per_m2_raw, {q}) FILTER (WHERE {M})"


def overview_sql(where: str) -> str:
    return f"""SELECT *, eligible_count - market_count AS excluded_count, {r2("median - raw_median")} AS sensitivity, false AS includes_partial_year,
  CASE WHEN total_count = 0 THEN 'no sales in this scope' WHEN market_count = 0 AND eligible_count > 0 THEN 'all eligible prices lie outside the band' ELSE '' END AS warnings
FROM (SELECT count(*) AS total_count, count(*) FILTER (WHERE is_price_per_m2_eligible) AS eligible_count, count(*) FILTER (WHERE {M}) AS market_count,
  {r2("quantile_cont(price_per_m2_raw, 0.5) FILTER (WHERE is_price_per_m2_eligible)")} AS raw_median,
  {r2(price(0.5))} AS median, {r2(price(0.25))} AS p25, {r2(price(0.75))} AS p75, {r2("quantile_cont(residential_surface, 0.5)")} AS median_surface
  FROM mut WHERE source_year BETWEEN {Y0} AND {Y1}{where}) z"""


# --- the market -----------------------------------------------------------------------------------------------------


@query(f"WITH {SALES_SQL} {overview_sql('')}")
def market_overview(spark, sf_dir):
    return analytics.market_overview(sales(spark, sf_dir), policy=SALES_POLICY)


@query(f"WITH {SALES_SQL} {overview_sql(' AND arrondissement = 15')}")
def market_overview_area(spark, sf_dir):
    return analytics.market_overview(sales(spark, sf_dir), area=15, policy=SALES_POLICY)


@query(f"""WITH {SALES_SQL}, y AS (SELECT source_year, count(*) AS n, count(*) FILTER (WHERE {M}) AS m, {price(0.5)} AS p50, {price(0.25)} AS q1, {price(0.75)} AS q3
  FROM mut WHERE source_year BETWEEN {Y0} AND {Y1} GROUP BY source_year),
s AS (SELECT CAST(r.range AS INTEGER) AS source_year, n, m, p50, q1, q3 FROM range({Y0}, {Y1 + 1}) r LEFT JOIN y ON y.source_year = r.range),
l AS (SELECT *, lag(p50) OVER (ORDER BY source_year) AS b FROM s)
SELECT source_year, coalesce(n, 0) AS transaction_count, coalesce(m, 0) AS market_count, {r2("p50")} AS median, {r2("q1")} AS p25, {r2("q3")} AS p75,
  CASE WHEN b <> 0 THEN {r2(f"(({r2('p50')} - b) / b * 100)")} END AS yoy_change_pct FROM l""")
def price_trend(spark, sf_dir):
    return analytics.price_trend(sales(spark, sf_dir), policy=SALES_POLICY)


BY_AREA = f"""SELECT arrondissement, count(*) AS n, count(*) FILTER (WHERE {M}) AS m, {price(0.5)} AS p50, {price(0.25)} AS q1, {price(0.75)} AS q3,
  quantile_cont(residential_surface, 0.5) AS surface FROM mut WHERE source_year BETWEEN {Y0} AND {Y1} AND arrondissement IS NOT NULL GROUP BY arrondissement"""


@query(f"""WITH {SALES_SQL}, a AS ({BY_AREA}), asked AS (SELECT * FROM (VALUES (0, 13), (1, 20), (2, 5)) t(position, arrondissement))
SELECT position, asked.arrondissement, coalesce(n, 0) AS transaction_count, coalesce(m, 0) AS market_count, {r2("p50")} AS median, {r2("q1")} AS p25, {r2("q3")} AS p75,
  {r2("surface")} AS median_surface FROM asked LEFT JOIN a ON a.arrondissement = asked.arrondissement""")
def compare_areas(spark, sf_dir):
    return analytics.compare_areas(sales(spark, sf_dir), [13, 20, 13, 5], policy=SALES_POLICY)


def _rank_sql(metric: str) -> str:
    return f"""WITH {SALES_SQL}, a AS ({BY_AREA}), k AS (SELECT arrondissement, {r2("p50")} AS median, {r2("surface")} AS median_surface, m AS sample_size FROM a WHERE m >= 30)
SELECT *, CAST(row_number() OVER (ORDER BY {metric} DESC, arrondissement) AS INTEGER) AS rank FROM k WHERE {metric} IS NOT NULL"""


@query(_rank_sql("median"))
def rank_by_price(spark, sf_dir):
    return analytics.ranking(sales(spark, sf_dir), "median", policy=SALES_POLICY)


@query(_rank_sql("sample_size"))
def rank_by_volume(spark, sf_dir):
    return analytics.ranking(sales(spark, sf_dir), "sample_size", policy=SALES_POLICY)


@query(_rank_sql("median_surface"))
def rank_by_surface(spark, sf_dir):
    return analytics.ranking(sales(spark, sf_dir), "median_surface", policy=SALES_POLICY)


#: So many sales that some districts have fewer in one year, at every size of the test tables.
ONE_YEAR = f"""SELECT arrondissement, count(*) FILTER (WHERE {M}) AS m FROM mut WHERE source_year = {Y1} AND arrondissement IS NOT NULL GROUP BY 1"""


@query(f"WITH {SALES_SQL}, a AS ({BY_AREA}) SELECT arrondissement, m AS sample_size FROM a WHERE m < 30")
def small_samples(spark, sf_dir):
    return analytics.small_samples(sales(spark, sf_dir), policy=SALES_POLICY)


@query(f"WITH {SALES_SQL}, a AS ({ONE_YEAR}) SELECT arrondissement, m AS sample_size FROM a WHERE m < 30")
def small_samples_of_a_year(spark, sf_dir):
    return analytics.small_samples(sales(spark, sf_dir), Y1, Y1, SALES_POLICY)


@query(f"""WITH {SALES_SQL}, a AS ({ONE_YEAR}) SELECT CASE WHEN count(*) > 0 THEN 'districts with fewer than 30 sales are not ranked: ' || string_agg(CAST(arrondissement AS VARCHAR), ', ' ORDER BY arrondissement) ELSE '' END AS warnings,
  15 AS arrondissement, {Y1} AS start_year, {Y1} AS end_year, 1000.0::DOUBLE AS price_per_m2_min, 50000.0::DOUBLE AS price_per_m2_max, false AS includes_partial_year FROM a WHERE m < 30""")
def answer_scope(spark, sf_dir):
    """What stands beside an answer: the warning of its rankings and the filters that were applied."""
    warned = analytics.small_sample_warning(sales(spark, sf_dir), Y1, Y1, SALES_POLICY)
    return warned.select("warnings", analytics.applied_filters(Y1, Y1, 15, SALES_POLICY).alias("f")).select("warnings", "f.*")


# --- diagnostics ----------------------------------------------------------------------------------------------------


def _labels_cte(where: str = "") -> str:
    return f"""lab AS (SELECT l.label, count(d.etiquette_dpe_norm) AS n FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E'), ('F'), ('G')) l(label)
  LEFT JOIN (SELECT * FROM diag WHERE is_label_analysis_eligible AND analysis_population = 'dwelling_unit' AND diagnostic_year BETWEEN {E0} AND {E1}{where}) d ON d.etiquette_dpe_norm = l.label GROUP BY l.label)"""


LABELS = _labels_cte()


@query(f"WITH {ENERGY_SQL}, {LABELS}, t AS (SELECT sum(n) AS total FROM lab) SELECT label, n, {pct('n', 'total')} AS pct FROM lab, t")
def label_distribution(spark, sf_dir):
    return analytics.label_distribution(diagnostics(spark, sf_dir), policy=ENERGY_POLICY)


POOR_SQL = f"""SELECT *, f_count + g_count AS fg_count, {pct("(f_count + g_count)", "total")} AS fg_pct, CASE WHEN total = 0 THEN 'no labels in this scope' ELSE '' END AS warnings
FROM (SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) FILTER (WHERE label = 'F') AS BIGINT) AS f_count, CAST(sum(n) FILTER (WHERE label = 'G') AS BIGINT) AS g_count FROM lab) t"""


@query(f"WITH {ENERGY_SQL}, {LABELS} {POOR_SQL}")
def poor_label_share(spark, sf_dir):
    return analytics.poor_labels(diagnostics(spark, sf_dir), policy=ENERGY_POLICY)


def _intensity_sql(where: str = "") -> str:
    q = lambda c, x: r2(f"quantile_cont({c}, {x})")
    return f"""SELECT count(*) AS n, {q("conso", 0.5)} AS consumption_median, {q("conso", 0.25)} AS consumption_p25, {q("conso", 0.75)} AS consumption_p75,
  {q("emission", 0.5)} AS emission_median, {q("emission", 0.25)} AS emission_p25, {q("emission", 0.75)} AS emission_p75, {q("surface", 0.5)} AS median_surface,
  CASE WHEN count(*) = 0 THEN 'no intensities in this scope' ELSE '' END AS warnings
FROM diag WHERE intensity_exclusion_reason IS NULL AND analysis_population = 'dwelling_unit' AND diagnostic_year BETWEEN {E0} AND {E1}{where}"""


@query(f"WITH {ENERGY_SQL} {_intensity_sql()}")
def intensity_summary(spark, sf_dir):
    return analytics.intensity_summary(diagnostics(spark, sf_dir), policy=ENERGY_POLICY)


def _prefixed(sql: str, view: str, names: str) -> str:
    return f"{view} AS (SELECT " + ", ".join(f"{n} AS {view}_{n}" for n in names.split()) + f" FROM ({sql}) x)"


OVERVIEW = "total_count eligible_count market_count raw_median median p25 p75 median_surface excluded_count sensitivity includes_partial_year warnings"
INTENSITY = "n consumption_median consumption_p25 consumption_p75 emission_median emission_p25 emission_p75 median_surface warnings"


@query(f"""WITH {SALES_SQL}, {ENERGY_SQL}, {_labels_cte(" AND arrondissement = 15")},
{_prefixed(overview_sql(" AND arrondissement = 15"), "market", OVERVIEW)}, {_prefixed(POOR_SQL, "labels", "total f_count g_count fg_count fg_pct warnings")},
{_prefixed(_intensity_sql(" AND arrondissement = 15"), "intensity", INTENSITY)}
SELECT CAST(15 AS INTEGER) AS arrondissement, * FROM market, labels, intensity""")
def area_profile(spark, sf_dir):
    """The test tables' facts cover different years; each is asked for those of its own policy."""
    return analytics.area_profile(sales(spark, sf_dir), diagnostics(spark, sf_dir), 15, policy=SALES_POLICY, energy_policy=ENERGY_POLICY)


# --- curating sales -------------------------------------------------------------------------------------------------


@query(f"WITH {SALES_SQL} SELECT id_mutation, source_year, type_local, surface_reelle_bati, arrondissement, count(*) AS n FROM sales WHERE res GROUP BY ALL")
def components(spark, sf_dir):
    found = market.components(market.without_duplicates(raw_sales(spark, sf_dir)))
    return found.groupBy("id_mutation", "source_year", "type_local", "surface_reelle_bati", "arrondissement").agg(F.count("*").alias("n"))


MUTATION = (
    "source_year, id_mutation, residential_unit_count, apartment_count, house_count, dependency_count, commercial_unit_count, total_component_count, "
    "distinct_parcel_count, mutation_value, mutation_date, value_consistent, geo_consistent, arrondissement, residential_property_type, residential_surface, residential_rooms, longitude, latitude"
)


@query(f"WITH {SALES_SQL} SELECT {MUTATION} FROM mut")
def mutations(spark, sf_dir):
    return sales(spark, sf_dir).select(*MUTATION.replace(" ", "").split(","))


@query(f"WITH {SALES_SQL} SELECT source_year, id_mutation, is_price_per_m2_eligible, price_ineligibility_reason, price_per_m2_raw FROM mut")
def price_eligibility(spark, sf_dir):
    return sales(spark, sf_dir).select("source_year", "id_mutation", "is_price_per_m2_eligible", "price_ineligibility_reason", "price_per_m2_raw")


@query(f"WITH {SALES_SQL} SELECT price_ineligibility_reason AS value, count(*) AS n FROM mut GROUP BY 1")
def ineligibility_counts(spark, sf_dir):
    return quality.value_counts(sales(spark, sf_dir), "price_ineligibility_reason")


@query("SELECT count(*) - count(DISTINCT (lang, source, text)) AS exact_duplicates, count(*) AS n FROM documents")
def exact_duplicates(spark, sf_dir):
    return quality.exact_duplicates(table(spark, sf_dir, "documents"), "lang", "source", "text")


@query(f"WITH {ENERGY_SQL} SELECT numero_dpe, _id, date_etablissement_dpe FROM dnew")
def dedup_newest(spark, sf_dir):
    return energy.newest(raw_diagnostics(spark, sf_dir)).select("numero_dpe", "_id", "date_etablissement_dpe")


@query(f"""WITH {ENERGY_SQL} SELECT count(*) AS rows_before, count(*) - count(DISTINCT _id) AS exact_duplicates, count(*) FILTER (WHERE numero_dpe IS NULL) AS missing_key,
  (SELECT count(*) FROM (SELECT numero_dpe FROM draw0 GROUP BY 1 HAVING count(*) > 1) z) AS conflicting, count(DISTINCT numero_dpe) AS unique_keys, count(DISTINCT numero_dpe) AS rows_after FROM draw0""")
def conflicting_keys(spark, sf_dir):
    return energy.duplicate_counts(raw_diagnostics(spark, sf_dir))


@query(f"WITH {ENERGY_SQL} SELECT arrondissement, arrondissement_source, count(*) AS n FROM d1 GROUP BY ALL")
def district_primary_fallback(spark, sf_dir):
    return diagnostics(spark, sf_dir).groupBy("arrondissement", "arrondissement_source").agg(F.count("*").alias("n"))


@query(f"WITH {ENERGY_SQL} SELECT is_geography_consistent, count(*) AS n FROM d1 GROUP BY 1")
def geo_consistency(spark, sf_dir):
    return diagnostics(spark, sf_dir).groupBy("is_geography_consistent").agg(F.count("*").alias("n"))


@query(f"WITH {ENERGY_SQL} SELECT etiquette_dpe, etiquette_dpe_norm, etiquette_ges, etiquette_ges_norm, count(*) AS n FROM d1 GROUP BY ALL")
def label_normalise(spark, sf_dir):
    return diagnostics(spark, sf_dir).groupBy("etiquette_dpe", "etiquette_dpe_norm", "etiquette_ges", "etiquette_ges_norm").agg(F.count("*").alias("n"))


@query(f"WITH {ENERGY_SQL} SELECT type_norm AS type_batiment_norm, analysis_population, count(*) AS n FROM d1 GROUP BY ALL")
def population_map(spark, sf_dir):
    return diagnostics(spark, sf_dir).groupBy("type_batiment_norm", "analysis_population").agg(F.count("*").alias("n"))


@query(f"""WITH {ENERGY_SQL} SELECT numero_dpe, diagnostic_year, arrondissement IS NOT NULL AS is_valid_arrondissement, etiquette_dpe_norm IS NOT NULL AS is_valid_dpe_label,
  etiquette_ges_norm IS NOT NULL AS is_valid_ges_label, coalesce(surface > 0, false) AS is_valid_surface, coalesce(conso >= 0, false) AS is_valid_consumption,
  coalesce(emission >= 0, false) AS is_valid_emission, coalesce(diagnostic_year BETWEEN 2021 AND 2025, false) AS is_complete_analysis_year,
  coalesce(diagnostic_year = 2026, false) AS is_partial_year FROM d1""")
def quality_flags(spark, sf_dir):
    return diagnostics(spark, sf_dir).select(
        "numero_dpe", "diagnostic_year", "is_valid_arrondissement", "is_valid_dpe_label", "is_valid_ges_label", "is_valid_surface", "is_valid_consumption", "is_valid_emission",
        "is_complete_analysis_year", "is_partial_year",
    )


@query(f"WITH {ENERGY_SQL} SELECT label_exclusion_reason, intensity_exclusion_reason, count(*) AS n FROM diag GROUP BY ALL")
def exclusion_reasons(spark, sf_dir):
    return diagnostics(spark, sf_dir).groupBy("label_exclusion_reason", "intensity_exclusion_reason").agg(F.count("*").alias("n"))


# --- quality --------------------------------------------------------------------------------------------------------

YEAR_SQL = f"""WITH {SALES_SQL},
ra AS (SELECT source_year, count(*) AS raw_rows FROM raw GROUP BY ROLLUP (source_year)),
ym AS (SELECT source_year, id_mutation, count(*) AS n, count(*) FILTER (WHERE nature_mutation = 'Vente' AND code_commune NOT LIKE '751%') AS bad, count(*) FILTER (WHERE nature_mutation <> 'Vente') AS other FROM dd GROUP BY ALL),
cl AS (SELECT source_year, CAST(sum(n) AS BIGINT) AS deduplicated_rows, count(id_mutation) AS unique_mutations, CAST(sum(bad) AS BIGINT) AS invalid_paris_codes, CAST(sum(other) AS BIGINT) AS excluded_nature_rows FROM ym GROUP BY ROLLUP (source_year)),
un AS (SELECT source_year, count(*) AS residential_units, count(*) FILTER (WHERE NOT coalesce(surface_reelle_bati > 0, false)) AS invalid_or_missing_surfaces, count(*) FILTER (WHERE longitude IS NOT NULL AND latitude IS NOT NULL) AS located FROM sales WHERE res GROUP BY ROLLUP (source_year)),
so AS (SELECT source_year, count(*) AS residential_mutations, count(*) FILTER (WHERE residential_unit_count = 1) AS single_unit_mutations, count(*) FILTER (WHERE residential_unit_count > 1) AS multi_unit_mutations,
  CAST(sum(apartment_count) AS BIGINT) AS apartment_count, CAST(sum(house_count) AS BIGINT) AS house_count, count(*) FILTER (WHERE NOT value_consistent) AS inconsistent_mutation_values,
  count(*) FILTER (WHERE NOT geo_consistent) AS ambiguous_geography, count(*) FILTER (WHERE is_price_per_m2_eligible) AS price_eligible_count FROM mut GROUP BY ROLLUP (source_year))"""


@query(f"""{YEAR_SQL} SELECT ra.source_year, raw_rows, deduplicated_rows, raw_rows - deduplicated_rows AS exact_duplicates, unique_mutations, invalid_paris_codes, excluded_nature_rows, residential_units,
  invalid_or_missing_surfaces, residential_mutations, single_unit_mutations, multi_unit_mutations, apartment_count, house_count, inconsistent_mutation_values, ambiguous_geography, price_eligible_count,
  {pct("price_eligible_count", "residential_mutations")} AS price_eligibility_rate_pct, {pct("located", "residential_units")} AS coordinate_coverage_pct
FROM ra JOIN cl ON ra.source_year IS NOT DISTINCT FROM cl.source_year JOIN un ON ra.source_year IS NOT DISTINCT FROM un.source_year JOIN so ON ra.source_year IS NOT DISTINCT FROM so.source_year""")
def year_metrics(spark, sf_dir):
    return quality.year_metrics(raw_sales(spark, sf_dir))


def _quantile_sql(column: str, source: str, at: dict[str, float]) -> str:
    return f"SELECT count({column}) AS count, {r2(f'min({column})')} AS min, {r2(f'max({column})')} AS max, " + ", ".join(f"{r2(f'quantile_cont({column}, {q})')} AS {n}" for n, q in at.items()) + f" FROM {source}"


@query(f"WITH {SALES_SQL} {_quantile_sql('price_per_m2_raw', 'mut WHERE is_price_per_m2_eligible', quality.PRICE_QUANTILES)}")
def price_distribution(spark, sf_dir):
    return quality.price_distribution(sales(spark, sf_dir))


@query(f"WITH {ENERGY_SQL} {_quantile_sql('conso', 'diag', quality.SUMMARY_QUANTILES)}")
def quantile_summary(spark, sf_dir):
    return quality.quantiles(diagnostics(spark, sf_dir), "conso_5_usages_par_m2_ep", quality.SUMMARY_QUANTILES)


@query(f"""{YEAR_SQL}, p AS ({_quantile_sql('price_per_m2_raw', 'mut WHERE is_price_per_m2_eligible', quality.PRICE_QUANTILES)})
SELECT raw_rows, deduplicated_rows, raw_rows - deduplicated_rows AS exact_duplicates, unique_mutations, invalid_paris_codes, excluded_nature_rows, residential_units,
  invalid_or_missing_surfaces, residential_mutations, single_unit_mutations, multi_unit_mutations, apartment_count, house_count, inconsistent_mutation_values, ambiguous_geography, price_eligible_count,
  {pct("price_eligible_count", "residential_mutations")} AS price_eligibility_rate_pct, {pct("located", "residential_units")} AS coordinate_coverage_pct,
  {", ".join(f"p.{c} AS price_{c}" for c in ("count", "min", "max", *quality.PRICE_QUANTILES))}
FROM ra, cl, un, so, p WHERE ra.source_year IS NULL AND cl.source_year IS NULL AND un.source_year IS NULL AND so.source_year IS NULL""")
def global_metrics_rollup(spark, sf_dir):
    return quality.global_metrics(raw_sales(spark, sf_dir), sales(spark, sf_dir))


RAW_DIAGNOSTICS = f"""{ENERGY_SQL}, d AS (SELECT draw0.*, CASE WHEN user_id % 22 < 21 THEN '751' || lpad(CAST(user_id % 22 + 1 AS VARCHAR), 2, '0') END AS code, '750' || lpad(CAST(user_id % 20 + 1 AS VARCHAR), 2, '0') AS pcode
  FROM draw0 JOIN ev ON draw0._id = lpad(CAST(event_id AS VARCHAR), 12, '0'))"""


def _described_sql(section: str, column: str, source: str) -> str:
    each = {"count": f"count({column})", "mean": r2(f"avg({column})"), "std": r2(f"stddev_samp({column})"), "min": f"min({column})", "max": f"max({column})"} | {f"p{q}": r2(f"quantile_cont({column}, {q / 100})") for q in (25, 50, 75)}
    return f"SELECT '{section}' AS section, unnest({list(each)}) AS key, unnest([{', '.join(f'CAST({v} AS DOUBLE)' for v in each.values())}]) AS value FROM {source}"


def _diagnostic_profile_sql() -> str:
    full = ("_id", "numero_dpe", "date_etablissement_dpe", "date_reception_dpe", "etiquette_dpe", "etiquette_ges", "conso_5_usages_par_m2_ep", "emission_ges_5_usages_par_m2", "type_batiment", "code_postal_ban", "code_departement_ban", "_geopoint")
    missing = {c: "0.0" for c in full} | {c: "100.0" for c in ("date_fin_validite_dpe", "periode_construction")} | {n: pct(f"count(*) FILTER (WHERE {c} IS NULL)", "count(*)") for n, c in (("code_insee_ban", "code"), ("surface_habitable_logement", "surface"))}
    parts = [f"SELECT 'missing_pct' AS section, unnest({list(missing)}) AS key, unnest([{', '.join(f'CAST({v} AS DOUBLE)' for v in missing.values())}]) AS value FROM d"]
    parts.append("SELECT 'repeated_keys', NULL, CAST(count(*) - count(DISTINCT numero_dpe) AS DOUBLE) FROM d")
    parts += [f"SELECT '{n}', {c}, CAST(count(*) AS DOUBLE) FROM d GROUP BY {c}" for n, c in (("etiquette_dpe", "etiquette_dpe"), ("etiquette_ges", "etiquette_ges"), ("code_insee_ban", "code"), ("code_postal_ban", "pcode"))]
    parts.append("SELECT 'invalid_code_insee_ban', code, CAST(count(*) AS DOUBLE) FROM d WHERE NOT coalesce(CAST(substr(code, 4) AS INTEGER) BETWEEN 1 AND 20, false) GROUP BY code")
    parts += [_described_sql(n, c, "d") for n, c in (("surface_habitable_logement", "surface"), ("conso_5_usages_par_m2_ep", "conso"), ("emission_ges_5_usages_par_m2", "emission"))]
    return " UNION ALL ".join(parts)


@query(f"WITH {RAW_DIAGNOSTICS} {_diagnostic_profile_sql()}")
def diagnostic_profile(spark, sf_dir):
    return quality.sample_profile(raw_diagnostics(spark, sf_dir))


def _raw_profile_sql() -> str:
    full = ("id_mutation", "date_mutation", "nature_mutation", "valeur_fonciere", "code_commune", "code_departement", "id_parcelle", "surface_reelle_bati", "nombre_pieces_principales", "longitude", "latitude", "source_year", "source_file", "source_sha256")
    missing = {c: "0.0" for c in full} | {"type_local": pct("count(*) FILTER (WHERE type_local IS NULL)", "count(*)")}
    parts = [f"SELECT 'missing_pct' AS section, unnest({list(missing)}) AS key, unnest([{', '.join(f'CAST({v} AS DOUBLE)' for v in missing.values())}]) AS value FROM raw"]
    parts.append("SELECT 'duplicates', unnest(['exact_duplicates', 'n']), unnest([CAST(count(*) - (SELECT count(*) FROM dd) AS DOUBLE), CAST(count(*) AS DOUBLE)]) FROM raw")
    parts += [f"SELECT '{c}', {c}, CAST(count(*) AS DOUBLE) FROM raw GROUP BY {c}" for c in ("nature_mutation", "type_local", "code_commune")]
    keys = {"n_keys": "count(*)", "mean_rows": r2("avg(n)"), "max_rows": "max(n)", "multi_row_pct": pct("count(*) FILTER (WHERE n > 1)", "count(*)"), "n_mixed_value": "count(*) FILTER (WHERE a)", "n_mixed_kind": "count(*) FILTER (WHERE b)"}
    of = "(SELECT count(*) AS n, min(valeur_fonciere) < max(valeur_fonciere) AS a, min(type_local) < max(type_local) AS b FROM raw GROUP BY id_mutation) k"
    parts.append(f"SELECT 'rows_per_mutation', unnest({list(keys)}), unnest([{', '.join(f'CAST({v} AS DOUBLE)' for v in keys.values())}]) FROM {of}")
    parts += [_described_sql(c, c, "raw") for c in ("valeur_fonciere", "surface_reelle_bati", "nombre_pieces_principales")]
    return f"SELECT 'sales' AS \"table\", * FROM ({' UNION ALL '.join(parts)}) s UNION ALL SELECT 'diagnostics', * FROM ({_diagnostic_profile_sql()}) p"


@query(f"WITH {SALES_SQL}, {RAW_DIAGNOSTICS} {_raw_profile_sql()}")
def raw_profile(spark, sf_dir):
    """Both raw tables in one profile."""
    return quality.raw_profile(raw_sales(spark, sf_dir), raw_diagnostics(spark, sf_dir))


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark, sf_dir):
    return quality.value_counts(table(spark, sf_dir, "events"), "event_type")


@query("SELECT CAST(l_partkey AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, value LIMIT 30")
def top_value_counts(spark, sf_dir):
    return quality.top_values(table(spark, sf_dir, "lineitem"), "l_partkey")


@query(f"WITH {SALES_SQL} SELECT v.value, count(dd.nature_mutation) AS n FROM (VALUES {', '.join('(' + repr(n).replace(chr(34), chr(39)).replace(chr(39) + 'Vente en l' + chr(39) + 'état futur d' + chr(39) + 'achèvement' + chr(39), chr(39) + 'Vente en l' + chr(39) * 2 + 'état futur d' + chr(39) * 2 + 'achèvement' + chr(39)) + ')' for n in quality.EXCLUDED_NATURES)}) v(value) LEFT JOIN dd ON dd.nature_mutation = v.value GROUP BY 1")
def excluded_natures(spark, sf_dir):
    return quality.counts_of(market.without_duplicates(raw_sales(spark, sf_dir)), "nature_mutation", quality.EXCLUDED_NATURES)


@query(f"""WITH {SALES_SQL} SELECT 'type_local' AS "column", count(*) FILTER (WHERE type_local IS NULL) AS n_missing, {pct("count(*) FILTER (WHERE type_local IS NULL)", "count(*)")} AS pct_missing FROM dd
UNION ALL SELECT 'surface_reelle_bati', count(*) FILTER (WHERE surface_reelle_bati IS NULL), {pct("count(*) FILTER (WHERE surface_reelle_bati IS NULL)", "count(*)")} FROM dd""")
def missing_counts(spark, sf_dir):
    return quality.missing(market.without_duplicates(raw_sales(spark, sf_dir)), "type_local", "surface_reelle_bati")


@query(f"""WITH {ENERGY_SQL} SELECT 'surface_habitable_logement' AS "column", count(*) FILTER (WHERE surface IS NULL) AS n_missing, {pct("count(*) FILTER (WHERE surface IS NULL)", "count(*)")} AS pct_missing FROM diag
UNION ALL SELECT 'arrondissement', count(*) FILTER (WHERE arrondissement IS NULL), {pct("count(*) FILTER (WHERE arrondissement IS NULL)", "count(*)")} FROM diag""")
def null_rates(spark, sf_dir):
    return quality.missing(diagnostics(spark, sf_dir), "surface_habitable_logement", "arrondissement")


@query(f"WITH {SALES_SQL} SELECT count(*) AS n, count(*) FILTER (WHERE longitude IS NOT NULL AND latitude IS NOT NULL) AS n_covered, {pct('count(*) FILTER (WHERE longitude IS NOT NULL AND latitude IS NOT NULL)', 'count(*)')} AS coverage_pct FROM mut")
def coverage(spark, sf_dir):
    return quality.coverage(sales(spark, sf_dir), "longitude", "latitude")


@query(f"""SELECT count(*) AS count, {r2("avg(l_extendedprice)")} AS mean, {r2("stddev_samp(l_extendedprice)")} AS std, min(l_extendedprice) AS min, {r2("quantile_cont(l_extendedprice, 0.25)")} AS p25,
  {r2("quantile_cont(l_extendedprice, 0.5)")} AS p50, {r2("quantile_cont(l_extendedprice, 0.75)")} AS p75, max(l_extendedprice) AS max FROM lineitem""")
def describe_numeric(spark, sf_dir):
    return quality.describe(table(spark, sf_dir, "lineitem"), "l_extendedprice")


@query(f"""WITH {SALES_SQL}, k AS (SELECT id_mutation, count(*) AS n, min(valeur_fonciere) < max(valeur_fonciere) AS a, min(type_local) < max(type_local) AS b FROM raw GROUP BY 1)
SELECT count(*) AS n_keys, {r2("avg(n)")} AS mean_rows, max(n) AS max_rows, {pct("count(*) FILTER (WHERE n > 1)", "count(*)")} AS multi_row_pct, count(*) FILTER (WHERE a) AS n_mixed_value, count(*) FILTER (WHERE b) AS n_mixed_kind FROM k""")
def rows_per_key(spark, sf_dir):
    return quality.rows_per_key(raw_sales(spark, sf_dir), "id_mutation", "valeur_fonciere", "type_local")


@query("SELECT count(*) AS n_orphans FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey IS NULL AND l_orderkey IS NOT NULL")
def orphan_fk(spark, sf_dir):
    return loading.orphans(table(spark, sf_dir, "lineitem"), "l_orderkey", table(spark, sf_dir, "orders"), "o_orderkey").agg(F.count("*").alias("n_orphans"))


@query("SELECT count(*) AS n, count(*) - count(DISTINCT o_orderkey) AS n_repeated FROM orders")
def pk_uniqueness(spark, sf_dir):
    return loading.repeated_keys(table(spark, sf_dir, "orders"), "o_orderkey")


@query(f"WITH {SALES_SQL} SELECT count(*) FILTER (WHERE nature_mutation = 'Vente' AND code_commune NOT LIKE '751%') AS n_invalid FROM dd")
def invalid_codes(spark, sf_dir):
    return quality.invalid_codes(market.without_duplicates(raw_sales(spark, sf_dir)))


@query(f"WITH {SALES_SQL} SELECT CAST(count(DISTINCT arrondissement) AS INTEGER) AS n_covered, (SELECT coalesce(string_agg(CAST(d AS VARCHAR), ',' ORDER BY d), '') FROM range(1, 21) t(d) WHERE d NOT IN (SELECT arrondissement FROM mut WHERE arrondissement IS NOT NULL)) AS missing FROM mut")
def district_coverage(spark, sf_dir):
    return quality.district_coverage(sales(spark, sf_dir))


@query(f"""WITH {ENERGY_SQL} SELECT count(*) AS processed_rows, count(*) FILTER (WHERE is_label_analysis_eligible) AS label_eligible_rows, count(*) FILTER (WHERE intensity_exclusion_reason IS NULL) AS intensity_eligible_rows,
  count(*) FILTER (WHERE type_norm = 'appartement') AS appartement_count, count(*) FILTER (WHERE type_norm = 'maison') AS maison_count, count(*) FILTER (WHERE type_norm = 'immeuble') AS immeuble_count,
  CAST(min(date_etablissement_dpe) AS VARCHAR) AS date_min, CAST(max(date_etablissement_dpe) AS VARCHAR) AS date_max, count(*) FILTER (WHERE diagnostic_year BETWEEN 2021 AND 2025) AS complete_year_count,
  count(*) FILTER (WHERE diagnostic_year = 2026) AS partial_year_count, count(*) FILTER (WHERE NOT is_geography_consistent) AS geography_inconsistencies, {pct("count(_geopoint)", "count(*)")} AS coordinate_coverage_pct FROM diag""")
def energy_report(spark, sf_dir):
    return quality.energy_report(diagnostics(spark, sf_dir))


MISSING = {"numero_dpe": "numero_dpe", "date_etablissement_dpe": "date_etablissement_dpe", "etiquette_dpe": "etiquette_dpe", "etiquette_ges": "etiquette_ges", "surface_habitable_logement": "surface",
    "conso_5_usages_par_m2_ep": "conso", "emission_ges_5_usages_par_m2": "emission", "code_insee_ban": "code_insee_ban", "_geopoint": "_geopoint"}
COUNTED = {"population": "analysis_population", "year": "diagnostic_year", "district": "arrondissement", "dpe_label": "etiquette_dpe_norm", "ges_label": "etiquette_ges_norm", "building_type": "type_norm",
    "construction_period": "NULL", "label_exclusions": "label_exclusion_reason", "intensity_exclusions": "intensity_exclusion_reason"}
TOTALS = {"processed_rows": "count(*)", "label_analysis_eligible_rows": "count(*) FILTER (WHERE is_label_analysis_eligible)", "intensity_analysis_eligible_rows": "count(*) FILTER (WHERE intensity_exclusion_reason IS NULL)",
    "complete_analysis_year_count": "count(*) FILTER (WHERE diagnostic_year BETWEEN 2021 AND 2025)", "partial_year_count": "count(*) FILTER (WHERE diagnostic_year = 2026)",
    "apartment_count": "count(*) FILTER (WHERE type_norm = 'appartement')", "house_count": "count(*) FILTER (WHERE type_norm = 'maison')", "whole_building_count": "count(*) FILTER (WHERE type_norm = 'immeuble')",
    "geography_inconsistencies": "count(*) FILTER (WHERE NOT is_geography_consistent)", "coordinate_coverage_pct": pct("count(_geopoint)", "count(*)"), "districts_covered": "count(DISTINCT arrondissement)"}
SPREAD = {"min": 0, "max": 1} | quality.SUMMARY_QUANTILES


def _sections_sql() -> str:
    """Every section of the report on diagnostics."""
    one = lambda section, key, value, source="g": f"SELECT '{section}' AS section, '{key}' AS key, CAST({value} AS DOUBLE) AS value, NULL AS text FROM {source}"
    parts = [one("totals", k, v) for k, v in TOTALS.items()]
    gone = "range(1, 21) t(d) WHERE d NOT IN (SELECT arrondissement FROM g WHERE arrondissement IS NOT NULL)"
    parts.append(f"SELECT 'totals', 'districts_missing', CAST(count(*) AS DOUBLE), coalesce(string_agg(CAST(d AS VARCHAR), ',' ORDER BY d), '') FROM {gone}")
    parts += [f"SELECT 'establishment_date', '{k}', NULL, CAST({k}(date_etablissement_dpe) AS VARCHAR) FROM g" for k in ("min", "max")]
    parts += [one("missing_pct", k, pct(f"count(*) FILTER (WHERE {c} IS NULL)", "count(*)")) for k, c in MISSING.items()]
    parts += [f"SELECT '{k}', CAST({c} AS VARCHAR), CAST(count(*) AS DOUBLE), NULL FROM g GROUP BY {c}" if c != "NULL" else f"SELECT '{k}', NULL, CAST(count(*) AS DOUBLE), NULL FROM g" for k, c in COUNTED.items()]
    parts.append("""SELECT 'building_type_observed', CASE event_type WHEN 'view' THEN 'appartement' WHEN 'click' THEN 'maison' WHEN 'signup' THEN ' Appartement ' WHEN 'purchase' THEN 'immeuble' ELSE 'chateau' END AS k,
  CAST(count(*) AS DOUBLE), NULL FROM events GROUP BY k""")
    for m, c in (("surface", "surface"), ("consumption", "conso"), ("emissions", "emission")):
        parts += [one(f"{m}_quantiles", k, r2(f"quantile_cont({c}, {q})")) for k, q in SPREAD.items()] + [one(f"{m}_quantiles", "count", f"count({c})")]
    parts += [one("retrieval", "rows_retrieved", "count(*)", "draw0"), one("duplicates", "exact_duplicates", "count(*) - count(DISTINCT _id)", "draw0"), one("duplicates", "unique_numero_dpe", "count(DISTINCT numero_dpe)", "draw0")]
    parts += [one("duplicates", "missing_numero_dpe", "count(*) FILTER (WHERE numero_dpe IS NULL)", "draw0"), one("duplicates", "conflicting_duplicates", "count(*)", "(SELECT numero_dpe FROM draw0 GROUP BY 1 HAVING count(*) > 1) z")]
    parts.append(f"SELECT 'outlier_policy', NULL, NULL, '{reports.OUTLIERS}'")
    return f"""WITH {ENERGY_SQL}, g AS (SELECT diag.*, CASE WHEN user_id % 22 < 21 THEN '751' || lpad(CAST(user_id % 22 + 1 AS VARCHAR), 2, '0') END AS code_insee_ban
  FROM diag JOIN events ON diag._id = lpad(CAST(event_id AS VARCHAR), 12, '0')) """ + " UNION ALL ".join(parts)


@query(_sections_sql())
def energy_sections(spark, sf_dir):
    """The whole report on diagnostics: totals, counts, quantiles, missing values, duplicates and observed types."""
    return reports.energy_sections(diagnostics(spark, sf_dir), raw_diagnostics(spark, sf_dir))


@query("""WITH k AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, CASE WHEN k - 5 BETWEEN -90 AND 90 AND k * 3 BETWEEN -180 AND 180 THEN CAST(k - 5 AS DOUBLE) END AS latitude,
  CASE WHEN k - 5 BETWEEN -90 AND 90 AND k * 3 BETWEEN -180 AND 180 THEN CAST(k * 3 AS DOUBLE) END AS longitude FROM k""")
def geopoint_parse(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    point = geopoint(F.concat_ws(",", (k - 5).cast("string"), (k * 3).cast("string")))
    return table(spark, sf_dir, "events").select("event_id", point.alias("p")).select("event_id", "p.latitude", "p.longitude")


@query("""WITH k AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, CAST(k AS VARCHAR) AS cleaned, CASE WHEN k BETWEEN 1 AND 20 THEN k END AS district FROM k""")
def district_codes(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    code = F.concat(F.lit("751"), F.lpad(k, 2, "0"))
    return table(spark, sf_dir, "events").select("event_id", cleaned_id(F.concat(k, F.lit(".0"))).alias("cleaned"), district(code).alias("district"))




# --- vectors and the index ------------------------------------------------------------------------------------------

QUERY_ID, TOP = 7, 5
COSINE = "greatest(-1.0, least(1.0, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))))"
TOP_SQL = f"""hits AS (SELECT e.vec_id, e.label, {COSINE} AS similarity, CAST(row_number() OVER (ORDER BY {COSINE} DESC, e.vec_id) AS INTEGER) AS rank
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {QUERY_ID}) q"""
ROUND6 = "sign(similarity) * floor(abs(similarity) * 1000000 + 0.5) / 1000000 AS similarity"


def _query_vector(spark, sf_dir) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == QUERY_ID).select("embedding").first()[0])


def _top(spark, sf_dir, only=None):
    found = table(spark, sf_dir, "embeddings")
    found = found if only is None else found.filter(F.col("label").isin(only))
    return vectors.top_k(found, _query_vector(spark, sf_dir), TOP)


@query(f"WITH {TOP_SQL}) SELECT vec_id, rank, {ROUND6} FROM hits WHERE rank <= {TOP}")
def cosine_topk(spark, sf_dir):
    return _top(spark, sf_dir).select("vec_id", "rank", rounded(F.col("similarity"), 6).alias("similarity"))


@query(f"WITH {TOP_SQL} WHERE e.label IN (1, 3)) SELECT vec_id, label, rank, {ROUND6} FROM hits WHERE rank <= {TOP}")
def cosine_topk_filtered(spark, sf_dir):
    return _top(spark, sf_dir, [1, 3]).select("vec_id", "label", "rank", rounded(F.col("similarity"), 6).alias("similarity"))


@query(f"WITH {TOP_SQL} WHERE e.vec_id <> {QUERY_ID}) SELECT vec_id, rank FROM hits WHERE rank <= {TOP} AND (SELECT max(similarity) FROM hits) >= 0.42")
def similarity_abstain(spark, sf_dir):
    found = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") != QUERY_ID)
    return vectors.or_abstain(vectors.top_k(found, _query_vector(spark, sf_dir), TOP)).select("vec_id", "rank")


MANY_SQL = f"""pairs AS (SELECT q.vec_id AS question_id, e.vec_id, {COSINE} AS similarity FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0),
many AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, vec_id) AS INTEGER) AS rank FROM pairs)"""


def _questions(spark, sf_dir):
    """The stated questions: every row whose id is divisible by 100."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id"), "embedding")


@query(f"WITH {MANY_SQL} SELECT question_id, vec_id, rank, {ROUND6} FROM many WHERE rank <= {TOP}")
def cosine_topk_of_many(spark, sf_dir):
    found = vectors.top_k_of_many(_questions(spark, sf_dir), table(spark, sf_dir, "embeddings"), TOP, 64)
    return found.select("question_id", "vec_id", "rank", rounded(F.col("similarity"), 6).alias("similarity"))


ASKED_LEAST = 0.5
HEADS = f"length('QUESTION' || chr(10) || 'Which passages are like ' || CAST(question_id AS VARCHAR) || '?' || chr(10) || chr(10) || 'STYLE' || chr(10) || '{answers.STYLES['brief']}' || chr(10) || chr(10) || 'PASSAGES' || chr(10))"
HEAD = "length(chr(10) || '[S' || CAST(rank AS VARCHAR) || ']' || chr(10) || 'Title: ' || coalesce(source, '-') || chr(10) || 'Publisher: ' || coalesce(lang, '-') || chr(10) || 'Section: -' || chr(10) || 'Page: -' || chr(10) || 'URL: ' || CAST(vec_id AS VARCHAR) || chr(10) || chr(10))"


@query(f"""WITH p0 AS (SELECT q.vec_id AS question_id, e.vec_id, {COSINE} AS similarity FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, vec_id) AS INTEGER) AS rank FROM p0),
t AS (SELECT r.*, source, lang, length(coalesce(text, '')) AS n, max(similarity) OVER (PARTITION BY question_id) AS best FROM r LEFT JOIN documents ON doc_id = vec_id WHERE rank <= {TOP}),
l AS (SELECT *, 12000 - {HEADS} - coalesce(sum({HEAD} + n) OVER (PARTITION BY question_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - {HEAD} AS room FROM t)
SELECT question_id, best < {ASKED_LEAST} AS insufficient, CAST(count(*) AS BIGINT) AS n_retrieved, CAST(CASE WHEN best >= {ASKED_LEAST} THEN count(*) FILTER (WHERE room >= 200) ELSE 0 END AS INTEGER) AS n_included,
  CASE WHEN best < {ASKED_LEAST} THEN '{answers.ABSTENTION}' ELSE 'The first is like it [S1].' END AS answer, CASE WHEN best >= {ASKED_LEAST} THEN max(vec_id) FILTER (WHERE rank = 1) END AS first_cited,
  sign(best) * floor(abs(best) * 1000000 + 0.5) / 1000000 AS top_similarity FROM l GROUP BY question_id, best""")
def documentary_answers(spark, sf_dir):
    """Every stated question answered from the documents of the most similar other vectors, or not where none is near."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("title"), F.col("lang").alias("publisher"))
    own = table(spark, sf_dir, "embeddings").join(docs, F.col("vec_id") == F.col("doc_id"), "left")
    none = F.lit(None).cast("string")
    passages = own.select(F.col("vec_id").alias("chunk_id"), F.col("title").alias("source_id"), "title", "publisher", F.col("vec_id").cast("string").alias("url"), none.alias("section"), none.alias("page"), "text", "embedding")
    asked = F.concat(F.lit(" Which passages are like "), F.col("question_id").cast("string"), F.lit("? "))
    questions = _questions(spark, sf_dir).select("question_id", asked.alias("question"), F.lit("brief").alias("style"), "embedding")
    found = answers.answered(questions, passages, lambda inputs: ["The first is like it [S1]."] * len(inputs), 64, k=TOP, threshold=ASKED_LEAST, but_itself=True)
    first = F.get("citations", F.lit(0))["of"]["chunk_id"].alias("first_cited")
    return found.select("question_id", "insufficient", "n_retrieved", "n_included", "answer", first, rounded(F.col("top_similarity"), 6).alias("top_similarity"))


def _index(spark, sf_dir):
    """The documents as a corpus, and an index of an older state of it: every fifth is missing, every seventh changed,
    and the first of each hundred stands for one that the corpus no longer has."""
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("source_id"), F.sha2("text", 256).alias("content_sha256"), "doc_id")
    known = chunks.filter("doc_id % 5 <> 0 OR doc_id % 100 = 0")
    known = known.select(
        F.when(F.col("doc_id") % 100 == 0, F.concat(F.lit("old-"), "chunk_id")).otherwise(F.col("chunk_id")).alias("chunk_id"), "source_id",
        F.when(F.col("doc_id") % 7 == 0, "changed").otherwise(F.col("content_sha256")).alias("content_sha256"), F.lit("m1").alias("model"), F.lit(64).alias("dimensions"),
    )
    return chunks.drop("doc_id"), known


@query("SELECT CAST(doc_id AS VARCHAR) AS chunk_id FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0")
def needs_embedding(spark, sf_dir):
    chunks, known = _index(spark, sf_dir)
    return loading.needs_embedding(chunks, known, "m1", 64).select("chunk_id")


@query("SELECT 'old-' || CAST(doc_id AS VARCHAR) AS chunk_id FROM documents WHERE doc_id % 100 = 0")
def stale_chunks(spark, sf_dir):
    chunks, known = _index(spark, sf_dir)
    return loading.stale_chunks(known, chunks, chunks).select("chunk_id")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS origin FROM documents WHERE doc_id % 3 = 0 OR doc_id % 2 = 0")
def manifest_merge(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    old, new = docs.filter("doc_id % 2 = 0").withColumn("origin", F.lit("old")), docs.filter("doc_id % 3 = 0").withColumn("origin", F.lit("new"))
    return loading.merge_manifest(old, new, "doc_id")


@query(f"""WITH {SALES_SQL} SELECT CAST(n AS INTEGER) AS arrondissement_number, '751' || lpad(CAST(n AS VARCHAR), 2, '0') AS insee_code, '750' || lpad(CAST(n AS VARCHAR), 2, '0') AS postal_code,
  'Paris ' || CAST(n AS VARCHAR) || CASE WHEN n = 1 THEN 'er' ELSE 'e' END AS name, (SELECT count(*) FROM raw WHERE code_commune = '751' || lpad(CAST(n AS VARCHAR), 2, '0')) AS n_rows FROM range(1, 21) t(n)""")
def district_dimension(spark, sf_dir):
    """The dimension with how many raw rows have each code."""
    codes = raw_sales(spark, sf_dir).groupBy(F.col("code_commune").alias("insee_code")).agg(F.count("*").alias("n_rows"))
    return loading.dimension(spark).join(codes, "insee_code", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


@query("""SELECT 'quantity' AS rule, count(*) FILTER (WHERE NOT (l_quantity BETWEEN 1 AND 45)) AS n_broken FROM lineitem
UNION ALL SELECT 'discount', count(*) FILTER (WHERE NOT (l_discount >= 0)) FROM lineitem""")
def constraint_checks(spark, sf_dir):
    rules = [loading.Rule("quantity", "l_quantity BETWEEN 1 AND 45"), loading.Rule("discount", "l_discount >= 0")]
    return loading.broken_rules(table(spark, sf_dir, "lineitem"), rules)


# --- text -----------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, CAST(length(text) AS INTEGER) AS n_characters, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS INTEGER) AS n_words, sha256(text) AS sha FROM documents""")
def text_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n_characters"), text.word_count(F.col("text")).alias("n_words"), F.sha2("text", 256).alias("sha"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY sha256(text)")
def content_hash_dedup(spark, sf_dir):
    return quality.equal_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS characters, length(text) >= 200 AS enough FROM documents")
def short_documents(spark, sf_dir):
    return corpus.enough_content(table(spark, sf_dir, "documents"), key="doc_id")


@query("""WITH a AS (SELECT doc_id, coalesce(text, '') || ' [S' || CAST(doc_id % 4 AS VARCHAR) || ']' AS t FROM documents),
c AS (SELECT doc_id, list_distinct(regexp_extract_all(t, '\\[S(\\d{1,9})\\]', 1)) AS refs, regexp_extract(t, '\\[S(\\d{1,9})\\]', 1) AS first FROM a)
SELECT doc_id, 'S' || first AS first_source, CAST(len(refs) AS INTEGER) AS n_cited, len(list_filter(refs, lambda x: CAST(x AS INTEGER) < 1 OR CAST(x AS INTEGER) > 2)) = 0 AS valid FROM c""")
def citation_refs(spark, sf_dir):
    """Whole texts as answers, each with a reference at its end, of which every fourth does not exist."""
    answer = F.concat(F.coalesce("text", F.lit("")), F.lit(" [S"), F.col("doc_id") % 4, F.lit("]"))
    found = vectors.citations(table(spark, sf_dir, "documents").select("doc_id", answer.alias("answer"), F.lit(2).alias("n_hits")), "answer", "n_hits")
    return found.select("doc_id", F.concat(F.lit("S"), F.get("cited", F.lit(0)).cast("string")).alias("first_source"), F.size("cited").alias("n_cited"), "valid")


def _redacted_sql(x: str) -> str:
    for pattern, put in text.SECRETS:
        x = f"regexp_replace({x}, '{pattern}', '{put.replace('$', chr(92))}', 'g')"
    return x


@query(f"""SELECT doc_id, CASE WHEN length(r) > 500 THEN left(r, 500) || '…' ELSE r END AS redacted
FROM (SELECT doc_id, {_redacted_sql("text")} AS r FROM documents)""")
def redact_secrets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.redacted(F.col("text")).alias("redacted"))


def searchable_sql(x: str) -> str:
    return f"trim(regexp_replace(replace(lower(strip_accents({x})), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g'))"  # what case folding does to ß


@query(f"SELECT doc_id, {searchable_sql('text')} AS normalised FROM documents")
def search_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.search_text(F.col("text")).alias("normalised"))


@query()
def html_elements(spark, sf_dir):
    return page_elements(table(spark, sf_dir, "pages"))


@query()
def chunk_documents(spark, sf_dir):
    found = chunking.chunk_rows(chunking.text_documents(table(spark, sf_dir, "documents")))
    return found.withColumns({c: F.array_join(c, "|") for c in ("heading_path", "quality_flags")})


@query()
def chunk_size_stats(spark, sf_dir):
    return chunking.size_stats(chunking.chunk_rows(chunking.text_documents(table(spark, sf_dir, "documents"))))


# --- conversations --------------------------------------------------------------------------------------------------


@query()
def route_messages(spark, sf_dir):
    turns = conversation.user_turns(table(spark, sf_dir, "conversations"))
    return conversation.with_routes(turns).select("conv_id", "turn", "route")


def _among(x: str, words: tuple[str, ...]) -> str:
    return f"{x} IN ({', '.join(repr(w) for w in words)})"


def _any_of(x: str, words: tuple[str, ...], how: str = "contains") -> str:
    return "(" + " OR ".join(f"{how}({x}, '{w}')" for w in words) + ")"


def _fits(x: str, patterns: tuple[str, ...]) -> str:
    return f"regexp_matches({x}, '{'|'.join(f'(?:{p})' for p in patterns)}')"


C = conversation
SCOPE = lambda x: f"(regexp_matches({x}, '\\b(?:{'|'.join(C.IN_SCOPE)})\\b') OR regexp_matches({x}, '{C.ORDINAL}'))"
NAMED = lambda x: f"regexp_matches({x}, '^(?:{'|'.join(C.CITY)})$')"
SHORT = "(t = '' OR len(string_split(t, ' ')) <= 12)"
SPOKEN = " OR ".join(_among("w", (x,)) for x in C.LANGUAGES)


def _route_sql() -> str:
    """The ordered rules over t, a normalized text, and b, the one before."""
    return f"""CASE WHEN {_fits("t", C.SECURITY)} THEN 'security' WHEN {_fits("t", C.CLOCK)} THEN 'clock' WHEN {_any_of("t", C.WEATHER)} THEN 'weather' WHEN {_fits("t", C.PLACE)} THEN 'location'
  WHEN {_among("t", C.GREETINGS)} THEN 'greeting' WHEN {_among("t", C.THANKS)} THEN 'thanks' WHEN {_among("t", C.ACKNOWLEDGEMENTS)} THEN 'acknowledgement' WHEN {_among("t", C.GOODBYES)} THEN 'goodbye'
  WHEN {_among("t", C.CAPABILITIES)} THEN 'capability' WHEN {SCOPE("t")} THEN 'model'
  WHEN {SHORT} AND ({NAMED("t")} OR {_any_of("t", C.FOLLOW_UPS, "starts_with")} OR regexp_matches(t, '{C.ORDINAL}')) AND ({SCOPE("b")} OR {NAMED("b")}) THEN 'model'
  WHEN {SHORT} AND len(list_filter(string_split(t, ' '), lambda w: {SPOKEN})) > 0 AND {_any_of("t", C.INSTRUCTIONS)} AND {SCOPE("b")} THEN 'model'
  WHEN {NAMED("t")} THEN 'clarify_city' ELSE 'out_of_scope' END"""


ROUTE = _route_sql()


@query(f"""WITH u AS (SELECT conv_id, turn, {searchable_sql("text")} AS t, coalesce({searchable_sql("lag(text) OVER (PARTITION BY conv_id ORDER BY turn)")}, '') AS b FROM conversations WHERE role = 'user')
SELECT conv_id, turn, {ROUTE} AS route FROM u""")
def route_by_rules(spark, sf_dir):
    """The ordered rules without the tolerance for misspelt greetings and languages."""
    turns = conversation.user_turns(table(spark, sf_dir, "conversations"))
    return conversation.with_routes(turns, misspelt=False).select("conv_id", "turn", "route")


TOOLS = f"""CASE WHEN {_any_of("t", C.DPE)} AND {_any_of("t", C.STATISTICAL)} AND NOT {_any_of("t", C.MARKET)} AND NOT {_any_of("t", C.DOCUMENTARY)} THEN 'analyze_dpe' END"""


@query(f"""WITH w AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
h AS (SELECT a.conv_id, a.turn, any_value(a.text) AS text, CAST(count(b.n) AS INTEGER) AS n_history, CAST(coalesce(sum(length(b.text)), 0) AS BIGINT) AS history_characters, max_by(b.text, b.n) FILTER (WHERE b.role = 'user') AS previous
  FROM w a LEFT JOIN w b ON b.conv_id = a.conv_id AND b.n BETWEEN a.n - {C.HISTORY} AND a.n - 1 WHERE a.role = 'user' GROUP BY a.conv_id, a.turn),
u AS (SELECT *, {searchable_sql("text")} AS t, coalesce({searchable_sql("previous")}, '') AS b FROM h)
SELECT conv_id, turn, n_history, history_characters, {ROUTE} AS route, {TOOLS} AS allowed_tools FROM u""")
def prepared_turns(spark, sf_dir):
    """What is settled before a model is asked: the last messages, the route and the tools."""
    found = conversation.prepared_turns(table(spark, sf_dir, "conversations"), misspelt=False)
    characters = F.aggregate("history", F.lit(0).cast("long"), lambda n, m: n + F.coalesce(F.length(m["text"]), F.lit(0)))
    return found.select("conv_id", "turn", F.size("history").alias("n_history"), characters.alias("history_characters"), "route", "allowed_tools")


@query(f"""SELECT conv_id, turn, CASE WHEN {_any_of("t", C.DPE)} AND {_any_of("t", C.STATISTICAL)} AND NOT {_any_of("t", C.MARKET)} AND NOT {_any_of("t", C.DOCUMENTARY)} THEN 'analyze_dpe' END AS allowed_tools
FROM (SELECT conv_id, turn, {searchable_sql("text")} AS t FROM conversations WHERE role = 'user') z""")
def tool_policy(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return conversation.with_tools(turns).select("conv_id", "turn", "allowed_tools")


def _recorded(spark, sf_dir):
    """Labels as recorded answers: one of poor quality took another route, a toxic one had a tool that failed."""
    t = table(spark, sf_dir, "labels")
    tools_of = F.array(F.lit("get_market_overview"))
    none = F.array().cast("array<string>")
    return t.select(
        F.lit("market").alias("expected_route"), F.when(F.col("quality") == 1, "market").otherwise("dpe").alias("route"), tools_of.alias("required_tools"), tools_of.alias("allowed_tools"),
        tools_of.alias("successful_tools"), F.when(F.col("toxic") == 0, none).otherwise(tools_of).alias("failed_tools"), F.lit(True).alias("citations_required"),
        (F.col("doc_id") % 4).cast("int").alias("n_citations"), F.array(F.lit("line")).alias("expected_charts"), F.when(F.col("doc_id") % 5 == 0, none).otherwise(F.array(F.lit("line"))).alias("charts"),
        F.lit(False).alias("memory_expected"), (F.col("doc_id") % 7 == 0).alias("memory_used"), F.lit(None).cast("string").alias("expected_model"), F.lit("m").alias("model"),
        F.array(F.lit("prix")).alias("required_terms"), F.when(F.col("doc_id") % 11 != 0, "Le Prix médian").otherwise(" ").alias("answer"), (F.col("doc_id") % 100).alias("latency_ms"),
    )


FLAGS = {
    "route_correct": "coalesce(quality = 1, false)", "tools_correct": "coalesce(toxic = 0, false)", "citations_correct": "doc_id % 4 > 0", "charts_correct": "doc_id % 5 <> 0",
    "memory_correct": "doc_id % 7 <> 0", "model_correct": "true", "terms_correct": "doc_id % 11 <> 0", "answer_present": "doc_id % 11 <> 0",
}


@query(f"""SELECT count(*) AS cases, count(*) FILTER (WHERE {' AND '.join(FLAGS.values())}) AS passed_cases, {pct(f"count(*) FILTER (WHERE {' AND '.join(FLAGS.values())})", "count(*)")} AS passed_pct,
  {', '.join(f'{pct(f"count(*) FILTER (WHERE {v})", "count(*)")} AS {k}_pct' for k, v in FLAGS.items())}, round(avg(doc_id % 100), 2) AS mean_latency_ms FROM labels""")
def eval_summary(spark, sf_dir):
    return conversation.summary(conversation.scored(_recorded(spark, sf_dir)))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN props ELSE '{"__invalid_json__": true}' END AS arguments FROM events""")
def checked_arguments(spark, sf_dir):
    """Every third event's properties are whole, every third's cut, and the rest's stand in a list."""
    x, n = F.col("props"), F.col("event_id") % 3
    given = F.when(n == 0, x).when(n == 1, F.substr(x, F.lit(1), F.length(x) - 1)).otherwise(F.concat(F.lit("["), x, F.lit("]")))
    return tools.checked_arguments(table(spark, sf_dir, "events").select("event_id", given.alias("arguments")))


@query("SELECT doc_id, doc_id % 3 = 0 AS insufficient, nullif(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '') AS answer FROM documents")
def insufficient_answers(spark, sf_dir):
    mark = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(f"{corpus.INSUFFICIENT} : "), F.regexp_replace("text", r"^\s+", ""))).otherwise(F.col("text"))
    return corpus.checked_answers(table(spark, sf_dir, "documents").select("doc_id", mark.alias("answer")), "answer")


@query("""WITH c AS (SELECT doc_id // 20 AS answer, doc_id AS pos, source, 'S' || CAST(doc_id % 6 AS VARCHAR) AS r, lang FROM documents),
f AS (SELECT answer, source, r, min(pos) AS pos FROM c GROUP BY ALL), g AS (SELECT answer, source, lang, min(pos) AS pos FROM c GROUP BY ALL),
f1 AS (SELECT answer, source, min(pos) AS place, string_agg(r, ',' ORDER BY pos) AS refs FROM f GROUP BY ALL), g1 AS (SELECT answer, source, string_agg(lang, ',' ORDER BY pos) AS sections FROM g GROUP BY ALL)
SELECT answer, source AS url, place, refs, sections FROM f1 JOIN g1 USING (answer, source)""")
def citation_groups(spark, sf_dir):
    """Twenty documents in a row are an answer's citations; their origin is the url, their language the section."""
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "documents").select(
        F.floor(F.col("doc_id") / 20).alias("answer"), F.col("doc_id").alias("position"), F.col("source").alias("url"), none.alias("source_id"), none.alias("title"), none.alias("publisher"),
        F.concat(F.lit("S"), F.col("doc_id") % 6).alias("citation_id"), F.col("lang").alias("section"),
    )
    return corpus.grouped_citations(rows, "answer").select("answer", "url", "place", F.array_join("references", ",").alias("refs"), F.array_join("sections", ",").alias("sections"))


# --- the corpus -----------------------------------------------------------------------------------------------------


@query("""SELECT count(*) AS total_chunks, count(*) FILTER (WHERE doc_id % 5 = 0 OR doc_id % 7 = 0) AS embedded_chunks, count(*) FILTER (WHERE NOT (doc_id % 5 = 0 OR doc_id % 7 = 0)) AS unchanged_chunks,
  count(*) FILTER (WHERE doc_id % 100 = 0) AS deleted_stale_chunks, count(DISTINCT source) AS source_count, 'm1' AS model, 64 AS dimensions FROM documents""")
def embedding_summary(spark, sf_dir):
    chunks, known = _index(spark, sf_dir)
    return corpus.embedding_summary(chunks, known, "m1", 64)


def _manifest(spark, sf_dir):
    """Documents as manifest entries; every ninth failed."""
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        n.cast("string").alias("source_id"), F.when(n % 9 == 0, "failed").otherwise("chunked").alias("status"), F.sha2("text", 256).alias("processed_sha256"), F.sha2("source", 256).alias("raw_sha256"),
        F.lit("v1").alias("chunking_version"), F.lit("{}").alias("configuration"), F.sha2(n.cast("string"), 256).alias("output_sha256"), (n % 7).alias("chunk_count"), F.col("n_chars").alias("character_count"),
    )


@query("SELECT count(*) AS total_sources, CAST(sum(doc_id % 7) AS BIGINT) AS total_chunks, CAST(sum(n_chars) AS BIGINT) AS total_characters FROM documents WHERE doc_id % 9 <> 0")
def corpus_totals(spark, sf_dir):
    return corpus.corpus_totals(_manifest(spark, sf_dir))


@query("SELECT CAST(doc_id AS VARCHAR) AS source_id FROM documents WHERE doc_id % 9 <> 0 AND doc_id % 4 <> 0 AND doc_id % 6 <> 1 AND doc_id % 10 <> 3")
def unchanged_sources(spark, sf_dir):
    """Against a manifest, every fourth has another text, some another version, and some no stored output."""
    n = F.col("source_id").cast("long")
    now = _manifest(spark, sf_dir).withColumns({
        "processed_sha256": F.when(n % 4 == 0, "changed").otherwise(F.col("processed_sha256")), "chunking_version": F.when(n % 6 == 1, "v2").otherwise(F.col("chunking_version")),
        "output_sha256": F.when(n % 10 != 3, F.col("output_sha256")),
    })
    return corpus.unchanged_sources(now, _manifest(spark, sf_dir)).select("source_id")


# --- checks of what is stored and answered --------------------------------------------------------------------------


def _stored_sql(dataset: str, view: str, key: str, source: str) -> str:
    return f"""SELECT '{dataset}' AS dataset, 'unique_keys' AS rule, (SELECT count(*) = count(DISTINCT {key}) FROM {view}) AS passed
UNION ALL SELECT '{dataset}', 'rows_match_source', (SELECT count(*) FROM {view}) = ({source})
UNION ALL SELECT '{dataset}', 'districts_known', NOT EXISTS (SELECT 1 FROM {view} WHERE arrondissement NOT BETWEEN 1 AND 20)"""


@query(f"""WITH {SALES_SQL}, {ENERGY_SQL} SELECT 'districts' AS dataset, 'expected_districts' AS rule, count(*) = 20 AS passed FROM range(1, 21)
UNION ALL {_stored_sql("sales", "mut", "id_mutation", "SELECT count(DISTINCT id_mutation) FROM raw WHERE nature_mutation = 'Vente' AND type_local IN ('Appartement', 'Maison')")}
UNION ALL {_stored_sql("diagnostics", "diag", "numero_dpe", "SELECT count(DISTINCT user_id || event_type) FROM events")}
UNION ALL SELECT unnest(['sales', 'diagnostics']), 'no_address_columns', true""")
def warehouse_validation(spark, sf_dir):
    raw = raw_sales(spark, sf_dir)
    units = raw.filter((F.col("nature_mutation") == market.SALE) & market.is_residential()).select("source_year", "id_mutation").distinct()
    numbers = raw_diagnostics(spark, sf_dir).select("numero_dpe").distinct()
    return runs.warehouse_checks(sales(spark, sf_dir), units, diagnostics(spark, sf_dir), numbers, loading.dimension(spark))


@query(f"""WITH {SALES_SQL}, {ENERGY_SQL}, {LABELS}, o AS ({overview_sql('')}), t AS (SELECT sum(n) AS total FROM lab)
SELECT 'market_eligible_total' AS rule, market_count <= eligible_count AND eligible_count <= total_count AS passed FROM o
UNION ALL SELECT 'defaults_exclude_partial_years', NOT includes_partial_year AND total_count = (SELECT count(*) FROM mut WHERE source_year BETWEEN {Y0} AND {Y1} AND source_year <> 2001) FROM o
UNION ALL SELECT 'ranked_districts', NOT EXISTS (SELECT 1 FROM mut WHERE arrondissement NOT BETWEEN 1 AND 20)
UNION ALL SELECT 'percentages', coalesce(abs(sum({pct('n', 'total')}) - 100) < 0.5, false) OR sum(n) = 0 FROM lab, t
UNION ALL SELECT 'poor_labels', sum(n) FILTER (WHERE label IN ('F', 'G')) <= sum(n) FROM lab""")
def analytics_invariants(spark, sf_dir):
    return runs.answer_checks(sales(spark, sf_dir), diagnostics(spark, sf_dir), SALES_POLICY, ENERGY_POLICY)


BROKEN = """broken AS (SELECT id_mutation, arrondissement FROM mut UNION ALL SELECT id_mutation, 99 FROM mut WHERE source_year = (SELECT min(source_year) FROM mut)),
short AS (SELECT range AS n FROM range(1, 20))"""


@query(f"""WITH {SALES_SQL}, {BROKEN}
SELECT 'districts' AS dataset, 'expected_districts' AS rule, (SELECT count(*) = 20 FROM short) AS passed
UNION ALL SELECT 'sales', 'unique_keys', count(*) = count(DISTINCT id_mutation) FROM broken
UNION ALL SELECT 'sales', 'rows_match_source', count(*) = (SELECT count(*) FROM mut) FROM broken
UNION ALL SELECT 'sales', 'districts_known', count(*) FILTER (WHERE arrondissement IS NOT NULL AND arrondissement NOT IN (SELECT n FROM short)) = 0 FROM broken
UNION ALL SELECT 'sales', 'no_address_columns', false
UNION ALL SELECT 'diagnostics', unnest(['unique_keys', 'rows_match_source', 'districts_known', 'no_address_columns']), unnest([count(*) = count(DISTINCT id_mutation), count(*) = (SELECT count(*) FROM mut), count(*) FILTER (WHERE arrondissement > 19) = 0, true]) FROM mut""")
def warehouse_validation_of_broken(spark, sf_dir):
    """The checks of a table that was broken on purpose: repeated keys, unknown districts, more rows than its source, an
    address column and a dimension without its last district; and of the same table unbroken but for the dimension."""
    good = sales(spark, sf_dir).select("source_year", "id_mutation", "arrondissement")
    first = good.agg(F.min("source_year").alias("_first"))
    extra = good.join(F.broadcast(first), F.col("source_year") == F.col("_first")).select("source_year", "id_mutation", F.lit(99).alias("arrondissement"))
    broken = good.unionByName(extra).withColumn(loading.FORBIDDEN[0], F.lit("1"))
    short = loading.dimension(spark, 19)
    return runs.warehouse_checks(broken, good, good.withColumnRenamed("id_mutation", "numero_dpe"), good, short)


SCOPE_SQL = """SELECT arrondissement, count(*) AS n, count_if(is_price_per_m2_eligible AND price_per_m2_raw BETWEEN :least AND :most) AS market_count
FROM {facts} WHERE source_year BETWEEN :start AND :end AND arrondissement IS NOT NULL GROUP BY arrondissement"""


@query(f"WITH {SALES_SQL} SELECT arrondissement, count(*) AS n, count(*) FILTER (WHERE {M}) AS market_count FROM mut WHERE source_year BETWEEN {Y0} AND {Y1} AND arrondissement IS NOT NULL GROUP BY arrondissement")
def scope_by_parameters(spark, sf_dir):
    """An answer asked in SQL with bound values."""
    return files.asked(SCOPE_SQL, {"start": Y0, "end": Y1, "least": SALES_POLICY.least_price, "most": SALES_POLICY.most_price}, facts=sales(spark, sf_dir))


def _plain(df):
    """Decimals as doubles, which every engine compares alike."""
    return df.select(*(F.col(c).cast("double").alias(c) if kind.startswith("decimal") else F.col(c) for c, kind in df.dtypes))


def _stored_as(x: str, kind: str) -> str:
    return f"CAST(CAST({x} AS {kind}) AS DOUBLE)"


LOADED_SALES = MUTATION.replace("residential_surface, residential_rooms, ", "").replace("mutation_value, ", "")


@query(f"""WITH {SALES_SQL} SELECT {LOADED_SALES}, {_stored_as("mutation_value", "DECIMAL(14,2)")} AS mutation_value, {_stored_as("residential_surface", "DECIMAL(10,2)")} AS residential_surface,
  {_stored_as("residential_rooms", "DECIMAL(5,1)")} AS residential_rooms, 'lineitem' AS source_file, 'deadbeef' AS source_sha256, is_price_per_m2_eligible, price_ineligibility_reason,
  {_stored_as("price_per_m2_raw", "DECIMAL(14,2)")} AS price_per_m2_raw FROM mut""")
def loaded_sales(spark, sf_dir):
    return _plain(projection.sales(sales(spark, sf_dir)))


@query(f"""WITH {ENERGY_SQL}, p AS (SELECT *, k - 5 AS lat, k * 3 AS lon FROM diag JOIN (SELECT event_id, k FROM ev) e ON diag._id = lpad(CAST(e.event_id AS VARCHAR), 12, '0'))
SELECT numero_dpe, date_etablissement_dpe, CAST(NULL AS DATE) AS date_fin_validite_dpe, diagnostic_year, etiquette_dpe_norm, etiquette_ges_norm, {_stored_as("surface", "DECIMAL(10,2)")} AS surface_habitable_logement,
  conso AS conso_5_usages_par_m2_ep, emission AS emission_ges_5_usages_par_m2, type_norm AS type_batiment_norm, analysis_population, CAST(NULL AS VARCHAR) AS periode_construction, arrondissement,
  CASE WHEN lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 THEN CAST(lat AS DOUBLE) END AS latitude, CASE WHEN lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 THEN CAST(lon AS DOUBLE) END AS longitude,
  arrondissement IS NOT NULL AS is_valid_arrondissement, is_geography_consistent, etiquette_dpe_norm IS NOT NULL AS is_valid_dpe_label, etiquette_ges_norm IS NOT NULL AS is_valid_ges_label,
  coalesce(surface > 0, false) AS is_valid_surface, coalesce(conso >= 0, false) AS is_valid_consumption, coalesce(emission >= 0, false) AS is_valid_emission, coalesce(type_norm IN ('appartement', 'maison'), false) AS is_residential_unit_type,
  is_label_analysis_eligible, intensity_exclusion_reason IS NULL AS is_intensity_analysis_eligible, coalesce(diagnostic_year BETWEEN 2021 AND 2025, false) AS is_complete_analysis_year,
  coalesce(diagnostic_year = 2026, false) AS is_partial_year, label_exclusion_reason, intensity_exclusion_reason FROM p""")
def loaded_diagnostics(spark, sf_dir):
    return _plain(projection.diagnostics(diagnostics(spark, sf_dir)))
