"""Quality metrics and profiles of raw and curated tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arpent.functions.columns import district, holds, percent, rounded
from arpent.operators import market
from arpent.operators.quantiles import exact

#: Natures that are counted but not analysed.
EXCLUDED_NATURES = ("Vente en l'état futur d'achèvement", "Échange", "Adjudication", "Vente terrain à bâtir")
PRICE_QUANTILES = {
    "p0_1": 0.001, "p0_5": 0.005, "p1": 0.01, "p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95,
    "p99": 0.99, "p99_5": 0.995, "p99_9": 0.999,
}
SUMMARY_QUANTILES = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def quantiles(rows: DataFrame, column: str, at: dict[str, float]) -> DataFrame:
    """One row: count, min, max and exact interpolated quantiles; nulls and NaN count for nothing."""
    asked = {"min": 0.0, "max": 1.0} | at
    found = exact(rows, {"x": F.col(column)}, {n: ("x", q) for n, q in asked.items()})
    return found.select(F.col("n_x").alias("count"), *(rounded(F.col(n)).alias(n) for n in asked))


def price_distribution(found: DataFrame) -> DataFrame:
    return quantiles(found.filter("is_price_per_m2_eligible"), "price_per_m2_raw", PRICE_QUANTILES)


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """value, n for every value, null included; cast to string."""
    return rows.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))


def top_values(rows: DataFrame, column: str, n: int = 30) -> DataFrame:
    """The n most frequent values; ties by value."""
    return value_counts(rows, column).orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(n)


def counts_of(rows: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """The given values with their counts, zero for those that do not occur."""
    asked = rows.sparkSession.createDataFrame([(v,) for v in values], "value string")
    found = value_counts(rows.filter(F.col(column).isin(*values)), column)
    return F.broadcast(asked).join(found, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def missing(rows: DataFrame, *columns: str) -> DataFrame:
    """column, n_missing, pct_missing in one pass."""
    names = [c for c in columns or rows.columns if c in rows.columns]
    one = rows.agg(F.count("*").alias("_all"), *(F.count_if(F.col(c).isNull()).alias(c) for c in names))
    long = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing")) for c in names))).alias("x")
    return one.select("_all", long).select("x.column", "x.n_missing", percent(F.col("x.n_missing"), F.col("_all")).alias("pct_missing"))


def invalid_codes(rows: DataFrame) -> DataFrame:
    """One row: sales whose code is no district's."""
    bad = (F.col("nature_mutation") == market.SALE) & district(F.col("code_commune")).isNull()
    return rows.agg(F.count_if(bad).alias("n_invalid"))


def coverage(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: how many rows, and the share of those that have all the columns."""
    there = reduce(Column.__and__, (F.col(c).isNotNull() for c in columns))
    return rows.agg(F.count("*").alias("n"), F.count_if(there).alias("n_covered")).withColumn("coverage_pct", percent(F.col("n_covered"), F.col("n")))


def district_coverage(rows: DataFrame, most: int = 20) -> DataFrame:
    """One row: districts that occur, and those that do not, in order."""
    seen = rows.agg(F.array_compact(F.collect_set("arrondissement")).alias("seen"))  # at most as many as there are districts
    gone = F.array_except(F.sequence(F.lit(1), F.lit(most)), "seen")
    return seen.select(F.size("seen").alias("n_covered"), F.array_join(F.array_sort(gone.cast("array<int>")), ",").alias("missing"))


def describe(rows: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, sample deviation, extremes and exact quartiles."""
    x = F.col(column).cast("double")
    x = F.when(~F.isnan(x), x)
    one = rows.agg(F.count(x).alias("count"), rounded(F.avg(x)).alias("mean"), rounded(F.stddev_samp(x)).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    quartiles = exact(rows, {"x": x}, {"p25": ("x", 0.25), "p50": ("x", 0.5), "p75": ("x", 0.75)})
    quartiles = quartiles.select(*(rounded(F.col(n)).alias(n) for n in ("p25", "p50", "p75")))
    return one.crossJoin(F.broadcast(quartiles)).select("count", "mean", "std", "min", "p25", "p50", "p75", "max")  # two frames of one row


def rows_per_key(rows: DataFrame, key: str, value: str, kind: str) -> DataFrame:
    """One row: how many rows keys have, how many keys several, and how often a key's value or kind is not one."""
    keys = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("n"), (F.min(value) < F.max(value)).alias("mixed_value"), (F.min(kind) < F.max(kind)).alias("mixed_kind")
    )
    return keys.agg(
        F.count("*").alias("n_keys"), rounded(F.avg("n")).alias("mean_rows"), F.max("n").alias("max_rows"),
        percent(F.count_if(F.col("n") > 1), F.count("*")).alias("multi_row_pct"),
        F.count_if("mixed_value").alias("n_mixed_value"), F.count_if("mixed_kind").alias("n_mixed_kind"),
    )


def year_metrics(rows: DataFrame) -> DataFrame:
    """A row for each year of raw sale rows, and one with a null year for all."""
    clean = market.counted_rows(rows)
    once = clean.drop(market.COPIES)
    return stored_year_metrics(clean, market.components(once), market.with_eligibility(market.mutations(once)))


def stored_year_metrics(clean: DataFrame, components: DataFrame, found: DataFrame) -> DataFrame:
    """The metrics from rows without duplicates with their copies counted, their components and their mutations: additive
    counts by rollup, shares anew. Mutations of all years are the sum of the years', as ids belong to a year."""
    by = lambda df, *aggs: df.rollup("source_year").agg(F.grouping("source_year").cast("int").alias("g"), *aggs)
    sale = F.col("nature_mutation") == market.SALE
    years = clean.groupBy("source_year", "id_mutation").agg(
        F.sum(market.COPIES).alias("raw"), F.count("*").alias("n"), F.count_if(sale & district(F.col("code_commune")).isNull()).alias("bad"),
        F.count_if(~holds(sale)).alias("other"),
    )
    raw = by(
        years, F.sum("raw").alias("raw_rows"), F.sum("n").alias("deduplicated_rows"), F.count("id_mutation").alias("unique_mutations"),
        F.sum("bad").alias("invalid_paris_codes"), F.sum("other").alias("excluded_nature_rows"),
    )
    surface = F.col("surface_reelle_bati")
    units = by(
        components, F.count("*").alias("residential_units"), F.count_if(~holds(surface > 0)).alias("invalid_or_missing_surfaces"),
        F.count_if(F.col("longitude").isNotNull() & F.col("latitude").isNotNull()).alias("with_coordinates"),
    )
    sold = by(
        found, F.count("*").alias("residential_mutations"), F.count_if(F.col("residential_unit_count") == 1).alias("single_unit_mutations"),
        F.count_if(F.col("residential_unit_count") > 1).alias("multi_unit_mutations"), F.sum("apartment_count").alias("apartment_count"),
        F.sum("house_count").alias("house_count"), F.count_if(~F.col("value_consistent")).alias("inconsistent_mutation_values"),
        F.count_if(~F.col("geo_consistent")).alias("ambiguous_geography"), F.count_if("is_price_per_m2_eligible").alias("price_eligible_count"),
    )
    joined = raw
    for other in (units, sold):  # as many rows as years
        both = (joined["g"] == other["g"]) & joined["source_year"].eqNullSafe(other["source_year"])
        joined = joined.join(other, both, "left").drop(other["g"]).drop(other["source_year"])
    counts = [c for c in joined.columns if c not in ("source_year", "g")]
    filled = joined.select("source_year", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts))
    return filled.withColumns({
        "exact_duplicates": F.col("raw_rows") - F.col("deduplicated_rows"),
        "price_eligibility_rate_pct": percent(F.col("price_eligible_count"), F.col("residential_mutations")),
        "coordinate_coverage_pct": percent(F.col("with_coordinates"), F.col("residential_units")),
    }).drop("with_coordinates")


def energy_report(rows: DataFrame) -> DataFrame:
    """One row of counts over curated diagnostics."""
    date = F.col("date_etablissement_dpe")
    return rows.agg(
        F.count("*").alias("processed_rows"), F.count_if("is_label_analysis_eligible").alias("label_eligible_rows"),
        F.count_if("is_intensity_analysis_eligible").alias("intensity_eligible_rows"),
        *(F.count_if(F.col("type_batiment_norm") == k).alias(f"{k}_count") for k in ("appartement", "maison", "immeuble")),
        F.min(date).cast("string").alias("date_min"), F.max(date).cast("string").alias("date_max"),
        F.count_if("is_complete_analysis_year").alias("complete_year_count"), F.count_if("is_partial_year").alias("partial_year_count"),
        F.count_if(~F.col("is_geography_consistent")).alias("geography_inconsistencies"),
        percent(F.count("_geopoint"), F.count("*")).alias("coordinate_coverage_pct"),
    )


def global_metrics(rows: DataFrame, found: DataFrame) -> DataFrame:
    """One row over all years: the sums and shares of `year_metrics` of raw rows, and the price quantiles of the mutations
    `found`, taken anew over all of them."""
    whole = year_metrics(rows).filter("source_year IS NULL").drop("source_year")
    prices = price_distribution(found)
    return whole.crossJoin(prices.select(*(F.col(c).alias(f"price_{c}") for c in prices.columns)))  # two frames of one row


def sample_profile(rows: DataFrame, key: str = "numero_dpe", most_invalid: int = 20) -> DataFrame:
    """section, key, value of raw diagnostics: missing shares, repeated keys, labels, codes and the most frequent of those
    that are no district's, and descriptions of the numbers."""
    none = F.lit(None).cast("string")
    row = lambda df, section, k, v: df.select(F.lit(section).alias("section"), k.alias("key"), v.cast("double").alias("value"))
    parts = [
        row(missing(rows), "missing_pct", F.col("column"), F.col("pct_missing")),
        row(rows.agg(F.count("*").alias("n"), F.count_distinct(key).alias("d"), F.max(F.col(key).isNull()).cast("int").alias("e")), "repeated_keys", none, F.col("n") - F.col("d") - F.coalesce("e", F.lit(0))),
    ]
    parts += [row(value_counts(rows, c), c, F.col("value"), F.col("n")) for c in ("etiquette_dpe", "etiquette_ges", "code_insee_ban", "code_postal_ban")]
    invalid = top_values(rows.filter(district(F.col("code_insee_ban")).isNull()), "code_insee_ban", most_invalid)
    parts.append(row(invalid, "invalid_code_insee_ban", F.col("value"), F.col("n")))
    for c in ("surface_habitable_logement", "conso_5_usages_par_m2_ep", "emission_ges_5_usages_par_m2"):
        one = describe(rows, c)
        long = one.select(F.explode(F.array(*(F.struct(F.lit(m).alias("k"), F.col(m).cast("double").alias("v")) for m in one.columns))).alias("x"))
        parts.append(row(long, c, F.col("x.k"), F.col("x.v")))
    return reduce(DataFrame.unionByName, parts)


def exact_duplicates(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: exact_duplicates, by how much rows outnumber the different ones, and n. Only digests of the columns, all of
    them if none are named, are shuffled; nulls equal nulls."""
    whole = F.to_json(F.struct(*(columns or rows.columns)), {"ignoreNullFields": "false"})
    different = rows.groupBy(F.sha2(whole, 256).alias("sha")).agg(F.count("*").alias("n"))
    return different.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("exact_duplicates"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def equal_texts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, n for each different text: the smallest key that has it, and how many rows do. Texts meet as digests; null is a
    text of its own."""
    return rows.groupBy(F.sha2(text, 256).alias("sha")).agg(F.min(key).alias(key), F.count("*").alias("n")).drop("sha")


def raw_profile(sales: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """table, section, key, value: both raw tables in one report. Of sales the missing shares, the kinds, natures and codes, how
    many rows mutations have and in how many their value or kind differs, and the spread of values and surfaces; of
    diagnostics their profile. Shares and counts of a table's columns come from one pass each."""
    row = lambda df, section, k, v: df.select(F.lit(section).alias("section"), k.alias("key"), v.cast("double").alias("value"))

    def long(one: DataFrame, section: str) -> DataFrame:
        each = one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v")) for c in one.columns))))
        return row(each, section, F.col("k"), F.col("v"))

    parts = [row(missing(sales), "missing_pct", F.col("column"), F.col("pct_missing")), long(exact_duplicates(sales), "duplicates")]
    parts += [row(value_counts(sales, c), c, F.col("value"), F.col("n")) for c in ("nature_mutation", "type_local", "code_commune")]
    parts.append(long(rows_per_key(sales, "id_mutation", "valeur_fonciere", "type_local"), "rows_per_mutation"))
    parts += [long(describe(sales, c), c) for c in ("valeur_fonciere", "surface_reelle_bati", "nombre_pieces_principales")]
    both = ((reduce(DataFrame.unionByName, parts), "sales"), (sample_profile(diagnostics), "diagnostics"))
    return reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("table"), "section", "key", "value") for df, name in both))


def as_markdown(rows: DataFrame, title: str, most: int = 1000) -> str:
    """A small report table as Markdown; `most` bounds what comes to the driver."""
    names = rows.columns
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in row) + " |" for row in rows.limit(most).collect()]
    return "\n".join(lines) + "\n"
