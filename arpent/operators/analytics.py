"""The seven questions over curated mutations and diagnostics. Each is one lazy plan with one pass over its fact table.

Percentiles are exact and interpolate, over prices that are already rounded to two places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arpent.functions.columns import percent, rounded
from arpent.operators import quantiles
from arpent.policy import DEFAULT, Policy, checked_areas, checked_district, checked_years, includes_partial


def _in_scope(facts: DataFrame, year: str, start: int, end: int, area: int | None) -> DataFrame:
    facts = facts.filter(F.col(year).between(start, end))
    return facts if area is None else facts.filter(F.col("arrondissement") == area)


def _scope(start: int | None, end: int | None, area: int | None, policy: Policy) -> tuple[int, int]:
    checked_district(area, policy)
    return checked_years(policy.first_year if start is None else start, policy.last_year if end is None else end, policy)


def _market(policy: Policy) -> Column:
    return F.col("is_price_per_m2_eligible") & F.col("price_per_m2_raw").between(policy.least_price, policy.most_price)


QUARTILES = {"p50": 0.5, "q1": 0.25, "q3": 0.75}


def _prices(policy: Policy) -> Column:
    """The quartiles of prices as one array, so that a group has one map of its prices and not one for each quartile. It
    holds the different prices within the band at most, which have two places."""
    return F.percentile(F.when(_market(policy), F.col("price_per_m2_raw")), list(QUARTILES.values())).alias("_prices")


def _apart(found: DataFrame) -> DataFrame:
    return found.withColumns({n: F.col("_prices")[i] for i, n in enumerate(QUARTILES)}).drop("_prices")


def spine(spark: SparkSession, start: int, end: int, name: str) -> DataFrame:
    return spark.range(start, end + 1).select(F.col("id").cast("int").alias(name))


def market_overview(facts: DataFrame, start: int | None = None, end: int | None = None, area: int | None = None, policy: Policy = DEFAULT) -> DataFrame:
    """One row; without sales counts are 0 and prices null."""
    start, end = _scope(start, end, area, policy)
    price, quarters = F.col("price_per_m2_raw"), (("median", 0.5), ("p25", 0.25), ("p75", 0.75))
    measures = {
        "rows": F.lit(0.0), "eligible": F.when(F.col("is_price_per_m2_eligible"), F.lit(0.0)), "raw": F.when(F.col("is_price_per_m2_eligible"), price),
        "in_band": F.when(_market(policy), F.lit(0.0)), "price": F.when(_market(policy), price), "surface": F.col("residential_surface"),
    }
    asked = {"raw_median": ("raw", 0.5)} | {n: ("price", q) for n, q in quarters} | {"median_surface": ("surface", 0.5)}
    found = quantiles.exact(_in_scope(facts, "source_year", start, end, area), measures, asked)
    counts = {"total_count": "n_rows", "eligible_count": "n_eligible", "market_count": "n_in_band"}
    one = found.select(*(F.col(c).alias(n) for n, c in counts.items()), *(rounded(F.col(n)).alias(n) for n in asked))
    warnings = F.array_compact(F.array(
        F.when(F.col("total_count") == 0, "no sales in this scope"),
        F.when((F.col("market_count") == 0) & (F.col("eligible_count") > 0), "all eligible prices lie outside the band"),
    ))
    return one.withColumns({
        "excluded_count": F.col("eligible_count") - F.col("market_count"),
        "sensitivity": rounded(F.col("median") - F.col("raw_median")),
        "includes_partial_year": F.lit(includes_partial(start, end, policy)),
        "warnings": F.array_join(warnings, "; "),
    })


def price_trend(facts: DataFrame, start: int | None = None, end: int | None = None, area: int | None = None, policy: Policy = DEFAULT) -> DataFrame:
    """A row for each year of the period, also of those without sales. The change compares the rounded median with the
    unrounded one of the year before; the first year has none."""
    start, end = _scope(start, end, area, policy)
    years = _apart(_in_scope(facts, "source_year", start, end, area).groupBy("source_year").agg(F.count("*").alias("n"), F.count_if(_market(policy)).alias("m"), _prices(policy)))
    years = spine(facts.sparkSession, start, end, "source_year").join(years, "source_year", "left")
    before = F.lag("p50").over(Window.orderBy("source_year"))  # as many rows as the period has years
    change = F.when(before != 0, rounded((rounded(F.col("p50")) - before) / before * 100))
    return years.select(
        "source_year", F.coalesce("n", F.lit(0)).alias("transaction_count"), F.coalesce("m", F.lit(0)).alias("market_count"),
        rounded(F.col("p50")).alias("median"), rounded(F.col("q1")).alias("p25"), rounded(F.col("q3")).alias("p75"), change.alias("yoy_change_pct"),
    )


def _by_area(facts: DataFrame, policy: Policy) -> DataFrame:
    found = facts.groupBy("arrondissement").agg(
        F.count("*").alias("n"), F.count_if(_market(policy)).alias("m"), _prices(policy), F.percentile(F.col("residential_surface").cast("double"), 0.5).alias("surface")
    )
    return _apart(found)


def compare_areas(facts: DataFrame, areas: list[int], start: int | None = None, end: int | None = None, policy: Policy = DEFAULT, most: int | None = None) -> DataFrame:
    """A row for each district asked for, in the order asked."""
    start, end = _scope(start, end, None, policy)
    areas = checked_areas(areas, policy, most)
    places = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(a).alias("arrondissement")) for i, a in enumerate(areas)))
    asked = facts.sparkSession.range(1).select(F.inline(places))
    found = _by_area(_in_scope(facts, "source_year", start, end, None).filter(F.col("arrondissement").isin(areas)), policy)
    return F.broadcast(asked).join(found, "arrondissement", "left").select(
        "position", "arrondissement", F.coalesce("n", F.lit(0)).alias("transaction_count"), F.coalesce("m", F.lit(0)).alias("market_count"),
        rounded(F.col("p50")).alias("median"), rounded(F.col("q1")).alias("p25"), rounded(F.col("q3")).alias("p75"), rounded(F.col("surface")).alias("median_surface"),
    )


def area_metrics(facts: DataFrame, start: int | None = None, end: int | None = None, policy: Policy = DEFAULT) -> DataFrame:
    """arrondissement, median, median_surface, sample_size, sufficient: what rankings choose from."""
    start, end = _scope(start, end, None, policy)
    found = _by_area(_in_scope(facts, "source_year", start, end, None).filter(F.col("arrondissement").isNotNull()), policy)
    return found.select(
        "arrondissement", rounded(F.col("p50")).alias("median"), rounded(F.col("surface")).alias("median_surface"),
        F.col("m").alias("sample_size"), (F.col("m") >= policy.least_sample).alias("sufficient"),
    )


def ranking(facts: DataFrame, metric: str, start: int | None = None, end: int | None = None, policy: Policy = DEFAULT) -> DataFrame:
    """Districts with enough sales by descending metric (median, sample_size or median_surface); ties by district."""
    kept = area_metrics(facts, start, end, policy).filter(F.col("sufficient") & F.col(metric).isNotNull())
    order = Window.orderBy(F.col(metric).desc(), F.col("arrondissement"))  # at most one row for each district
    return kept.withColumn("rank", F.row_number().over(order)).drop("sufficient")


def rankings(facts: DataFrame, start: int | None = None, end: int | None = None, policy: Policy = DEFAULT) -> DataFrame:
    """The three rankings under each other, with a column `ranking`, from one pass over the facts."""
    names = ("median", "sample_size", "median_surface")
    lists = F.array(*(F.struct(F.lit(m).alias("ranking"), F.col(m).cast("double").alias("_by")) for m in names))
    kept = area_metrics(facts, start, end, policy).filter("sufficient").drop("sufficient").select("*", F.inline(lists)).filter("_by IS NOT NULL")
    order = Window.partitionBy("ranking").orderBy(F.desc("_by"), "arrondissement")  # at most one row for each district
    return kept.withColumn("rank", F.row_number().over(order)).drop("_by")


def small_samples(facts: DataFrame, start: int | None = None, end: int | None = None, policy: Policy = DEFAULT) -> DataFrame:
    """The districts that the rankings leave out, and how many sales they have."""
    return area_metrics(facts, start, end, policy).filter(~F.col("sufficient")).select("arrondissement", "sample_size")


def small_sample_warning(facts: DataFrame, start: int | None = None, end: int | None = None, policy: Policy = DEFAULT) -> DataFrame:
    """One row: the warning that names the districts left out, in order, or an empty one."""
    found = small_samples(facts, start, end, policy).agg(F.array_sort(F.collect_list("arrondissement")).alias("gone"))  # at most one for each district
    text = F.concat(F.lit(f"districts with fewer than {policy.least_sample} sales are not ranked: "), F.array_join(F.col("gone").cast("array<string>"), ", "))
    return found.select(F.when(F.size("gone") > 0, text).otherwise("").alias("warnings"))


def applied_filters(start: int | None = None, end: int | None = None, area: int | None = None, policy: Policy = DEFAULT) -> Column:
    """What an answer was restricted to, as a struct that can stand beside it."""
    start, end = _scope(start, end, area, policy)
    fields = {
        "arrondissement": F.lit(area).cast("int"), "start_year": F.lit(start), "end_year": F.lit(end), "price_per_m2_min": F.lit(policy.least_price),
        "price_per_m2_max": F.lit(policy.most_price), "includes_partial_year": F.lit(includes_partial(start, end, policy)),
    }
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def _dwellings(facts: DataFrame, eligible: str, start: int, end: int, area: int | None) -> DataFrame:
    return _in_scope(facts.filter(F.col(eligible) & (F.col("analysis_population") == "dwelling_unit")), "diagnostic_year", start, end, area)


def label_distribution(facts: DataFrame, start: int | None = None, end: int | None = None, area: int | None = None, policy: Policy = DEFAULT) -> DataFrame:
    """A row for each label, also of those that do not occur."""
    start, end = _scope(start, end, area, policy)
    found = _dwellings(facts, "is_label_analysis_eligible", start, end, area).filter(F.col("etiquette_dpe_norm").isNotNull())
    found = found.groupBy(F.col("etiquette_dpe_norm").alias("label")).agg(F.count("*").alias("n"))
    labels = facts.sparkSession.createDataFrame([(x,) for x in policy.labels], "label string")
    found = F.broadcast(labels).join(found, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over as many rows as there are labels
    return found.select("label", "n", percent(F.col("n"), total).alias("pct"))


def poor_labels(facts: DataFrame, start: int | None = None, end: int | None = None, area: int | None = None, policy: Policy = DEFAULT) -> DataFrame:
    """One row: how many labels, and how many of them are the two poorest."""
    found = label_distribution(facts, start, end, area, policy)
    f, g = policy.labels[-2:]
    count = lambda x: F.sum(F.when(F.col("label") == x, F.col("n")).otherwise(0))
    found = found.agg(F.sum("n").alias("total"), count(f).alias("f_count"), count(g).alias("g_count"))
    both = F.col("f_count") + F.col("g_count")
    warnings = F.when(F.col("total") == 0, "no labels in this scope").otherwise("").alias("warnings")
    return found.select("total", "f_count", "g_count", both.alias("fg_count"), percent(both, F.col("total")).alias("fg_pct"), warnings)


def intensity_summary(facts: DataFrame, start: int | None = None, end: int | None = None, area: int | None = None, policy: Policy = DEFAULT) -> DataFrame:
    start, end = _scope(start, end, area, policy)
    columns = {"consumption": "conso_5_usages_par_m2_ep", "emission": "emission_ges_5_usages_par_m2", "surface": "surface_habitable_logement"}
    asked = {f"{c}_{n}": (c, q) for c in ("consumption", "emission") for n, q in (("median", 0.5), ("p25", 0.25), ("p75", 0.75))} | {"median_surface": ("surface", 0.5)}
    dwellings = _dwellings(facts, "is_intensity_analysis_eligible", start, end, area)
    found = quantiles.exact(dwellings, {"rows": F.lit(0.0)} | {n: F.col(c) for n, c in columns.items()}, asked)
    found = found.select(F.col("n_rows").alias("n"), *(rounded(F.col(n)).alias(n) for n in asked))
    return found.withColumn("warnings", F.when(F.col("n") == 0, "no intensities in this scope").otherwise(""))


def area_profile(sales: DataFrame, diagnostics: DataFrame, area: int, start: int | None = None, end: int | None = None, policy: Policy = DEFAULT, energy_policy: Policy | None = None) -> DataFrame:
    """One row for a district. The facts never meet row by row, only as the single rows of three answers. Without a period,
    each fact is asked for that of its own policy."""
    energy_policy = energy_policy or policy
    if area is None:
        raise ValueError("a profile needs a district")
    prefixed = lambda df, p: df.select(*(F.col(c).alias(f"{p}_{c}") for c in df.columns))
    market = prefixed(market_overview(sales, start, end, area, policy), "market")
    labels = prefixed(poor_labels(diagnostics, start, end, area, energy_policy), "labels")
    intensity = prefixed(intensity_summary(diagnostics, start, end, area, energy_policy), "intensity")
    joined = market.crossJoin(F.broadcast(labels)).crossJoin(F.broadcast(intensity))
    return joined.select(F.lit(area).alias("arrondissement"), "*")
