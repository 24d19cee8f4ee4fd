"""Composed runs: from files to stored tables and reports, and checks of what is stored and answered.

Each run writes its tables before it reports, and the reports are taken from the stored tables, so duplicates are removed
and mutations made once. Empty inputs give empty tables and reports of zeros."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from arpent.operators import analytics, energy, loading, market, quality, reports
from arpent.policy import DEFAULT, Policy
from arpent.sources import fetch, files


def _written(rows: DataFrame, path: str, years: bool = True) -> DataFrame:
    """rows stored at path, where only the years that they have are replaced, and read back."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if years else "static")
    (writer.partitionBy("source_year") if years else writer).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(line,) for line in text.split("\n")], "line string").coalesce(1).write.mode("overwrite").text(path)


def curate_sales(rows: DataFrame, out: str, years: list[int] | None = None) -> DataFrame:
    """Raw sale rows to tables by year: `clean`, rows without exact duplicates and how often each was there, `components` and
    `mutations`. Years that the rows do not have stay as they are. Then the metrics of every year, over all stored years,
    as JSON; returns the metrics. `years`, if known, spares a look into the rows."""
    spark = rows.sparkSession
    clean = _written(market.counted_rows(rows), f"{out}/clean")
    fresh = clean if years is None else clean.filter(F.col("source_year").isin(years))
    once = fresh.drop(market.COPIES)
    sold = _written(market.with_eligibility(market.mutations(once)), f"{out}/mutations")
    units = _written(market.components(once), f"{out}/components")
    quality.stored_year_metrics(clean, units, sold).coalesce(1).write.mode("overwrite").json(f"{out}/metrics")  # a row for each year
    return spark.read.json(f"{out}/metrics")


def _known(spark: SparkSession, out: str) -> dict[int, str]:
    """The checksum of each year's file that the tables hold."""
    try:
        rows = spark.read.schema("source_year int, sha256 string, at long").json(f"{out}/manifest")
        newest = rows.groupBy("source_year").agg(F.max_by("sha256", "at").alias("sha256"))
        return {r.source_year: r.sha256 for r in newest.collect()}  # a row for each year
    except AnalysisException:  # no run so far
        return {}


def sales_run(spark: SparkSession, sources: dict[int, tuple[str, str]], out: str) -> DataFrame:
    """The whole run; sources: the path and the checksum of each year's file. Only years whose checksum changed are read
    and curated, and of the stored tables only their partitions are written. Metrics by year and over all years, with
    the distribution of prices, are made from the stored tables, as JSON and as Markdown. Years count as done when all of
    their tables are written, so a run that fails is repeated for them."""
    known = _known(spark, out)
    changed = {year: s for year, s in sorted(sources.items()) if known.get(year) != s[1]}
    if not changed:
        return spark.read.json(f"{out}/metrics")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (files.checked_sales(spark, path, year, sha256) for year, (path, sha256) in changed.items()))
    metrics = curate_sales(rows, out, sorted(changed))
    sold = spark.read.parquet(f"{out}/mutations")
    prices = quality.price_distribution(sold)
    prices.coalesce(1).write.mode("overwrite").json(f"{out}/price_distribution")
    by_year = metrics.orderBy(F.asc_nulls_last("source_year"))
    _text(spark, f"{out}/report", quality.as_markdown(by_year, "Sales by year") + "\n" + quality.as_markdown(prices, "Prices per square metre"))
    done = spark.createDataFrame([(year, sha256, time.time_ns()) for year, (_, sha256) in changed.items()], "source_year int, sha256 string, at long")
    done.coalesce(1).write.mode("append").json(f"{out}/manifest")
    return metrics


def acquired_sales_run(spark: SparkSession, transport: fetch.Transport, urls: dict[int, str], folder: str, out: str) -> DataFrame:
    """From the yearly files' urls to stored tables and reports. Files whose checksum is known are not fetched again, and
    years whose files did not change are not curated again. `folder` is one of a store that all machines share; files are
    written to it through Spark's file systems."""
    found = fetch.acquired_years(transport, urls, folder, _known(spark, out), files=fetch.Shared(spark))
    return sales_run(spark, {year: (path, sha256) for year, (path, sha256, _) in found.items()}, out)


def diagnostics_run(spark: SparkSession, path: str, out: str, policy: Policy = DEFAULT, manifest: dict | None = None) -> DataFrame:
    """Snapshot files to curated diagnostics as Parquet, a report of one row as JSON, and the whole report in sections as
    JSON and Markdown; returns the report of one row. manifest: what was told of the snapshot when it was fetched."""
    raw = files.snapshot(spark, path)
    curated = _written(energy.curated(raw, policy), f"{out}/curated", years=False)
    curated.drop("_geopoint").write.mode("overwrite").parquet(f"{out}/diagnostics")
    quality.energy_report(curated).coalesce(1).write.mode("overwrite").json(f"{out}/report")
    reports.energy_sections(curated, raw, manifest, policy.districts).coalesce(1).write.mode("overwrite").json(f"{out}/sections")
    sections = spark.read.schema(reports.SHAPE).json(f"{out}/sections")
    _text(spark, f"{out}/markdown", reports.as_markdown(sections, "Energy diagnostics", "Aggregates of the diagnostics at hand, not of the whole housing stock."))
    return spark.read.json(f"{out}/report")


def _listed(one: DataFrame, checks: dict) -> DataFrame:
    """A frame of one row as rows of rule, passed."""
    return one.select(F.inline(F.array(*(F.struct(F.lit(name).alias("rule"), F.coalesce(ok, F.lit(False)).alias("passed")) for name, ok in checks.items()))))


def stored_checks(dataset: str, rows: DataFrame, key: str, source: DataFrame, districts: DataFrame) -> DataFrame:
    """dataset, rule, passed: keys are unique, rows are as many as the source's, districts are in the dimension, and no
    address columns are there. `source` is what was loaded; each side is counted where it lies."""
    n = rows.agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_keys"))
    lost = loading.orphans(rows, "arrondissement", districts, "arrondissement_number").agg(F.count("*").alias("n_orphans"))
    one = n.crossJoin(lost).crossJoin(source.agg(F.count("*").alias("n_source")))  # three frames of one row
    checks = {
        "unique_keys": F.col("n") == F.col("n_keys"), "rows_match_source": F.col("n") == F.col("n_source"),
        "districts_known": F.col("n_orphans") == 0, "no_address_columns": F.lit(not loading.forbidden_columns(rows)),
    }
    return _listed(one, checks).select(F.lit(dataset).alias("dataset"), "rule", "passed")


def warehouse_checks(sales: DataFrame, sales_source: DataFrame, diagnostics: DataFrame, diagnostics_source: DataFrame, districts: DataFrame, expected: int = 20) -> DataFrame:
    """dataset, rule, passed for the dimension and both facts."""
    whole = _listed(districts.agg(F.count("*").alias("n")), {"expected_districts": F.col("n") == expected}).select(F.lit("districts").alias("dataset"), "rule", "passed")
    first = stored_checks("sales", sales, "id_mutation", sales_source, districts)
    return whole.unionByName(first).unionByName(stored_checks("diagnostics", diagnostics, "numero_dpe", diagnostics_source, districts))


def answer_checks(sales: DataFrame, diagnostics: DataFrame, policy: Policy = DEFAULT, energy_policy: Policy | None = None) -> DataFrame:
    """rule, passed: what must hold between the answers whatever the data."""
    energy_policy = energy_policy or policy
    total = _listed(analytics.market_overview(sales, policy=policy), {"market_eligible_total": (F.col("market_count") <= F.col("eligible_count")) & (F.col("eligible_count") <= F.col("total_count"))})
    ranked = analytics.rankings(sales, policy=policy).agg(F.count_if(~F.col("arrondissement").between(1, policy.districts)).alias("n"))
    labels = analytics.label_distribution(diagnostics, policy=energy_policy).agg(F.sum("n").alias("n"), F.sum("pct").alias("pct"))
    poor = analytics.poor_labels(diagnostics, policy=energy_policy)
    years = sales.filter(F.col("source_year").between(policy.first_year, policy.last_year)).agg(F.count_if(F.col("source_year").isin(*policy.partial_years)).alias("partial"), F.count("*").alias("n"))
    whole = analytics.market_overview(sales, policy=policy).select("total_count", "includes_partial_year").crossJoin(F.broadcast(years))  # two frames of one row
    apart = {"defaults_exclude_partial_years": ~F.col("includes_partial_year") & (F.col("partial") == 0) & (F.col("total_count") == F.col("n"))}
    return (
        total.unionByName(_listed(whole, apart)).unionByName(_listed(ranked, {"ranked_districts": F.col("n") == 0}))
        .unionByName(_listed(labels, {"percentages": (F.abs(F.col("pct") - 100) < 0.5) | (F.col("n") == 0)}))
        .unionByName(_listed(poor, {"poor_labels": F.col("fg_count") <= F.col("total")}))
    )
