import pytest

from arpent.operators import analytics
from arpent.policy import InputError, checked_areas, checked_years

SALES = "id_mutation string, source_year int, arrondissement int, is_price_per_m2_eligible boolean, price_per_m2_raw double, residential_surface double"
DPE = (
    "diagnostic_year int, arrondissement int, analysis_population string, etiquette_dpe_norm string, is_label_analysis_eligible boolean, "
    "is_intensity_analysis_eligible boolean, conso_5_usages_par_m2_ep double, emission_ges_5_usages_par_m2 double, surface_habitable_logement double"
)


def sales(spark, prices, year=2023, area=15):
    return spark.createDataFrame([(str(i), year, area, p is not None, p, 50.0) for i, p in enumerate(prices)], SALES)


def dpe(spark, labels):
    return spark.createDataFrame([(2023, 15, "dwelling_unit", x, True, True, 100.0 + i, 10.0, 50.0) for i, x in enumerate(labels)], DPE)


@pytest.mark.parametrize("prices, median", [([9000.0, 10000.0, 11000.0], 10000), ([8000.0, 10000.0, 12000.0, 14000.0], 11000)])
def test_median(spark, prices, median):
    assert analytics.market_overview(sales(spark, prices)).first()["median"] == median


def test_quartiles_outliers_and_band(spark):
    r = analytics.market_overview(sales(spark, [4000.0, 8000.0, 12000.0, 16000.0, 20000.0])).first()
    assert (r.p25, r.p75) == (8000, 16000)
    r = analytics.market_overview(sales(spark, [9000.0, 10000.0, 11000.0, 999999.0])).first()
    assert (r.total_count, r.market_count, r.excluded_count, r["median"], r.raw_median, r.sensitivity) == (4, 3, 1, 10000, 10500, -500)
    r = analytics.market_overview(sales(spark, [500.0, 10000.0])).first()
    assert (r.market_count, r["median"]) == (1, 10000)
    assert "outside the band" in analytics.market_overview(sales(spark, [500.0])).first().warnings


def test_empty_market(spark):
    r = analytics.market_overview(sales(spark, [1.0]).limit(0)).first()
    assert (r.total_count, r["median"], r.median_surface) == (0, None, None)


def test_trend(spark):
    rows = analytics.price_trend(sales(spark, [10000.0], 2022).union(sales(spark, [11000.0], 2023)), 2022, 2024).orderBy("source_year").collect()
    assert [r.yoy_change_pct for r in rows] == [None, 10.0, None]
    assert [r.transaction_count for r in rows] == [1, 1, 0]


def test_one_map_of_prices_a_group(spark):
    facts = sales(spark, [8000.0, 12000.0, 16000.0, 4000.0, 20000.0, 999999.0, None], 2022).union(sales(spark, [500.0], 2023, 16))
    trend, areas = analytics.price_trend(facts, 2022, 2024), analytics.compare_areas(facts, [15, 16, 17])
    for found, maps in ((trend, {"price_per_m2_raw": 1}), (areas, {"price_per_m2_raw": 1, "residential_surface": 1})):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count(" partial_percentile(") + plan.count("[partial_percentile(") == sum(maps.values())  # an aggregate lists its functions once
    assert [(r["median"], r.p25, r.p75) for r in trend.orderBy("source_year").collect()] == [(12000, 8000, 16000), (None, None, None), (None, None, None)]
    assert [(r["median"], r.p25, r.p75, r.median_surface) for r in areas.orderBy("position").collect()] == [(12000, 8000, 16000, 50), (None, None, None, 50), (None, None, None, None)]


def test_compare(spark):
    facts = sales(spark, [10000.0], area=20).union(sales(spark, [8000.0], area=13))
    rows = analytics.compare_areas(facts, [13, 20, 13, 5]).orderBy("position").collect()
    assert [(r.arrondissement, r.market_count, r["median"]) for r in rows] == [(13, 1, 8000), (20, 1, 10000), (5, 0, None)]


def test_rankings_need_a_sample(spark):
    facts = sales(spark, [9000.0] * 40, area=1).union(sales(spark, [20000.0] * 5, area=2)).union(sales(spark, [9000.0] * 30, area=3))
    assert [(r.rank, r.arrondissement) for r in analytics.ranking(facts, "median").orderBy("rank").collect()] == [(1, 1), (2, 3)]
    every = analytics.rankings(facts).collect()
    for metric in ("median", "sample_size", "median_surface"):
        own = sorted((r["rank"], r.arrondissement, r[metric]) for r in every if r.ranking == metric)
        assert own == sorted((r["rank"], r.arrondissement, r[metric]) for r in analytics.ranking(facts, metric).collect()) and own
    assert [(r.arrondissement, r.sample_size) for r in analytics.small_samples(facts).collect()] == [(2, 5)]


def test_labels(spark):
    facts = dpe(spark, ["D", "D", "F", "G", None])
    rows = {r.label: (r.n, r.pct) for r in analytics.label_distribution(facts).collect()}
    assert rows["D"] == (2, 50.0) and rows["A"] == (0, 0.0) and len(rows) == 7
    assert analytics.poor_labels(facts).first().fg_pct == 50.0
    assert analytics.poor_labels(facts.limit(0)).first().fg_pct == 0.0


def test_intensity_and_profile(spark):
    facts = dpe(spark, ["A", "B", "C"])
    r = analytics.intensity_summary(facts).first()
    assert (r.n, r.consumption_median, r.consumption_p25, r.emission_p75, r.median_surface) == (3, 101.0, 100.5, 10.0, 50.0)
    r = analytics.area_profile(sales(spark, [10000.0]), facts, 15).first()
    assert (r.arrondissement, r.market_median, r.labels_total, r.intensity_n) == (15, 10000, 3, 3)


def test_inputs():
    for bad in ((2024, 2021), (2019, 2021), (True, 2022)):
        with pytest.raises(InputError):
            checked_years(*bad)
    assert checked_areas([13, 20, 13]) == [13, 20]
    for bad in ([13], [13, 13], [0, 1], [1, 21]):
        with pytest.raises(InputError):
            checked_areas(bad)
