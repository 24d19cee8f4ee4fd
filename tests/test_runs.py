"""Composed runs from files to tables and reports, and the checks of what is stored."""

import json

import pytest

from arpent.operators import loading
from arpent.plans import runs
from arpent.sources import files

HEAD = "id_mutation,date_mutation,nature_mutation,valeur_fonciere,code_commune,code_postal,type_local,surface_reelle_bati,nombre_pieces_principales,id_parcelle,longitude,latitude"


def test_sales_run(spark, tmp_path, monkeypatch):
    from arpent.operators import market

    monkeypatch.setattr(market, "check_schema", lambda rows: None)  # these files hold the columns that are used alone
    flat = "{id},2021-03-04,Vente,300000,75115,75015,Appartement,50,2,p{id},2.3,48.8"
    (tmp_path / "a.csv").write_text("\n".join([HEAD, flat.format(id=1), flat.format(id=1), flat.format(id=2), flat.format(id=3).replace("Vente", "Echange")]))
    (tmp_path / "b.csv").write_text("\n".join([HEAD, flat.format(id=1).replace("2021", "2022")]))
    metrics = runs.sales_run(spark, {2021: (f"{tmp_path}/a.csv", "x"), 2022: (f"{tmp_path}/b.csv", "y")}, f"{tmp_path}/out")
    got = {r.source_year: r for r in metrics.collect()}
    assert (got[2021].raw_rows, got[2021].exact_duplicates, got[2021].residential_mutations) == (4, 1, 2) and got[None].residential_mutations == 3
    found = spark.read.parquet(f"{tmp_path}/out/mutations")
    assert sorted((r.source_year, r.id_mutation, r.price_per_m2_raw) for r in found.collect()) == [(2021, "1", 6000.0), (2021, "2", 6000.0), (2022, "1", 6000.0)]
    assert spark.read.parquet(f"{tmp_path}/out/components").count() == 3


def _years(tmp_path, **rows):
    flat = "{id},{y}-03-04,Vente,300000,75115,75015,Appartement,50,2,p{id},2.3,48.8"
    for y, ids in rows.items():
        (tmp_path / f"{y[1:]}.csv").write_text("\n".join([HEAD, *(flat.format(id=i, y=y[1:]) for i in ids)]))


def test_a_second_run_writes_changed_years_alone(spark, tmp_path, monkeypatch):
    from arpent.operators import market

    monkeypatch.setattr(market, "check_schema", lambda rows: None)
    out = tmp_path / "out"
    files_of = lambda: {(t, y): sorted(p.name for p in (out / t / f"source_year={y}").glob("*.parquet")) for t in ("clean", "components", "mutations") for y in (2021, 2022)}
    _years(tmp_path, y2021=[1, 1, 2], y2022=[1])
    sources = {2021: (f"{tmp_path}/2021.csv", "a"), 2022: (f"{tmp_path}/2022.csv", "b")}
    runs.sales_run(spark, sources, str(out))
    first, wrote = files_of(), (out / "manifest").stat().st_mtime_ns
    again = {r.source_year: r.residential_mutations for r in runs.sales_run(spark, sources, str(out)).collect()}
    assert again == {2021: 2, 2022: 1, None: 3} and files_of() == first and (out / "manifest").stat().st_mtime_ns == wrote
    _years(tmp_path, y2022=[1, 5, 6, 6])
    (tmp_path / "2021.csv").unlink()  # an unchanged year is not read
    got = {r.source_year: r for r in runs.sales_run(spark, sources | {2022: (f"{tmp_path}/2022.csv", "c")}, str(out)).collect()}
    assert {y: (r.raw_rows, r.exact_duplicates, r.residential_mutations) for y, r in got.items()} == {2021: (3, 1, 2), 2022: (4, 1, 3), None: (7, 2, 5)}
    now = files_of()
    assert all((now[t, y] == first[t, y]) == (y == 2021) for t, y in now)
    assert spark.read.json(f"{out}/price_distribution").first()["count"] == 5
    said = "\n".join(r.value for r in spark.read.text(f"{out}/report").collect())
    assert "# Sales by year" in said and "# Prices per square metre" in said and "2022" in said


def test_a_failed_run_is_repeated(spark, tmp_path, monkeypatch):
    from arpent.operators import market, quality

    monkeypatch.setattr(market, "check_schema", lambda rows: None)
    _years(tmp_path, y2021=[1])
    sources, kept = {2021: (f"{tmp_path}/2021.csv", "a")}, quality.price_distribution
    monkeypatch.setattr(quality, "price_distribution", lambda rows: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        runs.sales_run(spark, sources, f"{tmp_path}/out")
    monkeypatch.setattr(quality, "price_distribution", kept)
    assert runs.sales_run(spark, sources, f"{tmp_path}/out").filter("source_year = 2021").first().residential_mutations == 1


def test_acquired_sales_run(spark, tmp_path, monkeypatch):
    import gzip

    from arpent.operators import market

    monkeypatch.setattr(market, "check_schema", lambda rows: None)
    _years(tmp_path, y2021=[1, 2], y2022=[3])
    asked = []

    def transport(url):
        asked.append(url)
        return 200, {}, gzip.compress((tmp_path / f"{url}.csv").read_bytes(), mtime=0)

    run = lambda: runs.acquired_sales_run(spark, transport, {2021: "2021", 2022: "2022"}, f"{tmp_path}/raw", f"{tmp_path}/out")
    assert {r.source_year: r.residential_mutations for r in run().collect()} == {2021: 2, 2022: 1, None: 3} and asked == ["2021", "2022"]
    assert run().count() == 3 and asked == ["2021", "2022"]  # known checksums are not fetched again


def test_diagnostics_run(spark, tmp_path):
    one = {"numero_dpe": "a", "date_etablissement_dpe": "2023-05-06", "etiquette_dpe": "C", "type_batiment": "appartement", "_id": "1"}
    (tmp_path / "s.json").write_text(json.dumps({"results": [one, {**one, "_id": "2"}, {**one, "numero_dpe": "b", "etiquette_dpe": "G"}]}))
    report = runs.diagnostics_run(spark, f"{tmp_path}/s.json", f"{tmp_path}/out").first()
    said = {(r.section, r.key): (r.value, r.text) for r in spark.read.json(f"{tmp_path}/out/sections").collect()}
    assert said["duplicates", "conflicting_duplicates"][0] == 1 and said["dpe_label", "G"][0] == 1 and said["building_type_observed", "appartement"][0] == 3
    assert said["totals", "districts_missing"] == (20, ",".join(map(str, range(1, 21)))) and said["establishment_date", "max"][1] == "2023-05-06"
    lines = [r.value for r in spark.read.text(f"{tmp_path}/out/markdown").collect()]
    assert lines[0] == "# Energy diagnostics" and "## Building type observed" in lines and "- appartement: 3" in lines
    assert report.processed_rows == 2 and spark.read.parquet(f"{tmp_path}/out/diagnostics").count() == 2
    assert files.snapshot(spark, f"{tmp_path}/s.json").count() == 3


@pytest.mark.parametrize("rows, failed", [([(1, "a"), (2, "b")], set()), ([(1, "a"), (2, "a"), (99, "c")], {"unique_keys", "rows_match_source", "districts_known"}), ([(None, "a"), (3, "d")], set())])
def test_stored_checks(spark, rows, failed):
    facts = spark.createDataFrame(rows, "arrondissement int, k string")
    got = {r.rule: r.passed for r in runs.stored_checks("x", facts, "k", spark.range(2), loading.dimension(spark)).collect()}
    assert {k for k, v in got.items() if not v} == failed and len(got) == 4
    named = facts.withColumnRenamed("k", loading.FORBIDDEN[0])
    assert not {r.rule: r.passed for r in runs.stored_checks("x", named, loading.FORBIDDEN[0], spark.range(2), loading.dimension(spark)).collect()}["no_address_columns"]
