"""The paged API as a source: what reaches the requests, what is repeated, and what is an error."""

import json

import pytest
from pyspark.sql import functions as F

from arpent.sources import paged

SCHEMA = "id long, city string, area double, new boolean"
ROWS = [{"id": i, "city": ("Paris", "paris", "Lyon")[i % 3], "area": i / 2 if i % 5 else "n/a", "new": i % 2 == 0, "unasked": "x" * 50} for i in range(95)]


@pytest.fixture
def api(tmp_path):
    (tmp_path / "rows.json").write_text(json.dumps(ROWS))
    return tmp_path


def source(spark, api, schema=SCHEMA, **more):
    return paged.paged(spark, schema, url=f"fake://{api}", transport="tests.fake_api:transport", size=10, pagesPerTask=3, pause=0.01, **more)


def asked(api):
    return [json.loads(x) for x in (api / "log").read_text().splitlines()]


def test_all_pages_in_ranges(spark, api):
    rows = source(spark, api)
    assert rows.rdd.getNumPartitions() == 4
    got = sorted(tuple(r) for r in rows.collect())
    assert got == [(r["id"], r["city"], r["area"] if r["id"] % 5 else None, r["new"]) for r in ROWS]
    pages = [a for a in asked(api) if "page" in a]
    assert {int(a["page"]) for a in pages} == set(range(1, 11)) and {a["select"] for a in pages} == {"id,city,area,new"}


def test_columns_and_filters_reach_the_request(spark, api):
    got = source(spark, api, "id long, city string").filter((F.col("city") == "Paris") & (F.col("id") >= 30)).filter(F.col("id").isin(30, 33, 36, 37)).collect()
    assert sorted(r.id for r in got) == [30, 33, 36] and {r.city for r in got} == {"Paris"}  # the server also gave "paris"
    last = [a for a in asked(api) if "page" in a][-1]
    assert last["select"] == "id,city"
    assert 'city:"Paris"' in last["qs"] and "id:>=30" in last["qs"] and "id:(30 OR 33 OR 36 OR 37)" in last["qs"]
    assert all(int(a["page"]) == 1 for a in asked(api)[-2:] if "page" in a)  # few rows are left, and few pages asked for


def test_fixed_filter_and_no_rows(spark, api):
    assert source(spark, api, filter='city:"Lyon"').count() == sum(r["city"] == "Lyon" for r in ROWS)
    assert source(spark, api).filter("city = 'nowhere'").count() == 0
    (api / "rows.json").write_text("[]")
    assert source(spark, api).count() == 0


def test_tasks_repeat_what_fails(spark, api):
    (api / "flaky").touch()
    assert source(spark, api).count() == 95
    pages = [int(a["page"]) for a in asked(api) if "page" in a]
    assert all(pages.count(p) == 2 for p in range(1, 11))


@pytest.mark.parametrize("fault, said", [("short", "page 2 should have 10 rows and has 9"), ("growing", "total went from 95 to 96")])
def test_missing_rows_are_errors(spark, api, fault, said):
    (api / fault).touch()
    with pytest.raises(Exception, match=said):
        source(spark, api).collect()


def test_values_become_the_columns_types():
    from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType

    cases = [
        (StringType(), [("a", "a"), (1, "1"), (True, "true"), (None, None), ([1], "[1]")]), (DoubleType(), [("1.5", 1.5), ("x", None), (float("nan"), None)]),
        (LongType(), [(2**62, 2**62), ("7", 7), (1.5, None), (2**63, None), (None, None)]), (IntegerType(), [(2**31, None), (5, 5)]), (BooleanType(), [("TRUE", True), (0, None)]),
    ]
    for kind, pairs in cases:
        assert [paged.converted(v, kind) for v, _ in pairs] == [w for _, w in pairs]


def test_unreadable_columns_are_refused(spark, api):
    with pytest.raises(Exception, match="none of the types"):
        source(spark, api, "id array<int>").collect()


def test_snapshots_are_whole_or_not_there(spark, api):
    folder = f"file://{api}/kept"
    take = lambda **more: paged.acquire(spark, SCHEMA, folder, url=f"fake://{api}", transport="tests.fake_api:transport", size=10, pause=0.01, **more)
    assert paged.whole_snapshot(spark, SCHEMA, folder) is None
    assert take().count() == 95
    n = len(asked(api))
    assert take().count() == 95 and len(asked(api)) == n  # nothing was asked again
    (api / "short").touch()
    with pytest.raises(Exception, match="page 2"):
        take(refresh=True)
    assert take().count() == 95  # the old one is still there
    (api / "short").unlink()
    (api / "rows.json").write_text(json.dumps(ROWS[:7]))
    assert take(refresh=True).count() == 7
    newest = sorted(p for p in (api / "kept").iterdir() if p.name.startswith("rows-"))[-1]
    next(newest.glob("*.parquet")).unlink()
    assert paged.whole_snapshot(spark, SCHEMA, folder) is None
