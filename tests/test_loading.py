import pytest

from arpent.operators import loading
from arpent.streaming import landing


def test_dimension(spark):
    rows = loading.dimension(spark).orderBy("arrondissement_number").collect()
    assert len(rows) == 20 and tuple(rows[0]) == (1, "75101", "75001", "Paris 1er")


def test_idempotent_load(spark, tmp_path):
    store = loading.Warehouse(spark, f"file://{tmp_path}")
    rows = spark.createDataFrame([("a", 2023), ("b", 2024)], "k string, source_year int")
    rules = [loading.Rule("source_year", "source_year BETWEEN 2021 AND 2025")]
    assert store.load("d", rows, "sha1", "k", rules, "source_year") == "succeeded"
    assert store.load("d", rows, "sha1", "k", rules) == "skipped"
    for bad, match in ((rows.union(rows), "repeats"), (spark.createDataFrame([("z", 1999)], rows.schema), "source_year: 1"), (spark.createDataFrame([(None, 2023)], rows.schema), "1 nulls")):
        with pytest.raises(loading.LoadError, match=match):
            store.load("d", bad, "sha2", "k", rules)
    with pytest.raises(loading.LoadError, match="address"):
        store.load("d", rows.withColumnRenamed("source_year", "adresse_numero"), "sha3", "k")
    assert store.current("d").count() == 2
    assert {r.status: r["count"] for r in store.audit().groupBy("status").count().collect()} == {"started": 5, "failed": 4, "succeeded": 1}


def test_orphans_and_keys(spark):
    facts = spark.createDataFrame([(1,), (9,), (None,)], "k int")
    assert [r.k for r in loading.orphans(facts, "k", spark.createDataFrame([(1,)], "id int"), "id").collect()] == [9]
    assert loading.repeated_keys(spark.createDataFrame([(1,), (1,)], "k int"), "k").first().n_repeated == 1


def test_index(spark):
    chunks = spark.createDataFrame([("a", "s", "1"), ("b", "s", "2"), ("c", "s", "3")], "chunk_id string, source_id string, content_sha256 string")
    known = spark.createDataFrame([("a", "s", "1", "m", 3), ("b", "s", "old", "m", 3), ("x", "s", "9", "m", 3), ("y", "t", "9", "m", 3)], "chunk_id string, source_id string, content_sha256 string, model string, dimensions int")
    need = loading.needs_embedding(chunks, known, "m", 3)
    assert {r.chunk_id for r in need.collect()} == {"b", "c"} and loading.needs_embedding(chunks, known, "m", 4).count() == 3
    stale = loading.stale_chunks(known, chunks, ["s"])
    assert [r.chunk_id for r in stale.collect()] == ["x"]
    new = known.filter("chunk_id = 'b'")
    assert {r.chunk_id for r in loading.synchronized(known, new, stale).collect()} == {"a", "b", "y"}
    made = loading.embed(chunks.withColumnRenamed("content_sha256", "text"), lambda t: [[float(len(x)), 0.0] for x in t], 2)
    assert made.count() == 3
    old, fresh = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), spark.createDataFrame([("b", 2)], "k string, v int")
    assert {tuple(r) for r in loading.merge_manifest(old, fresh, "k").collect()} == {("a", 1), ("b", 2)}


def test_landing(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "k string, v int")
    rows.write.parquet(f"{tmp_path}/in")
    store = loading.Warehouse(spark, f"{tmp_path}/store")
    for _ in range(2):
        landing.ingest(spark, f"{tmp_path}/in", rows.schema, store, "d", "k", f"{tmp_path}/state").awaitTermination(60)
    assert store.current("d_0").count() == 1


def test_stale_chunks_of_many_sources(spark, tmp_path):
    from arpent.plans import catalog

    docs = spark.range(1500).selectExpr("id * 100 AS doc_id", "concat('s', id) AS source", "concat('t', id) AS text")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.chunk_id for r in catalog.QUERIES["stale_chunks"](spark, str(tmp_path)).collect()}
    assert got == {f"old-{100 * k}" for k in range(1500)}


def test_entries_are_created_once(spark, tmp_path):
    """Of many that create one name at a time, one does; the file has the whole text of that one."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(8) as pool:
        for n in range(5):
            won = list(pool.map(lambda k: loading.created(spark, f"file://{tmp_path}/log/{n}.json", f'{{"k": {k}}}' + " " * 10_000), range(8)))  # noqa: B023
            assert won.count(True) == 1
            assert (tmp_path / f"log/{n}.json").read_text().startswith(f'{{"k": {won.index(True)}}}')
    assert sorted(p.name for p in (tmp_path / "log").iterdir() if not p.name.endswith(".crc")) == [f"{n}.json" for n in range(5)]


@pytest.mark.parametrize("same", [True, False])
def test_loads_that_end_at_one_time(spark, tmp_path, monkeypatch, same):
    """Both have passed all checks before either is published: of one checksum one is loaded, of two both, in one order."""
    import threading

    own, both = loading.Warehouse(spark, f"file://{tmp_path}/w"), threading.Barrier(2)
    publish = loading.Warehouse._publish

    def together(self, *args):
        both.wait(60)
        return publish(self, *args)

    monkeypatch.setattr(loading.Warehouse, "_publish", together)
    done = {}
    rows = lambda k: spark.createDataFrame([(k, "a"), (k + 1, "b")], "k long, v string")
    load = lambda name, k, sha: done.update({name: own.load("sales", rows(k), sha, "k")})
    threads = [threading.Thread(target=load, args=("one", 1, "x")), threading.Thread(target=load, args=("two", 1 if same else 5, "x" if same else "y"))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    log = own.published("sales")
    assert sorted(done.values()) == (["skipped", "succeeded"] if same else ["succeeded", "succeeded"])
    assert [e["number"] for e in log] == ([1] if same else [1, 2]) and own.is_loaded("sales", "x") and own.is_loaded("sales", "y") != same
    last = log[-1]["sha256"]
    assert sorted(r.k for r in own.current("sales").collect()) == ([1, 2] if last == "x" else [5, 6])
    monkeypatch.undo()
    assert own.load("sales", rows(9), "x", "k") == "skipped" and own.load("sales", rows(9), "z", "k") == "succeeded"
    assert sorted(r.k for r in own.current("sales").collect()) == [9, 10] and own.published("sales")[-1]["number"] == len(log) + 1
    notes = [r.status for r in own.audit().collect()]
    assert notes.count("skipped") == (1 if same else 0) and notes.count("succeeded") == len(log) + 1
