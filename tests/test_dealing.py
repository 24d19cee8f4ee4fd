"""Rows are dealt over partitions by the size of what they come from, so that a task's share does not grow with the input."""

from pyspark.sql import functions as F

from arpent.operators import dealing, energy, market
from arpent.sources.adapters import raw_sales


def test_partitions_follow_the_files(spark, tmp_path, monkeypatch):
    spark.range(4000).select(
        (F.col("id") % 5).cast("int").alias("source_year"), F.sha2((F.col("id") % 3000).cast("string"), 256).alias("id_mutation"), (F.col("id") % 3000 % 7).alias("x"),
    ).filter("id_mutation IS NOT NULL").write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    size = dealing.source_bytes(rows)
    assert size > 100_000 and dealing.source_bytes(rows.join(rows.select("id_mutation"), "id_mutation")) == 2 * size
    for part, expected in ((size // 9, 10), (size // 30, 31), (10 * size, 1)):
        monkeypatch.setattr(dealing, "PARTITION_BYTES", part)
        assert abs(dealing.dealt(rows, *market.KEY).rdd.getNumPartitions() - expected) <= 1  # the session's number is 4
    monkeypatch.setattr(dealing, "PARTITION_BYTES", size // 9)
    assert market.without_duplicates(rows).rdd.getNumPartitions() >= 9 and market.counted_rows(rows).rdd.getNumPartitions() >= 9
    assert market.without_duplicates(rows).exceptAll(rows.distinct()).count() == 0 and market.without_duplicates(rows).count() == rows.distinct().count()
    newest = energy.newest(rows, "id_mutation", "source_year", "x")
    assert newest.rdd.getNumPartitions() >= 9 and newest.count() == newest.select("id_mutation").distinct().count() == 3000


def test_a_diagnostics_task_takes_as_much_of_large_files_as_of_small_ones(spark, tmp_path, monkeypatch):
    """Small inputs are split for each core down to LEAST_BYTES; large ones no coarser."""
    spark.range(30_000).select(
        F.concat(F.lit("d"), F.col("id") % 9000).alias("numero_dpe"), F.expr("date_add(date'2024-01-01', cast(id % 700 as int))").alias("date_etablissement_dpe"),
        F.sha2(F.col("id").cast("string"), 256).alias("_id"),
    ).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    size = dealing.source_bytes(rows)
    share = {}
    for parts in (3, 40):  # a session of 4 cores: fewer and many more than those
        monkeypatch.setattr(dealing, "LEAST_BYTES", size // parts)
        monkeypatch.setattr(dealing, "PARTITION_BYTES", 4 * (size // parts))
        found = energy.newest(rows)
        share[parts] = (size / found.rdd.getNumPartitions()) / (size / parts)
        assert found.count() == 9000
    assert all(x <= 1.1 for x in share.values()), share


def test_rows_are_not_held_in_memory_while_they_are_dealt(spark, sf_dir, tmp_path, monkeypatch):
    """Above 200 partitions Spark's writer keeps a whole split of the files in memory; partitions grow instead, up to MOST_BYTES."""
    spark.range(20_000).select((F.col("id") % 5).cast("int").alias("source_year"), F.col("id").cast("string").alias("id_mutation")).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    size, join_size = dealing.source_bytes(rows), dealing.source_bytes(raw_sales(spark, sf_dir))
    monkeypatch.setattr(dealing, "JOIN_BYTES", 0)
    for share, expected in ((501, 200), (1990, 200), (2400, 240)):  # as many shares of PARTITION_BYTES as the files have
        monkeypatch.setattr(dealing, "PARTITION_BYTES", size / share)
        monkeypatch.setattr(dealing, "MOST_BYTES", 10 * size / share)
        assert abs(dealing.partitions(rows, size) - expected) <= 1
    monkeypatch.setattr(dealing, "PARTITION_BYTES", size // 501)
    monkeypatch.setattr(dealing, "MOST_BYTES", size // 40)
    assert market.without_duplicates(rows).rdd.getNumPartitions() == 200 and market.without_duplicates(rows).count() == 20_000
    assert energy.newest(rows, "id_mutation", "source_year", "source_year").rdd.getNumPartitions() == 200
    monkeypatch.setattr(dealing, "PARTITION_BYTES", join_size // 501)
    monkeypatch.setattr(dealing, "MOST_BYTES", join_size // 40)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert raw_sales(spark, sf_dir).rdd.getNumPartitions() == 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_of_no_known_size(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "source_year int, id_mutation string")
    assert dealing.source_bytes(rows) is None and market.without_duplicates(rows).count() == 2
    assert dealing.dealt(spark.range(0), "id").count() == 0


def test_joins_follow_the_files(spark, sf_dir, monkeypatch):
    plain = raw_sales(spark, sf_dir)
    size = dealing.source_bytes(plain)
    monkeypatch.setattr(dealing, "JOIN_BYTES", 0)
    for wanted in (9, 31):
        monkeypatch.setattr(dealing, "PARTITION_BYTES", size // wanted)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            rows = raw_sales(spark, sf_dir)
            assert abs(rows.rdd.getNumPartitions() - wanted) <= 1  # the session's number is 4
            assert rows.exceptAll(plain).count() == 0 and rows.count() == plain.count()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.undo()
    ids, none = spark.range(3), spark.createDataFrame([(1,)], "id long")
    assert dealing.dealt_alike(ids, none, "id", "id") == (ids, none)  # no size is known


def test_joins_keep_what_has_no_partner(spark, tmp_path):
    tables = {
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double", [(1, 1, 1, 1, 5.0), (1, 9, 1, 2, 5.0), (2, 1, 1, 1, 5.0), (3, 1, 1, 1, 5.0), (None, 1, 1, 1, 5.0), (1, None, 1, 3, 5.0)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string", [(1, 1, "F", 10.0, "1996-01-01"), (2, 7, "F", 10.0, "1996-01-01"), (4, 1, "F", 10.0, "1996-01-01"), (None, 1, "F", 10.0, "1996-01-01")]),
        "customer": ("c_custkey long, c_nationkey int", [(1, 3), (1, 4), (None, 5)]),
        "part": ("p_partkey long, p_type string", [(1, "ECONOMY TIN"), (None, "SMALL TIN")]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    found = raw_sales(spark, str(tmp_path)).collect()
    keys = sorted((r.id_mutation, r.code_commune, r.type_local or "", r.nombre_pieces_principales) for r in found)
    of_one = sorted(("1", c, t, n) for c in ("75104", "75105") for t, n in (("Appartement", 1.0), ("", 2.0), ("", 3.0)))
    assert keys == [*of_one, ("2", "92050", "Appartement", 1.0)]  # repeated and unknown customers and parts, orders that are not there
