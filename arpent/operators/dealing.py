"""How many partitions rows are dealt over: as many as the files they come from call for, so that what a task holds does not
grow with the input. Spark's own number is fixed, and adaptive execution joins partitions by their compressed bytes in the
shuffle, which for rows of repeated values are many times fewer than the bytes in memory.

Up to so many partitions as `spark.shuffle.sort.bypassMergeThreshold` says, a task that deals rows writes each to its
partition's file at once. Above it, it first holds all it deals in memory, up to a whole split of the files, which is far more than
what a partition takes; so that number is not left before partitions are large themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of files for a partition, and the fewest that a small input is split for, up to one partition for each core.
PARTITION_BYTES, LEAST_BYTES = 4_000_000, 1_000_000
#: Bytes of files from which on a partition takes no more, though rows are then held in memory while they are dealt.
MOST_BYTES = 40_000_000
#: Bytes of files up to which a join is left to Spark, which may broadcast its smaller side.
JOIN_BYTES = 64_000_000


def source_bytes(rows: DataFrame) -> int | None:
    """Bytes of the tables below rows, as Spark estimates them; None where it knows no size."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    unknown = int(rows.sparkSession._jsparkSession.sessionState().conf().defaultSizeInBytes())
    return None if any(s >= unknown for s in sizes) else sum(sizes)


def partitions(rows: DataFrame, size: int) -> int:
    """Over how many partitions files of so many bytes are dealt."""
    written_at_once = int(rows.sparkSession.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    return max(1, -(-size // MOST_BYTES), min(written_at_once, -(-size // PARTITION_BYTES)))


def dealt(rows: DataFrame, *keys: str, finer: int = 1) -> DataFrame:
    """rows by hash of the keys; those of no known size over the session's number of partitions. finer: how many times less of
    the files a partition takes, for rows that are wide against them."""
    size = source_bytes(rows)
    if size is None:
        return rows.repartition(*keys)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(partitions(rows, size * finer), min(cores, -(-size // LEAST_BYTES))), *keys)


def dealt_alike(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join by hash of their keys, over as many partitions as both call for together, so that the join takes
    them as they are. Sides of no known size, and small ones, stay as they were."""
    sizes = source_bytes(left), source_bytes(right)
    if None in sizes or sum(sizes) <= JOIN_BYTES:
        return left, right
    n = partitions(left, sum(sizes))
    return left.repartition(n, left_key), right.repartition(n, right_key)
