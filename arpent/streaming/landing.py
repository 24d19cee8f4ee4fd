"""Continuous ingestion of a landing folder: every micro-batch is one idempotent load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from arpent.operators.loading import Rule, Warehouse


def ingest(spark: SparkSession, landing: str, schema: StructType, warehouse: Warehouse, dataset: str, key: str, checkpoint: str, rules: list[Rule] = ()) -> StreamingQuery:
    """Load Parquet files as they arrive; each batch becomes a dataset `<dataset>_<batch>`. The batch number is the
    checksum, so a batch that is repeated after a failure is not loaded twice."""

    def load(batch: DataFrame, number: int) -> None:
        warehouse.load(f"{dataset}_{number}", batch, f"batch-{number}", key, rules)

    return spark.readStream.schema(schema).parquet(landing).writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

