"""A paged JSON API as a Spark source: `spark.read.format("paged_api")`.

The API answers `{"total": n, "results": [...]}` to a size and the number of a page. Planning asks for the total alone;
each task then reads a range of pages on its own and repeats what fails, so neither the driver nor a task holds more than
a page. The schema given to the reader is what is asked for (`select`); filters on its columns go to the server, and
Spark applies them again, as a server may match more loosely. A page that is shorter or longer than the total says, or a
total that changes while pages are read, is an error, so a scan has all rows or fails.

Options: `url`; `size` of a page (10000); `pagesPerTask` (8); `filter`, a condition that always holds; `transport`, the
"module:function" that fetches an url (https by default); `pause`, the first pause in seconds before a repeat (1.0); and
the names of the parameters: `sizeName` (size), `pageName` (page), `selectName` (select), `filterName` (qs).

Values of other types than the schema's are cast; what cannot be is null. Fields that a row lacks are null.
"""

from __future__ import annotations

import importlib
import json
import math
import time
from collections.abc import Iterator, Sequence
from urllib.parse import urlencode

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructType

from arpent.sources.fetch import FetchError, Transport, get

COMPARED = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
TO_ARROW = {StringType: pa.string(), DoubleType: pa.float64(), LongType: pa.int64(), IntegerType: pa.int32(), BooleanType: pa.bool_()}


def _literal(value) -> str | None:
    """A value as it stands in a condition; None for those that no condition takes."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int | float):
        return repr(value)
    if isinstance(value, str):
        return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return None


def condition(f: Filter) -> str | None:
    """A pushed filter in the server's language, or None if it has no form there."""
    if not isinstance(f, (EqualTo, In, *COMPARED)) or len(f.attribute) != 1:
        return None
    name = f.attribute[0]
    if isinstance(f, In):
        values = [_literal(v) for v in f.value]
        return f"{name}:({' OR '.join(values)})" if values and None not in values else None
    value = _literal(f.value)
    return value and f"{name}:{COMPARED.get(type(f), '')}{value}"


def converted(value, kind: DataType):
    """A JSON value as one of the column's type; null if it is none."""
    if value is None or isinstance(kind, StringType):
        return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    if isinstance(kind, BooleanType):
        return value if isinstance(value, bool) else {"true": True, "false": False}.get(str(value).lower())
    try:
        number = float(value)
    except (TypeError, ValueError):
        return None
    if isinstance(kind, DoubleType):
        return None if math.isnan(number) else number
    most = 2**31 if isinstance(kind, IntegerType) else 2**63
    if isinstance(value, int):
        return value if -most <= value < most else None
    return int(number) if number.is_integer() and -most <= number < most else None


class Pages(InputPartition):
    """Pages first to last, and how many rows and pages there are in all."""

    def __init__(self, first: int, last: int, total: int):
        self.first, self.last, self.total = first, last, total


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        for f in schema.fields:
            if type(f.dataType) not in TO_ARROW:
                raise ValueError(f"{f.name}: {f.dataType.simpleString()} is none of the types that a page gives")
        self.schema, self.conditions = schema, [options["filter"]] if options.get("filter") else []
        self.url, self.size, self.pages_per_task = options["url"], int(options.get("size", 10000)), int(options.get("pagesPerTask", 8))
        self.transport, self.pause = options.get("transport", "arpent.sources.fetch:https"), float(options.get("pause", 1.0))
        self.names = {k: options.get(f"{k}Name", d) for k, d in (("size", "size"), ("page", "page"), ("select", "select"), ("filter", "qs"))}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if (own := condition(f)) is not None:
                self.conditions.append(own)
            yield f  # the server may match more than equal values

    def _ask(self, **parameters) -> dict:
        if self.conditions:
            parameters["filter"] = self.conditions[0] if len(self.conditions) == 1 else " AND ".join(f"({c})" for c in self.conditions)
        mark = "&" if "?" in self.url else "?"
        url = self.url + mark + urlencode({self.names[k]: v for k, v in sorted(parameters.items())})
        module, name = self.transport.split(":")
        transport: Transport = getattr(importlib.import_module(module), name)
        payload = json.loads(get(transport, url, time.sleep, first=self.pause)[1])
        if not isinstance(payload, dict) or not isinstance(payload.get("total"), int):
            raise FetchError(f"{url} announces no total")
        return payload

    def partitions(self) -> Sequence[Pages]:
        total = self._ask(size=0)["total"]
        pages = math.ceil(total / self.size)
        step = self.pages_per_task
        return [Pages(p, min(p + step - 1, pages), total) for p in range(1, pages + 1, step)] or [Pages(1, 0, 0)]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        names = self.schema.fieldNames()
        for page in range(partition.first, partition.last + 1):
            payload = self._ask(size=self.size, page=page, select=",".join(names))
            rows, due = payload.get("results"), min(self.size, partition.total - (page - 1) * self.size)
            if payload["total"] != partition.total:
                raise FetchError(f"{self.url}: the total went from {partition.total} to {payload['total']}")
            if not isinstance(rows, list) or len(rows) != due:
                raise FetchError(f"{self.url}: page {page} should have {due} rows and has {len(rows) if isinstance(rows, list) else 'none'}")
            columns = [pa.array([converted(r.get(f.name), f.dataType) for r in rows], TO_ARROW[type(f.dataType)]) for f in self.schema.fields]
            yield pa.RecordBatch.from_arrays(columns, names=names)


class PagedApi(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_api"

    def schema(self) -> str:
        raise ValueError("give the columns to ask for by .schema(...)")

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedApi)


def paged(spark: SparkSession, schema: str, **options) -> DataFrame:
    """The rows of a paged API."""
    register(spark)
    return spark.read.format("paged_api").schema(schema).options(**options).load()


def acquire(spark: SparkSession, schema: str, folder: str, refresh: bool = False, **options) -> DataFrame:
    """The rows of a paged API from a snapshot in a folder that all machines share. Without a whole snapshot there, or to
    refresh it, all pages are written as Parquet under a new name; the manifest that names it is written last, so readers
    see the old rows or the new ones, and a run that fails leaves what was there."""
    if not refresh and (there := whole_snapshot(spark, schema, folder)) is not None:
        return there
    rows, name = paged(spark, schema, **options), f"rows-{time.time_ns()}"
    rows.write.parquet(f"{folder}/{name}")
    told = _marks(spark.read.schema(schema).parquet(f"{folder}/{name}")).withColumns({"rows_in": F.lit(name), "written_at": F.lit(time.time_ns())})
    told.write.mode("append").json(f"{folder}/manifest")
    return spark.read.schema(schema).parquet(f"{folder}/{name}")


def _marks(rows: DataFrame) -> DataFrame:
    """One row: the number of rows, and a checksum that does not depend on their order."""
    return rows.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("checksum"))


def whole_snapshot(spark: SparkSession, schema: str, folder: str) -> DataFrame | None:
    """The newest snapshot of a folder if its rows are those that its manifest tells of."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    told = spark.read.schema("n_rows long, checksum string, rows_in string, written_at long").json(f"{folder}/manifest").orderBy(F.desc("written_at")).first()
    if told is None:
        return None
    rows = spark.read.schema(schema).parquet(f"{folder}/{told.rows_in}")
    return rows if tuple(_marks(rows).first()) == (told.n_rows, told.checksum) else None
