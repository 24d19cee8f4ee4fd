"""Sources: sale CSVs, diagnostic snapshots, Parquet with its profile, document and chunk files, registries.

Schemas are always given, never inferred; bad numbers and dates become null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from arpent.functions.columns import cleaned_id, number, percent
from arpent.operators import energy, market

SALE_IDS = (
    "id_mutation", "code_postal", "code_commune", "code_departement", "id_parcelle", "code_type_local",
    "adresse_code_voie", "numero_disposition",
)
SALE_NUMBERS = (
    "valeur_fonciere", "surface_reelle_bati", "nombre_pieces_principales", "surface_terrain", "longitude", "latitude",
    "nombre_lots",
)


def _strings(names) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def sales_csv(spark: SparkSession, path: str) -> DataFrame:
    """Gzipped or plain sale CSVs with a header, of any column order; typed. A gzip file is one task, so a cluster gets
    one file for each year and part."""
    header = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)  # names alone; all strings
    rows = header.select(*(F.col(c).cast("string").alias(c) for c in header.columns))
    typed = {c: cleaned_id(F.col(c)) for c in SALE_IDS if c in rows.columns}
    typed |= {c: number(F.col(c)) for c in SALE_NUMBERS if c in rows.columns}
    typed |= {"date_mutation": F.col("date_mutation").try_cast("date")} if "date_mutation" in rows.columns else {}
    return rows.withColumns(typed)


def checked_sales(spark: SparkSession, path: str, year: int, sha256: str) -> DataFrame:
    rows = sales_csv(spark, path)
    market.check_schema(rows)
    return market.with_lineage(rows, year, path, sha256)


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Diagnostic snapshots `{"results": [...]}`: a row for each result, absent fields null, strings also for numbers."""
    fields = _strings([*energy.STRINGS, *energy.NUMBERS, *energy.DATES])
    schema = f"results array<{fields.simpleString()}>"
    rows = spark.read.schema(schema).option("multiLine", True).option("primitivesAsString", True).json(path)
    rows = rows.select(F.explode("results").alias("r")).select("r.*")
    typed = {c: cleaned_id(F.col(c)) for c in energy.STRINGS} | {c: number(F.col(c)) for c in energy.NUMBERS}
    return rows.withColumns(typed | {c: F.to_date(F.col(c).try_cast("timestamp")) for c in energy.DATES})


def profile(rows: DataFrame, key: str) -> DataFrame:
    """One row for each column: its type, nulls and their share, and whether it is the key and unique. One pass."""
    names = rows.columns
    one = rows.agg(F.count("*").alias("_n"), F.count_distinct(key).alias("_d"), *(F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(names)))
    kinds = dict(rows.dtypes)
    long = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.col(f"c{i}").alias("n_null")) for i, c in enumerate(names)))).alias("x")
    return one.select("_n", "_d", long).select(
        "x.column", "x.type", "x.n_null", percent(F.col("x.n_null"), F.col("_n")).alias("pct_null"),
        F.when(F.col("x.column") == key, F.col("_d") == F.col("_n")).alias("is_unique_key"), F.col("x.type").rlike("^(array|map|struct)").alias("is_nested"),
    )


def asked(sql: str, values: dict, **views: DataFrame) -> DataFrame:
    """The answer to a SQL text over the given frames, which it names in braces, with values bound to its markers: `:name`.
    Values are never part of the text, so none can change what is asked."""
    return next(iter(views.values())).sparkSession.sql(sql, args=values, **views)


def footer_count(spark: SparkSession, path: str) -> int:
    """The number of rows of Parquet files as their footers tell it; no column is read."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own.read.parquet(path).count()


DOCUMENT = (
    "source_id string, title string, raw_sha256 string, total_characters int, "
    "elements array<struct<order:int,kind:string,text:string,page_number:int,heading_level:int>>"
)


def processed_documents(spark: SparkSession, path: str) -> DataFrame:
    """Processed documents with `consistent`, whether the announced number of characters is that of the elements."""
    docs = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    total = F.aggregate("elements", F.lit(0), lambda n, e: n + F.coalesce(F.length(e["text"]), F.lit(0)))
    return docs.withColumn("consistent", total.eqNullSafe(F.col("total_characters")))


def document_elements(docs: DataFrame) -> DataFrame:
    found = docs.select("source_id", "raw_sha256", F.explode("elements").alias("e"))
    return found.select("source_id", "raw_sha256", "e.*")


CHUNK = (
    "source_id string, chunk_index int, chunk_id string, text string, character_count int, word_count int, content_sha256 string, "
    "heading_path array<string>, page_start int, page_end int, quality_flags array<string>"
)


def chunk_corpus(spark: SparkSession, path: str, sources: list[str] | None = None) -> DataFrame:
    """Chunks from JSON lines, all or those of the given sources. Reading checks them: a source without chunks is an error
    at once; a file of several sources or without any, and chunks of a source that do not follow each other from 0, repeat
    an id or say more or fewer characters than they have, are errors with the source's name of whoever reads its rows."""
    chunks = spark.read.schema(CHUNK).json(path).withColumn("_file", F.input_file_name())
    if sources is not None:
        wanted = spark.createDataFrame([(s,) for s in sources], "source_id string")
        if gone := [r[0] for r in wanted.join(chunks, "source_id", "left_anti").collect()]:
            raise ValueError(f"no chunks of {sorted(gone)}")
        chunks = chunks.filter(F.col("source_id").isin(sources))
    by_file = chunks.groupBy("_file").agg(F.min("source_id").alias("_low"), F.max("source_id").alias("_high"))
    mixed = by_file.filter(~F.col("_low").eqNullSafe(F.col("_high"))).select(F.col("_file").alias("_mixed"))
    twice = chunks.groupBy("chunk_id").agg((F.count("*") > 1).alias("_twice")).filter("_twice")
    order = Window.partitionBy("source_id").orderBy("chunk_index")
    checked = chunks.withColumn("_place", F.row_number().over(order) - 1)  # a source's chunks are those of one document
    checked = checked.join(twice, "chunk_id", "left").join(mixed, F.col("_file") == F.col("_mixed"), "left")
    problem = (
        F.when(F.col("source_id").isNull(), "a chunk without a source")
        .when(F.col("_mixed").isNotNull(), F.concat(F.lit("several sources in one file: "), F.col("_file")))
        .when(F.coalesce("_twice", F.lit(False)), F.concat(F.lit("chunk id twice: "), F.col("chunk_id")))
        .when(~F.col("chunk_index").eqNullSafe(F.col("_place")), F.concat(F.lit("chunk indexes do not run from 0 without gaps at "), F.coalesce(F.col("chunk_index").cast("string"), F.lit("null"))))
        .when(~F.col("character_count").eqNullSafe(F.length("text")), F.concat(F.lit("other text than its count says: "), F.col("chunk_id")))
    )
    fails = F.raise_error(F.concat_ws(": ", F.coalesce("source_id", F.lit("?")), problem)).cast("string")
    checked = checked.withColumn("source_id", F.when(problem.isNotNull(), fails).otherwise(F.col("source_id")))
    return checked.select(*(c.split()[0] for c in CHUNK.split(", ")))


REGISTRY = (
    "source_id string, title string, publisher string, source_page_url string, download_url string, document_format string, "
    "enabled boolean, language string, topics array<string>"
)


def registry(spark: SparkSession, path: str, hosts: list[str]) -> DataFrame:
    """A JSON list of sources with `problem`, the first rule that an entry breaks, or null."""
    entries = spark.read.schema(REGISTRY).option("multiLine", True).json(path)
    twice = entries.groupBy("source_id").agg((F.count("*") > 1).alias("_twice"))
    host = F.lower(F.regexp_extract("download_url", r"^https://([^/:?#]+)", 1))
    problem = (
        F.when(~F.coalesce(F.col("source_id").rlike("^[a-z0-9][a-z0-9_-]*$"), F.lit(False)), "source_id")
        .when(F.col("_twice"), "repeated source_id")
        .when(F.trim(F.coalesce("title", F.lit(""))) == "", "title")
        .when(~F.coalesce(F.col("download_url").startswith("https://"), F.lit(False)), "not https")
        .when(~host.isin(hosts), "host")
    )
    return entries.join(twice, "source_id", "left").withColumn("problem", problem).drop("_twice")
