"""Runs over a document corpus: raw pages to elements, elements to chunks, chunks to an index. Each run repeats no work on
what did not change, gives every source a status of its own, and reads what it stored before it says so.

What a run adds is appended under its own number, and the manifest says which number holds each source, so a run writes
only what it made and readers see the last whole manifest."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arpent.functions.html_elements import page_elements
from arpent.operators import chunking, loading
from arpent.operators.chunking import Sizes

#: Fixed value: documents with fewer characters are no documents.
LEAST_CHARACTERS = 200

STATE = ("processed_sha256", "raw_sha256", "chunking_version", "configuration", "output_sha256")
MANIFEST = (
    "source_id string, status string, error string, processed_sha256 string, raw_sha256 string, chunking_version string, configuration string, "
    "output_sha256 string, output_run long, chunk_count long, character_count long, minimum_chunk_size int, average_chunk_size double, "
    "maximum_chunk_size int, quality_flags array<string>"
)


def _last(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the highest run below a folder; none before the first."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException:  # nothing was stored so far
        return spark.createDataFrame([], schema + ", run long")
    return found.filter(F.col("run") == found.agg(F.max("run")).first()[0])


def enough_content(elements: DataFrame, least: int = LEAST_CHARACTERS, key: str = "source_id") -> DataFrame:
    """key, characters, enough for documents whose elements are rows."""
    found = elements.groupBy(key).agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("characters"))
    return found.withColumn("enough", F.col("characters") >= least)


def raw_status(registered: DataFrame, manifest: DataFrame, files: DataFrame, processed: DataFrame) -> DataFrame:
    """source_id, sha256, status, error of each registered source: what can be said before its text is read. Status is
    "failed", "unchanged" (processed from the same bytes) or null for those to be processed. Columns: manifest source_id,
    status, sha256; files source_id, sha256; processed source_id, raw_sha256."""
    noted = manifest.select("source_id", F.col("status").alias("_noted"), F.col("sha256").alias("_promised"), F.lit(True).alias("_known"))
    there = files.select("source_id", "sha256")
    done = processed.select("source_id", F.col("raw_sha256").alias("_done"))
    found = registered.select("source_id").join(noted, "source_id", "left").join(there, "source_id", "left").join(done, "source_id", "left")
    error = (
        F.when(F.col("_known").isNull(), "no manifest entry")
        .when(F.col("_noted") == "failed", "failed before")
        .when(F.col("sha256").isNull(), "no file")
        .when(F.col("_promised") != F.col("sha256"), "checksum differs")
    )
    status = F.when(error.isNotNull(), "failed").when(F.col("_done") == F.col("sha256"), "unchanged")
    return found.select("source_id", "sha256", status.alias("status"), error.alias("error"))


def document_run(spark: SparkSession, registered: DataFrame, manifest: DataFrame, pages: DataFrame, out: str, least: int = LEAST_CHARACTERS, force: bool = False) -> DataFrame:
    """Processes HTML pages (source_id, html as stored) into documents of elements below `out`; source_id, status
    (processed, unchanged, failed), error, characters of every registered source. Stored documents are those of the last
    run for each source: `documents(spark, out)`. Forced, a run also processes what did not change."""
    run = time.time_ns()
    pages = pages.withColumn("sha256", F.sha2("html", 256))
    state = raw_status(registered, manifest, pages, documents(spark, out))
    if force:
        state = state.withColumn("status", F.when(F.col("status") != "unchanged", F.col("status")))
    todo = pages.join(state.filter("status IS NULL").select("source_id"), "source_id", "left_semi")
    found = page_elements(todo, "source_id")
    element = F.struct("order", "kind", "text", "heading_level", F.lit(None).cast("int").alias("page_number"))
    made = found.groupBy("source_id").agg(F.array_sort(F.collect_list(element)).alias("elements"), F.sum(F.length("text")).alias("total_characters"))
    made = todo.select("source_id", F.col("sha256").alias("raw_sha256")).join(made, "source_id").filter(F.col("total_characters") >= least)
    made.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(f"{out}/documents")
    stored = spark.read.parquet(f"{out}/documents").filter(F.col("run") == run).select("source_id", F.col("total_characters").alias("characters"))
    told = state.join(stored, "source_id", "left")
    is_new, was_made = F.col("status").isNull(), F.col("characters").isNotNull()
    return told.select(
        "source_id", F.when(is_new & was_made, "processed").when(is_new, "failed").otherwise(F.col("status")).alias("status"),
        F.when(is_new & ~was_made, "too short").otherwise(F.col("error")).alias("error"), F.coalesce("characters", F.lit(0)).alias("characters"),
    )


def documents(spark: SparkSession, out: str) -> DataFrame:
    """The processed documents, of each source the latest: source_id, raw_sha256, elements, total_characters."""
    try:
        found = spark.read.parquet(f"{out}/documents")
    except AnalysisException:  # nothing was processed so far
        return spark.createDataFrame([], f"source_id string, raw_sha256 string, elements {chunking.ELEMENTS}, total_characters long")
    last = found.groupBy("source_id").agg(F.max("run").alias("run"))  # a few bytes a source; the elements follow by a join
    return found.join(last, ["source_id", "run"], "left_semi").drop("run")


def unchanged_sources(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """The rows of `current` whose source a manifest holds as not failed and with the same document, raw bytes, version,
    configuration and stored output; nulls equal nothing, so a missing output is a change."""
    state = manifest.filter(F.col("status") != "failed").select("source_id", *STATE)
    return current.join(state, ["source_id", *STATE], "left_semi")


def output_digests(chunks: DataFrame) -> DataFrame:
    """source_id, output_sha256, and the sizes of its chunks; the digest is over chunk ids and text hashes in order. A row
    of the list has 130 bytes, whatever the chunk's text."""
    item = F.struct("chunk_index", F.concat("chunk_id", F.sha2("text", 256)).alias("mark"))
    n = F.col("character_count")
    return chunks.groupBy("source_id").agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["mark"]), ","), 256).alias("output_sha256"),
        F.count("*").alias("chunk_count"), F.sum(n).alias("character_count"), F.min(n).alias("minimum_chunk_size"), F.round(F.avg(n), 2).alias("average_chunk_size"),
        F.max(n).alias("maximum_chunk_size"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("quality_flags")))).alias("quality_flags"),
        ((F.max("chunk_index") == F.count("*") - 1) & (F.count_distinct("chunk_index") == F.count("*"))).alias("contiguous"),
    )


def _stored_chunks(spark: SparkSession, root: str) -> DataFrame:
    try:
        found = spark.read.schema(f"{chunking.OUTCOME}, run long").parquet(f"{root}/chunks")
    except AnalysisException:  # nothing was stored so far
        found = spark.createDataFrame([], f"{chunking.OUTCOME}, run long")
    return found.filter("error IS NULL").drop("error")


def chunk_manifest(spark: SparkSession, root: str) -> DataFrame:
    """A row for each source, in order of source_id."""
    return _last(spark, f"{root}/manifest", MANIFEST).drop("run").orderBy("source_id")


def corpus(spark: SparkSession, root: str) -> DataFrame:
    """The chunks that the manifest names, in order of source and index."""
    named = _last(spark, f"{root}/manifest", MANIFEST).filter(F.col("status") != "failed").select("source_id", F.col("output_run").alias("run"))
    return _stored_chunks(spark, root).join(named, ["source_id", "run"], "left_semi").drop("run").orderBy("source_id", "chunk_index")


def configuration(sizes: Sizes) -> str:
    return json.dumps(asdict(sizes), sort_keys=True)


def chunking_run(spark: SparkSession, docs: DataFrame, root: str, sizes: Sizes = Sizes(), force: bool = False) -> DataFrame:
    """Chunks what is new or changed in `docs` (source_id, raw_sha256, elements), verifies what was stored by reading it
    again, and writes a manifest that keeps the entries of other sources. Status: chunked, updated, unchanged or failed.
    A source without text fails alone, and so do one that cannot be chunked and one whose stored chunks have gaps. Returns
    the new manifest."""
    run = time.time_ns()
    old = _last(spark, f"{root}/manifest", MANIFEST).drop("run")
    stored = _stored_chunks(spark, root).join(old.select("source_id", F.col("output_run").alias("run")), ["source_id", "run"], "left_semi")
    mark = {"chunking_version": F.lit(sizes.version), "configuration": F.lit(configuration(sizes))}
    work = docs.select("source_id", "raw_sha256", "elements", F.sha2(F.to_json("elements"), 256).alias("processed_sha256")).withColumns(mark)
    now = work.drop("elements").join(output_digests(stored).select("source_id", "output_sha256"), "source_id", "left")
    same = unchanged_sources(now, old).select("source_id")
    todo = work if force else work.join(same, "source_id", "left_anti")
    chunking.chunk_outcomes(todo, sizes).withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(f"{root}/chunks")
    written = spark.read.schema(f"{chunking.OUTCOME}, run long").parquet(f"{root}/chunks").filter(F.col("run") == run)
    made = output_digests(written.filter("error IS NULL"))
    faults = written.filter("error IS NOT NULL").groupBy("source_id").agg(F.min("error").alias("_fault"))
    before = old.filter("output_run IS NOT NULL").select("source_id", F.lit(True).alias("_before"))
    good = F.col("chunk_count").isNotNull() & F.coalesce("contiguous", F.lit(False))
    entries = todo.drop("elements").join(made, "source_id", "left").join(before, "source_id", "left").join(faults, "source_id", "left").select(
        "source_id", F.when(~good, "failed").when(F.col("_before"), "updated").otherwise("chunked").alias("status"),
        F.when(F.col("chunk_count").isNull(), F.coalesce("_fault", F.lit("no text"))).when(~good, "indexes have gaps").alias("error"),
        *STATE, F.when(good, F.lit(run)).alias("output_run"), "chunk_count", "character_count", "minimum_chunk_size", "average_chunk_size", "maximum_chunk_size", "quality_flags",
    )
    if not force:
        kept = old.join(same, "source_id", "left_semi").withColumns({"status": F.lit("unchanged"), "error": F.lit(None).cast("string")})
        entries = entries.unionByName(kept)
    whole = loading.merge_manifest(old, entries, "source_id")
    whole.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(f"{root}/manifest")
    return chunk_manifest(spark, root)


def corpus_totals(manifest: DataFrame) -> DataFrame:
    """One row over the sources that did not fail."""
    good = manifest.filter(F.col("status") != "failed")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c.split('_')[0]}s")
    return good.agg(F.count("*").alias("total_sources"), total("chunk_count"), total("character_count"))


def embedding_summary(chunks: DataFrame, known: DataFrame, model: str, dimensions: int, force: bool = False) -> DataFrame:
    """One row: chunks in all, how many are to be embedded, stay as they are and leave the index, and how many sources."""
    one = lambda df, name, *more: df.agg(F.count("*").alias(name), *more)
    whole = one(chunks, "total_chunks", F.count_distinct("source_id").alias("source_count"))
    pending = one(loading.needs_embedding(chunks, known, model, dimensions, force), "embedded_chunks")
    gone = one(loading.stale_chunks(known, chunks, chunks), "deleted_stale_chunks")
    found = whole.crossJoin(pending).crossJoin(gone)  # three frames of one row
    return found.select(
        "total_chunks", "embedded_chunks", (F.col("total_chunks") - F.col("embedded_chunks")).alias("unchanged_chunks"), "deleted_stale_chunks", "source_count",
        F.lit(model).alias("model"), F.lit(dimensions).alias("dimensions"),
    )


def embedding_run(
    chunks: DataFrame, known: DataFrame, provider: Callable[[list[str]], list[list[float]]], model: str, dimensions: int, out: str, batch: int = 64, force: bool = False
) -> DataFrame:
    """Embeds what is new or changed and writes the synchronized index to `out`, another folder than the one that `known`
    comes from; returns the summary. An empty corpus and repeated chunk ids are errors."""
    n, ids = chunks.agg(F.count("*"), F.count_distinct("chunk_id")).first()
    if n == 0 or n != ids:
        raise loading.LoadError("the corpus is empty" if n == 0 else "the corpus repeats chunk ids")
    pending = loading.needs_embedding(chunks, known, model, dimensions, force)
    state = pending.select("chunk_id", "source_id", "content_sha256").withColumns({"model": F.lit(model), "dimensions": F.lit(dimensions)})
    new = state.join(loading.embed(pending, provider, dimensions, batch), "chunk_id")
    loading.synchronized(known, new.select(*known.columns), loading.stale_chunks(known, chunks, chunks)).write.mode("error").parquet(out)
    return embedding_summary(chunks, known, model, dimensions, force)


def grouped_citations(citations: DataFrame, answer: str, position: str = "position") -> DataFrame:
    """Citations of an answer by source: answer, place (of the first mention), url, title, publisher, references and
    sections, both without blanks or repeats in order of mention. Columns: url, source_id, title, publisher, citation_id,
    section. A source is known by its url, else by its id."""
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    key = F.coalesce(filled("url"), filled("source_id"), F.lit("source")).alias("_key")
    row = F.struct(F.col(position).alias("at"), "url", "title", "publisher", F.trim("citation_id").alias("ref"), F.trim("section").alias("section")).alias("row")
    groups = citations.select(answer, key, row).groupBy(answer, "_key").agg(F.array_sort(F.collect_list("row")).alias("rows"))  # as many as one answer cites

    def unique(field: str) -> Column:
        return F.array_distinct(F.filter(F.transform("rows", lambda r: r[field]), lambda x: F.coalesce(x, F.lit("")) != ""))

    first = F.get("rows", F.lit(0))
    return groups.select(
        answer, first["at"].alias("place"), first["url"].alias("url"), F.coalesce(first["title"], F.lit("Source officielle")).alias("title"),
        F.coalesce(first["publisher"], F.lit("")).alias("publisher"), unique("ref").alias("references"), unique("section").alias("sections"),
    )


#: Fixed value: how an answer begins that its context does not carry.
INSUFFICIENT = "[INSUFFICIENT_CONTEXT]"


def checked_answers(answers: DataFrame, text: str) -> DataFrame:
    """answers with `insufficient` and, in the text's place, the answer without the mark; blank answers become null."""
    trimmed = F.regexp_replace(F.col(text), r"^\s+|\s+$", "")
    marked = trimmed.startswith(INSUFFICIENT)
    rest = F.regexp_replace(F.substr(trimmed, F.lit(len(INSUFFICIENT) + 1)), r"^[ :\n]+", "")
    bare = F.when(marked, rest).otherwise(trimmed)
    return answers.withColumns({"insufficient": F.coalesce(marked, F.lit(False)), text: F.when(bare != "", bare)})
