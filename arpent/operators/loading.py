"""Integrity checks, the idempotent load of a snapshot, and the index synchronisation that works the same way.

A load is idempotent by the checksum of its source: a checksum that has succeeded is not loaded again. A snapshot is
written beside the current one, checked, and only then published as the next entry of a numbered log, so a failure at any
point leaves the previous snapshot readable. An entry's file is created whole and exclusively: of loads that end at one
time one gets the number, the others look again at what was published and take the next, or find their checksum there."""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

COMMIT = "number long, load_id string, sha256 string, path string, loaded_rows long"
AUDIT = "load_id string, dataset string, sha256 string, status string, source_rows long, loaded_rows long, path string, at timestamp, notes string"


class LoadError(RuntimeError):
    """A snapshot that failed its checks."""


def orphans(facts: DataFrame, key: str, dimension: DataFrame, other: str) -> DataFrame:
    """Rows whose key is not null and not in the dimension."""
    return facts.filter(F.col(key).isNotNull()).join(dimension.select(F.col(other).alias(key)), key, "left_anti")


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    """One row: n, and by how much rows outnumber distinct keys."""
    return rows.agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct(key)).alias("n_repeated"))


def dimension(spark: SparkSession, most: int = 20) -> DataFrame:
    """The district dimension, computed."""
    n = F.col("id").cast("int")
    return spark.range(1, most + 1).select(
        n.alias("arrondissement_number"), F.format_string("751%02d", n).alias("insee_code"), F.format_string("750%02d", n).alias("postal_code"),
        F.concat(F.lit("Paris "), n.cast("string"), F.when(n == 1, "er").otherwise("e")).alias("name"),
    )


@dataclass(frozen=True)
class Rule:
    """A constraint: rows for which the condition is false break it; null passes, as in a CHECK."""

    name: str
    condition: str


def broken_rules(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """rule, n_broken for every rule, in one pass."""
    one = rows.agg(*(F.count_if(~F.expr(r.condition)).alias(f"r{i}") for i, r in enumerate(rules)))
    long = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.col(f"r{i}").alias("n_broken")) for i, r in enumerate(rules)))).alias("x")
    return one.select(long).select("x.rule", "x.n_broken")


SALES_RULES = [
    Rule("source_year", "source_year BETWEEN 2021 AND 2025"),
    Rule("arrondissement", "arrondissement BETWEEN 1 AND 20"),
    Rule("latitude", "latitude BETWEEN -90 AND 90"),
    Rule("longitude", "longitude BETWEEN -180 AND 180"),
]
ENERGY_RULES = [
    Rule("label", "etiquette_dpe_norm IN ('A', 'B', 'C', 'D', 'E', 'F', 'G')"),
    Rule("ges_label", "etiquette_ges_norm IN ('A', 'B', 'C', 'D', 'E', 'F', 'G')"),
    Rule("population", "analysis_population IN ('dwelling_unit', 'whole_building', 'unknown')"),
    Rule("arrondissement", "arrondissement BETWEEN 1 AND 20"),
]
#: Address columns that must never be loaded.
FORBIDDEN = (
    "adresse_numero", "adresse_suffixe", "adresse_nom_voie", "adresse_code_voie", "adresse_ban", "adresse_brut", "numero_voie_ban", "numero_rue_ban", "nom_rue_ban",
)


def forbidden_columns(rows: DataFrame) -> list[str]:
    return sorted(set(rows.columns) & set(FORBIDDEN))


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path):
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def created(spark: SparkSession, path: str, text: str) -> bool:
    """Whether a file of this text was created; false if there is one. It is written under a hidden name and then gets its
    own, which in one step fails if that is taken: by a link on a local file system, else by a rename."""
    jvm, where = spark.sparkContext._jvm, _path(spark, path)
    hidden = _path(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    files = _files(spark, where)
    out = files.create(hidden)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if files.getScheme() == "file":
            own, other = (jvm.java.io.File(p.toUri().getPath()).toPath() for p in (where, hidden))
            jvm.java.nio.file.Files.createLink(own, other)
        else:
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(hidden, where, none)
        return True
    except Py4JJavaError as problem:
        if "FileAlreadyExists" in problem.java_exception.getClass().getName():
            return False
        raise
    finally:
        files.delete(hidden, False)


class Warehouse:
    """Snapshots of datasets below one folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def audit(self) -> DataFrame:
        try:
            return self.spark.read.schema(AUDIT).json(f"{self.root}/audit")
        except AnalysisException:  # nothing was loaded so far
            return self.spark.createDataFrame([], AUDIT)

    def _note(self, load_id: str, dataset: str, sha256: str, status: str, source: int | None, loaded: int | None, path: str, notes: str | None) -> None:
        """A file for each note, so that loads at one time do not meet in a folder's commit."""
        now = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
        row = {"load_id": load_id, "dataset": dataset, "sha256": sha256, "status": status, "source_rows": source, "loaded_rows": loaded, "path": path, "at": now, "notes": notes}
        created(self.spark, f"{self.root}/audit/{load_id}-{status}.json", json.dumps(row, ensure_ascii=False))

    def published(self, dataset: str) -> list[dict]:
        """The entries of a dataset's log by number; one for each load that succeeded."""
        where = _path(self.spark, self._log(dataset))
        if not _files(self.spark, where).exists(where):
            return []
        return [r.asDict() for r in self.spark.read.schema(COMMIT).json(self._log(dataset)).orderBy("number").collect()]

    def _log(self, dataset: str) -> str:
        return f"{self.root}/log/{dataset}"

    def _publish(self, dataset: str, load_id: str, sha256: str, path: str, rows: int) -> bool:
        """Whether the snapshot got an entry; not if one of its checksum was published meanwhile."""
        while True:
            log = self.published(dataset)
            if any(e["sha256"] == sha256 for e in log):
                return False
            number = log[-1]["number"] + 1 if log else 1
            entry = {"number": number, "load_id": load_id, "sha256": sha256, "path": path, "loaded_rows": rows}
            if created(self.spark, f"{self._log(dataset)}/{number:012d}.json", json.dumps(entry)):
                return True

    def is_loaded(self, dataset: str, sha256: str) -> bool:
        return any(e["sha256"] == sha256 for e in self.published(dataset))

    def current(self, dataset: str) -> DataFrame:
        """The snapshot that was published last: that of the greatest number."""
        log = self.published(dataset)
        if not log:
            raise LoadError(f"{dataset} has no snapshot")
        return self.spark.read.parquet(log[-1]["path"])

    def load(self, dataset: str, rows: DataFrame, sha256: str, key: str, rules: list[Rule] = (), partition_by: str | None = None) -> str:
        """"skipped", or "succeeded" after all checks; raises LoadError and leaves the previous snapshot otherwise."""
        if self.is_loaded(dataset, sha256):
            return "skipped"
        load_id = uuid.uuid4().hex
        path = f"{self.root}/{dataset}/{load_id}"
        self._note(load_id, dataset, sha256, "started", None, None, path, None)
        try:
            if bad := forbidden_columns(rows):
                raise LoadError(f"address columns {bad}")
            writer = rows.write.mode("error")
            (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
            staged = self.spark.read.parquet(path)
            n, nulls, repeated = staged.agg(F.count("*"), F.count_if(F.col(key).isNull()), F.count(key) - F.count_distinct(key)).first()
            if nulls or repeated:
                raise LoadError(f"{key}: {nulls} nulls, {repeated} repeats")
            if rules and (broken := broken_rules(staged, list(rules)).filter("n_broken > 0").collect()):
                raise LoadError("; ".join(f"{r['rule']}: {r['n_broken']}" for r in broken))
        except Exception as problem:
            self._note(load_id, dataset, sha256, "failed", None, None, path, str(problem)[:500])
            raise
        if not self._publish(dataset, load_id, sha256, path, n):
            _files(self.spark, _path(self.spark, path)).delete(_path(self.spark, path), True)
            self._note(load_id, dataset, sha256, "skipped", n, None, path, "loaded meanwhile")
            return "skipped"
        self._note(load_id, dataset, sha256, "succeeded", n, n, path, None)
        return "succeeded"


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, bytes for every file below the path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def merge_manifest(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Entries of both; where both have a key, the new one's."""
    rest = old.join(new.select(key), key, "left_anti")
    return rest.unionByName(new)


def needs_embedding(chunks: DataFrame, known: DataFrame, model: str, dimensions: int, force: bool = False) -> DataFrame:
    """Chunks that are new, or whose text, model or dimensions changed; all of them if forced."""
    if force:
        return chunks
    state = known.select("chunk_id", F.col("content_sha256").alias("_sha"), F.col("model").alias("_model"), F.col("dimensions").alias("_dims"))
    same = F.col("_sha").eqNullSafe(F.col("content_sha256")) & F.col("_model").eqNullSafe(F.lit(model)) & F.col("_dims").eqNullSafe(F.lit(dimensions))
    return chunks.join(state, "chunk_id", "left").filter(~same).drop("_sha", "_model", "_dims")


def stale_chunks(known: DataFrame, chunks: DataFrame, sources: DataFrame | list[str]) -> DataFrame:
    """What the index holds of the sources though the corpus no longer does. Many sources are given as a frame with a
    source_id."""
    if isinstance(sources, DataFrame):
        own = known.join(sources.select("source_id"), "source_id", "left_semi").select(*known.columns)
    else:
        own = known.filter(F.col("source_id").isin(sources))
    return own.join(chunks.select("chunk_id"), "chunk_id", "left_anti")


def synchronized(known: DataFrame, embedded: DataFrame, stale: DataFrame) -> DataFrame:
    """The index after an update: without the stale, and with the embedded in place of those of equal id."""
    gone = stale.select("chunk_id").unionByName(embedded.select("chunk_id"))
    return known.join(gone, "chunk_id", "left_anti").unionByName(embedded)


def embed(chunks: DataFrame, provider: Callable[[list[str]], list[list[float]]], dimensions: int, batch: int = 64) -> DataFrame:
    """chunk_id, embedding; the provider gets texts in batches, on the executors."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch]
                vectors = provider(part["text"].tolist())
                if len(vectors) != len(part) or any(len(v) != dimensions for v in vectors):
                    raise ValueError("the provider returned another number of vectors or dimensions")
                yield pd.DataFrame({"chunk_id": part["chunk_id"], "embedding": vectors})

    return chunks.select("chunk_id", "text").mapInPandas(run, "chunk_id string, embedding array<float>")
