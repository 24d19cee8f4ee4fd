"""Document fingerprints: quartile bucket digests of hashed byte triplets.

The digest counts three byte triplets from every window of four bytes in 128 buckets, writes for each bucket the
quartile that its count falls in (two bits), and puts the length and the ratios of the quartiles before that. Two
digests differ by a bounded score; likeness is 1 for equal digests and 0 from BOUND on.

Defined results: a null text is the empty text; texts too short for a window have digests of their length alone; equal
texts have equal digests. Documents are ordered by descending key, then by the text's hash; null keys come last.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arpent.llm.bpe import slices

BUCKETS = 128
#: Difference from which two digests count as unlike: a little above that of independent digests.
BOUND = 256
#: Upper bounds of what length and quartile ratios add to a difference.
MOST_LENGTH, MOST_RATIO = 48, 16
_rng = np.random.RandomState(20240229)
#: One random byte table for each place in a triplet; a triplet's bucket is the exclusive or of its three entries.
TABLES = np.stack([_rng.permutation(256).astype(np.uint8) & (BUCKETS - 1) for _ in range(9)])
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
_STEP = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]], np.int64)


def fingerprint(text: str | None) -> str:
    """70 hexadecimal digits: length, two quartile ratios, 128 quartile codes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.zeros(BUCKETS, np.int64)
    if len(raw) >= 4:
        b = np.frombuffer(raw, np.uint8)
        n = len(b) - 3
        for k, (i, j, m) in enumerate(TRIPLETS):
            t = TABLES[3 * k : 3 * k + 3]
            counts += np.bincount(t[0][b[i : i + n]] ^ t[1][b[j : j + n]] ^ t[2][b[m : m + n]], minlength=BUCKETS)
    order = np.sort(counts)
    q1, q2, q3 = (int(order[BUCKETS * k // 4 - 1]) for k in (1, 2, 3))
    codes = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).astype(np.uint8).reshape(-1, 4)
    body = codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]
    length = min(255, int(math.log1p(len(raw)) / math.log(1.1)))
    ratios = (15 * q1 // q3) << 4 | 15 * q2 // q3 if q3 else 0
    return f"{length:02x}{ratios:02x}" + body.tobytes().hex()


def difference(a: str, b: str) -> int:
    """0 for equal digests, at most 6 * BUCKETS + MOST_LENGTH + MOST_RATIO."""
    if a == b:
        return 0
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    own = min(MOST_LENGTH, 2 * abs(int(x[0]) - int(y[0])))
    own += min(MOST_RATIO, abs((int(x[1]) >> 4) - (int(y[1]) >> 4)) + abs((int(x[1]) & 15) - (int(y[1]) & 15)))
    for shift in (6, 4, 2, 0):
        own += int(_STEP[(x[2:] >> shift) & 3, (y[2:] >> shift) & 3].sum())
    return own


def likeness(a: str, b: str) -> float:
    return max(0.0, 1.0 - difference(a, b) / BOUND)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: key, n_chars, fingerprint."""

    def run(batches):
        for batch in slices(batches, text):
            texts = [x or "" for x in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array([len(t) for t in texts], pa.int64()), pa.array([fingerprint(t) for t in texts], pa.string())],
                names=[key, "n_chars", "fingerprint"],
            )

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, n_chars long, fingerprint string")


def _bucket_of(key: str, bounds: list[float]):
    """How many of the sorted bounds are at most the key: a binary search with steps of halving size; -1 for null."""
    if not bounds:
        return F.when(F.col(key).isNull(), -1).otherwise(0)
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    array = f"array({', '.join(f'{x!r}D' for x in bounds)})"
    return F.expr(
        f"CASE WHEN {key} IS NULL THEN -1 ELSE aggregate(array({', '.join(map(str, steps))}), 0, (at, step) -> "
        f"CASE WHEN at + step <= {len(bounds)} AND get({array}, at + step - 1) <= {key} THEN at + step ELSE at END) END"
    )


def in_order(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, text and `tail`, in partitions that hold runs of the descending order of keys. After each run stands, as a
    tail, the row that follows it in the whole order; the first row follows the last.

    The runs are cut at quantiles of the key, eight for each shuffle partition; only these bounds and the runs' largest
    keys come to the driver. One shuffle moves the texts."""
    spark = docs.sparkSession
    runs = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(docs.approxQuantile(key, [k / runs for k in range(1, runs)], 0.25 / runs) or []))
    docs = docs.select(key, text).withColumn("run", _bucket_of(key, bounds))
    tops = sorted(((r["run"], r["top"]) for r in docs.groupBy("run").agg(F.max(key).alias("top")).collect()), reverse=True)
    follows = [(top, tops[i - 1][0]) for i, (_, top) in enumerate(tops)]  # the row of this key ends the run before
    kind = docs.schema[key].dataType.simpleString()
    ends = spark.createDataFrame(follows, f"top {kind}, before int")
    docs = docs.join(F.broadcast(ends), F.col(key).eqNullSafe(F.col("top")), "left")
    own = F.struct(F.col("run").alias("run"), F.lit(False).alias("tail"))
    tail = F.struct(F.col("before").alias("run"), F.lit(True).alias("tail"))
    at = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, tail))
    docs = docs.select(key, text, F.explode(at).alias("at")).select(key, text, "at.run", "at.tail")
    return docs.repartition("run").sortWithinPartitions(F.desc("run"), "tail", F.desc_nulls_last(key), F.xxhash64(text))


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document the digests of itself and of an edited text, whose last half comes from the next document."""

    def row(key_value, text, own, after, after_print):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        edited_print = fingerprint(edited)
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return key_value, len(text), sha, own, edited_print, likeness(own, edited_print), likeness(own, after_print)

    def run(batches):
        held = run_held = None
        for batch in slices(batches, text):
            out = []
            for k, t, number, tail in zip(*(batch.column(c).to_pylist() for c in (key, text, "run", "tail")), strict=True):
                t = t or ""
                own = fingerprint(t)
                if held is not None and run_held == number:
                    out.append(row(*held, t, own))
                held, run_held = (None if tail else (k, t, own)), number
            if out:
                arrays = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    docs = docs.withColumn(key, F.col(key).cast("long"))
    return in_order(docs, key, text).mapInArrow(
        run, f"{key} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
