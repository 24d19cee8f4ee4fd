"""Exact cosine retrieval: top-k with a filter, for one question or many at once, abstention, and the bounded context of an
answer."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arpent.functions.columns import similarity


def checked_query(vector: list[float], dimensions: int, k: int, most: int = 20) -> None:
    if len(vector) != dimensions or not all(isinstance(x, int | float) and math.isfinite(x) for x in vector):
        raise ValueError(f"a query has {dimensions} finite components")
    if not 1 <= k <= most:
        raise ValueError(f"k is 1 to {most}")


def top_k(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", embedding: str = "embedding", most: int = 20) -> DataFrame:
    """The k rows most similar to the query, with similarity and rank; ties by key. Every task keeps only its own k.
    Null vectors and those of another length are left out."""
    dims = len(query)
    checked_query(query, dims, k, most)
    literal = F.array(*(F.lit(float(x)) for x in query))
    found = vectors.withColumn("similarity", similarity(F.col(embedding), literal)).filter(F.col("similarity").isNotNull())
    top = found.orderBy(F.desc("similarity"), key).limit(k)
    order = Window.orderBy(F.desc("similarity"), F.col(key))  # over k rows
    return top.withColumn("rank", F.row_number().over(order))


#: Bytes of a block of vectors and of a block of questions; a pair of blocks is one matrix product.
VECTOR_BYTES, QUESTION_BYTES = 4_000_000, 250_000
#: Rows that are Python's lists at a time while blocks are packed.
SLICE = 500
#: By how much two ways to sum a product may differ.
NEAR = 1e-9


def _blocks(rows: DataFrame, key: str, embedding: str, dimensions: int, most: int, names: tuple[str, str]) -> DataFrame:
    """Vectors of the right length, finite and not zero, packed by partition into blocks of about `most` bytes."""
    size = max(1, most // (8 * dimensions))

    def run(batches):
        keys, held = [], []

        def out(n: int) -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([keys[:n]], kind), pa.array([b"".join(held[:n])], pa.binary())], names=list(names))
            del keys[:n], held[:n]
            return batch

        for batch in batches:
            kind = pa.list_(batch.schema.field(0).type)
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                for k, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if v is None or len(v) != dimensions or None in v or not all(map(math.isfinite, v)) or not any(v):
                        continue
                    keys.append(k)
                    held.append(np.array(v, np.float64).tobytes())
                while len(held) >= size:
                    yield out(size)
        if held:
            yield out(size)

    schema = f"{names[0]} array<{rows.schema[key].dataType.simpleString()}>, {names[1]} binary"
    return rows.select(key, F.col(embedding).cast("array<double>")).mapInArrow(run, schema)


#: Questions whose products with a block of vectors are held at a time.
TOGETHER = 32


def nearest(names: list, q: np.ndarray, keys: np.ndarray, v: np.ndarray, k: int, but_itself: bool = False) -> Iterator[tuple]:
    """name, key, cosine: for each of the questions q its k nearest of a block of vectors v."""
    q_norm, v_norm = np.sqrt((q * q).sum(1)), np.sqrt((v * v).sum(1))
    unit = v / v_norm[:, None]
    for lo in range(0, len(names), TOGETHER):
        near = (q[lo : lo + TOGETHER] / q_norm[lo : lo + TOGETHER, None]) @ unit.T
        for j, name in enumerate(names[lo : lo + TOGETHER]):
            row = np.where(keys == name, -np.inf, near[j]) if but_itself else near[j]
            least = np.partition(row, -k)[-k] if len(row) > k else -np.inf
            rows = np.flatnonzero((row >= least - NEAR) & (row > -np.inf))
            cosine = np.clip((v[rows] * q[lo + j]).sum(1) / (v_norm[rows] * q_norm[lo + j]), -1.0, 1.0)
            order = np.lexsort((keys[rows], -cosine))[:k]
            yield from ((name, x, c) for x, c in zip(keys[rows][order].tolist(), cosine[order].tolist(), strict=True))


def top_k_of_many(questions: DataFrame, vectors: DataFrame, k: int, dimensions: int, question: str = "question_id", key: str = "vec_id", embedding: str = "embedding", but_itself: bool = False) -> DataFrame:
    """question, key, similarity, rank: for every question the k rows most similar to it; ties by key. Questions and rows
    meet in blocks, by one matrix product each, of which every question keeps its own k; the blocks' choices are ranked
    in the end, also by k before they are shuffled. What the product leaves in doubt is computed anew, row by row, so
    equal vectors are equally similar wherever they lie. Null vectors, zeros and those that are not finite or of another
    length are left out, as questions and as rows. but_itself: a row of the question's own key is no answer."""
    if k < 1:
        raise ValueError("k is 1 at least")
    asked = _blocks(questions, question, embedding, dimensions, QUESTION_BYTES, ("q_keys", "q_data"))
    held = _blocks(vectors, key, embedding, dimensions, VECTOR_BYTES, ("v_keys", "v_data"))

    def best(batches):
        for batch in batches:
            for at in range(batch.num_rows):  # a pair at a time, its vectors where they lie in the batch
                pair = {c: batch.column(c)[at] for c in batch.schema.names}
                q, v = (np.frombuffer(pair[c].as_buffer(), np.float64).reshape(-1, dimensions) for c in ("q_data", "v_data"))
                out = list(nearest(pair["q_keys"].as_py(), q, np.array(pair["v_keys"].as_py()), v, k, but_itself))
                if out:
                    names, found, cosines = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(found), pa.array(cosines, pa.float64())], names=[question, key, "similarity"])

    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((questions, question), (vectors, key))]
    found = held.crossJoin(asked).mapInArrow(best, f"{', '.join(kinds)}, similarity double")  # blocks, not rows
    order = Window.partitionBy(question).orderBy(F.desc("similarity"), key)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def or_abstain(hits: DataFrame, threshold: float = 0.42) -> DataFrame:
    """The hits, or none of them if even the best is below the threshold."""
    best = hits.agg(F.max("similarity").alias("_best"))
    return hits.crossJoin(F.broadcast(best)).filter(F.col("_best") >= threshold).drop("_best")


def grounded_context(hits: DataFrame, budget: int = 12_000, least: int = 200) -> DataFrame:
    """rank, text of the hits that fit in a budget of characters: a hit that overruns it is cut, and nothing follows a
    cut one or a rest below `least`. Over as many rows as there are hits."""
    w = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))
    left = F.lit(budget) - used
    return hits.withColumn("_left", left).filter(F.col("_left") >= least).withColumn("text", F.expr("left(text, _left)")).drop("_left")


def citations(answers: DataFrame, text: str, n_hits: str) -> DataFrame:
    """answers with `cited`, the distinct source numbers in order of mention, and `valid`, whether all of them exist."""
    cited = F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(r"\[S(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int")))
    answers = answers.withColumn("cited", cited)
    return answers.withColumn("valid", (F.size("cited") > 0) & F.forall("cited", lambda x: (x >= 1) & (x <= F.col(n_hits))))
