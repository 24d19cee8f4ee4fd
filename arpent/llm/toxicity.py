"""Toxicity by compression distance: two zstandard dictionaries and calibrated thresholds.

One dictionary is trained on windows of ordinary texts, one on windows of toxic texts, both as they are. Each window of a
text, WORDS words, is compressed with both; a window that the ordinary dictionary finds hard - more bytes a byte of text
than a HARD share of ordinary windows take - gains by the bytes that the toxic dictionary saves. How many windows gain at
least each of MARGINS, the largest and the mean gain and the number of windows go through a logistic curve, calibrated on
labelled documents that the dictionaries have not seen. The parser is zstandard's optimal one: greedy ones miss matches
at random, which hides what a dictionary knows.

Fitting takes a bounded sample of the labelled rows, drawn by hash: documents up to SAMPLE_TOXIC and SAMPLE_PLAIN, and of
two thirds of them windows up to WINDOWS_TOXIC and WINDOWS_PLAIN, whatever the texts' lengths; the other third calibrates
by its whole texts. Windows come to the driver for the dictionaries, of the calibrating documents only the features. What
is hard is told by all windows of the ordinary documents that are learned from, drawn for the dictionary or not.
Scoring takes whole texts of all rows.

Defined results: null and empty texts have no windows and get the curve's score for none; equal texts get equal scores;
labels that repeat an id count once, as toxic if any of them says so; repeated rows of one id are each a row of the
sample; without labels of both kinds every score is 0; other columns are left alone.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arpent.llm.bpe import slices
from arpent.llm.common import drop, frugal, stored

SAMPLE_TOXIC, SAMPLE_PLAIN, WINDOWS_TOXIC, WINDOWS_PLAIN = 6000, 9000, 80_000, 120_000
#: Words of a window, and bytes of the dictionaries: ordinary text is more varied, and what the ordinary dictionary lacks
#: of it looks like a gain.
WORDS, PLAIN_BYTES, TOXIC_BYTES = 8, 524_288, 131_072
HARD, MARGINS = 0.65, (2, 3, 4, 5, 6, 8)
#: What the ordinary documents count together in calibration, against the toxic ones: equal weight, whatever their numbers.
ODDS = 1.0
PREDICT_FROM = 0.7


def windows(text: str | None) -> list[bytes]:
    words = (text or "").lower().split()
    return [f" {' '.join(words[i : i + WORDS])} ".encode("utf-8", "surrogatepass") for i in range(0, len(words), WORDS)]


@dataclass
class Model:
    plain: bytes
    toxic: bytes
    hard: float
    weights: list[float]


def _presser(dictionary: bytes):
    params = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_BTOPT, window_log=20, hash_log=18, chain_log=19, search_log=4, min_match=4, target_length=32,
        write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=params).compress


class Scorer:
    """A model with its two compressors."""

    def __init__(self, model: Model):
        self.model, self.plain, self.toxic = model, _presser(model.plain), _presser(model.toxic)

    def gains(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each window of each text the bytes that the toxic dictionary saves, 0 where ordinary text makes it easy. One
        dictionary after the other goes over all windows, as each fills the processor's cache."""
        of = [windows(t) for t in texts]
        every = [w for x in of for w in x]
        plain, toxic = self.plain, self.toxic
        size = np.array([len(plain(w)) for w in every], np.int64)
        hard = np.flatnonzero(size >= self.model.hard * np.array([len(w) for w in every]))
        saved = np.zeros(len(every), np.int64)
        saved[hard] = size[hard] - np.array([len(toxic(every[k])) for k in hard.tolist()], np.int64)
        return np.split(saved, np.cumsum([len(x) for x in of])[:-1]) if of else []

    def features(self, texts: list[str | None]) -> np.ndarray:
        rows = [[1.0, *(float((g >= m).sum()) for m in MARGINS), float(g.max(initial=0)), float(g.mean()) if len(g) else 0.0, float(len(g))] for g in self.gains(texts)]
        x = np.array(rows).reshape(-1, len(MARGINS) + 4)
        counts = [*range(1, len(MARGINS) + 1), -1]
        x[:, counts] = np.log1p(x[:, counts])
        return x

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.model.weights:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ np.array(self.model.weights), -30, 30)))


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size] or b"\0" * 8


def dictionaries(toxic: list[bytes], plain: list[bytes]) -> Model:
    """A model without hardness and curve from windows of both kinds."""
    return Model(_dictionary(plain, PLAIN_BYTES), _dictionary(toxic, TOXIC_BYTES), 0.0, [])


def quantile(counts: list[tuple[float, int]], at: float) -> float:
    """The quantile of values that occur so often each, between the two neighbours of its rank; 0 of none."""
    if not counts:
        return 0.0
    x, n = (np.array(c) for c in zip(*sorted(counts), strict=True))
    upto = np.cumsum(n)
    rank = (upto[-1] - 1) * at
    low, high = (x[np.searchsorted(upto, r, side="right")] for r in (math.floor(rank), math.ceil(rank)))
    return float(low + (high - low) * (rank - math.floor(rank)))


def hardness(ordinary: DataFrame, plain: bytes) -> float:
    """What a HARD share of all windows of the ordinary texts (t) stays below in compressed bytes a byte. Tasks count windows
    by their two lengths, and these counts alone come to the driver."""

    def run(batches):
        press, found = presser_of(plain), Counter()
        for batch in slices(batches, "t"):
            found.update((len(press(w)), len(w)) for t in batch.column("t").to_pylist() for w in windows(t))
        if found:
            each = [pa.array(c, pa.int64()) for c in (*zip(*found, strict=True), found.values())]
            yield pa.RecordBatch.from_arrays(each, names=["packed", "bytes", "n"])

    counted = ordinary.select("t").mapInArrow(frugal(run), "packed long, bytes long, n long").groupBy("packed", "bytes").agg(F.sum("n").alias("n"))
    return quantile([(r["packed"] / r["bytes"], r["n"]) for r in counted.collect()], HARD)


def curve(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Weights of a logistic regression with a small ridge; the ordinary rows count ODDS times what the toxic ones count together."""
    middle, spread = x.mean(0), x.std(0)
    middle[0], spread = 0, np.where(spread > 1e-9, spread, 1)
    z, weight = (x - middle) / spread, np.where(y > 0, 1.0, ODDS * y.sum() / (1 - y).sum())
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        bend = (z * (weight * p * (1 - p))[:, None]).T @ z + 0.5 * np.eye(len(w))
        w = w + np.linalg.solve(bend, z.T @ (weight * (y - p)) - 0.5 * w)
    w = w / spread
    w[0] -= w @ middle
    return w.tolist()


def _sample(docs: DataFrame, labels: DataFrame, may_learn: Column, key: str, text: str, toxic: str) -> DataFrame:
    """key, text, y, held of the labelled documents that are learned from. The sample is drawn from the labels by hash, so
    only its ids, at most SAMPLE_TOXIC + SAMPLE_PLAIN, are broadcast to find the texts."""
    known = labels.filter(F.col(toxic).isNotNull() & F.col(key).isNotNull() & may_learn).groupBy(key).agg((F.max(toxic) > 0).alias("y"))
    drawn = lambda y, n: known.filter(F.col("y") == y).orderBy(F.xxhash64(key), key).limit(n)
    ids = drawn(True, SAMPLE_TOXIC).unionByName(drawn(False, SAMPLE_PLAIN))
    ids = ids.select(F.col(key).alias("k"), "y", (F.pmod(F.xxhash64(key, F.lit("held")), F.lit(3)) == 0).alias("held"))
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(ids), "k")


def _windows_of(sample: DataFrame, toxic: bool, most: int) -> list[bytes]:
    """Windows of the sampled documents of one kind, drawn by hash."""

    def run(batches):
        for batch in slices(batches, "t"):
            for k, t in zip(batch.column("k").to_pylist(), batch.column("t").to_pylist(), strict=True):
                w = windows(t)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(w), pa.int64()), pa.array(range(len(w)), pa.int64()), pa.array(w, pa.binary())], names=["k", "at", "w"])

    found = sample.filter(F.col("y") == toxic).select("k", "t").mapInArrow(frugal(run), "k long, at long, w binary")
    return [bytes(r["w"]) for r in found.orderBy(F.xxhash64("k", "at"), "k", "at", "w").limit(most).select("w").collect()]


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, key: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """Fit on a sample of the labelled documents that may be learned from."""
    sample = stored(_sample(docs.withColumn(key, F.col(key).cast("long")), labels, may_learn, key, text, toxic), "labelled")
    kinds = {(r["y"], r["held"]) for r in sample.select("y", "held").distinct().collect()}
    if len({y for y, _ in kinds}) < 2:
        drop(sample)
        return Model(b"\0" * 8, b"\0" * 8, 0.0, [])
    enough = len(kinds) == 4  # else there are too few to keep any apart
    learn, held = (sample.filter("NOT held"), sample.filter("held")) if enough else (sample, sample)
    bad, good = _windows_of(learn, True, WINDOWS_TOXIC), _windows_of(learn, False, WINDOWS_PLAIN)
    model = dictionaries(bad, good or [b" "])
    model.hard = hardness(learn.filter("NOT y"), model.plain)

    def run(batches):
        own = scorer_of(model)
        for batch in slices(batches, "t"):
            x = own.features(batch.column("t").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

    rows = held.select("y", "t").mapInArrow(frugal(run), "y boolean, x array<double>").collect()
    rows = sorted((bool(r["y"]), list(r["x"])) for r in rows)
    model.weights = curve(np.array([x for _, x in rows]), np.array([y for y, _ in rows], float))
    drop(sample)
    return model


_pressers: dict[bytes, Callable[[bytes], bytes]] = {}


def presser_of(dictionary: bytes) -> Callable[[bytes], bytes]:
    """One compressor for each worker process and dictionary."""
    if dictionary not in _pressers:
        _pressers.clear()
        _pressers[dictionary] = _presser(dictionary)
    return _pressers[dictionary]


_scorers: dict[tuple, Scorer] = {}


def scorer_of(model: Model) -> Scorer:
    """One scorer for each worker process and model."""
    name = zlib.crc32(model.plain), zlib.crc32(model.toxic), model.hard, tuple(model.weights)
    if name not in _scorers:
        _scorers.clear()
        _scorers[name] = Scorer(model)
    return _scorers[name]


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, predicted for every document."""

    def run(batches):
        own = scorer_of(model)
        for batch in slices(batches, text):
            out = own.scores(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out), pa.array((out >= PREDICT_FROM).astype(np.int32))], names=[key, "score", "predicted"])

    return docs.select(key, text).mapInArrow(frugal(run), f"{key} {docs.schema[key].dataType.simpleString()}, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs that the model does not predict as toxic, in one pass and without a join."""

    def run(batches):
        own = scorer_of(model)
        for batch in slices(batches, text):
            yield batch.filter(pa.array(own.scores(batch.column(text).to_pylist()) < PREDICT_FROM))

    return docs.mapInArrow(frugal(run), docs.schema)
