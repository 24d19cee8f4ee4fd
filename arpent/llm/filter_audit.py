"""How filters work together: what each removes, alone and in every order, by part and by label.

FILTERS are five conditions on which a text fails: A few words, B few different words, C many capitals, D odd signs, E a
copy of a smaller key's text. A row fails a set of them, one of 32. A table made once says for each set and each of the
120 orders at which step such a row is removed; batches of rows index it, and one count for each part, order and step
adds up what goes, for all rows and for those of either label. Tasks give such arrays for their parts, which are summed,
a part's at most in SALTS groups first.

Copies are found by the digests of texts: rows of one digest, part, label and set are counted together, with the smallest
key among them and how often it stands there, before digests meet, so no group of copies lies in one task.

Defined results: a null text is the empty text, a null part the empty string; null keys are neither copies nor copied;
rows that repeat a key and its text are no copies of each other; labels that repeat a key count once, as good or toxic
if any of them says so; an empty table gives an empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arpent.llm.bpe import slices
from arpent.llm.common import frugal, stored

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DIFFERENT, MOST_CAPITALS = 200, 50, 2
ODD = re.compile(rb"[#$%&*|]")
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
#: Parts of which a task holds sums at once, and groups in which a part's sums are added up first.
PARTS_AT_ONCE, SALTS = 1000, 16
#: A part's numbers: removals by label, order and step (step 5: kept), then rows failing each filter, and it alone.
WIDTH = 3 * len(ORDERS) * (STEPS + 1) + 2 * STEPS


def first_failure() -> np.ndarray:
    """By set of failed filters, a bit each, and order: the step that removes, or STEPS if none does."""
    table = np.full((1 << STEPS, len(ORDERS)), STEPS, np.int64)
    for failed in range(1 << STEPS):
        for k, order in enumerate(ORDERS):
            table[failed, k] = next((i for i, f in enumerate(order) if failed >> FILTERS.index(f) & 1), STEPS)
    return table


def failed(text: bytes) -> int:
    """The conditions that the text itself meets, as bits."""
    words = text.split()
    raw = np.frombuffer(text, np.uint8)
    points = len(raw) - np.count_nonzero((raw & 0xC0) == 0x80)
    capitals = np.count_nonzero((raw - np.uint8(65)) < 26)
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DIFFERENT * len(words)) << 1
        | (100 * capitals > MOST_CAPITALS * points) << 2
        | (ODD.search(text) is not None) << 3
    )


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, good, toxic, failed, n: how many rows of a part and of labels fail a set of filters, in rows that tell the texts apart."""

    def run(batches):
        for batch in slices(batches, "text"):
            raw = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            digests = pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("part"), digests, pa.array([failed(x) for x in raw], pa.int32())], names=["key", "part", "digest", "failed"])

    own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    thin = own.mapInArrow(frugal(run), f"key {own.schema['key'].dataType.simpleString()}, part string, digest binary, failed int")
    thin = thin.groupBy("key", "part", "digest", "failed").agg(F.count("*").alias("n"))
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    marks = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("of")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    marked = thin.join(marks, F.col("key") == F.col("of"), "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    least = F.min(F.struct("key", "n"))
    groups = marked.groupBy("digest", "part", "good", "toxic", "failed", F.col("key").isNull().alias("no_key")).agg(F.sum("n").alias("n"), least.alias("least"))
    groups = stored(groups, "audit-groups")  # read twice
    firsts = groups.filter(~F.col("no_key")).groupBy(F.col("digest").alias("text_digest")).agg(F.min("least.key").alias("first"))
    met = groups.join(firsts, F.col("digest") == F.col("text_digest"), "left")
    stays = F.when(F.col("no_key"), F.col("n")).when(F.col("least.key") == F.col("first"), F.col("least.n")).otherwise(0)
    copies = F.array(F.struct(F.col("failed"), stays.alias("n")), F.struct((F.col("failed") + 16).alias("failed"), (F.col("n") - stays).alias("n")))
    return met.select("part", "good", "toxic", F.inline(copies)).filter("n > 0")


def audited(rows: DataFrame) -> DataFrame:
    """For each part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    rows: part, good, toxic, failed, n, as judged() gives them, or one row with n = 1 for each document."""
    table, size = first_failure(), len(ORDERS) * (STEPS + 1)
    cell = np.arange(len(ORDERS)) * (STEPS + 1)

    def out(parts: dict[str, int], sums: np.ndarray) -> pa.RecordBatch:
        salt = pa.array([TaskContext.get().partitionId() % SALTS] * len(parts), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.string()), salt, pa.array(list(sums[: len(parts)]), pa.list_(pa.int64()))], names=["part", "salt", "sums"])

    def add_up(batches):
        parts: dict[str, int] = {}
        sums = np.zeros((PARTS_AT_ONCE, WIDTH), np.int64)
        for batch in batches:
            for lo in range(0, len(batch), PARTS_AT_ONCE):
                piece = batch.slice(lo, PARTS_AT_ONCE)
                names = piece.column("part").to_pylist()
                if len(parts) + len(set(names)) > PARTS_AT_ONCE:
                    yield out(parts, sums)
                    parts.clear()
                    sums[:] = 0
                of = np.array([parts.setdefault(p, len(parts)) for p in names], np.int64)
                fails, n, good, toxic = (piece.column(c).to_numpy(zero_copy_only=False) for c in ("failed", "n", "good", "toxic"))
                at = (of[:, None] * size + cell + table[fails]).ravel()  # a row goes once in each order
                for k, weight in enumerate((n, n * good, n * toxic)):
                    gone = np.bincount(at, weights=np.repeat(weight, len(ORDERS)), minlength=len(parts) * size)
                    sums[: len(parts), k * size : (k + 1) * size] += np.rint(gone).astype(np.int64).reshape(-1, size)
                for k in range(STEPS):
                    for j, hit in ((2 * k, fails >> k & 1), (2 * k + 1, fails == 1 << k)):
                        gone = np.bincount(of, weights=n * hit, minlength=len(parts))
                        sums[: len(parts), 3 * size + j] += np.rint(gone).astype(np.int64)
        if parts:
            yield out(parts, sums)

    def total(given: pa.Table) -> np.ndarray:
        return given.column("sums").combine_chunks().flatten().to_numpy().reshape(-1, WIDTH).sum(0)

    def some(given: pa.Table) -> pa.Table:
        return pa.table({"part": given.column("part").slice(0, 1), "sums": pa.array([total(given)], pa.list_(pa.int64()))})

    def report(given: pa.Table) -> pa.Table:
        sums = total(given)
        gone, good, toxic = sums[: 3 * size].reshape(3, len(ORDERS), STEPS + 1)
        fails, alone = sums[3 * size :].reshape(STEPS, 2).T
        letter = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
        shapley = np.bincount(letter.ravel(), weights=gone[:, :STEPS].ravel(), minlength=STEPS).astype(np.int64)
        removed = gone[:, :STEPS]
        kept = gone.sum(1, keepdims=True) - np.cumsum(removed, 1)
        columns = {"kept": kept, "removed": removed, "redundant": fails[letter] - removed, "unique_fails": alone[letter], "good_lost": good[:, :STEPS], "toxic_lost": toxic[:, :STEPS], "shapley": shapley[letter]}
        rows = len(ORDERS) * STEPS
        return pa.table({
            "part": pa.array([given.column("part")[0].as_py()] * rows, pa.string()), "filter_order": pa.array(np.repeat(ORDERS, STEPS).tolist(), pa.string()),
            "step": pa.array(np.tile(np.arange(1, STEPS + 1), len(ORDERS)), pa.int32()), **{c: pa.array(x.ravel(), pa.int64()) for c, x in columns.items()},
        })

    partial = rows.select("part", "good", "toxic", "failed", "n").mapInArrow(frugal(add_up), "part string, salt int, sums array<bigint>")
    salted = partial.groupBy("part", "salt").applyInArrow(some, "part string, sums array<bigint>")
    counts = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return salted.groupBy("part").applyInArrow(report, f"part string, filter_order string, step int, {counts}")


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """The whole report over documents and their labels."""
    return audited(judged(docs, labels, key, text, part))


def oracle() -> str:
    """The report in SQL over the tables documents and labels."""
    words = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
    steps = ", ".join(f"(b >> (ascii(substr(o, {k}, 1)) - 65)) & 1 AS f{k}" for k in range(1, 6))
    first = "CASE " + " ".join(f"WHEN f{k} = 1 THEN {k}" for k in range(1, 6)) + " ELSE 6 END"
    letter = "(ascii(substr(o.o, s.step, 1)) - 65)"
    return f"""WITH l AS (SELECT doc_id, coalesce(max(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 0) AS good, coalesce(max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END), 0) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(CAST(source AS VARCHAR), '') AS part, coalesce(text, '') AS t, {words} AS w FROM documents),
e AS (SELECT *, min(doc_id) OVER (PARTITION BY t) AS m FROM d),
b AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CAST(len(w) < {LEAST_WORDS} AS INT) + 2 * CAST(100 * len(list_distinct(w)) < {LEAST_DIFFERENT} * len(w) AS INT) + 4 * CAST(100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(t) AS INT)
  + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(e.doc_id > m, false) AS INT) AS b FROM e LEFT JOIN l ON l.doc_id = e.doc_id),
c AS (SELECT part, b, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM b GROUP BY part, b),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
g AS (SELECT part, b, n, good, toxic, o, {first} AS gone FROM (SELECT *, {steps} FROM c, o) z),
r AS (SELECT part, o, gone, sum(n) AS n, sum(good) AS good, sum(toxic) AS toxic FROM g GROUP BY part, o, gone),
s AS (SELECT unnest([1, 2, 3, 4, 5]) AS step),
h AS (SELECT part, ascii(x.f) - 65 AS letter, sum(n * ((b >> (ascii(x.f) - 65)) & 1)) AS fails, sum(CASE WHEN b = 1 << (ascii(x.f) - 65) THEN n ELSE 0 END) AS alone FROM c, x GROUP BY part, x.f),
v AS (SELECT part, ascii(substr(o, gone, 1)) - 65 AS letter, sum(n) AS shapley FROM r WHERE gone < 6 GROUP BY ALL)
SELECT p.part, o.o AS filter_order, CAST(s.step AS INTEGER) AS step,
  CAST(p.n - sum(coalesce(r.n, 0)) OVER (PARTITION BY p.part, o.o ORDER BY s.step) AS BIGINT) AS kept, CAST(coalesce(r.n, 0) AS BIGINT) AS removed, CAST(h.fails - coalesce(r.n, 0) AS BIGINT) AS redundant,
  CAST(h.alone AS BIGINT) AS unique_fails, CAST(coalesce(r.good, 0) AS BIGINT) AS good_lost, CAST(coalesce(r.toxic, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(v.shapley, 0) AS BIGINT) AS shapley
FROM (SELECT part, count(*) AS n FROM d GROUP BY part) p CROSS JOIN o CROSS JOIN s LEFT JOIN r ON r.part = p.part AND r.o = o.o AND r.gone = s.step
JOIN h ON h.part = p.part AND h.letter = {letter} LEFT JOIN v ON v.part = p.part AND v.letter = {letter}"""
