"""Exact quantiles without a map of all values in one place.

Values are counted, each different one once a group. A value's slot is the whole part of a logarithm, so slots follow the
values' order and depend on nothing else; within a slot values differ by less than one part in SLOTS. The slots' counts are
cumulated, which tells in which slot the two neighbours of every asked rank lie; in those slots alone the values are put in
order, each slot by itself. No task holds more of a group than its slots' counts or the different values of one slot.

Nulls and NaN count for nothing. Quantiles interpolate between the two neighbours of rank (n - 1) * q, counted from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots between a value (from 1 on) and its e-fold.
SLOTS = 1024


#: Of a value x: a whole number that does not fall when x rises.
SLOT = f"CAST(signum(x) * floor(log1p(abs(x)) * {SLOTS}) AS BIGINT)"


def exact(rows: DataFrame, measures: dict[str, Column], asked: dict[str, tuple[str, float]], by: tuple[str, ...] = ()) -> DataFrame:
    """by..., then for each asked name its quantile of a measure, and for each measure `n_<measure>`, how many values it
    has. A row for each group that has a value of any measure; without `by` one row, also of no rows."""
    at = {name: k for k, name in enumerate(measures)}
    asked_of = [(k, at[measure], float(q)) for k, (measure, q) in enumerate(asked.values())]
    each = F.array(*(F.struct(F.lit(k).alias("m"), x.cast("double").alias("x")) for k, x in enumerate(measures.values())))
    keys = "".join(f"`{c}`, " for c in by)
    same = " AND ".join(f"c.`{c}` <=> t.`{c}`" for c in (*by, "m", "slot"))
    wanted = ", ".join(f"named_struct('k', {k}, 'm', {m}, 'q', {q!r}D)" for k, m, q in asked_of)
    rank = lambda up: f"named_struct('k', a.k, 'up', {up}, 'rank', CAST({'ceil' if up else 'floor'}(a.q * (total - 1)) AS BIGINT))"
    values = [f"max(CASE WHEN exists(mine, r -> r.k = {k} AND r.up = {up}) THEN x END) AS _{k}_{up}" for k, _, _ in asked_of for up in (False, True)]
    counts = [f"coalesce(max(CASE WHEN m = {k} THEN total END), 0L) AS `n_{name}`" for name, k in at.items()]

    def between(name: str, k: int, measure: str, q: float) -> str:
        place = f"{q!r}D * (`n_{measure}` - 1)"
        return f"CASE WHEN _{k}_False = _{k}_True THEN _{k}_False ELSE (ceil({place}) - {place}) * _{k}_False + ({place} - floor({place})) * _{k}_True END AS `{name}`"

    quantiles = [between(name, k, measure, float(q)) for k, (name, (measure, q)) in enumerate(asked.items())]
    hint = "" if by else "/*+ BROADCAST(t) */ "  # without groups a row for each rank asked for
    group = f"GROUP BY {keys[:-2]}" if by else ""
    # `first`: one slot of each group tells how many values there are
    return rows.sparkSession.sql(
        f"""WITH counted AS (SELECT *, {SLOT} AS slot FROM (SELECT {keys}m, x, count(*) AS n FROM {{rows}} WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY {keys}m, x)),
slots AS (SELECT *, sum(n) OVER (PARTITION BY {keys}m ORDER BY slot) - n AS before, sum(n) OVER (PARTITION BY {keys}m) AS total
  FROM (SELECT {keys}m, slot, sum(n) AS n FROM counted GROUP BY {keys}m, slot)),
ranks AS (SELECT *, flatten(transform(filter(array({wanted}), a -> a.m = m), a -> array({rank(False)}, {rank(True)}))) AS ranks FROM slots),
told AS (SELECT * FROM (SELECT {keys}m, slot, before, total, before = 0 AS first, filter(ranks, r -> r.rank >= before AND r.rank < before + n) AS ranks FROM ranks) WHERE first OR size(ranks) > 0),
near AS (SELECT {hint}c.*, total, ranks, before + sum(n) OVER (PARTITION BY {"".join(f"c.`{c}`, " for c in by)}c.m, c.slot ORDER BY x) AS upto FROM counted c JOIN told t ON {same}),
found AS (SELECT {keys}m, x, total, filter(ranks, r -> r.rank < upto AND r.rank >= upto - n) AS mine FROM near)
SELECT {keys}{", ".join([*quantiles, *(f"`n_{name}`" for name in at)])} FROM (SELECT {keys}{", ".join([*values, *counts])} FROM found {group})""",
        rows=rows.select(*by, F.inline(each)),
    )
