"""What a plan does, as rows: its exchanges, and of each scan what is pushed down and which columns are read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

SHAPE = "kind string, what string, pushed array<string>, columns array<string>"


def steps(df: DataFrame) -> list[tuple[str, str, list[str], list[str]]]:
    """(kind, what, pushed filters, columns) of each exchange and scan in the formatted plan before it runs. Exchanges: hash,
    range, round robin, single or broadcast; what: their keys. Scans: what is the format."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    found = []
    for block in re.split(r"\n\n+(?=\(\d+\) )", text):
        head = re.match(r"\((\d+)\) (.*)", block)
        if head is None:
            continue
        line = lambda name: (m := re.search(rf"^{name}: (.*)$", block, re.M)) and m[1]  # noqa: E731, B023
        plain = lambda x: re.sub(r"#\d+L?", "", x)
        if head[2].startswith(("Exchange", "BroadcastExchange")):
            given = line("Arguments") or ""
            kind = "broadcast" if head[2].startswith("Broadcast") else "single" if "SinglePartition" in given else next((k for k in ("hash", "range", "RoundRobin") if k in given), "other")
            keys = re.search(r"partitioning\((.*), \d+\)", given)
            found.append((f"{kind.lower()} exchange", plain(keys[1]) if keys else "", [], []))
        elif head[2].startswith(("Scan", "BatchScan")):
            pushed = re.search(r"\[(.*)\]", line("PushedFilters") or "[]")[1]
            columns = re.search(r"<(.*)>", line("ReadSchema") or "<>")
            names = [c.split(":")[0] for c in re.split(r",(?=[^<>()]*?:)", columns[1])] if columns and columns[1] else []
            found.append(("scan", head[2].strip().split()[1], [p for p in re.split(r", (?=[A-Z])", pushed) if p], names))
    return found


def plan_steps(df: DataFrame) -> DataFrame:
    """kind, what, pushed, columns: the steps of a plan as a frame. Nothing of df is computed."""
    return df.sparkSession.createDataFrame(steps(df), SHAPE)
