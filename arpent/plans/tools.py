"""The tools that a chat model may call: six names, strict inputs, and nothing generic behind them."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arpent.functions.text import area_name
from arpent.operators import analytics, conversation
from arpent.policy import DEFAULT, InputError, Policy


@dataclass(frozen=True)
class Tool:
    name: str
    fields: dict[str, type]
    required: frozenset[str]
    run: Callable[..., DataFrame]

    def specification(self) -> dict:
        kinds = {int: "integer", str: "string", list: "array"}
        return {"name": self.name, "parameters": {"type": "object", "additionalProperties": False, "required": sorted(self.required), "properties": {k: {"type": kinds[t]} for k, t in self.fields.items()}}}


def checked(tool: Tool, payload: dict) -> dict:
    if not isinstance(payload, dict) or set(payload) - set(tool.fields):
        raise InputError(f"{tool.name} takes only {sorted(tool.fields)}")
    if gone := tool.required - set(payload):
        raise InputError(f"{tool.name} needs {sorted(gone)}")
    for k, v in payload.items():
        if v is not None and (isinstance(v, bool) or not isinstance(v, tool.fields[k])):
            raise InputError(f"{k} must be {tool.fields[k].__name__}")
    return {k: v for k, v in payload.items() if v is not None}


def registry(sales: DataFrame, diagnostics: DataFrame, answer: Callable[[str, str], DataFrame], policy: Policy = DEFAULT, energy_policy: Policy | None = None) -> dict[str, Tool]:
    """Tools over the two facts; `answer` answers documentary questions and is given."""
    energy_policy = energy_policy or policy
    scope, period = {"area": int, "start": int, "end": int}, {"start": int, "end": int}

    def energy(**x) -> DataFrame:
        """A row for each label, with the numbers of the whole scope beside it."""
        beside = lambda df, p: F.broadcast(df.select(*(F.col(c).alias(f"{p}_{c}") for c in df.columns)))
        labels = analytics.label_distribution(diagnostics, policy=energy_policy, **x)
        poor, intensity = analytics.poor_labels(diagnostics, policy=energy_policy, **x), analytics.intensity_summary(diagnostics, policy=energy_policy, **x)
        return labels.crossJoin(beside(poor, "labels")).crossJoin(beside(intensity, "intensity")).orderBy("label")  # seven rows

    def documentary(question: str, style: str = "auto") -> DataFrame:
        if not 1 <= len(question.strip()) <= 2000 or style not in ("auto", "brief", "detailed"):
            raise InputError("a question has 1 to 2000 characters; styles are auto, brief and detailed")
        return answer(question.strip(), style)

    tools = [
        Tool("get_market_overview", scope, frozenset(), lambda **x: analytics.market_overview(sales, policy=policy, **x)),
        Tool("get_market_trend", scope, frozenset(), lambda **x: analytics.price_trend(sales, policy=policy, **x)),
        Tool("rank_arrondissements", period, frozenset(), lambda **x: analytics.rankings(sales, policy=policy, **x)),
        Tool("compare_arrondissements", {"areas": list, **period}, frozenset({"areas"}), lambda **x: analytics.compare_areas(sales, policy=policy, most=policy.most_areas_of_a_tool, **x)),
        Tool("analyze_dpe", scope, frozenset(), energy),
        Tool("answer_documentary_question", {"question": str, "style": str}, frozenset({"question"}), documentary),
    ]
    return {t.name: t for t in tools}


def execute(tools: dict[str, Tool], name: str, payload: dict) -> DataFrame:
    if name not in tools:
        raise InputError(f"there is no tool {name}")
    return tools[name].run(**checked(tools[name], payload))


def call_signature(name: str, payload: dict) -> str:
    """Equal for equal calls, whatever the order of their arguments."""
    return name + ":" + json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


#: Fixed values of the routes: what is said where a rule answers without the model.
LOCAL = ("security", "clock", "weather", "location", "greeting", "thanks", "acknowledgement", "goodbye", "capability", "clarify_city", "out_of_scope")


def settled_turn(spark: SparkSession, model: Callable[[list], dict], tools: dict[str, Tool], message: str, history: list[tuple[str, str]] = (), said: Callable[[str], str] = str, **bounds) -> dict:
    """A turn with what comes before the model: of the history the last messages alone, the route, which may answer locally
    by what `said` has for it, and the only tool that a question of its kind may use. Adds the route to what run_turn gives."""
    turns = [*history, ("user", message)]
    rows = spark.createDataFrame([("turn", i, role, text) for i, (role, text) in enumerate(turns)], "conv_id string, turn int, role string, text string")
    settled = conversation.prepared_turns(rows).filter(F.col("turn") == len(turns) - 1).first()
    if settled.route in LOCAL:
        return {"text": said(settled.route), "tools": [], "route": settled.route}
    allowed = tools if settled.allowed_tools is None else {settled.allowed_tools: tools[settled.allowed_tools]}
    return run_turn(model, allowed, message, history=[(m.role, m.text) for m in settled.history], **bounds) | {"route": settled.route}


def run_turn(model: Callable[[list], dict], tools: dict[str, Tool], message: str, rounds: int = 4, calls: int = 6, rows: int = 50, history: list[tuple[str, str]] = ()) -> dict:
    """Let a given model call tools until it answers: {"text"} or {"calls": [(name, payload)]} in each round, at most
    `rounds` rounds of `calls` calls; repeated calls and errors are told to the model. A result of more than `rows` rows
    is an error that is told too, not cut."""
    messages, seen, used = [*history, ("user", message)], set(), []
    for turn in range(rounds + 1):
        reply = model(messages)
        if "text" in reply:
            return {"text": reply["text"], "tools": used}
        if turn == rounds:
            break  # after the last round only an answer counts
        for name, payload in reply["calls"][:calls]:
            mark = call_signature(name, payload)
            if mark in seen:
                messages.append(("error", f"{name} was called so before"))
                continue
            seen.add(mark)
            try:
                found = [json.loads(x) for x in execute(tools, name, payload).limit(rows + 1).toJSON().collect()]
                if len(found) > rows:
                    raise InputError(f"{name} has more than {rows} rows for this; ask for less")
                used.append((name, True))
                messages.append(("tool", json.dumps(found, ensure_ascii=False)))
            except InputError as problem:
                used.append((name, False))
                messages.append(("error", str(problem)))
    raise InputError("the model did not answer within its rounds")


def chart(rows: DataFrame, label: str, value: str) -> DataFrame:
    """position, label, value of what a chart shows: rows with a value, in the order of labels."""
    return rows.filter(F.col(value).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(value).cast("double").alias("value")).orderBy("label")


#: What each tool's chart shows: its label, its value, and what gives the order.
CHARTS = {"get_market_trend": ("source_year", "median", "source_year"), "compare_arrondissements": ("arrondissement", "median", "position"), "analyze_dpe": ("label", "pct", "label")}


def tool_chart(name: str, rows: DataFrame) -> DataFrame | None:
    """position, label, value of the chart that a tool's result has, without rows that have no value; None for tools
    without a chart. Districts are labelled by their names."""
    if name not in CHARTS:
        return None
    by, value, order = CHARTS[name]
    label = area_name(F.col(by)) if by == "arrondissement" else F.col(by).cast("string")
    place = F.row_number().over(Window.orderBy(order)) - 1  # as many rows as years, labels or districts asked for
    return rows.filter(F.col(value).isNotNull()).select(place.alias("position"), label.alias("label"), F.col(value).cast("double").alias("value"))


#: Fixed value: stands for arguments that are no JSON object.
INVALID_ARGUMENTS = '{"__invalid_json__": true}'


def checked_arguments(calls: DataFrame, column: str = "arguments") -> DataFrame:
    """calls with the mark in place of arguments that are no JSON object; null is an empty object."""
    x = F.coalesce(F.col(column), F.lit("{}"))
    kind = F.schema_of_variant(F.try_parse_json(x))
    return calls.withColumn(column, F.when(kind.startswith("OBJECT"), x).otherwise(INVALID_ARGUMENTS))
