"""Routing of chat messages by ordered rules, exposure of tools, and scoring of recorded answers - in bulk, as columns.

The word lists are fixed values of the domain: French and English phrases after search normalisation."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arpent.functions.columns import percent
from arpent.functions.text import like_words, may_be_like, search_text

# Fixed values from here to the end of the lists.
GREETINGS = (
    "bonjour", "bonjour a vous", "bonjour comment allez vous", "bonsoir", "coucou", "hello", "hey", "salut", "salut ca va",
    "ca va", "comment allez vous",
)
GREETING_WORDS = tuple(g for g in GREETINGS if " " not in g)
THANKS = (
    "merci", "merci a vous", "merci beaucoup", "merci pour ton aide", "merci pour votre aide", "merci c est clair",
    "je vous remercie", "thanks", "thanks for your help", "thank you", "thank you for your help",
)
ACKNOWLEDGEMENTS = ("c est bon", "c est ok", "ca marche", "compris", "d accord", "ok", "okay", "parfait", "tres bien")
GOODBYES = ("a bientot", "a plus", "au revoir", "bonne journee", "bonne soiree")
CAPABILITIES = ("a quoi sers tu", "que peux tu faire", "qui es tu", "tu es qui", "tu peux faire quoi")
IN_SCOPE = (
    "achat", "acheter", "agence immobiliere", "agent immobilier", "appartement", "apartment", "arrondissement",
    "audit energetique", "bail", "bien immobilier", "building", "buy", "charges", "copropriete", "credit immobilier",
    "diagnostic", "dpe", "dvf", "emprunt", "energy rating", "energy performance", "frais de notaire", "home", "housing",
    "house", "immeuble", "immobilier", "immobiliere", "immobilieres", "immobiliers", "investissement", "landlord",
    "location", "locataire", "locatif", "logement", "logements", "loyer", "m2", "maison", "marche residentiel", "median",
    "mediane", "metre carre", "mortgage", "neighborhood", "notaire", "prix", "property", "property tax", "proprietaire",
    "quartier", "real estate", "rent", "rendement", "renovation", "sale", "studio", "surface", "taxe fonciere", "tenant",
    "transaction", "travaux", "valeur fonciere", "vente",
)
SECURITY = (
    r"ignore .*instruction", r"instructions? (systeme|system)", r"system prompt", r"api key", r"cle api", r"mot de passe",
    r"password", r"drop table", r"delete from", r"execute .*sql", r"revele .*secret", r"affiche .*secret",
    r"(?:montre|affiche|revele|donne).*(?:instruction|prompt|secret|cle api|mot de passe|password|token)",
    r"(?:select|insert|update|delete|drop|alter|truncate|create).*(?:from|into|table|database|schema)",
)
CLOCK = (
    r"quel(?:le)? heure", r"heure (?:a|de|en) paris", r"heure paris", r"heure est il", r"heure actuelle",
    r"heure maintenant", r"il est quelle heure", r"quel jour sommes nous", r"quelle date sommes nous",
    r"sommes nous en ete", r"sommes nous en hiver", r"saison sommes nous",
)
WEATHER = (
    "meteo", "neiger", "neige demain", "pleuvoir", "pluie demain", "prevision du temps", "temperature demain",
    "temps demain", "weather",
)
PLACE = (r"dans quelle ville suis je", r"ou suis je", r"ma position actuelle", r"ma localisation", r"mon gps")
FOLLOW_UPS = (
    "alors", "continue", "detaille", "et ", "explique", "mais", "non", "oui", "pourquoi", "precise", "vas y", "allez y",
)
INSTRUCTIONS = ("answer", "brief", "court", "detail", "explain", "please", "repond", "reply", "resume", "tradui")
LANGUAGES = ("anglais", "english", "francais", "french")
CITY = (
    r"(?:a )?paris", r"(?:la )?ville (?:c est|est) paris", r"ville paris", r"(?:c est|ce sera|je choisis|je veux) paris",
    r"paris (?:entier|intra muros)",
)
ORDINAL = r"\b(?:[1-9]|1[0-9]|20)(?:e|eme|er)\b"
DPE = ("dpe", "diagnostic de performance energetique", "performance energetique", "classe energetique", "etiquette energetique")
STATISTICAL = (
    "repartition", "distribution", "statistique", "pourcentage", "proportion", "diagnostics", "consommation", "emission",
    "intensite", "classe", "etiquette",
)
MARKET = ("prix", "transaction", "dvf", "marche", "valeur fonciere")
DOCUMENTARY = (
    "audit", "definition", "interdiction", "location", "louer", "loi", "methodologie", "obligation", "reglement",
    "restriction", "validite", "valable",
)
MARKET_TOOLS = ("get_market_overview", "get_market_trend", "rank_arrondissements", "compare_arrondissements")
ENERGY_TOOLS, DOCUMENTARY_TOOLS = ("analyze_dpe",), ("answer_documentary_question",)


def _any(conditions) -> Column:
    return reduce(Column.__or__, conditions)


def _holds_any(text: Column, words: tuple[str, ...]) -> Column:
    return _any(text.contains(w) for w in words)


def _fits_any(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def in_scope(text: Column) -> Column:
    """Words of the domain or the ordinal of a district."""
    return text.rlike(r"\b(?:" + "|".join(IN_SCOPE) + r")\b") | text.rlike(ORDINAL)


def names_city(text: Column) -> Column:
    return text.rlike("^(?:" + "|".join(CITY) + ")$")


def words(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


#: From which ratio of matching blocks on a single word is a greeting, and a word a language.
LIKE_GREETING, LIKE_LANGUAGE = 0.82, 0.8


def _marked(messages: DataFrame, key: str, found: DataFrame, mark: str) -> DataFrame:
    """messages with whether their key is among the found ones. Messages without a key have one of their own each, so that
    they do not gather in one task."""
    own = F.coalesce(F.col(key), F.concat(F.lit("\0"), F.xxhash64(*messages.columns).cast("string")))
    held = found.select(F.col(key).alias("_key")).distinct().withColumn(mark, F.lit(True))
    joined = messages.withColumn("_own", own).join(held, F.col("_own") == F.col("_key"), "left")
    return joined.withColumn(mark, F.coalesce(mark, F.lit(False))).drop("_own", "_key", key)


def with_misspelt(messages: DataFrame, text: str) -> DataFrame:
    """messages (with a normalized text) with `_typo`, a single word like a greeting, and `_language`, some word like a
    language in at most twelve. Only words that built-in expressions cannot rule out are compared, each different one once."""
    t = F.col(text)
    one = (words(t) == 1) & (F.length(t) >= 4) & may_be_like(t, GREETING_WORDS, LIKE_GREETING)
    messages = messages.withColumn("_word", F.when(one, t))
    messages = _marked(messages, "_word", like_words(messages.filter("_word IS NOT NULL"), "_word", GREETING_WORDS, LIKE_GREETING), "_typo")
    some = F.array_sort(F.array_distinct(F.filter(F.split(t, " "), lambda w: may_be_like(w, LANGUAGES, LIKE_LANGUAGE))))
    messages = messages.withColumn("_some", F.when((words(t) <= 12) & (F.size(some) > 0), F.array_join(some, " ")))
    each = messages.filter("_some IS NOT NULL").select("_some").distinct().select("_some", F.explode(F.split("_some", " ")).alias("_word"))
    like = each.join(like_words(each, "_word", LANGUAGES, LIKE_LANGUAGE), "_word", "left_semi")
    return _marked(messages, "_some", like, "_language")


def with_routes(messages: DataFrame, text: str = "text", before: str = "previous", misspelt: bool = True) -> DataFrame:
    """messages with `route`: the first rule that the text meets; `before` holds the user's message before it, or null.
    "model" means that no rule answers locally. Without `misspelt`, greetings and languages must be spelt as listed, and
    all of it is built-in expressions."""
    messages = messages.withColumns({"_t": search_text(F.col(text)), "_b": search_text(F.col(before))})
    if misspelt:
        messages = with_misspelt(messages, "_t")
    else:
        messages = messages.withColumns({"_typo": F.lit(False), "_language": F.arrays_overlap(F.split("_t", " "), F.array(*map(F.lit, LANGUAGES)))})
    t, b = F.col("_t"), F.coalesce(F.col("_b"), F.lit(""))
    topical = in_scope(b)
    short = words(t) <= 12
    follows = short & (names_city(t) | _any(t.startswith(p) for p in FOLLOW_UPS) | t.rlike(ORDINAL))
    instructs = short & F.col("_language") & _holds_any(t, INSTRUCTIONS)
    route = (
        F.when(_fits_any(t, SECURITY), "security")
        .when(_fits_any(t, CLOCK), "clock")
        .when(_holds_any(t, WEATHER), "weather")
        .when(_fits_any(t, PLACE), "location")
        .when(t.isin(*GREETINGS) | F.col("_typo"), "greeting")
        .when(t.isin(*THANKS), "thanks")
        .when(t.isin(*ACKNOWLEDGEMENTS), "acknowledgement")
        .when(t.isin(*GOODBYES), "goodbye")
        .when(t.isin(*CAPABILITIES), "capability")
        .when(in_scope(t), "model")
        .when(follows & (topical | names_city(b)), "model")
        .when(instructs & topical, "model")
        .when(names_city(t), "clarify_city")
        .otherwise("out_of_scope")
    )
    return messages.withColumn("route", route).drop("_t", "_b", "_typo", "_language")


def user_turns(conversations: DataFrame) -> DataFrame:
    """The users' messages, each with the user's message before it."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    users = conversations.filter(F.col("role") == "user")
    return users.withColumn("previous", F.lag("text").over(order))


HISTORY = 12


def recalled_turns(conversations: DataFrame, most: int = HISTORY) -> DataFrame:
    """The users' messages, each with `history`, the up to `most` messages before it, whoever wrote them, as role and text
    in order, and `previous`, the last text of a user among these: only that one unlocks what follows up on it. A frame
    looks at no more than `most` rows, however long a conversation is."""
    frame = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-most, -1)
    turns = conversations.withColumns({
        "history": F.collect_list(F.struct("role", "text")).over(frame),
        "previous": F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(frame),
    })
    return turns.filter(F.col("role") == "user")


def prepared_turns(conversations: DataFrame, most: int = HISTORY, misspelt: bool = True) -> DataFrame:
    """The users' messages with all that is settled before a model is asked: history, route and allowed_tools."""
    return with_tools(with_routes(recalled_turns(conversations, most), misspelt=misspelt))


def with_tools(messages: DataFrame, text: str = "text") -> DataFrame:
    """messages with `allowed_tools`: one tool for questions of diagnostic statistics alone, else null for all."""
    messages = messages.withColumn("_t", search_text(F.col(text)))
    t = F.col("_t")
    narrow = _holds_any(t, DPE) & _holds_any(t, STATISTICAL) & ~_holds_any(t, MARKET) & ~_holds_any(t, DOCUMENTARY)
    return messages.withColumn("allowed_tools", F.when(narrow, F.lit("analyze_dpe"))).drop("_t")


def route_of_tools(tools: Column) -> Column:
    """The route that an answer took, from the tools that it used."""
    uses = [F.arrays_overlap(tools, F.array(*map(F.lit, names))) for names in (MARKET_TOOLS, ENERGY_TOOLS, DOCUMENTARY_TOOLS)]
    n = reduce(Column.__add__, (u.cast("int") for u in uses))
    return F.when(n > 1, "combined").when(uses[0], "market").when(uses[1], "dpe").when(uses[2], "documentary").otherwise("conversation")


def scored(answers: DataFrame) -> DataFrame:
    """Expectations met, one flag each, and `passed`. Columns: expected_route, route, required_tools, allowed_tools,
    successful_tools, failed_tools, citations_required, n_citations, expected_charts, charts, memory_expected, memory_used,
    expected_model, model, required_terms, answer."""
    subset = lambda a, b: F.size(F.array_except(a, b)) == 0
    answers = answers.withColumn("_t", search_text(F.col("answer")))
    flags = {
        "route_correct": F.col("route") == F.col("expected_route"),
        "tools_correct": subset("required_tools", "successful_tools") & subset("successful_tools", "allowed_tools") & (F.size("failed_tools") == 0),
        "citations_correct": (F.col("n_citations") > 0) == F.col("citations_required"),
        "charts_correct": subset("expected_charts", "charts"),
        "memory_correct": F.col("memory_used") == F.col("memory_expected"),
        "model_correct": F.col("expected_model").isNull() | F.col("model").eqNullSafe(F.col("expected_model")),
        "terms_correct": F.forall("required_terms", lambda x: F.col("_t").contains(x)),
        "answer_present": F.trim(F.coalesce("answer", F.lit(""))) != "",
    }
    flags = {k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}
    answers = answers.withColumns(flags).drop("_t")
    return answers.withColumn("passed", reduce(Column.__and__, map(F.col, flags)))


def summary(results: DataFrame) -> DataFrame:
    """One row: cases, passes, the rate of each flag in percent, and the mean latency."""
    flags = [c for c in results.columns if c.endswith(("_correct", "_present"))]
    rate = lambda c: percent(F.count_if(c), F.count("*")).alias(f"{c}_pct")
    return results.agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed_cases"), rate("passed"), *map(rate, flags), F.round(F.avg("latency_ms"), 2).alias("mean_latency_ms"))


CASE = (
    "case_id string, position int, category string, question string, history array<string>, expected_route string, required_tools array<string>, "
    "allowed_tools array<string>, citations_required boolean, expected_charts array<string>, memory_expected boolean, expected_model string, required_terms array<string>"
)
ANSWER = (
    "route string, successful_tools array<string>, failed_tools array<string>, n_citations int, charts array<string>, memory_used boolean, model string, "
    "answer string, latency_ms double, error_type string"
)


def suite(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a suite `{"cases": [...]}`, with their place in it."""
    cases = spark.read.schema(f"cases array<struct<{CASE.replace('position int, ', '')}>>").option("multiLine", True).json(path)
    return cases.select(F.posexplode("cases").alias("position", "c")).select("position", "c.*")


def selected_cases(cases: DataFrame, ids: tuple[str, ...] = (), category: str | None = None, most: int | None = None) -> DataFrame:
    """Cases of the given ids and category in declared order, the first `most` of them. Unknown ids, a `most` below one and
    an empty choice are errors."""
    if most is not None and most < 1:
        raise ValueError("at least one case must be asked for")
    if ids:
        asked = cases.sparkSession.createDataFrame([(i,) for i in ids], "case_id string")
        if unknown := [r[0] for r in asked.join(cases, "case_id", "left_anti").collect()]:  # as many as were asked for
            raise ValueError(f"unknown cases {sorted(unknown)}")
        cases = cases.filter(F.col("case_id").isin(*ids))
    found = (cases if category is None else cases.filter(F.col("category") == category)).orderBy("position")
    found = found if most is None else found.limit(most)
    if found.isEmpty():
        raise ValueError("no case fits")
    return found


def answered(cases: DataFrame, answer: Callable[[str, list[str]], dict]) -> DataFrame:
    """cases with the columns of their answers. `answer` is given and runs on the executors: from a question and a history to
    the answer's columns; a case that fails has its error's name in error_type and leaves the others alone."""
    names = [c.split()[0] for c in ANSWER.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([("case_id", pa.string()), *((n, kinds[c.split()[1]]) for n, c in zip(names, ANSWER.split(", "), strict=True))])

    def one(row):
        begun = time.perf_counter()
        try:
            got, error = answer(row["question"], row["history"] or []), None
        except Exception as problem:  # a failure is a result of its case
            got, error = {}, type(problem).__name__
        return {**got, "case_id": row["case_id"], "latency_ms": (time.perf_counter() - begun) * 1000, "error_type": error}

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([one(r) for r in batch.to_pylist()], schema)

    found = cases.select("case_id", "question", "history").mapInArrow(run, f"case_id string, {ANSWER}")
    return cases.join(found, "case_id")


def evaluation_run(cases: DataFrame, answer: Callable[[str, list[str]], dict], out: str) -> DataFrame:
    """Answers and scores all cases, stores the results and their summary as JSON below `out`; returns the summary."""
    spark = cases.sparkSession
    answered(cases, answer).write.mode("overwrite").parquet(f"{out}/answers")
    results = scored(spark.read.parquet(f"{out}/answers")).withColumn("passed", F.col("passed") & F.col("error_type").isNull())
    results.write.mode("overwrite").json(f"{out}/results")
    summary(results).coalesce(1).write.mode("overwrite").json(f"{out}/summary")
    return spark.read.json(f"{out}/summary")
