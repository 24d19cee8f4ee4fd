"""Documentary answers to many questions at once: retrieve, abstain or lay out the context, generate, check the citations.

Each question is a row from beginning to end, so one that cannot be answered does not end the run: `problem` says what was
wrong with it. The embedding and the generating models are given; they run on the executors, for batches of rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arpent.operators import loading, vectors
from arpent.plans.corpus import checked_answers

LONGEST = 2000
STYLES = {
    "auto": "Answer at the length that the question asks for.",
    "brief": "Answer briefly and directly, in one to three sentences.",
    "detailed": "Answer in detail, clearly structured, without repetition and in fewer than 700 words.",
}
ABSTENTION = "The indexed documents do not hold enough to answer this reliably."
#: Columns of the passages.
PASSAGE = ("chunk_id", "source_id", "title", "publisher", "url", "section", "page", "text")


def checked_questions(questions: DataFrame) -> DataFrame:
    """question_id, question, style and `problem`: blank or too long questions, unknown styles. Blanks around go."""
    text, style = F.regexp_replace(F.coalesce("question", F.lit("")), r"^\s+|\s+$", ""), F.coalesce("style", F.lit("auto"))
    problem = F.when(text == "", "blank question").when(F.length(text) > LONGEST, "question too long").when(~style.isin(*STYLES), "unknown style")
    return questions.select("question_id", text.alias("question"), style.alias("style"), problem.alias("problem"))


def contexts(questions: DataFrame, hits: DataFrame, passages: DataFrame, budget: int = 12_000, least: int = 200) -> DataFrame:
    """question_id, input, included: what a model is given for each question. Passages follow each other by rank, each under
    a head that names it S1, S2 and so on, in a budget of characters that also holds the question. A passage that overruns
    it is cut; one that would have fewer than `least` characters, and all after it, are left out. `included` has the
    passages' chunk ids by their numbers, as many as a question has hits at most."""
    asks = F.concat(
        F.lit("QUESTION\n"), F.col("question"), F.lit("\n\nSTYLE\n"), F.element_at(F.create_map(*(F.lit(x) for kv in STYLES.items() for x in kv)), F.col("style")), F.lit("\n\nPASSAGES\n")
    )
    told = [("Title", "title"), ("Publisher", "publisher"), ("Section", "section"), ("Page", "page"), ("URL", "url")]
    head = F.concat(F.lit("\n[S"), F.col("rank").cast("string"), F.lit("]\n"), *(x for n, c in told for x in (F.lit(f"{n}: "), F.coalesce(F.col(c).cast("string"), F.lit("-")), F.lit("\n"))), F.lit("\n"))
    own = hits.select("question_id", "chunk_id", "rank").join(passages.select(*PASSAGE), "chunk_id").join(questions.select("question_id", asks.alias("asks")), "question_id")
    own = own.withColumns({"head": head, "text": F.coalesce("text", F.lit(""))})
    before = Window.partitionBy("question_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)  # over a question's hits
    used = F.length("asks") + F.coalesce(F.sum(F.length("head") + F.length("text")).over(before), F.lit(0))
    own = own.withColumn("left", F.lit(budget) - used - F.length("head")).filter(F.col("left") >= least)
    cut = F.when(F.length("text") > F.col("left"), F.rtrim(F.expr("left(text, `left`)"))).otherwise(F.col("text"))
    row = F.struct("rank", F.concat("head", cut).alias("block"), "chunk_id", "source_id", "title", "publisher", "url", "section")
    rows = own.groupBy("question_id", "asks").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return rows.select("question_id", F.concat("asks", F.array_join(F.transform("rows", lambda r: r["block"]), "")).alias("input"), F.transform("rows", lambda r: r.dropFields("rank", "block")).alias("included"))


def generated(inputs: DataFrame, generate: Callable[[list[str]], list[str]], batch: int = 16) -> DataFrame:
    """question_id, answer: what the given model says to each input."""

    def run(frames):
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch]
                said = generate(part["input"].tolist())
                if len(said) != len(part):
                    raise ValueError("the model gave another number of answers")
                yield pd.DataFrame({"question_id": part["question_id"], "answer": said})

    kind = inputs.schema["question_id"].dataType.simpleString()
    return inputs.select("question_id", "input").mapInPandas(run, f"question_id {kind}, answer string")


def with_citations(answers: DataFrame) -> DataFrame:
    """answers with `citations`, what they cite of `included` in order of mention, and `problem` where an answer is empty,
    cites nothing though its context was enough, or what it was not given."""
    found = vectors.citations(answers.withColumn("n_included", F.size("included")), "answer", "n_included")
    cited = F.transform(F.coalesce("cited", F.array().cast("array<int>")), lambda i: F.struct(F.concat(F.lit("S"), i.cast("string")).alias("citation_id"), F.get("included", i - 1).alias("of")))
    problem = F.when(F.col("answer").isNull(), "empty answer").when((F.size("cited") > 0) & ~F.col("valid"), "cites what was not retrieved").when((F.size("cited") == 0) & ~F.col("insufficient"), "cites nothing")
    return found.withColumns({"problem": problem, "citations": F.when(problem.isNull(), cited)}).drop("cited", "valid", "n_included")


def answered(
    questions: DataFrame, passages: DataFrame, generate: Callable[[list[str]], list[str]], dimensions: int, embed: Callable[[list[str]], list[list[float]]] | None = None,
    k: int = 5, threshold: float = 0.42, budget: int = 12_000, sources: list[str] | None = None, but_itself: bool = False,
) -> DataFrame:
    """A row for each question: question_id, question, style, answer, citations, n_retrieved, n_included, top_similarity,
    insufficient, problem. questions: question_id, question, style, and their embedding if no model is given for it;
    passages: PASSAGE and an embedding each; sources: the only ones to look into. Where nothing is found or the best
    passage is less similar than the threshold, the answer abstains and the model is not asked."""
    checked = checked_questions(questions)
    fine = checked.filter("problem IS NULL")
    if embed is None:
        asked = questions.join(fine.select("question_id"), "question_id", "left_semi").select("question_id", "embedding")
    else:
        asked = loading.embed(fine.select(F.col("question_id").cast("string").alias("chunk_id"), F.col("question").alias("text")), embed, dimensions)
        asked = asked.select(F.col("chunk_id").cast(questions.schema["question_id"].dataType).alias("question_id"), "embedding")
    within = passages if sources is None else passages.filter(F.col("source_id").isin(sources))
    hits = vectors.top_k_of_many(asked, within, k, dimensions, "question_id", "chunk_id", but_itself=but_itself)
    best = hits.groupBy("question_id").agg(F.max("similarity").alias("top_similarity"), F.count("*").alias("n_retrieved"))
    kept = hits.join(best.filter(F.col("top_similarity") >= threshold).select("question_id"), "question_id", "left_semi")
    inputs = contexts(fine, kept, within, budget)
    said = checked_answers(inputs.join(generated(inputs, generate), "question_id"), "answer")
    found = with_citations(said).select("question_id", "answer", "citations", F.size("included").alias("n_included"), "insufficient", F.col("problem").alias("fault"))
    whole = checked.join(best, "question_id", "left").join(found, "question_id", "left")
    abstains = F.col("problem").isNull() & F.col("insufficient").isNull()
    return whole.select(
        "question_id", "question", "style", F.when(abstains, ABSTENTION).otherwise(F.col("answer")).alias("answer"), "citations", F.coalesce("n_retrieved", F.lit(0)).alias("n_retrieved"),
        F.coalesce("n_included", F.lit(0)).alias("n_included"), "top_similarity", F.coalesce("insufficient", abstains).alias("insufficient"), F.coalesce("problem", "fault").alias("problem"),
    )
