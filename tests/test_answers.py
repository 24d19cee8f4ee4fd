"""Retrieval for many questions, and answers with abstention, budget, marks and citations."""

import json
import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from arpent.operators import vectors
from arpent.plans import answers
from arpent.plans.corpus import INSUFFICIENT


def cosine(a, b):
    return max(-1.0, min(1.0, sum(x * y for x, y in zip(a, b)) / (math.hypot(*a) * math.hypot(*b))))  # noqa: B905


def usable(v):
    return v is not None and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("vector_bytes, question_bytes", [(4_000_000, 250_000), (32 * 5, 32 * 3)])
@pytest.mark.parametrize("but_itself", [False, True])
def test_top_k_of_many_against_all_pairs(spark, monkeypatch, vector_bytes, question_bytes, but_itself):
    """Blocks of any size, copies, odd vectors, fewer rows than k."""
    monkeypatch.setattr(vectors, "VECTOR_BYTES", vector_bytes)
    monkeypatch.setattr(vectors, "QUESTION_BYTES", question_bytes)
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    rows += [(100 + i, list(rows[i % 3][1])) for i in range(30)] + [(200, None), (201, [0.0] * 4), (202, [1.0, 2.0]), (203, [math.nan, 1.0, 1.0, 1.0]), (204, [None, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    questions = df.filter("vec_id % 7 = 0 OR vec_id >= 200").select(F.col("vec_id").alias("question_id"), "embedding")
    got = sorted(tuple(x) for x in vectors.top_k_of_many(questions, df, 4, 4, but_itself=but_itself).select("question_id", "rank", "vec_id").collect())
    want = []
    for q, a in rows:
        if (q % 7 == 0 or q >= 200) and usable(a):
            found = sorted((-round(cosine(a, b), 12), i) for i, b in rows if usable(b) and not (but_itself and i == q))
            want += [(q, k + 1, i) for k, (_, i) in enumerate(found[:4])]
    assert got == sorted(want)
    few = vectors.top_k_of_many(questions, df.filter("vec_id < 2"), 4, 4)
    assert few.groupBy("question_id").count().select("count").distinct().collect()[0][0] == 2
    assert vectors.top_k_of_many(questions, df.limit(0), 4, 4).count() == 0 and vectors.top_k_of_many(questions.limit(0), df, 4, 4).count() == 0


PASSAGES = "chunk_id string, source_id string, title string, publisher string, url string, section string, page string, text string, embedding array<double>"


def passages(spark, *texts):
    axes = [[1.0, 0.0, 0.0], [0.9, 0.1, 0.0], [0.0, 1.0, 0.0]]
    return spark.createDataFrame([(f"c{i}", f"s{i}", f"Title {i}", "P", f"https://x/{i}", None, None, t, axes[i]) for i, t in enumerate(texts)], PASSAGES)


def ask(spark, said, questions=(("q", "How long?", "auto", [1.0, 0.05, 0.0]),), texts=("ten years", "more", "other"), **more):
    rows = spark.createDataFrame(list(questions), "question_id string, question string, style string, embedding array<double>")
    found = answers.answered(rows, passages(spark, *texts), lambda inputs: [said] * len(inputs), 3, **more)
    return {r.question_id: r for r in found.collect()}


def test_an_answer_with_its_citations(spark):
    r = ask(spark, "  Ten years [S1], and again [S1] [S2]. ", [("q", "  How long? ", None, [1.0, 0.05, 0.0])], k=2)["q"]
    assert r.question == "How long?" and r.style == "auto" and r.answer == "Ten years [S1], and again [S1] [S2]." and not r.insufficient and r.problem is None
    assert [(c.citation_id, c.of.chunk_id, c.of.url) for c in r.citations] == [("S1", "c0", "https://x/0"), ("S2", "c1", "https://x/1")]
    assert r.n_retrieved == r.n_included == 2 and r.top_similarity == pytest.approx(cosine([1, 0.05, 0], [1, 0, 0]))


def test_abstention_does_not_ask_the_model(spark, tmp_path):
    def generate(inputs):
        (tmp_path / "asked").touch()
        return ["x [S1]"] * len(inputs)

    rows = spark.createDataFrame([("weak", "Off topic?", "auto", [0.0, 0.0, 1.0])], "question_id string, question string, style string, embedding array<double>")
    r = answers.answered(rows, passages(spark, "a", "b", "c"), generate, 3).first()
    assert r.insufficient and r.answer == answers.ABSTENTION and r.citations is None and r.problem is None and not (tmp_path / "asked").exists()
    none = answers.answered(rows, passages(spark, "a", "b", "c"), generate, 3, sources=["nowhere"]).first()
    assert none.insufficient and none.n_retrieved == 0 and none.top_similarity is None


@pytest.mark.parametrize(
    "said, answer, insufficient, problem",
    [
        (f"{INSUFFICIENT} : the passages do not say.", "the passages do not say.", True, None),
        ("A fact without a source.", "A fact without a source.", False, "cites nothing"),
        ("A fact [S9].", "A fact [S9].", False, "cites what was not retrieved"),
        ("   ", None, False, "empty answer"),
        (INSUFFICIENT, None, True, "empty answer"),
    ],
)
def test_marks_and_faulty_answers(spark, said, answer, insufficient, problem):
    r = ask(spark, said)["q"]
    assert (r.answer, r.insufficient, r.problem) == (answer, insufficient, problem)


def test_bad_questions_do_not_end_the_run(spark):
    v = [1.0, 0.0, 0.0]
    got = ask(spark, "x [S1]", [("blank", " \n", "auto", v), ("long", "x" * 2001, "auto", v), ("style", "ok?", "epic", v), ("null", None, "auto", v), ("no vector", "ok?", "auto", None), ("fine", "ok?", "brief", v)])
    assert {k: r.problem for k, r in got.items()} == {"blank": "blank question", "long": "question too long", "style": "unknown style", "null": "blank question", "no vector": None, "fine": None}
    assert got["fine"].answer == "x [S1]" and got["no vector"].insufficient and got["blank"].answer is None and not got["blank"].insufficient


def test_contexts_keep_their_budget(spark, tmp_path):
    """What the model is given: heads, styles, cut passages, and nothing after a cut one."""

    def generate(inputs):
        (tmp_path / "inputs").write_text(json.dumps(inputs))
        return ["x [S1]"] * len(inputs)

    rows = spark.createDataFrame([("q", "Why?", "detailed", [1.0, 0.02, 0.0])], "question_id string, question string, style string, embedding array<double>")
    for texts, included in ((["a" * 2200, "b" * 2200, "c"], 1), (["a" * 1000, "b" * 5000, "c"], 2), (["a", "b", "c"], 3), (["a" * 2150, "b", "c"], 1)):
        r = answers.answered(rows, passages(spark, *texts), generate, 3, budget=2500, threshold=-1).first()
        given = json.loads((tmp_path / "inputs").read_text())
        assert r.n_included == included and len(given) == 1 and len(given[0]) <= 2500 and answers.STYLES["detailed"] in given[0]
        assert [f"[S{i}]" in given[0] for i in (1, 2, 3)] == [i <= included for i in (1, 2, 3)]


def test_questions_are_embedded_by_the_given_model(spark):
    rows = spark.createDataFrame([(1, "first axis", "auto"), (2, "second axis", "auto")], "question_id long, question string, style string")
    embed = lambda texts: [[1.0, 0.0, 0.0] if "first" in t else [0.0, 1.0, 0.0] for t in texts]
    found = answers.answered(rows, passages(spark, "a", "b", "c"), lambda inputs: ["x [S1]"] * len(inputs), 3, embed, k=1)
    assert {r.question_id: r.citations[0].of.chunk_id for r in found.collect()} == {1: "c0", 2: "c2"}


def test_a_pair_of_blocks_takes_little_memory():
    """What is held for a pair of blocks does not grow with its questions."""
    r = np.random.default_rng(3)
    v, q = r.normal(size=(6000, 16)), r.normal(size=(480, 16))
    v[7] = v[5]  # equal vectors, told apart by key
    q[3] = v[5]
    tracemalloc.start()
    got = list(vectors.nearest(list(range(480)), q, np.arange(6000), v, 5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8_000_000  # all products at once are 23 MB
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit(q) @ unit(v).T
    want = [(j, int(i)) for j in range(480) for i in np.lexsort((np.arange(6000), -near[j].round(12)))[:5]]
    assert [(n, i) for n, i, _ in got] == want and [i for n, i, _ in got if n == 3][:2] == [5, 7]
