"""Misspelt words against plain ratios, the plan that compares them, and the bounded history."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from arpent.functions.text import like_words, may_be_like, searchable
from arpent.operators import conversation as C


def ratio(word, candidates):
    return max(difflib.SequenceMatcher(None, word, c).ratio() for c in candidates)


def misspelt(r, word):
    for _ in range(r.randint(0, 2)):
        k = r.randrange(len(word) + 1)
        word = r.choice([word[:k] + r.choice("abcdeilnorstu") + word[k:], word[:k] + word[k + 1 :], word[:k][::-1] + word[k:]]) or "x"
    return word


@pytest.mark.parametrize("candidates, least", [(C.GREETING_WORDS, C.LIKE_GREETING), (C.LANGUAGES, C.LIKE_LANGUAGE)])
def test_like_words_against_plain_ratios(spark, candidates, least):
    r = random.Random(6)
    words = [misspelt(r, r.choice(candidates)) for _ in range(800)] + ["", "zzzz", "q" * 300, "eeeeeeeeee"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    want = {w for w in words if ratio(w, candidates) >= least}
    assert {x.w for x in like_words(df, "w", candidates, least).collect()} == want and 20 < len(want) < len(set(words))
    passed = {x.w for x in df.filter(may_be_like(F.col("w"), candidates, least)).collect()}
    assert want <= passed and "zzzz" not in passed and "q" * 300 not in passed


def plain_marks(text):
    t = searchable(text)
    tokens = t.split()
    typo = len(tokens) == 1 and len(t) >= 4 and ratio(t, C.GREETING_WORDS) >= C.LIKE_GREETING
    return typo, len(tokens) <= 12 and any(ratio(w, C.LANGUAGES) >= C.LIKE_LANGUAGE for w in tokens)


def test_marks_of_messages_against_plain_ratios(spark, sf_dir):
    r = random.Random(7)
    made = [" ".join(r.choice([misspelt(r, r.choice(C.LANGUAGES)), "en", "plus", "court", misspelt(r, r.choice(C.GREETING_WORDS))]) for _ in range(r.choice([1, 1, 1, 3, 12, 13]))) for _ in range(300)]
    real = [x.text for x in spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("role = 'user'").select("text").collect()]
    texts = [*made, *real, None, "", "  ", "bonjur", "bonjur", "Répondez en anglai"]
    df = spark.createDataFrame([(i, t, searchable(t)) for i, t in enumerate(texts)], "i int, text string, _t string")
    got = {x.i: (x._typo, x._language) for x in C.with_misspelt(df, "_t").collect()}
    assert got == {i: plain_marks(t) for i, t in enumerate(texts)}
    assert len([1 for m in got.values() if m[0]]) > 5 and len([1 for m in got.values() if m[1]]) > 5


def test_ratios_are_taken_of_different_words_alone(spark):
    df = spark.createDataFrame([(1, "bonjur", None), (2, "bonjur", None)], "turn int, text string, previous string")
    plan = C.with_routes(df)._jdf.queryExecution().optimizedPlan().toString()
    calls = [line for line in plan.split("\n") if "ArrowEvalPython" in line and "is_like" in line]
    assert calls
    for k, line in enumerate(plan.split("\n")):
        if line in calls:  # below each call stands the aggregate of its words
            assert any("Aggregate" in x for x in plan.split("\n")[k + 1 : k + 3])


def test_history_is_bounded(spark):
    rows = [("a", n, "user" if n in (0, 5, 19, 20) else "assistant", f"m{n}") for n in range(21)] + [("b", 3, "user", "only")] + [("c", 1, "user", None), ("c", 2, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = {(x.conv_id, x.turn): x for x in C.recalled_turns(df).collect()}
    assert set(got) == {("a", 0), ("a", 5), ("a", 19), ("a", 20), ("b", 3), ("c", 1), ("c", 2)}
    assert [m.text for m in got["a", 20].history] == [f"m{n}" for n in range(8, 20)] and got["a", 20].previous == "m19"
    assert got["a", 19].previous is None and len(got["a", 19].history) == 12  # the user's last message is too long ago
    assert got["a", 5].previous == "m0" and got["b", 3].history == [] and got["b", 3].previous is None and got["c", 2].previous is None
