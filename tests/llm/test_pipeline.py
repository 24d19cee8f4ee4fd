"""The queries on the smallest tables, and the pipeline stage by stage."""

import collections
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from arpent.llm import pseudonyms, queries, toxicity
from tests.llm.test_pages_and_text import feistel

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracles(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = con.execute(queries.ORACLE[name])
    names = [x[0] for x in found.description]
    df = queries.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=repr) == sorted(found.fetchall(), key=repr)


def test_thirteen_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_the_whole_pipeline_against_brute_force(spark, sf_dir, tmp_path):
    """run() over whole texts, with a very long one, near copies, mails and telephone numbers, against plain Python."""
    other = re.compile("|".join((pseudonyms.NATIONAL, pseudonyms.IBAN, pseudonyms.IPV4, pseudonyms.DAY, pseudonyms.SOCIAL, pseudonyms.CARD)))
    fine = lambda t: not other.search(t or "")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if fine(r.text)]
    n, r = max(x[0] for x in rows), random.Random(31)
    base = " ".join(f"w{r.randrange(5000)}" for _ in range(60_000))
    made = [base, base + " more", f"write to jane.doe42@example.org now {r.random()}", f"call +49 30 1234567 or +1 (415) 555-2671 {r.random()}", None, "", "x@b" + ".c" * 5000]
    rows += [(n + 1 + i, t, "en", "made", len(t or "")) for i, t in enumerate(made)]
    spark.createDataFrame(rows, DOC).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(tuple(x) for x in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect())

    model = toxicity.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"), F.lit(True))
    docs = [(i, t) for (i, t, *_), s in zip(rows, toxicity.Scorer(model).scores([x[1] for x in rows]), strict=True) if s < 0.7]
    sets, root = {i: shingles(t) for i, t in docs}, {i: i for i, _ in docs}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            root[max(top(a), top(b))] = min(top(a), top(b))
    docs = [(i, t) for i, t in docs if top(i) == i]

    def hidden(m):
        x = m[0]
        if "@" in x:
            name, at, domain = x.partition("@")
            return feistel("mail", name) + at + domain
        digits = re.sub("[^0-9]", "", x)
        if not 8 <= len(digits) <= 15:
            return x
        land = re.match(f"(?:{pseudonyms.LAND}|[0-9]{{3}})", digits)[0]
        new = iter(land + feistel("phone", digits[len(land) :]))
        return re.sub("[0-9]", lambda _: next(new), x)

    either = re.compile(f"{pseudonyms.MAIL}|{pseudonyms.PHONE}")
    tokenizer, want, total = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), [], 0
    tokenizer.encode_special_tokens = False
    for i, t in docs:
        ids = [*tokenizer.encode(either.sub(hidden, t or ""), add_special_tokens=False).ids, 1]
        total += len(ids)
        for piece, start in enumerate(range(0, len(ids), 4096)):
            own = ids[start : start + 4096]
            want.append((i, piece, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert [x[:5] for x in got] == sorted(want) and n + 2 not in {x[0] for x in got} and len(docs) < len(rows) - 3
    places = collections.defaultdict(list)
    for *_, length, _, sequence, offset in got:
        places[sequence].append((offset, length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= 1 + 1.05 * total / 4096


def test_stages_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir)
        assert after.columns == docs.columns, name
        before = after
    assert docs.count() >= before.count() > 0.8 * docs.count()


def test_stages_in_small(spark, sf_dir):
    text = "one two three four five six seven eight nine ten"
    rows = [(10**9 + i, t, "en", "s", len(t or "")) for i, t in enumerate([text, text, text + " eleven", "mail jane.doe@example.org", None, "", "10.1.2.3 and words"])]
    docs = spark.createDataFrame(rows, DOC)
    assert corpus_pipeline.drop_toxic(spark, docs, sf_dir).count() == 7
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf_dir)
    assert sorted(r.doc_id - 10**9 for r in kept.collect()) == [0, 3, 4, 5, 6]
    hidden = {r.doc_id - 10**9: r for r in corpus_pipeline.hide_personal(spark, docs, sf_dir).collect()}
    assert hidden[0].text == text and "jane.doe" not in hidden[3].text and "10.1.2.3" not in hidden[6].text and hidden[6].n_chars == len(hidden[6].text) and hidden[4].text is None
    packed = corpus_pipeline.pack(spark, docs, sf_dir)
    assert packed.count() == 7 and packed.select("sequence_id").distinct().count() == 1
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), sf_dir).count() == 0


def test_stages_leave_other_columns_alone(spark, sf_dir):
    """Columns named as the operators' own stay as they are, and empty tables give empty tables."""
    own = ["row_key", "_text_key", "_replaced", "_found", "cls", "score", "ids", "_row", "_shard"]
    docs = spark.createDataFrame([(10**9 + i, f"some words of document {i} call +49 30 1234567", *range(len(own))) for i in range(3)], "doc_id long, text string, " + ", ".join(f"{c} int" for c in own))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert out.select(own).distinct().collect() == docs.select(own).distinct().collect(), name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
    assert corpus_pipeline.pack(spark, docs, sf_dir).count() == 3
    assert corpus_pipeline.pack(spark, docs.limit(0), sf_dir).count() == 0
