"""WARC round trips, URL verdicts, pseudonyms, toxicity, and language-model scores."""

import collections
import datetime
import gzip
import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from arpent.llm import pitman_yor, pseudonyms, toxicity, url_reputation, warc


def digest(html):
    return hashlib.sha1((html or "").encode()).hexdigest()


@pytest.mark.parametrize("split", [warc.SPLIT, 700])
def test_warc_round_trip(spark, tmp_path, split):
    same, small, binary = "é" * 900, "tiny", "".join(map(chr, random.Random(1).choices(range(32, 0x2000), k=3000)))
    pages = [(1, "u", same), (5, None, same), (3, "u", same), (2, "u", small), (4, "u", small), (6, "u\r\nX: y", None), (7, "u", ""), (8, "u", binary), (None, "u", same), (5, "u", same)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    got = sorted((tuple(r) for r in warc.write_and_read(df, f"file://{tmp_path}/a", split).collect()), key=repr)
    want = []
    for i, _, html in pages:
        again = html == same and i != 5
        want.append((i, len((html or "").encode()), digest(html), "revisit" if again else "response", 5 if again else None))
    assert got == sorted(want, key=repr)
    assert warc.write_and_read(df.limit(0), f"file://{tmp_path}/b", split).count() == 0


def test_warc_ranges_and_false_magic():
    """Every record has one owner, whatever the ranges; gzip magic inside payloads and foreign members are no records."""
    payloads = [b"a" * 10, warc.MAGIC * 50, gzip.compress(b"WARC/1.1 not a record"), bytes(random.Random(2).randbytes(5000)), b""]
    members = [warc.record(i, "u", p, hashlib.sha1(p).hexdigest()) for i, p in enumerate(payloads)]
    data = gzip.compress(b"not a record") + b"".join(members)
    starts = [m.start() for m in re.finditer(re.escape(warc.MAGIC), data)]
    for split in (1, 7, 100, 1000, len(data)):
        found = [x for lo in range(0, len(data), split) for x in warc.records(io.BytesIO(data), lo, min(lo + split, len(data)))]
        assert [c for _, _, c in found] == payloads and all(at in starts for at, _, _ in found)
    assert list(warc.records(io.BytesIO(data[:-9]), 0, len(data)))[-1][2] == payloads[-2]  # a broken end


def test_warc_long_urls_and_counts(spark, tmp_path):
    """Header blocks of any size are read, and records that are not found are an error."""
    r = random.Random(4)
    urls = ["u", "data:" + "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=200_000)), "http://x/?" + "q" * 70_000, None]
    df = spark.createDataFrame([(i, u, f"page {i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    manifest = warc.write(df, f"file://{tmp_path}/a")
    for split in (warc.SPLIT, 5000):
        got = sorted((x.page_id, x.url, bytes(x.payload)) for x in warc.read(spark, manifest, split).collect())
        assert got == [(i, u or "", f"page {i}".encode()) for i, u in enumerate(urls)]
    assert warc.read(spark, manifest.select("path", "bytes")).count() == manifest.agg(F.sum("records")).first()[0] == 4
    with pytest.raises(Exception, match="in the manifest"):
        warc.read(spark, manifest.withColumn("starts", F.concat("starts", F.array(F.lit(1).cast("long"))))).count()


def verdicts(spark, urls, labels=()):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    marks = spark.createDataFrame(list(labels), "doc_id long, quality int")
    return {r.page_id: r for r in url_reputation.judge(pages, marks).collect()}


def test_url_rules(spark):
    urls = [
        "http://A.Example.COM/en/5", "http://a.example.com/en/75", "http://example.net/de/1", "http://x.example.net/de/8#f", "http://org/es/", "http://notcom/en/",
        None, "no scheme", "http://h?q=http://com/en/", "http://example.com/EN/5", "x://com:80/en/", "http://com",
    ]
    got = verdicts(spark, urls)
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(urls))] == [
        ("a.example.com", "/en/5", "com/en/", "block"), ("a.example.com", "/en/75", "example.com/en/7", "allow"), ("example.net", "/de/1", "net/de/", "block"),
        ("x.example.net", "/de/8", "example.net/de/8", "allow"), ("org", "/es/", "org/es/", "block"), ("notcom", "/en/", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("h", "", None, "allow"), ("example.com", "/EN/5", None, "allow"), ("com:80", "/en/", None, "allow"), ("com", "", None, "allow"),
    ]


def test_url_reputation_shrinks(spark):
    urls = [f"http://bad.one.info/{i}" for i in range(60)] + [f"http://h{i % 30}.two.info/{i}" for i in range(300)] + ["http://new.one.info/", "http://h1.two.info/x"]
    got = verdicts(spark, urls, [(i, 0) for i in range(60)] + [(60 + i, int(i // 30 > 0)) for i in range(300)] + [(None, 0), (361, None)])
    assert {got[i].verdict for i in range(60)} == {"block"} and {got[i].verdict for i in range(60, 360)} == {"allow"} and got[361].verdict == "allow"
    suffixes = spark.createDataFrame([("a.b.co.uk",), ("a.b.com",), ("1.2.3.4:80",), ("x",), ("u@a.b.org",)], "h string")
    pairs = [tuple(r) for r in suffixes.select(*url_reputation.suffix_and_domain(F.col("h"))).collect()]
    assert pairs == [("co.uk", "b.co.uk"), ("com", "b.com"), ("1.2.3.4", "1.2.3.4"), ("x", "x"), ("org", "b.org")]


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def iban_ok(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def hidden(spark, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")
    return [r.text for r in pseudonyms.pseudonymized(df).orderBy("doc_id").collect()]


def test_pseudonyms_keep_formats(spark):
    given = [
        "4532015112830366", "4532 0151 1283 0366", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "+1 (415) 555-2671", "192.168.0.1", "123-45-6789", "2023-02-28",
        "29/02/2024", "1.3.1999", "jane.doe42@example.org", "+4915112345678", "(415) 555-2671", "415-555-2671",
    ]
    got = hidden(spark, *given)
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", s)))
    assert all(a != b for a, b in zip(given, got, strict=True))
    assert all(shape(a) == shape(b) for i, (a, b) in enumerate(zip(given, got, strict=True)) if i not in (5, 9))
    assert luhn(got[0]) and luhn(got[1]) and got[1].replace(" ", "") == got[0] and iban_ok(got[2]) and iban_ok(got[3])
    assert got[4].startswith("+1 (") and all(int(o) <= 255 for o in got[5].split(".")) and got[10].endswith("@example.org")
    area, group, serial = got[6].split("-")
    assert area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"
    assert datetime.date.fromisoformat(got[7]) and datetime.datetime.strptime(got[8], "%d/%m/%Y") and datetime.datetime.strptime(got[9], "%d.%m.%Y")


def test_pseudonyms_leave_the_rest(spark):
    same = [None, "", "4532015112830367", "2023-02-30", "300.1.1.1", "version 4.0, 12 of 34", "000-12-3456", "GB82 WEST 1234 5698 7654 33", "a@b", "x" * 200_000]
    assert hidden(spark, *same) == same


def test_pseudonyms_link_and_differ(spark):
    numbers = [f"10.0.{i // 256}.{i % 256}" for i in range(600)]
    got = hidden(spark, *numbers)
    assert len(set(got)) == 600 and hidden(spark, "see 10.0.0.7!", "x\n10.0.0.7") == [f"see {got[7]}!", f"x\n{got[7]}"]
    days = [(datetime.date(1999, 1, 1) + datetime.timedelta(k)).isoformat() for k in range(500)]
    assert len(set(hidden(spark, *days))) == 500
    both = hidden(spark, "a 4532015112830366 4556737586899855 z")[0].split()
    assert both[0] == "a" and both[3] == "z" and luhn(both[1]) and luhn(both[2])
    df = spark.createDataFrame([("mail me@example.org", 3)], "text string, n int")
    r = pseudonyms.pseudonymized(df, key="other", replaced="times").first()
    assert r.n == 3 and r.times == 1 and r.text != pseudonyms.pseudonymized(df).first().text


def feistel(kind, text, back=False, key=pseudonyms.KEY):
    """The network over characters in plain Python, and its inverse."""

    def shift(half, beside, turn):
        digest = hashlib.sha512(f"{key}|{kind}|{turn}|{beside}".encode()).digest()
        out = ""
        for i, c in enumerate(half):
            for first, n in (("0", 10), ("A", 26), ("a", 26)):
                if ord(first) <= ord(c) < ord(first) + n:
                    by = digest[i % 64] * (-1 if back else 1)
                    c = chr(ord(first) + (ord(c) - ord(first) + by) % n)
                    break
            out += c
        return out

    cut = len(text) // 2
    a, b = text[:cut], text[cut:]
    for turn in range(pseudonyms.ROUNDS, 0, -1) if back else range(1, pseudonyms.ROUNDS + 1):
        a, b = (shift(b, a, turn), a) if back else (b, shift(a, b, turn))
    return a + b


def test_pseudonyms_against_plain_python(spark):
    """Numbers in several spellings against a second implementation, and back to the values they came from."""
    r = random.Random(3)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    check = lambda d: next(d + c for c in "0123456789" if luhn(d + c))
    cards = [check("4" + digits(14)) for _ in range(20)]
    phones = [("49", digits(9)), ("1", digits(10)), ("380", digits(9)), ("44", digits(10))]
    mails = [("jane.doe42", "@example.org"), ("X", "@a.b.co"), ("o_r-7+z", "@example.net")]
    spelt = lambda c: [c, f"{c[:4]} {c[4:8]} {c[8:12]} {c[12:]}", f"{c[:4]}-{c[4:8]}-{c[8:12]}-{c[12:]}"]
    got = hidden(spark, *[x for c in cards for x in spelt(c)])
    for k, c in enumerate(cards):
        want = check(feistel("card", c[:-1]))
        assert got[3 * k : 3 * k + 3] == spelt(want) and feistel("card", want[:-1], back=True) == c[:-1]
    ways = lambda land, n: [f"+{land}{n}", f"+{land} {n[:3]} {n[3:6]} {n[6:]}", f"+{land}-{n[:3]}-{n[3:6]}-{n[6:]}", f"+{land} ({n[:3]}) {n[3:6]}.{n[6:]}"]
    assert hidden(spark, *[x for p in phones for x in ways(*p)]) == [x for land, n in phones for x in ways(land, feistel("phone", n))]
    own = feistel("phone", "4155552671")
    assert hidden(spark, "(415) 555-2671", "415.555.2671") == [f"({own[:3]}) {own[3:6]}-{own[6:]}", f"{own[:3]}.{own[3:6]}.{own[6:]}"]
    assert hidden(spark, *[a + b for a, b in mails]) == [feistel("mail", a) + b for a, b in mails]
    long = feistel("iban", "WEST12345698765432")
    a, b, c = hidden(spark, "GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432", "GB82 WEST12345698765432")
    assert a.replace(" ", "") == b == c.replace(" ", "") and b[4:] == long and iban_ok(b) and feistel("iban", long, back=True) == "WEST12345698765432"
    one, two, three = hidden(spark, "2024-03-01", "01.03.2024", "1/3/2024")
    assert datetime.date.fromisoformat(one) == datetime.datetime.strptime(two, "%d.%m.%Y").date() == datetime.datetime.strptime(three, "%d/%m/%Y").date()


def test_pseudonyms_of_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([("call +49 30 1234567", "kept", 1)], "text string, _found string, _replaced int")
    out = pseudonyms.pseudonymized(docs)
    assert out.columns == docs.columns and out.first()._found == "kept" and out.first()._replaced == 1 and "1234567" not in out.first().text
    assert pseudonyms.pseudonymized(docs.limit(0)).count() == 0


def test_pseudonyms_ibans_before_other_words(spark):
    """The word, number or IBAN after an IBAN is no part of it; the number after it is found too."""
    ibans = ["BE68 5390 0754 7034", "BE68539007547034", "AT611904300234573201", "ES9121000418450200051332", "SE45 5000 0000 0583 9825 7466", "CZ6508000000192000145399", "PL61109010140000071219812874", "NO9386011117947"]
    assert all(map(iban_ok, ibans))
    after = [" EUR", " 2024", " 7", " A1", " USD 12", " BIC", ", EUR", ""]
    alone = dict(zip(ibans, hidden(spark, *ibans), strict=True))
    assert all(iban_ok(v) and v != k and v[:2] == k[:2] and len(v) == len(k) for k, v in alone.items())
    given = [f"to {i}{a}" for i in ibans for a in after]
    assert hidden(spark, *given) == [f"to {alone[i]}{a}" for i in ibans for a in after]
    card, day, other = hidden(spark, "4532 0151 1283 0366", "2024-01-31", "GB82 WEST 1234 5698 7654 32")
    both = hidden(spark, f"{ibans[0]} 4532 0151 1283 0366", f"{ibans[1]} 2024-01-31", f"{ibans[3]} GB82 WEST 1234 5698 7654 32", f"{ibans[4]} {ibans[0]}")
    assert both == [f"{alone[ibans[0]]} {card}", f"{alone[ibans[1]]} {day}", f"{alone[ibans[3]]} {other}", f"{alone[ibans[4]]} {alone[ibans[0]]}"]


def test_pseudonyms_early_dates(spark):
    """Dates before 1600 are permuted within their cycle too, those of the first cycle without the year 0."""
    days = [(datetime.date(start, 1, 1) + datetime.timedelta(k)).isoformat() for start in (1, 398, 1200, 1599) for k in range(0, 360, 3)]
    got = hidden(spark, *days)
    assert len(set(got)) == len(days) and sum(a != b for a, b in zip(days, got, strict=True)) > 0.99 * len(days)
    for a, b in zip(days, got, strict=True):
        assert datetime.date.fromisoformat(b).year // 400 == int(a[:4]) // 400
    assert hidden(spark, "0000-01-01", "1500-02-29") == ["0000-01-01", "1500-02-29"]
    d, m, y = hidden(spark, "03/04/1492")[0].split("/")
    assert datetime.date(int(y), int(m), int(d)) != datetime.date(1492, 4, 3)


def toxic_corpus(n=600):
    r = random.Random(0)
    parts = "ent ion the ing er lo ta mi ra so ne ku pa vi do".split()
    word = lambda: "".join(r.choice(parts) for _ in range(r.randrange(1, 4)))
    out = []
    for i in range(n):
        words = [word() for _ in range(120)]
        bad = i % 4 == 0
        for _ in range(9 if bad else 0):
            words[r.randrange(120)] = r.choice(["zgwortqux", "brfhassjk", "kxdeppwv"])
        out.append((i, " ".join(words), int(bad)))
    return out


def directly(model, text):
    """The score by fresh compressors for each window, in plain Python."""
    params = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_BTOPT, window_log=20, hash_log=18, chain_log=19, search_log=4, min_match=4, target_length=32,
        write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    words, gains = (text or "").lower().split(), []
    for i in range(0, len(words), 8):
        w = (" " + " ".join(words[i : i + 8]) + " ").encode()
        size = []
        for d in (model.plain, model.toxic):
            d = zstandard.ZstdCompressionDict(d)
            d.precompute_compress(compression_params=params)
            size.append(len(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress(w)))
        gains.append(size[0] - size[1] if size[0] >= model.hard * len(w) else 0)
    x = [1.0, *(math.log1p(sum(g >= m for g in gains)) for m in (2, 3, 4, 5, 6, 8)), max([0, *gains]), sum(gains) / max(1, len(gains)), math.log1p(len(gains))]
    return 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(x, model.weights, strict=True))))))


def test_toxicity_held_out(spark):
    rows = toxic_corpus()
    long = " ".join(t for _, t, y in rows if not y)
    docs = spark.createDataFrame([(i, t, 9.0) for i, t, _ in rows] + [(1000, None, 0.0), (1001, "", 0.0), (1002, long, 0.0), (3, "other", 0.0), (3, "other", 0.0), (None, "x", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None), (8, 0)], "doc_id long, toxic int")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = toxicity.train(docs, labels, fold != 1)
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    held = [(y, got[i].predicted) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(p for y, p in held if y) >= 0.9 * sum(y for y, _ in held) and sum(p for y, p in held if not y) <= 0.05 * len(held)
    assert got[1000].score == got[1001].score < 0.7 and all(0 <= r.score <= 1 for r in got.values())
    for i, t in [(r[0], r[1]) for r in rows[:12:2]] + [(1000, None)]:
        assert abs(got[i].score - directly(model, t)) < 1e-9
    assert toxicity.scored(docs, model).count() == docs.count() and toxicity.scored(docs, model).filter("doc_id = 3").select("score").distinct().count() <= 2
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    none = toxicity.train(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in toxicity.scored(docs, none).collect()} == {0.0}
    assert toxicity.scored(docs.limit(0), model).count() == 0


def test_toxicity_of_few_labels(spark):
    """Two labelled rows are enough for a model; of one kind alone there is none."""
    docs = spark.createDataFrame([(1, "good words here"), (2, "bad words there"), (2, "bad words again"), (3, None)], "doc_id long, text string")
    labels = lambda *rows: spark.createDataFrame(rows, "doc_id long, toxic int")
    assert toxicity.scored(docs, toxicity.train(docs, labels((1, 0), (2, 1), (3, 0)), F.lit(True))).count() == 4
    assert toxicity.train(docs, labels((2, 1), (3, 1)), F.lit(True)).weights == []
    assert toxicity.train(docs, labels((1, 0), (3, 1)), F.lit(True)).weights != []


def test_pitman_yor_counts_and_held_out(spark):
    r = random.Random(3)
    topics = [[f"{c}{k}" for k in range(60)] for c in "ab"]
    rows = [(i, " ".join(r.choice(topics[i % 2]) for _ in range(r.randrange(1, 60)))) for i in range(300)] + [(900, None), (901, ""), (None, "a1 A2\x0bzz"), (5, "a1")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, part int")
    got = pitman_yor.scored(docs).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    c = collections.Counter(w for i, t in rows if not out(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted(((repr(i), out(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 8)) for i, t in rows))
    assert sorted((repr(x.doc_id), x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 8)) for x in got) == want
    held = [x for x in got if x.held_out]
    assert sum(x.score for x in held) > sum(x.base_score for x in held) and all(x.score < 0 for x in got)
    assert pitman_yor.scored(docs.limit(0)).count() == 0


def test_pitman_yor_is_a_distribution():
    rng = np.random.default_rng(0)
    words = np.array(sorted({pitman_yor._hash(f"w{k}".encode()) for k in range(40)}), np.uint64)
    h = rng.choice(words, 3000)
    c = (h[np.arange(3000) - 1] & np.uint64(pitman_yor.FINE - 1)).astype(np.int64)
    order = np.lexsort((c, h))
    blob = pitman_yor.pack(*(lambda a, b: (a, np.ones(len(a), np.int32), b.astype(np.uint32), np.ones(len(a), np.int32)))(h[order], c[order]))
    state = pitman_yor.State.merged([blob])
    assert state.count.sum() == 3000 and len(state.words) == 40
    totals = []
    for k in range(2):
        state.sweep(pitman_yor.Totals(state.totals()), k)
        assert (state.tables >= 1).all() and (state.tables <= state.count).all() and (state.coarse_tables <= state.coarse_count).all()
        state.keep_sample()
        totals.append(pitman_yor.Totals(state.totals()))
    model = pitman_yor.Model(pitman_yor.State.unpack(state.pack()), totals)
    for ctx in (int(c[0]), int(c[1]), 17):
        p = 10 ** model.log10(np.append(np.arange(40), -1), np.full(41, ctx))
        assert abs(p.sum() - 1) < 1e-9


def test_stirling_numbers():
    s = pitman_yor.stirling(0.5)
    assert np.allclose(np.exp(s[3, 1:4]), [0.5 * 1.5, 1.5, 1])
    n, d, table = 60, 0.7, [[0.0] * 62 for _ in range(62)]  # the recurrence in plain numbers
    table[1][1] = 1.0
    for i in range(1, n):
        for m in range(1, i + 2):
            table[i + 1][m] = table[i][m - 1] + (i - m * d) * table[i][m]
    assert np.allclose(pitman_yor.stirling(d)[n, 1 : n + 1], np.log(table[n][1 : n + 1]))


class Seating:
    """The same hierarchy by a sampler that reseats one customer after the other, with tables of their own sizes."""

    def __init__(self, d, s, base, r):
        self.d, self.s, self.base, self.r = d, s, base, r
        self.sizes, self.n, self.t = collections.defaultdict(list), collections.Counter(), collections.Counter()

    def path(self, ctx):
        return [(2, ctx), (1, ctx // pitman_yor.PER_COARSE), (0, 0)]

    def p(self, path, w):
        if not path:
            return self.base
        level, own = path[0][0], self.sizes[path[0], w]
        n, t = self.n[path[0]], self.t[path[0]]
        return (sum(own) - self.d[level] * len(own) + (self.s[level] + self.d[level] * t) * self.p(path[1:], w)) / (self.s[level] + n)

    def add(self, path, w):
        if not path:
            return
        level, own = path[0][0], self.sizes[path[0], w]
        new = (self.s[level] + self.d[level] * self.t[path[0]]) * self.p(path[1:], w)
        weights = [x - self.d[level] for x in own] + [new]
        k = self.r.choices(range(len(weights)), weights)[0]
        self.n[path[0]] += 1
        if k < len(own):
            own[k] += 1
        else:
            own.append(1)
            self.t[path[0]] += 1
            self.add(path[1:], w)

    def remove(self, path, w):
        if not path:
            return
        own = self.sizes[path[0], w]
        k = self.r.choices(range(len(own)), own)[0]
        own[k] -= 1
        self.n[path[0]] -= 1
        if not own[k]:
            del own[k]
            self.t[path[0]] -= 1
            self.remove(path[1:], w)


def test_scores_against_a_sequential_sampler(spark):
    """The model's probabilities of held-out texts, to two hundredths of a digit a token on average."""
    r = random.Random(21)
    words = [f"w{k}" for k in range(30)]
    after = {w: r.choices(words, k=4) for w in words}

    def made():
        out = [r.choice(words)]
        while len(out) < 25:
            out.append(r.choice(after[out[-1]]) if r.random() < 0.8 else r.choice(words))
        return " ".join(out)

    rows = [(i, made()) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in pitman_yor.scored(docs, burn_in=4, samples=8).collect()}
    states, totals = pitman_yor.fit(docs, 4, burn_in=4, samples=8)
    last, tokens = totals[-1], {}
    for i, t in rows:
        h, _ = pitman_yor.tokens([t])
        tokens[i] = list(zip(pitman_yor.contexts(h).tolist(), h.tolist(), strict=True))
    train = [x for i, _ in rows if not got[i].held_out for x in tokens[i]]
    own = Seating(last.d, last.s, last.base, r)
    for ctx, w in train:
        own.add(own.path(ctx), w)
    logs = []
    for sweep in range(10):
        for ctx, w in r.sample(train, len(train)):
            own.remove(own.path(ctx), w)
            own.add(own.path(ctx), w)
        if sweep >= 4:
            logs.append({i: [own.p(own.path(c), w) for c, w in tokens[i]] for i, _ in rows if got[i].held_out})
    want = {i: sum(math.log10(sum(p) / len(p)) for p in zip(*(x[i] for x in logs), strict=True)) for i in logs[0]}
    n = sum(got[i].n_tokens for i in want)
    assert len(want) > 5 and abs(sum(want.values()) - sum(got[i].score for i in want)) / n < 0.02
    assert all(abs(want[i] - got[i].score) / got[i].n_tokens < 0.06 for i in want)
    base = sum(got[i].base_score for i in want)
    assert sum(want.values()) > base + 0.1 * n  # the comparison is not of two models that learned nothing


def test_pitman_yor_without_training_rows_and_long_texts(spark):
    """Held-out rows alone, and a text of a million words with long ones, in any number of partitions."""
    out = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    none = spark.createDataFrame([(i, "a b") for i in out], "doc_id long, text string")
    got = pitman_yor.scored(none).collect()
    assert [(x.held_out, x.n_tokens, x.n_known, x.train_tokens) for x in got] == [(True, 3, 0, 0)] * 3 and all(x.score == pytest.approx(0, abs=1e-9) for x in got)
    long = " ".join(f"w{k % 5000}" for k in range(1_000_000)) + " " + "q" * 400_000
    docs = spark.createDataFrame([(1, long), (2, "w1 w2"), (3, None)], "doc_id long, text string")
    got = {x.doc_id: x for x in pitman_yor.scored(docs, burn_in=0, samples=1).collect()}
    assert got[1].n_tokens == 1_000_002 and got[1].n_known == (0 if got[1].held_out else got[1].n_tokens) and got[3].n_tokens == 1
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        again = {x.doc_id: x.score for x in pitman_yor.scored(docs, burn_in=0, samples=1).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(again[i] == pytest.approx(got[i].score, rel=1e-6) for i in again)


@pytest.mark.parametrize("labels", [10, 2_000, 3_000, 100_000, 1_000_000])
def test_pseudonyms_of_many_labels(spark, labels):
    """Domains of any number of labels, through the operator and through the pipeline's stage."""
    import corpus_pipeline

    domain, r = "@b" + ".c" * labels, random.Random(labels)
    texts = [f"jane.doe42{domain}", f"see a{domain}, b", f"x{domain}..", f"a@b{'-' * labels}", "@" * labels, "a@" * labels, "a." * labels, "." * labels + "@b.c"]
    name = feistel("mail", "jane.doe42")
    got = hidden(spark, *texts)
    assert got[0] == name + domain and got[1] == f"see {feistel('mail', 'a')}{domain}, b" and got[2] == f"{feistel('mail', 'x')}{domain}.."
    assert got[3] == texts[3] and got[4] == texts[4] and got[6] == texts[6] and len(got[5]) == len(texts[5]) and r
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    assert [x.text for x in corpus_pipeline.hide_personal(spark, docs, "").orderBy("doc_id").collect()] == got


def test_pseudonyms_of_a_million_signs(spark):
    """Long rows of each format's signs before a value that is found; IBANs take 80 microseconds a sign."""
    size = lambda s: 20_000 if s == "GB82 " else 1_000_000
    signs = ["1", "12 ", "+", "+1 ", "(415) ", "415-", "1.", "1/", "2023-", "GB82 ", "A1B2 ", "4532 ", "4532-0151-", "a", "-", " ", "é"]
    texts = [s * (size(s) // len(s)) for s in signs]
    got = hidden(spark, *[t + " mail 2023-02-28!" for t in texts])
    day = hidden(spark, "2023-02-28")[0]
    assert all(len(a) == len(t) + len(" mail 2023-02-28!") and a.endswith(f" mail {day}!") for t, a in zip(texts, got, strict=True))
