"""Deep pages, faulty documents, and tools from the registry: nothing is lost and nothing takes others with it."""

import json
import random

import pytest
from pyspark.sql import functions as F

from arpent.functions.html_elements import elements, page_elements
from arpent.functions.text import clean_inline
from arpent.operators import analytics, chunking, energy, market
from arpent.plans import corpus, tools
from arpent.policy import InputError, Policy
from tests.test_energy import frame


@pytest.mark.parametrize("depth", [3, 500, 100_000])
def test_pages_of_any_depth(depth):
    page = f"<body>{'<div>' * depth}<p>one</p>{'</div>' * depth}<p>two</p></body>"
    assert elements(page) == [("paragraph", "one", None), ("paragraph", "two", None)]
    assert elements(f"<body>{'<div>' * depth}<p>one<p>two") == [("paragraph", "onetwo", None), ("paragraph", "two", None)]
    assert elements(f"<body>{'</b>' * depth}<p>{'<b>' * depth}x</p></i><p>y") == [("paragraph", "x", None), ("paragraph", "y", None)]


def made_page(r, depth=0):
    """A random page and its elements, by recursion: (html, text, elements within)."""
    html, text, found = "", "", []
    for _ in range(r.randint(0, 3) if depth else 4):
        kind = r.choice(["text", "div", "p", "h2", "li", "nav", "b", "menu", "tr"]) if depth < 6 else "text"
        inner, said, within = made_page(r, depth + 1) if kind != "text" else ("", "", [])
        if kind == "text":
            word = r.choice(["alpha ", "beta&amp;", "\n gamma", "é", ""])
            html, text = html + word, text + word.replace("&amp;", "&")
        elif kind == "nav":
            html += f"<nav>{inner}</nav>"
        elif kind == "menu":
            html += f'<div class="top Menu">{inner}</div>'
        elif kind == "tr":
            cell = r.choice(["x", " y  z", ""])
            html, text = html + f"<tr><td>{cell}</td><th>{cell}</th></tr>", text + cell + cell
            found.append(("table_row", " | ".join(c for c in [clean_inline(cell)] * 2 if c), None))
        elif kind in ("div", "b"):
            html, text = html + f"<{kind}>{inner}</{kind}>", text + said
            found += within
        else:
            html, text = html + f"<{kind}>{inner}</{kind}>", text + said
            found += [({"p": "paragraph", "h2": "heading", "li": "list_item"}[kind], clean_inline(said), 2 if kind == "h2" else None), *within]
    return html, text, found


def test_elements_against_pages_that_are_known(spark):
    r = random.Random(11)
    pages = [made_page(r) for _ in range(300)]
    assert [elements(f"<html><body>{html}</body></html>") for html, _, _ in pages] == [found for _, _, found in pages]
    df = spark.createDataFrame([(i, f"<body>{html}</body>", "x") for i, (html, _, _) in enumerate(pages)], "page_id long, html string, text string")
    want = []
    for i, (_, _, found) in enumerate(pages):
        kept = [e for e in found if e[1]]
        kept = [e for k, e in enumerate(kept) if k == 0 or e[1] != kept[k - 1][1]]
        want += [(i, k, *e) for k, e in enumerate(kept)]
    assert sorted(tuple(x) for x in page_elements(df).collect()) == want


def test_a_faulty_document_fails_alone(spark, tmp_path):
    element = lambda n, text, kind="paragraph": {"order": n, "kind": kind, "text": text, "heading_level": 1 if kind == "heading" else None, "page_number": None}
    gap = [element(0, "a" * 300), element(2, "b" * 300)]
    crowded = [element(0, "x", "heading"), element(1, "text")]
    docs = [("good", "1", [element(0, "c" * 300)]), ("gap", "2", gap), ("empty", "3", []), ("also good", "4", [element(0, "d" * 300)])]
    df = spark.createDataFrame(docs, f"source_id string, raw_sha256 string, elements {chunking.ELEMENTS}").coalesce(1)
    got = {r.source_id: (r.status, r.error) for r in corpus.chunking_run(spark, df, f"{tmp_path}/c").collect()}
    assert got == {"good": ("chunked", None), "also good": ("chunked", None), "gap": ("failed", "element orders must run from 0 without gaps"), "empty": ("failed", "no text")}
    assert {r.source_id for r in corpus.corpus(spark, f"{tmp_path}/c").collect()} == {"good", "also good"}
    tight = spark.createDataFrame([("crowded", "1", crowded)], df.schema)
    assert corpus.chunking_run(spark, tight, f"{tmp_path}/d", chunking.Sizes(most=40, target=40, overlap=0, least=10)).first().error == "headings leave no room for text"
    mended = spark.createDataFrame([("gap", "2", [element(0, "a" * 300)])], df.schema)
    assert {r.source_id: r.status for r in corpus.chunking_run(spark, mended, f"{tmp_path}/c").collect()}["gap"] == "chunked"
    with pytest.raises(Exception, match="gap: element orders"):
        chunking.chunk_rows(df).collect()


@pytest.fixture
def known(spark):
    diagnostics = energy.curated(frame(spark, *({"numero_dpe": f"n{i}", "etiquette_dpe": "ABCDEFG"[i % 7], "conso_5_usages_par_m2_ep": 100.0 + i} for i in range(16))))
    sales = market.with_eligibility(market.mutations(spark.createDataFrame(
        [(str(i), 2021 + i % 5, "Vente", 300000.0 + i, "75115", "Appartement", 50.0, 2.0, f"p{i}", 2.3, 48.8) for i in range(10)],
        "id_mutation string, source_year int, nature_mutation string, valeur_fonciere double, code_commune string, type_local string, surface_reelle_bati double, nombre_pieces_principales double, id_parcelle string, longitude double, latitude double",
    ).withColumns({"date_mutation": F.lit("2023-01-01").cast("date"), "source_file": F.lit("f"), "source_sha256": F.lit("s")})))
    return tools.registry(sales, diagnostics, lambda q, s: spark.createDataFrame([(q,)], "answer string"))


def test_charts_of_what_the_registry_gives(known):
    rows = tools.execute(known, "analyze_dpe", {})
    assert len(rows.columns) == len(set(rows.columns)) and {"labels_warnings", "intensity_warnings", "pct"} <= set(rows.columns)
    chart = [tuple(r) for r in tools.tool_chart("analyze_dpe", rows).collect()]
    assert chart == [(i, x, pytest.approx(100 * n / 16, abs=0.01)) for i, (x, n) in enumerate(zip("ABCDEFG", (3, 3, 2, 2, 2, 2, 2), strict=True))]
    one = rows.first()
    assert one.labels_fg_count == 4 and one.intensity_n == 16 and one.intensity_consumption_median == 107.5
    trend = tools.execute(known, "get_market_trend", {"start": 2021, "end": 2023})
    assert [r.label for r in tools.tool_chart("get_market_trend", trend).collect()] == ["2021", "2022", "2023"]
    compared = tools.execute(known, "compare_arrondissements", {"areas": [15, 1]})
    assert [r.label for r in tools.tool_chart("compare_arrondissements", compared).collect()] == ["Paris 15e"]
    assert all(json.loads(x) for x in rows.toJSON().collect())


def test_turns_are_settled_before_the_model(spark, known):
    asked = []

    def model(messages):
        asked.append(list(messages))
        return {"calls": [("get_market_overview", {})]} if len(asked) == 1 else {"text": "done"}

    local = tools.settled_turn(spark, model, known, "Bonjour", said=lambda route: f"<{route}>")
    assert local == {"text": "<greeting>", "tools": [], "route": "greeting"} and not asked
    history = [("user", f"m{i}") for i in range(20)]
    got = tools.settled_turn(spark, model, known, "Quel est le prix d'un appartement ?", history)
    assert got == {"text": "done", "tools": [("get_market_overview", True)], "route": "model"}
    assert asked[0] == [("user", f"m{i}") for i in range(8, 20)] + [("user", "Quel est le prix d'un appartement ?")]
    asked.clear()
    narrow = tools.settled_turn(spark, model, known, "Quelle est la répartition des étiquettes DPE ?")
    assert narrow["tools"] == [("get_market_overview", False)]  # not among what this question may use


def test_large_results_are_told_not_cut(known):
    script = iter([{"calls": [("get_market_trend", {})]}, {"text": "done"}])
    seen = []
    assert tools.run_turn(lambda m: seen.append(list(m)) or next(script), known, "?", rows=2)["tools"] == [("get_market_trend", False)]
    assert "more than 2 rows" in seen[1][-1][1]
    with pytest.raises(InputError):
        analytics.market_overview(known["get_market_overview"].run(), start=1900, policy=Policy())
