"""HTML pages as ordered elements: headings, paragraphs, list items and table rows of the main content.

Parsing is a small helper inside an Arrow-batched map over pages; what follows it - repeats, order, counting - are
column expressions and windows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arpent.functions.text import clean_inline

#: Tags without content of their own, hints of interface blocks, and labels of interface elements.
DROPPED = ("script", "style", "noscript", "template", "nav", "footer", "header", "form", "aside", "svg", "button", "iframe")
HINTS = (
    "cookie", "newsletter", "breadcrumb", "share", "social", "menu", "nav", "footer", "header", "sidebar", "pagination",
    "search", "skip-link", "back-to-top", "consent", "banner",
)
LABELS = (
    "république française", "republique francaise", "se connecter", "s'enregistrer", "ressources communautaires",
    "informations", "télécharger", "telecharger", "menu", "rechercher", "connexion", "inscription", "accueil", "partager",
    "imprimer", "fermer", "retour", "suivant", "précédent", "precedent", "paramètres d'affichage", "parametres d'affichage",
)
PREFIXES = ("fichiers", "réutilisations", "reutilisations", "discussions", "ressources communautaires")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
BLOCKS = {"p": "paragraph", "li": "list_item", "tr": "table_row"} | {f"h{n}": "heading" for n in range(1, 7)}
LONGEST_ROW = 2000


@dataclass
class Node:
    tag: str
    attrs: dict
    inside: list = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        """All nodes within, in document order. No walk recurses, so pages may be nested as deep as they are."""
        rest = self.inside[::-1]
        while rest:
            x = rest.pop()
            if isinstance(x, Node):
                yield x
                rest += x.inside[::-1]

    def text(self) -> str:
        out, rest = [], self.inside[::-1]
        while rest:
            x = rest.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                rest += x.inside[::-1]
        return "".join(out)


class Builder(HTMLParser):
    """A tree in which an end tag closes the nearest open element of its name and those within it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.n_open = [Node("", {})], Counter()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].inside.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.n_open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.open[-1].inside.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        if not self.n_open[tag]:
            return
        while (closed := self.open.pop()).tag != tag:
            self.n_open[closed.tag] -= 1
        self.n_open[tag] -= 1

    def handle_data(self, data):
        self.open[-1].inside.append(data)


def _prune(node: Node, gone: Callable[[Node], bool]) -> None:
    rest = [node]
    while rest:
        n = rest.pop()
        n.inside = [x for x in n.inside if isinstance(x, str) or not gone(x)]
        rest += [x for x in n.inside if isinstance(x, Node)]


def _is_interface(node: Node) -> bool:
    named = " ".join(node.attrs.get(a, "") for a in ("class", "id", "role")).lower()
    return any(hint in named for hint in HINTS)


def elements(page: str | None) -> list[tuple[str, str, int | None]]:
    """(kind, text, heading level) in document order; nested blocks are visited each on their own."""
    builder = Builder()
    builder.feed(page or "")
    builder.close()
    root = builder.open[0]
    _prune(root, lambda n: n.tag in DROPPED)
    nodes = list(root.walk())
    articles = [n for n in nodes if n.tag == "article"]
    regions = [n for n in nodes if n.tag == "main"] or [n for n in nodes if n.attrs.get("role") == "main"] or [n for n in nodes if n.tag == "body"]
    main = max(articles, key=lambda n: len(n.text())) if articles else (regions or [root])[0]
    _prune(main, _is_interface)
    out = []
    for n in main.walk():
        if (kind := BLOCKS.get(n.tag)) is None:
            continue
        if kind == "table_row":
            cells = (clean_inline(c.text()) for c in n.walk() if c.tag in ("td", "th"))
            text = " | ".join(c for c in cells if c)[:LONGEST_ROW]
        else:
            text = clean_inline(n.text())
        out.append((kind, text, int(n.tag[1]) if kind == "heading" else None))
    return out


def is_interface_text(text):
    """A column: the text is a label or a short fragment of an interface."""
    low = F.lower(F.trim(text))
    begins = F.lit(False)
    for p in PREFIXES:
        begins = begins | low.startswith(p)
    return low.isin(*LABELS) | ((F.length(low) <= 40) & begins)


def page_elements(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, order, kind, text, heading_level: without blanks, interface texts and texts that repeat the one before."""

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 64):
                part = batch.slice(lo, 64)
                found = [elements(page) for page in part.column(html).to_pylist()]
                rows = pa.array([k for k, own in enumerate(found) for _ in own], pa.int64())
                places, each = [i for own in found for i in range(len(own))], [e for own in found for e in own]
                columns = [pa.array([e[k] for e in each], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(key).take(rows), pa.array(places, pa.int32()), *columns], names=[key, "place", "kind", "text", "heading_level"])

    kind = pages.schema[key].dataType.simpleString()
    found = pages.select(key, html).mapInArrow(run, f"{key} {kind}, place int, kind string, text string, heading_level int")
    found = found.filter((F.col("text") != "") & ~is_interface_text(F.col("text")))
    order = Window.partitionBy(key).orderBy("place")
    kept = found.withColumn("_before", F.lag("text").over(order)).filter(~F.col("text").eqNullSafe(F.col("_before")))
    return kept.withColumn("order", F.row_number().over(order) - 1).select(key, "order", "kind", "text", "heading_level")
