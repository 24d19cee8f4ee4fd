"""Text functions. What Spark has built in is an expression; Unicode normal forms and HTML entities are Arrow UDFs."""

from __future__ import annotations

import difflib
import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

_TO_BLANK = {0xA0: " ", 0x202F: " ", 0xAD: None}


def clean(text: str | None) -> str:
    """Entities resolved, composed, one blank for runs of them, lines stripped, at most one empty line between."""
    text = unicodedata.normalize("NFC", html.unescape(text or "")).translate(_TO_BLANK)
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    lines = (re.sub(r"[^\S\n]+", " ", line).strip() for line in text.split("\n"))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def clean_inline(text: str | None) -> str:
    return re.sub(r"\s+", " ", clean(text)).strip()


def searchable(text: str | None) -> str:
    """Lower-case letters and digits without accents, between single blanks."""
    plain = unicodedata.normalize("NFKD", (text or "").casefold())
    return re.sub(r"[^a-z0-9]+", " ", "".join(c for c in plain if not unicodedata.combining(c))).strip()


@F.pandas_udf(StringType())
def clean_text(x: pd.Series) -> pd.Series:
    return x.map(clean)


@F.pandas_udf(StringType())
def search_text(x: pd.Series) -> pd.Series:
    return x.map(searchable)


def may_be_like(word: Column, candidates: tuple[str, ...], least: float) -> Column:
    """Whether a word's ratio of matching blocks with any of the candidates can reach `least`: the letters that two words
    have in common, with repeats, are at least as many as those in matching blocks. Built-in expressions alone; what
    they let through has its ratio taken by `like_words`."""
    shapes = F.array(*(F.struct(F.lit(len(c)).alias("size"), F.array(*(F.struct(F.lit(x).alias("letter"), F.lit(c.count(x)).alias("n")) for x in sorted(set(c)))).alias("letters")) for c in candidates))

    def reaches(c: Column) -> Column:
        shared = F.aggregate(c["letters"], F.lit(0), lambda n, x: n + F.least(F.length(word) - F.length(F.replace(word, x["letter"], F.lit(""))), x["n"]))
        return 2.0 * shared / (F.length(word) + c["size"]) >= least

    return F.coalesce(F.exists(shapes, reaches), F.lit(False))


def like_words(words: DataFrame, column: str, candidates: tuple[str, ...], least: float) -> DataFrame:
    """The different words of a column whose ratio of matching blocks with any of the candidates is at least `least`."""

    @F.pandas_udf(BooleanType())
    def is_like(x: pd.Series) -> pd.Series:
        return x.map(lambda w: any(difflib.SequenceMatcher(None, w, c).ratio() >= least for c in candidates))

    found = words.select(column).filter(may_be_like(F.col(column), candidates, least)).distinct()
    return found.filter(is_like.asNondeterministic()(column))  # else the filter would be moved below the aggregate


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(text), r"(?U)\s+"), lambda w: w != ""))


#: What log lines must not show, and what stands there instead.
SECRETS = (
    (r"\bsk-[A-Za-z0-9_-]{8,}\b", "[REDACTED]"),
    (r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+", "[REDACTED]"),
    (r"(?i)(api[_ -]?key|password|token)\s*[:=]\s*\S+", "[REDACTED]"),
    (r"(://[^:/\s]+:)[^@\s]+@", "$1***@"),
)


def redacted(text: Column, most: int = 500) -> Column:
    """Text without keys, bearer tokens, given secrets and passwords in urls; beyond `most` characters an ellipsis."""
    for pattern, put in SECRETS:
        text = F.regexp_replace(text, pattern, put)
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def area_name(number: Column) -> Column:
    return F.when(number.isNull(), "Paris").otherwise(F.concat(F.lit("Paris "), number.cast("string"), F.when(number == 1, "er").otherwise("e")))


def grouped(number: Column) -> Column:
    """A whole number with blanks between its thousands; a dash for null."""
    return F.coalesce(F.translate(F.format_number(number, 0), ",", " "), F.lit("—"))


def signed_percent(x: Column) -> Column:
    return F.coalesce(F.format_string("%+.2f %%", x), F.lit("—"))
