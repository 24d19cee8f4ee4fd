"""Format-preserving pseudonyms for personal numbers, dates and mail names, in DataFrame functions alone.

Found and validated: card numbers (Luhn), IBANs (remainder 97), telephone numbers (8 to 15 digits after a plus, or ten
in groups), IPv4 addresses, social security numbers (valid areas, groups and serials), calendar dates, and the names in
mail addresses.
Each is permuted within its format by a keyed Feistel network, so equal values get equal pseudonyms in all documents
and different values different ones. Numbers are permuted without the blanks, dashes, dots and brackets between their
signs, which are laid back afterwards, so spellings of one number stay linked. Check digits are made anew, so pseudonyms
are valid too.

 - Strings of characters are cut in two halves; in each round a keyed digest of one half shifts every digit and letter
   of the other within its class. Other characters stay.
 - Addresses, security numbers and dates are pairs of numbers in a product of two ranges; in each round a digest of one
   is added to the other, modulo its range. A date stays in its cycle of 400 years, whose 146,097 days are 189 * 773; the
   first cycle has no year 0, and its 145,731 days are 93 * 1567.

An IBAN ends where its country's length says, whatever word or number follows. Only candidates of other countries and
lengths reach as far as groups go, and what stands inside a candidate that fails its check is not searched again.

Values that are not valid stay as they are. Telephone numbers keep their country's code; one in national groups is linked
to the number of ten digits behind a code. Dates keep the order of their fields and whether one digit may stand alone.

Defined results: null stays null, the empty text empty; text of every length is searched whole; no row meets another, so
repeated rows and hot sources need no care; other columns stay, whatever their names. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arpent.llm.common import free_name

#: Rounds of the networks; even, so that halves end where they began.
ROUNDS = 8
#: A key for demonstrations, and the session's setting by which the query and the pipeline are given another.
KEY, KEY_SETTING = "arpent-demonstration-key", "spark.arpent.pseudonym.key"

#: The formats. A group that repeats without a bound is possessive, so that it is a loop, not a recursion.
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
PHONE = r"(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})){2,5}(?![0-9])"
NATIONAL = r"(?<![0-9A-Za-z(+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9]|[.-][0-9])"
#: Characters of an IBAN by country: those of the registry, then those in use without being registered.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST AO CV GW MZ", 26: "IS TR DZ IR", 27: "BI DJ FR GR IT MC MR SM CF CG CM GA GQ KM MG TD",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV BF BJ CI MA ML NE SN TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban(length: int, lands: str) -> str:
    groups, rest = divmod(length - 4, 4)
    return f"(?:{lands.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "")


IBAN_LENGTHS = "|".join(_iban(n, lands) for n, lands in IBAN_COUNTRIES.items())
IBAN = rf"(?<![0-9A-Za-z])(?=[A-Z]{{2}}[0-9]{{2}})(?:{IBAN_LENGTHS}|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)(?![0-9A-Za-z])"
#: Country codes of telephone numbers of one and of two digits; all others have three.
LAND = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
DAY = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4})(?![0-9]|[./-][0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\3[0-9]{5})(?![0-9A-Za-z])"
ANY = "|".join((MAIL, PHONE, NATIONAL, IBAN, IPV4, DAY, SOCIAL, CARD))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _solid(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9A-Za-z]", "")


def _once(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x computed once, however often and in whatever lambda it is used."""
    return F.element_at(F.transform(F.array(x), use), 1)


def _laid(signs: Column, pattern: Column) -> Column:
    """The signs in the places that digits and letters have in pattern, with all else of the pattern between them."""

    def lay(both: Column) -> Column:
        def one(s: Column, c: Column) -> Column:
            is_sign = c.rlike("[0-9A-Za-z]")
            put = F.when(is_sign, F.substring(both["signs"], s["at"] + 1, F.lit(1))).otherwise(c)
            return F.struct((s["at"] + is_sign.cast("int")).alias("at"), F.concat(s["out"], put).alias("out"))

        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        return F.aggregate(F.split(both["pattern"], ""), start, one, lambda s: s["out"])

    return _once(F.struct(signs.alias("signs"), pattern.alias("pattern")), lay)


def _places(x: Column) -> Column:
    """1 to the length of x; nothing for the empty string."""
    return F.filter(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: i <= F.length(x))


def _luhn(digits: Column, check: bool) -> Column:
    """The Luhn sum of digits; with check, as if a check digit 0 followed."""
    first = 1 if check else 0

    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((i + first) % 2 == 0, doubled).otherwise(d)

    return F.aggregate(_places(digits), F.lit(0), add)


def _remainder97(iban: Column) -> Column:
    """The remainder of an IBAN without blanks: its first four characters go last, letters count from 10."""
    turned = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(_places(turned), F.lit(0), add)


def _number(key: str, kind: str, turn: Column, half: Column) -> Column:
    """48 bits of a keyed digest."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def _permuted_pair(key: str, kind: str, a: Column, b: Column, ranges: tuple[int | Column, int | Column]) -> Column:
    """struct(a, b) permuted in the product of the two ranges."""

    def turn(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        a2 = F.when(even, (s["a"] + _number(key, kind, r, s["b"])) % ranges[0]).otherwise(s["a"])
        b2 = F.when(even, s["b"]).otherwise((s["b"] + _number(key, kind, r, s["a"])) % ranges[1])
        return F.struct(a2.alias("a"), b2.alias("b"))

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _permuted_text(key: str, kind: Column, text: Column) -> Column:
    """text with its digits and letters permuted within their classes."""

    def shifted(half: Column, digest: Column) -> Column:
        def one(i: Column) -> Column:
            c = F.ascii(F.substring(half, i, F.lit(1)))
            by = F.conv(F.substring(digest, 2 * ((i - 1) % 64) + 1, F.lit(2)), 16, 10).cast("int")
            in_class = lambda first, n: F.char(first + (c - first + by) % n)
            return (
                F.when(c.between(48, 57), in_class(48, 10))
                .when(c.between(65, 90), in_class(65, 26))
                .when(c.between(97, 122), in_class(97, 26))
                .otherwise(F.substring(half, i, F.lit(1)))
            )

        return F.array_join(F.transform(_places(half), one), "")

    def turn(s: Column, r: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), kind, r.cast("string"), s["b"]), 512)
        return F.struct(s["b"].alias("a"), shifted(s["a"], digest).alias("b"))

    cut = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), cut).alias("a"), F.substring(text, cut + 1, F.length(text)).alias("b"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)
    return F.concat(done["a"], done["b"])


def _classified(m: Column) -> Column:
    """struct(value, kind, head, core, tail): the core is what gets permuted; kind is null for what is not valid."""
    digits, solid = _digits(m), _solid(m)
    whole = lambda pattern: m.rlike(f"^(?:{pattern})$")
    octets = F.split(m, r"\.")
    numbers = F.split(m, "-")
    iso = m.rlike("^[0-9]{4}-")
    day = F.when(iso, F.try_to_timestamp(m, F.lit("yyyy-MM-dd"))).otherwise(F.try_to_timestamp(F.replace(m, F.lit("/"), F.lit(".")), F.lit("d.M.yyyy"))).cast("date")
    kind = (
        F.when(m.contains("@"), "mail")
        .when(m.startswith("+"), F.when(F.length(digits).between(8, 15), "phone"))
        .when(whole(r"(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}"), "phone")
        .when(m.rlike("^[A-Z]"), F.when(_remainder97(solid) == 1, "iban"))
        .when(whole(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"), F.when(F.forall(octets, lambda x: x.cast("int") <= 255), "ipv4"))
        .when(
            whole("[0-9]{3}-[0-9]{2}-[0-9]{4}"),
            F.when((numbers[0] != "000") & (numbers[0] != "666") & (numbers[0] < "900") & (numbers[1] != "00") & (numbers[2] != "0000"), "social"),
        )
        .when(iso & (F.length(digits) == 8) | m.rlike("[./]"), F.when(day.isNotNull() & (F.year(day) >= 1), "day"))
        .otherwise(F.when(F.length(digits).between(13, 19) & (_luhn(digits, False) % 10 == 0), "card"))
    )
    land = F.when(m.startswith("+"), F.regexp_extract(digits, f"^(?:{LAND}|[0-9]{{3}})", 0)).otherwise("")
    head = F.when(kind == "phone", land).when(kind == "iban", F.substring(m, 1, 2)).otherwise("")
    tail = F.when(kind == "mail", F.regexp_extract(m, "@.*$", 0)).otherwise("")
    core = (
        F.when(kind == "mail", F.substring_index(m, "@", 1))
        .when(kind == "card", F.substring(digits, F.lit(1), F.length(digits) - 1))
        .when(kind == "phone", F.substring(digits, F.length(land) + 1, F.length(digits)))
        .when(kind == "iban", F.substring(solid, 5, 40))
    )
    return F.struct(m.alias("value"), kind.alias("kind"), head.alias("head"), core.alias("core"), tail.alias("tail"), day.alias("day"))


def _pseudonym(key: str, x: Column) -> Column:
    m = x["value"]
    moved = _permuted_text(key, x["kind"], x["core"])
    check = lambda number, width: F.lpad(number.cast("string"), width, "0")
    with_check = lambda digits: F.concat(digits, ((10 - _luhn(digits, True) % 10) % 10).cast("string"))
    checked = lambda core: F.concat(x["head"], check(98 - _remainder97(F.concat(x["head"], F.lit("00"), core)), 2), core)
    spelt = (
        F.when(x["kind"] == "card", _once(moved, with_check))
        .when(x["kind"] == "iban", _once(moved, checked))
        .when(x["kind"] == "phone", F.concat(x["head"], moved))
    )
    o = F.transform(F.split(m, r"\."), lambda v: v.cast("long"))
    address = _permuted_pair(key, "ipv4", o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536))
    high, low = address["a"], address["b"]
    ipv4 = F.concat_ws(".", F.floor(high / 256).cast("string"), (high % 256).cast("string"), F.floor(low / 256).cast("string"), (low % 256).cast("string"))
    # areas 001 to 899 without 666 are numbered from 0, groups and serials together from 0
    area, group, serial = (F.substring(_digits(m), *p).cast("long") for p in ((1, 3), (4, 2), (6, 4)))
    social = _permuted_pair(key, "social", area - 1 - (area > 666).cast("long"), (group - 1) * 9999 + serial - 1, (898, 99 * 9999))
    area2 = social["a"] + 1 + (social["a"] >= 665).cast("long")
    social = F.concat_ws("-", check(area2, 3), check(F.floor(social["b"] / 9999) + 1, 2), check(social["b"] % 9999 + 1, 4))
    since = F.datediff(x["day"], F.lit("1600-01-01").cast("date"))
    early = F.year(x["day"]) < 400
    within = F.when(early, F.datediff(x["day"], F.lit("0001-01-01").cast("date"))).otherwise(F.pmod(since, F.lit(146097)))
    rows, width = F.when(early, 93).otherwise(189), F.when(early, 1567).otherwise(773)
    pair = _permuted_pair(key, "day", F.floor(within / width), within % width, (rows, width))
    date = F.date_add(F.lit("1600-01-01").cast("date"), (since - within + pair["a"] * width + pair["b"]).cast("int"))
    apart = F.when(m.contains("/"), "/").otherwise(".")
    short = m.rlike(r"^[0-9][./]|[./][0-9][./]")
    plain = F.when(short, F.date_format(date, "d.M.yyyy")).otherwise(F.date_format(date, "dd.MM.yyyy"))
    day = F.when(m.rlike("^[0-9]{4}-"), F.date_format(date, "yyyy-MM-dd")).otherwise(F.replace(plain, F.lit("."), apart))
    return (
        F.when(x["kind"] == "mail", F.concat(moved, x["tail"]))
        .when(x["kind"].isin("card", "iban", "phone"), _laid(spelt, m))
        .when(x["kind"] == "ipv4", ipv4)
        .when(x["kind"] == "social", social)
        .when(x["kind"] == "day", day)
        .otherwise(m)
    )


def pseudonymized(docs: DataFrame, key: str = KEY, text: str = "text", replaced: str | None = None) -> DataFrame:
    """docs with pseudonyms in the text column and, if a name is given for it, a last column: how many were replaced."""
    searched, held = F.col(text).rlike("[0-9@]"), free_name(docs, "_found")
    found = docs.withColumn(held, F.when(searched, F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    found = found.withColumn(held, F.transform(held, _classified))
    between = F.split(F.col(text), ANY, -1)
    pseudonyms = F.transform(held, lambda x: _pseudonym(key, x))
    joined = F.array_join(F.zip_with(between, pseudonyms, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    added = {text: F.when(F.size(held) > 0, joined).otherwise(F.col(text))}
    if replaced is not None:
        added[replaced] = F.size(F.filter(held, lambda x: x["kind"].isNotNull()))
    return found.withColumns(added).drop(held)
