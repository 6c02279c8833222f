"""Filing texts: normalisation, item headings, exhibits, dividend facts, and tags inferred from a profile.

Texts are read as lines and words: a heading is a line whose first words are a heading's,
an amount or a date belongs to the word that comes before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def _character(code: Column) -> Column:
    """The character of a code point; nothing for a number that is none."""
    n = code.try_cast("long")
    high, low = F.lit(0xD800) + F.shiftright(n - 0x10000, 10), F.lit(0xDC00) + (n - 0x10000).bitwiseAND(F.lit(1023))
    units = F.when(n < 0x10000, F.lpad(F.hex(n), 4, "0")).otherwise(F.concat(F.hex(high), F.hex(low)))
    valid = ((n > 0) & (n < 0xD800)) | ((n > 0xDFFF) & (n < 0x110000))
    return F.when(valid, F.decode(F.unhex(units), "UTF-16BE")).otherwise("")


def normalized(text: Column) -> Column:
    """Ends of paragraphs, rows and list items as line ends, other tags as blanks, entities decoded, runs of blanks and line ends made one."""
    told = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)<(?:br\s*/?|/(?:p|div|tr|li))>", "\n")
    told = F.regexp_replace(told, r"<[^>]+>", " ")
    for name, mark in (("nbsp", " "), ("amp", "&"), ("quot", '"'), ("lt", "<"), ("gt", ">")):
        told = F.regexp_replace(told, f"(?i)&{name};", mark)
    told = _let(told, lambda t: F.array_join(F.zip_with(
        F.split(t, r"&#\d+;", -1), F.regexp_extract_all(t, F.lit(r"&#(\d+);"), F.lit(1)), lambda piece, code: F.concat(piece, F.coalesce(_character(code), F.lit("")))
    ), ""))
    told = F.regexp_replace(F.replace(F.replace(told, F.lit("\r"), F.lit("")), F.lit("\t"), F.lit(" ")), " {2,}", " ")
    return F.regexp_replace(F.regexp_replace(told, "\n{2,}", "\n"), r"^\s+|\s+$", "")


def _words(line: Column) -> Column:
    return F.filter(F.split(line, r"\s+"), lambda w: w != "")


def _rest(words: Column, at: Column) -> Column:
    """The words from place ``at`` on, without a full stop at the end; null if there are none."""
    said = F.array_join(F.slice(words, at + 1, F.greatest(F.size(words) - at, F.lit(0))), " ")
    return F.nullif(F.regexp_replace(said, r"\s*\.$", ""), F.lit(""))


def _heading(line: Column, code: str, parts: bool) -> Column:
    """struct(code, title) of a line that begins with the word item and a code, else null; with ``parts`` a part may be named before."""

    def read(w: Column) -> Column:
        word = lambda i: F.lower(F.coalesce(F.get(w, i), F.lit("")))
        skip = F.when((word(0) == "part") & word(1).rlike(r"^[ivx]+\.?$"), 2).otherwise(0) if parts else F.lit(0)
        number = F.rtrim(F.coalesce(F.get(w, skip + 1), F.lit("")), F.lit(".:"))
        return F.when((word(skip) == "item") & number.rlike(code), F.struct(F.upper(number).alias("code"), _rest(w, skip + 2).alias("title")))

    return _let(_words(line), read)


def items(text: Column, form: Column) -> Column:
    """The items of a normalised filing: array of (code, title, body); a body runs to the next heading.

    8-K headings have codes like 5.02; other forms have codes like 1A, titles of at most 180
    characters, and fall back to the former if none is found. A title is null if nothing
    follows the code.
    """

    def by(code: str, parts: bool) -> Column:
        def read(lines: Column) -> Column:
            heads = F.transform(lines, lambda line, i: F.struct(_heading(line, code, parts).alias("h"), i.alias("at")))
            found = F.filter(heads, lambda x: x["h"].isNotNull() & (F.lit(not parts) | (F.length(F.coalesce(x["h"]["title"], F.lit(""))) <= 180)))
            return _let(found, lambda f: F.transform(f, lambda x, i: F.struct(
                x["h"]["code"].alias("code"), x["h"]["title"].alias("title"),
                F.regexp_replace(F.array_join(F.slice(lines, x["at"] + 2, F.coalesce(F.get(f, i + 1)["at"], F.size(lines)) - x["at"] - 1), "\n"), r"^\s+|\s+$", "").alias("body"),
            )))

        return _let(F.split(text, "\n"), read)

    current, periodic = by(r"^\d+\.\d+$", False), by(r"(?i)^\d{1,2}[a-z]?(\.\d+)?$", True)
    return F.when(form == "8-K", current).otherwise(_let(periodic, lambda p: F.when(F.size(p) > 0, p).otherwise(current)))


def exhibits(text: Column) -> Column:
    """(number, description) of a normalised filing's exhibits, each pair once.

    The list begins at the line that says (d) Exhibits, or else at that of the column heads
    Exhibit No. and Description, and ends at the next lettered or numbered section. A number
    like 99.1 or 101.INS opens a line; descriptions have three characters or more.
    """

    def read(lines: Column) -> Column:
        plain = F.transform(lines, lambda line: F.regexp_replace(F.lower(line), r"\s+", ""))
        lettered = F.array_position(F.transform(plain, lambda p: p.contains("(d)exhibit")), True)
        headed = F.array_position(F.transform(plain, lambda p: p.rlike(r"exhibitno\.?description")), True)
        begin = F.when(lettered > 0, lettered).otherwise(headed).cast("int")
        rest = F.slice(lines, F.greatest(begin, F.lit(1)) + 1, F.size(lines))
        section = lambda line: F.regexp_replace(F.lower(line), r"\s+", "").rlike(r"^(\([a-z]\)|item\d+\.\d)")
        stop = _let(F.array_position(F.transform(rest, section), True).cast("int"), lambda s: F.when(s > 0, s - 1).otherwise(F.size(lines)))
        rows = F.transform(F.slice(rest, F.lit(1), stop), lambda line: _let(_words(line), lambda w: F.struct(
            F.rtrim(F.coalesce(F.get(w, 0), F.lit("")), F.lit(".")).alias("number"), _rest(w, F.lit(1)).alias("description")
        )))
        good = F.filter(rows, lambda x: x["number"].rlike(r"(?i)^\d{1,3}(\.[0-9a-z]+)*$") & (F.length(x["description"]) >= 3))
        return F.when(begin > 0, F.array_distinct(good)).otherwise(F.slice(good, 1, 0))

    return _let(F.split(text, "\n"), read)


def dividend(text: Column) -> Column:
    """What a text says of a dividend; null if it says none of it.

    previous and current are the amounts of a share that it goes from and to; annualized is
    an amount that is called so within the next words. A date belongs to the nearest of the
    words declared, record and payable (paid) before it; the first date of each counts.
    """

    def read(raw: Column) -> Column:
        return _let(F.transform(raw, lambda x: F.regexp_replace(F.lower(x), r"^[(\"]+|[.,;:)\"]+$", "")), lambda w: found(raw, w))

    def found(raw: Column, w: Column) -> Column:
        word = lambda i: F.coalesce(F.get(w, i), F.lit(""))
        money = lambda i: F.when(word(i).startswith("$"), F.replace(F.substring(word(i), 2, 40), F.lit(","), F.lit("")).try_cast("double"))
        places = F.transform(w, lambda x, i: i)
        moved = F.filter(places, lambda i: (word(i) == "from") & money(i + 1).isNotNull() & (word(i + 2) == "to") & money(i + 3).isNotNull() & (word(i + 4) == "per") & word(i + 5).startswith("share"))
        yearly = F.filter(places, lambda i: money(i).isNotNull() & F.exists(F.slice(w, i + 2, 4), lambda x: x.isin("annualized", "annualised")))
        role = lambda x: F.when(x.isin("payable", "paid"), "payable").when(x.isin("declared", "record"), x)
        dated = F.filter(places, lambda i: word(i).rlike("^[a-z]+$") & word(i + 1).rlike(r"^\d{1,2}$") & word(i + 2).rlike(r"^\d{4}$"))
        owned = F.transform(dated, lambda i: F.struct(
            F.element_at(F.filter(F.transform(F.slice(w, 1, i), role), lambda x: x.isNotNull()), -1).alias("role"), F.concat(F.get(raw, i), F.lit(" "), word(i + 1), F.lit(", "), word(i + 2)).alias("day")
        ))
        day = lambda kind: F.get(F.filter(owned, lambda o: o["role"] == kind), 0)["day"]
        told = F.struct(
            money(F.get(moved, 0) + 1).alias("previous"), money(F.get(moved, 0) + 3).alias("current"), money(F.get(yearly, 0)).alias("annualized"),
            day("declared").alias("declared"), day("record").alias("record"), day("payable").alias("payable"),
        )
        return _let(told, lambda t: F.when(F.coalesce(*[t[c].cast("string") for c in ("previous", "annualized", "declared", "record", "payable")]).isNotNull(), t))

    return F.try_element_at(F.transform(F.array(_words(F.coalesce(text, F.lit("")))), read), F.lit(1))


#: The tag of a sector, and of an industry by its whole name.
SECTOR_TAGS = {
    "Technology": "tech", "Healthcare": "healthcare", "Financial Services": "financial", "Energy": "energy", "Industrials": "industrial", "Utilities": "utilities",
    "Consumer Defensive": "consumer_staples", "Consumer Cyclical": "consumer", "Communication Services": "communication", "Basic Materials": "materials", "Real Estate": "real_estate",
}
INDUSTRY_TAGS = {
    "Semiconductors": "semiconductor", "Biotechnology": "biotech", "Banks": "banking", "Insurance": "insurance", "Utilities": "utilities", "Aerospace & Defense": "defense",
    "Software - Infrastructure": "software", "Software - Application": "software", "Consumer Electronics": "hardware", "Medical Devices": "medical",
    "Drug Manufacturers - General": "pharma", "Drug Manufacturers - Specialty & Generic": "pharma",
}
#: Tags of words that an industry's name, and a description, holds anywhere.
INDUSTRY_WORDS = {
    "software": ["software"], "oil_gas": ["oil", "gas"], "banking": ["bank"], "insurance": ["insurance"], "medical": ["medical"], "defense": ["aerospace", "defense"], "hardware": ["electronic", "hardware"],
}
DESCRIPTION_WORDS = {
    "ai": ["artificial intelligence", " ai "], "data_center": ["data center"], "cloud": ["cloud"], "cybersecurity": ["cybersecurity"], "robotics": ["robotics"], "defense": ["defense"],
    "power_infra": ["electric power", "power generation", "grid"], "consumer": ["consumer", "retail", "e-commerce"],
}
#: Names of a profile's flags and their tags.
FLAGS = {"is_adr": "adr", "is_etf": "etf", "is_fund": "fund", "is_actively_trading": "actively_trading"}


def infer_tags(profile: dict[str, Column]) -> Column:
    """Tags of a profile, each once in the order of the rules: sector, industry, country, flags, description, size, beta, dividend.

    ``profile`` names columns: sector, industry, country, description, market_cap, beta,
    last_dividend, price and the flags; what isn't named counts as null. The yield is four
    times the last dividend by the price.
    """
    at = lambda name, kind="string": profile.get(name, F.lit(None)).cast(kind)
    low = lambda name: F.lower(F.trim(F.coalesce(at(name), F.lit(""))))
    named = lambda name, tags: F.coalesce(*[F.when(at(name) == k, t) for k, t in tags.items()])
    holds = lambda name, tags: [F.when(F.greatest(*[low(name).contains(w) for w in words], F.lit(False)), tag) for tag, words in tags.items()]
    cap, beta, paid, price = (at(c, "double") for c in ("market_cap", "beta", "last_dividend", "price"))
    rate = F.when((paid > 0) & (price > 0), 4 * paid / price)
    rules = [
        named("sector", SECTOR_TAGS), named("industry", INDUSTRY_TAGS), *holds("industry", INDUSTRY_WORDS),
        F.when(at("country") == "US", "us_listed").when(F.nullif(at("country"), F.lit("")).isNotNull(), "non_us"), F.when(at("country") == "CN", "china_exposure"),
        *[F.when(at(flag, "boolean"), tag) for flag, tag in FLAGS.items()], *holds("description", DESCRIPTION_WORDS),
        F.when(cap >= 200e9, "megacap").when(cap >= 10e9, "largecap").when(cap >= 2e9, "midcap").when(cap > 0, "smallcap"),
        F.when(F.isnan(beta), None).when(beta < 0.8, "low_beta").when(beta <= 1.2, "mid_beta").when(beta > 1.2, "high_beta"),
        F.when(rate.isNull(), "non_dividend").when(rate < 0.02, "low_dividend").when(rate < 0.05, "mid_dividend").otherwise("high_dividend"),
    ]
    return F.array_distinct(F.filter(F.array(*rules), lambda t: t.isNotNull()))


def allowed_revenue_family(industry: Column, family: Column) -> Column:
    """Whether a revenue tag's family fits the company: banks, REITs, utilities and health care have families of their own."""
    name = F.lower(F.trim(F.coalesce(industry, F.lit(""))))
    special = F.when(name.contains("bank"), "bank").when(name.contains("reit"), "reit").when(name.contains("utilit"), "utility").when(name.contains("health"), "healthcare")
    return family.isNull() | (family == "general") | F.coalesce(family == special, F.lit(False))
