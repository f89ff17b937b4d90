"""Event identity: normalised titles and venues, keys, and the similarity of variants."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .timeutil import DATE_IN_TEXT

CITY = "тернопіль"
#: Suffixes that sites append to titles, fixed patterns: the city, "tickets", prices from and at.
SUFFIXES = (
    rf"(?iuU)\s+\b{CITY}\b.*$",
    r"(?iuU)\s+\bквитки\b.*$",
    r"(?iuU)\s+\bвід\s+\d+(?:[.,]\d+)?\s*(?:грн|₴|uah)?\b.*$",
    r"(?iuU)\s+\b\d+(?:[.,]\d+)?\s*(?:грн|₴|uah)\b.*$",
)
#: Keywords of categories by priority, fixed values; the first that fits wins.
CATALOGUE = (("standup", ("стендап", "stand-up")), ("festival", ("фестив",)), ("theatre", ("театр", "вистав")), ("concert", ("концерт",)), ("circus", ("цирк",)), ("children", ("дит",)))
GENERIC = (("standup", ("стендап", "stand-up")), ("theatre", ("театр", "вистав")), ("festival", ("фестив",)), ("concert", ("концерт",)))
MONTH_PAGE = (("concert", ("концерт",)), ("theatre", ("театр",)), ("standup", ("stand-up",)))
DEFAULT_CATEGORY = "Інше"
CARDS = (("standup", ("стендап", "stand-up", "stand up")), ("festival", ("фестив",)), ("theatre", ("театр", "вистав")), ("concert", ("концерт", "concert")), ("circus", ("цирк",)), ("children", ("дит",)))
#: Parts of prices: a number with spaces, a range, the currency; fixed values.
_NUMBER, _DASH, _HRYVNIA = r"\d[\d\s]*", "(?:-|–)", "грн"
PRICE = rf"(?iu)({_NUMBER}{_DASH}\s*{_NUMBER}\s*{_HRYVNIA}|{_NUMBER}\s*{_HRYVNIA}|від\s*{_NUMBER}\s*(?:₴|{_HRYVNIA}))"
#: Words that say an event is over, cancelled or moved, one vocabulary for each dialect; fixed values.
LINE_ENDED = (r"подія\s+закінчилась", r"подія\s+закінчилася", r"event\s+ended", "скасовано", "перенесено")
MONTH_PAGE_ENDED = ("скасовано", "перенесено", "cancelled", "transferred", "продано")
CATALOGUE_ENDED = ("скасовано", "перенесено", "cancelled", "postponed")


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def squeezed(text: Column) -> Column:
    """White space, no-break space too, as single spaces; trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\xa0]+", " "))


def normalized(text: Column, compose: bool = False) -> Column:
    """Lower case letters, digits and underscores, with single spaces between. compose: NFKC first, which needs Python; texts that are NFKC already don't."""
    return squeezed(F.regexp_replace(F.lower(_nfkc(text) if compose else text), r"[^\p{L}\p{N}_\s]", " "))


def bare_title(title: Column) -> Column:
    """A title without dates, sites' suffixes and dangling separators; the title itself if nothing is left."""
    out = F.regexp_replace(title, DATE_IN_TEXT, " ")
    for pattern in SUFFIXES:
        out = F.regexp_replace(out, pattern, "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?U)\s{2,}", " "), r"(?U)\s+([,:])", "$1")
    out = F.regexp_replace(F.regexp_replace(out, r"(?U)[,|]\s*$", ""), r"^[ \-—|,:]+|[ \-—|,:]+$", "")
    return F.coalesce(F.nullif(out, F.lit("")), title)


def group_key(title: Column, start: Column, venue: Column) -> Column:
    when = F.coalesce(F.date_format(start, "yyyy-MM-dd-HH-mm"), F.lit("unknown-time"))
    return F.sha2(F.concat_ws("|", normalized(bare_title(F.coalesce(title, F.lit("")))), when, normalized(F.coalesce(venue, F.lit("")))), 256)


def external_id(url: Column, title: Column, start: Column) -> Column:
    """32 hexadecimal digits from url, title and ISO start (empty if there is none)."""
    when = F.coalesce(F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
    return F.substring(F.sha2(F.concat(F.coalesce(url, F.lit("")), F.lit("|"), F.coalesce(title, F.lit("")), F.lit("|"), when), 256), 1, 32)


def category_of(text: Column, ladder=CATALOGUE) -> Column:
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for name, words in reversed(ladder):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


def any_pattern(words: tuple[str, ...]) -> str:
    """One of the words, anywhere."""
    return f"(?iu){'|'.join(words)}"


def word_pattern(words: tuple[str, ...]) -> str:
    """One of the words, standing alone."""
    return rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(words)})(?![\p{{L}}\p{{N}}_])"


def catalogue_price(text: Column) -> Column:
    """A catalogue card's price: a range, an amount with what white space is before it, or "from" an amount."""
    pattern = rf"(?iu){_NUMBER}\s*{_DASH}\s*{_NUMBER}\s*{_HRYVNIA}|[\d\s]+\s*{_HRYVNIA}|від\s*[\d\s]+\s*(?:₴|{_HRYVNIA})"
    return F.nullif(squeezed(F.regexp_extract(text, pattern, 0)), F.lit(""))


def price_of(text: Column) -> Column:
    return F.nullif(squeezed(F.regexp_extract(text, PRICE, 1)), F.lit(""))


def like_literal(text: Column, term: str, wildcards: bool = False) -> Column:
    """Case-blind substring search; wildcards lets % and _ in the term match as in LIKE."""
    term = " ".join(term.split()).lower()
    if not term:
        return F.lit(False)
    if wildcards:
        return F.lower(text).like("%" + term.replace("\\", "\\\\") + "%")
    return F.contains(F.lower(text), F.lit(term))


def overlap(a: Column, b: Column) -> Column:
    """Shared distinct words by the smaller number of distinct words; null if one has none."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))), F.lit(0))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), 1))


def ratio(a: str, b: str) -> float:
    """Matching characters of the longest common blocks, twice, by both lengths; the order of the arguments matters."""
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else 1.0 if x == y else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def could_reach(a: Column, b: Column, least: float) -> Column:
    """Whether lengths allow a ratio of least: a cheap exact filter before sequence_ratio."""
    return 2 * F.least(F.length(a), F.length(b)) >= least * (F.length(a) + F.length(b))


def same_title(a: str, b: str) -> bool:
    """Whether two normalised bare titles are variants: equal, 0.90 similar, or 85 % of the shorter's words (3 at least) in the other."""
    if a == b or ratio(a, b) >= 0.90:
        return True
    x, y = set(a.split()), set(b.split())
    return min(len(x), len(y)) >= 3 and len(x & y) / min(len(x), len(y)) >= 0.85


def same_venue(a: str, b: str) -> bool:
    """Whether two normalised venues are variants; a missing one fits any."""
    return not a or not b or a in b or b in a or ratio(a, b) >= 0.80


def event_card(title: Column, start: Column, venue: Column, prices: Column) -> Column:
    """A card's text: title without its date, local day and time, venue or city, the distinct prices in order. start is UTC."""
    from .timeutil import to_local

    local = to_local(start)
    shown = F.array_join(F.array_sort(F.array_distinct(F.filter(prices, lambda p: p.isNotNull() & (p != "")))), ", ")
    return F.concat(
        F.lit("🎟️ <b>"), bare_title(title), F.lit("</b>\n📅 "), F.coalesce(F.date_format(local, "dd.MM.yyyy"), F.lit("Дата уточнюється")),
        F.lit("\n🕐 "), F.coalesce(F.date_format(local, "HH:mm"), F.lit("Час уточнюється")),
        F.lit("\n📍 "), F.coalesce(F.nullif(venue, F.lit("")), F.lit(CITY.capitalize())), F.lit("\n"),
        F.when(shown != "", F.concat(F.lit("💰 "), shown, F.lit("\n"))).otherwise(""),
    )


def reminder(title: Column, start: Column, venue: Column, price: Column, url: Column) -> Column:
    """A reminder's text; lines whose value is missing or empty are left out. start is printed as it is."""
    given = lambda c, made: F.when(F.coalesce(c.cast("string"), F.lit("")) != "", made)
    return F.concat_ws(
        "\n", F.lit("🔔 <b>Нагадування про подію</b>"), F.lit(""), F.concat(F.lit("<b>"), title, F.lit("</b>")),
        given(start, F.concat(F.lit("📅 "), F.date_format(start, "dd.MM.yyyy"), F.lit(" о "), F.date_format(start, "HH:mm"))),
        given(venue, F.concat(F.lit("📍 "), venue)), given(price, F.concat(F.lit("💰 "), price)),
        given(url, F.concat(F.lit('\n🎫 <a href="'), url, F.lit('">Купити квиток</a>'))),
    )
