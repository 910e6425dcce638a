"""Posting dates: an exact date, else a relative label at capture time, else the search window's bound."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number words.
ONES = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
TEENS = ("ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
NUMBERS = {"a": 1, "an": 1} | {w: i for i, w in enumerate(ONES, 1)} | {w: i for i, w in enumerate(TEENS, 10)} | {w: 10 * i for i, w in enumerate(TENS, 2)}
#: Units of a label with their abbreviations (each also in the plural) and seconds.
UNITS = {("minute", "min"): 60, ("hour", "hr"): 3600, ("day",): 86_400, ("week",): 604_800}
LETTERS = {"h": 3600, "d": 86_400, "w": 604_800}
SECONDS = {w + s: n for words, n in UNITS.items() for w in words for s in ("", "s")} | LETTERS
#: What a casting of text to a timestamp must look like, so that no lenient reading slips in.
STRICT_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
#: Rank of what a date rests on; higher wins a merge.
BASIS_RANK = {"source_exact": 3, "source_relative": 2, "search_window_bound": 1}


def strict_timestamp(c: Column) -> Column:
    """The instant of a strict ISO text (UTC where it names no offset); null for anything else, such as 30 February."""
    return F.when(F.trim(c).rlike(STRICT_ISO), F.trim(c).try_cast("timestamp"))


def _lookup(table: dict[str, int], key: Column) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])[key]


def number_word(c: Column) -> Column:
    """The value of digits or of one or two number words."""
    parts = F.regexp_extract_all(F.lower(c), F.lit("[0-9]+|[a-z]+"), F.lit(0))
    return F.when(F.size(parts) <= 2, _count(parts, F.size(parts) - 1, alone=True))


def _count(parts: Column, at: Column, alone: bool = False) -> Column:
    """The number that ends at a token: digits, a word, or a word for tens before one for ones. ``alone``: with nothing before it."""
    here, before = F.get(parts, at), F.when(at > 0, F.get(parts, at - 1))
    value = F.coalesce(here.try_cast("int"), _lookup(NUMBERS, here))
    both = F.when(before.isin(*TENS) & here.isin(*ONES), _lookup(NUMBERS, before) + value)
    return F.coalesce(both, F.when(at == 0, value) if alone else value)


def relative_seconds(label: Column) -> Column:
    """Seconds before capture that a label such as ``two days ago`` names, or null: a number, a unit and ``ago`` in a row."""
    parts = F.regexp_extract_all(F.lower(label), F.lit("[0-9]+|[a-z]+"), F.lit(0))
    named = lambda t, i: F.when(F.get(t, i) == "ago", _count(t, i - 2).cast("long") * _lookup(SECONDS, F.get(t, i - 1)))
    found = lambda t: F.filter(F.transform(F.sequence(F.lit(2), F.size(t) - 1), lambda i: named(t, i)), lambda x: x.isNotNull())
    return F.get(F.transform(F.array(parts), lambda t: F.when(F.size(t) >= 3, F.get(found(t), F.lit(0)))), F.lit(0))


def posting_date(posted_at: Column, posted_text: Column, captured_at: Column, window_hours: Column | None = None) -> Column:
    """A struct (value, basis) of a posting; null without evidence. Values are instants, exact dates included."""
    exact, captured = strict_timestamp(posted_at), strict_timestamp(captured_at)
    ago = F.timestamp_micros(F.unix_micros(captured) - relative_seconds(posted_text) * 1_000_000)
    pair = lambda v, basis: F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(basis).alias("basis")))
    found = [pair(exact, "source_exact"), pair(ago, "source_relative")]
    if window_hours is not None:
        edge = F.when(window_hours > 0, F.timestamp_micros(F.unix_micros(captured) - window_hours.cast("long") * 3_600_000_000))
        found.append(pair(edge, "search_window_bound"))
    return F.coalesce(*found)


def basis_rank(basis: Column) -> Column:
    """Rank of a basis; none or ``not_present`` is 0."""
    out = F.lit(0)
    for name, rank in BASIS_RANK.items():
        out = F.when(basis == name, F.lit(rank)).otherwise(out)
    return out


def previous_midnight(now: Column, zone: str) -> Column:
    """The instant of the midnight before today's in a time zone."""
    return F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(now, zone)) - F.expr("INTERVAL 1 DAY"), zone)


def slot(now: Column, hours: int) -> Column:
    """Start of the rolling slot that an instant falls in."""
    return F.window(now, f"{hours} hours")["start"]
