"""Text, URL, identity, location and fingerprint expressions over observed records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query keys that only track visitors.
TRACKING_KEYS = ("ref", "refid", "trackingid", "trk")
#: Names of states, which are no localities, and suffixes that name one.
STATE_NAMES = ("australia", "new south wales", "nsw", "queensland", "qld", "australian capital territory", "act")
#: Words that name the one metropolitan region known by several names.
REGION_WORDS = {"canberra": ("australian capital territory", "act", "canberra")}
#: Geography codes by the order in which they are looked for.
GEOGRAPHIES = {"NSW": ("new south wales", "nsw"), "QLD": ("queensland", "qld"), "ACT": ("australian capital territory", "act")}

NOT_WORD = r"[^\p{L}\p{N}_]+"


def clean(c: Column) -> Column:
    """White space collapsed; blank becomes null."""
    return F.nullif(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def canonical_url(c: Column) -> Column:
    """Scheme and host in lower case, tracking parameters, fragment and trailing slashes removed; blank gives null.

    Parameters are decoded and encoded again, so that one spelling remains: ``a`` is ``a=``, ``%20`` is ``+``.
    """
    url = F.regexp_replace(F.trim(c), "#.*$", "")
    head = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    path = F.regexp_replace(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?]*)?([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(url, r"\?(.*)$", 1)
    plain = lambda part: F.coalesce(F.try_url_decode(part), part)
    again = lambda part: F.replace(F.replace(F.url_encode(plain(part)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    key = lambda kv: F.substring_index(kv, "=", 1)
    name = lambda kv: F.lower(plain(key(kv)))
    kept = F.filter(F.split(query, "&"), lambda kv: (kv != "") & ~name(kv).isin(*TRACKING_KEYS) & ~name(kv).startswith("utm_"))
    value = lambda kv: F.substr(kv, F.length(key(kv)) + 2)
    tail = F.array_join(F.transform(kept, lambda kv: F.concat(again(key(kv)), F.lit("="), again(value(kv)))), "&")
    return F.when(F.trim(c) != "", F.concat(F.lower(head), path, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise("")))


def identity_key(source: Column, native_id: Column, url: Column) -> Column:
    """``source:id:<id>`` where the source gave an id, else ``source:url:<canonical URL>``."""
    fold = lambda c: F.lower(clean(c))
    by_id = F.concat_ws(":", fold(source), F.lit("id"), fold(native_id))
    by_url = F.concat_ws(":", fold(source), F.lit("url"), canonical_url(url))
    return F.when(fold(native_id).isNotNull(), by_id).when(canonical_url(url).isNotNull(), by_url)


def native_id(c: Column) -> Column:
    """Seven to twelve digits, with or without the alias prefix ``li-``."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(c)), r"^(?:li-)?([0-9]{7,12})$", 1), F.lit(""))


def fold(c: Column) -> Column:
    """Lower case, sharp s as ``ss``, runs of other than word characters as one space: stays in the JVM.

    ``fold_exact`` also normalises compatibility characters and folds every script's case.
    """
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "ß", "ss"), NOT_WORD, " "))


@F.pandas_udf(T.StringType())
def fold_exact(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility-normalised, case-folded, word characters only; null becomes the empty text."""
    import re
    import unicodedata

    other = re.compile(r"[^\w]+")
    for s in parts:
        yield s.map(lambda v: "" if v is None else " ".join(other.sub(" ", unicodedata.normalize("NFKC", v).casefold()).split()))


@F.pandas_udf(T.DoubleType())
def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two texts, in this order of arguments; null where either is null."""
    from difflib import SequenceMatcher

    return pd.Series([None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right, strict=True)], dtype="float64")


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts with unit separators between them."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def core_fingerprint(title: Column, employer: Column) -> Column:
    """Blocking key of title and employer; null if either is empty. Location is evidence, not part of the key."""
    t, e = fold(title), fold(employer)
    return F.when((t != "") & (e != ""), fingerprint(t, e))


def card_fingerprint(title: Column, employer: Column, *others: Column) -> Column:
    """Fingerprint of a whole card; null unless title, employer and four fields in all are not empty."""
    parts = [fold(c) for c in (title, employer, *others)]
    filled = F.size(F.filter(F.array(*parts), lambda p: p != ""))
    return F.when((parts[0] != "") & (parts[1] != "") & (filled >= 4), fingerprint(*parts))


def locality(c: Column) -> Column:
    """The leading locality without a state's name; empty if it only names a state."""
    first = fold(F.substring_index(F.coalesce(c, F.lit("")), ",", 1))
    suffixes = sorted((s for s in STATE_NAMES), key=len, reverse=True)
    bare = F.trim(F.regexp_replace(first, f" (?:{'|'.join(suffixes)})$", ""))
    return F.when(bare.isin(*STATE_NAMES), F.lit("")).otherwise(bare)


def region(c: Column) -> Column:
    """The metropolitan region that a location names, or the empty text."""
    text = fold(c)
    out = F.lit("")
    for name, words in REGION_WORDS.items():
        out = F.when(text.rlike(rf"\b(?:{'|'.join(words)})\b"), F.lit(name)).otherwise(out)
    return out


def locations_conflict(a: Column, b: Column) -> Column:
    """Both specific, different, and not the same region."""
    la, lb, ra, rb = locality(a), locality(b), region(a), region(b)
    return (la != "") & (lb != "") & (la != lb) & ~((ra != "") & (ra == rb))


def geography(location: Column, fallback: Column) -> Column:
    """Geography code named by a location, the first in order, else the fallback."""
    text = fold(location)
    out = fallback
    for code, words in reversed(GEOGRAPHIES.items()):
        out = F.when(text.rlike(rf"\b(?:{'|'.join(words)})\b"), F.lit(code)).otherwise(out)
    return out


def consumer_key(c: Column) -> Column:
    """Lower case with dashes for white space; null unless 1 to 100 characters long."""
    slug = F.regexp_replace(F.lower(F.trim(c)), r"\s+", "-")
    return F.when(F.length(slug).between(1, 100), slug)


def result_count(c: Column) -> Column:
    """The first integer before ``jobs`` or ``results`` in the first twenty lines of a page's text."""
    head = F.substring_index(c, "\n", 20)
    return F.regexp_replace(F.nullif(F.regexp_extract(head, r"(?i)\b([0-9][0-9,]*)\s+(?:jobs?|results?)\b", 1), F.lit("")), ",", "").cast("long")


def applicant_count(c: Column) -> Column:
    """An exact number of applicants; bounds such as ``over`` or ``first`` give null."""
    vague = c.rlike(r"(?i)\b(?:first|over|more than|at least)\b")
    digits = F.regexp_replace(F.regexp_extract(c, r"(?i)\b([0-9][0-9,]*)\s+applicants?\b", 1), ",", "")
    return F.when(~vague, digits.try_cast("int"))


def apply_method(apply_link: Column, page: Column) -> Column:
    """``external_apply`` for a link of its own, ``easy_apply`` without one, else ``unknown``."""
    link = F.trim(F.coalesce(apply_link, F.lit("")))
    return F.when((link != "") & (link != F.trim(F.coalesce(page, F.lit("")))), "external_apply").when(link == "", "easy_apply").otherwise("unknown")


def url_parts(c: Column) -> dict[str, Column]:
    """Host in lower case, path without trailing slashes and a map of the decoded parameters."""
    query = F.regexp_extract(c, r"\?([^#]*)", 1)
    plain = lambda part: F.coalesce(F.try_url_decode(part), part)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda kv: kv != ""), lambda kv: F.struct(plain(F.substring_index(kv, "=", 1)).alias("k"), plain(F.substr(kv, F.length(F.substring_index(kv, "=", 1)) + 2)).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["k"] == p["k"]))
    return {
        "host": F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)),
        "path": F.regexp_replace(F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), "/+$", ""),
        "params": F.map_from_entries(last),
    }


def same_page(actual: Column, expected: Column, hosts: tuple[str, ...]) -> Column:
    """Whether a URL shows the page that was asked for: hosts of the site, equal paths, and all expected parameters. No URL counts as yes."""
    a, e = url_parts(F.coalesce(actual, F.lit(""))), url_parts(expected)
    met = F.forall(F.map_entries(e["params"]), lambda p: F.coalesce(a["params"][p["key"]] == p["value"], F.lit(False)))
    return (a["host"] == "") | (a["host"].isin(*hosts) & e["host"].isin(*hosts) & (a["path"] == e["path"]) & met)


def date_range_hours(url: Column) -> Column:
    """Hours of the search window that a URL's ``daterange`` (days) names, or null."""
    return F.regexp_extract(url, r"[?&]daterange=([0-9]+)(?=[&#]|$)", 1).try_cast("int") * 24


def page_url(url: Column, page: Column) -> Column:
    """The URL of a result page: ``page`` is set beyond the first and removed on the first."""
    bare = F.regexp_replace(F.regexp_replace(url, r"([?&])page=[^&#]*&?", "$1"), r"[?&]$", "")
    mark = F.when(bare.contains("?"), F.lit("&page=")).otherwise(F.lit("?page="))
    return F.when(page <= 1, bare).otherwise(F.concat(bare, mark, page.cast("string")))


def salary_label(low: Column, high: Column) -> Column:
    """Amounts with thousands separators, with cents only where there are any."""
    one = lambda c: F.concat(F.lit("$"), F.when(c == F.floor(c), F.format_number(c, 0)).otherwise(F.format_number(c, 2)))
    return F.when(low.isNotNull() & high.isNotNull() & (low != high), F.concat(one(low), F.lit(" - "), one(high))).otherwise(one(F.coalesce(low, high)))
