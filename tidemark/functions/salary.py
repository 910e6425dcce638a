"""Salary texts to amounts, period, currency and bound; anything not provable is ``unknown``.

A text is read into tokens: numerals, words (without dots) and single signs. Every question is then one
about neighbouring tokens, answered from tables of units, words and fixed texts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: For each period the letter of its abbreviation, other words that name it, and the range of plausible amounts.
PERIODS = {
    "hour": ("h", ("hourly", "hr"), 1, 5_000),
    "day": ("d", ("daily", "day"), 10, 50_000),
    "week": ("w", ("weekly", "week"), 25, 250_000),
    "month": ("m", ("monthly", "month"), 100, 1_000_000),
    "year": ("a", ("annually", "annual", "annum", "year"), 1_000, 10_000_000),
}
#: Currencies, texts that say there is no or no stated salary, and words that may stand beside an amount.
CURRENCIES = ("AUD", "NZD", "USD", "GBP", "EUR")
NONE_TEXTS = ("n/a", "na", "not applicable", "no salary", "unpaid")
UNKNOWN_TEXTS = ("competitive", "salary undisclosed", "undisclosed", "negotiable")
CONTEXT_WORDS = frozenset(
    "a annual annually annum approx approximately at aud base based c circa compensation d daily day depending eur experience from fte "
    "gbp h hour hourly hr inc incl includes inclusive m max maximum min minimum month monthly neg negotiable nzd of on p package packaged "
    "pay per plus range ranges rate rates relative remuneration salary starting super superannuation to total up usd w week weekly year".split()
)
SUPER = ("super", "superannuation")
#: Multipliers of the letters that may follow an amount, and what the amount must stay under for them.
SCALES = {"k": (1_000, 10_000), "m": (1_000_000, 100)}
#: A mark between a letter and a digit that touch, so that such a number is no amount.
_GLUE = "~"


def _bound(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` of a struct of the values; each is evaluated once, however often the body names it."""
    packed = F.struct(*[v.alias(k) for k, v in values.items()])
    return F.get(F.transform(F.array(packed), body), F.lit(0))


def tokens(low: Column) -> Column:
    """Numerals, words and signs of a text in lower case; ``p.a.`` is the word ``pa``."""
    marked = F.regexp_replace(low, "([a-z])(?=[0-9])", f"$1{_GLUE}")
    found = F.regexp_extract_all(marked, F.lit(r"[0-9][0-9,.]*|[a-z]+(?:\.[a-z]+)*\.?|[^\sa-z0-9]"), F.lit(0))
    return F.transform(found, lambda t: F.when(t.rlike("^[0-9]"), F.regexp_replace(t, "[,.]+$", "")).when(t.rlike("^[a-z]"), F.replace(t, F.lit("."), F.lit(""))).otherwise(t))


def _is_in(c: Column, *wanted: str) -> Column:
    return F.coalesce(c.isin(*wanted), F.lit(False))


def _numeral(t: Column) -> Column:
    """Digits with an optional fraction, in groups of three or none."""
    plain = t.rlike(r"^[0-9]+(\.[0-9]+)?$")
    return F.coalesce(plain | t.rlike(r"^[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$"), F.lit(False))


def _amount(t: Column, letter: Column) -> Column:
    n = F.replace(t, F.lit(","), F.lit("")).try_cast("decimal(30,8)")
    out = n
    for name, (factor, under) in SCALES.items():
        out = F.when(letter == name, F.when(n < under, n * factor)).otherwise(out)
    return F.when(n > 0, out).cast("double")


def _read(t: Column) -> dict[str, Column]:
    """What the tokens say, by looking at each one's neighbours."""
    at = lambda i: F.get(t, i)
    places = F.sequence(F.lit(0), F.size(t) - 1)
    counted = F.filter(places, lambda i: _numeral(at(i)) & ~_is_in(at(i + 1), "%") & ~_is_in(F.when(i > 0, at(i - 1)), _GLUE))
    in_super = lambda i: _is_in(at(i + 1), "%") & _is_in(at(i + 2), *SUPER)
    loading = lambda i: _is_in(at(i), "leave", "loading") & F.exists(places, lambda j: in_super(j) & _is_in(at(j + 3), "&") & (i > j) & (i <= j + 5))

    def fits(i: Column) -> Column:
        word = at(i).rlike("^[a-z]")
        letter = (i > 0) & _is_in(at(i), *SCALES) & F.when(i > 0, _numeral(at(i - 1))).otherwise(False)
        allowed = letter | at(i).isin(*sorted(CONTEXT_WORDS), *[f"p{a}" for a, _, _, _ in PERIODS.values()]) | loading(i)
        return F.when(word, allowed).when(at(i) == "%", (i > 0) & _is_in(at(i + 1), *SUPER)).otherwise(True)

    def names(period: str) -> Column:
        letter, words, _, _ = PERIODS[period]
        near = lambda i: _is_in(at(i), "p") & (_is_in(at(i + 1), letter) | (_is_in(at(i + 1), "/") & _is_in(at(i + 2), letter) if period == "hour" else F.lit(False)))
        full = lambda i: _is_in(at(i), "per", "/") & _is_in(at(i + 1), period)
        return F.exists(places, lambda i: at(i).isin(*words, f"p{letter}") | near(i) | full(i))

    named = F.filter(F.array(*[F.when(names(p), F.lit(p)) for p in PERIODS]), lambda x: x.isNotNull())
    pair = lambda i, a, *b: _is_in(at(i), a) & _is_in(at(i + 1), *b)
    money = F.filter(places, lambda i: at(i).isin(*[c.lower() for c in CURRENCIES]))
    added = lambda i: _is_in(at(i), "+", "plus") & F.exists(F.array(i + 1, i + 3), lambda j: _is_in(at(j), *SUPER) | (_numeral(at(j)) & in_super(j)))
    included = lambda i: (_is_in(at(i), "inc", "incl") & _is_in(at(i + 1), "super")) | (pair(i, "inclusive", "of") & _is_in(at(i + 2), "super"))
    ahead = F.slice(places, F.lit(1), F.coalesce(F.get(counted, F.lit(0)), F.size(t)))
    return {
        "amounts": F.transform(counted, lambda i: F.struct(i.alias("i"), at(i).alias("n"), F.when(at(i + 1).isin(*SCALES), at(i + 1)).alias("letter"))),
        "provable": F.forall(places, fits),
        "named": named,
        "upper": F.exists(ahead, lambda i: _is_in(at(i), "to", "upto", "maximum") | pair(i, "max", "of")),
        "lower": F.exists(ahead, lambda i: _is_in(at(i), "from", "minimum") | pair(i, "starting", "at", "from") | pair(i, "min", "of")),
        "currency": F.upper(F.get(t, F.get(money, F.lit(0)))),
        "qualifier": F.when(F.exists(places, included), "includes_super").when(F.exists(places, added), "plus_super").when(F.exists(places, lambda i: _is_in(at(i), "package", "packaged")), "package"),
        "tokens": t,
    }


def _decided(r: Column) -> dict[str, Column]:
    """Bounds of what ``_read`` gives: a range where a dash or ``to`` joins two amounts, else one amount."""
    one, two = F.get(r["amounts"], F.lit(0)), F.get(r["amounts"], F.lit(1))
    sep = one["i"] + 1 + F.when(one["letter"].isNotNull(), 1).otherwise(0)
    next_at = sep + 1 + F.when(_is_in(F.get(r["tokens"], sep + 1), "$"), 1).otherwise(0)
    joined = F.coalesce(F.get(r["tokens"], sep).isin("-", "–", "to") & (next_at == two["i"]), F.lit(False))
    return {
        "joined": joined,
        "low": _amount(one["n"], F.coalesce(one["letter"], F.when(joined, two["letter"]))),
        "high": _amount(two["n"], two["letter"]),
        "period": F.when(F.size(r["named"]) == 1, F.get(r["named"], F.lit(0))),
    }


def normalize_salary(text: Column, field_state: Column | None = None, default_currency: Column | None = None) -> Column:
    """A struct (state, min_amount, max_amount, period, currency, qualifier, bound) of a salary text.

    A recorded field state other than ``known`` is passed on. Blank texts are unknown.
    """
    state = F.lower(F.trim(F.coalesce(field_state, F.lit("")))) if field_state is not None else F.lit("")
    fallback = (default_currency if default_currency is not None else F.lit(None)).cast("string")
    raw = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    nothing = F.lit(None)

    def of(state_: Column, *values: Column) -> Column:
        names = ("min_amount", "max_amount", "period", "currency", "qualifier", "bound")
        kinds = ("double", "double", "string", "string", "string", "string")
        return F.struct(state_.alias("state"), *[v.cast(k).alias(n) for v, k, n in zip(values or (nothing,) * 6, kinds, names, strict=True)])

    def verdict(t: Column, r: Column, d: Column) -> Column:
        upper, lower = r["upper"] & ~d["joined"], r["lower"] & ~d["joined"]
        least = F.when(d["joined"] | ~upper, d["low"])
        most = F.when(d["joined"], d["high"]).when(~lower, d["low"])
        bound = F.when(d["joined"], F.lit("range")).when(upper, F.lit("up_to")).when(lower, F.lit("from")).otherwise(F.lit("exact"))
        ranges = {name: (low, high) for name, (_, _, low, high) in PERIODS.items()}
        within = lambda low, high: F.coalesce(least.between(low, high), F.lit(True)) & F.coalesce(most.between(low, high), F.lit(True))
        plausible = reduce(lambda out, p: F.when(d["period"] == p, within(*ranges[p])).otherwise(out), ranges, F.lit(True))
        several = F.size(r["amounts"])
        valid = F.when(d["joined"], (several == 2) & (d["low"] <= d["high"])).otherwise((several == 1) & d["low"].isNotNull() & ~(upper & lower))
        known = (t["low"] != "") & ~t["low"].isin(*UNKNOWN_TEXTS) & r["provable"] & F.coalesce(valid, F.lit(False)) & plausible
        return (
            F.when(t["state"].isin("unknown", "not_present", "not_applicable"), of(t["state"]))
            .when(t["low"].isin(*NONE_TEXTS), of(F.lit("not_applicable")))
            .when(known, of(F.lit("known"), least, most, d["period"], F.coalesce(r["currency"], t["fallback"]), r["qualifier"], bound))
            .otherwise(of(F.lit("unknown")))
        )

    def folded(t: Column) -> Column:
        return _bound({"t": tokens(t["low"])}, lambda x: F.when(F.size(x["t"]) > 0, _bound(_read(x["t"]), lambda r: _bound(_decided(r), lambda d: verdict(t, r, d)))))

    blank = F.when(state.isin("unknown", "not_present", "not_applicable"), of(state)).otherwise(of(F.lit("unknown")))
    return F.coalesce(_bound({"low": F.lower(raw), "state": state, "fallback": fallback}, folded), blank)


def context_currency(source: Column, url: Column, sources: tuple[str, ...], hosts: tuple[str, ...], code: str = "AUD") -> Column:
    """A currency proved by source and host (or a host under it); otherwise null."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    on = F.lit(False)
    for h in hosts:
        on = on | (host == h) | host.endswith(f".{h}")
    return F.when(F.lower(F.trim(source)).isin(*sources) & on, F.lit(code))
