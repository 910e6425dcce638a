"""Three-valued filters: how a missing value is read depends on the recorded state of its field.

States are ``known``, ``not_present``, ``unknown`` and ``not_applicable``; no record reads as ``unknown``.
A filter keeps what may match: a value is compared only where it is known, not_present never matches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ("known", "not_present", "unknown", "not_applicable")


def pivot_states(rows: DataFrame, id_col: str = "job_id", field_col: str = "field_name", state_col: str = "state") -> DataFrame:
    """One map of field states for each record: filters on many fields then need no join at all."""
    return rows.groupBy(id_col).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct(field_col, state_col)))).alias("states"))


def three_valued(state: Column, known: Column) -> Column:
    return F.when(state == "not_present", F.lit(False)).when(state == "known", F.coalesce(known, F.lit(False))).otherwise(F.lit(True))


def contains_any(value: Column, state: Column, wanted: list[str]) -> Column:
    """Any of the texts occurs in the value, whatever its case."""
    return three_valued(state, reduce(lambda a, b: a | b, [F.lower(value).contains(w.lower()) for w in wanted]))


def in_any(value: Column, state: Column, wanted: list[str]) -> Column:
    return three_valued(state, value.isin(*wanted))


def on_or_after(instant: Column, state: Column, bound: Column) -> Column:
    """Fail-closed: only known and readable instants pass."""
    return F.coalesce((state == "known") & (instant >= bound), F.lit(False))


def comparable(state: Column, norm_state: Column, period: Column, currency: Column, bound: Column, wanted_period: str, wanted_currency: str) -> Column:
    """Whether a stored interval can be held against a requested one at all."""
    shapes = bound.isin("range", "exact", "from", "up_to")
    return F.coalesce((state == "known") & (norm_state == "known") & (period == wanted_period) & (currency == wanted_currency) & shapes, F.lit(False))


def overlaps(low: Column, high: Column, least: float | None, most: float | None) -> Column:
    """Inclusive overlap with a requested interval; a null end is open."""
    out = F.lit(True)
    if least is not None:
        out = out & F.coalesce(high >= least, F.lit(True))
    if most is not None:
        out = out & F.coalesce(low <= most, F.lit(True))
    return out


def interval_filter(can_compare: Column, low: Column, high: Column, least: float | None, most: float | None) -> Column:
    """Drop only what is comparable and provably disjoint."""
    return ~can_compare | overlaps(low, high, least, most)


def match_basis(can_compare: Column) -> Column:
    return F.when(can_compare, F.lit("comparable_overlap")).otherwise(F.lit("uncertain_preserved"))


def check_interval(least: float | None, most: float | None, period: str | None, currency: str | None, periods: tuple[str, ...] = ("hour", "day", "week", "month", "year")) -> None:
    """Reject a request that can't be answered: bounds need period and currency, and the other way round."""
    if least is None and most is None:
        if period or currency:
            raise ValueError("period and currency need a bound")
        return
    if not period or not currency:
        raise ValueError("bounds need period and currency")
    if period not in periods or len(currency) != 3 or not currency.isalpha():
        raise ValueError("unknown period or currency")
    if any(v is not None and (v != v or v in (float("inf"), float("-inf"))) for v in (least, most)):
        raise ValueError("bounds must be finite")
    if least is not None and most is not None and least > most:
        raise ValueError("the least exceeds the most")


def check_names(names: list[str], allowed: tuple[str, ...]) -> None:
    """Reject states of fields that there are not."""
    if other := sorted(set(names) - set(allowed)):
        raise ValueError(f"unknown fields: {', '.join(other)}")


def capability(source: Column, field: Column, table: dict[str, dict[str, str]]) -> Column:
    """What a source can tell of a field, by a table of sources; anything not in it is ``unknown``."""
    entries = [x for s, known in table.items() for f, v in known.items() for x in (F.lit(f"{s}\x1f{f}"), F.lit(v))]
    return F.coalesce(F.create_map(*entries)[F.concat_ws("\x1f", F.lower(F.trim(source)), field)], F.lit("unknown"))


def derived_state(explicit: Column, value: Column, observed: Column) -> Column:
    """The state to record: an explicit one, else known for a value, else unknown; not_present only where the source was seen to lack it."""
    return F.coalesce(F.when(explicit.isin(*STATES), explicit), F.when(F.trim(value.cast("string")) != "", F.lit("known")), F.when(observed, F.lit("not_present")), F.lit("unknown"))
