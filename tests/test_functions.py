"""Truth tables of the scalar functions and filters."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, salary, states
from tidemark.functions import text as X
from tidemark.plans import search as S


def apply(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_salary(spark):
    cases = {
        "AUD $100,000 - $120,000 per annum + super": ("known", 100000.0, 120000.0, "year", "AUD", "plus_super", "range"),
        "AUD 800 - 900 day": ("known", 800.0, 900.0, "day", "AUD", None, "range"),
        "Up to $150,000 per annum": ("known", None, 150000.0, "year", None, None, "up_to"),
        "From $120,000 per annum": ("known", 120000.0, None, "year", None, None, "from"),
        "$1k - $1100 p.d.": ("known", 1000.0, 1100.0, "day", None, None, "range"),
        "AUD $1,200.50 per week": ("known", 1200.5, 1200.5, "week", "AUD", None, "exact"),
        "NZD 90k to 110k package": ("known", 90000.0, 110000.0, None, "NZD", "package", "range"),
        "$95-105k p.a. inc. super": ("known", 95000.0, 105000.0, "year", None, "includes_super", "range"),
        "minimum 31.25 p/h plus 11.5% super": ("known", 31.25, None, "hour", None, "plus_super", "from"),
        "1.2m per annum + up to 17% superannuation & leave loading": ("known", 1200000.0, 1200000.0, "year", None, "plus_super", "exact"),
        "700 p d": ("known", 700.0, 700.0, "day", None, None, "exact"),
    }
    for got, want in zip(apply(spark, salary.normalize_salary, list(cases)), cases.values(), strict=True):
        assert tuple(got) == want
    unknown = ["Competitive", "", None, "we have 5 great benefits", "70% of base", "99999k annual", "$31-$42 annually", "$52K-$58K hourly", "usd500", "from 10 to 5 per hour", "1 2 3 per day", "30 per 3rd week", "12,34 per day"]
    assert [g["state"] for g in apply(spark, salary.normalize_salary, unknown)] == ["unknown"] * len(unknown)
    assert apply(spark, salary.normalize_salary, ["N/A"])[0]["state"] == "not_applicable"


def test_posting_dates(spark):
    at = F.lit("2026-09-10T12:00:00+00:00")
    got = apply(spark, lambda c: dates.posting_date(F.lit(None).cast("string"), c, at, F.lit(120)), ["Listed three hours ago", "2 days ago", "3h ago", "1w ago", "twenty-four minutes ago", "soon"])
    base = dt.datetime(2026, 9, 10, 12)
    want = [base - dt.timedelta(**x) for x in ({"hours": 3}, {"days": 2}, {"hours": 3}, {"weeks": 1}, {"minutes": 24}, {"hours": 120})]
    assert [g["value"] for g in got] == want
    assert [g["basis"] for g in got] == ["source_relative"] * 5 + ["search_window_bound"]
    exact = apply(spark, lambda c: dates.posting_date(c, F.lit(None).cast("string"), at), ["2026-09-09T10:00:00+10:00", "2026-02-30", "2026"])
    assert exact[0]["value"] == dt.datetime(2026, 9, 9) and exact[1] is None and exact[2] is None


def test_urls_and_keys(spark):
    got = apply(spark, X.canonical_url, ["HTTPS://Example.COM/Job/1/?utm_source=a&keep=B&ref=z#top", "https://a.org//", " ", None])
    assert got == ["https://example.com/Job/1?keep=B", "https://a.org", None, None]
    assert apply(spark, X.native_id, ["li-1234567", "1234567", "12", "x"]) == ["1234567", "1234567", None, None]
    assert apply(spark, X.consumer_key, [" My  Consumer ", ""]) == ["my-consumer", None]
    assert apply(spark, X.applicant_count, ["1,204 applicants", "Over 200 applicants", None]) == [1204, None, None]


def test_localities(spark):
    assert apply(spark, X.locality, ["Sydney NSW, Australia", "Queensland", "Braddon", None]) == ["sydney", "", "braddon", ""]
    df = spark.createDataFrame([("Braddon ACT", "Canberra"), ("Sydney", "Parramatta"), ("Sydney", "NSW")], "a string, b string")
    assert [r[0] for r in df.select(X.locations_conflict(F.col("a"), F.col("b"))).collect()] == [False, True, False]


def test_folding_agrees_on_plain_text(spark):
    values = ["Straße – Nr. 5", "  Été_2 ", None, "ＡＢＣ"]
    exact = apply(spark, X.fold_exact, values)
    assert apply(spark, X.fold, values)[:3] == exact[:3] and exact[3] == "abc"


def test_three_valued(spark):
    rows = [("x", "known"), ("y", "known"), ("x", "not_present"), (None, "unknown"), (None, "not_applicable"), (None, "known")]
    df = spark.createDataFrame(rows, "v string, s string")
    assert [r[0] for r in df.select(states.in_any(F.col("v"), F.col("s"), ["x"])).collect()] == [True, False, False, True, True, False]


@pytest.mark.parametrize("bad", [(1.0, None, None, "AUD"), (None, None, "year", "AUD"), (2.0, 1.0, "year", "AUD"), (1.0, None, "fortnight", "AUD"), (1.0, None, "year", "money"), (float("nan"), None, "year", "AUD")])
def test_interval_requests(bad):
    with pytest.raises(ValueError):
        states.check_interval(*bad)


def test_interval_truth_table(spark):
    rows = [("annual", "AUD", "year", 100000.0, 120000.0, "known", "range"), ("hourly", "AUD", "hour", 100.0, 120.0, "known", "range"), ("nocur", None, "year", 100000.0, 120000.0, "known", "range"),
            ("stale", "AUD", "year", 100000.0, 120000.0, "not_present", "range"), ("upto", "AUD", "year", None, 150000.0, "known", "up_to"), ("from", "AUD", "year", 120000.0, None, "known", "from")]
    df = spark.createDataFrame(rows, "n string, c string, p string, lo double, hi double, s string, b string")

    def left(least, most):
        can = states.comparable(F.col("s"), F.lit("known"), F.col("p"), F.col("c"), F.col("b"), "year", "AUD")
        return {r["n"] for r in df.where(~states.interval_filter(can, F.col("lo"), F.col("hi"), least, most)).collect()}

    assert left(110000, 115000) == {"from"} and left(None, 105000) == {"from"}
    assert left(160000, None) == {"annual", "upto"} and left(None, 99999) == {"annual", "from"}


def test_search_grammar():
    fields = {"title": ["t"], "company": ["e"]}
    assert S.parse("data analyst", fields) == S.Term(None, "data analyst")
    assert S.parse("research and development", fields) == S.Both(S.Term(None, "research"), S.Term(None, "development"))
    assert S.parse("a OR b AND c", fields) == S.Either(S.Term(None, "a"), S.Both(S.Term(None, "b"), S.Term(None, "c")))
    assert S.parse('title:"x y" AND (a OR b)', fields) == S.Both(S.Term("title", "x y"), S.Either(S.Term(None, "a"), S.Term(None, "b")))
    for bad in ("(a OR b", "a OR", 'title:x y', "", "a" * 301, " OR ".join(["t"] * 17)):
        with pytest.raises(S.SearchError):
            S.parse(bad, fields)
