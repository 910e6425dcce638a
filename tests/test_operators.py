"""Lifecycle, merging, resolution, coverage and streaming on rows written here."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import coverage, feed, lifecycle, merge, resolve
from tidemark.streaming import state


def test_pages_join_up(spark):
    df = spark.range(1, 26).withColumnRenamed("id", "k")
    seen, after = [], 0
    while True:
        rows = feed.keyset_page(df, "k", 10, after, 23).orderBy("k").collect()
        seen += [r["k"] for r in rows]
        if not rows[-1]["has_more"]:
            break
        after = rows[-1]["next_cursor"]
    assert seen == list(range(1, 24))


def test_upsert_keeps_what_is_known(spark):
    obs = spark.createDataFrame([("a", 1, "x", None, False), ("a", 2, None, "y", True), ("a", 3, "z", None, False)], "k string, seq int, title string, place string, reposted boolean")
    assert merge.upsert(obs, "k", F.col("seq"), ["title", "place"], ["reposted"]).collect() == [("a", "z", "y", True)]


def test_rank_merge_ties(spark):
    obs = spark.createDataFrame([("a", 1, "2026-09-09", 3), ("a", 2, "2026-09-09T01:00:00", 3), ("b", 1, "first", 2), ("b", 2, "other", 2)], "k string, seq int, v string, r int")
    got = {r["k"]: r["v"] for r in merge.rank_merge(obs, "k", "v", F.col("r"), F.col("seq")).collect()}
    assert got == {"a": "2026-09-09T01:00:00", "b": "first"}


def test_retention_archives_and_removes_in_one_run(spark):
    now = dt.datetime(2026, 9, 1)
    rows = [(1, None, now - dt.timedelta(days=130), False), (2, None, now - dt.timedelta(days=130), False), (3, 2, now, False), (4, None, now - dt.timedelta(days=50), False)]
    df = spark.createDataFrame(rows, "id int, p int, seen timestamp, archived boolean")
    out = lifecycle.retention(df, "id", "p", F.col("seen"), F.col("archived"), F.lit(now - dt.timedelta(days=40)), F.lit(now - dt.timedelta(days=120)))
    assert {r["id"]: r["phase"] for r in out.collect()} == {1: "remove", 2: "archive", 3: "keep", 4: "archive"}
    off = lifecycle.retention(df, "id", "p", F.col("seen"), F.col("archived"), None, None)
    assert {r["phase"] for r in off.collect()} == {"keep"}


CARD = "id int, title string, employer string, location string, source string, employment_type string, workplace_type string, salary_text string, classification string, teaser string"


def groups(spark, rows):
    out = {}
    for r in resolve.same_vacancy(spark.createDataFrame(rows, CARD)).collect():
        out.setdefault(r["primary_id"], set()).add(r["id"])
    return sorted(map(sorted, out.values()))


def test_grouping_is_no_closure(spark):
    teaser = "An unusually long teaser text that two boards print word for word for one vacancy"
    a = (1, "Analyst", "Acme", "Sydney NSW", "s1", None, None, None, None, teaser)
    bridge = (2, "Analyst", "Acme", None, "s1", None, None, None, None, teaser)
    b = (3, "Analyst", "Acme", "Parramatta NSW", "s1", None, None, None, None, teaser)
    assert groups(spark, [a, bridge, b]) == [[1, 2], [3]]


def test_locality_alone_needs_one_on_each_side(spark):
    one = (1, "Analyst", "Acme", "Sydney NSW", "s1", None, None, None, None, None)
    two = (2, "Analyst", "Acme", "Sydney, New South Wales", "s2", None, None, None, None, None)
    also = (3, "Analyst", "Acme", "Sydney", "s2", None, None, None, None, None)
    assert groups(spark, [one, two]) == [[1, 2]]
    assert groups(spark, [one, two, also]) == [[1], [2], [3]]
    assert groups(spark, [one, (4, "Analyst", "Acme", "Queensland", "s2", None, None, None, None, None)]) == [[1], [4]]


def test_two_signals_and_no_conflict(spark):
    a = (1, "Analyst", "Acme", None, "s1", "Full time", "Remote", None, None, None)
    b = (2, "Analyst", "Acme", None, "s1", "Full time", "Remote", None, None, None)
    c = (3, "Analyst", "Acme", None, "s1", "Full time", "Office", None, None, None)
    assert groups(spark, [a, (2, "Analyst", "Acme", None, "s1", None, "Remote", None, None, None)]) == [[1], [2]]
    assert groups(spark, [a, b, c]) == [[1, 2], [3]]


def test_coverage(spark):
    kids = spark.createDataFrame([(1, 9, "COMPLETE"), (2, 9, "COMPLETE"), (3, 8, "INCOMPLETE_PAGE_LIMIT")], "id int, parent int, status string")
    held = spark.createDataFrame([(1, 5), (1, 6), (2, 6), (2, 7), (3, 1)], "partition int, job int")
    want = spark.createDataFrame([(9, 3), (8, 1), (7, 0)], "id int, reported int")
    got = {r["id"]: (r["unique_jobs"], r["status"]) for r in coverage.roll_up(kids, held, want, 0).collect()}
    assert got == {9: (3, "COMPLETE_BY_PARTITION"), 8: (1, "INCOMPLETE_CHILD_COVERAGE"), 7: (0, "INCOMPLETE_CHILD_COVERAGE")}


def test_checkpoints_only_advance(spark):
    df = spark.createDataFrame([("a", 5), ("b", 9)], "consumer_key string, last_id long")
    assert dict(state.advance(df, "a", 5).collect()) == {"a": 5, "b": 9}
    assert dict(state.advance(df, "c", 1).collect()) == {"a": 5, "b": 9, "c": 1}
    with pytest.raises(ValueError):
        state.advance(df, "b", 8)


def test_identity_lookup_prefers_records(spark):
    jobs = spark.createDataFrame([("1", "u1", 10), ("2", "u2", 20)], "nid string, url string, target int")
    stones = spark.createDataFrame([("3", "u3", 30), ("1", "u9", 99)], "nid string, url string, target int")
    new = spark.createDataFrame([("1", "u2"), (None, "u2"), ("3", "x"), (None, "u9"), ("7", "z")], "nid string, url string")
    got = merge.identity_lookup(new, jobs, stones, "nid", "url", "target")
    rows = {(r["nid"], r["url"]): (r["match"], r["match_kind"]) for r in got.collect()}
    assert rows == {("1", "u2"): (10, "job"), (None, "u2"): (20, "job"), ("3", "x"): (30, "tombstone"), (None, "u9"): (99, "tombstone"), ("7", "z"): (None, None)}
