"""Rules of single operators on rows written here, and entity resolution against a plain replay."""

import datetime as dt
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import states
from tidemark.functions import text as X
from tidemark.operators import coverage, lifecycle, merge, resolve
from tidemark.plans import search as S
from tidemark.plans.catalogue import _part_cards
from tidemark.sources import pages, readers
from tidemark.streaming import state
from tests.test_operators import CARD, groups


def test_an_archived_alias_does_not_hold_its_primary(spark):
    now = dt.datetime(2026, 9, 1)
    ago = lambda n: now - dt.timedelta(days=n)
    rows = [(1, None, ago(130), True), (2, 1, ago(60), True), (3, None, ago(130), True), (4, 3, ago(5), False)]
    df = spark.createDataFrame(rows, "id int, p int, seen timestamp, archived boolean")
    out = lifecycle.retention(df, "id", "p", F.col("seen"), F.col("archived"), F.lit(ago(40)), F.lit(ago(120)))
    assert {r["id"]: r["phase"] for r in out.collect()} == {1: "remove", 2: "keep", 3: "keep", 4: "keep"}


def test_uniqueness_counts_the_region(spark):
    card = lambda i, place, source: (i, "Analyst", "Acme", place, source, None, None, None, None, None)
    assert groups(spark, [card(1, "Canberra ACT", "s1"), card(2, "Canberra", "s2"), card(3, "Braddon ACT", "s2")]) == [[1, 3], [2]]


def test_search_language_refuses_and_escapes():
    fields = {"title": ["t"]}
    assert S.parse('"say \\"hi\\" now"', fields) == S.Term(None, 'say "hi" now')
    assert S.parse("red   widget", fields) == S.Term(None, "red widget") and S.parse('say "hi" now', fields) == S.Term(None, 'say "hi" now')
    assert S.parse('title:"a  b" or c', fields) == S.Either(S.Term("title", "a b"), S.Term(None, "c"))
    assert S.parse("order and band", fields) == S.Both(S.Term(None, "order"), S.Term(None, "band"))
    for bad in ("foo:bar", "title:", "title: x", '""', "()", "a AND", "a b AND c"):
        with pytest.raises(S.SearchError):
            S.parse(bad, fields)
    with pytest.raises(S.SearchError):
        S.check_values(["x"] * 101)


def test_fielded_terms_are_three_valued_by_field(spark):
    rows = [(1, "x", "y", "known"), (2, "a", "y", "known"), (3, "a", "b", "unknown"), (4, "x", "x", "not_present"), (5, "a", "b", None)]
    df = spark.createDataFrame(rows, "id int, one string, two string, s string").withColumn("states", F.map_filter(F.create_map(F.lit("text"), F.col("s")), lambda k, v: v.isNotNull()))
    kept = df.where(S.search(["body:x"], {"body": ["one", "two"]}, ["one"], F.col("states"), {"body": "text"}))
    assert sorted(r["id"] for r in kept.collect()) == [1, 3, 5]


def test_urls_have_one_spelling(spark):
    urls = ["https://H.org/a/?a", "https://h.org/a?a=", "https://h.org/a?q=x%20y*~&UTM_x=1&%75tm_y=2", "https://h.org/a?q=100%&b=1"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(X.canonical_url(F.col("u"))).collect()] == ["https://h.org/a?a=", "https://h.org/a?a=", "https://h.org/a?q=x+y%2A~", "https://h.org/a?q=100%25&b=1"]


def test_repeated_details_multiply_nothing(spark):
    now = spark.createDataFrame([(1, " "), (2, "kept")], "id int, v string")
    detail = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "x")], "id int, v string")
    assert sorted(merge.fill_only(now, detail, "id", ["v"]).collect()) == [(1, "b"), (2, "kept")]


def test_deep_trees_are_whole_or_an_error(spark):
    chain = lambda n: spark.createDataFrame([(i, i - 1 if i else None, str(i)) for i in range(n)], "id int, parent int, label string")
    assert coverage.paths(chain(80)).agg(F.max("depth")).first()[0] == 79
    with pytest.raises(Exception, match="RECURSION"):
        coverage.paths(chain(30), depth=10).count()


def test_chains_of_primaries(spark):
    links = spark.createDataFrame([(i, i - 1 if i % 70 else None) for i in range(140)], "id long, primary_id long")
    assert {r["id"]: r["root"] for r in resolve.resolved_primaries(links).collect()} == {i: i - i % 70 for i in range(140)}
    with pytest.raises(RuntimeError):
        resolve.resolved_primaries(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None)], "id long, primary_id long"))


def test_states_and_ends(spark):
    with pytest.raises(ValueError):
        states.check_names(["title", "colour"], ("title",))
    assert state.latest_watermark(spark.createDataFrame([(1, "normal", "fresh", "COMPLETE", "t", None)], "id int, kind string, mode string, status string, started_at string, stats string"), ["a"]) is None
    assert state.cycle_transition("RUNNING", True) == "PARTIAL" and state.cycle_transition("COMPLETE", False) == "RUNNING"
    rows = [("a", 0, 10), ("a", 10, 4), ("a", 20, 0), ("a", 30, 0), ("a", 40, 0), ("b", 0, 3), ("b", 10, 0)]
    ends = readers.end_of_stream(spark.createDataFrame(rows, "listing string, offset int, rows int"), 10)
    assert {r["listing"]: r["status"] for r in ends.collect()} == {"a": "COMPLETE", "b": "OPEN"}  # a probe that is missing proves nothing


def test_snapshot_pages_must_agree(spark):
    df = spark.createDataFrame([(["A", "B"], ["a x", "c"])], "t array<string>, b array<string>")
    with pytest.raises(Exception, match="differ"):
        df.select(pages.cards_from_text(F.col("t"), F.col("b"))).collect()


def _fold(v):
    return "".join(c if c.isalnum() or c == "_" else " " for c in (v or "").lower()).split()


def _plain_replay(cards):
    """The grouping rules in plain loops over all cards, without blocks, prepared columns or indexes."""
    text = lambda c, f: " ".join(_fold(c.get(f)))

    def place(c):
        first = " ".join(_fold((c["location"] or "").split(",")[0]))
        names = ("australia", "new south wales", "nsw", "queensland", "qld", "australian capital territory", "act")
        for n in sorted(names, key=len, reverse=True):
            if first.endswith(" " + n):
                first = first[: -len(n) - 1].strip()
                break
        region = "canberra" if any(f" {w} " in f" {text(c, 'location')} " for w in ("australian capital territory", "act", "canberra")) else ""
        return ("" if first in names else first), region

    card_fields = ("title", "employer", "location", "salary_text", "employment_type", "workplace_type", "classification", "subclassification", "teaser")
    signals = {"location": 0.08, "employment_type": 0.04, "workplace_type": 0.03, "salary_text": 0.04, "classification": 0.03}

    def clash(a, b):
        (la, ra), (lb, rb) = place(a), place(b)
        return bool(la and lb and la != lb and not (ra and ra == rb))

    def evidence(a, b):
        whole = [[text(c, f) for f in card_fields] for c in (a, b)]
        if whole[0] == whole[1] and sum(map(bool, whole[0])) >= 4:
            return 1.0, "exact"
        if clash(a, b):
            return None
        ta, tb = text(a, "teaser"), text(b, "teaser")
        ratio = SequenceMatcher(None, ta, tb).ratio() if min(len(ta), len(tb)) >= 25 else None
        if ratio is not None and min(len(ta), len(tb)) >= 40 and ratio >= 0.9:
            return ratio, "teaser"
        (la, ra), (lb, rb) = place(a), place(b)
        if a["source"] != b["source"] and la and (la == lb or ra and ra == rb):
            return 0.96, "place"
        same = [f for f in signals if text(a, f) and text(a, f) == text(b, f)]
        if len(same) >= 2:
            return min(0.999, 0.72 + sum(signals[f] for f in same) + 0.12 * (ratio or 0)), "signals"
        return None

    primary = {c["id"]: c["id"] for c in cards}
    block = lambda c: (text(c, "title"), text(c, "employer"))
    for me in sorted(cards, key=lambda c: c["id"]):
        best = []
        for other in cards:
            if primary[other["id"]] == primary[me["id"]] or block(other) != block(me) or not all(block(me)):
                continue
            found = evidence(me, other)
            if not found:
                continue
            mine, theirs = ([c for c in cards if primary[c["id"]] == primary[x["id"]]] for x in (me, other))
            if any(clash(a, b) for a in mine for b in theirs):
                continue
            (la, ra), (lb, _) = place(me), place(other)
            if found[1] == "place" and la == lb:
                near = lambda s: {primary[c["id"]] for c in cards if block(c) == block(me) and c["source"] == s and (place(c)[0] == la or ra and place(c)[1] == ra)}
                if near(me["source"]) != {primary[me["id"]]} or near(other["source"]) != {primary[other["id"]]}:
                    continue
            best.append((primary[other["id"]], -found[0], other["id"]))
        if best:
            low, high = sorted((primary[me["id"]], min(best)[0]))
            primary = {i: low if p == high else p for i, p in primary.items()}
    return primary


def test_groups_by_a_plain_replay(spark):
    cards = _part_cards(spark, "/root/testdata/sf0.01").where("title <= 'c'")
    rows = [r.asDict() for r in cards.collect()]
    assert len(rows) > 50
    got = {r["id"]: r["primary_id"] for r in resolve.same_vacancy(cards).collect()}
    assert got == _plain_replay(rows)
    places = ["Sydney NSW", "Sydney", "Canberra ACT", "Braddon ACT", None, "Parramatta, New South Wales"]
    teasers = ["A long teaser of well over forty characters that two boards share", "A long teaser of well over forty characters that both boards share", "Short one", None]
    made = [(i, "Analyst", "Acme", places[i * 7 % 6], f"s{i % 3}", ("Full time", None)[i % 2], None, ("$1", "$2", None)[i % 3], None, teasers[i * 5 % 4]) for i in range(40)]
    df = spark.createDataFrame(made, CARD)
    assert {r["id"]: r["primary_id"] for r in resolve.same_vacancy(df).collect()} == _plain_replay([r.asDict() for r in df.collect()])


def test_rebuild_and_audit(spark):
    card = lambda i, place, title="Analyst": (i, title, "Acme", place, "s1", None, "Remote", None, None, None)
    cards = spark.createDataFrame([card(1, "Sydney"), card(2, "Canberra"), card(3, "Sydney"), card(4, "Hay", "Clerk"), card(5, "Hay", "Clerk")], CARD)
    before = spark.createDataFrame([(1, 1, None), (2, 1, "old"), (3, 1, "old"), (4, 4, None), (5, 4, "old")], "id int, primary_id int, match_type string")
    after = resolve.rebuilt(before, cards)
    assert {r["id"]: r["primary_id"] for r in after.collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4}
    assert [(r["id"], r["action"]) for r in resolve.link_audit(before, after).collect()] == [(2, "unlinked")]


def test_alike_cards_are_grouped_as_by_a_plain_replay(spark):
    places, teasers = ["Sydney", "Canberra ACT", "Braddon ACT", None], ["A teaser of well over forty characters that two boards share", "A teaser of well over forty characters that few boards share", None]
    made = [(i * 7919 % 1009, "Analyst", "Acme", places[i % 4], f"s{i % 2}", ("Full time", None)[i % 3 % 2], None, None, None, teasers[i % 5 % 3]) for i in range(150)]
    df = spark.createDataFrame(made, CARD)
    assert {r["id"]: r["primary_id"] for r in resolve.same_vacancy(df).collect()} == _plain_replay([r.asDict() for r in df.collect()])


def test_a_hot_block_of_alike_cards_compares_looks_only(monkeypatch):
    asked, plain = [], resolve.evidence
    monkeypatch.setattr(resolve, "evidence", lambda a, b: asked.append(1) or plain(a, b))
    rows = pd.DataFrame([{"id": i, **dict.fromkeys(resolve.READ, ""), "card": f"c{i % 3}", "locality": ("sydney", "perth", "")[i % 3]} for i in range(5000)])
    got = resolve.replay(rows)
    assert got["primary_id"].tolist() == [i % 3 for i in range(5000)] and len(asked) == 9
