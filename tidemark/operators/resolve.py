"""Entity resolution: evidence between cards of one block, and greedy grouping replayed block by block.

Cards can only match within a block (same folded title and employer), so candidates come from an equality
on the block's fingerprint. Cheap equalities run in the JVM; the text ratio is a pandas UDF on what is left.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X

#: Weights of equal fields on top of the base score, and the share of the teaser's ratio.
BASE_SCORE, TEASER_SHARE, MOST = 0.72, 0.12, 0.999
WEIGHTS = {"location": 0.08, "employment_type": 0.04, "workplace_type": 0.03, "salary_text": 0.04, "classification": 0.03}
KEEP = 0.92
CARD = ("title", "employer", "location", "salary_text", "employment_type", "workplace_type", "classification", "subclassification", "teaser")


def prepared(cards: DataFrame) -> DataFrame:
    """Cards with block and card fingerprints, locality, region and folded fields; absent fields are null."""
    missing = {c: F.lit(None).cast("string") for c in (*CARD, "source") if c not in cards.columns}
    df = cards.withColumns(missing) if missing else cards
    df = df.withColumns({
        "block": X.core_fingerprint(F.col("title"), F.col("employer")),
        "card": X.card_fingerprint(*[F.col(c) for c in CARD]),
        "locality": X.locality(F.col("location")),
        "region": X.region(F.col("location")),
    })
    return df.withColumns({f"n_{c}": X.fold(F.col(c)) for c in (*WEIGHTS, "teaser", "source")})


def _equal(c: str) -> Column:
    return (F.col(f"a.n_{c}") != "") & (F.col(f"a.n_{c}") == F.col(f"b.n_{c}"))


def edges(cards: DataFrame, min_teaser: int = 25) -> DataFrame:
    """Duplicate evidence (a, b, score, match_type) of pairs with a < b, at least KEEP or with equal cards."""
    p = prepared(cards).where(F.col("block").isNotNull())
    a, b = p.alias("a"), p.alias("b")
    pairs = a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.id") < F.col("b.id")))
    exact = F.coalesce(F.col("a.card") == F.col("b.card"), F.lit(False))
    score = F.lit(BASE_SCORE)
    for c, w in WEIGHTS.items():
        score = score + F.when(_equal(c), w).otherwise(0.0)
    long = (F.length("a.n_teaser") >= min_teaser) & (F.length("b.n_teaser") >= min_teaser)
    rows = pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), exact.alias("exact"), score.alias("fields"), F.when(long & ~exact, F.col("a.n_teaser")).alias("ta"), F.when(long & ~exact, F.col("b.n_teaser")).alias("tb"))
    # what even an equal teaser could not lift over the bar needs no ratio
    rows = rows.where(F.col("exact") | (F.col("fields") + F.when(F.col("ta").isNotNull(), TEASER_SHARE).otherwise(0.0) >= KEEP - 1e-9))
    near = F.least(F.col("fields") + TEASER_SHARE * F.coalesce(X.ratio(F.col("ta"), F.col("tb")), F.lit(0.0)), F.lit(MOST))
    out = rows.select("a", "b", F.when(F.col("exact"), F.lit(1.0)).otherwise(near).alias("score"), F.when(F.col("exact"), F.lit("exact_rich_card")).otherwise(F.lit("near_rich_card")).alias("match_type"))
    return out.where((F.col("match_type") == "exact_rich_card") | (F.round("score", 9) >= KEEP))


def _signals(a: dict, b: dict) -> int:
    return sum(bool(a[f"n_{c}"]) and a[f"n_{c}"] == b[f"n_{c}"] for c in WEIGHTS)


def _conflict(a: dict, b: dict) -> bool:
    if not a["locality"] or not b["locality"] or a["locality"] == b["locality"]:
        return False
    return not (a["region"] and a["region"] == b["region"])


def evidence(a: dict, b: dict, teaser_ratio: float = 0.9, teaser_chars: int = 40, signals: int = 2) -> tuple[float, str] | None:
    """Evidence that two prepared cards of a block are one vacancy, the strongest rule first."""
    if a["card"] and a["card"] == b["card"]:
        return 1.0, "exact_rich_card"
    if _conflict(a, b):
        return None
    ta, tb = a["n_teaser"] or "", b["n_teaser"] or ""
    least, alike, texts = min(len(ta), len(tb)), None, SequenceMatcher(None, ta, tb)
    # both quick ratios are upper bounds, so the costly one is taken only where it can decide
    if least >= max(25, teaser_chars) and texts.real_quick_ratio() >= teaser_ratio and texts.quick_ratio() >= teaser_ratio:
        alike = texts.ratio()
        if alike >= teaser_ratio:
            return alike, "strong_teaser"
    same_region = bool(a["region"]) and a["region"] == b["region"]
    if a["n_source"] and b["n_source"] and a["n_source"] != b["n_source"] and a["locality"] and (a["locality"] == b["locality"] or same_region):
        return 0.96, "cross_source_locality"
    if _signals(a, b) >= signals:
        score = BASE_SCORE + sum(w for c, w in WEIGHTS.items() if a[f"n_{c}"] and a[f"n_{c}"] == b[f"n_{c}"])
        if least >= 25:
            score += TEASER_SHARE * (texts.ratio() if alike is None else alike)
        return min(MOST, score), "secondary_signals"
    return None


#: What the rules read of a card; cards that agree in all of it are alike to every rule.
READ = ("card", "locality", "region", *[f"n_{c}" for c in (*WEIGHTS, "teaser", "source")])


class Grouping:
    """Groups of one block's cards while they merge: each has its least id, its looks, its places and its localities.

    A look is one combination of the fields that the rules read. Evidence holds between looks, so a block of
    n cards with d looks compares d * d pairs, not n * n, and a card finds its best group in lists of groups by look.
    """

    def __init__(self, cards: list[tuple[object, tuple]]) -> None:
        self.looks: list[dict] = []
        self.primary: dict = {}
        self.members: dict = {}
        self.look_ids: dict = {}  # group: look: its least id in the group
        self.spots: dict = {}  # group: (locality, region) of its cards
        self.places: dict = {}  # place of a source: the groups there
        self.group_places: dict = {}
        self.groups_by_look: list[list] = []
        self.matches: dict[int, dict] = {}
        numbers: dict[tuple, int] = {}
        self.cards = []
        for i, fields in cards:
            look = numbers.setdefault(fields, len(numbers))
            if look == len(self.looks):
                self.looks.append(dict(zip(READ, fields)))
                self.groups_by_look.append([])
            self._add(i, look)
            self.cards.append((i, look))

    def _add(self, i: object, look: int) -> None:
        card = self.looks[look]
        if i not in self.primary:
            self.primary[i], self.members[i] = i, [i]
            self.look_ids[i], self.spots[i], self.group_places[i] = {}, set(), set()
        if look not in self.look_ids[i]:
            self.look_ids[i][look] = i
            self.groups_by_look[look].append(i)  # ids ascend
        self.spots[i].add((card["locality"], card["region"]))
        for place in (("at", card["locality"]), ("in", card["region"])):
            if place[1]:
                key = (card["n_source"], *place)
                self.places.setdefault(key, set()).add(i)
                self.group_places[i].add(key)

    def _matches(self, look: int) -> dict:
        """The looks that a card of this look has evidence for."""
        if look not in self.matches:
            found = ((other, evidence(self.looks[look], card)) for other, card in enumerate(self.looks))
            self.matches[look] = {other: e for other, e in found if e}
        return self.matches[look]

    def _alone(self, a: int, mine: object, b: int, theirs: object) -> bool:
        """Whether each source has one group at the place of look ``a`` or in its region: that of the card itself."""
        at, to = self.looks[a], self.looks[b]
        if at["locality"] != to["locality"]:
            return True  # a region match
        for card, group in ((at, mine), (to, theirs)):
            near = [self.places.get((card["n_source"], "at", at["locality"]), set())]
            if at["region"]:
                near.append(self.places.get((card["n_source"], "in", at["region"]), set()))
            if any(len(n) > 1 for n in near) or set().union(*near) != {group}:
                return False
        return True

    def _vetoed(self, a: object, b: object) -> bool:
        return any(_conflict({"locality": p, "region": r}, {"locality": q, "region": s}) for p, r in self.spots[a] for q, s in self.spots[b])

    def best(self, i: object, look: int) -> tuple[object, str] | None:
        """The group with the least primary that the card may join, and the kind of its strongest evidence there."""
        mine, found, last = self.primary[i], self._matches(look), None
        for group in heapq.merge(*(self.groups_by_look[other] for other in found)):
            if group == mine or group == last:
                continue
            last = group
            open_to = [(-found[o][0], least, found[o][1]) for o, least in self.look_ids[group].items() if o in found and (found[o][1] != "cross_source_locality" or self._alone(look, mine, o, group))]
            if open_to and not self._vetoed(mine, group):
                return group, min(open_to)[2]
        return None

    def merge(self, a: object, b: object) -> list:
        """Merge two groups under the lesser primary; the ids that got a new one."""
        a, b = sorted((a, b))
        moved = self.members.pop(b)
        for i in moved:
            self.primary[i] = a
        self.members[a] += moved
        for look, least in self.look_ids.pop(b).items():
            groups = self.groups_by_look[look]
            del groups[bisect_left(groups, b)]
            if look in self.look_ids[a]:
                self.look_ids[a][look] = min(self.look_ids[a][look], least)
            else:
                self.look_ids[a][look] = least
                insort(groups, a)
        self.spots[a] |= self.spots.pop(b)
        for key in self.group_places.pop(b):
            self.places[key].discard(b)
            self.places[key].add(a)
            self.group_places[a].add(key)
        return moved


def replay(block: pd.DataFrame) -> pd.DataFrame:
    """Group one block's cards: ids ascending, each linked to its best candidate unless the groups conflict.

    The best candidate has the least primary, then the highest evidence, then the least id. A match by
    locality alone must be the only one of its source on either side. A merged group keeps its least id;
    rows of one id are one card.
    """
    block = block.sort_values("id")
    fields = block[list(READ)].astype(object).where(block[list(READ)].notna(), None)
    groups = Grouping(list(zip(block["id"].tolist(), fields.itertuples(index=False, name=None))))
    kind: dict = {}
    for i, look in groups.cards:
        found = groups.best(i, look)
        if found:
            for moved in groups.merge(groups.primary[i], found[0]):
                kind.setdefault(moved, found[1])
    ids = [i for i, _ in groups.cards]
    primary = [groups.primary[i] for i in ids]
    return pd.DataFrame({"id": ids, "primary_id": primary, "match_type": [kind.get(i) if p != i else None for i, p in zip(ids, primary)]})


def same_vacancy(cards: DataFrame) -> DataFrame:
    """(id, primary_id, match_type) of every card, rebuilt from scratch: blocks are independent of each other.

    The rules are order-dependent and vetoed by groups, so this is no transitive closure. A block is one
    title of one employer; cards without a block are their own primaries.
    """
    p = prepared(cards)
    columns = ["id", "block", *READ]
    kind = cards.schema["id"].dataType.simpleString()
    schema = f"id {kind}, primary_id {kind}, match_type string"
    blocks = p.where(F.col("block").isNotNull()).select(*columns)
    sizes = blocks.groupBy(F.col("block").alias("_b")).agg(F.count("*").alias("_n"))
    sized = blocks.join(sizes, F.col("block") == F.col("_b"))
    grouped = sized.where("_n > 1").select(*columns).groupBy("block").applyInPandas(replay, schema)
    single = sized.where("_n = 1").unionByName(p.where(F.col("block").isNull()).select(*columns), allowMissingColumns=True)
    return grouped.unionByName(single.select("id", F.col("id").alias("primary_id"), F.lit(None).cast("string").alias("match_type")))


def rebuilt(assigned: DataFrame, cards: DataFrame) -> DataFrame:
    """The assignment with every block replayed that holds a group of several localities; all other rows stay as they are."""
    bad = conflicting_groups(assigned, cards).select(F.col("primary_id").alias("_bad"))
    block = prepared(cards).select(F.col("id").alias("_id"), "block")
    hit = assigned.join(bad, F.col("primary_id") == F.col("_bad"), "left_semi").join(block, F.col("id") == F.col("_id")).select(F.col("block").alias("_block")).distinct()
    redo = block.join(hit, F.col("block") == F.col("_block"), "left_semi").select(F.col("_id").alias("_redo"))
    kept = assigned.join(redo, F.col("id") == F.col("_redo"), "left_anti")
    return kept.unionByName(same_vacancy(cards.join(redo, F.col("id") == F.col("_redo"), "left_semi")).select(*assigned.columns))


def link_audit(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows whose primary changed between two assignments: old and new primary, and what was done."""
    both = before.select("id", F.col("primary_id").alias("old_primary")).join(after.select("id", F.col("primary_id").alias("new_primary")), "id", "full")
    alone = F.col("new_primary") == F.col("id")
    action = F.when(F.col("old_primary").isNull(), "added").when(F.col("new_primary").isNull(), "removed").when(alone, "unlinked").when(F.col("old_primary") == F.col("id"), "linked").otherwise("moved")
    return both.where(~F.col("old_primary").eqNullSafe(F.col("new_primary"))).withColumn("action", action)


def resolved_primaries(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, root) of each row's chain of primaries, by pointer doubling; a chain that goes in a circle is an error.

    ``links`` has (id, primary_id); null ends a chain, as does an id without a row. A round squares the
    length that a pointer spans, so few are needed whatever the length.
    """
    from tidemark.staging import staged

    now = staged(links.select("id", F.coalesce("primary_id", "id").alias("root")), "roots")
    for _ in range(rounds):
        step = now.select(F.col("id").alias("_id"), F.col("root").alias("_root"))
        jumped = now.join(step, F.col("root") == F.col("_id"), "left").select("id", F.coalesce("_root", "root").alias("next"), "root")
        jumped = staged(jumped, "roots")
        moved = jumped.where("next <> root").limit(1).count()
        now = jumped.select("id", F.col("next").alias("root"))
        if not moved:
            looped = links.where("primary_id IS NOT NULL").select("id").join(now.where("id = root").select("id"), "id").limit(1).count()
            if looped:
                raise RuntimeError("a chain of primaries goes in a circle")
            return now
    raise RuntimeError("a chain of primaries goes in a circle")


def conflicting_groups(assigned: DataFrame, cards: DataFrame) -> DataFrame:
    """Primaries of groups that hold more than one locality: the ones to rebuild."""
    named = prepared(cards).where("locality <> ''").select("id", "locality")
    return assigned.join(named, "id").groupBy("primary_id").agg(F.count_distinct("locality").alias("localities")).where("localities > 1")
