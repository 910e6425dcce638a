"""Folding observations into records. There is no table to update in place: folds read a snapshot and the
new observations and give the next snapshot, which is written to a new folder.

Every fold has an order column that is unique, so that results don't depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_known(col: str | Column, order: Column, name: str) -> Column:
    """Aggregate: the last value that is not null. Rows without one never win."""
    c = F.col(col) if isinstance(col, str) else col
    return F.max_by(c, F.when(c.isNotNull(), order)).alias(name)


def first_known(col: str | Column, order: Column, name: str) -> Column:
    """Aggregate: the first value that is not null (write once)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.min_by(c, F.when(c.isNotNull(), order)).alias(name)


def upsert(obs: DataFrame, key: str, order: Column, fields: list[str], sticky: list[str] = ()) -> DataFrame:
    """Fold observations by key: known values overwrite, nulls preserve, ``sticky`` booleans stay true once set."""
    kept = [last_known(f, order, f) for f in fields] + [F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in sticky]
    return obs.groupBy(key).agg(*kept)


def observation_state(obs: DataFrame, key: str, ts: str, order: Column) -> DataFrame:
    """First sighting, time of the last arrival (not the greatest time) and number of observations."""
    return obs.groupBy(key).agg(F.min(ts).alias("first_seen"), F.max_by(ts, order).alias("last_seen"), F.count("*").alias("capture_count"))


def refresh_state(state: DataFrame, obs: DataFrame, key: str, ts: str, order: Column) -> DataFrame:
    """The state table after new observations: what is seen again is no longer archived, the rest stays as it is."""
    new = observation_state(obs, key, ts, order).withColumnsRenamed({key: "_k", "first_seen": "_first", "last_seen": "_last", "capture_count": "_n"})
    both = state.join(new, F.col(key) == F.col("_k"), "full")
    return both.select(
        F.coalesce(key, "_k").alias(key),
        F.least("first_seen", "_first").alias("first_seen"),
        F.coalesce("_last", "last_seen").alias("last_seen"),
        (F.coalesce("capture_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("capture_count"),
        (F.col("_k").isNull() & F.coalesce("archived", F.lit(False))).alias("archived"),
    )


def query_counters(found: DataFrame, query: str, job: str, primary: str, created: str) -> DataFrame:
    """Counters of each discovery query: cards, jobs that are new to the market, and duplicates.

    A new row that joins a known vacancy counts as a duplicate, not as new.
    """
    alias = F.col(primary) != F.col(job)
    new = F.coalesce(F.col(created), F.lit(False)) & ~F.coalesce(alias, F.lit(False))
    return found.groupBy(query).agg(F.count("*").alias("cards"), F.count_if(new).alias("new_jobs"), F.count_if(~new).alias("duplicates"))


def overlay(existing: DataFrame, edits: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Records with edits laid over them: what an edit leaves out stays, and an unknown key is inserted."""
    new = edits.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in fields])
    return existing.join(new, F.col(key) == F.col("_k"), "full").select(F.coalesce(key, "_k").alias(key), *[F.coalesce(f"_{c}", c).alias(c) for c in fields])


def rank_merge(obs: DataFrame, key: str, value: str, rank: Column, seq: Column, exact_rank: int = 3) -> DataFrame:
    """The value of the highest rank; among the exact the longest text; then the first to arrive."""
    r = rank.alias("r")
    order = F.struct(r, F.when(rank == exact_rank, F.length(value)).otherwise(F.lit(0)).alias("n"), (-seq).alias("s"))
    return obs.groupBy(key).agg(F.max_by(F.col(value), order).alias(value), F.max(rank).alias("basis_rank"))


def fill_only(current: DataFrame, detail: DataFrame, key: str, fill: list[str], refresh: list[str] = (), sticky: list[str] = ()) -> DataFrame:
    """Fill blanks from a detail record, take ``refresh`` fields from it, and keep ``sticky`` booleans set.

    Of several details of one key the greatest known value of each field counts, so no record is multiplied.
    """
    new = detail.groupBy(F.col(key).alias("_k")).agg(*[F.max(c).alias(f"_{c}") for c in (*fill, *refresh, *sticky)])
    out = current.join(new, F.col(key) == F.col("_k"), "left")
    blank = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    changes = {c: F.when(blank(c).isNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in fill}
    changes |= {c: F.coalesce(f"_{c}", c) for c in refresh}
    changes |= {c: F.coalesce(F.col(c), F.lit(False)) | F.coalesce(F.col(f"_{c}"), F.lit(False)) for c in sticky}
    return out.withColumns(changes).select(*current.columns)


def merge_states(rows: DataFrame, keys: list[str], state: str, order: Column) -> DataFrame:
    """The last recorded state that is not ``unknown``; unknown only where nothing else was recorded."""
    said = F.nullif(F.col(state), F.lit("unknown"))
    return rows.groupBy(*keys).agg(F.coalesce(F.max_by(said, F.when(said.isNotNull(), order)), F.lit("unknown")).alias(state))


def missing_states(records: DataFrame, id_col: str, fields: list[str], known: DataFrame) -> DataFrame:
    """State rows to insert: every field of every record that has none yet."""
    every = records.select(F.col(id_col).alias("job_id"), F.explode(F.array(*[F.lit(f) for f in fields])).alias("field_name"), F.lit("unknown").alias("state"))
    return every.join(known.select("job_id", "field_name"), ["job_id", "field_name"], "left_anti")


def hits(obs: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Provenance: how often and when first and last each pair of keys met."""
    return obs.groupBy(*keys).agg(F.count("*").alias("hit_count"), F.min(ts).alias("first_hit"), F.max(ts).alias("last_hit"))


def tombstones(gone: DataFrame, key: str, first: str, last: str, count: str) -> DataFrame:
    """Identity memory of removed records: earliest first, latest last, greatest count."""
    return gone.groupBy(key).agg(F.min(first).alias(first), F.max(last).alias(last), F.max(count).alias(count))


def resurrect(new: DataFrame, stones: DataFrame, key: str, first: str, count: str) -> DataFrame:
    """New records with what their tombstone remembers: first sighting and count go on, ``created`` is false."""
    old = stones.select(F.col(key).alias("_k"), F.col(first).alias("_first"), F.col(count).alias("_count"))
    out = new.join(old, F.col(key) == F.col("_k"), "left")
    out = out.withColumns({first: F.least(F.col(first), F.col("_first")), count: F.col(count) + F.coalesce("_count", F.lit(0)), "created": F.col("_k").isNull()})
    return out.drop("_k", "_first", "_count")


def changed(current: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Incoming rows that differ from the snapshot in a field, folded in case and white space; blanks never differ."""
    from tidemark.functions.text import fold

    old = current.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in fields])
    both = incoming.join(old, F.col(key) == F.col("_k"), "left")
    differs = [F.struct(fold(F.col(c)).alias("new"), fold(F.col(f"_{c}")).alias("old")) for c in fields]
    new = F.exists(F.array(*differs), lambda d: (d["new"] != "") & (d["new"] != d["old"]))
    return both.where(F.col("_k").isNull() | new).select(*incoming.columns)


def identity_lookup(incoming: DataFrame, jobs: DataFrame, stones: DataFrame, by_id: str, by_url: str, target: str) -> DataFrame:
    """Match by id in the records, then URL there, then id and URL among the tombstones; the first match wins."""
    out = incoming
    sides = [(jobs, by_id, "_a", "job"), (jobs, by_url, "_b", "job"), (stones, by_id, "_c", "tombstone"), (stones, by_url, "_d", "tombstone")]
    for side, key, name, _ in sides:
        one = side.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"{name}k")).agg(F.min(target).alias(name))
        out = out.join(one, out[key] == F.col(f"{name}k"), "left").drop(f"{name}k")
    kind = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(k)) for _, _, n, k in sides])
    return out.withColumn("match", F.coalesce(*[n for _, _, n, _ in sides])).withColumn("match_kind", kind).drop("_a", "_b", "_c", "_d")


def import_plan(rows: DataFrame, key: str, required: list[str], fields: list[str], order: Column, conflict: str) -> DataFrame:
    """Dry run of a bulk import: one row for each identity with merged fields and ``verdict``.

    Rows that lack a required field are ``invalid``; identities with more than one value of ``conflict``
    are ``conflict`` and block themselves; the rest is ``import``.
    """
    ok = F.lit(True)
    for c in required:
        ok = ok & F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))
    marked = rows.withColumn("_ok", ok)
    first = [F.min_by(F.when(F.col("_ok"), F.col(f)), F.when(F.col("_ok") & F.col(f).isNotNull(), order)).alias(f) for f in fields]
    out = marked.groupBy(key).agg(F.count("*").alias("rows"), F.count_if("_ok").alias("valid_rows"), F.count_distinct(F.when(F.col("_ok"), F.col(conflict))).alias("_n"), *first)
    verdict = F.when(F.col("valid_rows") == 0, "invalid").when(F.col("_n") > 1, "conflict").otherwise("import")
    return out.withColumn("verdict", verdict).drop("_n")


def registry_sync(wanted: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Actions on a registry: insert the new, deactivate the missing, keep the rest as it is (never reactivate)."""
    a = wanted.select(*keys).distinct().withColumn("_w", F.lit(True))
    b = current.select(*keys, F.col("active").alias("_on"))
    out = a.join(b, keys, "full")
    action = F.when(F.col("_on").isNull(), "insert").when(F.col("_w").isNull() & F.col("_on"), "deactivate").otherwise("keep")
    return out.select(*keys, action.alias("action"))


def recompute_diff(before: DataFrame, after: DataFrame, key: str, col: str) -> DataFrame:
    """Histogram of a recomputed column before and after, with the number of rows that would change."""
    both = before.select(key, F.col(col).alias("old")).join(after.select(key, F.col(col).alias("new")), key)
    return both.groupBy("old", "new").agg(F.count("*").alias("rows")).withColumn("changed", ~F.col("old").eqNullSafe(F.col("new")))
