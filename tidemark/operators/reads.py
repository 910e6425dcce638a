"""Whole reads, composed of the other operators: feed, search, detail, new records, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import feed


def payload(df: DataFrame, tags: str, flags: list[str], salary: list[str], raw: list[str] = (), include_raw: bool = True) -> DataFrame:
    """Records as they are served: tags decoded from JSON (malformed ones are none), flags as booleans, the salary as one struct, raw texts on demand."""
    decoded = F.coalesce(F.from_json(tags, "array<string>"), F.array().cast("array<string>"))
    out = df.withColumns({tags: decoded, **{f: F.col(f).cast("boolean") for f in flags}, "salary_normalized": F.struct(*salary)}).drop(*salary)
    return out if include_raw else out.drop(*raw)


def feed_page(postings: DataFrame, links: DataFrame, limit: int, is_active: Column, after: int = 0, through: int | None = None, source: str | None = None, geography: str | None = None, include_archived: bool = False) -> DataFrame:
    """A page of primaries with the life cycle of their vacancies and the number of their duplicate links.

    ``postings`` has (id, primary_id, source, geography_code, last_seen, ...), ``links`` (a, b). The equality filters
    hold for the primary row only. The page is cut first; what it needs of members and links is joined to its rows.
    """
    rows = postings if include_archived else feed.with_active_member(postings, "id", "primary_id", is_active)
    rows = rows.where("primary_id IS NULL")
    if source:
        rows = rows.where(F.col("source") == source.strip().lower())
    if geography:
        rows = rows.where(F.col("geography_code") == geography.strip().upper())
    page = feed.keyset_page(rows, "id", limit, after, through)
    members = postings.withColumn("_v", feed.vacancy_id(F.col("primary_id"), F.col("id"))).join(page.select(F.col("id").alias("_p")), F.col("_v") == F.col("_p"), "left_semi")
    life = feed.lifecycle(members, "_v", "last_seen", is_active).withColumnsRenamed({"last_seen": "vacancy_last_seen", "active": "vacancy_active"})
    counted = feed.link_counts(links, "a", "b").withColumnRenamed("id", "_l")
    out = page.join(life, F.col("id") == F.col("_v"), "left").join(counted, F.col("id") == F.col("_l"), "left")
    return out.withColumn("links", F.coalesce("links", F.lit(0))).drop("_v", "_l")


def search_page(postings: DataFrame, predicate: Column, comparable: Column, is_active: Column, limit: int, after: int = 0, include_archived: bool = False) -> DataFrame:
    """A page of vacancies of which a member matches, with the exact total, their life cycle, the members that matched and the basis of the match.

    ``postings`` has (id, vacancy, source, last_seen, ...). All of a vacancy's figures come from one aggregate, so members
    are shuffled once; the total is a count of the vacancies before the page is cut.
    """
    hit = F.struct(F.col("id"), F.col("source"), F.when(comparable, F.lit("comparable_overlap")).otherwise(F.lit("uncertain_preserved")).alias("basis"))
    found = postings.groupBy("vacancy").agg(
        F.array_sort(F.collect_list(F.when(predicate, hit))).alias("matched"), F.count("*").alias("members"), F.max("last_seen").alias("last_seen"), F.bool_or(is_active).alias("active")
    )
    found = found.where(F.size("matched") > 0)
    if not include_archived:
        found = found.where("active")
    total = found.agg(F.count("*").alias("total"))  # one row
    return found.where(F.col("vacancy") > after).orderBy("vacancy").limit(limit).join(F.broadcast(total))


def new_records(records: DataFrame, state: DataFrame, id_col: str, ts_col: str, since: Column, limit: int) -> DataFrame:
    """The most recent primaries seen first since a time; without a state row they are left out, archived or not they are in."""
    both = records.where("primary_id IS NULL").join(state, id_col).where(F.col(ts_col) >= since)
    return feed.top_recent(both, ts_col, id_col, limit)


def history(captures: DataFrame, by: str, order: list[Column], fields: list[str], limit: int) -> DataFrame:
    """The latest captures of each record as one JSON array, newest first; no more than the limit of any record are gathered."""
    rows = feed_rank(captures, by, order).where(F.col("_k") <= limit)
    listed = F.array_sort(F.collect_list(F.struct("_k", *fields)))
    return rows.groupBy(by).agg(F.to_json(F.transform(listed, lambda r: F.struct(*[r[f].alias(f) for f in fields]))).alias("captures"))


def feed_rank(df: DataFrame, by: str, order: list[Column]) -> DataFrame:
    from pyspark.sql import Window as W

    return df.withColumn("_k", F.row_number().over(W.partitionBy(by).orderBy(*order)))


def query_hits_of(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits with their queries' texts; the queries are a dimension. A record's hits go by count, then text."""
    texts = queries.select(F.col("query_id").alias("_q"), "query_text")
    joined = hits.join(texts, F.col("query_id") == F.col("_q")).drop("_q")
    return feed_rank(joined, "job_id", [F.col("hit_count").desc(), F.col("query_text")]).withColumnRenamed("_k", "place")


def neighbours(edges: DataFrame) -> DataFrame:
    """Duplicate links seen from both ends: (id, other, score, match_type)."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other"))))
    return edges.select(ends.alias("e"), "score", "match_type").select("e.*", "score", "match_type")


def population(postings: DataFrame, terminal: Column, has_text: Column) -> DataFrame:
    """Totals by source and over all (source null), in one pass."""
    return postings.rollup("source").agg(F.count("*").alias("jobs"), F.count_if(has_text).alias("with_text"), F.count_if(~has_text).alias("without_text"), F.count_if(terminal).alias("unavailable"))


def campaign_progress(cursors: DataFrame, places: DataFrame, cycle: str, terminal: tuple[str, ...] = ("COMPLETE", "INCOMPLETE_CAP")) -> DataFrame:
    """How many places of a campaign are complete, capped and left; a cursor of another cycle does not count."""
    own = cursors.where(F.col("cycle") == cycle).select(F.col("place").alias("_p"), "status")
    both = places.join(own, F.col("place") == F.col("_p"), "left")
    counts = both.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "COMPLETE").alias("complete"), F.count_if(F.col("status") == "INCOMPLETE_CAP").alias("capped"), F.count_if(F.col("status").isin(*terminal)).alias("_done"))
    return counts.withColumn("remaining", F.greatest(F.lit(0), F.col("total") - F.col("_done"))).drop("_done")


def source_candidates(postings: DataFrame, is_active: Column, priority: dict[str, int]) -> DataFrame:
    """Active members of each vacancy in the order in which a text is looked for: by source priority, then the newest id."""
    rank = F.coalesce(F.create_map(*[x for k, v in priority.items() for x in (F.lit(k), F.lit(v))])[F.lower("source")], F.lit(99))
    return feed_rank(postings.where(is_active), "vacancy", [rank, F.col("id").desc()]).withColumnRenamed("_k", "place")


def only_ids(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows whose id is in a list, however often the list names it."""
    return df.join(ids.select(F.col(ids.columns[0]).alias("_i")), F.col(id_col) == F.col("_i"), "left_semi")


def terminal_families(postings: DataFrame, source: str, since: Column, terminal: Column) -> DataFrame:
    """Vacancies that a source has shown since a time and of which a member is terminal: those to clean up."""
    seen = postings.where((F.col("source") == source.strip().lower()) & (F.col("last_seen") >= since)).select(F.col("vacancy").alias("_v")).distinct()
    return postings.where(terminal).join(seen, F.col("vacancy") == F.col("_v"), "left_semi").groupBy("vacancy").agg(F.count("*").alias("terminal_members"))


def best_date(captures: DataFrame, key: str, value: Column, rank: Column) -> DataFrame:
    """The best evidence of each record: the highest rank, and in it the earliest value."""
    rows = captures.select(key, value.alias("value"), rank.alias("rank")).where(F.col("value").isNotNull())
    return rows.groupBy(key).agg(F.min_by("value", F.struct(-F.col("rank"), F.col("value"))).alias("value"), F.max("rank").alias("rank"))


def backfill(records: DataFrame, evidence: DataFrame, key: str, value: str, stale: Column) -> DataFrame:
    """What a backfill does to each record that has no usable value: ``update`` it from evidence, ``clear`` a stale one, or ``none``."""
    found = evidence.select(F.col(key).alias("_k"), F.col("value").alias("_new"))
    both = records.join(found, F.col(key) == F.col("_k"), "left")
    open_ = F.col(value).isNull() | stale
    action = F.when(~open_, "keep").when(F.col("_new").isNotNull(), "update").when(stale, "clear").otherwise("none")
    new = F.when(action == "update", F.col("_new")).when(action == "keep", F.col(value))
    return both.select(key, F.col(value).alias("before"), new.alias("after"), action.alias("action"))
