"""Reading operators: active records, vacancies, keyset pages, snapshots, search results and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def active(status: Column, terminal: tuple[str, ...]) -> Column:
    """Null-safe: a record without a status is active."""
    return ~F.coalesce(status, F.lit("")).isin(*terminal)


def vacancy_id(primary: Column, own: Column) -> Column:
    """Primaries are kept flat, so membership is an equality on this column and joins stay hash joins."""
    return F.coalesce(primary, own)


def with_active_member(records: DataFrame, id_col: str, primary_col: str, is_active: Column) -> DataFrame:
    """Primaries of vacancies of which any member, primary or alias, is active."""
    alive = records.where(is_active).select(vacancy_id(F.col(primary_col), F.col(id_col)).alias("_v")).distinct()
    return records.where(F.col(primary_col).isNull()).join(alive, F.col(id_col) == F.col("_v"), "left_semi")


def snapshot(df: DataFrame, id_col: str, after: int = 0, through: int | None = None) -> DataFrame:
    """Rows after a cursor, up to the high-water mark of a run, where there is one."""
    df = df.where(F.col(id_col) > after)
    return df if through is None else df.where(F.col(id_col) <= through)


def keyset_page(df: DataFrame, id_col: str, limit: int, after: int = 0, through: int | None = None) -> DataFrame:
    """The page after a cursor, with ``has_more`` and ``next_cursor`` on each row.

    One row beyond the page tells whether there is more; only that many rows leave the sort.
    """
    if not 1 <= limit <= 1000:
        raise ValueError("a page has 1 to 1000 rows")
    top = snapshot(df, id_col, after, through).orderBy(id_col).limit(limit + 1)
    every = W.partitionBy(F.lit(1))  # over limit + 1 rows at most
    seen = top.withColumn("_n", F.count("*").over(every)).withColumn("_k", F.row_number().over(every.orderBy(id_col)))
    page = seen.where(F.col("_k") <= limit).withColumn("has_more", F.col("_n") > limit)
    return page.withColumn("next_cursor", F.max(id_col).over(every)).drop("_n", "_k")


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in an order; the order should end in a unique column."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_k = 1").drop("_k")


def top_recent(df: DataFrame, ts_col: str, id_col: str, limit: int) -> DataFrame:
    """The most recent rows; ties by the greater id."""
    return df.orderBy(F.col(ts_col).desc(), F.col(id_col).desc()).limit(limit)


def pending(df: DataFrame, id_col: str, checkpoint: int, is_active: Column) -> DataFrame:
    """High-water mark and number of active rows past a checkpoint, in one pass."""
    late = (F.col(id_col) > checkpoint) & is_active
    return df.agg(F.max(id_col).alias("through_id"), F.count_if(late).alias("pending"))


def lifecycle(records: DataFrame, by: str, last_seen: str, is_active: Column) -> DataFrame:
    """Members, last sighting and activity of each vacancy; the members' own times stay as they are."""
    return records.groupBy(by).agg(F.count("*").alias("members"), F.max(last_seen).alias("last_seen"), F.bool_or(is_active).alias("active"))


def link_counts(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Number of links of each endpoint of undirected edges."""
    ends = edges.select(F.explode(F.array(a, b)).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("links"))


def search_results(members: DataFrame, predicate: Column, vacancy: str, id_col: str, source_col: str) -> DataFrame:
    """Vacancies with a matching member: the members that matched and their sources. Its count is the exact total."""
    hit = members.where(predicate)
    pair = F.struct(F.col(id_col).alias("id"), F.col(source_col).alias("source"))
    return hit.groupBy(vacancy).agg(F.array_sort(F.collect_set(pair)).alias("matched_sources"))


def exact_lookup(df: DataFrame, url: str | None = None, source: str | None = None, native_id: str | None = None) -> DataFrame:
    """Rows of one identity: a URL, or a source with its id, but not both."""
    if (url is None) == (source is None and native_id is None) or (source is None) != (native_id is None):
        raise ValueError("either a URL or a source with an id")
    if url is not None:
        from tidemark.functions.text import canonical_url

        return df.where(F.col("canonical_url") == canonical_url(F.lit(url)))
    return df.where((F.lower("source") == source.lower()) & (F.col("source_job_id") == native_id))


def text_outcome(posting: DataFrame, tombstones: DataFrame, key: str, text_col: str) -> DataFrame:
    """200 with a cached text, 409 without one, 410 where only a tombstone is left; keys in neither are 404 to the caller."""
    both = posting.select(key, text_col).join(tombstones.select(F.col(key).alias("_t")), F.col(key) == F.col("_t"), "full")
    code = F.when(F.trim(F.col(text_col)) != "", 200).when(F.col(key).isNotNull(), 409).otherwise(410)
    return both.select(F.coalesce(key, "_t").alias(key), code.alias("code"), text_col)


def summary(df: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """Any number of conditional counts in one pass; an empty table counts 0."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in counts.items()])


def delta(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """Counts by key in two snapshots and their difference; a key missing on one side counts 0 there."""
    a = before.groupBy(F.col(by).alias("_a")).agg(F.count("*").alias("_n0"))
    b = after.groupBy(F.col(by).alias("_b")).agg(F.count("*").alias("_n1"))
    n0, n1 = F.coalesce("_n0", F.lit(0)), F.coalesce("_n1", F.lit(0))
    return a.join(b, F.col("_a") == F.col("_b"), "full").select(F.coalesce("_a", "_b").alias(by), n0.alias("before"), n1.alias("after"), (n1 - n0).alias("change"))
