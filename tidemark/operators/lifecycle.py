"""Retention, retirement, work queues and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def retention(records: DataFrame, id_col: str, primary_col: str, last_seen: Column, archived: Column, archive_before: Column | None, remove_before: Column | None) -> DataFrame:
    """Add ``phase``: ``remove``, ``archive`` or ``keep``. Either phase is off where its bound is None.

    A row archived in this run may be removed in it; an alias that is not archived holds its primary back.
    """
    if archive_before is None:
        remove_before = None
    will_archive = archived | (last_seen < archive_before) if archive_before is not None else archived
    df = records.withColumn("_archived", will_archive)
    due = F.col("_archived") & (last_seen < remove_before) if remove_before is not None else F.lit(False)
    df = df.withColumn("_due", due)
    alive = df.where(F.col(primary_col).isNotNull() & ~F.col("_archived")).select(F.col(primary_col).alias("_p")).distinct()
    df = df.join(alive, F.col(id_col) == F.col("_p"), "left")
    phase = F.when(F.col("_due") & F.col("_p").isNull(), "remove").when(F.col("_archived") & ~archived, "archive").otherwise("keep")
    return df.withColumn("phase", phase).drop("_archived", "_due", "_p")


def reroot(members: DataFrame, vacancy: str, id_col: str, is_active: Column, last_seen: str) -> DataFrame:
    """The new primary of each family: the old one while it is active, else the freshest active member, else the old one."""
    own = (F.col(id_col) == F.col(vacancy)) & is_active
    order = [own.desc(), is_active.desc(), F.col(last_seen).desc(), F.col(id_col)]
    first = F.first(id_col).over(W.partitionBy(vacancy).orderBy(*order))
    any_on = F.bool_or(is_active).over(W.partitionBy(vacancy))
    return members.withColumn("new_primary", F.when(any_on, first).otherwise(F.col(vacancy)))


def enqueue(records: DataFrame, id_col: str, vacancy: str, has_text: Column, queue: DataFrame) -> DataFrame:
    """Records to queue: those of vacancies without a text, once each."""
    done = records.where(has_text).select(F.col(vacancy).alias("_v")).distinct()
    todo = records.join(done, F.col(vacancy) == F.col("_v"), "left_anti")
    return todo.join(queue.select(F.col("job_id").alias("_q")), F.col(id_col) == F.col("_q"), "left_anti")


def dequeue(queue: DataFrame, records: DataFrame, id_col: str, vacancy: str, is_active: Column, text: Column, attempts_below: int = 2, since: Column | None = None, limit: int | None = None, source: str | None = None) -> DataFrame:
    """Distinct primaries without a text of active rows that are due: queued since a time, tried before or failed, with attempts left."""
    due = queue.where(F.col("attempts") < attempts_below)
    if source is not None:
        due = due.where(F.col("source") == source.strip().lower())
    if since is not None:
        due = due.where((F.col("queued_at") >= since) | (F.col("attempts") > 0) | F.col("last_error").isNotNull())
    on = records.where(is_active).select(F.col(id_col).alias("_id"), F.col(vacancy).alias("primary_id"))
    bare = records.where(F.trim(F.coalesce(text, F.lit(""))) == "").select(F.col(id_col).alias("_p"))
    found = due.join(on, F.col("job_id") == F.col("_id")).join(bare, F.col("primary_id") == F.col("_p"), "left_semi").select("primary_id").distinct()
    return found if limit is None else found.orderBy("primary_id").limit(limit)


def prune(captures: DataFrame, ts: str, before: Column) -> DataFrame:
    """The captures that stay: those not older than a bound."""
    return captures.where(F.col(ts) >= before)


def defer(queue: DataFrame, failed: DataFrame) -> DataFrame:
    """Count an attempt and record the error of the queue rows that failed."""
    f = failed.select(F.col("job_id").alias("_id"), F.col("error").alias("_e"))
    out = queue.join(f, F.col("job_id") == F.col("_id"), "left")
    return out.withColumn("attempts", F.col("attempts") + F.col("_id").isNotNull().cast("int")).withColumn("last_error", F.coalesce("_e", "last_error")).drop("_id", "_e")


def readiness(vacancies: DataFrame, has_text: Column, failed: Column) -> DataFrame:
    """Mutually exclusive buckets: available, failed, missing."""
    return vacancies.agg(
        F.count_if(has_text).alias("available"),
        F.count_if(~has_text & failed).alias("failed"),
        F.count_if(~has_text & ~failed).alias("missing"),
    )


def audit(df: DataFrame, by: str, checks: dict[str, Column]) -> DataFrame:
    """A wide conditional aggregate by group, with the residual that no check explains (never negative)."""
    counted = df.groupBy(by).agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in checks.items()])
    rest = F.col("total")
    for n in checks:
        rest = rest - F.col(n)
    return counted.withColumn("residual", F.greatest(F.lit(0), rest))


def bounded_repair(candidates: DataFrame, attempted: DataFrame, id_col: str, limit: int) -> DataFrame:
    """The next candidates that were not tried before."""
    return candidates.join(attempted.select(F.col(id_col).alias("_t")), F.col(id_col) == F.col("_t"), "left_anti").orderBy(id_col).limit(limit)


def unique_window(points: DataFrame, windows: DataFrame, key: str, ts: str, start: str, end: str, value: str, point_id: str, width: int) -> DataFrame:
    """The value of the windows that hold a point, where all that do agree on one.

    The join is on key and time slot of ``width`` seconds: a point lies in one slot, a window in those that it
    touches, so a hot key meets slot by slot and not as one product. The range is checked on the matches.
    """
    slot = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (width * 1_000_000)).cast("long")
    w = windows.where(F.col(start) <= F.col(end)).select(
        F.col(key).alias("_k"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(value).alias("_v"), F.explode(F.sequence(slot(start), slot(end))).alias("_slot")
    )
    met = points.withColumn("_at", slot(ts)).join(w, (F.col(key) == F.col("_k")) & (F.col("_at") == F.col("_slot")) & F.col(ts).between(F.col("_s"), F.col("_e")))
    return met.groupBy(point_id).agg(F.count_distinct("_v").alias("_n"), F.min("_v").alias(value)).where("_n = 1").drop("_n")


def page_cutoff(cards: DataFrame, by: list[str], page: str, pos: str, ts: str, cutoff: Column) -> DataFrame:
    """Mark cards past an incremental cutoff, where a page is fit for one.

    A page is fit if every card has a time, they run newest first, and none is newer than the oldest of
    the page before; once a page is unfit, the cutoff is off for the pages after it, too.
    """
    here = W.partitionBy(*by, page)
    order = here.orderBy(pos)
    df = cards.withColumn("_ok", F.col(ts).isNotNull() & F.coalesce(F.lag(ts).over(order) >= F.col(ts), F.row_number().over(order) == 1))
    pages = df.groupBy(*by, page).agg(F.every("_ok").alias("_fit"), F.min(ts).alias("_old"), F.max(ts).alias("_new"))
    seq = W.partitionBy(*by).orderBy(page)
    pages = pages.withColumn("_fit", F.col("_fit") & F.coalesce(F.col("_new") <= F.lag("_old").over(seq), F.lit(True)))
    pages = pages.withColumn("_fit", F.every("_fit").over(seq.rowsBetween(W.unboundedPreceding, 0)))
    out = cards.join(pages.select(*by, page, "_fit"), [*by, page])
    return out.withColumn("past_cutoff", F.col("_fit") & F.coalesce(F.col(ts) < cutoff, F.lit(False))).withColumnRenamed("_fit", "cutoff_active")
