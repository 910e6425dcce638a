"""Streaming forms: running observation state, snapshot-bounded reads and monotone checkpoints.

No watermark is set anywhere: completeness is preferred to an early stop, and late rows count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.staging import new_folder


def running_state(stream: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    """First sighting, last arrival and count by key; state is three values for each key, whatever the history."""
    return stream.groupBy(key).agg(F.min(ts).alias("first_seen"), F.max_by(ts, order).alias("last_seen"), F.count("*").alias("capture_count"))


def drain(stream: DataFrame, mode: str = "complete", folder: str | None = None) -> DataFrame:
    """Run a stream over all that is there now and stop; every batch's result is a table of its own, and the last one is returned."""
    spark = stream.sparkSession
    base = folder or new_folder(spark)
    written: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/batches/{number:09d}")
        written.append(number)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not written:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{base}/batches/{written[-1]:09d}")


def read_new(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """New files of an append-only table as a stream; the trigger ``availableNow`` bounds a run by a snapshot."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def advance(checkpoints: DataFrame, consumer: str, to: int) -> DataFrame:
    """The checkpoint table with a consumer moved forward. Moving back is an error, standing still is not."""
    now = checkpoints.where(F.col("consumer_key") == consumer).agg(F.max("last_id")).first()[0]
    if now is not None and to < now:
        raise ValueError(f"{consumer} is at {now}, past {to}")
    row = checkpoints.sparkSession.createDataFrame([(consumer, to)], "consumer_key string, last_id long")
    return checkpoints.where(F.col("consumer_key") != consumer).unionByName(row)


def cycle_transition(state: str | None, same_key: bool) -> str:
    """The next state of a campaign that is opened again: a running one was partial, an ended one restarts under a new key."""
    if state is None or state in ("COMPLETE", "FAILED") and not same_key:
        return "RUNNING"
    return "PARTIAL" if state == "RUNNING" else state


def cursor_for(cursors: DataFrame, keys: dict[str, str], cycle: str) -> int:
    """The offset to go on from: that of this cycle, or 0 under a new one."""
    df = cursors.where(F.col("cycle") == cycle)
    for k, v in keys.items():
        df = df.where(F.col(k) == v)
    found = df.agg(F.max("offset")).first()[0]
    return int(found or 0)


def latest_watermark(runs: DataFrame, codes: list[str]) -> str | None:
    """Start of the latest complete fresh run whose every geography is complete; none where there is no such run.

    ``runs`` has (id, kind, mode, status, started_at, stats), the last a JSON text with a status by geography.
    """
    if not codes:
        return None
    coverage = F.from_json("stats", "struct<coverage:map<string,struct<status:string>>>")["coverage"]
    whole = F.forall(F.array(*[F.lit(c) for c in codes]), lambda c: F.coalesce(F.col("_c")[c]["status"].startswith("COMPLETE"), F.lit(False)))
    fit = runs.where("kind = 'normal' AND mode = 'fresh' AND status = 'COMPLETE'").withColumn("_c", coverage).where(whole)
    return fit.agg(F.max_by("started_at", "id")).first()[0]


def incremental_cutoff(previous: Column, started: Column, overlap_minutes: int, days: int) -> Column:
    """The time to go back to: the previous complete start less an overlap, if that lies inside the horizon; else null."""
    back = F.timestamp_micros(F.unix_micros(previous) - overlap_minutes * 60_000_000)
    return F.when(F.unix_micros(back) > F.unix_micros(started) - days * 86_400_000_000, back)


def consumer_state(records: DataFrame, checkpoints: DataFrame, id_col: str, is_active: Column) -> DataFrame:
    """Each consumer's checkpoint, the high-water mark and the number of active records past the checkpoint.

    Counts by distance: the checkpoints are few, so the active ids are sorted into their intervals in one pass,
    and what lies past a checkpoint is the sum of the intervals above it.
    """
    edges = sorted({r[0] for r in checkpoints.select("last_id").distinct().collect()})  # one for each consumer at most
    at = F.lit(0)
    for e in edges:
        at = at + F.when(F.col(id_col) > e, 1).otherwise(0)
    counts = records.where(is_active).groupBy(at.alias("_past")).agg(F.count("*").alias("_n"))
    place = F.array_position(F.array(*[F.lit(e).cast("long") for e in edges]), F.col("last_id").cast("long"))
    through = records.agg(F.max(id_col).alias("through_id"))
    met = checkpoints.withColumn("_place", place).join(F.broadcast(counts), F.col("_past") >= F.col("_place"), "left")
    total = met.groupBy("consumer_key", "last_id").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("pending"))
    return total.join(F.broadcast(through))
