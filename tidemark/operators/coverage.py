"""Coverage of a tree of partitions: leaves, parents from their children, and what is still incomplete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def leaf_status(seen: Column, reported: Column, tolerance: int, cutoff_crossed: Column, repeated: Column, page_limit: Column) -> Column:
    """The status of a leaf, the first that applies."""
    return (
        F.when(seen + tolerance >= reported, "COMPLETE")
        .when(cutoff_crossed, "COMPLETE_INCREMENTAL")
        .when(repeated, "INCOMPLETE_REPEATED_PAGE")
        .when(page_limit, "INCOMPLETE_PAGE_LIMIT")
        .otherwise("INCOMPLETE_COUNT_MISMATCH")
    )


def recovered(status: Column, persisted: Column, reported: Column, tolerance: int) -> Column:
    """A leaf that was left open is complete if what was kept of it is enough."""
    return F.when(~status.startswith("COMPLETE") & (persisted + tolerance >= reported), "COMPLETE_RECOVERED").otherwise(status)


def split_decision(reported: Column, threshold: int, children: Column) -> Column:
    return F.when(reported <= threshold, "LEAF").when(children > 0, "SPLIT").otherwise("UNSPLITTABLE")


def roll_up(children: DataFrame, membership: DataFrame, reported: DataFrame, tolerance: int) -> DataFrame:
    """Status of each parent from its children (id, parent, status) and the distinct jobs that they hold.

    ``membership`` has (partition, job); a job under two children counts once. ``reported`` has (id, reported).
    """
    ok = children.groupBy("parent").agg(
        F.count("*").alias("child_count"),
        F.every(F.col("status").startswith("COMPLETE")).alias("_ok"),
        F.some(F.col("status") == "COMPLETE_INCREMENTAL").alias("_inc"),
    )
    held = membership.join(children.select(F.col("id").alias("partition"), "parent"), "partition").groupBy(F.col("parent").alias("_p")).agg(F.count_distinct("job").alias("unique_jobs"))
    out = reported.join(ok, F.col("id") == F.col("parent"), "left").join(held, F.col("id") == F.col("_p"), "left")
    n = F.coalesce("unique_jobs", F.lit(0))
    good = F.coalesce("_ok", F.lit(False))
    status = F.when(good & F.col("_inc"), "COMPLETE_INCREMENTAL").when(good & (n + tolerance >= F.col("reported")), "COMPLETE_BY_PARTITION").otherwise("INCOMPLETE_CHILD_COVERAGE")
    return out.select("id", "reported", n.alias("unique_jobs"), F.coalesce("child_count", F.lit(0)).alias("child_count"), status.alias("status"))


def reconciled(status: Column, unique: Column, refreshed: Column, tolerance: int) -> Column:
    """A root held against a count that was read again."""
    return F.when((status == "INCOMPLETE_CHILD_COVERAGE") & (unique + tolerance >= refreshed), "COMPLETE_BY_PARTITION").otherwise(status)


def paths(nodes: DataFrame, depth: int = 200) -> DataFrame:
    """Path ``A > B`` from the root and depth of each node (id, parent, label), by a recursive query.

    A tree of more levels than ``depth`` is an error, never a shorter result.
    """
    import uuid

    view = f"tidemark_tree_{uuid.uuid4().hex}"
    nodes.createOrReplaceTempView(view)
    try:
        return nodes.sparkSession.sql(f"""
            WITH RECURSIVE t(id, path, depth) MAX RECURSION LEVEL {depth} AS (
              SELECT id, CAST(label AS STRING), 0 FROM {view} WHERE parent IS NULL
              UNION ALL
              SELECT c.id, concat(t.path, ' > ', c.label), t.depth + 1 FROM {view} c JOIN t ON c.parent = t.id)
            SELECT id, path, depth FROM t""")
    finally:
        nodes.sparkSession.catalog.dropTempView(view)


def report(roots: DataFrame, partitions: DataFrame, history: DataFrame, code: str, updated: str) -> DataFrame:
    """One row for each geography: its latest root, how many partitions are not complete, and the last archived cycle.

    ``roots`` lists the geographies; ``partitions`` has (code, id, parent, status, reported, unique_jobs, updated).
    """
    latest = partitions.where("parent IS NULL").groupBy(F.col(code).alias("_c")).agg(F.max_by(F.struct("status", "reported", "unique_jobs"), F.struct(updated, "id")).alias("_root"))
    open_ = partitions.where(~F.col("status").startswith("COMPLETE")).groupBy(F.col(code).alias("_o")).agg(F.count("*").alias("_open"))
    before = history.groupBy(F.col(code).alias("_h")).agg(F.max_by(F.struct("root_status", "covered"), F.struct("captured_at", "id")).alias("_last"))
    out = roots.join(latest, F.col(code) == F.col("_c"), "left").join(open_, F.col(code) == F.col("_o"), "left").join(before, F.col(code) == F.col("_h"), "left")
    return out.select(
        code, F.col("_root").isNotNull().alias("has_cycle"), F.coalesce("_root.status", F.lit("NOT_RUN")).alias("status"), F.col("_root.reported").alias("reported"),
        F.coalesce("_root.unique_jobs", F.lit(0)).alias("unique_jobs"), F.coalesce("_open", F.lit(0)).alias("incomplete"), F.col("_last.root_status").alias("previous_status"), F.col("_last.covered").alias("previous_covered"),
    )


def reset(partitions: DataFrame, code: str) -> tuple[DataFrame, DataFrame]:
    """History rows of a cycle's latest roots, and the workspace of the next: roots only, pending and empty."""
    open_ = partitions.groupBy(F.col(code).alias("_o")).agg(F.count_if(~F.col("status").startswith("COMPLETE")).alias("incomplete"))
    latest = partitions.where("parent IS NULL").groupBy(code).agg(F.max_by(F.struct("status", "reported", "unique_jobs"), "id").alias("_root"))
    history = latest.join(open_, F.col(code) == F.col("_o")).select(code, F.col("_root.status").alias("root_status"), F.col("_root.reported").alias("reported"), F.col("_root.unique_jobs").alias("covered"), "incomplete")
    clean = {"status": F.lit("PENDING"), "reported": F.lit(None).cast(partitions.schema["reported"].dataType), "unique_jobs": F.lit(0).cast(partitions.schema["unique_jobs"].dataType)}
    return history, partitions.where("parent IS NULL").withColumns(clean)


def covered_jobs(jobs: DataFrame, membership: DataFrame, id_col: str, primary_col: str) -> DataFrame:
    """(job, partition) of jobs that are, or whose primary is, in a partition: each job's two keys are exploded, so the join is on equality."""
    keys = jobs.select(F.col(id_col).alias("job"), F.explode(F.array_distinct(F.array_compact(F.array(id_col, primary_col)))).alias("_key"))
    held = membership.select(F.col("partition"), F.col("job").alias("_held"))
    return keys.join(held, F.col("_key") == F.col("_held")).select("job", "partition").distinct()


def incomplete_leaves(nodes: DataFrame) -> DataFrame:
    """Leaves (nodes that are nobody's parent) that are not complete."""
    parents = nodes.select(F.col("parent").alias("_p")).where("_p IS NOT NULL").distinct()
    return nodes.where(~F.col("status").startswith("COMPLETE")).join(parents, F.col("id") == F.col("_p"), "left_anti")
