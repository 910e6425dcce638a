"""What several operators share: staged tables, reading batches in bounded slices, gapless numbers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Characters of text that Python code holds as objects at once.
SLICE_CHARS = 4_000_000
#: Bytes of an Arrow batch on its way to Python, unless the session sets a bound of its own; a longer row is a batch of its own.
BATCH_BYTES, BATCH_CONF = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
DEFAULT_BATCH_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Only a local session does without, in a folder of its machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.conf.get("spark.master", "").split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    import tempfile

    return f"file://{tempfile.gettempdir()}/checkpoints"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write a table into the shared folder and read it again: lineage is cut, a lost executor costs a read.

    The table goes when the application ends, or earlier by ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{uuid.uuid4().hex}/{tag}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = folder
    return out


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    folder = getattr(df, "_staged_at", None)
    if folder is not None:
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def broadcast_within(df: DataFrame, rows: int) -> DataFrame:
    """The staged table, to be broadcast if it has no more rows than the bound; beyond, the join shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


def in_batches(df: DataFrame) -> DataFrame:
    """The same table, whose batches for Python hold BATCH_BYTES at most (or what the session says, if not the default)."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF, str(DEFAULT_BATCH_BYTES)) in (str(DEFAULT_BATCH_BYTES), "64MB", f"{DEFAULT_BATCH_BYTES}b"):
        conf.set(BATCH_CONF, str(BATCH_BYTES))
    return df


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose column holds about ``limit`` bytes each; one long row is a part of its own."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield batch.slice(start)


def number(df: DataFrame, part_col: str, out: str, order: list[str]) -> DataFrame:
    """Add ``out``, the row's place from 0 within its value of ``part_col``, in the order of other columns (nulls first).

    Rows are range-partitioned by all of them and, last, by a number of their own, so that neither a hot part
    nor a row that repeats lands in one task. A row's place is that in its range plus what earlier ranges hold
    of its part: one count for each part and range that meet, at most as many as there are parts and ranges.
    """
    keys = [part_col, *order]
    rows = staged(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    by = [*keys, "_row"]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    ranged = staged(ranged.drop("_row"), "ranged")  # the upper bits of _at number the range, the others the row in it
    discard(rows)
    counts = ranged.groupBy(F.col(part_col).alias("_part"), F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = W.partitionBy("_part").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("_part", "_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    met = F.col(part_col).eqNullSafe(F.col("_part")) & (F.shiftright("_at", 33) == F.col("_range"))
    joined = ranged.join(F.broadcast(counts), met)  # parts plus ranges rows: their bound
    return joined.withColumn(out, (F.col("_base") + F.col("_at") - F.col("_first")).cast("long")).select(*df.columns, out)


def train_side(id_col: str = "doc_id"):
    """Rows that labels may be learnt from: the CRC of the id as text is no multiple of five."""
    return F.crc32(F.col(id_col).cast("string")) % 5 != 0
