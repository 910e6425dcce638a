"""Sources and sinks: tables with required columns, JSON configuration, page snapshots, detail pages, backups."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_required(spark: SparkSession, path: str, required: list[str], kind: str = "parquet") -> DataFrame:
    """A table that must have some columns; the error lists those that are missing."""
    df = spark.read.format(kind).load(path)
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return df


def read_config(spark: SparkSession, path: str, required: list[str] = ()) -> dict:
    """One JSON object, read through Spark so that any store it knows will do."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    found = json.loads(text)
    missing = sorted(set(required) - set(found))
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return found


def cards_from_json(pages: DataFrame, json_col: str, page_col: str, page_size: int) -> DataFrame:
    """Cards of pages whose JSON array lists them, with position and rank; a page without cards or a card
    without id, URL or title is an error when the row is read."""
    kind = "array<struct<id:string,url:string,title:string,employer:string,location:string,salary:string,teaser:string,posted:string>>"
    cards = F.from_json(F.col(json_col), kind)
    rows = pages.select(page_col, F.posexplode(F.when(F.size(cards) > 0, cards).otherwise(F.raise_error(F.lit("a page without cards")).cast(kind))).alias("pos", "card"))
    bad = (F.coalesce("card.id", F.lit("")) == "") | (F.coalesce("card.url", F.lit("")) == "") | (F.coalesce("card.title", F.lit("")) == "")
    card = F.when(bad, F.raise_error(F.lit("a card without id, URL or title")).cast(cards_type())).otherwise(F.col("card"))
    return rows.select(page_col, "pos", (F.col(page_col) * page_size + F.col("pos") + 1).alias("rank"), card.alias("card")).select(page_col, "pos", "rank", "card.*")


def cards_type() -> str:
    return "struct<id:string,url:string,title:string,employer:string,location:string,salary:string,teaser:string,posted:string>"


def first_by_id(pages: list[DataFrame], id_col: str) -> DataFrame:
    """The union of reads of one page by id, the first read winning."""
    from pyspark.sql import Window as W

    every = reduce(lambda a, b: a.unionByName(b), [p.withColumn("_read", F.lit(i)) for i, p in enumerate(pages)])
    return every.withColumn("_k", F.row_number().over(W.partitionBy(id_col).orderBy("_read"))).where("_k = 1").drop("_k", "_read")


def end_of_stream(pages: DataFrame, size: int, probes: int = 3, cap: int = 1000) -> DataFrame:
    """Whether a listing (offset, rows) has ended: a short page followed only by empty probes; past the cap it is incomplete."""
    from pyspark.sql import Window as W

    ahead = W.partitionBy("listing").orderBy("offset").rowsBetween(1, probes)
    df = pages.withColumn("_next", F.sum("rows").over(ahead)).withColumn("_probed", F.count("*").over(ahead))
    done = (F.col("rows") < size) & (F.col("_probed") >= probes) & (F.coalesce("_next", F.lit(0)) == 0)
    return df.groupBy("listing").agg(F.when(F.max("offset") >= cap, "INCOMPLETE_CAP").when(F.bool_or(done), "COMPLETE").otherwise("OPEN").alias("status"))


def html_facts(html: Column) -> Column:
    """Title, first heading, language and number of links of a stored page."""
    pick = lambda p: F.nullif(F.trim(F.regexp_extract(html, p, 1)), F.lit(""))
    return F.struct(
        pick(r"(?is)<title[^>]*>(.*?)</title>").alias("title"),
        pick(r"(?is)<h1[^>]*>(.*?)</h1>").alias("heading"),
        pick(r'(?i)<html[^>]*\blang="([^"]*)"').alias("lang"),
        F.size(F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*href="), F.lit(0))).alias("links"),
    )


def evidence_row(df: DataFrame, columns: list[str]) -> DataFrame:
    """Raw evidence as one JSON text, for an append-only table."""
    return df.select(F.to_json(F.struct(*columns)).alias("raw_json"))


def append(df: DataFrame, path: str, date_col: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(date_col) if date_col else writer).parquet(path)


def manifest(df: DataFrame, key: str) -> DataFrame:
    """Row count and an order-free digest of a table, in one pass."""
    row = F.xxhash64(*[F.col(c).cast("string") for c in sorted(df.columns)])
    return df.agg(F.count("*").alias("rows"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("digest"), F.min(key).alias("least"), F.max(key).alias("greatest"))


def backup(df: DataFrame, root: str, version: int, key: str, keep: int = 3) -> list[str]:
    """Write a snapshot to its own folder, read it again, hold it against the source, and name the versions to drop."""
    path = f"{root}/v{version:06d}"
    df.write.mode("errorifexists").parquet(path)
    spark = df.sparkSession
    if manifest(df, key).first() != manifest(spark.read.parquet(path), key).first():
        raise ValueError(f"{path} differs from its source")
    return [f"{root}/v{v:06d}" for v in range(max(1, version - keep - 2), version - keep + 1)]


#: Adapters by source name: functions from raw rows to observations. New sources register here.
ADAPTERS: dict = {}


def adapter(name: str):
    """Register an adapter for a source."""

    def add(f):
        ADAPTERS[name] = f
        return f

    return add


@adapter("listing")
def listing_rows(rows: DataFrame) -> DataFrame:
    """Observations from a listing's rows: not-a-number becomes null, dates become texts, positions become pages."""
    from tidemark.functions.text import clean, geography, native_id

    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    return rows.select(
        F.lit("listing").alias("source"),
        native_id(F.col("id")).alias("source_job_id"),
        F.col("job_url").alias("canonical_url"),
        clean(F.col("title")).alias("title"),
        clean(F.col("company")).alias("employer"),
        clean(F.col("location")).alias("location"),
        geography(F.col("location"), F.lit(None).cast("string")).alias("geography_code"),
        number("min_amount").alias("min_amount"),
        number("max_amount").alias("max_amount"),
        F.date_format("date_posted", "yyyy-MM-dd").alias("posted_at"),
        (F.floor(F.col("position") / 10) + 1).cast("int").alias("page_number"),
        (F.col("position") + 1).cast("int").alias("rank"),
    )
