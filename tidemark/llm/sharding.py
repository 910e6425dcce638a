"""Hierarchical weighted hash tree: region, rack and shard are drawn one after the other.

At each level every child draws ``-ln(u) / weight`` with ``u`` hashed from the document's id and the
child's path; the least draw wins. A child's chance is its share of the weight, and a change of one
child's weight moves rows only between that child and its siblings: all other draws stay as they were.

Everything is a column expression: there is no Python on the executors, and the only shuffle is the one
by ranges that numbers the rows of a shard, which carries ids and sizes, never texts.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import number


@dataclass(frozen=True)
class Leaf:
    """One shard and its place in the tree."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def topology(shards: int, racks: int = 2, per_rack: int = 4, base: int = 24) -> list[Leaf]:
    """A tree of ``shards`` equal shards: up to ``base`` in full regions, each one beyond in a region of its own.

    A further shard thus changes the weight of one new region alone, so it can only draw rows to itself.
    """
    leaves = []
    for s in range(shards):
        if s < base:
            region, rack = s // (racks * per_rack), s // per_rack % racks
            leaves.append(Leaf(f"r{region}", f"r{region}/k{rack}", s))
        else:
            leaves.append(Leaf(f"x{s}", f"x{s}/k0", s))
    return leaves


def _draw(key: Column, node: str, weight: float) -> Column:
    """An exponential draw with rate ``weight``, from 52 bits of a hash of key and node."""
    digest = F.md5(F.concat(key, F.lit(f"|{node}")))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(2**52))) / F.lit(float(weight))


def _least(key: Column, nodes: dict[str, float]) -> Column:
    """The path of the child with the least draw."""
    if len(nodes) == 1:
        return F.lit(next(iter(nodes)))
    draws = [F.struct(_draw(key, n, w).alias("d"), F.lit(n).alias("n")) for n, w in nodes.items()]
    return F.least(*draws)["n"]


def _sum(leaves: Iterable[Leaf], of) -> dict[str, float]:
    out: dict[str, float] = {}
    for x in leaves:
        out[of(x)] = out.get(of(x), 0.0) + x.weight
    return out


def assign(df: DataFrame, leaves: list[Leaf], key_col: str, out: str) -> DataFrame:
    """Add ``out``, the shard of each row. A null key counts as the text ``null``; equal keys share a shard.

    Leaves of weight 0 or less get nothing; a tree without any other leaf is an error.
    """
    leaves = [x for x in leaves if x.weight > 0]
    if not leaves:
        raise ValueError("a tree needs a shard of positive weight")
    key = F.coalesce(F.col(key_col).cast("string"), F.lit("null"))
    region, rack = f"_{out}_region", f"_{out}_rack"
    df = df.withColumn(region, _least(key, _sum(leaves, lambda x: x.region)))
    racks = F.lit(None).cast("string")
    for r in dict.fromkeys(x.region for x in leaves):
        racks = F.when(F.col(region) == r, _least(key, _sum((x for x in leaves if x.region == r), lambda x: x.rack))).otherwise(racks)
    df = df.withColumn(rack, racks)
    shards = F.lit(None).cast("string")
    for k in dict.fromkeys(x.rack for x in leaves):
        own = {f"{k}/s{x.shard}": x.weight for x in leaves if x.rack == k}
        shards = F.when(F.col(rack) == k, _least(key, own)).otherwise(shards)
    return df.withColumn(out, F.substring_index(shards, "/s", -1).cast("int")).drop(region, rack)


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard, slot and the shard after growth by one, for each document.

    Slots follow id, checksum and size within a shard. Null text: no bytes, size 8. Null ids share one shard
    and come first in it. Repeated rows share a shard and get slots of their own. An empty table gives no
    rows. Other columns of the input are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    df = assign(df, topology(shards), "doc_id", "shard")
    df = assign(df, topology(shards + 1), "doc_id", "grown_shard")
    df = number(df, "shard", "slot", ["doc_id", "text_crc32", "size"])
    return df.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
