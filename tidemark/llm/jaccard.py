"""Jaccard join on word shingles by chosen paths, with an exact check.

1. One pass over the texts gives each document the key of its shingle set (equal sets share it) and a
   sketch of SKETCH minhashes: a minhash is a sampled token, shared by two sets with the probability of
   their similarity. Equal sets become one node with a weight.
2. Chosen paths: each of RUNS runs splits all nodes by the tokens sampled at a few positions. Buckets of
   one node end there. Buckets of up to SMALL are compared by brute force on sketches. Larger ones are
   split again at positions drawn from their path that it has not used, in expectation 1 / 0.8 of them, so
   that a pair at the threshold keeps its chance at every level. A bucket that a split leaves nearly whole
   is also compared in random blocks that share pivots, a new dealing for every path, and so are buckets
   still large after DEPTH levels. Nodes of such a bucket whose sketches agree with a pivot's are settled:
   their block links them to it, and only the others are split again. Nodes that went deeper than the runs
   suffice for, by ``miss_rate`` and the target recall, get further runs among themselves.
3. Nodes that look alike, by a bound well below the threshold, form candidate groups (connected
   components). A group of one block is compared exactly, all pairs. A larger one is dealt into blocks, by
   nodes and shingles; pairs of blocks are first compared on sketches, and the shingles are sent only of
   nodes that look like one of the other block. Only counts and stars of edges leave a unit.
4. The exact links' components are the classes.

A pair is lost only if its sketches differ by more than 4.5 standard deviations or no run and no chain of
similar sets brings it together. No bucket, group or document is capped.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_within, discard, fresh, in_batches, slices, staged
from tidemark.llm.components import components

#: Words of a shingle; the threshold as a fraction.
WORDS, NUM, DEN = 5, 4, 5
SKETCH, RUNS, DEPTH, SMALL = 64, 8, 12, 128
#: Nodes and shingles of a block.
BLOCK, BLOCK_SHINGLES = 1024, 500_000
#: Recall that the runs are repeated for.
TARGET = 0.99
#: A bucket that keeps this share of the one above may hold look-alikes, which no split separates.
ALONE = 0.75
#: Sampled tokens that two sketches must share to be compared exactly: 4.5 standard deviations under the threshold.
ALIKE = 37
#: Sampled tokens shared with a pivot from which a node counts as settled: what is similar to it is alike the pivot, too.
SURE = 48
#: Nodes whose ids may be broadcast (12 bytes each), buckets (40 bytes) and pivots (300 bytes); beyond, the joins shuffle.
BROADCAST_IDS, BROADCAST_PATHS, BROADCAST_PIVOTS = 200_000, 100_000, 10_000

_WORD = re.compile(r"\w+")
_MIX = np.random.default_rng(3).integers(1, 2**63, 2 * WORDS + SKETCH, dtype=np.uint64) | np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of WORDS words, lower-cased.

    A text of fewer words is one shingle; a text without words is its own shingle, so equal ones match.
    """
    from xxhash import xxh3_64_intdigest as hash64

    words = _WORD.findall(text.lower())
    if len(words) < WORDS:
        return np.array([hash64("\x1f".join(words) if words else "\x1e" + text.strip())], np.uint64)
    h = np.fromiter(map(hash64, words), np.uint64, len(words))
    n = len(h) - WORDS + 1
    out = np.zeros(n, np.uint64)
    for i in range(WORDS):
        out = (out ^ (h[i : i + n] * _MIX[i])) * _MIX[WORDS + i]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Minhashes of each set, one row for each."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((SKETCH, len(sets)), np.int32)
    for t in range(SKETCH):
        v = flat * _MIX[2 * WORDS + t]
        v ^= v >> np.uint64(32)
        v *= _MIX[2 * WORDS + (t + 1) % SKETCH]
        out[t] = (np.minimum.reduceat(v, starts) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return np.ascontiguousarray(out.T)


def _key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sketched(docs: DataFrame) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = [shingles(t or "") for t in batch.column("text").to_pylist()]
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, SKETCH * len(sets) + 1, SKETCH, dtype=np.int32)), pa.array(_sketches(sets).reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("digest"), pa.array([_key(s) for s in sets], pa.binary()), rows, pa.array([len(s) for s in sets], pa.int64())],
                    ["doc_id", "digest", "key", "sketch", "size"],
                )

    return in_batches(docs).mapInArrow(run, f"doc_id {id_type}, digest string, key binary, sketch array<int>, size long")


def _children(path: Column, sketch: Column, used: Column) -> Column:
    """Paths one level down and the positions used: one position drawn from the path, and with a chance of a quarter a second one."""
    draw = F.xxhash64(path, F.lit(17))
    free = F.array_except(F.sequence(F.lit(0), F.lit(SKETCH - 1)), used)
    one = F.get(free, F.pmod(draw, F.size(free)).cast("int"))
    left = F.array_except(free, F.array(one))
    two = F.get(left, F.pmod(F.shiftright(draw, 20), F.size(left)).cast("int"))
    step = lambda p: F.struct(F.xxhash64(path, p, F.get(sketch, p)).alias("path"), F.concat(used, F.array(p)).alias("used"))
    more = F.pmod(F.shiftright(draw, 40), F.lit(4)) == 0
    return F.when(more, F.array(step(one), step(two))).otherwise(F.array(step(one)))


def _whole() -> Column:
    return F.coalesce(F.col("n") >= ALONE * F.col("above"), F.lit(False))


def _unsettled(split: DataFrame) -> DataFrame:
    """Rows of large buckets that go on to the next level: all but those in nearly whole buckets that resemble a pivot.

    Those are linked to it in their block already, so their pairs among themselves lie in one candidate group.
    """
    ends = split.where(_whole() & F.col("node").isin(F.col("lo"), F.col("hi")))
    at = lambda end: F.first(F.when(F.col("node") == F.col(end), F.col("sketch")), ignorenulls=True).alias(f"_{end}")
    pivots = staged(ends.groupBy(F.col("path").alias("p")).agg(at("lo"), at("hi")), "pivots")
    shared = lambda pivot: F.size(F.filter(F.zip_with("sketch", pivot, lambda x, y: x == y), lambda same: same))
    met = split.join(broadcast_within(pivots, BROADCAST_PIVOTS), F.col("path") == F.col("p"), "left")
    return met.where(F.col("p").isNull() | (F.greatest(shared("_lo"), shared("_hi")) < SURE)).drop("p", "_lo", "_hi")


def _roots(many: int = RUNS + RUNS // 4, first: int = 0) -> list[tuple[int, int]]:
    """(run, position) of the first level: RUNS runs of one position, every fourth of them with a second one; then further runs."""
    rng = np.random.default_rng(5)
    order, extra = rng.permutation(SKETCH), rng.permutation(SKETCH)
    every = [(r, int(order[r % SKETCH])) for r in range(RUNS)] + [(r, int(extra[r % SKETCH])) for r in range(0, RUNS, 4)]
    every += [(r, int(order[r % SKETCH])) for r in range(RUNS, RUNS + SKETCH)]
    return every[first : first + many]


def _stars(ids: list[int], pairs: np.ndarray) -> list[tuple[int, int]]:
    """Links of each id to the least of those that the pairs of positions connect it with."""
    parent = list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in pairs.tolist():
        a, b = root(i), root(j)
        if a != b:
            a, b = (a, b) if ids[a] < ids[b] else (b, a)
            parent[b] = a
    return [(x, ids[r]) for i, x in enumerate(ids) if (r := root(i)) != i]


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the look-alikes within each bucket; a row is a bucket of nodes and sketches."""
    for b in batches:
        u, v = [], []
        offsets = b.column("nodes").offsets.to_numpy()
        ids = b.column("nodes").values.to_numpy()
        flat = b.column("sketches").values.values.to_numpy().reshape(-1, SKETCH)
        for i in range(b.num_rows):
            own, sk = ids[offsets[i] : offsets[i + 1]], flat[offsets[i] : offsets[i + 1]]
            same = np.zeros((len(own), len(own)), np.int16)
            for t in range(SKETCH):
                same += sk[:, t, None] == sk[None, :, t]
            for x, y in _stars(own.tolist(), np.argwhere(np.triu(same >= ALIKE, 1))):
                u.append(x)
                v.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _buckets(nodes: DataFrame, roots: list[tuple[int, int]], enough: int) -> tuple[list[DataFrame], DataFrame | None]:
    """(path, part, node, pivots) of the buckets to compare, level by level, and the nodes that are still split beyond the depth ``enough``."""
    first = F.explode(F.array(*[F.struct(F.xxhash64(F.lit(r), F.lit(p), F.get("sketch", F.lit(p))).alias("path"), F.array(F.lit(p)).alias("used")) for r, p in roots]))
    rows = nodes.select("node", first.alias("child")).select("node", "child.*", F.lit(None).cast("long").alias("above"))
    levels, deep = [], []

    def deal(found: DataFrame) -> None:
        large = F.col("n") > SMALL
        part = F.when(large, F.pmod(F.xxhash64("path", "node"), F.ceil(F.col("n") / SMALL))).otherwise(0)
        pivots = F.when(large, F.array("lo", "hi")).otherwise(F.array())
        levels.append(found.select("path", part.cast("long").alias("part"), "node", pivots.alias("pivots")))

    for depth in range(DEPTH + 1):
        # counted apart and written: few buckets are broadcast, and of many a hot one's rows can be split by the join
        counts = staged(rows.groupBy(F.col("path").alias("p")).agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("n > 1"), f"counts{depth}")
        held = staged(rows.join(broadcast_within(counts, BROADCAST_PATHS), F.col("path") == F.col("p")).select("path", "node", "used", "above", "n", "lo", "hi"), f"paths{depth}")
        discard(counts)
        discard(rows)
        large = F.col("n") > SMALL
        if depth == DEPTH:
            deal(held)
            break
        deal(held.where(~large))
        split = staged(held.where(large).join(nodes.select("node", "sketch"), "node"), f"split{depth}")
        if split.isEmpty():
            break
        deal(held.where(large & _whole()))
        left = _unsettled(split)
        if depth >= enough:
            deep.append(left.select("node"))
        children = F.explode(_children(F.col("path"), F.col("sketch"), F.col("used"))).alias("child")
        below = left.select("node", children, F.col("n").alias("above")).select("node", "child.*", "above")
        rows = staged(below, f"children{depth}")
    return levels, reduce(DataFrame.unionByName, deep).distinct() if deep else None


def _candidates(nodes: DataFrame, target: float = TARGET) -> DataFrame:
    """Edges (u, v) between nodes that look alike, from all buckets of all runs; runs are repeated until the target recall."""
    roots = _roots()
    enough = max((d for d in range(1, DEPTH + 1) if _lost(NUM / DEN, d) ** len(roots) <= 1 - target), default=0)
    levels, deep = _buckets(nodes, roots, enough)
    more = math.ceil(math.log(1 - target) / math.log(_lost(NUM / DEN, DEPTH))) - len(roots)
    if deep is not None and more > 0:
        again = staged(nodes.select("node", "sketch").join(deep, "node", "left_semi"), "deep")
        levels += _buckets(again, _roots(more, len(roots)), DEPTH + 1)[0]
    dealt = reduce(DataFrame.unionByName, levels)
    merged = dealt.groupBy("path", "part").agg(F.sort_array(F.array_distinct(F.concat(F.collect_set("node"), F.first("pivots")))).alias("members"))
    # the same few nodes meet in most runs: each list is compared once
    merged = merged.where(F.size("members") > 1).groupBy(F.xxhash64("members").alias("bucket"), "members").agg(F.count("*").alias("runs"))
    spread = merged.select("bucket", F.explode("members").alias("node")).join(nodes.select("node", "sketch"), "node")
    grouped = spread.groupBy("bucket").agg(F.collect_list(F.struct("node", "sketch")).alias("rows"))
    buckets = grouped.select(F.transform("rows", lambda r: r["node"]).alias("nodes"), F.transform("rows", lambda r: r["sketch"]).alias("sketches"))
    return in_batches(buckets).mapInArrow(_alike, "u long, v long").distinct()


def _in_units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """Units of work, each as one table, from rows that arrive sorted by unit (comp, x, y)."""
    unit, held = None, []
    for b in batches:
        keys = np.stack([b.column(c).to_numpy() for c in ("comp", "x", "y")])
        edges = [0, *(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1).tolist(), b.num_rows]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            if i < j:
                own = tuple(int(k) for k in keys[:, i])
                if own != unit:
                    if held:
                        yield unit, pa.Table.from_batches(held).combine_chunks()
                    unit, held = own, []
                held.append(b.slice(i, j - i))
    if held:
        yield unit, pa.Table.from_batches(held).combine_chunks()


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each unit of two blocks, or of one with itself, whose sketch looks like one of the other side."""
    for (_, x, y), rows in _in_units(batches):
        sk = np.asarray(rows.column("sketch").combine_chunks().flatten()).reshape(-1, SKETCH)
        side = rows.column("side").to_numpy()
        left, right = (np.arange(len(sk)),) * 2 if x == y else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        hit = np.zeros(len(sk), bool)
        for i in range(0, len(left), 128):
            part = left[i : i + 128]
            same = np.zeros((len(part), len(right)), np.int16)
            for t in range(SKETCH):
                same += sk[part, t, None] == sk[None, right, t]
            alike = same >= ALIKE
            if x == y:
                alike[np.arange(len(part)), part] = False
            hit[part] |= alike.any(axis=1)
            hit[right] |= alike.any(axis=0)
        yield from rows.drop(["sketch"]).filter(pa.array(hit)).to_batches()


def _units(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(comp, x, y, side, node, key, weight) of each unit's nodes: whole groups of one block, and what looks alike in pairs of blocks of the others."""
    unit = ["comp", "x", "y", "side", "node", "key", "weight"]
    zero = F.lit(0)
    single = members.where("blocks = 1").select("comp", zero.alias("x"), zero.alias("y"), zero.alias("side"), "node", "key", "weight")
    large = members.where("blocks > 1")
    if large.isEmpty():
        return single
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    spread = large.join(nodes.select("node", "sketch"), "node").withColumn("own", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = spread.select("comp", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "key", "weight", "sketch")
    dealt = in_batches(pairs.repartition("comp", "x", "y").sortWithinPartitions("comp", "x", "y"))
    met = dealt.mapInArrow(_met, pairs.drop("sketch").schema)
    return single.unionByName(staged(met, "met")).select(*unit)


def _compare(left: list[tuple], right: list[tuple] | None) -> Iterator[tuple[int, int, int]]:
    """Exact links of two blocks, or within one: (node, -1, linked weight) and stars of edges (u, v, 0).

    Shared shingles are counted by products of incidence matrices, a bounded number of columns at a time.
    """
    rows = left + (right or [])
    sizes = np.array([len(r[2]) for r in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    _, inverse, counts = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True, return_counts=True)
    shared = counts > 1
    column = np.cumsum(shared) - 1
    keep = shared[inverse]
    owner, column = owner[keep], column[inverse[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    n, m = len(rows), len(left)
    common = np.zeros((n, n) if right is None else (m, n - m), np.float64)
    width = 4096
    total = int(shared.sum())
    edges = np.searchsorted(column, np.arange(0, total + width, width))
    for k in range(len(edges) - 1):
        a, b = edges[k], edges[k + 1]
        if a < b:
            grid = np.zeros((n, min(width, total - k * width)), np.float32)
            grid[owner[a:b], column[a:b] - k * width] = 1
            common += grid @ grid.T if right is None else grid[:m] @ grid[m:].T
    a, b = (sizes, sizes) if right is None else (sizes[:m], sizes[m:])
    linked = (NUM + DEN) * common >= NUM * (a[:, None] + b[None, :])
    weights = np.array([r[1] for r in rows], np.float64)
    if right is None:
        np.fill_diagonal(linked, False)
        gained = linked @ weights
        pairs = np.argwhere(np.triu(linked, 1))
    else:
        gained = np.concatenate([linked @ weights[m:], linked.T @ weights[:m]])
        pairs = np.argwhere(linked) + [0, m]
    for i in np.flatnonzero(gained):
        yield rows[i][0], -1, int(gained[i])
    for u, v in _stars([r[0] for r in rows], pairs):
        yield u, v, 0


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact links of each unit of work: rows arrive sorted by unit, with their side (0 or 1) of it."""
    for unit, table in _in_units(batches):
        columns = [table.column(c).to_pylist() for c in ("node", "weight", "side", "shingles")]
        rows = [(n, w, np.frombuffer(raw, np.uint64), s) for n, w, s, raw in zip(*columns, strict=True)]
        left, right = [r for r in rows if not r[3]], [r for r in rows if r[3]]
        found = []
        if unit[1] == unit[2]:
            found = list(_compare(rows, None)) if len(rows) > 1 else []
        elif left and right:
            found = list(_compare(left, right))
        cols = list(zip(*found, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["u", "v", "links"])


def _with_shingles(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = [shingles(t or "") for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "shingles"])

    return in_batches(docs).mapInArrow(run, "key binary, shingles binary")


def _digest(text_col: str) -> Column:
    return F.md5(F.coalesce(F.col(text_col), F.lit("")))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``class_id`` and ``n_links``.

    ``class_id`` is the least id of the class; ``n_links`` counts the other rows whose shingle sets have a
    Jaccard similarity of at least 0.8, copies included. Null texts are empty ones. Rows with a null id
    take part like others; a class of such rows alone has a null class. An empty table gives no rows.
    """
    return _classified(docs, id_col, text_col).select("doc_id", "class_id", "n_links")


def _classified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``similar_documents`` with the text's ``digest`` and the class's ``label``, which is never null."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = staged(_sketched(docs.withColumn("digest", _digest("text"))), "sketches")
    found = rows.groupBy("key").agg(F.first("sketch").alias("sketch"), F.first("size").alias("size"), F.count("*").alias("weight"), F.min("doc_id").alias("least"))
    nodes = staged(found.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbers are fixed by the writing
    groups = components(_candidates(nodes))
    members = groups.withColumnRenamed("label", "comp").join(nodes.select("node", "key", "weight", "least", "size"), "node")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int")
    sizes = members.groupBy(F.col("comp").alias("c")).agg(blocks.alias("blocks"))
    members = staged(members.join(sizes, F.col("comp") == F.col("c")).drop("c", "size"), "members")

    ids = broadcast_within(members.select(F.col("least").alias("_id")), BROADCAST_IDS)
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    sets = _with_shingles(texts.select("doc_id", "text")).dropDuplicates(["key"])
    units = _units(members, nodes).join(sets, "key")
    dealt = in_batches(units.repartition("comp", "x", "y").sortWithinPartitions("comp", "x", "y"))
    links = staged(dealt.mapInArrow(_verify, "u long, v long, links long"), "links")

    counted = links.where("v < 0").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    labels = components(links.where("v >= 0").select("u", "v"))
    linked = nodes.select("key", "node", "weight", "least").join(labels, "node", "left").join(counted, "node", "left")
    linked = linked.select("key", F.coalesce("label", "node").alias("label"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "least")
    least = linked.groupBy(F.col("label").alias("c")).agg(F.min("least").alias("class_id"))
    classes = linked.join(least, F.col("label") == F.col("c")).select("key", "label", "class_id", "n_links")
    return rows.select("doc_id", "digest", "key").join(classes, "key").select("doc_id", "digest", "label", "class_id", F.col("n_links").cast("long").alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one row of each class: of the least id and, where ids repeat, the least digest of the text.

    Rows are told apart by id and digest, so null and repeated ids remove only rows of their own class. Null
    texts are empty ones. All columns stay, whatever their names; an empty table gives no rows.
    """
    found = staged(_classified(docs, id_col, text_col).select("doc_id", "digest", "label"), "classes")
    pairs = found.groupBy("label", "doc_id", "digest").agg(F.count("*").alias("n"))
    first = found.groupBy(F.col("label").alias("c")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("first"))
    marked = pairs.join(first, F.col("label") == F.col("c")).withColumn("kept", F.col("digest").eqNullSafe(F.col("first.digest")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id")))
    own_id, own_digest = fresh(docs, "_id"), fresh(docs, "_digest")
    # rows to take out: all of a pair that isn't kept, and of one that repeats, whose rows are then put back once
    out = staged(marked.where("NOT kept OR n > 1").select(F.col("doc_id").alias(own_id), F.col("digest").alias(own_digest), "kept"), "gone")
    back = out.where("kept").drop("kept")
    many = not back.isEmpty()
    if out.count() <= BROADCAST_IDS:
        gone, back = F.broadcast(out.drop("kept")), F.broadcast(back)
    else:
        gone = out.drop("kept")
    same = F.col(id_col).eqNullSafe(F.col(own_id)) & (_digest(text_col) == F.col(own_digest))
    kept = docs.join(gone, same, "left_anti")
    if not many:
        return kept
    repeated = docs.join(back, same, "left_semi").withColumn(own_digest, _digest(text_col))
    return kept.unionByName(repeated.dropDuplicates([id_col, own_digest]).drop(own_digest))


def _lost(similarity: float, depth: int) -> float:
    """Chance that one root does not bring a pair of this similarity into a common bucket of the given depth."""
    lost = 1 - similarity
    for _ in range(depth - 1):  # a child is lost unless its own position, or the second one where drawn, is shared
        lost = 1 - similarity * (1 - (lost * (0.75 + 0.25 * lost)))
    return lost


def miss_rate(similarity: float, depth: int = 1) -> float:
    """Chance that no run of the first batch brings a pair of this similarity into a common bucket of the given depth."""
    return float(_lost(similarity, depth) ** len(_roots()))
