"""Best-fit packing of token sequences in bulk-synchronous rounds.

Rounds go through the pieces by length, longest first (``BANDS``). In each, the pieces of the round and the
gaps that earlier rounds left are range-sorted by size, and the sorted list is dealt out like cards: the
row of rank r goes to share r modulo the number of shares. So every share is a like sample of all sizes,
and no two shares want the same gap: rank settles the conflict. Each task then sweeps its share: a piece
takes its successor among the gaps, the least that is large enough, the gap shrinks and goes back to its
place in the order, and a piece without a successor opens a sequence. What is left of all gaps is written
and, range-sorted again, dealt out anew in the next round, so that a gap meets pieces of other shares.

A share has about ``SHARE`` rows, whatever the corpus; within one, the outcome is that of best fit
decreasing. Equal sizes are swept as one run. Tokens are carried only where they are asked for, and then
joined to their places at the end.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, in_batches, slices, staged

CAPACITY = 4096
#: Id that ends each document.
END_ID = 1
#: Rounds: pieces of over a half, a quarter, an eighth of the capacity, and the rest. Rows that one task sweeps at a time.
BANDS, SHARE = (2, 4, 8), 4096
#: Bytes of words and ids that a worker remembers, and what an entry costs besides its text.
CACHE_BYTES, ENTRY_BYTES = 64 << 20, 200
#: Characters over which a part is never remembered.
LONG = 200


_LATIN = re.compile("([a-zA-Z\u00df-\u00f6\u00f8-\u00ff\u00c0-\u00d6\u00d8-\u00de]*)([!-&(-/:-@\\[-`{-~]*)")


class WordIds(dict):
    """Ids of a text from those of its space-separated parts, each encoded once and remembered.

    The tokenizer drops white space and never joins across it, so the parts' ids in a row are the text's.
    Only spaces and line feeds split here; other white space stays inside a part. A part of Latin-1
    letters, then ASCII punctuation, is two words to the tokenizer, lower-cased: its model takes them
    without the normalizer. Everything else, names of special tokens included, goes through the whole
    tokenizer. A part is remembered when it is met again; what is remembered is bounded by bytes, whatever
    a text holds.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.held, self.met = 0, bytearray(1 << 22)

    def _keep(self, part: str, ids: bytes) -> bytes:
        mark = hash(part) & 0x3FFFFF
        if not self.met[mark]:
            self.met[mark] = 1
        elif len(part) <= LONG:
            self.held += 2 * len(part) + len(ids) + ENTRY_BYTES
            if self.held > CACHE_BYTES:
                self.clear()
                self.held, self.met = 0, bytearray(1 << 22)
            self[part] = ids
        return ids

    def _word(self, word: str) -> bytes:
        found = self.get(word)
        if found is None:
            units = word if word.isascii() else self.level.pre_tokenize_str(word)[0][0]
            found = self._keep(word, np.array([t.id for t in self.tokenizer.model.tokenize(units)], dtype="<u4").tobytes())
        return found

    def __missing__(self, part: str) -> bytes:
        if not part:
            return b""
        if m := _LATIN.fullmatch(part):
            word, marks = m[1].lower(), m[2]
            if not marks or not word:
                found = self._word(word or marks)
            else:
                found = self._word(word) + self._word(marks)
        else:
            found = np.asarray(self.tokenizer.encode(part, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self._keep(part, found)

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        for t in texts:
            yield b"".join(map(self.__getitem__, t.replace("\n", " ").split(" ")))


_ENCODERS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's encoder for a tokenizer file; it outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents' ids, each followed by END_ID, cut where they exceed the capacity.

    Null and empty texts are a piece of one id. ``with_ids`` adds them as little-endian 32-bit numbers.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    end = np.asarray([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encode = word_ids(tokenizer).encode
        for whole in batches:
            for batch in slices(whole, "text"):
                at, piece, start, length, crc, raw = [], [], [], [], [], []
                for i, ids in enumerate(encode(t or "" for t in batch.column("text").to_pylist())):
                    ids += end
                    for k in range(0, len(ids), 4 * capacity):
                        part = ids[k : k + 4 * capacity]
                        at.append(i)
                        piece.append(k // (4 * capacity))
                        start.append(k // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            raw.append(part)
                columns = [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array(raw, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return in_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, schema)


def sweep(counts: dict[int, int], capacity: int = CAPACITY, gaps: dict[int, int] | None = None) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Best fit decreasing of pieces, ``counts`` of each length, into ``gaps`` of each size and sequences that it opens.

    Returns rows (length, first rank, ranks, pieces a sequence, first sequence, offset) by length and rank, and
    what is left as runs (gap, first sequence, sequences). Piece ``k`` of a row's ranks goes to sequence
    ``first + k // pieces``, at ``offset + k % pieces * length``. The given gaps are sequences 0, 1, 2 and so
    on, the greatest first; those opened have the numbers after them.
    """
    sizes: list[int] = sorted(g for g in gaps or {} if g)  # of the gaps, ascending
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: (first sequence, sequences)
    rows: list[tuple[int, int, int, int, int, int]] = []
    opened = 0
    for g in sorted(gaps or {}, reverse=True):
        if g:
            runs[g].append((opened, gaps[g]))
        opened += gaps[g]

    def leave(gap: int, first: int, many: int) -> None:
        if gap and many:
            if not runs[gap]:
                insort(sizes, gap)
            runs[gap].append((first, many))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} ids does not fit {capacity}")
        while left:
            i = bisect_left(sizes, length)
            if i == len(sizes):
                gap, first, many = capacity, opened, -(-left // (capacity // length))
                opened += many
            else:
                gap = sizes[i]
                first, many = runs[gap].pop()
                if not runs[gap]:
                    sizes.pop(i)
            each = gap // length
            taken = min(left, many * each)
            full, rest = divmod(taken, each)
            rows.append((length, rank, taken, each, first, capacity - gap))
            leave(gap - each * length, first, full)
            if rest:
                leave(gap - rest * length, first + full, 1)
            leave(gap, first + full + (rest > 0), many - full - (rest > 0))
            rank, left = rank + taken, left - taken
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6), [(g, *run) for g in sizes for run in runs[g]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """The rows of a sweep without gaps to start from."""
    return sweep(counts, capacity)[0]


#: What a row holds while it is dealt out: a piece without, or a gap with, a sequence.
_ITEM = ("size", "sequence_id", "offset", "_row", "doc_id", "piece", "start", "ids_crc32")


def _swept(share: pa.Table, base: int, capacity: int) -> pa.Table:
    """A share's pieces with their places, and its gaps as they are after the sweep; ``base`` numbers the sequences that it opens."""
    size = share.column("size").to_numpy()
    is_gap = share.column("_row").is_null().to_numpy(zero_copy_only=False)
    order = np.lexsort((-size, is_gap))  # pieces first, each kind by size, greatest first
    share, size, n = share.take(pa.array(order)), size[order], int((~is_gap).sum())
    held = share.column("sequence_id").slice(n).to_numpy()
    count = lambda x: dict(zip(*(v.tolist() for v in np.unique(x, return_counts=True)), strict=True))
    table, left = sweep(count(size[:n]), capacity, count(size[n:]))

    def named(local: np.ndarray) -> np.ndarray:
        out = base + local - len(held)
        out[local < len(held)] = held[local[local < len(held)]]
        return out

    out = share.slice(0, n)
    if n:
        lengths = size[:n]
        rank = np.arange(n) - np.searchsorted(-lengths, -lengths, side="left")
        stride = n + 1
        row = table[np.searchsorted(table[:, 0] * stride + table[:, 1], lengths * stride + rank, side="right") - 1]
        k = rank - row[:, 1]
        out = out.set_column(1, "sequence_id", pa.array(named(row[:, 4] + k // row[:, 3])))
        out = out.set_column(2, "offset", pa.array(row[:, 5] + k % row[:, 3] * lengths))
    gap = np.repeat([g for g, _, _ in left], [m for _, _, m in left]).astype(np.int64)
    local = np.concatenate([np.arange(f, f + m) for _, f, m in left]) if left else np.zeros(0, np.int64)
    none = [pa.nulls(len(gap), share.schema.field(c).type) for c in _ITEM[3:]]
    rest = pa.table([pa.array(gap), pa.array(named(local)), pa.array(capacity - gap), *none], names=list(_ITEM))
    return pa.concat_tables([out.cast(rest.schema), rest])


def _round(items: DataFrame, shares: int, number: int, capacity: int) -> DataFrame:
    """One round: range-sort pieces and gaps by size, deal them out by rank, and sweep each share."""
    by = [F.col("size").desc(), F.col("sequence_id"), F.col("_row")]
    ranged = items.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    rank = F.col("_at").bitwiseAND((1 << 33) - 1) + 7919 * F.shiftright("_at", 33)  # ranges start at different shares
    dealt = ranged.withColumn("_share", F.pmod(rank, F.lit(shares))).drop("_at").repartition("_share").sortWithinPartitions("_share")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                share = pa.Table.from_batches(held).combine_chunks()
                base = (number << 58) + (share.column("_share")[0].as_py() << 32)
                yield from _swept(share.drop(["_share"]), base, capacity).to_batches()
                held.clear()

        for b in batches:
            marks = b.column("_share").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(marks)]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if i < j:
                    if held and held[0].column("_share")[0].as_py() != marks[i]:
                        yield from out()
                    held.append(b.slice(i, j - i))
        yield from out()

    return dealt.mapInArrow(run, items.schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their sequence and offset.

    Texts of any length are tokenised once; the pieces (without texts) are kept in the shared folder, and
    so is every round. Repeated rows and ties are packed each for itself, null ids included; an empty table
    gives no rows; columns other than id and text are not read, whatever their names.
    """
    numbered = pieces(docs, tokenizer, capacity, with_ids, id_col, text_col).withColumn("_row", F.monotonically_increasing_id())
    cut = staged(numbered, "pieces")
    band = F.lit(len(BANDS))
    for i, part in reversed(list(enumerate(BANDS))):
        band = F.when(F.col("length") > capacity // part, i).otherwise(band)
    items = cut.withColumnsRenamed({"length": "size"}).withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")}).select(*_ITEM)
    sized = cut.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.min("length").alias("least")).orderBy("band").collect()  # a row for each band
    done, gaps = [], None
    for i, r in enumerate(sized):
        own, n = items.where(band_of(r["band"], capacity)), r["n"]
        if gaps is not None:
            own, n = own.unionByName(gaps), n + gaps.count()
        swept = staged(_round(own, -(-n // SHARE), i, capacity), f"round{i}")
        done.append(swept.where("_row IS NOT NULL"))
        gaps = swept.where(F.col("_row").isNull() & (F.col("size") >= min(x["least"] for x in sized[i:])))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if not done:
        return cut.select(*kept, *["ids"] * with_ids, F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    placed = reduce(DataFrame.unionByName, done).withColumnRenamed("size", "length")
    if not with_ids:
        discard(cut)
        return placed.select(*kept, "sequence_id", "offset")
    return placed.join(cut.select("_row", "ids"), "_row").select(*kept, "ids", "sequence_id", "offset")


def band_of(band: int, capacity: int = CAPACITY):
    """Whether a size belongs to a round."""
    edges = [capacity, *(capacity // p for p in BANDS), 0]
    return (F.col("size") > edges[band + 1]) & (F.col("size") <= edges[band])


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces with ids: ``sequence_id``, ``ids`` and the documents in order."""
    part = F.struct("offset", "ids", "doc_id", "piece")
    df = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))  # a sequence holds ``capacity`` pieces at most
    joined = F.aggregate(F.col("parts"), F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"]))
    return df.select("sequence_id", joined.alias("ids"), F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"))
