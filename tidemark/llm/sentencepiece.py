"""SentencePiece encoding and decoding by a forward pass over the trie of a batch's distinct words.

A text is marked (spaces become the mark, one is put in front) and cut into marked words, which no piece
crosses. The distinct words that are new are sorted, which lines them up as the depth-first traversal of
their trie: a word keeps the forward states of the prefix that it shares with the one before.

For a unigram model the forward state of a prefix is its best score and the last piece on that path
(Viterbi). The public model at hand is a BPE model, whose right segmentation is not the best-scoring one,
so there the state is the last piece of the prefix's only segmentation in which all neighbours stay apart
under the merge rules; that is exactly the library's. Either way states depend on the prefix alone.

Everything happens within a batch: no shuffle, and what a worker remembers is bounded.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_batches, slices

MARK = "▁"
#: Bytes of words and their ids, and pairs of pieces, that a worker remembers; what a word costs besides.
CACHE_BYTES, ENTRY_BYTES, CACHE_PAIRS = 128 << 20, 200, 500_000
#: Score of a character that is no piece.
UNKNOWN = -1e6
_WORDS = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")


class Codec:
    """Encoder and decoder for a model file; the identity normalizer and byte fallback are required."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(lib.serialized_model_proto())
        rules = proto.normalizer_spec
        if rules.name != "identity" or rules.remove_extra_whitespaces or not proto.trainer_spec.byte_fallback:
            raise ValueError("a model with the identity normalizer and byte fallback is needed")
        self.bpe = proto.trainer_spec.model_type == 2
        self.prefix = MARK if rules.add_dummy_prefix else ""
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.id_bytes = {p.piece: i.to_bytes(4, "little") for i, p in enumerate(proto.pieces) if p.type == 1}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.scores):
            raise ValueError("pieces cross words")
        byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.byte_ids = [byte_id[b].to_bytes(4, "little") for b in range(256)]
        self.ends = {p[i:] for p in self.scores for i in range(len(p))}
        self.raw = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.encode() if p.type == 1 else b"" for p in proto.pieces]
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.apart: dict[tuple[str, str], bool] = {}

    def _merged(self, word: str) -> list[str]:
        """The merge rules by the book: join the neighbours whose piece scores highest, leftmost first."""
        parts = list(word)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stay(self, a: str, b: str) -> bool:
        key = (a, b)
        found = self.apart.get(key)
        if found is None:
            if len(self.apart) > CACHE_PAIRS:
                self.apart.clear()
            found = self.apart[key] = self._merged(a + b) == [a, b]
        return found

    def _segment(self, words: list[str]) -> Iterator[list[str]]:
        """Segmentations of sorted words; ``last[i]`` is the last piece of the first ``i`` characters, ``total`` its score."""
        scores, ends, bpe, apart = self.scores, self.ends, self.bpe, self.apart
        last, total, before = [""], [0.0], ""
        for word in words:
            same, most = 0, min(len(before), len(word))
            while same < most and before[same] == word[same]:
                same += 1
            del last[same + 1 :], total[same + 1 :]
            for i in range(same + 1, len(word) + 1):
                fits = [word[i - 1]]
                for k in range(i - 2, -1, -1):
                    part = word[k:i]
                    if part not in ends:
                        break
                    if part in scores:
                        fits.append(part)
                if bpe:
                    for piece in reversed(fits):
                        left = last[i - len(piece)]
                        if not left or apart.get((left, piece)) or self._stay(left, piece):
                            break
                    last.append(piece)
                else:
                    best, piece = max((total[i - len(p)] + scores.get(p, UNKNOWN), p) for p in fits)
                    last.append(piece)
                    total.append(best)
            out, i = [], len(word)
            while i:
                out.append(last[i])
                i -= len(last[i])
            out.reverse()
            yield out
            before = word

    def _learn(self, words: Iterable[str]) -> None:
        fresh = sorted(set(words).difference(self.known))
        ids = self.id_bytes
        self.held += sum(5 * len(w) for w in fresh) + ENTRY_BYTES * len(fresh)
        for word, pieces in zip(fresh, self._segment(fresh), strict=True):
            try:
                self.known[word] = b"".join([ids[p] for p in pieces])
            except KeyError:
                self.known[word] = b"".join([ids.get(p) or self._bytes(p) for p in pieces])

    def _bytes(self, piece: str) -> bytes:
        return b"".join([self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers; an empty text has none."""
        words = [_WORDS.findall(self.prefix + t.replace(" ", MARK)) if t else [] for t in texts]
        if self.held > CACHE_BYTES:
            self.known.clear()
            self.held = 0
        self._learn(set().union(*words))
        return [b"".join(map(self.known.__getitem__, w)) for w in words]

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces and bytes in a row, marks as spaces, without the one in front."""
        raw = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        text = raw.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec for a model file; it outlives a task."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (an array) of each document; null and empty texts have no ids."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids = [np.frombuffer(x, "<i4") for x in own.encode([t or "" for t in batch.column("text").to_pylist()])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return in_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, f"doc_id {id_type}, ids array<int>")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id`` and ``text`` of rows with ``ids``; null ids give an empty text."""
    id_type = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for b in batches:
            texts = [own.decode(np.asarray(x or [], "<u4").tobytes()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type}, text string")


def codec_report(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number and CRC of each document's ids, CRC of the text decoded from them, and whether it is the document's.

    Null texts are empty ones. A text that holds the mark itself comes back with spaces and is no round
    trip. Repeated rows give repeated rows; other columns are not read; an empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, n_ids long, ids_crc32 long, decoded_crc32 long, round_trip boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                ids = own.encode(texts)
                back = [own.decode(x) for x in ids]
                columns = [
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in back], pa.int64()),
                    pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], [x.split()[0] for x in schema.split(", ")])

    return in_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, schema)
