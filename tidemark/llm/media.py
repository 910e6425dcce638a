"""Media columns: audio stored as 8-bit WAV, its features as fixed-shape Arrow tensors with time spans.

Samples are resampled by a polyphase filter, framed with overlap into log-mel energies, and segmented by
energy with hysteresis: a segment opens above the high threshold and closes below the low one. The frames
are stored in an Arrow stream of two tables: tensors of one shape, each with the time it spans, and the
time spans of the segments. Spectra are made in blocks of frames; besides them a text takes memory in
proportion to its own length, one text at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.ipc  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_batches, slices

RATE = 8000
#: Resampling ratio, frame and hop at the lower rate, number of mel bands, frames of a tensor.
UP, DOWN, FRAME, HOP, BANDS, FRAMES = 2, 3, 128, 64, 16, 32
#: Taps of each phase of the resampling filter.
TAPS = 16
#: Hysteresis: a segment opens at the mean energy plus the first share of the spread and closes below the mean plus the second.
OPEN, CLOSE = 0.5, -0.5
#: Frames that are held at once.
BLOCK = 8192


def payload_of(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes of the text and how many; zeros fill up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % 64 if raw else 64)


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """A RIFF file of one channel of unsigned 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples


def read_wav(stored: bytes) -> tuple[int, bytes]:
    """Rate and samples of a RIFF file; chunks other than ``fmt`` and ``data`` are passed over."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a RIFF file")
    at, rate, found = 12, 0, b""
    while at + 8 <= len(stored):
        kind, n = struct.unpack_from("<4sI", stored, at)
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", stored, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("not one channel of 8-bit samples")
        elif kind == b"data":
            found = stored[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    return rate, found


@lru_cache
def _filter() -> np.ndarray:
    """Windowed-sinc low-pass filter, one row of taps for each phase."""
    n = TAPS * UP
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.hamming(n)
    return (h / h.sum() * UP).reshape(TAPS, UP).T.astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """Polyphase resampling by UP/DOWN: output k is phase k * DOWN % UP applied from input k * DOWN // UP on."""
    phases = _filter()
    n = -(-len(x) * UP // DOWN)
    padded = np.concatenate([np.zeros(TAPS // 2, np.float32), x, np.zeros(TAPS, np.float32)])
    views = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    out = np.empty(n, np.float32)
    for p in range(min(UP, n)):  # outputs p, p + UP and so on share a phase, and their inputs lie DOWN apart
        out[p::UP] = views[p * DOWN // UP :: DOWN][: -(-(n - p) // UP)] @ phases[p * DOWN % UP][::-1]
    return out


@lru_cache
def mel_bank(rate: float) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(0, mel(rate / 2), BANDS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / rate)
    up = (f[None] - points[:-2, None]) / (points[1:-1] - points[:-2])[:, None]
    down = (points[2:, None] - f[None]) / (points[2:] - points[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(x: np.ndarray, rate: float) -> np.ndarray:
    """Log-mel energies of overlapping frames; zeros fill the last frame up, so that every sample lies in one."""
    if short := max(0, FRAME - len(x)) or -(len(x) - FRAME) % HOP:
        x = np.concatenate([x, np.zeros(short, np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window, bank = np.hanning(FRAME).astype(np.float32), mel_bank(rate).T
    out = np.empty((len(frames), BANDS), np.float32)
    for i in range(0, len(frames), BLOCK):
        spectrum = np.fft.rfft(frames[i : i + BLOCK] * window, axis=1)
        out[i : i + BLOCK] = np.log(np.square(np.abs(spectrum)).astype(np.float32) @ bank + 1e-6)
    return out


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames between an opening above the high and a closing below the low threshold."""
    mean, spread = float(energy.mean()), float(energy.std())
    marks = np.where(energy >= mean + OPEN * spread + 1e-9, 1, np.where(energy < mean + CLOSE * spread, -1, 0))
    at = np.flatnonzero(marks)
    on = np.zeros(len(energy), bool)
    if len(at):
        last = np.searchsorted(at, np.arange(len(energy)), side="right") - 1
        on = (last >= 0) & (marks[at[np.maximum(last, 0)]] == 1)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on.view(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def features(stored: bytes) -> tuple[bytes, np.ndarray, list[tuple[float, float]]]:
    """Samples, log-mel frames and time spans (in seconds) of a stored WAV."""
    rate, samples = read_wav(stored)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    low = rate * UP / DOWN
    mels = log_mel(resample(x), low)
    return samples, mels, [(a * HOP / low, ((b - 1) * HOP + FRAME) / low) for a, b in segments(mels.mean(axis=1))]


def tensors(mels: np.ndarray, frames: int = FRAMES) -> pa.FixedShapeTensorArray:
    """The frames as an Arrow column of tensors of one shape; the last tensor is filled up with zeros."""
    full = np.zeros((-(-len(mels) // frames) * frames, BANDS), np.float32)
    full[: len(mels)] = mels
    return pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(-1, frames, BANDS))


def to_arrow(mels: np.ndarray, spans: list[tuple[float, float]], rate: float, frames: int = FRAMES) -> bytes:
    """An Arrow stream of the tensors, each with its number of frames and the time it spans; the segments are in the schema's metadata."""
    column = tensors(mels, frames)
    first = np.arange(len(column)) * frames
    held = np.minimum(frames, len(mels) - first)
    columns = [column, pa.array(held, pa.int32()), pa.array(first * HOP / rate), pa.array(((first + held - 1) * HOP + FRAME) / rate)]
    table = pa.table(columns, names=["mel", "frames", "start", "end"])
    table = table.replace_schema_metadata({"segments": np.array(spans, "<f8").tobytes(), "rate": repr(rate)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def from_arrow(stored: bytes) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """Frames and time spans of the segments, read back from the stream."""
    table = pa.ipc.open_stream(stored).read_all()
    full = table.column("mel").combine_chunks().to_numpy_ndarray().reshape(-1, BANDS)
    spans = np.frombuffer(table.schema.metadata[b"segments"], "<f8").reshape(-1, 2)
    return full[: sum(table.column("frames").to_pylist())], [(float(a), float(b)) for a, b in spans]


def digest(mels: np.ndarray, spans: list[tuple[float, float]]) -> str:
    """Frames, bands, mean and spread of the energies, and the time spans' number and length."""
    energy = mels.mean(axis=1, dtype=np.float64)
    return f"mel:{mels.shape[0]}x{mels.shape[1]};mean={energy.mean():.2f};sd={energy.std():.2f};spans={len(spans)};voiced={sum(b - a for a, b in spans):.3f}"


def _media(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, bytes]]:
    """Unpadded bytes, stored WAV and Arrow stream of features of each text."""
    for text in batch.column("text").to_pylist():
        n, payload = payload_of(text)
        stored = wav(payload)
        _, mels, spans = features(stored)
        yield n, stored, to_arrow(mels, spans, RATE * UP / DOWN)


def media_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored form, payload and features of each document, in one pass without a shuffle; all is read back from what ``media_column`` stores.

    A null text is the empty one. Texts of any length are read whole. Equal texts give equal values; repeated
    rows give repeated rows; other columns are not read; an empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = []
                for n, stored, arrow in _media(batch):
                    back = read_wav(stored)[1]
                    rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), digest(*from_arrow(arrow))))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], [x.split()[0] for x in schema.split(", ")])

    return in_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, schema)


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``media``, the stored WAV, and ``features``, the Arrow stream of its tensors and time spans, for each document.

    Nulls, repeated rows, other columns and empty tables are as in ``media_report``.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = [(stored, arrow) for _, stored, arrow in _media(batch)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.binary()) for c in zip(*rows, strict=True)]], ["doc_id", "media", "features"])

    return in_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, f"doc_id {id_type}, media binary, features binary")
