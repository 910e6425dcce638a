"""Toxic spans by a linear-chain conditional random field over words.

Training (on the driver, from a bounded sample of labelled documents): words of clean documents are
labelled clean; in toxic documents a word is labelled toxic when one of its features (the word itself,
prefixes, suffixes) occurs in toxic documents and hardly ever in clean ones. The CRF is
fitted to windows of labelled words, then again with the windows that it got wrong on clean documents.

Scoring (distributed, one pass, no shuffle): every word of the whole text gets its emission from its
features, forward-backward gives each word its marginal, and a document's score is a calibrated
function of its highest marginal odds and expected number of toxic words. Words whose marginal reaches
one half are the offending spans.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_batches, slices, train_side

#: Labelled documents of each class that training reads at most.
SAMPLE = 2000
#: Words on either side of a labelled word in a training window.
REACH = 6
#: Emissions are held within this many nats.
CLIP = 12.0
#: Bytes of words whose emission a worker remembers, what a word costs besides its text, and the length of a scan block.
CACHE_BYTES, ENTRY_BYTES, BLOCK = 96 << 20, 150, 64

WORD = re.compile(r"\w+")


def word_features(word: str) -> tuple[str, ...]:
    """The word in lower case (a digest stands for one of over 64 characters), its prefixes and its suffixes; a mark tells the kinds apart."""
    w = word.lower()
    whole = w if len(w) <= 64 else "#" + hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
    return ("=" + whole, w[:3], w[:4], w[:5], "-" + w[-3:], "-" + w[-4:])


#: Features of a word, by whose root its emission is scaled.
SCALE = 1 / np.sqrt(6)


@dataclass
class Model:
    """Weights of features, transitions [from][to] and the calibration; all bounded by the sample."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -4.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    calibration: tuple[float, float, float] = (-4.0, 0.5, 0.0)

    def emission(self, word: str) -> float:
        get = self.weights.get
        total = 0.0
        for f in word_features(word):
            total += get(f, 0.0)
        return min(CLIP, max(-CLIP, self.bias + SCALE * total))


def recursions(emissions: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward ratios (toxic to clean) at each word, of documents laid end to end; ``first`` marks their first words.

    With two states the recursions act on ratios as fractional-linear maps. A document's first word is a
    map that ignores its argument, so one chain serves all documents. Maps are multiplied within blocks,
    the block maps applied in order, and the ratios filled in within blocks.
    """
    n = len(emissions)
    if not n:
        return np.zeros(0), np.zeros(0)
    t = np.exp(trans)
    size = -(-n // BLOCK) * BLOCK
    e = np.ones(size)
    e[:n] = np.exp(emissions)
    starts = np.ones(size, bool)
    starts[:n] = first
    ends = np.ones(size, bool)
    ends[: n - 1] = first[1:]
    #: ratio' = (a * ratio + b) / (c * ratio + d); at a first word: e
    ahead = _scan(np.where(starts, 0, e * t[1, 1]), np.where(starts, e, e * t[0, 1]), np.where(starts, 0, t[1, 0]), np.where(starts, 1, t[0, 0]))
    after = np.ones(size)
    after[:-1] = e[1:]
    back = _scan(*(x[::-1] for x in (np.where(ends, 0, t[1, 1] * after), np.where(ends, 1, t[1, 0]), np.where(ends, 0, t[0, 1] * after), np.where(ends, 1, t[0, 0]))))[::-1]
    return ahead[:n], back[:n]


def log_odds(emissions: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Log odds of the toxic state at each word: its marginal."""
    ahead, back = recursions(emissions, first, trans)
    return np.log(np.maximum(ahead * back, 1e-300))


def gradient(emissions: np.ndarray, first: np.ndarray, trans: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the labels' log likelihood by emissions and by transitions: what is there, less what the field expects.

    Expected transitions are the pairwise marginals of forward-backward: the forward ratio of the earlier
    word, the transition, the later word's emission and backward ratio, normalised pair by pair.
    """
    ahead, back = recursions(emissions, first, trans)
    p = ahead * back / (1 + ahead * back)
    later = np.flatnonzero(~first)
    t = np.exp(trans)
    a, b = ahead[later - 1], np.exp(emissions[later]) * back[later]
    cells = np.stack([np.full(len(later), t[0, 0]), t[0, 1] * b, a * t[1, 0], a * t[1, 1] * b])
    expected = (cells / cells.sum(axis=0)).sum(axis=1).reshape(2, 2)
    seen = np.bincount(2 * y[later - 1].astype(int) + y[later].astype(int), minlength=4).reshape(2, 2)
    return y - p, seen - expected


def _scan(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    a, b, c, d = (np.ascontiguousarray(x.reshape(-1, BLOCK).T) for x in (a, b, c, d))
    pa_, pb, pc, pd = a[0], b[0], c[0], d[0]
    for i in range(1, BLOCK):
        na, nb, nc, nd = a[i] * pa_ + b[i] * pc, a[i] * pb + b[i] * pd, c[i] * pa_ + d[i] * pc, c[i] * pb + d[i] * pd
        top = na + nb + nc + nd
        pa_, pb, pc, pd = na / top, nb / top, nc / top, nd / top
    enter, ratio = np.empty(len(pa_)), 1.0
    for k, (w, x, y, z) in enumerate(zip(pa_.tolist(), pb.tolist(), pc.tolist(), pd.tolist(), strict=True)):
        enter[k] = ratio
        ratio = min(1e200, max(1e-200, (w * ratio + x) / (y * ratio + z)))
    out = np.empty_like(a)
    for i in range(BLOCK):
        enter = np.clip((a[i] * enter + b[i]) / (c[i] * enter + d[i]), 1e-200, 1e200)
        out[i] = enter
    return out.T.reshape(-1)


def _windows(docs: list[list[str]], marks: list[np.ndarray], clean: list[bool], rng: np.random.Generator, each: int = 3) -> list[tuple[list[str], np.ndarray]]:
    """Windows around the toxic words of toxic documents and at random places of clean ones."""
    out = []
    for words, y, ok in zip(docs, marks, clean, strict=True):
        at = rng.integers(0, len(words), each) if ok else rng.permutation(np.flatnonzero(y))[:each]
        out += [(words[max(0, i - REACH) : i + REACH + 1], y[max(0, i - REACH) : i + REACH + 1]) for i in at]
    return out


def _fit(model: Model, windows: list[tuple[list[str], np.ndarray]], rounds: int = 60, l2: float = 1e-4) -> None:
    """Maximum likelihood of the windows' labels by Adagrad."""
    words = sorted({w for x, _ in windows for w in x})
    index = {w: i for i, w in enumerate(words)}
    rows = [word_features(w) for w in words]
    names = sorted({f for r in rows for f in r})
    number = {f: i for i, f in enumerate(names)}
    flat = np.array([number[f] for r in rows for f in r])
    owner = np.repeat(np.arange(len(words)), 6)
    weights = np.array([model.weights.get(f, 0.0) for f in names])
    ids = np.concatenate([[index[w] for w in x] for x, _ in windows])
    y = np.concatenate([m for _, m in windows]).astype(float)
    first = np.zeros(len(ids), bool)
    first[np.cumsum([0] + [len(x) for x, _ in windows[:-1]])] = True
    seen_w, seen_t, seen_b = np.full(len(names), 1e-6), np.full((2, 2), 1e-6), 1e-6
    for _ in range(rounds):
        emission = np.clip(model.bias + SCALE * np.bincount(owner, weights[flat], len(words)), -CLIP, CLIP)[ids]
        by_word, gt = gradient(emission, first, model.trans, y)
        by_word = np.where(np.abs(emission) < CLIP, by_word, 0)  # beyond, the emission does not move
        grad_word = np.bincount(ids, by_word, len(words))
        g = np.bincount(flat, SCALE * grad_word[owner], len(names)) / len(ids) * 100 - l2 * weights
        seen_w += g * g
        weights += 0.5 * g / np.sqrt(seen_w)
        gb = by_word.mean() * 100
        seen_b += gb * gb
        model.bias += 0.1 * gb / np.sqrt(seen_b)
        gt = gt / len(ids)
        seen_t += gt * gt
        model.trans += 0.05 * gt / np.sqrt(seen_t)
        model.trans -= model.trans[0, 0]
    model.weights.update((f, float(w)) for f, w in zip(names, weights, strict=True) if abs(w) > 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Newton steps of a ridge logistic regression with intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        w += np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
    return tuple(float(v) for v in w)


def _summary(odds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each document: its highest log odds and the logarithm of one more than its expected toxic words."""
    at = np.flatnonzero(first)
    top = np.maximum.reduceat(odds, at)
    mass = np.add.reduceat(np.where(odds > 0, 1 / (1 + np.exp(-np.clip(odds, -30, 30))), 0), at)
    return np.column_stack([np.clip(top, FLOOR, 30), np.log1p(mass)])


#: Log odds under which words no longer differ in a document's score; the summary of a document without others.
FLOOR = -4.0
NOTHING = (FLOOR, 0.0)


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Fit the field to labelled documents. Without any of one class, the score is that class's constant."""
    model = Model()
    y = np.asarray(labels)
    if not len(y) or y.min() == y.max():
        model.calibration = (4.0 if len(y) and y[0] else -4.0, 0.0, 0.0)
        return model
    rng = np.random.default_rng(seed)
    docs = [WORD.findall(t or "") for t in texts]
    held = [(d, bool(v)) for d, v in zip(docs, y, strict=True) if d]
    toxic_in, clean_in = Counter(), Counter()
    for d, v in held:
        (toxic_in if v else clean_in).update({f for w in set(d) for f in word_features(w)})
    n_toxic, n_clean = max(1, sum(v for _, v in held)), max(1, sum(not v for _, v in held))
    telling = {f for f, k in toxic_in.items() if k >= max(4, 0.002 * n_toxic) and k / n_toxic > 40 * (clean_in[f] + 0.5) / n_clean}
    del toxic_in, clean_in
    marks = [np.array([v and not telling.isdisjoint(word_features(w)) for w in d]) for d, v in held]
    known = [(d, m, not v) for (d, v), m in zip(held, marks, strict=True) if not v or m.any()]
    if not any(m.any() for _, m, _ in known):
        model.calibration = (float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), 0.0, 0.0)
        return model
    windows = _windows(*zip(*known, strict=True), rng)
    for again in range(3):
        _fit(model, windows)
        if again < 2:
            scorer = Scorer(model)
            for d, m, ok in known:
                if ok:
                    e = np.array(scorer.emissions(d))
                    i = int(e.argmax())
                    if e[i] > -2:
                        windows.append((d[max(0, i - REACH) : i + REACH + 1], m[max(0, i - REACH) : i + REACH + 1]))
    scorer = Scorer(model)
    rows = []
    for i in range(0, len(docs), 200):
        part = [d for d in docs[i : i + 200] if d]
        first = np.zeros(sum(map(len, part)), bool)
        first[np.cumsum([0] + [len(d) for d in part[:-1]])[: len(part)]] = True
        found = iter(_summary(log_odds(np.array(scorer.emissions([w for d in part for w in d])), first, model.trans), first)) if part else iter(())
        rows += [next(found) if d else np.array(NOTHING) for d in docs[i : i + 200]]
    model.calibration = _logistic(np.array(rows), y.astype(float))
    return model


class Scorer:
    """Scores and offending spans of texts; the emissions of words are remembered, up to a bound.

    A neighbour moves a word's log odds by the spread of the transitions at most. Where no word of a text
    comes within that of FLOOR, the summary is NOTHING without running the recursions.
    """

    def __init__(self, model: Model):
        self.model = model
        self.known: set[str] = set()
        self.hot: dict[str, float] = {}
        self.least = FLOOR - 2 * float(np.abs(model.trans).max() * 2)
        self.held = 0

    def learn(self, words: list[str]) -> None:
        if self.held > CACHE_BYTES:
            self.known.clear(), self.hot.clear()
            self.held = 0
        fresh = set(words).difference(self.known)
        self.held += sum(map(len, fresh)) + ENTRY_BYTES * len(fresh)
        emission, least = self.model.emission, self.least
        for w in fresh:
            e = emission(w)
            if e > least:
                self.hot[w] = e
        self.known |= fresh

    def emissions(self, words: list[str]) -> list[float]:
        """Emissions of words; those too low to matter are given as the lowest."""
        self.learn(words)
        get = self.hot.get
        return [get(w, -CLIP) for w in words]

    def __call__(self, texts: list[str], spans: bool = False) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        found: list[list[tuple[int, int, float]]] = [[] for _ in texts]
        c0, c1, c2 = self.model.calibration
        of = lambda s: 1 / (1 + np.exp(-(c0 + c1 * s[:, 0] + c2 * s[:, 1])))
        score = np.full(len(texts), of(np.array([NOTHING]))[0])
        at, emissions, first = [], [], []
        for i, t in enumerate(texts):
            words = WORD.findall(t)
            self.learn(words)
            if not self.hot.keys().isdisjoint(words):
                at.append(i)
                first.append(len(emissions))
                emissions += map(self.hot.get, words, repeat(-CLIP))
        if not at:
            return score, found
        marks = np.zeros(len(emissions), bool)
        marks[first] = True
        odds = log_odds(np.array(emissions), marks, self.model.trans)
        score[at] = of(_summary(odds, marks))
        if spans:
            for i, a, b in zip(at, first, [*first[1:], len(emissions)], strict=True):
                hits = np.flatnonzero(odds[a:b] > 0)
                if len(hits):
                    places = [m.span() for m in WORD.finditer(texts[i])]
                    found[i] = [(*places[k], float(1 / (1 + np.exp(-odds[a + k])))) for k in hits]
        return np.clip(score, 0, 1), found


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on ``sample`` documents of each class at most, chosen by a hash of the id among the training rows."""
    rows = labels.where(train_side("doc_id") & F.col(label_col).isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max(label_col).alias("_y"))
    order = [F.xxhash64("_id"), F.col("_id")]
    chosen = rows.where("_y = 1").orderBy(*order).limit(sample).unionByName(rows.where("_y = 0").orderBy(*order).limit(sample))
    # at most two samples of ids: the bound of the broadcast
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text IS NOT NULL").join(F.broadcast(chosen), "_id")
    # one text of each id, however often the id repeats
    found = {r["_id"]: (r["_text"], int(r["_y"])) for r in joined.groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_y").alias("_y")).toLocalIterator()}
    at = sorted(found)
    return train([found[i][0] for i in at], [found[i][1] for i in at])


def score_documents(docs: DataFrame, model: Model, spans: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score of each document and, with ``spans``, its offending words with offsets and marginals.

    Null and empty texts get the score of a document without words. Repeated rows are scored each for
    itself, equal texts alike. An empty table gives no rows. Other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, score double" + ", spans array<struct<start:int,end:int,prob:double>>" * spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for whole in batches:
            for batch in slices(whole, "text"):
                score, found = scorer([t or "" for t in batch.column("text").to_pylist()], spans)
                columns = [batch.column("doc_id"), pa.array(score, pa.float64())]
                if spans:
                    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("prob", pa.float64())]))
                    columns.append(pa.array([[dict(zip(("start", "end", "prob"), s, strict=True)) for s in x] for x in found], kind))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "spans"][: len(columns)])

    return in_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents, whole rows, that score below the threshold.

    Null and empty texts, which have no words, score low and stay. Repeated rows go or stay together, whatever
    other columns there are; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for whole in batches:
            for batch in slices(whole, text_col):
                score, _ = scorer([t or "" for t in batch.column(text_col).to_pylist()])
                yield batch.filter(pa.array(score < threshold))

    return in_batches(docs).mapInArrow(run, docs.schema)
