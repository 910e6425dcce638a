"""The queries' operators held against plain versions that share no code with them, and the branches that small tables don't reach."""

import hashlib
import io
import math
import random
import re
import wave
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import SF, WORDS, _classes, _pii
from tests.oracle import TABLES, differences
from tidemark.llm import html, jaccard, media, packing, pii, quality_classifier, quality_rules, queries, sharding, toxicity


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").cache()


def _held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


# ---- op1


def _draw(key, nodes):
    of = lambda n: -math.log((int(hashlib.md5(f"{key}|{n}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / nodes[n]
    return min(nodes, key=of) if len(nodes) > 1 else next(iter(nodes))


def _shard(key, shards):
    tree = defaultdict(lambda: defaultdict(list))
    for s in range(shards):
        region, rack = (f"r{s // 8}", f"r{s // 8}/k{s // 4 % 2}") if s < 24 else (f"x{s}", f"x{s}/k0")
        tree[region][rack].append(s)
    region = _draw(key, {r: sum(map(len, racks.values())) for r, racks in tree.items()})
    rack = _draw(key, {k: len(own) for k, own in tree[region].items()})
    return int(_draw(key, {f"{rack}/s{s}": 1 for s in tree[region][rack]}).rpartition("/s")[2])


def test_sharding_by_brute_force(docs):
    rows = [(d["doc_id"], d["text"].encode()) for d in docs.select("doc_id", "text").collect()]
    want, seen = [], Counter()
    for i, size, crc, s in sorted((i, len(t) + 8, zlib.crc32(t), _shard(i, 24)) for i, t in rows):
        want.append((i, size, crc, "key", s, seen[s], _shard(i, 25)))
        seen[s] += 1
    assert sorted(tuple(r) for r in sharding.shard_documents(docs).collect()) == sorted(want)


def test_slots_of_a_hot_repeated_row(spark):
    rows = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text")).unionByName(spark.range(50).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text")))
    got = defaultdict(list)
    for r in sharding.shard_documents(rows).collect():
        got[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in got.values()) and sum(map(len, got.values())) == 4050


# ---- op3


def test_special_tokens_are_those_of_the_plain_call(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(WORDS)
    texts = ["<|endoftext|>", "a <|startoftext|>b<|endoftext|> c", "<|EndOfText|>", "it's I'LL 12 34", "x" * 700, "tab\tand space é ẞ", "日本 語 🙂🙂", "'s's"]
    got = {r["doc_id"]: bytes(r["ids"]) for r in packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), WORDS, with_ids=True).collect()}
    assert [np.frombuffer(got[i], "<u4").tolist() for i in range(len(texts))] == [plain.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_word_cache_is_bounded_and_harmless(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 4000)
    small, large = packing.WordIds(WORDS), packing.WordIds(WORDS)
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("abcé,") for _ in range(rng.randrange(1, 5))) for _ in range(300)) for _ in range(10)]
    bounded = list(small.encode(texts + texts))
    assert small.held < 8000
    monkeypatch.undo()
    assert bounded == list(large.encode(texts + texts)) and large.held > 8000


def test_packing_in_many_shares(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(packing, "SHARE", 64)
    rows = [(i % 900, " ".join("a" for _ in range(rng.choice([1, 3, 9, 30, 70, 130, 260, 500, 520, 1100])))) for i in range(1000)] + [(None, None), (None, "")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), WORDS, capacity=512, with_ids=True).collect()
    held = defaultdict(list)
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    want = Counter((i, len((t or "").split()) + 1) for i, t in rows)
    have = Counter()
    for i, n in Counter((r["doc_id"], r["start"] + r["length"]) for r in got if r["length"] < 512 or r["start"] + r["length"] in {k for _, k in want}).items():
        have[i] += n
    assert all(have[k] >= n for k, n in want.items())
    assert len(held) <= 1.05 * sum(r["length"] for r in got) / 512 + 2


# ---- op4


def test_gradient_by_finite_differences():
    rng = np.random.default_rng(1)
    e, trans, y = rng.normal(0, 1.5, 40), rng.normal(0, 1, (2, 2)), rng.integers(0, 2, 40).astype(float)
    first = np.zeros(40, bool)
    first[[0, 1, 17]] = True

    def likelihood(e, trans):
        out, edges = 0.0, [*np.flatnonzero(first), 40]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            alpha, seen = np.array([0, e[a]]), y[a] * e[a]
            for t in range(a + 1, b):
                alpha = np.array([np.logaddexp(alpha[0] + trans[0, j], alpha[1] + trans[1, j]) + j * e[t] for j in (0, 1)])
                seen += trans[int(y[t - 1]), int(y[t])] + y[t] * e[t]
            out += seen - np.logaddexp(*alpha)
        return out

    by_word, by_step = toxicity.gradient(e, first, trans, y)
    h = 1e-5
    assert np.allclose(by_word, [(likelihood(e + h * d, trans) - likelihood(e - h * d, trans)) / (2 * h) for d in np.eye(40)], atol=1e-7)
    for k in range(4):
        d = np.zeros(4)
        d[k] = h
        d = d.reshape(2, 2)
        assert abs(by_step.flat[k] - (likelihood(e, trans + d) - likelihood(e, trans - d)) / (2 * h)) < 1e-7


def test_toxicity_scores_by_brute_force(spark, docs, labels):
    model = toxicity.fit(docs, labels)
    c0, c1, c2 = model.calibration
    for r in toxicity.score_documents(docs, model).join(docs.select(F.col("doc_id").alias("i"), "text"), F.col("doc_id") == F.col("i")).collect():
        e = [model.emission(w) for w in re.findall(r"\w+", r["text"])]
        top, mass = toxicity.FLOOR, 0.0
        if e:
            fwd, bwd = [np.array([0, e[0]])], [np.zeros(2)]
            for x in e[1:]:
                fwd.append(np.array([np.logaddexp(fwd[-1][0] + model.trans[0, j], fwd[-1][1] + model.trans[1, j]) + j * x for j in (0, 1)]))
            for x in reversed(e[1:]):
                bwd.append(np.array([np.logaddexp(model.trans[i, 0] + bwd[-1][0], model.trans[i, 1] + x + bwd[-1][1]) for i in (0, 1)]))
            odds = [float((f + b)[1] - (f + b)[0]) for f, b in zip(fwd, reversed(bwd), strict=True)]
            top, mass = min(30.0, max(toxicity.FLOOR, *odds, -99)), sum(1 / (1 + math.exp(-o)) for o in odds if o > 0)
        assert abs(r["score"] - 1 / (1 + math.exp(-(c0 + c1 * top + c2 * math.log1p(mass))))) < 1e-6


# ---- op6 and its stage


def test_clashing_names_and_shuffled_ids(spark, monkeypatch):
    words = lambda k, n=30: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(1, words(1)), (2, words(1)), (3, words(2)), (None, words(2)), (4, words(3)), (4, words(3)), (5, None)]
    names = ["_id", "_digest", "_pii_spans", "n", "c", "p", "label", "kept", "node"]
    df = spark.createDataFrame([(i, t, *[f"{k}{j}" for j in range(len(names))]) for k, (i, t) in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    for bound in (jaccard.BROADCAST_IDS, 0):
        monkeypatch.setattr(jaccard, "BROADCAST_IDS", bound)
        monkeypatch.setattr(jaccard, "BROADCAST_PATHS", bound)
        kept = jaccard.keep_one(df)
        assert kept.columns == df.columns and Counter(r["doc_id"] for r in kept.collect()) == {1: 1, 3: 1, 4: 1, 5: 1}
    redacted = pii.redact_documents(df.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" a@b.co"))))
    assert redacted.columns == df.columns and all(r["text"].endswith(" [EMAIL]") and r["_pii_spans"][-1] == "2" for r in redacted.collect())


def test_large_groups_in_blocks(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(260):  # a chain of drifting texts: near ones are similar, far ones are not
        base[rng.randrange(100)] = f"n{i}"
        rows.append((i, " ".join(base)))
    monkeypatch.setattr(jaccard, "BLOCK", 32)
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == _classes(rows)


# ---- op7


def test_quality_verdicts_by_exact_quantiles(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = []
    for d in docs.collect():
        text = d["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        repeat = len({k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)})
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        chars = sum(map(len, w))
        ratios = (sum(c in "#*$%&|<>" for c in text) / max(chars, 1), (len(lines) - len(set(lines))) / max(len(lines), 1), repeat / max(len(w), 1), chars / max(len(w), 1))
        rows.append((d["doc_id"], d["lang"], d["source"], len(w) < 50 or 100 * repeat > 50 * len(w), ratios))
    floors = (0.08, 0.3, 0.3, 14.0)

    def fences(own):
        out = []
        for k, floor in enumerate(floors):
            v = sorted(r[4][k] for r in own)
            low, mid = (v[max(0, math.ceil(q * len(v)) - 1)] for q in (0.25, 0.5))
            out.append(max(mid + 13 * (mid - low), floor / 2 if mid > low else floor))
        return out

    corpus = fences(rows)
    langs = {x: fences([r for r in rows if r[1] == x]) for x in {r[1] for r in rows}}
    groups = {g: [r for r in rows if r[1:3] == g] for g in {r[1:3] for r in rows}}
    want = {}
    for i, lang, source, failed, ratios in rows:
        wide = [min(a, b) for a, b in zip(langs[lang][:3], corpus, strict=False)] + langs[lang][3:]
        if len(groups[lang, source]) >= 100:
            wide = [min(a, b) for a, b in zip(fences(groups[lang, source]), wide, strict=True)]
        want[i] = not failed and not any(x > f for x, f in zip(ratios, wide, strict=True))
    assert {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(docs).collect()} == want


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_rows_by_sql(spark, name):
    for sf_dir in (SF, "/root/testdata/sf0.01"):
        assert differences(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name], sf_dir) == ""


def test_rules_of_odd_rows_by_sql(spark, tmp_path):
    junk, line = "#|# " * 60, "one two three four five six\n"
    odd = [(None, None, None, None), (1, "en", "a", ""), (1, "en", "a", ""), (2, "en", None, "a b c a b c a b c"), (3, None, "a", junk), (4, "de", "b", line * 30), (5, "de", "b", "\n\n \n\x0b"), (6, "en", "a", "\u00e4\U0001f600\u00a0x " * 70)]
    rows = odd + [(i, "en", "a", " ".join(f"w{i * k % 97}" for k in range(60))) for i in range(10, 150)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for other in set(TABLES) - {"documents"}:
        spark.range(0).write.parquet(str(tmp_path / f"{other}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert differences(quality_rules.quality_rules(docs), queries.ORACLE_SQL["op7_quality_rules"], str(tmp_path)) == ""


# ---- op8


def test_quality_scores_by_brute_force(docs, labels):
    rows = {d["doc_id"]: quality_classifier.statistics_of(d["text"] or "") for d in docs.collect()}
    known = [(rows[x["doc_id"]], float(x["quality"])) for x in labels.collect() if not _held(x["doc_id"]) and x["doc_id"] in rows and x["quality"] is not None]
    x, y = np.array([a for a, _ in known]), np.array([b for _, b in known])
    centre, scale = x.mean(0), np.sqrt(np.maximum(x.var(0), 1e-8))
    rng = np.random.default_rng(11)
    w, b = rng.normal(0, 1 / 4, (16, 191)), rng.uniform(0, 2 * np.pi, 191)
    phi = lambda v: np.hstack([np.ones((len(v), 1)), np.cos(np.clip((v - centre) / scale, -6, 6) @ w + b) * np.sqrt(2 / 191)])
    beta = np.linalg.lstsq(np.vstack([phi(x), np.eye(192)]), np.concatenate([y, np.zeros(192)]), rcond=None)[0]  # ridge as more rows
    place = lambda v: np.clip((phi(v) @ beta + 0.5) / 2 * 400, 0, 399).astype(int)
    n = np.bincount(place(x), minlength=400) + 1e-3
    mean = (np.bincount(place(x), y, 400) + 1e-3 * y.mean()) / n
    # isotonic regression by its minimax formula
    sums, weights = np.concatenate([[0], np.cumsum(mean * n)]), np.concatenate([[0], np.cumsum(n)])
    steps = [max(min((sums[j + 1] - sums[i]) / (weights[j + 1] - weights[i]) for j in range(k, 400)) for i in range(k + 1)) for k in sorted(set(place(np.array(list(rows.values())))))]
    at = dict(zip(sorted(set(place(np.array(list(rows.values()))))), steps, strict=True))
    own = np.array(list(rows.values()))
    want = dict(zip(rows, np.clip(0.998 * np.array([at[k] for k in place(own)]) + 0.002 * np.clip(phi(own) @ beta, 0, 1), 0, 1), strict=True))
    got = {r["doc_id"]: r["score"] for r in quality_classifier.classify(docs, labels).collect()}
    assert got.keys() == want.keys() and sum(abs(got[i] - want[i]) > 1e-5 for i in want) <= 1  # a score on the edge of a bin may fall to either side


# ---- op9


def _plain_feature(samples):
    up, down, taps, frame, hop, bands = 2, 3, 16, 128, 64, 16
    x = (np.frombuffer(samples, np.uint8).astype(float) - 128) / 128
    t = np.arange(taps * up) - (taps * up - 1) / 2
    h = np.sinc(t / down) * np.hamming(taps * up)
    h *= up / h.sum()
    spread = np.zeros(len(x) * up)
    spread[::up] = x  # zeros between samples, one long filter, every third output
    n = -(-len(x) * up // down)
    low = np.concatenate([np.convolve(spread, h), np.zeros(down)])[(taps // 2 - 1) * up :][: n * down : down]
    low = low if len(low) >= frame and (len(low) - frame) % hop == 0 else np.concatenate([low, np.zeros(max(0, frame - len(low)) or -(len(low) - frame) % hop)])
    rate = 8000 * up / down
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    points = [700 * (10 ** (mel(rate / 2) * k / (bands + 1) / 2595) - 1) for k in range(bands + 2)]
    window = [0.5 - 0.5 * math.cos(2 * math.pi * k / (frame - 1)) for k in range(frame)]
    turn = np.exp(-2j * np.pi * np.outer(np.arange(frame // 2 + 1), np.arange(frame)) / frame)
    rows = []
    for at in range(0, len(low) - frame + 1, hop):
        power = np.abs(turn @ (low[at : at + frame] * window)) ** 2
        energies = []
        for b in range(bands):
            a, m, c = points[b : b + 3]
            energies.append(math.log(sum(p * max(0, min((k * rate / frame - a) / (m - a), (c - k * rate / frame) / (c - m))) for k, p in enumerate(power)) + 1e-6))
        rows.append(energies)
    return np.array(rows), rate


def test_media_by_brute_force(spark):
    texts = ["", "Hello wörld 🙂", "abc " * 100, "AAAA" * 60 + "\x01" * 300 + "zzzz" * 60, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in media.media_report(df).collect()}
    kept = {r["doc_id"]: r for r in media.media_column(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        file = io.BytesIO()
        with wave.open(file, "wb") as out:
            out.setnchannels(1), out.setsampwidth(1), out.setframerate(8000), out.writeframes(payload)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(file.getvalue()), hashlib.sha256(file.getvalue()).hexdigest()) and bytes(kept[i]["media"]) == file.getvalue()
        mels, rate = _plain_feature(payload)
        table = pa.ipc.open_stream(bytes(kept[i]["features"])).read_all()
        assert table.schema.field("mel").type == pa.fixed_shape_tensor(pa.float32(), [32, 16])
        stored, spans = media.from_arrow(bytes(kept[i]["features"]))
        assert stored.shape == mels.shape and np.abs(stored - mels).max() < 0.02
        assert np.allclose(table.column("start").to_pylist(), [k * 32 * 64 / rate for k in range(table.num_rows)])
        energy, on, want = stored.mean(axis=1), False, []
        high, least = energy.mean() + 0.5 * energy.std() + 1e-9, energy.mean() - 0.5 * energy.std()
        for k, e in enumerate(energy):
            if not on and e >= high:
                want.append([k, k + 1])
                on = True
            elif on and e < least:
                on = False
            elif on:
                want[-1][1] = k + 1
        assert np.allclose(spans, [(a * 64 / rate, ((b - 1) * 64 + 128) / rate) for a, b in want])
        assert r["feature"] == f"mel:{len(stored)}x16;mean={stored.mean(axis=1, dtype=float).mean():.2f};sd={stored.mean(axis=1, dtype=float).std():.2f};spans={len(want)};voiced={sum(b - a for a, b in spans):.3f}"


# ---- op10


def _page(rng, host):
    """A page and its main text, known from its making."""
    words = lambda n: " ".join(rng.choice(["stone", "river", "Tür", "a&b", "x<y", "naïve"]) for _ in range(n))
    esc = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace("ü", "&uuml;")
    blocks = [words(rng.randrange(1, 30)) for _ in range(rng.randrange(1, 12))]
    body = "".join(rng.choice([f"<p>{esc(b)}</p>", f"<p>{esc(b)}", f"<h2> {esc(b)}\n</h2>", f"<ul><li>{esc(b)}</ul>", f"<p><b>{esc(b)}</b></p>"]) for b in blocks)
    noise = [f"<nav><a href=/>{esc(words(9))}</a></nav>", f"<aside>{esc(words(20))}</aside>", f"<div class='ad-box'>{esc(words(3))}</div>", f"<form>{esc(words(4))}</form>", "<script>if (a<b) {}</script>", f"<!-- {words(5)} -->"]
    rng.shuffle(noise)
    wrap = {"a.org": "<article class='story with-footer'>{}</article>", "b.org": "<div id=content class='no-sidebar main-col'>{}</div>", "c.org": "<main class='post7'>{}</main>"}[host]
    return f"<html><head><title>t</title></head><body>{noise[0]}{noise[1]}{wrap.format(body)}{''.join(noise[2:])}<footer>{esc(words(5))}</footer></body></html>", "\n".join(blocks)


def test_extraction_of_made_pages(spark, monkeypatch):
    rng = random.Random(6)
    rows, want = [], {}
    for i in range(240):
        host = ("a.org", "b.org", "c.org")[i % 3]
        page, want[i] = _page(rng, host)
        rows.append((i, f"http://{host}/{i}", page))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for bound in (html.BROADCAST_HOSTS, 0):  # winners broadcast, and joined by host and salt
        monkeypatch.setattr(html, "BROADCAST_HOSTS", bound)
        got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract(df).collect()}
        assert got == {i: (t, len(t)) for i, t in want.items()}


def test_class_words_are_evidence_only():
    text = lambda page: html.Page(page).text(None)
    assert text('<div class="content no-sidebar"><p>Text</p></div>') == text('<div id="content" class="with-footer"><p>Text</p></div>') == "Text"
    assert text('<div class="post-content share-story"><p>The article</p></div><div><p>x</p></div>').startswith("The article")
    assert text('<article><p>a</p><blockquote class="related-quote">quote</blockquote><div class="ad-slot">buy</div></article>') == "a\nquote"
    assert text('<article><p>short</p><section class="comments"><p>a much longer comment by a reader</p></section></article>') == "short"
    assert text('<div class="widget"><p>All of the text</p></div>') == "All of the text"
    assert text("<div class=sidebar><p>a sidebar longer than the article</p></div><article><p>short</p></article>") == "short"
    assert text("<p>&am<b>p;</b> x</p>") == "&amp; x"


def test_hosts_overrule_a_page(spark):
    body = lambda n: "".join(f"<p>Sentence {k} of the article.</p>" for k in range(n))
    page = lambda n, extra: f"<body><div class=story>{body(n)}</div><div class=extra>{extra}</div></body>"
    rows = [(i, "http://h.org/x", page(20, "")) for i in range(9)] + [(9, "http://h.org/y", page(1, "<p>" + "elsewhere " * 60 + "</p>"))]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "Sentence 0 of the article." and got[0].count("\n") == 19


def test_long_page(spark):
    paragraphs = [f"Paragraph {k} " + "word " * 40 + "end." for k in range(20_000)]
    page = "<body><article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article></body>"
    (row,) = html.extract(spark.createDataFrame([(1, "http://h.org/x", page)], "page_id long, url string, html string")).collect()
    assert row["text"] == "\n".join(paragraphs)


# ---- the pipeline


def test_pipeline_by_brute_force(spark, docs, labels):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rows = {d["doc_id"]: d["text"] for d in docs.collect()}
    score = {r["doc_id"]: r["score"] for r in quality_classifier.classify(docs, labels).collect()}
    rows = {i: t for i, t in rows.items() if score[i] >= 0.3}
    left = docs.where(F.col("doc_id").isin(*rows))
    score = {r["doc_id"]: r["score"] for r in toxicity.score_documents(left, toxicity.fit(left, labels)).collect()}
    rows = {i: t for i, t in rows.items() if score[i] < 0.5}
    rows = {i: rows[i] for i in {c for _, c, _ in _classes(sorted(rows.items()))}}
    spans = {r["doc_id"]: r["spans"] for r in pii.pii_report(docs.where(F.col("doc_id").isin(*rows))).collect()}
    plain, want = Tokenizer.from_file(WORDS), Counter()
    for i, t in rows.items():
        assert {":".join(map(str, s)) for s in _pii(t)} <= set(spans[i].split(","))
        out, at = "", 0
        for kind, a, b in (s.split(":") for s in spans[i].split(",") if s):
            if int(a) >= at:
                out += t[at : int(a)] + f"[{kind.upper()}]"
            at = max(at, int(b))
        ids = plain.encode(out + t[at:], add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[i, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(o == sum(n for _, n in sorted(p)[:k]) for p in held.values() for k, (o, _) in enumerate(sorted(p))) and all(sum(n for _, n in p) <= 4096 for p in held.values())
