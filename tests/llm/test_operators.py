"""Each operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, html, jaccard, media, packing, pii, quality_classifier, quality_rules, sentencepiece, sharding, toxicity

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string, label string, path string, key string, node string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows and extra columns whose names clash."""
    random.seed(1)
    long = " ".join(random.choice("alpha beta gamma delta eps").upper() if i % 9 else "zeta" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, "same text of seven words in all"), (6, "same text of seven words in all"), (6, "same text of seven words in all"), (None, "no id"), (None, None), (7, "x" * 20_000), (8, "été 🙂 ß Ώ")]
    return spark.createDataFrame([(i, t, None, None, None, "s", "t", None, "p", "k", "n") for i, t in rows], SCHEMA).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_sharding(spark, odd, nothing, docs):
    for df in (odd, docs):
        rows = sharding.shard_documents(df).collect()
        assert len(rows) == df.count()
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
            assert r["grown_shard"] in (r["shard"], 24) and 0 <= r["shard"] < 24
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(nothing).count() == 0
    assert len({(r["shard"]) for r in sharding.shard_documents(odd).where("doc_id = 6").collect()}) == 1


def test_sharding_moves_little(spark):
    ids = spark.range(4000)
    heavy = [sharding.Leaf(x.region, x.rack, x.shard, 2.0 if x.shard == 5 else 1.0) for x in sharding.topology(24)]
    both = sharding.assign(sharding.assign(ids, sharding.topology(24), "id", "a"), heavy, "id", "b")
    moved = both.where("a <> b").collect()
    assert moved and all(r["b"] // 8 == 0 for r in moved)  # rows only move into the region whose weight grew
    # a move between racks of the region goes to the rack that grew, one within it to the shard that did
    assert all(r["b"] // 4 == 1 for r in moved if r["a"] // 8 == 0) and all(r["b"] == 5 for r in moved if r["a"] // 4 == 1)
    shares = Counter(r["b"] for r in both.collect())
    assert shares[5] > 1.4 * shares[4]


def _luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c)) // 10 + 2 * int(c) % 10 for i, c in enumerate(reversed(d))) % 10 == 0


def _pii(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and _luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    found = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m[0]))
    return [(kinds[k][0], a, b) for a, k, b in found]


TRICKY = [
    "a@b.com_x@c.de, a@b", "1.2.3.4.5.6.7.8 300.1.2.3.4 007.0.0.1", "4111 1111 1111 1111 and 4111-1111-1111-1112 41111111111111111111111", "🙂 call +1 (499) 555-6503. now +49 30",
    "9" * 5000 + " " + "a" * 5000 + "@", "1 2 3 4 5 6 7 8 9 0 1 2 3 4", ".@-.-.- x@y.z-.q", "+1+1 +12345678901", "",
]


def test_pii(spark, odd, nothing, docs):
    texts = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    for df in (texts, odd.select("doc_id", "text"), docs.select("doc_id", "text")):
        want = Counter((r["doc_id"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in _pii(r["text"] or "")).encode()).hexdigest()) for r in df.collect())
        assert Counter((r["doc_id"], r["base_sha256"]) for r in pii.pii_report(df).collect()) == want
    assert pii.pii_report(nothing).count() == 0


def test_pii_checksums_and_context(spark):
    df = spark.createDataFrame([(1, "my iban GB82 WEST 1234 5698 7654 32 ok"), (2, "GB83 WEST 1234 5698 7654 32"), (3, "ssn 123-45-6789"), (4, "part 123-45-6789"), (5, "mail a@b.co, +49 30 1234567 end")], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.pii_report(df).collect()}
    assert got[1] == "iban:8:35" and got[2] == "" and got[3] == "ssn:4:15" and got[4] == ""
    text = {r["doc_id"]: r["text"] for r in pii.redact_documents(df).collect()}
    assert text[5] == "mail [EMAIL], [PHONE] end" and text[2] == "GB83 WEST 1234 5698 7654 32"


def test_packing(spark, odd, nothing, docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORDS)
    for df in (odd.select("doc_id", "text", "shard"), docs):
        rows = packing.pack_documents(df, WORDS, with_ids=True).collect()
        held = defaultdict(list)
        for r in rows:
            held[r["sequence_id"]].append((r["offset"], r["length"]))
            assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        for parts in held.values():
            parts.sort()
            assert [o for o, _ in parts] == list(np.cumsum([0] + [n for _, n in parts[:-1]])) and sum(n for _, n in parts) <= 4096
        total = sum(r["length"] for r in rows)
        assert len(held) <= 1.02 * total / 4096 + 2
        want = Counter((d["doc_id"], np.array(whole.encode(d["text"] or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for d in df.collect())
        if df is docs:
            parts = defaultdict(dict)
            for r in rows:
                parts[r["doc_id"]][r["piece"]] = bytes(r["ids"])
            assert Counter((i, b"".join(p[k] for k in sorted(p))) for i, p in parts.items()) == want
    assert packing.pack_documents(nothing, WORDS).count() == 0


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(0)
    for _ in range(30):
        counts = {int(k): int(v) for k, v in zip(rng.integers(1, 101, 12), rng.integers(1, 9, 12), strict=True)}
        table = packing.plan(counts, 100)
        used = defaultdict(list)
        for length, rank, n, each, first, offset in table.tolist():
            for k in range(n):
                used[first + k // each].append((offset + k % each * length, length))
        gaps = []
        for length in sorted((x for k, n in counts.items() for x in [k] * n), reverse=True):
            fits = [i for i, g in enumerate(gaps) if g >= length]
            if fits:
                i = min(fits, key=lambda i: gaps[i])
                gaps[i] -= length
            else:
                gaps.append(100 - length)
        assert len(used) == len(gaps) and sorted(100 - sum(n for _, n in p) for p in used.values()) == sorted(gaps)
        assert all(sorted(p)[i][0] == sum(n for _, n in sorted(p)[:i]) for p in used.values() for i in range(len(p)))
    assert len(packing.plan({}, 100)) == 0


def test_field_recursions_match_brute_force():
    rng = np.random.default_rng(1)
    e, trans = rng.normal(0, 2, 150), rng.normal(0, 1, (2, 2))
    first = np.zeros(150, bool)
    first[[0, 1, 60, 61, 140]] = True
    got = toxicity.log_odds(e, first, trans)
    edges = [*np.flatnonzero(first), 150]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        n = b - a
        alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
        alpha[0] = [0, e[a]]
        for t in range(1, n):
            alpha[t] = [np.logaddexp(alpha[t - 1, 0] + trans[0, j], alpha[t - 1, 1] + trans[1, j]) + j * e[a + t] for j in (0, 1)]
        for t in range(n - 2, -1, -1):
            beta[t] = [np.logaddexp(trans[i, 0] + beta[t + 1, 0], trans[i, 1] + e[a + t + 1] + beta[t + 1, 1]) for i in (0, 1)]
        assert np.allclose(got[a:b], (alpha + beta)[:, 1] - (alpha + beta)[:, 0])


def test_toxicity(spark, odd, nothing):
    rng = random.Random(2)
    clean = lambda n: " ".join(rng.choice("river stone garden window paper music table green") + rng.choice("abcdef") for _ in range(n))
    rows = [(i, clean(40) if i % 3 else f"{clean(20)} {rng.choice(['gromblak', 'gromblish'])}{rng.choice('xyz')} {clean(15)}", int(i % 3 == 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df)
    got = {r["doc_id"]: r for r in toxicity.score_documents(df, model, spans=True).collect()}
    assert sum((got[i]["score"] >= 0.5) == bool(t) for i, _, t in rows) >= 594
    texts = {i: t for i, t, _ in rows}
    assert all(texts[i][s["start"] : s["end"]].startswith("grombl") for i, r in got.items() for s in r["spans"])
    assert toxicity.score_documents(odd, model).count() == odd.count() and toxicity.score_documents(nothing, model).count() == 0
    assert toxicity.keep_clean(odd, model).count() == odd.count()
    assert all(0 <= r["score"] <= 1 for r in toxicity.score_documents(odd, toxicity.fit(nothing, nothing.selectExpr("doc_id", "1 AS toxic"))).collect())


def test_word_features_read_the_whole_word():
    long = "Quiet_" * 50
    a, b = toxicity.word_features(long + "gromblak"), toxicity.word_features(long + "garden")
    assert a[4:] == ("-lak", "-blak") and b[4:] == ("-den", "-rden") and a[0] != b[0] and a[1:4] == b[1:4] == ("qui", "quie", "quiet")
    assert max(map(len, a)) <= 66 and toxicity.word_features("Word") == ("=word", "wor", "word", "word", "-ord", "-word")


def test_sentencepiece(spark, odd, nothing):
    import sentencepiece as library

    lib = library.SentencePieceProcessor(model_file=PIECES)
    own = sentencepiece.Codec(PIECES)
    rng = random.Random(3)
    texts = ["", " ", "  a  b \n\n x", "日本語 🙂 é test", "\t\tfoo", "don't   stop    now     ok", "x" * 3000] + ["".join(rng.choice("abcde tion\n.é") for _ in range(rng.randrange(200))) for _ in range(300)]
    ids = own.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == lib.encode(texts)
    assert [own.decode(x) for x in ids] == texts
    assert all(r["round_trip"] for r in sentencepiece.codec_report(odd, PIECES).collect()) and sentencepiece.codec_report(nothing, PIECES).count() == 0
    back = sentencepiece.decode_documents(sentencepiece.encode_documents(odd, PIECES), PIECES)
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((r["doc_id"], r["text"] or "") for r in odd.collect())


def test_unigram_viterbi_matches_brute_force():
    own = sentencepiece.Codec(PIECES)
    own.bpe = False
    own.scores = {"▁a": -2.0, "ab": -2.5, "b": -1.0, "a": -1.5, "abb": -3.0, "▁": -1.0, "bb": -1.8}
    own.ends = {p[i:] for p in own.scores for i in range(len(p))}
    words = sorted("▁" + "".join(w) for n in range(1, 6) for w in __import__("itertools").product("ab", repeat=n))

    def best(w):
        if not w:
            return 0.0
        return max(own.scores[w[:i]] + best(w[i:]) for i in range(1, len(w) + 1) if w[:i] in own.scores)

    for w, cut in zip(words, own._segment(words), strict=True):
        assert "".join(cut) == w and sum(own.scores[p] for p in cut) == pytest.approx(best(w))


def _classes(rows):
    sets = [set(jaccard.shingles(t or "").tolist()) for _, t in rows]
    parent, links = list(range(len(rows))), Counter()

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            links[i] += 1
            links[j] += 1
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return Counter((d, least.get(root(i)), links[i]) for i, (d, _) in enumerate(rows))


def test_jaccard(spark, odd, nothing):
    rng = random.Random(4)
    base = [rng.choice("one two three four five six seven eight nine ten".split()) + str(rng.randrange(40)) for _ in range(120)]
    rows = []
    for i in range(320):  # more than a block of near copies that link to some of each other
        own = list(base)
        for k in rng.sample(range(120), rng.randrange(4)):
            own[k] = f"new{rng.randrange(10_000)}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(rng.choice("abc") + str(rng.randrange(300)) for _ in range(60))) for i in range(60)]
    rows += [(2000, rows[-1][1]), (2001, rows[-1][1] + " tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for table in (df, odd):
        own = [(r["doc_id"], r["text"]) for r in table.collect()]
        assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.similar_documents(table).collect()) == _classes(own)
    kept = jaccard.keep_one(df).collect()
    assert len(kept) == len({c for _, c, _ in _classes(rows)})
    assert jaccard.similar_documents(nothing).count() == 0 and jaccard.keep_one(odd).columns == odd.columns
    assert jaccard.miss_rate(0.8) < 1e-6


def test_keep_one_with_null_and_repeated_ids(spark, odd):
    words = lambda k, n=30: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(1, words(1)), (None, words(1)), (None, words(2)), (None, words(3)), (None, words(3)), (None, words(4) + " a"), (None, words(4) + " b"), (5, words(5)), (5, words(6)), (5, words(6)), (0, words(7)), (8, words(7)), (8, words(8)), (9, None), (9, "")]
    for df in (spark.createDataFrame(rows, "doc_id long, text string"), odd):
        kept = [(r["doc_id"], r["text"]) for r in jaccard.keep_one(df).collect()]
        own = [(r["doc_id"], r["text"]) for r in df.collect()]
        assert not Counter(kept) - Counter(own)
        keys = [jaccard.shingles(t or "").tobytes() for _, t in kept]
        assert len(set(keys)) == len(keys)
        if df is not odd:
            # each class by the first word of its texts, with its least id
            assert sorted(((t or "").split("x")[0], str(d)) for d, t in kept) == [("", "9"), ("w1", "1"), ("w2", "None"), ("w3", "None"), ("w4", "None"), ("w5", "5"), ("w6", "5"), ("w7", "0"), ("w8", "8")]
        else:
            assert set(keys) == {jaccard.shingles(t or "").tobytes() for _, t in own}


def test_jaccard_around_a_common_passage(spark):
    """Pairs of similarity 0.83 among 4000 texts that share a passage and are 0.49 similar to all others."""
    rng = random.Random(7)
    shared = [f"p{i}" for i in range(80)]
    rows = []
    for k in range(2000):
        own = [f"w{rng.randrange(10**9)}" for _ in range(40)]
        rows.append((2 * k, " ".join(shared + own)))
        own[13], own[26], own[-1] = "x", "y", "z"
        rows.append((2 * k + 1, " ".join(shared + own)))
    sets = [set(jaccard.shingles(t).tolist()) for _, t in rows]
    passage = set.intersection(*sets)
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s - passage:
            holders[x].append(i)
    common = Counter(pair for held in holders.values() for pair in combinations(held, 2))
    similar = lambda i, j, n: 9 * (n + len(passage)) >= 4 * (len(sets[i]) + len(sets[j]))
    assert not similar(0, 2, 0) and {p for p, n in common.items() if similar(*p, n)} == {(2 * k, 2 * k + 1) for k in range(2000)}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.similar_documents(df).collect()}
    assert got == {i: (i - i % 2, 1) for i in range(4000)}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 105), (105, 101), (7, 7)], "u long, v long")
    got = {r["node"]: r["label"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 105: 100}


def test_quality_rules(spark, odd, nothing, docs):
    for df in (odd, docs):
        want = Counter()
        for d in df.collect():
            text = d["text"] or ""
            w = re.findall(r"[^\x20\x09-\x0D]+", text)
            windows = Counter(zip(w, w[1:], w[2:], strict=False))
            held = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
            lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            want[d["doc_id"], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(held), len(w) < 50 or 100 * len(held) > 50 * len(w)] += 1
        rows = quality_rules.quality_rules(df).collect()
        assert Counter(tuple(r[:7]) for r in rows) == want and not any(r["base_failed"] and r["kept"] for r in rows)
    assert quality_rules.quality_rules(nothing).count() == 0


def _ratio_docs(lang, source, ratios, start):
    """Documents of 100 words of four letters, with symbols in the given share of their characters."""
    rows = []
    for i, ratio in enumerate(ratios, start):
        words = [f"{chr(97 + k // 26)}{chr(97 + k % 26)}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for k in range(100)]
        n = round(400 * ratio)
        rows.append((i, " ".join("#" * min(4, max(0, n - 4 * k)) + w[min(4, max(0, n - 4 * k)) :] for k, w in enumerate(words)), lang, source))
    return rows


def test_quality_fences_hold_bad_groups_and_follow_quantiles(spark):
    schema = "doc_id long, text string, lang string, source string"
    third = _ratio_docs("en", "hot", [0.2 if i % 3 == 0 else 0 for i in range(300)], 0)
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(third, schema)).collect()}
    assert all(kept[i] == (i % 3 > 0) for i in range(300))
    # a source that is mostly junk, beside a clean one of its language
    most = _ratio_docs("en", "bad", [0 if i % 5 == 0 else 0.12 + i % 5 / 50 for i in range(200)], 0) + _ratio_docs("en", "good", [0] * 600, 200)
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(most, schema)).collect()}
    assert all(kept[i] == (i >= 200 or i % 5 == 0) for i in range(800))
    # a cutoff may lie under the floor, and above it: symbols of 0.0025 to 0.005 and of 0.02 to 0.06 are usual
    for usual, odd_ones in (([0.0025, 0.005], 0.07), ([0.02, 0.04, 0.06], 0.5)):
        texts = _ratio_docs("en", "s", [usual[i % len(usual)] for i in range(300)] + [odd_ones], 0)
        kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(texts, schema)).collect()}
        assert all(kept[i] == (i < 300) for i in range(301))
    texts = _ratio_docs("en", "s", [(0.02, 0.04, 0.06)[i % 3] for i in range(300)] + [0.1], 0)
    assert all(r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(texts, schema)).collect())


def test_quality_classifier(spark, odd, nothing):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8)))
    rows = [(i, " ".join(word() for _ in range(80)) if i % 4 else " ".join(["SPAM!!"] * 30 + [word()] * 20), int(i % 4 > 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = {r["doc_id"]: r["score"] for r in quality_classifier.classify(df, df).collect()}
    assert all((got[i] >= 0.3) == bool(q) for i, _, q in rows)
    assert quality_classifier.classify(odd, df).count() == odd.count() and quality_classifier.classify(nothing, df).count() == 0
    assert all(0.49 < r["score"] < 0.51 for r in quality_classifier.classify(odd, df.limit(0)).collect())
    assert quality_classifier.isotonic(np.array([1.0, 3, 2, 4]), np.ones(4)).tolist() == [1, 2.5, 2.5, 4]


def test_media(spark, odd, nothing):
    for r in media.media_report(odd.select("doc_id", "text", "score")).collect():
        own = [t for t in odd.where(F.col("doc_id").eqNullSafe(F.lit(r["doc_id"]))).collect()]
        payloads = [media.payload_of(t["text"])[1] for t in own]
        assert r["payload_sha256"] in {hashlib.sha256(p).hexdigest() for p in payloads} and r["payload_bytes"] % 64 == 0
        assert r["media_bytes"] == r["payload_bytes"] + 44
    assert media.media_report(nothing).count() == 0 and media.media_column(odd).count() == odd.count() and media.media_column(nothing).count() == 0
    assert media.segments(np.array([0, 0, 9, 5, 9, 0, 0, 0.0])) == [(2, 5)]


def test_media_frames_hold_every_sample():
    for n in (0, 1, 127, 128, 129, 160, 192, 193, 1000):
        x = np.zeros(n, np.float32)
        quiet = media.log_mel(x, 8000)
        assert len(quiet) == max(0, -(-(n - media.FRAME) // media.HOP)) + 1
        if n > 2 * media.FRAME or n in (129, 160, 193):
            x[-20:] = np.sin(np.arange(20))
            assert not np.allclose(media.log_mel(x, 8000)[-1], quiet[-1])


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id=main class="post-17 body"><h2>Head &amp; <b>line</b></h2><p>First  para<br>goes on <a title="a>b" href=x>link</a>.<p>Second<div class="ad-slot">Buy</div>
<ul><li>one<li>two</ul><script>var x="<p>no</p>";</script><form><input>Search</form></div><aside>Side</aside><section class="comments"><p>Nice!</p></section><footer>&copy; F</footer></body></html>"""


def test_html(spark, nothing):
    want = "Head & line\nFirst para goes on link.\nSecond\none\ntwo"
    rows = [(1, "http://a.org/1", PAGE), (2, "http://A.org/2", PAGE), (2, "http://A.org/2", PAGE), (3, None, None), (4, "", ""), (None, "http://b.org", "plain <text"), (5, "http://c.org", "<article><p>cut off &am")]
    df = spark.createDataFrame([(*r, "p", "t") for r in rows], "page_id long, url string, html string, path string, text string")
    got = Counter((r["page_id"], r["text"], r["n_chars"]) for r in html.extract(df).collect())
    assert got[1, want, len(want)] == 1 and got[2, want, len(want)] == 2 and got[3, "", 0] == 1 and got[4, "", 0] == 1
    assert got[None, "plain", 5] == 1 and got[5, "cut off &am", 11] == 1
    assert html.extract(df.limit(0)).count() == 0


def test_html_keeps_a_heading_outside_the_inner_container(spark):
    body = "".join(f"<p>Paragraph {i} {'of some words ' * 20}</p>" for i in range(100))
    pages = [f"<body><nav>Home</nav><div class=content><h1>Head</h1><p>Lead</p><div class=body>{body}</div></div></body>", f"<body><main><h1>Head</h1><article>{body}</article></main></body>"]
    df = spark.createDataFrame([(i, f"http://{i}.org/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"].split("\n") for r in html.extract(df).collect()}
    assert got[0][:2] == ["Head", "Lead"] and len(got[0]) == 102 and got[1][0] == "Head" and len(got[1]) == 101
    page = html.Page("<body><div class=a><div class=b><p>same text</p></div></div></body>")
    assert page.paths[page.best()].endswith("div.b")


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in step.collect()}
        step = stage(spark, step, SF)
        assert step.columns == docs.columns
        after = {r["doc_id"]: r["text"] for r in step.collect()}
        assert set(after) <= set(before) and len(after) > 0.5 * len(before), name
        if name == "n-gram Jaccard join":
            assert len(after) == len({c for _, c, _ in _classes(sorted(before.items()))})
        if name == "PII":
            assert not any(_pii(t) for t in after.values())
        step = spark.createDataFrame(step.collect(), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, step, SF)
    assert {r["doc_id"] for r in packed.collect()} == set(after)
