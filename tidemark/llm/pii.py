"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

All of it is column expressions (Java regular expressions and array functions). Positions come from
splitting the text at the pattern's matches: the lengths of gaps and matches add up to offsets, in code
points. Quantifiers are possessive and starts are anchored at the edge of a run, so that no text, however
long, makes the matcher backtrack or recurse.

The base kinds (email, ip, card, phone) are fixed by pattern and check alone; context raises or lowers
their score but never drops them. The further kinds (iban, ssn, key, secret, birth) need a score of ``THRESHOLD``:
words for it lift an uncertain match over it, words against it take a confirmed one back.

Gaps and matches are walked in chunks, so that the work of a text is nearly in proportion to its length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh

#: Least score of a span of a further kind.
THRESHOLD = 0.6
#: Code points before a span in which context words count; they reach back to the start of the match before at most.
CONTEXT = 40
#: Matches that one walk appends to an array; arrays of walks are joined at the end.
CHUNK = 128

_LOCAL = "[A-Za-z0-9._%+-]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _mod97(m: Column) -> Column:
    """ISO 7064 check of an account number: letters count as 10 to 35, the remainder must be 1."""
    plain = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    return (
        F.aggregate(
            F.split(turned, ""),
            F.lit(0),
            lambda acc, ch: F.when(ch.between("0", "9"), (acc * 10 + ch.cast("int")) % 97)
            .when(ch == "", acc)
            .otherwise((acc * 100 + F.ascii(ch) - 55) % 97),
        )
        == 1
    )


@dataclass(frozen=True)
class Kind:
    """A kind of span: a pattern, a cheap test of the text, a check of the match and words of its context."""

    name: str
    pattern: str
    quick: str
    check: object
    score: float
    for_it: str
    against: str = ""


KINDS = [
    Kind(
        "email",
        rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@",
        lambda m: F.lit(True),
        0.8,
        "mail|contact|write|kontakt|correo",
    ),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", ".", lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), 0.6, r"\bip\b|host|server|address", "version|release"),
    Kind(
        "card",
        r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
        "",
        lambda m: F.call_function("luhn_check", _digits(m)),
        0.7,
        "card|visa|master|pay|karte|tarjeta|carte",
        "order|isbn|serial",
    ),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", lambda m: F.length(_digits(m)).between(9, 15), 0.7, "phone|call|tel|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,3})?+)(?![A-Za-z0-9])", "", _mod97, 0.7, "iban|account|bank|konto", r"\b(?:example|sample|dummy|invalid|isbn|serial)\b"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "-", lambda m: F.lit(True), 0.4, r"\bssn\b|social security|tax id", "part|order|serial"),
    Kind("key", r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk[-_][A-Za-z0-9_-]{20,64}+)(?![A-Za-z0-9_-])", "", lambda m: F.lit(True), 0.7, "key|secret|token|password", r"\b(?:example|sample|dummy|placeholder)\b"),
    Kind("secret", r'(?i)(?<![a-z0-9_])(?:token|secret|password|passwd|api[_-]?key)\x20{0,3}+[=:]\x20{0,3}+"[^"\s]{12,200}+"', '"', lambda m: F.lit(True), 0.7, "key|login|auth|config", r"\b(?:example|sample|dummy|placeholder)\b"),
    Kind("birth", r"(?<![0-9-])(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9-])", "-", lambda m: m.try_cast("date").isNotNull(), 0.4, r"\bborn\b|birth|\bdob\b", "release|version"),
]
BASE = ("email", "ip", "card", "phone")


_SPAN = "struct<start:int,ord:int,end:int,score:double>"


def _spans_of(text: Column, kind: Kind, order: int) -> Column:
    """The kind's confirmed spans as structs (start, ord, end, score), in order of start."""
    empty = F.array().cast(f"array<{_SPAN}>")
    gaps, matches = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))

    def near(gap: Column, before: Column) -> Column:
        return F.lower(F.right(F.concat(F.coalesce(before, F.lit("")), gap), F.lit(CONTEXT)))

    def piece(found: Column) -> Column:
        return F.transform(
            found["gaps"],
            lambda gap, i: F.struct(
                F.length(gap).alias("gap"),
                F.coalesce(F.length(F.get(found["matches"], i)), F.lit(0)).alias("n"),
                F.get(found["matches"], i).alias("m"),
                near(gap, F.get(found["matches"], i - 1)).alias("near"),
            ),
        )

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["gap"]
        score = F.lit(kind.score) + F.when(x["near"].rlike(kind.for_it), 0.2).otherwise(0.0)
        if kind.against:
            score = score - F.when(x["near"].rlike(kind.against), 0.2).otherwise(0.0)
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), (start + x["n"]).alias("end"), F.round(score, 2).alias("score"))
        ok = x["m"].isNotNull() & F.coalesce(kind.check(x["m"]), F.lit(False))
        return F.struct((start + x["n"]).alias("pos"), F.when(ok, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def chunk(pieces: Column, i: Column) -> Column:
        return F.aggregate(F.slice(pieces, i * CHUNK + 1, F.lit(CHUNK)), F.struct(F.lit(0).alias("pos"), empty.alias("out")), step)

    def shifted(acc: Column, c: Column) -> Column:
        moved = F.transform(c["out"], lambda s: F.struct((s["start"] + acc["pos"]).alias("start"), s["ord"].alias("ord"), (s["end"] + acc["pos"]).alias("end"), s["score"].alias("score")))
        return F.struct((acc["pos"] + c["pos"]).alias("pos"), F.concat(acc["out"], F.array(moved)).alias("out"))

    def spans(pieces: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / CHUNK).cast("int")), lambda i: chunk(pieces, i))
        return F.flatten(F.aggregate(chunks, F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<array<{_SPAN}>>").alias("out")), shifted, lambda acc: acc["out"]))

    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  the value is computed once
    found = once(F.struct(gaps.alias("gaps"), matches.alias("matches")), lambda f: once(piece(f), spans))
    if kind.name not in BASE:
        found = F.filter(found, lambda s: s["score"] >= THRESHOLD)
    wanted = text.rlike(kind.pattern)
    if kind.quick:
        wanted = text.contains(kind.quick) & wanted
    return F.when(wanted, found).otherwise(empty)


def with_spans(df: DataFrame, text_col: str = "text", out: str = "pii_spans") -> DataFrame:
    """Add ``out``: an array of structs (start, ord, end, score) by start, kind, end; ``ord`` indexes KINDS.

    Null and empty texts have no spans. A column of the name ``out`` is replaced; others are kept.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumn(out, F.array_sort(F.concat(*[_spans_of(text, k, i) for i, k in enumerate(KINDS)])))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["ord"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scores_text(spans: Column) -> Column:
    """The spans' scores in their order, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.format_number(s["score"], 2)), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first names the whole."""
    names = F.array(*[F.lit(f"[{k.name.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.array(F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]), F.get(names, s["ord"])))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(s["start"] >= acc["pos"], fresh).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["pos"] + 1, 2_147_483_647)))
    return F.when(F.size(spans) == 0, text).otherwise(done)


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, spans and their scores of each document.

    Null and empty texts have no spans, texts of any length are read whole; null ids and repeated rows pass
    through as they are; other columns are not read; an empty table gives no rows.
    """
    df = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    spans = F.col("pii_spans")
    base = F.filter(spans, lambda s: s["ord"] < len(BASE))

    def count(order: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["ord"] == order)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(BASE)]
    return df.select("doc_id", *counts, F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(spans).alias("spans"), scores_text(spans).alias("scores"))


def redact_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with personal data replaced in ``text_col``; ``n_chars``, where there is one, follows.

    Null texts stay null. All rows and columns stay, whatever their names; an empty table gives no rows.
    """
    spans = fresh(docs, "_pii_spans")
    df = with_spans(docs, text_col, spans)
    df = df.withColumn(text_col, redacted(F.col(text_col), F.col(spans))).drop(spans)
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.coalesce(F.length(text_col), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return df.select(*docs.columns)
