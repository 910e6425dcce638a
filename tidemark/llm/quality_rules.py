"""Quality rules whose cutoffs adapt to language and source.

Statistics of each document are column expressions. Mergeable quantile sketches (the ones behind
``approx_percentile``, merged map-side first) give each (language, source), each language and the corpus
a lower quartile and a median, from which a fence follows for each statistic: the median plus a multiple of
the spread below it, which outliers reach only where they are half of the group. The fence of a group is
capped by its language's, that of a language, for ratios, by the corpus's, so a mostly bad group switches
no rule off. FLOORS decide where the quartiles show no spread; elsewhere a cutoff may lie above a floor or
under it, down to LEAST of it. Small groups take the fence of their language. The fences are joined back to
the statistics, not to the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged

#: Groups with fewer documents take the fences of their language.
MIN_GROUP = 100
#: Spreads beyond the upper quartile (for an even distribution) at which a statistic counts as an outlier.
REACH = 6.0
#: Statistics and their least cutoff where the quartiles show no spread; the share of it that a cutoff has elsewhere at least.
FLOORS = {"symbol_ratio": 0.08, "dup_line_ratio": 0.3, "repeat_ratio": 0.3, "mean_word": 14.0}
LEAST = 0.5
#: Statistics that mean the same in every language; the length of words depends on the script.
RATIOS = ("symbol_ratio", "dup_line_ratio", "repeat_ratio")
#: Accuracy of the sketches: ranks are off by one in this many at most.
ACCURACY = 5000

_SPACE = "[\\x20\\x09-\\x0D]+"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words that lie in three-word windows found twice or more, the first finding included."""
    n = F.size(words)
    windows = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    )

    def count(h: Column) -> Column:
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = lambda s: F.filter(
            s,
            lambda e, k: (F.coalesce(F.get(s, k - 1)["x"] == e["x"], F.lit(False))) | (F.coalesce(F.get(s, k + 1)["x"] == e["x"], F.lit(False))),
        )
        at = _bound(ranked, lambda s: F.sort_array(F.transform(twice(s), lambda e: e["i"])))
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last"))
        covered = F.aggregate(at, start, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered)

    return _bound(windows, count)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of statistics for each document; a null text has no words. Null language and source are groups of their own."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, _SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def own(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).alias("n_repeat_words"))

    by_line = _bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long")
    df = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col("lang").alias("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang"),
        F.col("source").alias("source") if "source" in docs.columns else F.lit(None).cast("string").alias("source"),
        _bound(words, own).alias("w"),
        by_line.alias("l"),
        symbols.alias("n_symbols"),
    )
    return df.select("doc_id", "lang", "source", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "l.n_lines", "w.n_repeat_words")


def _ratios(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "symbol_ratio": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_ratio": F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)),
        "mean_word": F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
    })


def _fences(stats: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """Group size and fence of each statistic, for each value of the keys."""
    sketches = [F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5)), ACCURACY).alias(f"q_{c}") for c in FLOORS]
    df = stats.groupBy(*[F.col(k).alias(f"{tag}_{k}") for k in keys]).agg(F.count("*").alias(f"{tag}_n"), *sketches)

    def fence(c: str, floor: float) -> Column:
        low, mid = F.get(F.col(f"q_{c}"), F.lit(0)), F.get(F.col(f"q_{c}"), F.lit(1))
        # as far out as the upper quartile plus REACH quartile distances where both halves are alike
        return F.greatest(mid + (2 * REACH + 1) * (mid - low), F.when(mid > low, LEAST * floor).otherwise(floor))

    return df.select(*[f"{tag}_{k}" for k in keys], f"{tag}_n", *[fence(c, floor).alias(f"{tag}_{c}") for c, floor in FLOORS.items()])


def judge(stats: DataFrame) -> DataFrame:
    """Add ``base_failed`` and ``kept`` to rows of ``statistics``."""
    stats = _ratios(stats)
    own, lang, corpus = _fences(stats, ["lang", "source"], "g"), _fences(stats, ["lang"], "l"), _fences(stats, [], "c")
    df = stats.join(own, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    df = df.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")), "left").crossJoin(F.broadcast(corpus))
    outlier = F.lit(False)
    for c in FLOORS:
        wide = F.least(f"l_{c}", f"c_{c}") if c in RATIOS else F.col(f"l_{c}")
        outlier = outlier | (F.col(c) > F.when(F.col("g_n") >= MIN_GROUP, F.least(F.col(f"g_{c}"), wide)).otherwise(wide))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", base).withColumn("kept", ~base & ~F.coalesce(outlier, F.lit(False)))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics and verdict of each document.

    The statistics are written once into the shared folder: sketches and verdicts read that small table.
    Repeated rows each get their row; an empty table gives none.
    """
    stats = staged(statistics(docs, id_col, text_col), "quality_rules")
    return judge(stats).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
