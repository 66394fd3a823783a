"""Quality rules with adaptive thresholds.

Every document gets a handful of integer metrics (mean word length, symbol, punctuation,
capital, duplicate-line and repeated-window shares). The metrics of all documents are
gathered in mergeable quantile sketches, one per (language, source, metric): a sketch is a
set of (bucket, count) rows whose buckets keep the ``MANTISSA`` leading bits of the value, so
a quantile is exact below 2**MANTISSA and within a relative 2**(1-MANTISSA) above. Merging
is adding counts, hence independent of partitioning and repeatable after a lost executor; the
sketches of a language, and of the corpus, are merged from those of its sources.

The upper fence of a metric is ``median + WIDTH * max(q75 - median, spread floor)``; mean word
length also has a lower fence, from ``median - q25``. A source with fewer than ``MIN_ROWS``
documents takes the fences of its language, and a language with fewer those of the corpus.
The fences are joined back to the documents, which are kept when no fence and no base rule is
broken.

Only DataFrame functions run here. Defined cases: null and empty text have no words, so the
base rule rejects them; null language or source form groups of their own; repeated rows are
judged one by one; an empty table gives an empty result; columns beyond doc_id, text, lang
and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW_WORDS = 5
MANTISSA = 6
WIDTH = 5
MIN_ROWS = 100

# Metric -> least spread that counts, in the metric's own unit.
SPREAD = {
    "word_length": 60,  # code points per 100 words
    "symbols": 40,  # per 1000 words
    "punctuation": 60,  # per 1000 words
    "capitals": 40,  # per 1000 word code points
    "dup_lines": 60,  # per 1000 lines with a word
    "repeats": 40,  # words in repeated windows per 1000 words
}
LOWER = ("word_length",)

_WORD = r"[^\x20\x09-\x0D]+"
_GAP = r"[\x20\x09-\x0D]+"


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts and the metrics of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", "lang", "source", text.alias("text")).select(
        "doc_id", "lang", "source",
        F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(_WORD)).alias("lines"),
        F.char_length(F.regexp_replace("text", _GAP, "")).alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).alias("n_symbols"),
        F.char_length(F.regexp_replace("text", r"[\p{L}\p{N}\x20\x09-\x0D]+", "")).alias("n_punct"),
        F.char_length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).alias("n_capital"),
    )
    last = F.size("words") - WINDOW_WORDS
    windows = F.when(last >= 0, F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(WINDOW_WORDS))),
    )).otherwise(F.array().cast("array<bigint>"))
    counted = split.select(
        "doc_id", "lang", "source", "word_chars", "n_symbols", "n_punct", "n_capital",
        F.size("words").alias("n_words"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        windows.alias("windows"),
    )
    # Windows sorted by hash: equal neighbours are the windows found more than once.
    placed = counted.withColumn("sorted", F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )).drop("windows")
    twice = F.array_sort(F.transform(
        F.filter("sorted", lambda x, j: (x["h"] == F.get("sorted", j - 1)["h"]).eqNullSafe(True)
                 | (x["h"] == F.get("sorted", j + 1)["h"]).eqNullSafe(True)),
        lambda x: x["i"],
    ))
    covered = F.aggregate(
        F.transform("twice", lambda i, j: F.least(
            F.lit(WINDOW_WORDS), F.coalesce(F.get("twice", j + 1) - i, F.lit(WINDOW_WORDS)))),
        F.lit(0), lambda a, x: a + x,
    )
    base = placed.withColumn("twice", twice).select(
        "doc_id", "lang", "source",
        *(F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        *(F.col(c).cast("long").alias(c) for c in ("n_lines", "n_punct", "n_capital")),
    )
    share = lambda a, b, k: F.expr(f"CASE WHEN {b} > 0 THEN {k} * {a} div {b} END")
    return base.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS)
         | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        share("word_chars", "n_words", 100).alias("word_length"),
        share("n_symbols", "n_words", 1000).alias("symbols"),
        share("n_punct", "n_words", 1000).alias("punctuation"),
        share("n_capital", "word_chars", 1000).alias("capitals"),
        share("n_dup_lines", "n_lines", 1000).alias("dup_lines"),
        share("n_repeat_words", "n_words", 1000).alias("repeats"),
    )


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, level, metric, bucket, n): the quantile sketch of every source, of every
    language (level 1) and of the corpus (level 2). Documents that the base rules reject don't
    count. One row per bucket leaves each task; higher levels merge these rows."""
    values = measured.where(~F.col("base_failed")).select(
        "lang", "source",
        F.posexplode(F.array(*SPREAD)).alias("metric", "value"),
    )
    drop = f"greatest(0, char_length(bin(value)) - {MANTISSA})"
    by_source = values.where("value IS NOT NULL").groupBy(
        "lang", "source", "metric",
        F.expr(f"shiftleft(shiftright(value, {drop}), {drop})").alias("bucket"),
    ).agg(F.count(F.lit(1)).alias("n"))
    return by_source.rollup("metric", "bucket", "lang", "source").agg(
        F.sum("n").alias("n"), F.grouping_id().alias("gid"),
    ).where("gid IN (0, 1, 3)").select(
        "lang", "source", F.expr("CASE gid WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END").alias("level"),
        "metric", "bucket", "n",
    )


def fences(sketch: DataFrame) -> DataFrame:
    """(lang, source, level, rows, low_*, high_*): one row per sketch group. The windows hold
    the buckets of one sketch, whose number is bounded by the sketch's resolution."""
    group = Window.partitionBy("lang", "source", "level", "metric")
    ranked = sketch.select(
        "*", F.sum("n").over(group).alias("total"),
        F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("below"),
    )
    at = lambda p: F.min(F.when(F.col("below") * 100 >= F.col("total") * p, F.col("bucket")))
    cut = ranked.groupBy("lang", "source", "level", "metric").agg(
        at(25).alias("q25"), at(50).alias("q50"), at(75).alias("q75"), F.max("total").alias("total"))
    spread = F.element_at(F.create_map(*(F.lit(x) for k, v in enumerate(SPREAD.values()) for x in (k, v))), F.col("metric"))
    cut = cut.select(
        "lang", "source", "level", "metric", "total",
        (F.col("q50") - WIDTH * F.greatest(F.col("q50") - F.col("q25"), spread)).alias("low"),
        (F.col("q50") + WIDTH * F.greatest(F.col("q75") - F.col("q50"), spread)).alias("high"),
    )
    pick = lambda c, k: F.max(F.when(F.col("metric") == k, F.col(c)))
    return cut.groupBy("lang", "source", "level").agg(
        F.max("total").alias("rows"),
        *(pick("high", k).alias(f"high_{m}") for k, m in enumerate(SPREAD)),
        *(pick("low", k).alias(f"low_{m}") for k, m in enumerate(SPREAD) if m in LOWER),
    )


def thresholds(measured: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """One row per (lang, source) of ``measured``, with the fences that hold for it."""
    cuts = cut_lineage(fences(sketches(measured)))
    names = [c for c in cuts.columns if c.startswith(("high_", "low_"))]
    groups = measured.select("lang", "source").distinct()

    def level(k: int, keys: list[str]) -> DataFrame:
        own = cuts.where(F.col("level") == k)
        return own.select(*(F.col(c).alias(f"{c}_{k}") for c in keys), F.col("rows").alias(f"rows_{k}"),
                          *(F.col(c).alias(f"{c}_{k}") for c in names))

    held = (
        groups.join(level(0, ["lang", "source"]), F.col("lang").eqNullSafe(F.col("lang_0")) & F.col("source").eqNullSafe(F.col("source_0")), "left")
        .join(level(1, ["lang"]), F.col("lang").eqNullSafe(F.col("lang_1")), "left")
    )
    corpus = cuts.where("level = 2").first()  # one row, or none for an empty table
    held = held.withColumns({f"{c}_2": F.lit(corpus[c] if corpus else None).cast("long") for c in names})
    take = lambda c: F.when(F.col("rows_0") >= min_rows, F.col(f"{c}_0")).when(
        F.col("rows_1") >= min_rows, F.col(f"{c}_1")).otherwise(F.col(f"{c}_2"))
    return held.select("lang", "source", *(take(c).alias(c) for c in names))


def quality_rules(docs: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """Base counts, ``base_failed``, ``broken`` (names of the broken fences) and ``kept``."""
    measured = cut_lineage(measure(docs))
    cuts = thresholds(measured, min_rows).select(
        F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), "*").drop("lang", "source")
    joined = measured.join(
        cuts, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    broken = [F.when(F.col(m) > F.col(f"high_{m}"), F.lit(m)) for m in SPREAD]
    broken += [F.when(F.col(m) < F.col(f"low_{m}"), F.lit(f"low_{m}")) for m in LOWER]
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.concat_ws(",", *broken).alias("broken"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("broken") == ""))
