"""Surface and cadence features of each text, as columns over arrays; no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.functions import patterns as P
from inkgauge.functions import textkit as T


def prepared(df: DataFrame, text: str = "text") -> DataFrame:
    """Arrays every feature shares: words, sentences, their lengths, paragraphs.

    They are written out once per row (one projection), not once per feature.
    A null text has null arrays and, below, null features.
    """
    c = F.col(text)
    x = df.withColumns({"_w": T.words_ascii(c), "_s": T.sentences(c), "_p": T.paragraphs(c)})
    return x.withColumns({"_l": F.transform("_s", lambda s: F.size(T.words_ascii(s))), "_pl": F.transform("_p", lambda p: F.transform(T.sentences(p), lambda s: F.size(T.words_ascii(s))))})


def surface_columns(text: str = "text") -> dict[str, Column]:
    """The 13 surface features over prepared(); all 0 without a sentence or with fewer than 20 words."""
    t, w, s, lens = F.col(text), F.col("_w"), F.col("_s"), F.col("_l")
    per100 = F.lit(100.0) / F.size(w)
    n = F.size(s)
    window = F.slice(w, 1, P.TTR_WINDOW)
    paras = F.transform("_pl", lambda p: F.size(p))
    raw = {
        "sent_len_mean": T.mean(lens),
        "sent_len_stdev": T.stdev(lens),
        "pct_short_sents": T.share(lens, lambda x: x < 8),
        "pct_long_sents": T.share(lens, lambda x: x > 30),
        "colons_per_100w": T.count(t, ":") * per100,
        "semicolons_per_100w": T.count(t, ";") * per100,
        "emdash_per_100w": T.count(F.regexp_replace(t, P.RULE_LINE, ""), P.DASH_RUN) * per100,
        "question_rate": T.share(s, lambda x: x.endswith("?")),
        "commas_per_sent": T.count(t, ",") / n,
        "para_len_mean": F.coalesce(T.mean(paras), n.cast("double")),
        "first_person_openers": T.share(s, lambda x: x.rlike(P.FIRST_PERSON)),
        "ttr": F.size(F.array_distinct(F.transform(window, F.lower))) / F.size(window),
        "word_len_mean": T.mean(F.transform(w, F.length)),
    }
    ok = (n > 0) & (F.size(w) >= 20)
    return {k: F.when(t.isNull(), None).when(ok, raw[k]).otherwise(F.lit(0.0)) for k in P.SURFACE}


def cadence_prepared(df: DataFrame, lo: Column | float = P.DEFAULT_CUTS[0], hi: Column | float = P.DEFAULT_CUTS[1]) -> DataFrame:
    """prepared() with the arrays of the cadence features, each written out once before what builds on it."""
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    x = df.withColumn("_x", F.filter("_l", lambda v: v > 0))
    x = x.withColumn("_m", T.mean(F.col("_x")))
    x = x.withColumns(
        {
            "_dev": F.transform("_x", lambda v: v - F.col("_m")),
            "_delta": T.adjacent(F.col("_x"), lambda a, b: (b - a).cast("double")),
            "_cls": F.transform("_x", lambda v: F.when(v <= lo, 0).when(v > hi, 2).otherwise(1)),
            "_paras": F.filter("_pl", lambda p: F.size(p) > 0),
            "_clauses": F.filter(F.transform("_s", lambda s: F.filter(F.transform(F.split(s, "[,;:]"), lambda c: F.size(T.words_ascii(c))), lambda v: v > 0)), lambda a: F.size(a) > 0),
        }
    )
    return x.withColumns(
        {
            "_var": F.aggregate("_dev", F.lit(0.0), lambda a, v: a + v * v),
            "_sign": F.filter(F.transform("_delta", F.signum), lambda v: v != 0),
            "_step": T.adjacent(F.col("_cls"), lambda a, b: a * 3 + b),
            "_cl": F.flatten("_clauses"),
        }
    )


def cadence_columns(text: str = "text") -> dict[str, Column]:
    """The 13 cadence features over cadence_prepared(); all 0 with fewer than four sentences that have a word."""
    x, m, dev, var, delta = (F.col(c) for c in ("_x", "_m", "_dev", "_var", "_delta"))
    sign, step, paras, clauses, clause_lens = (F.col(c) for c in ("_sign", "_step", "_paras", "_clauses", "_cl"))
    n, zero = F.size(x), F.lit(0.0)
    flips = F.size(F.filter(T.adjacent(sign, lambda a, b: a != b), lambda v: v))
    changes = F.size(F.filter(step, lambda v: (v % 4) != 0))  # equal classes are steps 0, 4 and 8

    def term(code):
        p = F.size(F.filter(step, lambda v: v == code)) / F.nullif(F.size(step), F.lit(0))
        return F.when(p > 0, -p * F.log2(p)).otherwise(zero)

    def autocorr(lag):
        cov = F.aggregate(T.adjacent(dev, lambda a, b: a * b, lag), zero, lambda a, v: a + v)
        return F.when((n > lag + 1) & (var > 1e-9), cov / var).otherwise(zero)

    raw = {
        "sl_autocorr1": autocorr(1),
        "sl_autocorr2": autocorr(2),
        "sl_delta_abs": T.mean(F.transform(delta, F.abs)) / m,
        "sl_delta_sd": T.stdev(delta) / m,
        "sl_dir_changes": F.when(F.size(sign) > 1, flips / (F.size(sign) - 1)).otherwise(zero),
        "sl_run_mean": n / (changes + 1),
        "sl_trans_entropy": F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(8)), term), zero, lambda a, v: a + v),
        "sl_short_after_long": F.coalesce(T.share(F.filter(step, lambda v: v >= 6), lambda v: v == 6), zero),
        "para_open_ratio": F.coalesce(T.mean(F.transform(paras, lambda p: F.element_at(p, 1))) / m, zero),
        "para_close_ratio": F.coalesce(T.mean(F.transform(paras, lambda p: F.element_at(p, -1))) / m, zero),
        "clause_len_mean": F.coalesce(T.mean(clause_lens), zero),
        "clause_len_cv": F.coalesce(T.stdev(clause_lens) / T.mean(clause_lens), zero),
        "clause_per_sent": F.coalesce(T.mean(F.transform(clauses, F.size)), zero),
    }
    return {k: F.when(F.col(text).isNull(), None).when(n >= 4, raw[k]).otherwise(zero) for k in P.CADENCE}


def with_features(df: DataFrame, text: str = "text", cadence: bool = False, lo: Column | float = P.DEFAULT_CUTS[0], hi: Column | float = P.DEFAULT_CUTS[1]) -> DataFrame:
    """df with the surface (and cadence) features and n_words; null texts have null features and 0 words."""
    keep = df.columns
    cols = surface_columns(text) | (cadence_columns(text) if cadence else {})
    n = F.coalesce(F.size("_w"), F.lit(0)).alias("n_words")
    x = prepared(df, text)
    return (cadence_prepared(x, lo, hi) if cadence else x).select(*(F.col(f"`{c}`") for c in keep), n, *(c.alias(k) for k, c in cols.items()))


def sentence_cuts(df: DataFrame, by: str = "voice", text: str = "text") -> DataFrame:
    """(by, lo, hi): terciles of the pooled positive sentence lengths; the defaults below ten lengths."""
    lens = T.exploded(df.where(F.col(text).isNotNull()), [by], F.transform(T.sentences(F.col(text)), lambda s: F.size(T.words_ascii(s))), "n").where("n > 0")
    few = F.count("*") < 10
    cut = lambda p, d: F.when(few, F.lit(d)).otherwise(T.pct_linear(F.col("n"), p))
    return lens.groupBy(by).agg(cut(1 / 3, P.DEFAULT_CUTS[0]).alias("lo"), cut(2 / 3, P.DEFAULT_CUTS[1]).alias("hi"))


def unpivoted(df: DataFrame, ids: list[str], features: tuple[str, ...]) -> DataFrame:
    """(ids, feature, idx, x), one row per feature."""
    rows = F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(i).alias("idx"), F.col(f).alias("x")) for i, f in enumerate(features)))
    return df.select(*ids, F.explode(rows).alias("z")).select(*ids, "z.feature", "z.idx", "z.x")
