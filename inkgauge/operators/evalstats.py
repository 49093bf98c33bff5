"""Evaluation: AUROC, thresholds, sign tests, rollups, audits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgauge.functions import patterns as P
from inkgauge.functions import textkit as T
from inkgauge.operators.quantiles import group_quantiles


def auroc(df: DataFrame, positive: str, score: str, by: str | None = None) -> DataFrame:
    """(by, n_pos, n_neg, auroc): chance that a positive scores below a negative, ties half; 0.5 without either.

    Counts per distinct score come first, so the running sum sorts scores, not
    rows; no pair is formed.
    """
    keys = [by] if by else []
    c = df.where(F.col(score).isNotNull() & F.col(positive).isNotNull()).groupBy(*keys, score).agg(F.sum(F.when(F.col(positive), 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(positive), 0).otherwise(1)).alias("q"))
    return auroc_of_counts(c, by, score)


def auroc_of_counts(counts: DataFrame, by: str | list[str] | None, score: str) -> DataFrame:
    """auroc() of rows (by, score, p, q): how many positives and negatives have a score."""
    keys = by if isinstance(by, list) else [by] if by else []
    c = counts.groupBy(*keys, score).agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    w = Window.partitionBy(*keys).orderBy(score)
    c = c.withColumn("below", F.sum("p").over(w) - F.col("p"))
    a = c.groupBy(*keys).agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.sum(F.col("q") * (F.col("below") + F.col("p") * 0.5)).alias("wins"))
    return a.select(*keys, "n_pos", "n_neg", F.coalesce(F.try_divide(F.col("wins"), F.col("n_pos") * F.col("n_neg")), F.lit(0.5)).alias("auroc"))


def detector_threshold(df: DataFrame, machine: str, score: str, by: str, fpr: float = 0.01, least: int = 3) -> DataFrame:
    """Per group: the direction that separates, the cut at a low quantile of human scores, means and deviations."""
    x = df.where(F.col(score).isNotNull())
    human, ai = F.when(~F.col(machine), F.col(score)), F.when(F.col(machine), F.col(score))
    s = x.groupBy(by).agg(
        F.count(human).alias("n_human"), F.count(ai).alias("n_ai"), F.avg(human).alias("hm"), F.coalesce(F.stddev_samp(human), F.lit(0.0)).alias("hs"), F.avg(ai).alias("am"), F.coalesce(F.stddev_samp(ai), F.lit(0.0)).alias("as_"),
    ).where((F.col("n_human") >= least) & (F.col("n_ai") >= least))
    cut = group_quantiles(x.select(by, human.alias("h")), [by], {"low": ("h", "even", fpr), "high": ("h", "even", 1 - fpr)})
    s = s.join(cut, by)
    s = s.join(auroc(x, machine, score, by).select(by, "auroc"), by)
    low = F.col("auroc") >= 0.5
    # scores have few decimals, so means may lie on a half: 12 places first, or the order of summing decides
    steady = lambda c: F.round(F.round(c, 12), 5)
    return s.select(by, "n_human", "n_ai", F.round(F.when(low, F.col("low")).otherwise(F.col("high")), 5).alias("threshold"), F.when(low, "low_is_machine").otherwise("high_is_machine").alias("direction"), F.round(F.greatest("auroc", 1 - F.col("auroc")), 4).alias("auroc"), steady("hm").alias("human_mean"), steady("hs").alias("human_stdev"), steady("am").alias("ai_mean"), steady("as_").alias("ai_stdev"))


def detector_label(score: Column, n_tokens: Column, threshold: Column, direction: Column, least: int = 48) -> Column:
    machine = F.when(direction == "high_is_machine", score > threshold).otherwise(score < threshold)
    return F.when((n_tokens < least) | score.isNull() | F.isnan(score) | threshold.isNull(), "uncertain").when(machine, "machine").otherwise("human")


def _log_comb(n: Column, k: Column) -> Column:
    """log of n over k as a sum of logs."""
    i = F.sequence(F.lit(1), F.greatest(k, F.lit(1)))
    s = F.aggregate(i, F.lit(0.0), lambda a, j: a + F.log((n - k + j).cast("double")) - F.log(j.cast("double")))
    return F.when(k > 0, s).otherwise(F.lit(0.0))


def sign_p(wins: Column, n: Column) -> Column:
    """Exact two-sided p of ``wins`` of n; 1 without any."""
    k = F.least(wins, n - wins).cast("int")
    tail = F.aggregate(F.sequence(F.lit(0), k), F.lit(0.0), lambda a, j: a + F.exp(_log_comb(n.cast("int"), j) - n * math.log(2)))
    return F.when(n > 0, F.least(F.lit(1.0), tail * 2)).otherwise(F.lit(1.0))


def sign_test(deltas: DataFrame, by: list[str], delta: str = "delta") -> DataFrame:
    """(by, improved, n, p): negative deltas are improvements, ties count against."""
    x = deltas.where(F.col(delta).isNotNull()).groupBy(*by).agg(F.sum(F.when(F.col(delta) < 0, 1).otherwise(0)).alias("improved"), F.count("*").alias("n"))
    return x.select(*by, "improved", "n", sign_p(F.col("improved"), F.col("n")).alias("p"))


def purity_metrics(t: Column) -> dict[str, Column]:
    n = F.greatest(F.size(T.words_ascii(t)), F.lit(1))
    sents = F.filter(F.transform(F.split(t, P.SENTENCE_GAP), lambda s: F.size(T.words_ascii(s))), lambda v: v > 0)
    paras = F.transform(F.filter(F.split(t, P.PARAGRAPH_GAP), lambda p: T.strip(p) != ""), lambda p: F.size(T.words_ascii(p)))
    cv = lambda a: F.coalesce(F.try_divide(T.stdev(a), T.mean(a)), F.lit(0.0))
    dashes = T.count(t, "—") + T.count(t, "--")
    return {
        "emdash_per_100w": dashes * 100.0 / n,
        "md_structure_per_1kw": (T.count(t, P.BOLD_HEADER) + T.count(t, P.BULLET)) * 1000.0 / n,
        "tricolon_per_1kw": T.count(t, P.TRICOLON) * 1000.0 / n,
        "para_cv": cv(paras),
        "sent_cv": cv(sents),
        "placeholders": T.count(t, P.PLACEHOLDER),
    }


def purity_outliers(pieces: DataFrame, key: str, by: str = "voice", text: str = "text", top: int = 6, min_words: int = 200, min_pieces: int = 8) -> DataFrame:
    """(by, key, suspicion, rank): the pieces of each voice that stand out most the suspicious way."""
    t = F.col(text)
    x = pieces.where(F.col(by).isNotNull() & t.isNotNull()).where(F.size(T.words_ascii(t)) >= min_words)
    x = x.select(by, key, *(c.alias(k) for k, c in purity_metrics(t).items()))
    s = x.groupBy(by).agg(F.count("*").alias("n__"), *(F.avg(k).alias(f"{k}__m") for k in P.PURITY), *(F.coalesce(F.stddev_samp(k), F.lit(0.0)).alias(f"{k}__s") for k in P.PURITY)).where(F.col("n__") >= min_pieces)
    x = x.join(s, by)
    susp = F.col("placeholders") * 10.0
    for k, d in P.PURITY.items():
        susp = susp + F.greatest(F.lit(0.0), F.when(F.col(f"{k}__s") > 1e-9, (F.col(k) - F.col(f"{k}__m")) / F.col(f"{k}__s")).otherwise(F.lit(0.0)) * d)
    x = x.select(by, key, susp.alias("suspicion"))
    w = Window.partitionBy(by).orderBy(F.round("suspicion", 9).desc(), key)
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def cluster_pick(units: DataFrame, features: tuple[str, ...], key: str, k: int = 4, take: int = 5, least: int = 3, seed: int = 1) -> DataFrame:
    """(key, distance): of the k-means clusters in z-space (least members or more) the one farthest from the centre, its nearest units."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    z = units.select(key, F.array(*(F.col(f"{f}__z") for f in features)).alias("z")).withColumn("v", array_to_vector("z"))
    model = KMeans(k=k, seed=seed, featuresCol="v", predictionCol="c").fit(z)
    far = sorted(((sum(x * x for x in c), i) for i, c in enumerate(model.clusterCenters())), reverse=True)
    sizes = {r["c"]: r["n"] for r in model.transform(z).groupBy("c").agg(F.count("*").alias("n")).collect()}  # k rows
    pick = next((i for _, i in far if sizes.get(i, 0) >= least), far[0][1])
    centre = F.array(*(F.lit(float(x)) for x in model.clusterCenters()[pick]))
    d = F.sqrt(F.aggregate(F.zip_with(vector_to_array("v"), centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v))
    return z.select(key, d.alias("distance")).orderBy("distance", key).limit(take)
