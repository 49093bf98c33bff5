"""Fingerprints per voice, winsorised distances, leave-one-out baselines, spread.

A fingerprint is one row per voice with a mean and a deviation column per
feature (``f__m``, ``f__s``). Unit features are aggregated once per voice
(partial sums first); texts are never gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgauge.functions import patterns as P
from inkgauge.operators.quantiles import group_quantiles
from inkgauge.session import checkpointed

Features = tuple[str, ...]


def usable(units: DataFrame, by: str = "voice", min_words: int = P.MIN_PIECE_WORDS) -> DataFrame:
    """Units of a known voice with enough words."""
    return units.where(F.col(by).isNotNull() & (F.col("n_words") >= min_words))


def fingerprint(units: DataFrame, features: Features = P.SURFACE, by: str = "voice", min_pieces: int = P.MIN_PIECES) -> DataFrame:
    """Mean and sample deviation per voice of at least min_pieces units; units as usable() gives them."""
    aggs = [F.count("*").alias("n_pieces")]
    for f in features:
        aggs += [F.avg(f).alias(f"{f}__m"), F.coalesce(F.stddev_samp(f), F.lit(0.0)).alias(f"{f}__s")]
    return units.groupBy(by).agg(*aggs).where(F.col("n_pieces") >= min_pieces)


def fingerprint_long(fp: DataFrame, features: Features = P.SURFACE, by: str = "voice") -> DataFrame:
    rows = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"{f}__m").alias("mean"), F.col(f"{f}__s").alias("std")) for f in features))
    return fp.select(by, "n_pieces", F.explode(rows).alias("z")).select(by, "n_pieces", "z.feature", "z.mean", "z.std")


def z_of(x: Column, m: Column, s: Column, clip: float | None = P.Z_CLIP) -> Column:
    """z of a value; 0 where the deviation is none; clipped unless clip is None."""
    z = F.when(s > 1e-9, (x - m) / s).otherwise(F.lit(0.0))
    return z if clip is None else F.greatest(F.lit(-clip), F.least(F.lit(clip), z))


def rms(zs: list[Column]) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, (z * z for z in zs)) / len(zs))


def with_distance(units: DataFrame, fp: DataFrame, features: Features = P.SURFACE, by: str = "voice") -> DataFrame:
    """units with z columns (``f__z``) and ``rmsz``; voices without a fingerprint fall out.

    Fingerprints are one row per voice: the planner broadcasts them by their
    size as it is at run time and joins by shuffle beyond.
    """
    x = units.join(fp, by)
    zs = {f"{f}__z": z_of(F.col(f), F.col(f"{f}__m"), F.col(f"{f}__s")) for f in features}
    x = x.withColumns(zs)
    x = x.withColumn("rmsz", rms([F.col(c) for c in zs]))
    return x.drop(*(f"{f}__{k}" for f in features for k in "ms"))


def cadence_rms() -> Column:
    """RMS of the cadence z columns alone."""
    return rms([F.col(f"{f}__z") for f in P.CADENCE])


def worst_features(features: Features = P.SURFACE, k: int = 3) -> Column:
    """array<struct<feature, z>> of the k largest absolute z; ties in the order of the features."""
    rows = F.array(*(F.struct((-F.abs(F.col(f"{f}__z"))).alias("d"), F.lit(i).alias("i"), F.lit(f).alias("feature"), F.col(f"{f}__z").alias("z")) for i, f in enumerate(features)))
    return F.transform(F.slice(F.array_sort(rows), 1, k), lambda r: F.struct(r["feature"].alias("feature"), r["z"].alias("z")))


def leave_one_out(units: DataFrame, features: Features = P.SURFACE, by: str = "voice", min_pieces: int = P.MIN_PIECES) -> DataFrame:
    """units with ``loo``: each one's distance to the fingerprint of the others of its voice.

    Closed form from the voice's mean and centred sum of squares, O(1) per unit.
    What is left of the sum of squares by rounding alone counts as 0, so that a
    feature that is constant without the unit gives z = 0, as it should.
    """
    aggs = [F.count("*").alias("n__")]
    for f in features:
        aggs += [F.avg(f).alias(f"{f}__m"), F.coalesce(F.var_samp(f), F.lit(0.0)).alias(f"{f}__v")]
    x = units.join(units.groupBy(by).agg(*aggs).where(F.col("n__") >= min_pieces), by)
    n = F.col("n__")
    zs = []
    for f in features:
        d, m2 = F.col(f) - F.col(f"{f}__m"), F.col(f"{f}__v") * (n - 1)
        left = m2 - d * d * n / (n - 1)
        left = F.when(left <= m2 * 1e-12, F.lit(0.0)).otherwise(left)
        zs.append(z_of(F.col(f), F.col(f"{f}__m") - d / (n - 1), F.sqrt(left / (n - 2))))
    return x.withColumn("loo", rms(zs)).drop("n__", *(f"{f}__{k}" for f in features for k in "mv"))


def baselines(loo: DataFrame, by: str = "voice") -> DataFrame:
    """(by, n_pieces, self_baseline, fit_threshold) of leave_one_out()."""
    loo = checkpointed(loo.select(by, "loo"))
    q = group_quantiles(loo, [by], {"fit_threshold": ("loo", "linear", 0.95)})
    return loo.groupBy(by).agg(F.count("*").alias("n_pieces"), F.avg("loo").alias("self_baseline")).join(q, by)


def corpus_spread(units: DataFrame, key: str, features: Features = P.SURFACE, by: str = "voice", most: int | None = P.SPREAD_SAMPLE) -> DataFrame:
    """(by, n_units, spread): mean pairwise distance of a voice's units, standardised among themselves.

    At most ``most`` units per voice take part, those of the lowest md5 of the
    key; the limit is part of the measure, which is quadratic in them.
    """
    x = units
    if most is not None:
        h = F.md5(F.col(key).cast("string"))
        x = x.withColumn("rn__", F.row_number().over(Window.partitionBy(by).orderBy(h, F.col(key)))).where(F.col("rn__") <= most)
    else:
        x = x.withColumn("rn__", F.row_number().over(Window.partitionBy(by).orderBy(key)))
    z = with_unclipped(x, features, by).select(by, "rn__", "zs")
    return pairwise(z, by, len(features)).select(by, "n_units", F.col("spread"))


def with_unclipped(units: DataFrame, features: Features, by: str) -> DataFrame:
    """units with an array ``zs`` of z within the group."""
    w = Window.partitionBy(by)
    zs = [z_of(F.col(f), F.avg(f).over(w), F.coalesce(F.stddev_samp(f).over(w), F.lit(0.0)), None) for f in features]
    return units.withColumn("zs", F.array(*zs))


def pairwise(rows: DataFrame, by: str, k: int) -> DataFrame:
    """(by, n_units, spread): mean over pairs of the RMS difference of the arrays zs; rn__ numbers a group's rows."""
    a = rows.select(by, F.col("rn__").alias("i"), F.col("zs").alias("x"))
    b = rows.select(by, F.col("rn__").alias("j"), F.col("zs").alias("y"))
    d = F.sqrt(F.aggregate(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v) / k)
    p = a.join(b, by).where("i < j").groupBy(by).agg(F.avg(d).alias("spread"))
    n = rows.groupBy(by).agg(F.count("*").alias("n_units"))
    return n.join(p, by, "left").select(by, "n_units", F.coalesce("spread", F.lit(0.0)).alias("spread"))


def recency_weight(steps_back: Column, base: float = 4.0, half_life: float = 3.0) -> Column:
    """1 + (base - 1) * 0.5 ** (steps_back / half_life); without a half-life only the newest is raised."""
    decay = F.pow(F.lit(0.5), steps_back / F.lit(half_life)) if half_life > 0 else F.when(steps_back == 0, 1.0).otherwise(0.0)
    return F.lit(1.0) + F.lit(base - 1.0) * decay


def weighted_fingerprint(units: DataFrame, weight: str = "weight", features: Features = P.SURFACE, by: str = "voice", min_pieces: int = P.MIN_PIECES) -> DataFrame:
    """Fingerprint with weighted means and weighted population deviations."""
    w = F.col(weight)
    m = units.groupBy(by).agg(F.count("*").alias("n_pieces"), F.sum(w).alias("w__"), *((F.sum(w * F.col(f)) / F.sum(w)).alias(f"{f}__m") for f in features)).where(F.col("n_pieces") >= min_pieces)
    x = units.join(m, by)
    dev = [F.sqrt(F.sum(w * (F.col(f) - F.col(f"{f}__m")) ** 2) / F.sum(w)).alias(f"{f}__s") for f in features]
    return m.drop("w__").join(x.groupBy(by).agg(*dev), by)


def accepted_target(accepted: DataFrame, scale: DataFrame, features: Features = P.SURFACE, by: str = "voice") -> DataFrame:
    """Centroid of the accepted texts on the deviations of a fingerprint, as a fingerprint row."""
    m = accepted.groupBy(by).agg(F.count("*").alias("n_pieces"), *(F.avg(f).alias(f"{f}__m") for f in features))
    return m.join(scale.select(by, *(f"{f}__s" for f in features)), by)


def fit_state(distance: Column, threshold: Column, baseline: Column, worst: Column | None = None) -> Column:
    """off, drifting or fit: beyond the 95th percentile (1.6 baselines where there is none), between, or within."""
    limit = F.when(threshold > 0, threshold).otherwise(baseline * P.FIT_RATIO)
    off = (limit > 0) & (distance > limit)
    drift = distance > baseline * P.FIT_RATIO
    if worst is not None:
        drift = drift | (F.size(F.filter(worst, lambda r: F.abs(r["z"]) >= P.FEATURE_Z)) >= P.FEATURE_K)
    return F.when(off, "off").when((baseline > 0) & drift, "drifting").otherwise("fit")


def confidence(n: Column, n_features: int) -> Column:
    """ok, thin (below three units per feature) or very thin (below one)."""
    return F.when(n < n_features, "very thin").when(n < 3 * n_features, "thin").otherwise("ok")
