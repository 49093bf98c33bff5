"""Slates of drafts: gate, Pareto front, fallback, spread, accept rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgauge.functions import patterns as P
from inkgauge.operators.calibrate import pairwise


def threshold(setting: Column, fit_threshold: Column, baseline: Column) -> Column:
    """auto: the 95th percentile, or 1.6 baselines without one; else the number set (1.1 without a setting)."""
    auto = F.when(fit_threshold > 0, fit_threshold).otherwise(baseline * P.FIT_RATIO)
    return F.when(F.lower(setting) == "auto", auto).otherwise(F.coalesce(F.expr("try_cast(1 as double)") * setting.try_cast("double"), F.lit(1.1)))


def target_distance(rmsz: Column, baseline: Column, mode: str = "minimize") -> Column:
    return F.when(baseline > 0, F.abs(rmsz - baseline)).otherwise(rmsz) if mode == "band" else rmsz


def survivors(cands: DataFrame, limit: Column, hard: Column | None = None) -> DataFrame:
    """Drafts within the distance and without a hard finding."""
    return cands.where((F.col("rmsz") <= limit) & ((hard == 0) if hard is not None else F.lit(True)))


def pareto_front(cands: DataFrame, task: str = "task_id", x: str = "rmsz", y: str = "n_flags") -> DataFrame:
    """Drafts no other draft of their task beats on both costs: one sort per task, no pairs.

    By rising x, a draft is on the front if its y is the least among its equals
    in x and below every y before them. Equal drafts don't beat each other.
    """
    before = Window.partitionBy(task).orderBy(x)
    same = Window.partitionBy(task, x)
    d = cands.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = d.withColumn("low__", F.min(y).over(same)).withColumn("rank__", F.dense_rank().over(before))
    per = d.groupBy(task, "rank__").agg(F.min(y).alias("m__"))
    prior = per.withColumn("prior__", F.min("m__").over(Window.partitionBy(task).orderBy("rank__").rowsBetween(Window.unboundedPreceding, -1))).select(task, "rank__", "prior__")
    keep = (F.col(y) == F.col("low__")) & (F.col("prior__").isNull() | (F.col(y) < F.col("prior__")))
    return d.join(prior, [task, "rank__"]).where(keep).drop("low__", "rank__", "prior__")


def least_bad(cands: DataFrame, baseline: Column | None = None, task: str = "task_id", hard: str = "n_hard", mode: str = "minimize", distance: str = "rmsz") -> DataFrame:
    """One draft per task: fewest hard findings, then the least target distance, then the lowest cand_idx."""
    d = target_distance(F.col(distance), baseline if baseline is not None else F.lit(0.0), mode)
    w = Window.partitionBy(task).orderBy(hard, d.asc_nulls_last(), "cand_idx")
    return cands.withColumn("rn__", F.row_number().over(w)).where("rn__ = 1").drop("rn__")


def slate_spread(z: DataFrame, features: tuple[str, ...], task: str = "task_id", order: str = "cand_idx") -> DataFrame:
    """(task, n_units, spread): mean pairwise RMS difference of clipped z columns in a slate."""
    rows = z.select(task, F.row_number().over(Window.partitionBy(task).orderBy(order)).alias("rn__"), F.array(*(F.col(f"{f}__z") for f in features)).alias("zs"))
    return pairwise(rows, task, len(features))


def collapsed(spread: Column, corpus_spread: Column) -> Column:
    return (corpus_spread > 0) & (spread < corpus_spread * 0.5)


def repair_accepted(flags_before: Column, flags_after: Column, rmsz_after: Column, limit: Column, hard_before: Column, hard_after: Column) -> Column:
    """A repair counts if it has fewer flags, is clean or within the gate, and no more hard findings."""
    return (flags_after < flags_before) & ((flags_after == 0) | (rmsz_after <= limit)) & (hard_after <= hard_before)


def detector_accepted(before: Column, after: Column, direction: Column, rmsz_after: Column, limit: Column, hard_after: Column) -> Column:
    gain = F.when(direction == "low_is_machine", after > before).otherwise(after < before)
    return gain & (rmsz_after <= limit) & (hard_after == 0)
