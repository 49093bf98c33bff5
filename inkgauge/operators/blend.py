"""Composite voices: checks, weighted corpora, shares, blended calibrations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parts(profiles: DataFrame) -> DataFrame:
    """(slug, source, weight, pos) of every composite's parts."""
    x = profiles.where(F.size("compose_from") > 0).select("slug", F.posexplode("compose_from").alias("pos", "p"))
    return x.select("slug", F.col("p.profile").alias("source"), F.col("p.weight").alias("weight"), "pos")


def problems(profiles: DataFrame, stored: DataFrame) -> DataFrame:
    """(slug, problem, source): no parts of its own, self, repeated, unknown, no store, weight, mixed authors."""
    p = parts(profiles)
    known = profiles.select(F.col("slug").alias("source"), F.col("author").alias("source_author"))
    row = lambda df, what: df.select("slug", F.lit(what).alias("problem"), "source")
    out = row(p.where("source = slug"), "self")
    out = out.unionByName(row(p.groupBy("slug", "source").count().where("count > 1"), "repeated"))
    out = out.unionByName(row(p.join(known, "source", "left_anti"), "unknown"))
    out = out.unionByName(row(p.join(known, "source", "left_semi").join(stored.select(F.col("voice").alias("source")).distinct(), "source", "left_anti"), "no store"))
    out = out.unionByName(row(p.where("weight is null or weight <= 0"), "weight"))
    mixed = p.join(known, "source").groupBy("slug").agg(F.count_distinct("source_author").alias("n")).where("n > 1").select("slug", F.lit(None).cast("string").alias("source"))
    return out.unionByName(row(mixed, "mixed authors")).distinct()


def usable_parts(profiles: DataFrame) -> DataFrame:
    """Parts that count: of another, known voice, of positive weight; a repeated source counts by its first row."""
    w = Window.partitionBy("slug", "source").orderBy("pos")
    known = profiles.select(F.col("slug").alias("source"))
    p = parts(profiles).where("source <> slug and weight > 0").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "pos")
    return p.join(known, "source", "left_semi").select("slug", "source", "weight")


def shares(parts_: DataFrame, counts: DataFrame) -> DataFrame:
    """(slug, source, weight, n, share): shares over the sources that have pieces; counts is (source, n)."""
    x = parts_.join(counts, "source").where("n > 0")
    return x.select("slug", "source", "weight", "n", (F.col("weight") / F.sum("weight").over(Window.partitionBy("slug"))).alias("share"))


def weighted_units(units: DataFrame, shares_: DataFrame, by: str = "voice") -> DataFrame:
    """Units of all parts of each composite with the weight of one piece: the source's over its pieces."""
    x = units.withColumnRenamed(by, "source").join(shares_.select("slug", "source", (F.col("weight") / F.col("n")).alias("weight")), "source")
    return x


def blended_scrub(cal: DataFrame, shares_: DataFrame, by: str = "voice") -> DataFrame:
    """Share-weighted floors and ceilings; composites carry no dash band."""
    x = cal.withColumnRenamed(by, "source").drop("n").join(shares_.select("slug", "source", "share"), "source")
    cols = ("burstiness_floor", "hedge_ceiling", "mean_sentence_len")
    return x.groupBy("slug").agg(F.sum("n_pieces").alias("n_pieces"), *(F.sum(F.col(c) * F.col("share")).alias(c) for c in cols))


def blended_banlist(banlists: DataFrame, shares_: DataFrame, by: str = "voice") -> DataFrame:
    """(slug, word): words every part bans; one part that uses a word keeps it."""
    x = banlists.withColumnRenamed(by, "source").join(shares_.select("slug", "source"), "source")
    return x.groupBy("slug", "word").agg(F.bool_and("banned").alias("b")).where("b").select("slug", "word")
