"""Exact order statistics per group without gathering a group.

Sketches give each wanted rank a narrow interval; what lies below it is only
counted (map-side first), and what lies inside, some 1 in 500 rows, is counted
by distinct value and walked in order. Groups of up to SMALL rows are walked
whole. A group may hold any share of all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALL, ACCURACY, MARGIN = 5_000, 10_000, 0.001

#: The rank (0-based, of n sorted values) that a rule takes for a share p.
RULES = {
    "even": lambda p, n: F.bround(F.lit(p) * (n - 1), 0),
    "floor": lambda p, n: F.floor(F.lit(p) * (n - 1)),
    "cut": lambda p, n: F.least(F.floor(F.lit(p) * n), n - 1),
    "linear": lambda p, n: F.floor(F.lit(p) * (n - 1)),
}


def null_safe_join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a joined with b on keys where null equals null; the keys of a stay."""
    b = b.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in b.columns if c not in keys))
    return a.join(b, reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys)), how).drop(*(f"__{k}" for k in keys))


def group_quantiles(df: DataFrame, by: list[str], specs: dict[str, tuple[str, str, float]]) -> DataFrame:
    """(by, alias...) for specs alias -> (column, rule, p); null values don't count, a group without any gives null.
    A null key is a group. df is read several times: callers write it out first
    where it is dear.

    Rules: even (rank p(n-1), halves to even), floor (rank floor p(n-1)), cut
    (rank floor pn), linear (interpolated at p(n-1)).
    """
    cols = sorted({c for c, _, _ in specs.values()})
    pairs = F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("x")) for c in cols))
    groups = df.select(*by).distinct()
    long = df.select(*by, F.explode(pairs).alias("z")).select(*by, "z.c", "z.x").where("x is not null")
    ps = sorted({p for _, _, p in specs.values()})
    around = [v for p in ps for v in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))]
    stat = long.groupBy(*by, "c").agg(F.count("*").alias("n"), F.percentile_approx("x", F.array(*(F.lit(v) for v in around)), F.lit(ACCURACY)).alias("q"))

    def of(spec: tuple[str, tuple[str, str, float]]) -> Column:
        alias, (c, rule, p) = spec
        n, i = F.col("n"), ps.index(p)
        whole = n <= SMALL
        pos = F.lit(p) * (n - 1)
        rank = RULES[rule](p, n).cast("long")
        lo = F.when(~whole, F.get("q", F.lit(2 * i)))
        hi = F.when(~whole, F.get("q", F.lit(2 * i + 1)))
        frac = pos - F.floor(pos) if rule == "linear" else F.lit(0.0)
        return F.when(F.col("c") == c, F.struct(F.lit(alias).alias("s"), rank.alias("k"), frac.cast("double").alias("f"), lo.alias("lo"), hi.alias("hi")))

    want = stat.select(*by, "c", F.explode(F.array_compact(F.array(*(of(s) for s in specs.items())))).alias("w")).select(*by, "c", "w.*")
    x = null_safe_join(long, want, [*by, "c"]).where("hi is null or x <= hi").withColumn("x", F.when(F.col("lo").isNull() | (F.col("x") >= F.col("lo")), F.col("x")))
    counts = x.groupBy(*by, "s", "k", "f", "x").agg(F.count("*").alias("n"))
    cum = counts.withColumn("cum", F.sum("n").over(Window.partitionBy(*by, "s").orderBy(F.col("x").asc_nulls_first())))
    at = cum.where("x is not null").groupBy(*by, "s", "f").agg(F.min(F.when(F.col("cum") > F.col("k"), F.col("x"))).alias("a"), F.min(F.when(F.col("cum") > F.col("k") + 1, F.col("x"))).alias("b"))
    value = at.select(*by, "s", F.when(F.col("f") > 0, F.col("a") + F.col("f") * (F.coalesce("b", "a") - F.col("a"))).otherwise(F.col("a")).alias("v"))
    out = value.groupBy(*by).agg(*(F.max(F.when(F.col("s") == a, F.col("v"))).alias(a) for a in specs))
    return null_safe_join(groups, out, by, "left")
