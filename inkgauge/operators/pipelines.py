"""Whole chains over tables: scoring and choosing drafts, retrieving anchors, calibrating voices and composites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgauge.functions import patterns as P
from inkgauge.functions import textkit as T
from inkgauge.operators import calibrate as C
from inkgauge.operators import chunking, fidelity, gate, retrieve, rules
from inkgauge.operators import features as X
from inkgauge.session import checkpointed


def scored_drafts(drafts: DataFrame, units: DataFrame, profiles: DataFrame) -> DataFrame:
    """drafts (cand_id, task_id, cand_idx, voice, text, source) scalpelled, measured and verified.

    Adds n_fixed, rmsz, self_baseline, fit_threshold, limit, flags (hard ones),
    n_flags, n_fidelity and fidelity_ok, all of the scalpelled text. Drafts of
    voices without a fingerprint have no distance and never pass a gate.
    """
    x = drafts.withColumn("n_fixed", rules.plain_dashes(F.col("text"))).withColumn("text", rules.plain_scalpel(F.col("text")))
    flags = fidelity.hard_flags(F.col("text"), F.col("source"))
    x = checkpointed(X.with_features(x.withColumn("flags", flags)).drop("text", "source"))
    base = C.baselines(C.leave_one_out(units)).drop("n_pieces")
    dist = C.with_distance(x.select("cand_id", "voice", *P.SURFACE), C.fingerprint(units)).select("cand_id", "rmsz")
    setting = profiles.select(F.col("slug").alias("voice"), F.coalesce(F.col("max_rmsz").cast("string"), F.lit("auto")).alias("setting"))
    x = x.drop(*P.SURFACE).join(dist, "cand_id", "left").join(base, "voice", "left").join(setting, "voice", "left")
    n = F.size(F.filter("flags", lambda f: f.startswith("fidelity")))
    return x.select("cand_id", "task_id", "cand_idx", "voice", "n_fixed", "rmsz", "self_baseline", "fit_threshold", gate.threshold(F.coalesce("setting", F.lit("auto")), F.col("fit_threshold"), F.col("self_baseline")).alias("limit"), "flags", F.size("flags").alias("n_flags"), n.alias("n_fidelity"), (n == 0).alias("fidelity_ok"))


def chosen(scored: DataFrame, mode: str = "band") -> DataFrame:
    """One draft per task: of those within the gate and true to their source, on the Pareto front of distance and flags, the one of the least target distance; else the least bad.

    (task_id, cand_id, route, n_survivors); route is ``front`` or ``fallback``.
    """
    ok = gate.survivors(scored, F.col("limit"), F.col("n_fidelity"))
    aim = gate.target_distance(F.col("rmsz"), F.coalesce("self_baseline", F.lit(0.0)), mode)
    w = Window.partitionBy("task_id").orderBy(F.round(aim, 9), "cand_idx")
    best = gate.pareto_front(ok).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("task_id", "cand_id", F.lit("front").alias("route"))
    rest = scored.join(best.select("task_id"), "task_id", "left_anti")
    worst = gate.least_bad(rest.withColumn("aim", F.round(aim, 9)), None, hard="n_fidelity", distance="aim").select("task_id", "cand_id", F.lit("fallback").alias("route"))
    n = ok.groupBy("task_id").agg(F.count("*").alias("n_survivors"))
    return best.unionByName(worst).join(n, "task_id", "left").select("task_id", "cand_id", "route", F.coalesce("n_survivors", F.lit(0)).alias("n_survivors"))


def rewrite_rounds(scored: DataFrame, max_rewrites: int = 2) -> DataFrame:
    """(task_id, rounds, passed, cand_id): a task's drafts as successive attempts, up to the first that passes the gate or the last allowed."""
    ok = F.coalesce((F.col("rmsz") <= F.col("limit")) & F.col("fidelity_ok"), F.lit(False))
    w = Window.partitionBy("task_id").orderBy("cand_idx", "cand_id")
    x = scored.select("task_id", "cand_id", "cand_idx", ok.alias("ok")).withColumn("round", F.row_number().over(w)).where(F.col("round") <= max_rewrites + 1)
    first = F.min(F.when(F.col("ok"), F.struct("round", "cand_id")))
    last = F.max(F.struct("round", "cand_id"))
    y = x.groupBy("task_id").agg(first.alias("f"), last.alias("l"))
    return y.select("task_id", F.coalesce("f.round", "l.round").alias("rounds"), F.col("f").isNotNull().alias("passed"), F.coalesce("f.cand_id", "l.cand_id").alias("cand_id"))


def hybrid(docs: DataFrame, queries: DataFrame, limit: int, keyword: bool = True, diversify: bool = False, excluded: DataFrame | None = None, text: str = "text") -> DataFrame:
    """(query_id, id, rank): recall of 9 * limit by vector and by keyword, fused to 3 * limit, then diversified or cut to limit.

    docs (id, text), queries (query_id, text); null texts take no part. Without
    ``keyword`` the vector list stands alone.
    """
    v = docs.where(F.col(text).isNotNull()).select("id", retrieve.encode(F.col(text)).alias("vec"))
    q = queries.where(F.col(text).isNotNull()).select("query_id", retrieve.encode(F.col(text)).alias("vec"))
    near = retrieve.vector_topk(v, q, 9 * limit + 8)
    steady = lambda x, col, up: x.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round(col, 9).asc() if up else F.round(col, 9).desc(), "id"))).where(F.col("rank") <= 9 * limit)
    lists = [checkpointed(steady(near.drop("rank"), "sim", False))]
    if keyword:
        lists.append(checkpointed(steady(retrieve.bm25(docs, queries, text=text), "score", True)))
    fused = retrieve.rrf([x.select("query_id", "id", "rank") for x in lists], 3 * limit, excluded=excluded)
    if not diversify:
        return fused.where(F.col("rank") <= limit).select("query_id", "id", "rank")
    sim = F.col("q.vec")
    pool = fused.join(v, "id").join(q.select("query_id", F.struct("vec").alias("q")), "query_id").withColumn("sim", retrieve.dot(F.col("vec"), sim)).drop("q", "rrf")
    return retrieve.mmr(pool, limit).withColumnRenamed("pick", "rank")


def calibration_texts(docs: DataFrame, key: str, by: str = "voice", text: str = "text", n_features: int = len(P.SURFACE)) -> DataFrame:
    """(key, by, seg, text): the texts of a corpus as units; of voices that are lopsided or thin, cut into segments of the voice's target."""
    d = docs.where(F.col(text).isNotNull() & F.col(by).isNotNull()).select(key, by, F.col(text).alias("text"))
    plan = chunking.segmentation(d, by, n_features)
    need = F.col("lopsided") | (F.col("n_pieces") < 3 * n_features)
    x = d.join(plan.select(by, need.alias("need"), "target"), by)
    cut = T.exploded(x.where("need"), [key, by], chunking.segment_udf("text", "target"), "text", "seg")
    return cut.unionByName(x.where("not need").select(key, by, F.lit(0).alias("seg"), "text"))


def kept_and_banned(usage: DataFrame, words: tuple[str, ...], explicit: tuple[str, ...] = (), least: int = 3, by: str = "voice") -> DataFrame:
    """(by, word, kept) of every tell word and explicit one: kept if explicit or used ``least`` times, else banned."""
    listed = usage.select(by).distinct().select(by, F.explode(F.array_distinct(F.array(*(F.lit(w) for w in words + explicit)))).alias("word"))
    keep = F.col("word").isin(*explicit) if explicit else F.lit(False)
    return listed.join(usage.where("word is not null"), [by, "word"], "left").select(by, "word", (keep | (F.coalesce("uses", F.lit(0)) >= least)).alias("kept"))


def blended_words(lists: DataFrame, shares: DataFrame, by: str = "voice") -> DataFrame:
    """(slug, word, banned) of composites: banned if every part bans it and none keeps it."""
    x = lists.withColumnRenamed(by, "source").join(shares.select("slug", "source"), "source")
    return x.groupBy("slug", "word").agg((~F.bool_or("kept")).alias("banned"))


def resolved(names: DataFrame, profiles: DataFrame, col: str, fallback: str = "example") -> DataFrame:
    """names with ``slug``: the named profile, else the fallback one, else the first; null without any profile."""
    first = profiles.agg(F.max(F.when(F.col("slug") == fallback, F.col("slug"))).alias("ex"), F.min("slug").alias("first"))
    x = names.join(profiles.select(F.col("slug").alias("found")).distinct(), F.col(col) == F.col("found"), "left")
    return x.crossJoin(F.broadcast(first)).select(*(F.col(f"`{c}`") for c in names.columns), F.coalesce("found", "ex", "first").alias("slug"))  # one row


def cloned(profiles: DataFrame, slug: str, new: str, **override: Column) -> DataFrame:
    """The profiles with a copy of one under a new slug, some columns overridden; an existing new slug is replaced."""
    copy = profiles.where(F.col("slug") == slug).withColumns({"slug": F.lit(new), **override})
    return profiles.where(F.col("slug") != new).unionByName(copy)


def layered(layers: DataFrame, by: str, order: list[str], text: str = "text") -> DataFrame:
    """(by, text): the layers of a voice (its core first) as one text, parts set off by a rule; empty layers fall out."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.trim(text).alias("t"))))
    return layers.where(F.coalesce(F.trim(text), F.lit("")) != "").groupBy(by).agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n\n---\n\n").alias("text"))
