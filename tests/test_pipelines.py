"""Chains over drafts, retrieval, calibration and composites, and their edge cases."""

import math
import random

from pyspark.sql import functions as F

from inkgauge.functions import patterns as P
from inkgauge.operators import blend, chunking, evalstats, feedback, gate, pipelines, retrieve, rules

SCORED = "cand_id string, task_id string, cand_idx int, rmsz double, self_baseline double, `limit` double, n_flags int, n_fidelity int, fidelity_ok boolean"


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_choice_goes_by_gate_front_and_band(spark):
    d = spark.createDataFrame([
        ("a0", "a", 0, 0.2, 1.0, 1.5, 0, 0, True), ("a1", "a", 1, 0.9, 1.0, 1.5, 0, 0, True), ("a2", "a", 2, 1.4, 1.0, 1.5, 0, 1, False),  # a0 beats a1 on the front
        ("b0", "b", 0, 9.0, 1.0, 1.5, 0, 1, False), ("b1", "b", 1, 5.0, 1.0, 1.5, 2, 0, True),  # none passes: the least untrue one
        ("c0", "c", 0, None, None, None, 0, 0, True),
    ], SCORED)
    assert rows(pipelines.chosen(d)) == {("a", "a0", "front", 2), ("b", "b1", "fallback", 0), ("c", "c0", "fallback", 0)}
    assert rows(pipelines.rewrite_rounds(d, 1)) == {("a", 1, True, "a0"), ("b", 2, False, "b1"), ("c", 1, False, "c0")}
    assert pipelines.chosen(d.limit(0)).count() == pipelines.rewrite_rounds(d.limit(0)).count() == 0


def test_chain_scores_the_scalpelled_text(spark):
    r = random.Random(1)
    say = lambda n: " ".join(" ".join(r.choice(["we", "saw", "the", "lamp", "and", "a", "river"]) for _ in range(r.randrange(5, 14))).capitalize() + "." for _ in range(n))
    from inkgauge.operators import calibrate as C
    from inkgauge.operators import features as X

    docs = spark.createDataFrame([(k, "v", say(30)) for k in range(8)], "doc_id long, voice string, text string")
    units = C.usable(X.with_features(docs).drop("text"))
    base = say(20)
    d = spark.createDataFrame([("t#0", "t", 0, "v", base + " In 1999 -- it ended.", None), ("t#1", "t", 1, "v", base + " In 2001 it ended.", base + " In 1999 it ended."), ("u#0", "u", 0, "w", base, None), ("n#0", "n", 0, "v", "", "")], "cand_id string, task_id string, cand_idx int, voice string, text string, source string")
    prof = spark.createDataFrame([("v", None), ("w", 2.0)], "slug string, max_rmsz double")
    got = {x["cand_id"]: x for x in pipelines.scored_drafts(d, units, prof).collect()}
    assert got["t#0"]["n_fixed"] == 1 and "em-dash" not in got["t#0"]["flags"] and got["t#0"]["fidelity_ok"]
    assert got["t#1"]["n_fidelity"] == 1 and not got["t#1"]["fidelity_ok"]
    assert got["u#0"]["rmsz"] is None and got["u#0"]["limit"] == 2.0 and math.isclose(got["t#0"]["limit"], got["t#0"]["fit_threshold"])


def test_hybrid_retrieval(spark):
    docs = spark.createDataFrame([(k, f"lamp river number{k} " + ("garden " * (k % 5)) + ("stone bridge" if k % 7 == 0 else "")) for k in range(60)] + [(99, None)], "id long, text string")
    q = spark.createDataFrame([("q", "the stone bridge over there"), ("n", None)], "query_id string, text string")
    got = [r["id"] for r in pipelines.hybrid(docs, q, 3).orderBy("rank").collect()]
    assert len(got) == 3 and set(got) <= {k for k in range(60) if k % 7 == 0}
    out = spark.createDataFrame([(got[0],)], "id long")
    assert got[0] not in {r["id"] for r in pipelines.hybrid(docs, q, 3, excluded=out).collect()}
    assert pipelines.hybrid(docs, q, 3, diversify=True).count() == pipelines.hybrid(docs, q, 3, keyword=False).count() == 3
    assert pipelines.hybrid(docs, q.where("query_id = 'n'"), 3).count() == 0


def test_topk_beyond_one_block_of_queries(spark):
    import numpy as np

    x = np.random.default_rng(3).normal(size=(2500, 6))
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)] + [(9999, None)], "id long, vec array<double>").repartition(3)
    q = v.where("id % 2 = 0").withColumnRenamed("id", "query_id")
    few, many = (retrieve.vector_topk(v, q, 4, block=b) for b in (5000, 100))
    want = {(i, j) for i in range(0, 2500, 2) for j in np.argsort(-(x @ x[i]), kind="stable")[:4].tolist()}
    assert {(r["query_id"], r["id"]) for r in few.collect()} == {(r["query_id"], r["id"]) for r in many.collect()} == want
    assert retrieve.vector_topk(v, q.limit(0), 4).count() == 0


def test_calibration_texts_cut_thin_or_lopsided_voices(spark):
    para = lambda n: "\n\n".join(" ".join(["word"] * 50) for _ in range(n))
    d = spark.createDataFrame([*((k, "even", para(3)) for k in range(60)), *((100 + k, "few", para(60)) for k in range(3)), (200, None, "x"), (201, "even", None)], "doc_id long, voice string, text string")
    got = pipelines.calibration_texts(d, "doc_id").groupBy("voice").count()
    n = {r["voice"]: r["count"] for r in got.collect()}
    assert n["even"] == 60 and n["few"] > 3 and set(n) == {"even", "few"}
    assert chunking.segments("a b\n\nc d\n\ne", 2, cut_all=True) == ["a b", "c d", "e"] and chunking.segments("", 5) == [""]


def test_words_kept_and_blended(spark):
    three = "One robust lamp. One robust lamp. One robust lamp. Here we stop."
    d = spark.createDataFrame([("a", three), ("b", "It was so. We went on. They came back."), ("b", None)], "voice string, text string")
    lists = pipelines.kept_and_banned(rules.word_usage(d, ("robust", "delve", "vibrant")), ("robust", "delve"), ("vibrant",))
    assert rows(lists) == {("a", "robust", True), ("a", "delve", False), ("a", "vibrant", True), ("b", "robust", False), ("b", "delve", False), ("b", "vibrant", True)}
    sh = spark.createDataFrame([("c", "a"), ("c", "b")], "slug string, source string")
    assert rows(pipelines.blended_words(lists, sh)) == {("c", "robust", False), ("c", "delve", True), ("c", "vibrant", False)}


def test_profiles_resolved_cloned_and_layered(spark):
    p = spark.createDataFrame([("b", "x", 1.0), ("a", None, 2.0)], "slug string, author string, max_rmsz double")
    n = spark.createDataFrame([(1, "b"), (2, "gone"), (3, None)], "k int, name string")
    assert rows(pipelines.resolved(n, p, "name")) == {(1, "b", "b"), (2, "gone", "a"), (3, None, "a")}
    with_example = p.unionByName(spark.createDataFrame([("example", None, None)], p.schema))
    assert (2, "gone", "example") in rows(pipelines.resolved(n, with_example, "name"))
    assert rows(pipelines.resolved(n, p.limit(0), "name").select("slug")) == {(None,)}
    assert rows(pipelines.cloned(p, "b", "new", max_rmsz=F.lit(9.0))) == {("b", "x", 1.0), ("a", None, 2.0), ("new", "x", 9.0)}
    d = spark.createDataFrame([("v", 1, "layer"), ("v", 0, " core "), ("v", 2, ""), ("v", 3, None)], "voice string, o int, text string")
    assert rows(pipelines.layered(d, "voice", ["o"])) == {("v", "core\n\n---\n\nlayer")}


def test_resident_vectors_and_weights(spark):
    d = spark.createDataFrame([(1, "lamp lamp river"), (2, "lamp stone"), (3, None)], "id long, text string")
    x = {r["id"]: r["vec"] for r in retrieve.tfidf(d).collect()}
    assert set(x) == {1, 2} and all(math.isclose(sum(v * v for v in e), 1, abs_tol=1e-9) for e in x.values())
    a = retrieve.resident("h1", lambda: d)
    assert retrieve.resident("h1", lambda: d.limit(0)) is a and retrieve.resident("h2", lambda: d.limit(1)) is not a and not a.is_cached


def test_slates_briefs_events_and_counts(spark):
    long_ = " ".join(["word"] * 25)
    d = spark.createDataFrame([(f"{long_}\n=== DRAFT ===\nshort\n=== DRAFT ===\n{long_} b",), ("only a little",), ("",)], "t string")
    got = [r[0] for r in d.select(chunking.slate_parts(F.col("t"), "=== DRAFT ===", 3)).collect()]
    assert got == [[long_, f"{long_} b"], ["only a little"], [""]]
    assert d.limit(1).select(chunking.neutral_brief(F.lit(" A cold day! And more."))).first()[0] == "Write a short piece on this subject: A cold day!"
    assert len(d.limit(1).select(feedback.event("compose", F.col("t")).alias("e")).first()["e"]["text_sha"]) == 12
    c = spark.createDataFrame([("x", 1.0, 2, 1), ("x", 2.0, 0, 1), ("y", 1.0, 0, 3)], "by string, s double, p int, q int")
    assert rows(evalstats.auroc_of_counts(c, "by", "s").select("by", "auroc")) == {("x", (1 + 2) / 4), ("y", 0.5)}
    assert P.FIT_RATIO > 1 and gate is not None and blend is not None
