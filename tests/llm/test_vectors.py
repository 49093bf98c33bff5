"""Vector, mixing and subset operators against brute force."""

import random

import numpy as np
import pytest

from inkgauge.llm import diverse, mix, vectors

SCHEMA = "id string, filename string, voice string, embedding array<float>"


def brute(ids, x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    out = {}
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))
        out[ids[i]] = [(ids[j], s[i, j]) for j in order[:k]]
    return out


@pytest.fixture(scope="module")
def cloud():
    r = np.random.default_rng(0)
    centres = r.normal(size=(12, 384))
    x = np.concatenate([c + r.normal(size=(60, 384)) for c in centres])
    near = x[:100] + 0.2 * r.normal(size=(100, 384))
    x = np.round(np.concatenate([x, near]) / 10, 3).astype(np.float32)
    return [f"v{k:04d}" for k in range(len(x))], x


def test_graph_recall(cloud):
    ids, x = cloud
    best, _ = vectors.knn_graph(vectors.unit(x), 5)
    want = brute(ids, x.astype(np.float64), 5)
    hits = sum(len({ids[j] for j in best[i]} & {n for n, _ in want[ids[i]]}) for i in range(len(ids)))
    assert hits / (5 * len(ids)) >= 0.97


def test_robust_prune_keeps_the_nearest():
    x = vectors.unit(np.random.default_rng(1).normal(size=(50, 16)))
    s = x @ x.T
    np.fill_diagonal(s, -9)
    order = np.argsort(-s, axis=1)[:, :20]
    out = vectors.robust_prune(x, np.arange(50), order, np.take_along_axis(s, order, 1), 8, 1.2)
    assert (out[:, 0] == order[:, 0]).all() and (out >= 0).sum(axis=1).min() >= 1


def test_nearest_recall_over_shards(spark, cloud):
    ids, x = cloud
    d = spark.createDataFrame([(i, "f", "v", v.tolist()) for i, v in zip(ids, x, strict=True)], SCHEMA)
    got = {}
    for r in vectors.nearest_vectors(d, shard_rows=200).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbor"], r["cos"]))
    want = brute(ids, x.astype(np.float64), 5)
    hits = sum(len({n for _, n, _ in got[i]} & {n for n, _ in want[i]}) for i in ids)
    assert hits / (5 * len(ids)) >= 0.9
    pairs = {tuple(r) for r in vectors.close_pairs(d).collect()}
    assert pairs == {(min(i, n), max(i, n)) for i, v in want.items() for n, c in v if c >= 0.8}


def test_nearest_recall_over_split_shards(spark, cloud):
    """More shards than the sample allows centroids for: shards are split by centroids of their own."""
    ids, x = cloud
    d = spark.createDataFrame([(i, "f", "v", v.tolist()) for i, v in zip(ids, x, strict=True)], SCHEMA)
    got = {}
    for r in vectors.nearest_vectors(d, shard_rows=60, sample_rows=100).collect():
        got.setdefault(r["id"], set()).add(r["neighbor"])
    want = brute(ids, x.astype(np.float64), 5)
    assert set(got) == set(ids) and all(len(v) == 5 for v in got.values())
    assert sum(len(got[i] & {n for n, _ in want[i]}) for i in ids) / (5 * len(ids)) >= 0.8
    pairs = {tuple(r) for r in vectors.close_pairs(d).collect()}
    assert pairs == {(min(i, n), max(i, n)) for i, v in want.items() for n, c in v if c >= 0.8}


@pytest.mark.parametrize("sizes", [{"shard_rows": 60}, {"shard_rows": 60, "sample_rows": 400}])
def test_nearest_recall_holds_over_many_shards(spark, sizes):
    """One cluster in many shards, by the sample's centroids or also by the shards' own: two shards a vector aren't enough."""
    r = np.random.default_rng(7)
    x = np.round((r.normal(size=(3000, 24)) @ r.normal(size=(24, 384)) + 0.3 * r.normal(size=(3000, 384))) / 10, 3).astype(np.float32)
    ids = [f"v{k:04d}" for k in range(len(x))]
    d = spark.createDataFrame([(i, "f", "v", v.tolist()) for i, v in zip(ids, x, strict=True)], SCHEMA)
    got = {}
    for z in vectors.nearest_vectors(d, **sizes).collect():
        got.setdefault(z["id"], set()).add(z["neighbor"])
    want = brute(ids, x.astype(np.float64), 5)
    recall = sum(len(got[i] & {n for n, _ in want[i]}) for i in ids) / (5 * len(ids))
    assert recall >= 0.9


def test_nearest_edge_cases(spark, cloud):
    _, x = cloud
    a, b = x[0].tolist(), x[1].tolist()
    rows = [(f"c{k:02d}", "f", "v", a) for k in range(20)] + [("c00", "f", "v", a), ("o", "f", "v", b), ("z", "f", "v", [0.0] * 384), ("s", "f", "v", [1.0] * 3), ("n", "f", "v", None), (None, "f", "v", a), ("q", "f", "v", [float("nan")] * 384)]
    d = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in vectors.nearest_vectors(d).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbor"]))
    assert set(got) == {f"c{k:02d}" for k in range(20)} | {"o"}
    assert [n for _, n in sorted(got["c19"])] == [f"c{k:02d}" for k in range(5)]
    assert [n for _, n in sorted(got["c00"])] == [f"c{k:02d}" for k in range(1, 6)]
    assert [n for _, n in sorted(got["o"])] == [f"c{k:02d}" for k in range(5)]
    assert vectors.nearest_vectors(d.limit(0)).count() == 0


def test_pack_round_trip(cloud):
    _, x = cloud
    assert (vectors.unpack([vectors.pack(v) for v in x[:9]], 384) == x[:9]).all()


def test_values_of_few_decimals_are_packed_as_steps():
    """A third of the bytes of their planes, and the same values; others as before."""
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(50, 384)) / 20 / 0.005) * 0.005
    x = np.concatenate([x, 2 * x, np.round(x, 2), r.normal(size=(5, 384)), 1e9 * r.normal(size=(2, 384)), np.zeros((1, 384))]).astype(np.float32)
    packed = [vectors.pack(v) for v in x]
    assert (vectors.unpack(packed, 384) == x).all()
    assert max(len(p) for p in packed[:50]) < 400


def test_close_pairs_meet_in_few_of_many_shards(spark):
    """The vectors sent don't grow with the shards as for neighbours of any kind; the pairs are those of brute force."""
    r = np.random.default_rng(5)
    base = (r.normal(size=(1500, 12)) @ r.normal(size=(12, 384)) + 3 * r.normal(size=(1500, 384))) / 60
    x = np.concatenate([base, base[:300] + 0.5 * base[:300].std() * r.normal(size=(300, 384))])
    x = (np.round(x / 0.005) * 0.005).astype(np.float32)
    c, ways = vectors.fit_close_shards(vectors.unit(x), 100, len(x), 60, 2, 0.8)
    assert len(c) > 25 and 2 <= ways <= 6
    ids = [f"v{k:04d}" for k in range(len(x))]
    d = spark.createDataFrame([(i, "f", "v", v.tolist()) for i, v in zip(ids, x, strict=True)], SCHEMA)
    got = {(z["id"], z["neighbor"]): z["cos"] for z in vectors.nearest_vectors(d, shard_rows=60, sample_rows=2000, least=0.8).collect()}
    want = {(i, n): s for i, v in brute(ids, x.astype(np.float64), 5).items() for n, s in v if s >= 0.8}
    assert len(want) >= 500 and not set(got) - set(want) and len(got) >= 0.99 * len(want)
    assert all(abs(s - want[p]) < 1e-9 for p, s in got.items())


def test_cosines_are_alike_in_any_company(cloud):
    """Answers of several shards are merged by value: a cosine that differs in its last bit would take two places."""
    w = cloud[1].astype(np.float64)
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    alone = [vectors.cosines(w, np.array([q]), 3)[0] for q in range(200)]
    assert (vectors.cosines(w, np.arange(200), 3) == alone).all() and alone == [vectors.cosines(w, np.arange(3, 9), q)[0] for q in range(200)]


# --- problem 7 ---


def test_varied_subset(spark, cloud):
    ids, x = cloud
    rows = [(i, "big" if k % 3 else f"f{k % 17}", "v1" if k % 2 else None, v.tolist()) for k, (i, v) in enumerate(zip(ids, x, strict=True))]
    rows += [("copy", "g", "v1", x[5].tolist()), ("none", "g", "v1", None), (ids[0], rows[0][1], None, x[0].tolist())]
    d = spark.createDataFrame(rows, SCHEMA)
    out = diverse.varied_subset(d, k=24).collect()
    where = dict(zip([r[0] for r in rows], [np.array(r[3], dtype=np.float64) if r[3] else None for r in rows], strict=True))
    for scope in (None, "v1"):
        got = [r for r in out if r["voice"] == scope]
        assert 12 <= len(got) <= 24 and len({r["id"] for r in got}) == len(got)
        v = vectors.unit(np.stack([where[r["id"]] for r in got]))
        s = v @ v.T
        np.fill_diagonal(s, 0)
        assert s.max() < 0.8
        n_scope = sum(1 for r in rows if r[3] and (scope is None or r[2] == scope))
        for f in {r["filename"] for r in got}:
            share = sum(1 for r in rows if r[3] and r[1] == f and (scope is None or r[2] == scope)) / n_scope
            assert sum(r["filename"] == f for r in got) <= max(1, np.ceil(24 * share - 1e-9))
        rng = random.Random(0)
        mean = (1 - s).sum() / (len(got) * (len(got) - 1))
        some = vectors.unit(np.stack([where[i] for i in rng.sample(ids, len(got))]))
        t = some @ some.T
        np.fill_diagonal(t, 0)
        assert mean > (1 - t).sum() / (len(got) * (len(got) - 1))
    small = lambda x: sorted(map(tuple, diverse.varied_subset(x, k=6, block=64, fan_in=2).collect()), key=str)
    assert small(d.coalesce(1)) == small(d.repartition(5, "filename"))  # in rounds, and however rows are stored
    assert diverse.varied_subset(d.limit(0)).count() == 0


def test_swaps_never_lower_the_sum(cloud):
    ids, x = cloud
    u = vectors.unit(x[:300])
    files = [f"f{k % 5}" for k in range(300)]
    due = {f: 6 for f in set(files)}
    start = diverse.farthest_first(u, ids[:300], 20, files, due, 0.8)
    end = diverse.swap_search(u, start, files, due, 0.8)
    total = lambda s: (1 - u[s] @ u[s].T).sum()
    assert total(end) >= total(start) - 1e-6 and len(set(end)) == len(start)


# --- problem 9 ---


def test_water_fill():
    assert mix.water_fill([1, 1, 2], [100, 100, 100], 40) == [10, 10, 20]
    assert mix.water_fill([1, 1], [5, 100], 50) == [5, 45]
    assert mix.water_fill([1, 1, 1], [5, 10, 100], 60) == [5, 10, 45]
    assert mix.water_fill([1, 1], [5, 10], 60) == [5, 10]
    assert mix.water_fill([0, 1], [5, 10], 6) == [0, 6]
    assert mix.water_fill([], [], 6) == []
    r = random.Random(1)
    for _ in range(200):
        w, c = [r.random() for _ in range(6)], [r.random() * 10 for _ in range(6)]
        t = r.random() * 40
        out = mix.water_fill(w, c, t)
        assert abs(sum(out) - min(t, sum(c))) < 1e-6 and all(o <= x + 1e-9 for o, x in zip(out, c, strict=True))
        level = [o / x for o, x, k in zip(out, w, c, strict=True) if o < k - 1e-9]
        assert not level or max(level) - min(level) < 1e-6


def test_mix(spark):
    docs = [(k, "a" if k < 60 else "b" if k < 70 else "c" if k < 75 else None, "lamp stone river " * (1 + k % 5)) for k in range(80)] + [(90, "b", None), (91, "b", "")]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string")
    t = spark.createDataFrame([("x", "a", 1.0, 1), ("x", "b", 1.0, 3), ("x", "b", 1.0, 3), ("x", "c", 2.0, 2), ("x", "gone", 1.0, 1), ("x", "null", None, 2), ("y", "a", 1.0, 5)], "blend string, source string, weight double, max_repeats int")
    counts = mix.token_counts(d)
    plan = mix.mix_plan(counts, t)
    drawn = mix.draw(counts, plan)
    rep = {(r["blend"], r["source"]): r for r in mix.reached_shares(drawn, plan).collect()}
    assert rep["x", "gone"]["status"] == "missing" and rep["x", "null"]["status"] == "unusable" and rep["x", "c"]["status"] == "short"
    assert rep["x", "c"]["most_repeats"] == 2 and rep["x", "b"]["most_repeats"] <= 3 and rep["x", "a"]["most_repeats"] <= 1
    assert abs(sum(r["reached_share"] or 0 for r in rep.values() if r["blend"] == "x") - 1) < 1e-9
    assert abs(rep["x", "a"]["due_tokens"] - rep["x", "a"]["taken_tokens"]) <= 20
    assert rep["y", "a"]["reached_share"] == 1.0
    one = sorted(map(tuple, drawn.collect()))
    assert one == sorted(map(tuple, mix.draw(counts, plan).collect()))
    assert mix.draw(mix.token_counts(d.limit(0)), plan).count() == 0
