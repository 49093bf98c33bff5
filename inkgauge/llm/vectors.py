"""Problem 5: the k most similar vectors of every vector, by pruned graphs.

Equal vectors are one class. Classes are routed to the SPREAD nearest of
n_shards centroids (fitted on a bounded sample) and to all within a margin of
the nearest. The margin is the least at which REACH of the neighbours within
held-out sample rows share a shard, so it grows with the number of shards as
the data needs it. Each shard builds a directed graph: vectors enter in tiles; greedy beam searches over the graph so
far propose neighbours; relaxed distance pruning keeps an edge p -> q unless a
kept, closer neighbour r of p has ALPHA * d(r, q) <= d(p, q); reverse edges are
added and pruned alike. Then a beam search asks the finished graph for every
vector of the shard, and the answers of its shards are merged.

A tile's searches share their frontier: what one of them expands is compared
with all of the tile in one matrix product, which only widens each beam.

Where only neighbours of a least cosine are wanted, the margin gives way to a
number of nearest shards, fitted to pairs of that cosine, and a shard compares
all of its vectors by blocks: no margin, no graph, no second split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgauge.llm.common import map_rows
from inkgauge.session import checkpointed, ship_code

DIM, K = 384, 5
DEGREE, BEAM, ALPHA, TILE = 20, 32, 1.2, 256
SHARD_ROWS, SPREAD, SAMPLE_ROWS = 4000, 2, 20_000
SUB_SAMPLE = 40
REACH, REACH_ROWS = 0.99, 2000
CLOSE_SAMPLE = 80_000  # rows that centroids are fitted on where only close neighbours are wanted, at most
DECIMALS = (2, 3, 4)  # of values that are packed as multiples of a step
KEPT_IDS = 6  # of a class; more copies than that are answered by these
SEED = 11


def pack(v: np.ndarray) -> bytes:
    """A float32 vector, lossless (but for the sign of a zero), compressed.

    Values of few decimals are small multiples of one step: a byte of their
    decimals, one of the step and one of each value. Others are their bytes by
    plane after a byte 0.
    """
    z = zstandard.ZstdCompressor(level=1)
    v = v.astype("<f4")
    w = v.astype(np.float64)
    for d in DECIMALS:
        m = np.rint(w * 10.0**d)
        step = int(np.gcd.reduce(m.astype(np.int64))) if np.abs(m).max(initial=0) < 1 << 15 else 0
        if 0 < step < 256 and np.abs(m).max() <= 127 * step and np.array_equal((m / 10.0**d).astype("<f4"), v):
            return bytes((d, step)) + z.compress((m / step).astype(np.int8).tobytes())
    return b"\0" + z.compress(v.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(rows: list[bytes], dim: int) -> np.ndarray:
    z = zstandard.ZstdDecompressor()
    out = np.empty((len(rows), dim), dtype="<f4")
    by: dict[bytes, list[int]] = {}
    for j, r in enumerate(rows):
        by.setdefault(r[:2] if r[0] else b"\0", []).append(j)
    for head, at in by.items():
        raw = b"".join(z.decompress(memoryview(rows[j])[len(head) :]) for j in at)
        if head[0]:
            out[at] = np.frombuffer(raw, np.int8).reshape(-1, dim).astype(np.float64) * head[1] / 10.0 ** head[0]
        else:
            out[at] = np.frombuffer(raw, np.uint8).reshape(-1, 4, dim).transpose(0, 2, 1).copy().view("<f4").reshape(-1, dim)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def usable_vectors(b: pa.RecordBatch, dim: int) -> tuple[list[str], np.ndarray]:
    """Ids and vectors of the rows whose vector has dim finite values that aren't all zero."""
    v = b.column(1)
    n = np.asarray(pc.fill_null(pc.list_value_length(v), -1))
    ok = (n == dim) & np.asarray(pc.is_valid(b.column(0)))
    t = v.filter(pa.array(ok))
    x = np.asarray(t.flatten().to_numpy(zero_copy_only=False), dtype=np.float32).reshape(-1, dim)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return b.column(0).filter(pa.array(ok)).filter(pa.array(good)).to_pylist(), x[good]


def _merge(ids: np.ndarray, sims: np.ndarray, new_ids: np.ndarray, new: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The width best of each row, of what it has and of new columns."""
    if new.shape[1] > width:
        part = np.argpartition(-new, width - 1, axis=1)[:, :width]
        new, col = np.take_along_axis(new, part, 1), new_ids[part]
    else:
        col = np.broadcast_to(new_ids, new.shape)
    s, i = np.concatenate([sims, new], axis=1), np.concatenate([ids, col], axis=1)
    o = np.argsort(-s, axis=1, kind="stable")[:, :width]
    return np.take_along_axis(i, o, 1), np.take_along_axis(s, o, 1)


def beam_search(x: np.ndarray, edges: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Beams (ids, similarities) of a tile of queries over the graph of edges (rows of node ids, -1 where unused)."""
    seen = np.zeros(len(x) + 1, dtype=bool)
    seen[-1] = True  # the unused edge
    expanded = np.zeros(len(x), dtype=bool)
    new = np.unique(entry)
    ids = np.full((len(queries), 0), -1)
    sims = np.zeros((len(queries), 0), dtype=np.float32)
    while len(new):
        seen[new] = True
        ids, sims = _merge(ids, sims, new, queries @ x[new].T, width)
        front = np.unique(ids)
        front = front[~expanded[front]]
        if not len(front):
            break
        expanded[front] = True
        flag = np.zeros(len(x) + 1, dtype=bool)
        flag[edges[front].ravel()] = True
        new = np.flatnonzero(flag & ~seen)
    return ids, sims


def robust_prune(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, sims: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Edges of nodes: of their candidates (by falling similarity, -1 unused) the diverse ones, -1 padded."""
    n, c = cand.shape
    v = x[np.maximum(cand, 0)]
    d_pq = 2 - 2 * sims  # squared distances of unit vectors
    d_qq = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
    alive = (cand >= 0) & (cand != nodes[:, None])
    out = np.full((n, degree), -1, dtype=np.int32)
    count = np.zeros(n, dtype=np.int64)
    for j in range(c):
        take = alive[:, j] & (count < degree)
        rows = np.flatnonzero(take)
        if not len(rows):
            continue
        out[rows, count[rows]] = cand[rows, j]
        count[rows] += 1
        alive[rows] &= alpha * alpha * d_qq[rows, j] > d_pq[rows]
    return out


def knn_graph(x: np.ndarray, k: int, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, tile: int = TILE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours, similarities), k columns, of every row of unit vectors x; -1 where there are fewer."""
    n = len(x)
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    cap = degree * 2
    edges = np.full((n, cap), -1, dtype=np.int32)
    fill = np.zeros(n, dtype=np.int64)
    entry = np.zeros(0, dtype=np.int64)
    for a in range(0, n, tile):
        nodes = order[a : a + tile]
        q = x[nodes]
        if a:
            ids, sims = beam_search(x, edges, q, entry, beam)
        else:
            ids, sims = np.full((len(nodes), 0), -1), np.zeros((len(nodes), 0), dtype=np.float32)
        own = q @ q.T  # vectors that enter together may be neighbours
        ids, sims = _merge(ids, sims, nodes, own, beam + 1)
        out = robust_prune(x, nodes, ids, sims, degree, alpha)
        edges[nodes, :degree] = out
        fill[nodes] = (out >= 0).sum(axis=1)
        src, dst = np.repeat(nodes, degree), out.ravel().astype(np.int64)
        src, dst = src[dst >= 0], dst[dst >= 0]
        o = np.argsort(dst, kind="stable")
        src, dst = src[o], dst[o]
        rank = np.arange(len(dst)) - np.searchsorted(dst, dst)
        at = fill[dst] + rank
        ok = at < cap
        edges[dst[ok], at[ok]] = src[ok]
        full = np.unique(dst[~ok])
        fill += np.bincount(dst[ok], minlength=n)
        if len(full):  # prune what has too many edges
            extra = np.full((len(full), cap), -1, dtype=np.int64)
            row, r = np.searchsorted(full, dst[~ok]), (at - cap)[~ok]
            fit = r < cap
            extra[row[fit], r[fit]] = src[~ok][fit]
            cand = np.concatenate([edges[full], extra], axis=1)
            s = np.einsum("ncd,nd->nc", x[np.maximum(cand, 0)], x[full])
            s[cand < 0] = -9
            o = np.argsort(-s, axis=1)
            new = robust_prune(x, full, np.take_along_axis(cand, o, 1), np.take_along_axis(s, o, 1), degree, alpha)
            edges[full] = -1
            edges[full, :degree] = new
            fill[full] = (new >= 0).sum(axis=1)
        if len(entry) < 32:
            entry = np.concatenate([entry, nodes[:8]])
    best, cos = np.full((n, k), -1, dtype=np.int64), np.full((n, k), -2.0)
    # similar vectors are asked together
    pivot = np.argmax(x @ x[rng.choice(n, min(n, 24), replace=False)].T, axis=1)
    order = np.argsort(pivot, kind="stable")
    for a in range(0, n, tile):
        nodes = order[a : a + tile]
        ids, sims = beam_search(x, edges, x[nodes], np.concatenate([nodes, entry]), beam)
        sims = np.where(ids == nodes[:, None], -9, sims)
        o = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        i, s = np.take_along_axis(ids, o, 1), np.take_along_axis(sims, o, 1)
        i[s < -1.5] = -1
        best[nodes, : i.shape[1]], cos[nodes, : s.shape[1]] = i, s
    return best, cos


def fit_centroids(sample: np.ndarray, n: int, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), n, replace=False)].copy()
    for _ in range(rounds):
        a = np.concatenate([(sample[j : j + 4096] @ c.T).argmax(axis=1) for j in range(0, len(sample), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, a, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-6, total / np.maximum(norm, 1e-6), c)
    return c.astype(np.float32)


def within(x: np.ndarray, c: np.ndarray, margin: float, least: int) -> np.ndarray:
    """For unit vectors x whether each centroid is among the ``least`` nearest or within the margin of the nearest, a share of its squared distance."""
    d = np.maximum(2 - 2 * (x @ c.T), 0)
    kth = np.partition(d, least - 1, axis=1)[:, least - 1]
    return (d <= kth[:, None]) | (d <= (1 + margin) * d.min(axis=1, keepdims=True))


def fit_margin(held: np.ndarray, c: np.ndarray, least: int, k: int = K, reach: float = REACH) -> float:
    """The least margin at which the share ``reach`` of the k nearest of held rows (that c wasn't fitted on) among each other meet.

    Rows of a sample lie further apart than those of the whole, so it is rather too wide than too narrow.
    """
    if len(c) <= least:
        return 0.0
    k = min(k, len(held) - 1)
    if k < 1:
        return float("inf")
    d = np.maximum(2 - 2 * (held @ c.T), 0)
    kth = np.partition(d, least - 1, axis=1)[:, least - 1]
    enter = np.where(d <= kth[:, None], 0, d / np.maximum(d.min(axis=1, keepdims=True), 1e-9) - 1)  # the margin at which a row enters a shard
    asked = held[:REACH_ROWS]
    s = asked @ held.T
    s[np.arange(len(asked)), np.arange(len(asked))] = -9
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    meet = np.concatenate([np.maximum(enter[i], enter[near[i]]).min(axis=1) for i in range(len(asked))])
    return float(np.quantile(meet, reach, method="higher")) * (1 + 1e-6)


def fit_ways(held: np.ndarray, c: np.ndarray, least: int, cos: float, reach: float = REACH) -> int:
    """The least number of nearest centroids, ``least`` or more, at which the share ``reach`` of pairs on the bound ``cos`` meet.

    A sample holds few close pairs, so they are made: of each held row and a
    vector at that cosine in a random direction. Closer pairs meet more often.
    """
    rng = np.random.default_rng(SEED)
    meet = []
    for a in range(0, min(len(held), REACH_ROWS), 500):
        x = held[a : min(a + 500, REACH_ROWS)]
        r = rng.standard_normal(x.shape)
        r -= (r * x).sum(axis=1, keepdims=True) * x
        y = cos * x + np.sqrt(1 - cos * cos) * r / np.linalg.norm(r, axis=1, keepdims=True)
        meet.append(np.maximum(*(np.argsort(np.argsort(-(v @ c.T), axis=1), axis=1) for v in (x, y.astype(np.float32)))).min(axis=1))
    return min(len(c), max(least, 1 + int(np.quantile(np.concatenate(meet), reach, method="higher")) if meet else least))


def fit_close_shards(sample: np.ndarray, n: int, rows: int, shard_rows: int, least: int, cos: float) -> tuple[np.ndarray, int]:
    """At most n centroids and the ways of a row, so that close pairs meet and a shard holds some SPREAD * shard_rows of the rows with all their ways."""
    sample = np.unique(sample, axis=0)
    sample = sample[np.random.default_rng(SEED).permutation(len(sample))]
    held, rest = sample[::4], np.delete(sample, np.s_[::4], axis=0)
    ways, c = least, None
    for _ in range(2):  # more ways need more shards, for shards of one size
        wanted = max(1, min(n, round(rows * ways / (SPREAD * shard_rows))))
        if c is None or wanted > 1.25 * len(c):
            c = fit_centroids(rest if len(rest) > 3 * wanted else sample, wanted)
            ways = fit_ways(held, c, min(least, wanted), cos)
    return c, ways


def cosines(w: np.ndarray, rows: np.ndarray, p: int) -> np.ndarray:
    """Those of rows with row p of unit vectors; alike to the last bit in whatever shard and company, as answers of shards are merged by value."""
    return (w[rows] * w[p]).sum(axis=1)


def close_neighbors(x: np.ndarray, w: np.ndarray, k: int, least: float, first: list[str], tile: int = TILE) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, cosines) of the k most similar others of every row with a cosine of ``least`` or more, all compared; w are the unit vectors in full precision, ties go to the smaller of first."""
    out = []
    for a in range(0, len(x), tile):
        s = x[a : a + tile] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -9
        row, col = np.nonzero(s >= least - 1e-5)
        at = np.searchsorted(row, np.arange(len(s) + 1))
        for p in range(len(s)):
            near = col[at[p] : at[p + 1]]
            if len(near) > 8 * k:  # single precision leaves out those that are surely further
                v = s[p, near]
                near = near[v >= np.partition(v, -k)[-k] - 1e-5]
            cos = cosines(w, near, a + p)
            order = sorted(np.flatnonzero(cos >= least), key=lambda j: (-cos[j], first[near[j]]))[:k]
            out.append((near[order], cos[order]))
    return out


def fit_shards(sample: np.ndarray, n: int, least: int) -> tuple[np.ndarray, float, float]:
    """n centroids, fitted on three of four sample rows, their margin by the fourth, and the shards that a row then enters on average."""
    sample = np.unique(sample, axis=0)
    sample = sample[np.random.default_rng(SEED).permutation(len(sample))]
    held = sample[::4]
    c = fit_centroids(np.delete(sample, np.s_[::4], axis=0) if len(sample) > 4 * n else sample, n)
    margin = fit_margin(held, c, min(least, n))
    return c, margin, float(within(held, c, margin, min(least, n)).sum(axis=1).mean())


def nearest_vectors(
    chunks: DataFrame, k: int = K, dim: int = DIM, shard_rows: int = SHARD_ROWS, spread: int = SPREAD, sample_rows: int | None = None, beam: int = BEAM, least: float | None = None
) -> DataFrame:
    """(id, neighbor, rank, cos): for each id with a usable vector its k most similar other ids, of those with a cosine of ``least`` or more.

    Usable: dim finite values, not all zero. Repeated rows of an id are one.
    Ties in cosine go to the smaller id. sample_rows bounds the sample that the
    shards' centroids are fitted on; every vector is indexed, in the spread
    nearest shards and in all within the margin. With ``least`` a vector enters
    so many of the nearest shards that pairs of this cosine meet, which are few
    however many shards there are, and a shard compares all its vectors.
    Whatever is closer than such a pair is close enough itself, so ranks are
    those among all.
    """
    if k >= KEPT_IDS:
        raise ValueError(f"k must be below {KEPT_IDS}")
    spark = chunks.sparkSession
    ship_code(spark)
    src = chunks.select(F.col("id").cast("string").alias("id"), "embedding")
    n = src.count()
    wanted = max(1, round(n / shard_rows))
    if sample_rows is None:
        sample_rows = SAMPLE_ROWS if least is None else min(CLOSE_SAMPLE, max(SAMPLE_ROWS, 20 * wanted))
    shards = min(wanted, max(1, sample_rows // 20))
    if shards > 1:
        some = src.where(F.size("embedding") == dim).sample(fraction=min(1.0, sample_rows / n), seed=SEED)
        got = map_rows(some, lambda b: {"vec": [pack(v) for v in usable_vectors(b, dim)[1]]}, "vec binary").limit(2 * sample_rows).toArrow()
        sample = unit(unpack(got.column("vec").to_pylist(), dim))
        shards = min(shards, max(1, len(np.unique(sample, axis=0)) // 4))
    fitted, margin, mean, ways = None, 0.0, 1.0, min(spread, shards)
    if shards > 1 and least is not None:
        fitted, ways = fit_close_shards(sample, max(1, min(sample_rows // 20, len(np.unique(sample, axis=0)) // 4)), n, shard_rows, spread, least)
        shards = wanted = len(fitted)  # no second split: larger shards instead
    elif shards > 1:
        fitted, margin, mean = fit_shards(sample, shards, spread)
    more = round(n * mean / (spread * shard_rows))
    if shards > 1 and least is None and more > 1.25 * wanted:  # rows that enter more shards need more of them, for shards of one size
        finer = min(more, max(1, sample_rows // 20), max(1, len(np.unique(sample, axis=0)) // 4))
        again = fit_shards(sample, finer, spread)
        if again[2] ** 2 / finer < mean**2 / shards:  # what all shards compare
            shards, ways, (fitted, margin, mean) = finer, min(spread, finer), again
        wanted = more
    centroids = spark.sparkContext.broadcast(fitted)  # at most sample_rows // 20 vectors

    def route(b):
        """Classes of equal vectors of a batch, each with its smallest ids, for each of their shards."""
        ids, x = usable_vectors(b, dim)
        by: dict[bytes, tuple[int, set[str]]] = {}
        for j, i in enumerate(ids):
            by.setdefault(xxhash.xxh3_128_digest(x[j].tobytes()), (j, set()))[1].add(i)
        if not by:
            return None
        at = [j for j, _ in by.values()]
        if centroids.value is None:
            rows, near = np.arange(len(at)), np.zeros(len(at), dtype=np.int32)
        else:
            rows, near = np.nonzero(within(unit(x[at]), centroids.value, margin, ways))
        rows = pa.array(rows)
        kept = pa.array([sorted(v)[: KEPT_IDS + 1] for _, v in by.values()], type=pa.list_(pa.string()))
        return {"shard": pa.array(near.astype(np.int32)), "vkey": pa.array(list(by), type=pa.binary()).take(rows), "vec": pa.array([pack(x[j]) for j in at], type=pa.binary()).take(rows), "ids": kept.take(rows)}

    routed = map_rows(src, route, "shard int, vkey binary, vec binary, ids array<string>")
    if wanted > 1.5 * shards > 1.5:
        routed = split_shards(routed, wanted / shards, shard_rows, dim, spread)
    near_type = pa.list_(pa.struct([("d", pa.float64()), ("neighbor", pa.string())]))
    schema = pa.schema([("vkey", pa.binary()), ("ids", pa.list_(pa.string())), ("near", near_type)])

    def search(t: pa.Table) -> pa.Table:
        by: dict[bytes, tuple[int, set[str]]] = {}
        for j, (key, ids) in enumerate(zip(t.column("vkey").to_pylist(), t.column("ids").to_pylist(), strict=True)):
            by.setdefault(key, (j, set()))[1].update(ids)
        by = dict(sorted(by.items()))  # rows arrive in any order; the graph is the same
        vec = t.column("vec")
        raw = unpack(vec.take(pa.array([j for j, _ in by.values()])).to_pylist(), dim)
        ids = [sorted(v)[: KEPT_IDS + 1] for _, v in by.values()]
        w = raw.astype(np.float64)
        w /= np.linalg.norm(w, axis=1, keepdims=True)
        if least is None:
            best = [row[row >= 0] for row in knn_graph(unit(raw), k, beam=beam)[0]]
            best = [(row, cosines(w, row, p)) for p, row in enumerate(best)]
        else:
            best = close_neighbors(w.astype(np.float32), w, k, least, [i[0] for i in ids])
        near, kept = [], []
        for p, (row, cos) in enumerate(best):
            mine = [(-1.0, i) for i in ids[p]] if len(ids[p]) > 1 else []
            found = mine + [(-float(c), i) for c, q in zip(cos, row, strict=True) for i in ids[q][:k]]
            if found or least is None:
                kept.append(p)
                near.append([{"d": d, "neighbor": i} for d, i in found])
        keys = list(by)
        return pa.table([pa.array([keys[p] for p in kept], type=pa.binary()), pa.array([ids[p] for p in kept], type=schema.field(1).type), pa.array(near, type=near_type)], schema=schema)

    found = routed.groupBy("shard").applyInArrow(search, "vkey binary, ids array<string>, near array<struct<d double, neighbor string>>")
    both = F.array_sort(F.array_distinct(F.flatten(F.collect_list("near"))))  # one row of each of its shards
    lists = checkpointed(found.groupBy("vkey").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, KEPT_IDS + 1).alias("ids"), F.slice(both, 1, k + KEPT_IDS + 1).alias("near")))
    members = lists.where(F.size("ids") <= KEPT_IDS).select(F.explode("ids").alias("id"), "near")
    many = lists.where(F.size("ids") > KEPT_IDS).select("vkey", "near")
    if not many.isEmpty():  # classes of more ids than were kept: from the rows

        def keys(b):
            ids, x = usable_vectors(b, dim)
            return {"id": ids, "vkey": [xxhash.xxh3_128_digest(r.tobytes()) for r in x]}

        rows = map_rows(src, keys, "id string, vkey binary").join(many, "vkey").select("id", "near")
        members = members.unionByName(rows.dropDuplicates(["id"]))
    picked = members.select("id", F.slice(F.filter("near", lambda z: z["neighbor"] != F.col("id")), 1, k).alias("near"))
    return picked.select("id", F.posexplode("near").alias("rank", "z")).select("id", F.col("z.neighbor").alias("neighbor"), (F.col("rank") + 1).alias("rank"), (-F.col("z.d")).alias("cos"))


def split_shards(routed: DataFrame, parts: float, shard_rows: int, dim: int, ways: int) -> DataFrame:
    """Rows of too large shards, again routed to the nearest ``ways`` of their shard's own centroids and to all within its margin.

    Each shard fits its centroids, one per shard_rows of its rows, and its
    margin on SUB_SAMPLE sampled rows for each. Centroids then meet their shard's rows in sorted
    partitions (centroids first), salted, so that rows stream by and a large
    shard is many tasks.
    """
    fraction = min(1.0, SUB_SAMPLE / shard_rows)
    fit_schema = pa.schema([("shard", pa.int32()), ("vec", pa.binary()), ("margin", pa.float64())])

    def fit(t: pa.Table) -> pa.Table:
        x = unit(unpack(t.column("vec").to_pylist(), dim))
        k = max(1, min(len(x) // 4, round(len(x) / (fraction * shard_rows))))
        k = max(1, min(k, len(np.unique(x, axis=0)) // 4))
        c, margin, _ = fit_shards(x, k, ways)
        return pa.table([pa.array([t.column("shard")[0].as_py()] * k, pa.int32()), pa.array([pack(v) for v in c], pa.binary()), pa.array([margin] * k)], schema=fit_schema)

    centroids = checkpointed(routed.select("shard", "vec").sample(fraction=fraction, seed=SEED).groupBy("shard").applyInArrow(fit, "shard int, vec binary, margin double"))
    salts = max(1, min(64, round(parts)))
    none = F.lit(None)
    first = centroids.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("flag"), none.cast("binary").alias("vkey"), "vec", none.cast("array<string>").alias("ids"), "margin")
    then = routed.select("shard", F.pmod(F.xxhash64("vkey"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("flag"), "vkey", "vec", "ids", none.cast("double").alias("margin"))
    both = first.unionByName(then).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "flag")
    schema = pa.schema([("shard", pa.int64()), ("vkey", pa.binary()), ("vec", pa.binary()), ("ids", pa.list_(pa.string()))])

    def route(batches):
        at, own, margin = None, np.zeros((0, dim), np.float32), 0.0
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([np.asarray(b.column(j)) for j in range(3)], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [b.num_rows]])
            for lo, hi in zip(cuts, cuts[1:]):
                shard, salt, flag = (int(v) for v in key[lo])
                x = unpack(b.column(4).slice(lo, hi - lo).to_pylist(), dim)
                if flag == 0:
                    own = np.concatenate([own, x]) if at == (shard, salt) else x
                    at, margin = (shard, salt), b.column(6)[int(lo)].as_py()
                    continue
                if at != (shard, salt):  # a shard so small that none of its rows was sampled
                    own, at = np.zeros((1, dim), np.float32), (shard, salt)
                i, near = np.nonzero(within(unit(x), own, margin, min(ways, len(own))))
                i = pa.array(i + lo)
                yield pa.record_batch([pa.array(shard * 1_000_000 + near.astype(np.int64)), *(b.column(j).take(i) for j in (3, 4, 5))], schema=schema)

    return both.mapInArrow(route, "shard long, vkey binary, vec binary, ids array<string>")


def close_pairs(chunks: DataFrame, least: float = 0.8, k: int = K, dim: int = DIM) -> DataFrame:
    """(id_a < id_b) with a cosine of at least ``least`` of which one is among the k most similar of the other."""
    near = nearest_vectors(chunks, k, dim, least=least).where(F.col("cos") >= least)
    return near.select(F.least("id", "neighbor").alias("id_a"), F.greatest("id", "neighbor").alias("id_b")).distinct()
