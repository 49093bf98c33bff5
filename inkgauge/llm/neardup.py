"""Problem 2: near-duplicate texts, by MinHash with Bayesian pruning.

1. Every text, in its one form, gives the set of its k-word shingles and
   MinHash values. Texts with equal word sequences form a class; one
   representative goes on, so copies cost nothing in the join.
2. Candidates share a band of MinHash values. Bands are as long as the
   threshold allows without missing more than 1 pair on it in 1,000; the
   longer they are, the fewer texts that share only common phrases meet. A
   bucket of more than HOT representatives is joined in blocks that compare
   sketches (step 3) on the spot, so that common boilerplate costs comparisons
   but only what survives them is written.
3. Candidates are compared by one byte per MinHash value, STEP values at a
   time, and dropped as soon as the posterior probability of reaching the
   threshold falls below EPSILON (uniform prior, binomial likelihood). Chance
   matches of bytes only add matches, so none is dropped that whole values
   would keep.
4. What remains is verified on the exact shingle sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgauge.llm.common import WORD, expand_pairs, map_rows
from inkgauge.llm.lookalike import one_form
from inkgauge.session import checkpointed

N_HASH, N_SKETCH, STEP, EPSILON, MISSED = 160, 64, 16, 1e-4, 1e-3
HOT, BLOCK = 256, 2048
BROADCAST_ROWS = 300_000  # (rep, id) rows, some 15 MB; beyond, the texts are shuffled
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_rng = np.random.default_rng(20240501)
_MUL = _rng.integers(1, 2**63, N_HASH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, N_HASH, dtype=np.uint64)
_WORD_HASH: dict[str, int] = {}


def band_rows(threshold: float) -> int:
    """Values per band: the most at which a pair on the threshold is missed in fewer than MISSED of the cases; at least 2."""
    r = 2
    while r < 16 and (1 - threshold ** (r + 1)) ** (N_HASH // (r + 1)) < MISSED:
        r += 1
    return r


def word_hashes(words: list[str]) -> np.ndarray:
    cache = _WORD_HASH
    if len(cache) > 500_000:
        cache.clear()
    out = []
    for w in words:
        h = cache.get(w)
        if h is None:
            h = cache[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        out.append(h)
    return np.array(out, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words; a text of fewer words is one shingle of all, none of no word."""
    if not len(hashes):
        return hashes
    k = min(k, len(hashes))
    acc = np.zeros(len(hashes) - k + 1, dtype=np.uint64)
    for j in range(k):
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + hashes[j : len(hashes) - k + 1 + j])
    return np.unique(acc)


def minhash(sh: np.ndarray) -> np.ndarray:
    """N_HASH MinHash values of 32 bits."""
    return ((sh[:, None] * _MUL[None, :] + _ADD[None, :]) >> np.uint64(32)).min(axis=0).astype(np.uint32)


def least_matches(threshold: float, step: int = STEP, epsilon: float = EPSILON) -> list[tuple[int, int]]:
    """(n, m): after n comparisons, fewer than m matches mean P(similarity >= threshold | data) < epsilon."""
    out = []
    for n in range(step, N_SKETCH + 1, step):
        m = 0
        # uniform prior: P(J >= t | m of n) = P(Bin(n + 1, t) <= m)
        while sum(math.comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1)) < epsilon:
            m += 1
        out.append((n, m))
    return out


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """A 32-bit key per band."""
    n = len(values) // rows
    key = np.zeros(n, dtype=np.uint64)
    for j in range(rows):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + values[j * n : (j + 1) * n].astype(np.uint64))
    return (key >> np.uint64(32)).astype(np.uint32)


def _word_key(h: np.ndarray) -> int:
    """64 bits of a word sequence, as a signed number."""
    return int.from_bytes(xxhash.xxh3_64_digest(h.tobytes()), "little", signed=True)


def _source(texts: DataFrame) -> DataFrame:
    return texts.where("id is not null and text is not null").select(F.col("id").cast("string").alias("id"), "text")


def signed(texts: DataFrame, k: int, min_words: int, rows: int) -> DataFrame:
    """(rep, id, keys, sketch) of every text with at least min_words words: its class (the key of its word sequence), band keys
    and a byte of N_SKETCH MinHash values. Of equal texts of a batch only the first has keys and a sketch."""

    def sign(b):
        out: dict[str, list] = {n: [] for n in ("rep", "id", "keys", "sketch")}
        known: set[int] = set()
        with np.errstate(over="ignore"):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = word_hashes(WORD.findall(one_form(t).lower()))
                if len(h) < max(1, min_words):
                    continue
                rep = _word_key(h)
                out["rep"].append(rep)
                out["id"].append(i)
                if rep in known:
                    out["keys"].append(None)
                    out["sketch"].append(None)
                    continue
                known.add(rep)
                v = minhash(shingles(h, k))
                out["keys"].append(band_keys(v, rows).tobytes())
                out["sketch"].append((v[:N_SKETCH] & np.uint32(255)).astype(np.uint8).tobytes())
        return out

    return map_rows(_source(texts), sign, "rep long, id string, keys binary, sketch binary")


def representatives(rows: DataFrame) -> DataFrame:
    """Of signed() rows one per class, with its smallest id."""
    return rows.groupBy("rep").agg(F.min("id").alias("id"), F.first("keys", ignorenulls=True).alias("keys"), F.first("sketch", ignorenulls=True).alias("sketch"))


def _bands(rep: DataFrame) -> DataFrame:
    """(rep, key) for every band of rows (rep, keys)."""

    def cut(b):
        if not b.num_rows:
            return None
        k = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint32).reshape(b.num_rows, -1)
        with np.errstate(over="ignore"):
            key = _mix(k.astype(np.uint64) + (np.arange(k.shape[1], dtype=np.uint64) << np.uint64(32))[None, :])
        return {"rep": b.column(0).take(pa.array(np.repeat(np.arange(len(k)), k.shape[1]))), "key": pa.array(key.ravel().view(np.int64))}

    return map_rows(rep.select("rep", "keys"), cut, "rep long, key long")


def bucket_pairs(batches, hot: int):
    """Of rows (rep, key) sorted by key: (a, b, False) for the pairs of each bucket, (rep, key, True) for the rows of hot ones.

    Holds one bucket of at most ``hot`` rows; what is above goes by.
    """
    names = ["a", "b", "hot"]

    def emit(reps: np.ndarray, sizes: np.ndarray):
        start = np.cumsum(sizes) - sizes
        for n in np.unique(sizes):
            if n < 2:
                continue
            i, j = np.triu_indices(n, 1)
            at = start[sizes == n]
            step = max(1, 200_000 // len(i))
            for c in range(0, len(at), step):
                x, y = reps[at[c : c + step, None] + i].ravel(), reps[at[c : c + step, None] + j].ravel()
                keep = x != y
                x, y = x[keep], y[keep]
                yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(np.zeros(len(x), dtype=bool))], names=names)

    held, last, over = np.zeros(0, np.int64), None, False  # the open bucket; whether it is hot
    for b in batches:
        if not b.num_rows:
            continue
        reps, keys = np.asarray(b.column(0)), np.asarray(b.column(1))
        if last is not None and not over and len(held):
            reps, keys = np.concatenate([held, reps]), np.concatenate([np.full(len(held), last), keys])
        start = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
        size = np.diff(np.concatenate([start, [len(keys)]]))
        big = size > hot
        big[0] |= over and keys[0] == last  # goes on from the batch before
        over, last = bool(big[-1]), keys[-1]
        rows = np.repeat(big, size)
        if rows.any():
            yield pa.record_batch([pa.array(reps[rows]), pa.array(keys[rows]), pa.array(np.ones(int(rows.sum()), dtype=bool))], names=names)
        held = np.zeros(0, np.int64) if over else reps[start[-1] :]
        done = ~big
        done[-1] = False
        yield from emit(reps[np.repeat(done, size)], size[done])
    if not over and len(held):
        yield from emit(held, np.array([len(held)]))


def _pairs_of(bands: DataFrame, hot: int) -> DataFrame:
    def scan(batches):
        yield from bucket_pairs(batches, hot)

    return bands.select("rep", "key").repartition("key").sortWithinPartitions("key").mapInArrow(scan, "a long, b long, hot boolean").distinct()


def close_sketches(x: np.ndarray, y: np.ndarray, steps: list[tuple[int, int]]):
    """Of sketches x and y, some of x at a time, the index pairs that survive the incremental comparison."""
    cols = np.ascontiguousarray(y.T)
    step = max(1, 1_000_000 // max(1, len(y)))
    for c in range(0, len(x), step):
        part, done = x[c : c + step], steps[0][0]
        same = np.zeros((len(part), len(y)), dtype=np.uint8)
        for j in range(done):
            same += part[:, j, None] == cols[j]
        u, v = np.nonzero(same >= steps[0][1])
        match = same[u, v].astype(np.int32)
        for n, m in steps[1:]:
            match += (part[u, done:n] == y[v, done:n]).sum(axis=1, dtype=np.int32)
            keep = match >= m
            u, v, match, done = u[keep], v[keep], match[keep], n
        yield u + c, v


def hot_pairs(big: DataFrame, rep: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Distinct (a < b) of rows (rep, key) of hot buckets whose sketches survive; every pair of a bucket is compared.

    A bucket is cut by hash into blocks of some ``block`` rows, and every two
    of them (and each with itself) meet in a group of their own.
    """
    steps = least_matches(threshold)
    size = big.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    rows = big.join(size, "key").join(rep.select("rep", "sketch"), "rep")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int"))
    rows = rows.select("rep", "key", "sketch", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    rows = rows.select("rep", "key", "sketch", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(t: pa.Table) -> pa.Table:
        reps, own = np.asarray(t.column("rep")), np.asarray(t.column("own"))
        s = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, N_SKETCH)
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        x, y = np.flatnonzero(own == i), np.flatnonzero(own == j)
        out = [np.zeros((2, 0), dtype=np.int64)]
        for u, v in close_sketches(s[x], s[y], steps):
            a, b = reps[x[u]], reps[y[v]]
            keep = a < b if i == j else a != b
            out.append(np.stack([np.minimum(a, b)[keep], np.maximum(a, b)[keep]]))
        a, b = np.concatenate(out, axis=1)
        return pa.table([a, b], schema=schema)

    return rows.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def candidate_pairs(rep: DataFrame, hot: int = HOT, threshold: float = 0.0, block: int = BLOCK) -> DataFrame:
    """Distinct (a < b) of rows (rep, keys, sketch) that share a band; of hot buckets those whose sketches may reach the threshold."""
    found = checkpointed(_pairs_of(_bands(rep), hot))
    pairs, big = found.where("not hot").select("a", "b"), found.where("hot").select(F.col("a").alias("rep"), F.col("b").alias("key"))
    if big.isEmpty():
        return pairs
    return pairs.unionByName(hot_pairs(big, rep, threshold, block)).distinct()


def likely_pairs(pairs: DataFrame, rep: DataFrame, threshold: float) -> DataFrame:
    """Candidates (a, b) that survive the incremental comparison of sketches."""
    steps = least_matches(threshold)

    def prune(b):
        if not b.num_rows:
            return None
        x, y = (np.frombuffer(b"".join(b.column(j).to_pylist()), dtype=np.uint8).reshape(-1, N_SKETCH) for j in (2, 3))
        alive, done = np.arange(b.num_rows), 0
        match = np.zeros(b.num_rows, dtype=np.int32)
        for n, m in steps:
            match[alive] += (x[alive, done:n] == y[alive, done:n]).sum(axis=1, dtype=np.int32)
            alive, done = alive[match[alive] >= m], n
        return {"a": b.column(0).take(pa.array(alive)), "b": b.column(1).take(pa.array(alive))}

    v = rep.select("rep", "sketch")
    p = pairs.join(v.select(F.col("rep").alias("a"), F.col("sketch").alias("x")), "a").join(v.select(F.col("rep").alias("b"), F.col("sketch").alias("y")), "b")
    return map_rows(p.select("a", "b", "x", "y"), prune, "a long, b long")


def similar_texts(texts: DataFrame, threshold: float = 0.8, k: int = 5, min_words: int = 1, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(links, members) of rows (id, text).

    links (a, b, similarity): classes of different word sequences whose
    shingle sets have at least the threshold's Jaccard similarity.
    members (id, rep): the class of every text with at least min_words words.
    Null ids and null texts take no part; repeated rows of an id count once.
    """
    rows = checkpointed(signed(texts, k, min_words, band_rows(threshold)))
    rep, members = checkpointed(representatives(rows)), rows.select("id", "rep").distinct()
    likely = checkpointed(likely_pairs(candidate_pairs(rep, hot, threshold), rep, threshold))
    needed = likely.select(F.col("a").alias("rep")).unionByName(likely.select(F.col("b").alias("rep"))).distinct().join(rep.select("rep", "id"), "rep")
    needed = checkpointed(needed)

    def sets(b):
        out = []
        with np.errstate(over="ignore"):
            for t in b.column(1).to_pylist():
                out.append(shingles(word_hashes(WORD.findall(one_form(t).lower())), k).view(np.int64))
        return {"rep": b.column(0), "sh": pa.array(out, type=pa.list_(pa.int64()))}

    t = _source(texts)
    if needed.count() <= BROADCAST_ROWS:
        needed = F.broadcast(needed)
    sh = map_rows(t.join(needed, "id").select("rep", "text"), sets, "rep long, sh array<long>").dropDuplicates(["rep"])
    x = likely.join(sh.select(F.col("rep").alias("a"), F.col("sh").alias("x")), "a").join(sh.select(F.col("rep").alias("b"), F.col("sh").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    links = x.select("a", "b", (both / (F.size("x") + F.size("y") - both)).alias("similarity")).where(F.col("similarity") >= threshold)
    return links, members


def similar_pairs(texts: DataFrame, threshold: float, k: int, min_words: int) -> DataFrame:
    """All pairs (id_a < id_b) of ids whose texts reach the similarity, copies included; the stated result of p2_found."""
    links, members = similar_texts(texts, threshold, k, min_words)
    links, members = checkpointed(links), checkpointed(members)
    two = members.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    both = expand_pairs(members.withColumnRenamed("rep", "cls"), two.unionByName(links.select("a", "b")))
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def similar_classes(texts: DataFrame, threshold: float = 0.8, k: int = 5, min_words: int = 1) -> DataFrame:
    """One row per id: its class of equal word sequences, the class' size and its number of links to other classes."""
    links, members = similar_texts(texts, threshold, k, min_words)
    ends = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep")))
    n = ends.groupBy("rep").agg(F.count("*").alias("n_links"))
    size = members.groupBy("rep").agg(F.min("id").alias("class_id"), F.count("*").alias("n_copies"))
    return members.join(size.join(n, "rep", "left"), "rep").select("id", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
