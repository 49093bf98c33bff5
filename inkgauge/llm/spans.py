"""Problem 4: long spans that stand word for word in records of other origins.

A truncated, prefix-partitioned suffix tree over tokens:

1. Seeds. In every window of ``length`` tokens the smallest hash of its runs
   of SEED tokens is a seed. Two equal windows have the same seed, so a window
   without a seed known from another origin can't be shared; only seeds' (hash,
   lowest and highest origin) are aggregated, map-side first.
2. Suffixes. Every window start that holds a shared seed is a suffix, written
   as its path of four edges (hashes of its tokens 0-7, 8-15, 16-23 and the
   rest). Deeper levels aren't needed: any deeper node lies under one of depth
   ``length``, and the union of the windows below these nodes is what longer
   repeats cover.
3. Subtrees. Range partitioning cuts the sorted paths by sampled prefixes of
   whatever length makes groups of even size, record included, so that a
   repeat held by a third of all records is cut as well. Every group walks its
   suffixes in order; a node of full depth with two origins is a repeat. Nodes
   at a group's ends may go on in the next group: these, two per group, are
   put together afterwards.
4. Consecutive repeated windows of a record merge into its maximal spans.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkgauge.llm.common import map_rows
from inkgauge.llm.neardup import _mix, word_hashes
from inkgauge.session import checkpointed, ship_code

LENGTH, SEED = 30, 12
GROUP_ROWS = 2_000_000  # suffixes to a subtree, some 80 MB
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(0xFFFFFFFF00000000)
ROWS_PER_STEP = 400


def _roll(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k values; 0 beyond the end."""
    out = np.zeros(len(h), dtype=np.uint64)
    if len(h) >= k:
        acc = np.zeros(len(h) - k + 1, dtype=np.uint64)
        for j in range(k):
            acc = _mix(acc * _GOLD + h[j : len(h) - k + 1 + j])
        out[: len(acc)] = acc
    return out


def _slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over x[i : i + w] for each i that has w values."""
    m, have = x, 1
    while have * 2 <= w:
        m = op(m[: len(m) - have], m[have:])
        have *= 2
    return m if have == w else op(m[: len(m) - (w - have)], m[w - have :])


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts in a row, the text of each token, and the end of that text."""
    lists = [t.split() for t in texts]
    n = np.array([len(x) for x in lists], dtype=np.int64)
    h = np.concatenate([word_hashes(x) for x in lists if x]) if n.sum() else np.zeros(0, np.uint64)
    return h, np.repeat(np.arange(len(texts)), n), np.repeat(np.cumsum(n), n)


def seeds(h: np.ndarray, ends: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all seeds; ties within a window are all taken."""
    at = np.arange(len(h))
    if len(h) < length:
        return at[:0], h[:0]
    g = _roll(h, seed)
    w = length - seed + 1
    low = _slide(g, w, np.minimum)  # per window start
    low = np.where(at[: len(low)] + length <= ends[: len(low)], low, np.uint64(0))[: len(h) - length + 1]
    pad = np.zeros(w - 1, dtype=np.uint64)
    best = _slide(np.concatenate([pad, low, pad]), w, np.maximum)  # per seed position: the highest minimum of the windows over it
    ok = np.zeros(len(h), dtype=bool)
    ok[: len(best)] = (best == g[: len(best)]) & (best != 0)
    return at[ok], g[ok]


def _steps(b: pa.RecordBatch):
    for k in range(0, b.num_rows, ROWS_PER_STEP):
        yield b.slice(k, ROWS_PER_STEP)


def shared_windows(records: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(rec, pos): hashed record ids and token positions where ``length`` tokens begin that stand in another origin too.

    rec is xxhash64(rec_id). A null origin counts as one origin of its own.
    """
    if seed >= length:
        raise ValueError("a seed must be shorter than a span")
    spark = records.sparkSession
    ship_code(spark)
    src = records.where("text is not null and rec_id is not null").select(F.xxhash64("rec_id").alias("rec"), F.xxhash64(F.coalesce("origin", F.lit("\0"))).alias("org"), "text")

    def find(b):
        parts = []
        with np.errstate(over="ignore"):
            for s in _steps(b):
                h, who, ends = _tokens(s.column(2).to_pylist())
                pos, g = seeds(h, ends, length, seed)
                start = np.searchsorted(who, who[pos])
                rows = pa.array(who[pos])
                parts.append((g.view(np.int64), s.column(0).take(rows), s.column(1).take(rows), (pos - start).astype(np.int32)))
        if not parts:
            return None
        return {"seed": pa.array(np.concatenate([p[0] for p in parts])), "rec": pa.concat_arrays([p[1] for p in parts]), "org": pa.concat_arrays([p[2] for p in parts]), "pos": pa.array(np.concatenate([p[3] for p in parts]))}

    found = map_rows(src, find, "seed long, rec long, org long, pos int")
    shared = found.groupBy("seed").agg(F.min("org").alias("lo"), F.max("org").alias("hi")).where("lo < hi").select("seed")
    hits = found.select("seed", "rec", "pos").join(shared, "seed", "left_semi").groupBy("rec").agg(F.collect_set("pos").alias("hits"))

    def paths(b):
        parts = []
        with np.errstate(over="ignore"):
            for s in _steps(b):
                h, who, ends = _tokens(s.column(2).to_pylist())
                if len(h) < length:
                    continue
                first = np.searchsorted(who, np.arange(s.num_rows))
                hit = s.column(3)
                at = np.asarray(hit.flatten()).astype(np.int64) + np.repeat(first, np.asarray(pc.list_value_length(hit)))
                delta = np.zeros(len(h) + 1, dtype=np.int32)
                lo = np.maximum(at - (length - seed), first[who[at]])
                np.add.at(delta, lo, 1)
                np.add.at(delta, at + 1, -1)
                start = np.flatnonzero((np.cumsum(delta[:-1]) > 0) & (np.arange(len(h)) + length <= ends))
                e8, rest = _roll(h, 8), _roll(h, length - 24)
                k1 = (e8[start] & _TOP) | (e8[start + 8] >> np.uint64(32))
                k2 = (e8[start + 16] & _TOP) | (rest[start + 24] >> np.uint64(32))
                rows = pa.array(who[start])
                parts.append((k1.view(np.int64), k2.view(np.int64), s.column(0).take(rows), s.column(1).take(rows), (start - first[who[start]]).astype(np.int32)))
        if not parts:
            return None
        j = [np.concatenate([p[i] for p in parts]) if i in (0, 1, 4) else pa.concat_arrays([p[i] for p in parts]) for i in range(5)]
        return {"k1": pa.array(j[0]), "k2": pa.array(j[1]), "rec": j[2], "org": j[3], "pos": pa.array(j[4])}

    suffixes = checkpointed(map_rows(src.join(hits.hint("shuffle_hash"), "rec").select("rec", "org", "text", "hits"), paths, "k1 long, k2 long, rec long, org long, pos int"))
    # as many groups as keep each within GROUP_ROWS suffixes
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(suffixes.count() / GROUP_ROWS))
    ordered = suffixes.repartitionByRange(parts, "k1", "k2", "rec").sortWithinPartitions("k1", "k2")
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("rec", pa.int64()), ("org", pa.int64()), ("pos", pa.int32()), ("edge", pa.bool_())])

    def walk(batches):
        yield from walk_subtree(batches, schema)

    walked = checkpointed(ordered.mapInArrow(walk, "k1 long, k2 long, rec long, org long, pos int, edge boolean"))
    # at most two nodes per group are edges, however many rows they hold
    edges = walked.where("edge")
    nodes = edges.groupBy("k1", "k2").agg(F.min("org").alias("lo"), F.max("org").alias("hi")).where("lo < hi").select("k1", "k2")
    inner = walked.where("not edge").select("rec", "pos")
    return inner.unionByName(edges.join(F.broadcast(nodes), ["k1", "k2"], "left_semi").where("pos >= 0").select("rec", "pos"))


def walk_subtree(batches, schema: pa.Schema):
    """Rows of the nodes with two origins in a sorted group, and the edges: its first and last node.

    Holds one batch and the rows of an open node of one origin so far. A last
    node known to be a repeat sends two rows at position -1, its lowest and
    highest origin, in place of its rows.
    """
    key, lo, hi, first = None, 0, 0, True
    held: list[pa.RecordBatch] = []

    def out(b: pa.RecordBatch, edge: bool) -> pa.RecordBatch:
        return pa.record_batch([*b.columns, pa.array(np.full(b.num_rows, edge))], schema=schema)

    for b in batches:
        if not b.num_rows:
            continue
        k1, k2, org = (np.asarray(b.column(i)) for i in (0, 1, 3))
        cut = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
        start, end = np.concatenate([[0], cut]), np.concatenate([cut, [b.num_rows]])
        low, high = np.minimum.reduceat(org, start), np.maximum.reduceat(org, start)
        last, i = len(start) - 1, 0
        if key == (k1[0], k2[0]):  # the open node goes on
            lo, hi, i = min(lo, low[0]), max(hi, high[0]), 1
            held.append(b.slice(0, end[0]))
        elif key is None:  # the first node begins
            key, lo, hi, i = (k1[0], k2[0]), low[0], high[0], 1
            held.append(b.slice(0, end[0]))
        if first or lo != hi:
            for x in held:
                yield out(x, first)
            held = []
        if i > last:
            continue
        first, held = False, []
        rows = np.repeat(low[i:last] != high[i:last], (end - start)[i:last])
        if rows.any():
            yield out(b.slice(start[i], len(rows)).filter(pa.array(rows)), False)
        key, lo, hi = (k1[-1], k2[-1]), low[last], high[last]
        held = [b.slice(start[last])]
        if lo != hi:
            yield out(held.pop(), False)
    for x in held:
        yield out(x, True)
    if key is not None and not first and lo != hi:
        yield pa.record_batch([pa.array([key[0]] * 2), pa.array([key[1]] * 2), pa.array([0, 0]), pa.array([lo, hi]), pa.array([-1, -1], pa.int32()), pa.array([True, True])], schema=schema)


def sharing_records(records: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rec_id of records that hold ``length`` tokens which stand in a record of another origin."""
    rec = shared_windows(records, length).select("rec").distinct()
    ids = records.where("text is not null and rec_id is not null").select("rec_id", F.xxhash64("rec_id").alias("rec"))
    return ids.join(rec, "rec", "left_semi").select("rec_id").distinct()


def maximal_spans(records: DataFrame, length: int = LENGTH) -> DataFrame:
    """(rec_id, start, n_tokens): the runs of a record all of whose windows stand in another origin, from their first token (0 on).

    Neighbouring windows make one span; two spans of a record overlap by less
    than a window. Repeated rows of a record count once.
    """
    spans = _spans(records, length).select("rec", F.col("a").alias("start"), (F.col("b") - F.col("a")).alias("n_tokens"))
    return _ids(records).join(spans, "rec").select("rec_id", "start", "n_tokens")


def _ids(records: DataFrame) -> DataFrame:
    return records.where("text is not null and rec_id is not null").select("rec_id", F.xxhash64("rec_id").alias("rec")).distinct()


def _spans(records: DataFrame, length: int) -> DataFrame:
    """(rec, a, b): maximal runs of shared windows, as token ranges."""
    pos = shared_windows(records, length).groupBy("rec").agg(F.array_sort(F.collect_set("pos")).alias("p"))  # bounded by the text
    runs = pos.select("rec", F.explode(F.arrays_zip(F.col("p").alias("p"), F.expr("transform(p, (x, i) -> x - i)").alias("g"))).alias("z")).select("rec", "z.p", "z.g")
    return runs.groupBy("rec", "g").agg(F.min("p").alias("a"), (F.max("p") + length).alias("b")).drop("g")


def shared_share(records: DataFrame, length: int = LENGTH) -> DataFrame:
    """(rec_id, n_tokens, shared_tokens, n_spans, longest_span, shared_share) of every record with a shared span."""
    # spans may overlap by less than a window between two runs: a token counts once
    w = Window.partitionBy("rec").orderBy("a")
    spans = _spans(records, length).withColumn("from", F.greatest("a", F.coalesce(F.lag("b").over(w), F.lit(0))))
    per = spans.groupBy("rec").agg(F.sum(F.col("b") - F.col("from")).alias("shared_tokens"), F.count("*").alias("n_spans"), F.max(F.col("b") - F.col("a")).alias("longest_span"))
    ids = records.where("text is not null and rec_id is not null").select("rec_id", F.xxhash64("rec_id").alias("rec"), F.size(F.filter(F.split("text", "(?U)\\s+"), lambda x: x != "")).alias("n_tokens")).dropDuplicates(["rec_id"])
    return ids.join(per, "rec").select("rec_id", "n_tokens", "shared_tokens", "n_spans", "longest_span", (F.col("shared_tokens") / F.col("n_tokens")).alias("shared_share"))
