"""Problem 8: held-out items that stand, whole or in part, in documents.

Two kinds of windows of an item are fingerprinted (64-bit SimHash of their
words) and sought among a document's windows of the same size:

* item-sized ones, the first and the last of the largest size class within the
  item (classes grow by a quarter), within RADIUS bits: an item with some of
  its words changed;
* those in its runs of RUN words (in the whole item, if it is shorter), within
  RUN_RADIUS bits: a part of an item.

A document's windows are taken at every STRIDE-th word alone. Both kinds are
short enough by STRIDE - 1 words for each run, and each item, to hold one that
begins at such a word, whatever its place; the item's windows at all of STRIDE
neighbouring places are in the index.

Multi-index Hamming blocks find all fingerprints within a radius r: with m
blocks, one of them is within r // m bits, so every key of an item's block
within that distance is in the table of the block. Candidates are verified on
the words: a run counts if it is equal word by word, an item if the weighted
share of its shingles of GRAM words that stand in the document is SHARE or
more. Equal windows have equal fingerprints, so no exact run is lost.

Items are the stated query set. They travel to the tasks in blocks of some
BLOCK_WORDS words, one pass over the documents per block; the driver holds one
block at a time. Shingle weights come from all items.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgauge.llm.common import WORD, map_rows
from inkgauge.llm.neardup import word_hashes
from inkgauge.llm.spans import _roll
from inkgauge.session import checkpointed

RUN, RUN_RADIUS, RUN_BLOCKS, STRIDE, SHORTEST = 13, 1, 2, 4, 8
RADIUS, BLOCKS, GROWTH = 8, 3, 1.25
GRAM, SHARE = 5, 0.8
BLOCK_WORDS = 500_000
ROWS_PER_STEP = 150
_MASK_BITS = 21


def size_class(n: int, growth: float = GROWTH) -> int:
    """The largest class of sizes that isn't above n."""
    k = RUN
    while True:
        after = max(k + 1, round(k * growth))
        if after > n:
            return min(k, n)
        k = after


def bit_sums(h: np.ndarray, longest: int) -> np.ndarray:
    """Running sums of the 64 bits of values, from 0 on; they wrap around, which differences over up to ``longest`` values don't see."""
    t = np.uint8 if longest < 256 else np.uint16 if longest < 65536 else np.uint32
    out = np.zeros((len(h) + 1, 64), dtype=t)
    np.cumsum(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=t, out=out[1:])
    return out


def fingerprints(sums: np.ndarray, size: int, stride: int = 1) -> np.ndarray:
    """SimHash of every stride-th window of size values: a bit is set if it is in more than half of the values."""
    if len(sums) <= size:
        return np.zeros(0, np.uint64)
    return np.packbits((sums[size::stride] - sums[:-size:stride]) > size // 2, axis=1).view(np.uint64).ravel()


def run_window(n: int, run: int) -> tuple[int, int, int]:
    """(run, window, stride) of an item of n words: every run holds a window that begins at a multiple of the stride."""
    run = min(run, n)
    return (run, run, 1) if run < SHORTEST else (run, run - STRIDE + 1, STRIDE)


def blocks_of(f: np.ndarray, n: int) -> list[tuple[np.ndarray, int]]:
    """n disjoint blocks of the bits, and their widths."""
    edge = [64 * k // n for k in range(n + 1)]
    return [((f >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1), b - a) for a, b in zip(edge, edge[1:])]


class HammingIndex:
    """Fingerprints within a radius of given ones, by tables of the keys near each of their blocks."""

    def __init__(self, f: np.ndarray, radius: int, n: int):
        self.f, self.radius, self.n = f, radius, n
        self.tables = []
        for block, width in blocks_of(f, n):
            keys, rows = [block], [np.arange(len(f))]
            for d in range(1, radius // n + 1):
                for bits in itertools.combinations(range(width), d):
                    keys.append(block ^ np.uint64(sum(1 << b for b in bits)))
                    rows.append(rows[0])
            key, row = np.concatenate(keys), np.concatenate(rows)
            order = np.argsort(key, kind="stable")
            mask = np.zeros(1 << _MASK_BITS, dtype=bool)
            mask[(key & np.uint64((1 << _MASK_BITS) - 1)).astype(np.int64)] = True
            self.tables.append((key[order], row[order], mask))

    def near(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in g, places in the index) of all pairs within the radius."""
        found: list[np.ndarray] = []
        for (keys, row, mask), (block, _) in zip(self.tables, blocks_of(g, self.n), strict=True):
            at = np.flatnonzero(mask[(block & np.uint64((1 << _MASK_BITS) - 1)).astype(np.int64)])
            lo, hi = np.searchsorted(keys, block[at], "left"), np.searchsorted(keys, block[at], "right")
            n = hi - lo
            if not n.sum():
                continue
            a = np.repeat(at, n)
            b = row[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            ok = np.bitwise_count(g[a] ^ self.f[b]) <= self.radius
            found.append(np.stack([a[ok], b[ok]]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pair = np.unique(np.concatenate(found, axis=1), axis=1)
        return pair[0], pair[1]


class ItemIndex:
    """The windows of items (id, words, shingles, weights) by size."""

    def __init__(self, items: list[tuple], run: int, radius: int):
        self.ids = [i[0] for i in items]
        hashes = [word_hashes(i[1]) for i in items]
        self.grams = [(np.array(g, dtype=np.int64).view(np.uint64), np.array(w)) for _, _, g, w in items]
        self.words = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        first = np.cumsum([0, *(len(h) for h in hashes)])
        self.longest = longest = max((len(h) for h in hashes), default=1)
        parts: dict[tuple, list[tuple]] = {}
        whole: dict[int, list[tuple]] = {}
        for k, h in enumerate(hashes):
            s, kind = bit_sums(h, longest), run_window(len(h), run)
            f = fingerprints(s, kind[1])
            # the places before and behind a window that its item has
            parts.setdefault(kind, []).append((f, np.full(len(f), k), first[k] + np.arange(len(f)), np.arange(len(f)), len(h) - np.arange(len(f))))
            if len(h) > run:
                size = size_class(len(h) - STRIDE + 1)
                f = fingerprints(s, size)
                f = np.concatenate([f[:STRIDE], f[max(STRIDE, len(f) - STRIDE) :]])
                whole.setdefault(size, []).append((f, np.full(len(f), k)))
        cat = lambda rows: [np.concatenate(c) for c in zip(*rows)]
        self.parts = {kind: (HammingIndex(c[0], RUN_RADIUS, RUN_BLOCKS), *c[1:]) for kind, c in ((kind, cat(r)) for kind, r in sorted(parts.items()))}
        self.whole = {size: (HammingIndex(c[0], radius, BLOCKS), c[1]) for size, c in ((size, cat(r)) for size, r in sorted(whole.items()))}

    def equal_runs(self, h: np.ndarray, a: np.ndarray, w: np.ndarray, before: np.ndarray, behind: np.ndarray, kind: tuple, table: tuple) -> np.ndarray:
        """Whether the windows at a of h and w of the table lie in a run of equal words; before and behind are the words of h's text on either side of a."""
        _, _, place, left, right = table
        run, window, _ = kind
        out = np.zeros(len(a), dtype=bool)
        for shift in range(run - window + 1):
            ok = np.flatnonzero(~out & (before >= shift) & (left[w] >= shift) & (behind >= run - shift) & (right[w] >= run - shift))
            if len(ok):
                at = np.arange(run) - shift
                out[ok] = (h[a[ok, None] + at] == self.words[place[w[ok], None] + at]).all(axis=1)
        return out


def scan(b: pa.RecordBatch, index: ItemIndex, share: float) -> dict:
    out = {n: [] for n in ("doc_id", "item_id", "n_windows", "n_exact", "item_share")}
    with np.errstate(over="ignore"):
        for k in range(0, b.num_rows, ROWS_PER_STEP):
            s = b.slice(k, ROWS_PER_STEP)
            ids = s.column(0).to_pylist()
            lists = [WORD.findall(t.lower()) for t in s.column(1).to_pylist()]
            n = np.array([len(x) for x in lists])
            if not n.sum():
                continue
            h = np.concatenate([word_hashes(x) for x in lists if x])
            who, ends = np.repeat(np.arange(len(lists)), n), np.repeat(np.cumsum(n), n)
            sums = bit_sums(h, max(index.longest, 1))
            pairs: dict[tuple[int, int], list[int]] = {}

            def add(a, item, kind):
                for d, i in zip(who[a].tolist(), item.tolist(), strict=True):
                    pairs.setdefault((d, i), [0, 0])[kind] += 1

            start = ends - n[who]
            for kind, table in index.parts.items():
                _, size, stride = kind
                a, w = table[0].near(fingerprints(sums, size, stride))
                a *= stride
                ok = a + size <= ends[a]
                a, w = a[ok], w[ok]
                if len(a):
                    ok = index.equal_runs(h, a, w, a - start[a], ends[a] - a, kind, table)
                    add(a[ok], table[1][w[ok]], 1)
            for size, (table, item) in index.whole.items():
                a, w = table.near(fingerprints(sums, size, STRIDE))
                a *= STRIDE
                ok = a + size <= ends[a]
                add(a[ok], item[w[ok]], 0)
            first = np.concatenate([[0], np.cumsum(n)])
            grams: dict[int, np.ndarray] = {}
            for (d, i), (near, exact) in pairs.items():
                g, weight = index.grams[i]
                if d not in grams:
                    grams[d] = np.unique(grams_of(h[first[d] : first[d + 1]]))
                have = float((weight * (grams[d][np.minimum(np.searchsorted(grams[d], g), len(grams[d]) - 1)] == g)).sum() / weight.sum())
                if exact or have >= share:
                    for c, v in zip(out, (ids[d], index.ids[i], near, exact, have), strict=True):
                        out[c].append(v)
    return out


def grams_of(h: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Hashes of the runs of k words; of a text of fewer words the hash of all."""
    k = max(1, min(k, len(h)))
    return _roll(h, k)[: len(h) - k + 1] if len(h) else h


def weighted_items(items: DataFrame) -> DataFrame:
    """(item_id, text, grams, weights) of the distinct items with words; a shingle weighs more the fewer items it is in."""

    def cut(b):
        with np.errstate(over="ignore"):
            words = [WORD.findall(t.lower()) for t in b.column(1).to_pylist()]
            grams = [np.unique(grams_of(word_hashes(w))).view(np.int64) if w else [] for w in words]
        return {"item_id": b.column(0), "text": b.column(1), "words": [len(w) for w in words], "grams": pa.array(grams, type=pa.list_(pa.int64()))}

    src = items.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    x = checkpointed(map_rows(src, cut, "item_id long, text string, words int, grams array<long>").where("words > 0"))
    n = x.count()
    g = x.select("item_id", F.xxhash64("text").alias("t"), F.explode("grams").alias("gram"))
    df = g.groupBy("gram").agg(F.count("*").alias("df"))
    w = g.join(df, "gram").groupBy("item_id", "t").agg(F.sort_array(F.collect_list(F.struct("gram", F.log(1 + F.lit(float(n)) / F.col("df")).alias("w")))).alias("z"))
    return x.withColumn("t", F.xxhash64("text")).join(w, ["item_id", "t"]).select("item_id", "text", "words", F.col("z.gram").alias("grams"), F.col("z.w").alias("weights"))


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, radius: int = RADIUS, share: float = SHARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, n_windows, n_exact, item_share): pairs with an equal run, or an item_share of ``share`` or more.

    n_windows counts item-sized windows within the radius, n_exact windows in
    runs equal word by word; item_share is the weighted share of the item's shingles in
    the document. Null texts and texts without words take no part. A doc_id or
    item_id that is repeated counts once per distinct text; its best row is
    kept. Items are found by their windows alone: one with more changes than
    the radius covers is missed however high its share (README gives figures).
    """
    spark = documents.sparkSession
    known = checkpointed(weighted_items(items))
    total = known.agg(F.sum("words")).first()[0] or 0
    n = max(1, math.ceil(total / block_words))
    docs = documents.where("text is not null and doc_id is not null").select("doc_id", "text")
    schema = "doc_id long, item_id long, n_windows long, n_exact long, item_share double"
    out = None
    for k in range(n):
        rows = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()  # some block_words words
        block = [(r["item_id"], WORD.findall(r["text"].lower()), r["grams"], r["weights"]) for r in sorted(rows, key=lambda r: (r["item_id"], r["text"]))]
        sent = spark.sparkContext.broadcast((block, run, radius))
        held: dict = {}

        def find(b, sent=sent, held=held):
            if "index" not in held:
                with np.errstate(over="ignore"):
                    held["index"] = ItemIndex(*sent.value)
            return scan(b, held["index"], share)

        part = map_rows(docs, find, schema)
        part = checkpointed(part) if n > 1 else part
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max("n_exact").alias("n_exact"), F.max("item_share").alias("item_share"))


def exact_leaks(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, item_id) with run consecutive words of the item, or all of a shorter one, in the document."""
    return leaks(documents, items, run).where("n_exact > 0").select("doc_id", "item_id")
