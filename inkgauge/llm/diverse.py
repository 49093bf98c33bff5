"""Problem 7: a varied subset by max-sum dispersion.

Rows are cut by a hash of their id into blocks of some BLOCK; of each block
and scope (the store, a voice) a core-set is formed by farthest-first
traversal. The core-sets of FAN_IN blocks are put together and reduced in the
same way, in the levels of a tree, until one is left per scope.
There a local search starts from the farthest-first choice and swaps a chosen
vector for another one as long as the sum of pairwise distances grows and the
quotas hold: no file more than its due places, no two chosen vectors of one
family (cosine of FAMILY or more).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgauge.llm.common import map_rows
from inkgauge.llm.vectors import DIM, pack, unit, unpack, usable_vectors
from inkgauge.session import checkpointed, ship_code

K, FAMILY, BLOCK, FAN_IN = 64, 0.8, 8192, 64


def farthest_first(x: np.ndarray, ids: list[str], m: int, files: list[str] | None = None, due: dict[str, int] | None = None, family: float | None = None) -> list[int]:
    """Up to m rows, each the one farthest from those before; starts farthest from the mean; ties to the smaller id.

    With quotas, a file stops at its due places; with family, closer vectors are passed over.
    """
    if not len(x):
        return []
    rank = np.argsort(np.argsort(np.array(ids, dtype=object), kind="stable"), kind="stable")
    near = np.full(len(x), -2.0)  # the highest cosine to a chosen one
    free = np.ones(len(x), dtype=bool)
    mean = x.mean(axis=0)
    score = x @ mean
    out: list[int] = []
    taken: dict[str, int] = {}
    group = np.unique(np.array(files, dtype=object), return_inverse=True)[1] if files is not None else None
    while len(out) < m and free.any():
        at = np.where(free, score if not out else near, 9.0)
        low = at.min()
        tie = np.flatnonzero(at <= low + 1e-9)
        j = int(tie[np.argmin(rank[tie])])
        if family is not None and out and near[j] >= family:
            break
        out.append(j)
        free[j] = False
        near = np.maximum(near, x @ x[j])
        if group is not None:
            f = files[j]
            taken[f] = taken.get(f, 0) + 1
            if taken[f] >= due.get(f, 1):
                free &= group != group[j]
    return out


def swap_search(x: np.ndarray, chosen: list[int], files: list[str], due: dict[str, int], family: float) -> list[int]:
    """Local search: the best swap, again and again, while the sum of pairwise distances grows."""
    sel = list(chosen)
    if len(sel) < 2 or len(sel) == len(x):
        return sel
    group = np.unique(np.array(files, dtype=object), return_inverse=True)[1]
    limit = np.zeros(group.max() + 1, dtype=int)
    for f, g in zip(files, group, strict=True):
        limit[g] = due.get(f, 1)
    cos = x @ x[sel].T  # rows: all, columns: chosen
    while True:
        total = (1 - cos).sum(axis=1)  # distance of each to the chosen
        inside = total[sel]  # a chosen one's distance to itself is 0
        count = np.bincount(group[sel], minlength=len(limit))
        close = (cos >= family).sum(axis=1)
        best, move = 1e-9, None
        for c, s in enumerate(sel):
            gain = total - (1 - cos[:, c]) - inside[c]
            ok = close - (cos[:, c] >= family) == 0
            ok &= (count[group] < limit[group]) | (group == group[s])
            ok[sel] = False
            j = int(np.argmax(np.where(ok, gain, -1e9)))
            if ok[j] and gain[j] > best:
                best, move = gain[j], (c, j)
        if move is None:
            return sel
        c, j = move
        sel[c] = j
        cos[:, c] = x @ x[j]


def varied_subset(chunks: DataFrame, k: int = K, dim: int = DIM, family: float = FAMILY, block: int = BLOCK, fan_in: int = FAN_IN) -> DataFrame:
    """(voice, id, filename, rank): up to k exemplars of every voice, and of the store (voice null).

    A file's due places are its share of the scope's usable ids, rounded up.
    Rows with an unusable vector (null, not dim finite values, all zero) aren't
    chosen; repeated rows of an id are one (of the least filename and voice); a
    null filename counts as one file; rows of a null voice stand in the store
    alone. Fewer than k come out if quotas or families leave no more. The
    outcome doesn't depend on how rows are stored or batched.
    """
    spark = chunks.sparkSession
    ship_code(spark)
    src = chunks.where("id is not null").select(F.col("id").cast("string").alias("id"), F.coalesce("filename", F.lit("")).alias("filename"), "voice", "embedding")
    core_size = 2 * k
    blocks = max(1, math.ceil(src.select("id").count() / block))
    core_schema = pa.schema([("scope", pa.string()), ("id", pa.string()), ("filename", pa.string()), ("vec", pa.binary()), ("g", pa.int32()), ("n", pa.int64())])

    def scan(b):
        """Usable rows, one per id of a batch."""
        ids, x = usable_vectors(b.select(["id", "embedding"]), dim)
        place: dict[str, int] = {}
        files, voices = b.column(1).to_pylist(), b.column(2).to_pylist()
        order = lambda j: (files[j], voices[j] is None, voices[j] or "")
        for j, i in enumerate(b.column(0).to_pylist()):
            if i not in place or order(j) < order(place[i]):
                place[i] = j
        first: dict[str, int] = {}
        for j, i in enumerate(ids):
            first.setdefault(i, j)
        return {"id": list(first), "filename": [files[place[i]] for i in first], "voice": [voices[place[i]] for i in first], "vec": [pack(x[j]) for j in first.values()]}

    def cores(batches):
        """Of sorted blocks: the core-set of each scope, and its ids counted by file. The store's is one of the voices' core-sets together."""
        held: dict[str, tuple] = {}
        at = None

        def done():
            if not held:
                return
            out: list[tuple] = []
            ids = sorted(held)
            x = unit(unpack([held[i][2] for i in ids], dim))
            by: dict[str | None, list[int]] = {}
            count: dict[tuple, int] = {}
            for j, i in enumerate(ids):
                f, v, _ = held[i]
                by.setdefault(v, []).append(j)
                for scope in ("*",) if v is None else ("*", f"={v}"):
                    count[scope, f] = count.get((scope, f), 0) + 1

            def core(rows: list[int]) -> list[int]:
                return [rows[r] for r in farthest_first(x[rows], [ids[r] for r in rows], core_size)]

            some = {v: core(rows) for v, rows in by.items()}
            some[None], voices = core(sorted(j for rows in some.values() for j in rows)), {v: r for v, r in some.items() if v is not None}
            for scope, rows in [("*", some[None]), *((f"={v}", r) for v, r in voices.items())]:
                out += [(scope, ids[j], held[ids[j]][0], held[ids[j]][2], at, None) for j in rows]
            out += [(scope, None, f, None, None, n) for (scope, f), n in count.items()]
            yield pa.record_batch([pa.array(c, type=t) for c, t in zip(zip(*out), core_schema.types, strict=True)], schema=core_schema)

        for b in batches:
            for i, f, v, vec, g in zip(*(b.column(c).to_pylist() for c in ("id", "filename", "voice", "vec", "g")), strict=True):
                if g != at:
                    yield from done()
                    held, at = {}, g
                held.setdefault(i, (f, v, vec))  # rows are sorted: the first of an id stays
        yield from done()

    one = map_rows(src, scan, "id string, filename string, voice string, vec binary").withColumn("g", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    one = one.repartition("g").sortWithinPartitions("g", "id", "filename", F.col("voice").asc_nulls_last())
    found = checkpointed(one.mapInArrow(cores, "scope string, id string, filename string, vec binary, g int, n long"))
    both = found.where("n is null").drop("n")
    files = found.where("n is not null").groupBy("scope", "filename").agg(F.sum("n").alias("n"))
    files = files.join(files.groupBy("scope").agg(F.sum("n").alias("all")), "scope").select("scope", "filename", (F.col("n") / F.col("all")).alias("share"))
    out_schema = pa.schema([("scope", pa.string()), ("id", pa.string()), ("filename", pa.string()), ("vec", pa.binary()), ("g", pa.int32())])

    def shrink(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        keep = farthest_first(unit(unpack(t.column("vec").to_pylist(), dim)), t.column("id").to_pylist(), core_size)
        return t.take(pa.array(keep, type=pa.int64())).select(out_schema.names).cast(out_schema)

    while blocks > fan_in:  # a level of the tree: at most fan_in * core_size vectors to a group
        both = both.withColumn("g", F.floor(F.col("g") / fan_in).cast("int")).repartition("scope", "g")
        both = checkpointed(both.groupBy("scope", "g").applyInArrow(shrink, "scope string, id string, filename string, vec binary, g int"))
        blocks = math.ceil(blocks / fan_in)
    final_schema = pa.schema([("voice", pa.string()), ("id", pa.string()), ("filename", pa.string()), ("rank", pa.int32())])

    def choose(t: pa.Table) -> pa.Table:
        by = {i: (f, v, s) for i, f, v, s in zip(t.column("id").to_pylist(), t.column("filename").to_pylist(), t.column("vec").to_pylist(), t.column("share").to_pylist(), strict=True)}
        ids = sorted(by)
        names = [by[i][0] for i in ids]
        due = {f: max(1, math.ceil(k * s - 1e-9)) for f, _, s in by.values()}
        x = unit(unpack([by[i][1] for i in ids], dim)).astype(np.float64)
        sel = swap_search(x, farthest_first(x, ids, k, names, due, family), names, due, family)
        sel.sort(key=lambda j: ids[j])
        n = len(sel)
        scope = t.column("scope")[0].as_py()
        return pa.table([pa.array([None if scope == "*" else scope[1:]] * n, type=pa.string()), pa.array([ids[j] for j in sel]), pa.array([names[j] for j in sel]), pa.array(range(1, n + 1), type=pa.int32())], schema=final_schema)

    joined = both.join(files, ["scope", "filename"]).select("scope", "id", "filename", "vec", "share")
    return joined.groupBy("scope").applyInArrow(choose, "voice string, id string, filename string, rank int")  # at most fan_in * core_size vectors
