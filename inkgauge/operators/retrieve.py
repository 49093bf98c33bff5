"""Retrieval: cosine and keyword top-k, rank fusion, diversification, blended anchors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from inkgauge.functions import patterns as P
from inkgauge.functions import textkit as T


QUERY_BLOCK = 8192


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def normalized(v: Column) -> Column:
    """L2-normalised as doubles; a vector of length zero stays."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double")))


def packed(df: DataFrame, id_col: str, v: str, size: int) -> DataFrame:
    """(ids, m): the vectors of some ``size`` rows as one matrix of doubles, with their ids as an array; null vectors fall out."""
    import numpy as np
    import pyarrow as pa

    kind = df.schema[id_col].dataType.simpleString()

    def pack(batches):
        for b in batches:
            for k in range(0, b.num_rows, size):
                part = b.slice(k, size)
                m = np.array(part.column(1).to_pylist(), dtype=np.float64)
                yield pa.record_batch([pa.array([part.column(0).to_pylist()], type=pa.list_(part.schema.field(0).type)), pa.array([m.tobytes()], type=pa.binary())], names=["ids", "m"])

    return df.where(F.col(v).isNotNull()).select(id_col, v).mapInArrow(pack, f"ids array<{kind}>, m binary")


def vector_topk(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "id", q_col: str = "query_id", v: str = "vec", block: int = QUERY_BLOCK) -> DataFrame:
    """(query, id, sim, rank): the k rows of the highest dot product for each query; ties to the smaller id.

    The queries are a stated set. Rows and queries are packed into matrices on
    the cluster and every two of them are multiplied, which hands on only the k
    best rows (with ties) per query and pair of matrices. Up to ``block``
    queries are sent to all tasks; more stay where they are and meet the rows'
    matrices pair by pair. Null vectors take no part.
    """
    import numpy as np
    import pyarrow as pa

    q_type, id_type = queries.schema[q_col].dataType, rows.schema[id_col].dataType
    w = Window.partitionBy(q_col).orderBy(F.col("sim").desc(), "id")
    asked, held = packed(queries, q_col, v, 1024).select(F.col("ids").alias("q_ids"), F.col("m").alias("q_m")), packed(rows, id_col, v, 1024)
    asked = F.broadcast(asked) if queries.limit(block + 1).count() <= block else asked

    def multiply(batches):
        for b in batches:
            for j in range(b.num_rows):
                names, ids = b.column(2)[j].values, b.column(0)[j].values
                q = np.frombuffer(b.column(3)[j].as_py(), dtype=np.float64).reshape(len(names), -1)
                x = np.frombuffer(b.column(1)[j].as_py(), dtype=np.float64).reshape(len(ids), -1)
                s = q @ x.T
                n = min(k, s.shape[1])
                part = np.argpartition(-s, n - 1, axis=1)[:, :n]
                kth = np.take_along_axis(s, part, 1).min(axis=1, keepdims=True)
                row, col = np.nonzero(s >= kth)  # with all ties
                yield pa.record_batch([names.take(pa.array(row)), ids.take(pa.array(col)), pa.array(s[row, col])], names=[q_col, "id", "sim"])

    pairs = held.join(asked, how="cross")  # the stated queries against all rows, matrix by matrix
    best = pairs.mapInArrow(multiply, f"{q_col} {q_type.simpleString()}, id {id_type.simpleString()}, sim double")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fold_accents(t: Column) -> Column:
    """Lower-cased with the accents of Latin letters off. A fixed table: letters and what they become."""
    return F.translate(F.lower(t), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def postings(docs: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """(id, term, tf, len): terms are folded plain words."""
    w = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), T.find_all(fold_accents(F.col(text)), P.WORD_PLAIN).alias("w"))
    return T.exploded(w, ["id", F.size("w").alias("len")], F.col("w"), "term").groupBy("id", "term", "len").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, id_col: str = "id", q_col: str = "query_id", q_text: str = "text", text: str = "text") -> DataFrame:
    """(query, id, score): BM25 of every document that has a term of the query; lower is better.

    Terms of the queries are few: postings are cut to them before any shuffle
    by a join the planner broadcasts while it is small.
    """
    terms = queries.where(F.col(q_text).isNotNull()).select(q_col, F.explode(F.array_distinct(T.query_terms(fold_accents(F.col(q_text))))).alias("term"))
    base = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), T.find_all(fold_accents(F.col(text)), P.WORD_PLAIN).alias("w"))
    stats = base.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avglen"))
    wanted = terms.select("term").distinct()
    post = T.exploded(base, ["id", F.size("w").alias("len")], F.col("w"), "term").join(wanted, "term", "left_semi").groupBy("term", "id", "len").agg(F.count("*").alias("tf"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw <= 0, F.lit(1e-6)).otherwise(raw)
    tf = F.col("tf")
    part = idf * tf * (P.BM25_K1 + 1) / (tf + P.BM25_K1 * (1 - P.BM25_B + P.BM25_B * F.col("len") / F.col("avglen")))
    x = post.join(df, "term").join(terms, "term").crossJoin(F.broadcast(stats))  # stats is one row
    return x.groupBy(q_col, "id").agg((-F.sum(part)).alias("score"))


def topk(scored: DataFrame, k: int, q_col: str = "query_id", score: str = "score", ascending: bool = True) -> DataFrame:
    w = Window.partitionBy(q_col).orderBy(F.col(score).asc() if ascending else F.col(score).desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rrf(lists: list[DataFrame], limit: int, q_col: str = "query_id", excluded: DataFrame | None = None) -> DataFrame:
    """(query, id, rrf, rank) fused from ranked lists (query, id, rank).

    Excluded ids fall out after the lists were cut; ranks are then counted
    without gaps. Ties go to the earlier list's better rank, then to the id.
    """
    parts = []
    for i, one in enumerate(lists):
        x = one.select(q_col, "id", "rank")
        if excluded is not None:
            x = x.join(excluded, "id", "left_anti")
        r = F.row_number().over(Window.partitionBy(q_col).orderBy("rank"))
        parts.append(x.select(q_col, "id", (F.lit(1.0) / (P.RRF_K + r)).alias("s"), F.struct(F.lit(i).alias("l"), r.alias("r")).alias("o")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    f = u.groupBy(q_col, "id").agg(F.sum("s").alias("rrf"), F.min("o").alias("o"))
    w = Window.partitionBy(q_col).orderBy(F.col("rrf").desc(), "o", "id")
    return f.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select(q_col, "id", "rrf", "rank")


def mmr(pool: DataFrame, k: int, q_col: str = "query_id", weight: float = P.MMR_LAMBDA) -> DataFrame:
    """(query, id, pick): greedy picks from a pool (query, id, rank, sim, vec) of bounded size per query."""
    import numpy as np

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("rank", kind="stable").reset_index(drop=True)
        x = np.array(p["vec"].tolist(), dtype=np.float64)
        sim = p["sim"].to_numpy()
        near = np.zeros(len(p))
        free = np.ones(len(p), dtype=bool)
        out = []
        while free.any() and len(out) < k:
            j = int(np.argmax(np.where(free, weight * sim - (1 - weight) * near, -np.inf)))
            near = x @ x[j] if not out else np.maximum(near, x @ x[j])
            free[j] = False
            out.append(j)
        return pd.DataFrame({q_col: p[q_col].iloc[out], "id": p["id"].iloc[out], "pick": range(1, len(out) + 1)})

    s = pool.schema
    return pool.groupBy(q_col).applyInPandas(pick, f"{q_col} {s[q_col].dataType.simpleString()}, id {s['id'].dataType.simpleString()}, pick int")


def recency_ranked(scored: DataFrame, order: str, q_col: str = "query_id") -> DataFrame:
    """(…, blended): similarity plus 0 for the oldest to RECENCY_NUDGE for the newest of each query."""
    n = F.count("*").over(Window.partitionBy(q_col))
    i = F.row_number().over(Window.partitionBy(q_col).orderBy(order, "id")) - 1
    nudge = F.when(n > 1, i * P.RECENCY_NUDGE / F.nullif(n - 1, F.lit(0))).otherwise(F.lit(0.0))
    return scored.withColumn("blended", F.col("sim") + nudge)


def allocation(shares: DataFrame, limit: int) -> DataFrame:
    """shares (…, source, share) with ``slots``: rounded half to even, one at least from a share of 5%."""
    n = F.bround(F.col("share") * limit, 0).cast("int")
    return shares.withColumn("slots", F.greatest(F.when(F.col("share") >= 0.05, 1).otherwise(0), n))


def blended(ranked: DataFrame, limit: int, q_col: str = "query_id") -> DataFrame:
    """Anchors of several sources interleaved: (query, id, source, place) from ranked (query, source, share, id, rank), the strongest source first."""
    x = allocation(ranked, limit).where(F.col("rank") <= F.col("slots"))
    w = Window.partitionBy(q_col).orderBy("rank", F.col("share").desc(), "source")
    return x.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select(q_col, "id", "source", "place")


PLACES = 64
_PLACE: dict[str, tuple[int, int]] = {}


def place_of(word: str) -> tuple[int, int]:
    """The place and sign of a word: of the first byte of its md5 the lower six bits and the next one."""
    got = _PLACE.get(word)
    if got is None:
        import hashlib

        if len(_PLACE) > 500_000:
            _PLACE.clear()
        h = hashlib.md5(word.encode("utf-8", "surrogatepass")).digest()[0]
        got = _PLACE[word] = (h % PLACES, 1 if h & PLACES else -1)
    return got


@F.pandas_udf(returnType=ArrayType(DoubleType()))
def hashed_embedding(text: pd.Series) -> pd.Series:
    """A deterministic stand-in for a neural encoder: signed feature hashing of words into PLACES places, normalised."""
    import re

    import numpy as np

    out = []
    for t in text:
        if t is None:
            out.append(None)
            continue
        at = [place_of(w) for w in re.findall(r"\w+", t.lower())]
        v = np.bincount([p for p, _ in at], weights=[s for _, s in at], minlength=PLACES) if at else np.zeros(PLACES)
        n = np.linalg.norm(v)
        out.append((v / n if n else v).tolist())
    return pd.Series(out)


def tfidf(df: DataFrame, text: str = "text", places: int = 256) -> DataFrame:
    """df with ``vec``: hashed word counts weighted by inverse document frequency over the table, normalised; null texts have none."""
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    x = df.where(F.col(text).isNotNull()).withColumn("w__", T.find_all(fold_accents(F.col(text)), P.WORD_PLAIN))
    x = HashingTF(numFeatures=places, inputCol="w__", outputCol="t__").transform(x)
    x = IDF(inputCol="t__", outputCol="i__").fit(x).transform(x)
    return Normalizer(inputCol="i__", outputCol="n__").transform(x).withColumn("vec", vector_to_array("n__")).drop("w__", "t__", "i__", "n__")


_RESIDENT: dict[str, DataFrame] = {}


def resident(key: str, make) -> DataFrame:
    """The persisted vectors of a corpus, by its hash; one corpus at a time is kept, so a changed one takes the place of the old."""
    if key not in _RESIDENT:
        for old in _RESIDENT.values():
            old.unpersist()
        _RESIDENT.clear()
        _RESIDENT[key] = make().persist()
    return _RESIDENT[key]


ENCODERS = {"hashed": hashed_embedding}


def encode(text: Column, backend: str = "hashed") -> Column:
    """A vector by a registered encoder; others are added to ENCODERS as Arrow functions of a text column."""
    return ENCODERS[backend](text)
