"""Problem 9: mix sources to target weights by capped water-filling.

The plan is made from sums per source alone; documents are then drawn by a
seeded order. A source's whole repetitions take all its documents, the
fraction takes the head of the seeded order up to the tokens still due.
Prefix sums run over (source, bucket) totals first and inside buckets second,
so that a source with a third of all rows is no single sort.
"""

from __future__ import annotations

import base64
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkgauge.llm.common import map_rows

TOKENIZER_DIR = "/opt/tokenizers"
SEED, BUCKETS = 17, 256
_ENCODERS: dict[str, object] = {}


def _encoder(path: str):
    """A tiktoken encoding of a rank file; its split pattern is a fixed value."""
    if path not in _ENCODERS:
        import tiktoken

        with Path(path).open("rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
        _ENCODERS[path] = tiktoken.Encoding("mix", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(documents: DataFrame, tokenizer: str = f"{TOKENIZER_DIR}/byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """(doc_id, source, n_tokens) with the tokens of a public tokenizer; null texts count 0."""

    def count(b):
        enc = _encoder(tokenizer)
        return {"doc_id": b.column(0), "source": b.column(1), "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(2).to_pylist()]}

    return map_rows(documents.where("doc_id is not null").select("doc_id", "source", "text"), count, "doc_id long, source string, n_tokens long")


def water_fill(weights: list[float], caps: list[float], total: float) -> list[float]:
    """Amounts in proportion to the weights, none above its cap, that add up to total or to all caps.

    Sources above their cap are clamped; the excess goes to the others in
    proportion to their weights, until none is above.
    """
    out = [0.0] * len(weights)
    free = {i for i, w in enumerate(weights) if w > 0 and caps[i] > 0}
    rest = min(total, sum(caps[i] for i in free))
    while free and rest > 1e-9:
        w = sum(weights[i] for i in free)
        over = [i for i in free if rest * weights[i] / w >= caps[i]]
        if not over:
            for i in free:
                out[i] = rest * weights[i] / w
            break
        for i in over:
            out[i] = caps[i]
            free.discard(i)
        rest -= sum(caps[i] for i in over)
    return out


def mix_plan(counts: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """One row per (blend, source) of the targets with what is to be drawn.

    Usable weights are those above zero; equal target rows count once, of
    different rows for one (blend, source) the one of the highest weight.
    total_tokens is a blend's size; by default all tokens of its sources, once.
    status: ok, short (clamped at its cap), missing (no tokens in documents),
    unusable (null or non-positive weight or repeats).
    """
    have = counts.where("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    w = Window.partitionBy("blend", "source").orderBy(F.col("weight").desc_nulls_last(), F.col("max_repeats").desc_nulls_last())
    t = targets.where("blend is not null and source is not null").select("blend", "source", "weight", "max_repeats").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    t = t.join(have, "source", "left").select("blend", "source", "weight", F.col("max_repeats").cast("long").alias("max_repeats"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("docs", F.lit(0)).alias("docs"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("source").reset_index(drop=True)
        usable = (p.weight > 0) & (p.max_repeats > 0)
        weights = [float(x) if u else 0.0 for x, u in zip(p.weight, usable, strict=True)]
        caps = [float(a) * float(b) if u else 0.0 for a, b, u in zip(p.tokens, p.max_repeats.fillna(0), usable, strict=True)]
        total = float(total_tokens) if total_tokens is not None else float(p.tokens[usable].sum())
        due = water_fill(weights, caps, total)
        s = sum(weights)
        p["target_share"] = [x / s if s and u else None for x, u in zip(weights, usable, strict=True)]
        p["due_tokens"] = due
        p["epochs"] = [int(d // t) if t else 0 for d, t in zip(due, p.tokens, strict=True)]
        p["rest_tokens"] = [d - e * t for d, e, t in zip(due, p.epochs, p.tokens, strict=True)]
        p["status"] = ["unusable" if not u else "missing" if not t else "short" if d + 1e-6 < total * x / s else "ok" for u, t, d, x in zip(usable, p.tokens, due, weights, strict=True)]
        return p

    schema = "blend string, source string, weight double, max_repeats long, tokens long, docs long, target_share double, due_tokens double, epochs long, rest_tokens double, status string"
    return t.groupBy("blend").applyInPandas(fill, schema)  # one row per source of a blend


def draw(counts: DataFrame, plan: DataFrame, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """(blend, source, doc_id, n_tokens, repeats) of the documents taken at least once.

    The fraction of a source takes documents in seeded order while their
    tokens, summed up, stay within what is due; the one across the end is taken
    if at least half of it is due.
    """
    u = F.xxhash64(F.lit(seed), "doc_id")
    d = counts.where("source is not null").select("doc_id", "source", "n_tokens", u.alias("u"), F.pmod(F.shiftright(u, 40), F.lit(buckets)).alias("bucket"))
    p = plan.where("due_tokens > 0").select("blend", "source", "epochs", "rest_tokens", "max_repeats")
    per = d.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
    before = per.select("source", "bucket", (F.sum("t").over(Window.partitionBy("source").orderBy("bucket")) - F.col("t")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("u", "doc_id")) - F.col("n_tokens")
    x = d.withColumn("inside", inside).join(before, ["source", "bucket"]).withColumn("start", F.col("before") + F.col("inside"))
    more = (F.col("start") + F.col("n_tokens") / 2 <= F.col("rest_tokens")) & (F.col("rest_tokens") > 0) & (F.col("epochs") < F.col("max_repeats"))
    out = x.join(p, "source").select("blend", "source", "doc_id", "n_tokens", (F.col("epochs") + F.when(more, 1).otherwise(0)).alias("repeats"))
    return out.where("repeats > 0")


def reached_shares(drawn: DataFrame, plan: DataFrame) -> DataFrame:
    """The report: per (blend, source) its target and reached share, documents, repeats and status."""
    got = drawn.groupBy("blend", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("got"), F.count("*").alias("taken_docs"), F.max("repeats").alias("most_repeats"))
    x = plan.join(got, ["blend", "source"], "left").withColumn("got", F.coalesce("got", F.lit(0)))
    share = F.try_divide(F.col("got"), F.sum("got").over(Window.partitionBy("blend")))
    return x.select("blend", "source", "target_share", "tokens", "due_tokens", F.col("got").alias("taken_tokens"), share.alias("reached_share"), F.coalesce("taken_docs", F.lit(0)).alias("taken_docs"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "status")
