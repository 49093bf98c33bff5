"""Shared pieces: the record table, Arrow mapping, word and token runs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgauge.session import checkpointed, ship_code, table

WORD = re.compile(r"\w+")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (rec_id, origin, text) of chunks and candidates; null texts and null ids are left out.

    Repeated rows of one id carry the same text, so callers make their small
    results distinct instead of shuffling texts here.
    """
    ch = table(spark, sf_dir, "chunks").select(F.col("id").alias("rec_id"), F.col("filename").alias("origin"), "text")
    ca = table(spark, sf_dir, "candidates").select(F.col("cand_id").alias("rec_id"), F.col("task_id").alias("origin"), "text")
    return ch.unionByName(ca).where("rec_id is not null and text is not null")


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply fn to every Arrow batch of df; fn returns columns by name, lists or arrays of one length."""
    ship_code(df.sparkSession)
    names_types = [(f.name, _arrow(f.dataType)) for f in _schema(schema).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = fn(b)
            if out is not None:
                yield pa.record_batch([pa.array(out[n], type=t) if not isinstance(out[n], pa.Array) else out[n].cast(t) for n, t in names_types], names=[n for n, _ in names_types])

    return df.mapInArrow(run, schema)


def _schema(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def _arrow(t):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def expand_pairs(members: DataFrame, pairs: DataFrame, block: int = 4096) -> DataFrame:
    """(x, y): the ids of members (id, cls) for every pair (a, b) of classes; for a = b each two of them once.

    A class is cut by hash into blocks of some ``block`` ids. Every two blocks
    of a pair meet under a key of their own, so that no task forms more than
    block * block rows of a key, whatever the size of a class.
    """
    size = members.groupBy("cls").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    rows = members.join(size, "cls").select("id", "cls", F.pmod(F.xxhash64("id"), F.col("n")).cast("int").alias("own"))
    p = pairs.select("a", "b").join(size.select(F.col("cls").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("cls").alias("b"), F.col("n").alias("nb")), "b")
    p = p.select("a", "b", "nb", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("i"))
    p = checkpointed(p.select("a", "b", "i", F.explode(F.sequence(F.when(F.col("a") == F.col("b"), F.col("i")).otherwise(0), F.col("nb") - 1)).alias("j")))
    left = p.join(rows.select(F.col("cls").alias("a"), F.col("own").alias("i"), F.col("id").alias("x")), ["a", "i"])
    right = p.join(rows.select(F.col("cls").alias("b"), F.col("own").alias("j"), F.col("id").alias("y")), ["b", "j"])
    return left.join(right, ["a", "b", "i", "j"]).where("a <> b or i <> j or x < y").select("x", "y")
