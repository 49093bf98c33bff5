"""Problem 3: cut oversized texts at natural boundaries, with overlap.

Per text: offsets of all tokens, and a sorted array of boundary positions (in
tokens) at paragraph and at sentence ends. Each piece ends at the last
boundary under the limit (binary search; paragraph ends win if they leave the
piece at least half full), the next begins at a boundary 20 to 60 tokens
back, or exactly ``overlap`` tokens back if there is none; where no boundary
lies in reach the cut is hard at the limit.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkgauge.llm.common import map_rows
from inkgauge.session import checkpointed, ship_code

LIMIT, OVERLAP, LEAST_OVERLAP, MOST_OVERLAP = 350, 40, 20, 60
_END = re.compile(r"[.!?…。！？]+[\"'”’»)\]]*$")
_BLANK = re.compile(r"\n[^\S\n]*\n")


def plan(spans: list[tuple[int, int]], text: str, limit: int, overlap: int, least: int, most: int) -> list[tuple[int, int]]:
    """Token ranges [a, b) of the pieces of a text whose tokens stand at spans."""
    n = len(spans)
    if n <= limit:
        return [(0, n)]
    paras, sentences = [], []
    for k in range(1, n):
        gap = text[spans[k - 1][1] : spans[k][0]]
        if "\n" in gap and _BLANK.search(gap):
            paras.append(k)
            sentences.append(k)
        elif _END.search(text[spans[k - 1][0] : spans[k - 1][1]]):
            sentences.append(k)

    def last(bounds: list[int], lo: int, hi: int) -> int | None:
        """The last boundary in (lo, hi]."""
        k = bisect_right(bounds, hi)
        return bounds[k - 1] if k and bounds[k - 1] > lo else None

    out, a = [], 0
    while True:
        if n - a <= limit:
            out.append((a, n))
            return out
        low = a + most  # a piece must go beyond its overlap
        b = last(paras, max(low, a + limit // 2), a + limit) or last(sentences, low, a + limit) or a + limit
        out.append((a, b))
        k = bisect_left(sentences, b - overlap)  # the boundary nearest to the wished overlap, within its bounds
        near = [x for x in sentences[max(0, k - 1) : k + 1] if b - most <= x <= b - least and x > a]
        a = min(near, key=lambda x: abs(b - overlap - x)) if near else max(a + 1, b - overlap)


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST_OVERLAP, most: int = MOST_OVERLAP) -> list[tuple[str, int, int]]:
    """Pieces (text, word_count, repeated tokens at the start) of a text; the text between tokens is kept as it is."""
    if not least <= overlap <= most < limit:
        raise ValueError("need least <= overlap <= most < limit")
    # the tokens of str.split(): runs between Unicode white space, no-break blanks included
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    if len(spans) <= limit:
        return [(text, len(spans), 0)]
    ranges = plan(spans, text, limit, overlap, least, most)
    out, end = [], 0
    for k, (a, b) in enumerate(ranges):
        lo = 0 if k == 0 else spans[a][0]
        hi = len(text) if k == len(ranges) - 1 else spans[b - 1][1]
        out.append((text[lo:hi], b - a, end - a if k else 0))
        end = b
    return out


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST_OVERLAP, most: int = MOST_OVERLAP) -> DataFrame:
    """(id, chunk_idx, n_pieces, text, word_count, overlap) for every distinct id with a text.

    Texts within the limit come out as one piece; null texts give no row, an
    empty text one empty piece of 0 words. Repeated rows of an id count once.
    Texts are split where they are read; nothing is shuffled but equal pieces.
    """

    def cut(b):
        out = {n: [] for n in ("id", "chunk_idx", "n_pieces", "text", "word_count", "overlap")}
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            pieces = split_text(t, limit, overlap, least, most)
            for k, (x, n, o) in enumerate(pieces):
                for c, v in zip(out, (i, k, len(pieces), x, n, o), strict=True):
                    out[c].append(v)
        return pa.record_batch([pa.array(v, type=t) for v, t in zip(out.values(), (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()), strict=True)], names=list(out))

    return map_rows(chunks.where("text is not null and id is not null").select("id", "text"), cut, "id string, chunk_idx int, n_pieces int, text string, word_count int, overlap int").dropDuplicates(["id", "chunk_idx"])


def oversized_ids(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Distinct id of texts that the splitter cuts into more than one piece."""
    return split_oversized(chunks, limit).where("chunk_idx = 1").select("id").distinct()


def reindexed(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST_OVERLAP, most: int = MOST_OVERLAP) -> DataFrame:
    """(id, filename, old_idx, chunk_idx, text, word_count, overlap): pieces with a chunk_idx that runs through the whole file.

    The order is that of (old chunk_idx, id, piece). Texts are sorted once by
    (filename, old chunk_idx, id), in ranges that cut hot files and equal
    indices as well, and are cut while they stream by, with a number within
    their range; the counts of the ranges, few rows per file, then give each
    range its offset. Of rows of one id with differing places the least place
    counts; a null filename is a file of its own.
    """
    spark = chunks.sparkSession
    ship_code(spark)
    rows = chunks.where("id is not null").select(F.col("id").cast("string").alias("id"), "filename", F.col("chunk_idx").alias("old_idx"), "text")
    place = F.struct("filename", "old_idx")
    per = rows.groupBy("id").agg(F.min(place).alias("at"), F.max(place).alias("to")).where(~F.col("at").eqNullSafe(F.col("to"))).select("id", "at")  # rare
    src = rows.where("text is not null").join(per, "id", "left").where(F.col("at").isNull() | F.col("at").eqNullSafe(place)).drop("at")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = src.repartitionByRange(parts, "filename", "old_idx", "id").sortWithinPartitions("filename", "old_idx", "id")
    ordered = ordered.withColumn("part", F.spark_partition_id())
    schema = pa.schema([("id", pa.string()), ("filename", pa.string()), ("old_idx", pa.int32()), ("part", pa.int32()), ("nr", pa.int64()), ("text", pa.string()), ("word_count", pa.int32()), ("overlap", pa.int32())])

    def cut(batches):
        file, last, nr = None, None, 0
        for b in batches:
            out: list[list] = [[] for _ in schema]
            for i, f, o, t, part in zip(*(b.column(c).to_pylist() for c in ("id", "filename", "old_idx", "text", "part")), strict=True):
                if last == i:
                    continue  # a repeated row
                if last is None or f != file:
                    nr = 0
                file, last = f, i
                for x, n, w in split_text(t, limit, overlap, least, most):
                    for c, v in zip(out, (i, f, o, part, nr, x, n, w), strict=True):
                        c.append(v)
                    nr += 1
            yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    p = checkpointed(ordered.mapInArrow(cut, "id string, filename string, old_idx int, part int, nr long, text string, word_count int, overlap int"))
    n = p.groupBy("filename", "part").agg((F.max("nr") + 1).alias("n"))  # a file has at most as many rows here as there are ranges
    base = n.select(F.col("filename").alias("f"), F.col("part").alias("q"), F.coalesce(F.sum("n").over(Window.partitionBy("filename").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    x = p.join(base, p["filename"].eqNullSafe(base["f"]) & (p["part"] == base["q"]))
    return x.select("id", "filename", "old_idx", (F.col("base") + F.col("nr")).cast("int").alias("chunk_idx"), "text", "word_count", "overlap")
