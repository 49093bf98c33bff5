"""Sources and sinks: documents from files, append logs, artefacts, change detection."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from inkgauge.operators import chunking, markup

SUPPORTED = ("docx", "pdf", "txt", "md", "html", "htm")
PAIR_SCHEMA = "id string, ai_text string, human_text string, move string, granularity string, task string, timestamp string"
ACCEPTED_SCHEMA = "id string, text string, task string, source string, timestamp string"
EVENT_SCHEMA = "ts timestamp, tool string, voice string, text_sha string"


def find_documents(spark: SparkSession, folder: str, recursive: bool = False, ordered: bool = False) -> DataFrame:
    """(path, name, ext, content) of the supported files of a folder; on wish in the order of lower-cased names, which sorts their contents as well."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    x = x.select("path", F.url_decode(name).alias("name"), ext.alias("ext"), "content").where(F.col("ext").isin(*SUPPORTED))
    return x.orderBy(F.lower("name"), "name") if ordered else x


@F.pandas_udf(returnType=StringType())
def docx_text(content: pd.Series) -> pd.Series:
    """Paragraph texts of Word files, joined by blank lines; null for what can't be read."""
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def read(b: bytes | None) -> str | None:
        try:
            root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(b)).read("word/document.xml"))
        except Exception:
            return None
        paras = ["".join(t.text or "" for t in p.iter(f"{ns}t")) for p in root.iter(f"{ns}p")]
        return "\n\n".join(p for p in paras if p.strip())

    return content.map(read)


@F.pandas_udf(returnType=StringType())
def pdf_text(content: pd.Series) -> pd.Series:
    """The text layer of PDF files, pages apart by a form feed; null for what can't be read or has none.

    Reads the shown strings (Tj, TJ, ' and ") of plain and deflated content
    streams in simple encodings; text in fonts with maps of their own comes out
    only as far as these keep Latin codes.
    """
    import zlib

    stream = re.compile(rb"(?:<<(?P<dict>.*?)>>)\s*stream\r?\n(?P<data>.*?)endstream", re.S)
    shown = re.compile(rb"(?P<arr>\[(?:[^\[\]()\\]|\\.|\((?:[^()\\]|\\.)*\))*\])\s*TJ|(?P<str>\((?:[^()\\]|\\.)*\))\s*(?:Tj|'|\")|(?P<line>T\*|-?[\d.]+\s+-?[\d.]+\s+T[dD]\b|\bTm\b|\bET\b)", re.S)
    part = re.compile(rb"\((?:[^()\\]|\\.)*\)|-?\d+(?:\.\d+)?", re.S)
    escape = re.compile(rb"\\([0-7]{1,3}|.)", re.S)
    plain = {b"n": b"\n", b"r": b"\n", b"t": b"\t", b"b": b"", b"f": b"", b"\n": b""}

    def text(literal: bytes) -> str:
        one = lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else plain.get(m[1], m[1])
        return escape.sub(one, literal[1:-1]).decode("cp1252", "replace")

    def read(b: bytes | None) -> str | None:
        if b is None or not b.startswith(b"%PDF"):
            return None
        pages = []
        for m in stream.finditer(b):
            data = m["data"]
            if b"FlateDecode" in m["dict"]:
                try:
                    data = zlib.decompressobj().decompress(data)
                except zlib.error:
                    continue
            out = []
            for t in shown.finditer(data) if b"BT" in data else ():
                if t["line"]:
                    out.append("\n")
                elif t["str"]:
                    out.append(text(t["str"]))
                else:  # a wide step back between two strings is a blank
                    out += [text(x) if x[:1] == b"(" else " " if float(x) < -200 else "" for x in part.findall(t["arr"])]
            page = re.sub(r"\n{2,}", "\n", "".join(out)).strip()
            if page:
                pages.append(page)
        return "\f".join(pages) or None

    return content.map(read)


def utf8(content: Column) -> Column:
    """Bytes as text; what isn't UTF-8 becomes the replacement character."""
    return _lenient(content)


@F.pandas_udf(returnType=StringType())
def _lenient(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else b.decode("utf-8", "replace").removeprefix("﻿"))


def read_texts(files: DataFrame) -> DataFrame:
    """(name, text, readable): text by extension; of page files the text layer with its pages repaired (see also page_text)."""
    docx = files.where("ext = 'docx'").select("name", docx_text("content").alias("text"))
    html = files.where("ext in ('html', 'htm')").select("name", markup.strip_tags(utf8(F.col("content"))).alias("text"))
    rest = files.where("ext in ('txt', 'md')").select("name", utf8(F.col("content")).alias("text"))
    raw = F.regexp_replace(pdf_text("content"), "\f", "\n")
    pdf = files.where("ext = 'pdf'").select("name", F.regexp_replace(chunking.repair_pages(raw), r"\n+", "\n\n").alias("text"))
    out = docx.unionByName(html).unionByName(rest).unionByName(pdf)
    return out.withColumn("readable", F.col("text").isNotNull())


def page_text(pages: DataFrame) -> DataFrame:
    """(name, text) of files whose pages were extracted elsewhere: rows (name, page, text)."""
    rows = F.array_sort(F.collect_list(F.struct("page", "text")))
    joined = pages.groupBy("name").agg(F.array_join(F.transform(rows, lambda r: F.coalesce(r["text"], F.lit(""))), "\n\n").alias("text"))
    return joined.select("name", F.regexp_replace(chunking.repair_pages(F.col("text")), r"\n+", "\n\n").alias("text"))


def corpus_hash(files: DataFrame, by: str | None = None, name: str = "name", content: str = "content") -> DataFrame:
    """One hash per corpus over names and contents in the order of lower-cased names. The names and hashes of a corpus meet in one row; see ``corpus_tree_hash``."""
    row = F.struct(F.lower(name).alias("o"), F.col(name).alias("n"), F.sha2(F.col(content), 256).alias("h"))
    keys = [by] if by else []
    return files.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: F.concat(r["n"], F.lit(":"), r["h"])), "\n"), 256).alias("corpus_hash"))


def corpus_tree_hash(files: DataFrame, name: str = "name", content: str = "content", buckets: int = 4096) -> DataFrame:
    """(corpus_hash): one hash of a corpus of any size: of the hashes of buckets of names, which are small rows, in their order."""
    part = files.withColumn("b__", F.pmod(F.xxhash64(name), F.lit(buckets)))
    one = corpus_hash(part, "b__", name, content)
    return one.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b__", "corpus_hash"))), lambda r: F.concat(r["b__"].cast("string"), F.lit(":"), r["corpus_hash"])), "\n"), 256).alias("corpus_hash"))  # at most ``buckets`` rows


def changed(now: DataFrame, stored: DataFrame, by: str) -> DataFrame:
    """Corpora whose hash isn't the stored one."""
    return now.join(stored.select(by, "corpus_hash"), [by, "corpus_hash"], "left_anti")


def ingest(spark: SparkSession, folder: str, out: str, encoder: str = "hashed") -> DataFrame:
    """Scan, chunk, embed and write a store of chunks; unreadable files are left out. Returns the store."""
    from inkgauge.operators.retrieve import encode

    texts = read_texts(find_documents(spark, folder)).where("readable")
    stem = F.regexp_replace("name", r"\.[A-Za-z0-9]+$", "")
    c = chunking.chunked(texts.withColumn("stem", stem), "stem")
    c.withColumn("embedding", encode(F.col("text"), encoder)).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def import_documents(new: DataFrame, stored: DataFrame, key: str, name: str, content: str) -> DataFrame:
    """New documents not stored yet: one per content, clashing names numbered -2, -3 and so on.

    Contents travel as hashes; among equal contents the lowest key stays.
    """
    h = new.withColumn("sha", F.sha2(F.col(content), 256))
    first = h.select("sha", key).groupBy("sha").agg(F.min(key).alias(key))
    fresh = h.join(first, ["sha", key], "left_semi").dropDuplicates(["sha"]).join(stored.select("sha").distinct(), "sha", "left_anti")
    n = F.row_number().over(Window.partitionBy(name).orderBy(key))
    return fresh.withColumn("n", n).withColumn("import_name", F.when(F.col("n") > 1, F.concat_ws("-", F.col(name), F.col("n").cast("string"))).otherwise(F.col(name))).drop("n")


def flat_name(path: Column) -> Column:
    """A nested path as one file name."""
    return F.concat_ws("__", F.filter(F.split(path, "/"), lambda p: p != ""))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of a JSON-lines file; bad lines and pairs with an empty side are dropped."""
    x = spark.read.schema(PAIR_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return x.where("coalesce(trim(ai_text), '') <> '' and coalesce(trim(human_text), '') <> ''")


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def save_artifact(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def load_artifact(spark: SparkSession, path: str, schema: str, defaults: dict | None = None) -> DataFrame:
    """A saved artefact under its schema; fields it lacks have their defaults."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path).fillna(defaults or {})


def pending(jobs: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Jobs without a ledger row of status ok."""
    return jobs.join(ledger.where("status = 'ok'").select(key).distinct(), key, "left_anti")


@F.pandas_udf(returnType=StringType())
def _dug(doc: pd.Series, field: pd.Series) -> pd.Series:
    import json

    def find(x, name):
        todo = [x]
        while todo:
            x = todo.pop(0)
            if isinstance(x, dict):
                if name in x and not isinstance(x[name], (dict, list)):
                    return x[name]
                todo = list(x.values()) + todo
            elif isinstance(x, list):
                todo = x + todo
        return None

    def one(text, name):
        try:
            v = find(json.loads(text), name)
        except (TypeError, ValueError):
            return None
        return v if v is None or isinstance(v, str) else json.dumps(v)

    return pd.Series([one(t, f) for t, f in zip(doc, field, strict=True)])


def dig(json: Column, field: str) -> Column:
    """The first plain value of a field anywhere in a JSON text, depth first, as text; null without one and for what is no JSON."""
    return _dug(json, F.lit(field))


def safe_name(name: Column) -> Column:
    """A name fit for a file: letters, digits, points and hyphens, blanks as underscores, 120 characters at most."""
    s = F.replace(F.trim(F.regexp_replace(name, r"[^\p{L}\p{N}_\s.-]", "")), F.lit(" "), F.lit("_"))
    return F.when(s == "", "untitled").otherwise(F.substring(s, 1, 120))


def meta_values(keys: DataFrame, meta: DataFrame) -> DataFrame:
    """(key, value) of stored values by key; null where there is none."""
    return keys.join(meta.groupBy("key").agg(F.max("value").alias("value")), "key", "left").select("key", "value")


def store_documents(chunks: DataFrame, cookbook: DataFrame) -> DataFrame:
    """(filename, text): pieces of a store, and cookbook rows of files without chunks."""
    p = chunking.pieces(chunks)
    return p.unionByName(cookbook.select("filename", "text").join(p.select("filename"), "filename", "left_anti"))
