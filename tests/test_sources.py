"""Files in, logs out, streams."""

import io as bytes_io
import zipfile

from pyspark.sql import functions as F

from inkgauge.sources import io
from inkgauge.streaming import scorer


def _docx(*paras):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paras)
    b = bytes_io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    return b.getvalue()


def test_ingest(spark, tmp_path):
    words = " ".join(["lamp"] * 12)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes(f"{words} one\r\n\r\nshort\r\n\r\n{words} two\xff".encode("latin-1"))
    (tmp_path / "in/b.docx").write_bytes(_docx(words + " three", "", words + " four"))
    (tmp_path / "in/bad.docx").write_bytes(b"no zip")
    (tmp_path / "in/c.html").write_text(f"<p>{words} five</p>")
    (tmp_path / "in/skip.xyz").write_text("x")
    out = io.ingest(spark, str(tmp_path / "in"), str(tmp_path / "store")).collect()
    assert {r["id"] for r in out} == {"a::000", "b::000", "c::000"}
    a = next(r for r in out if r["filename"] == "a")
    assert "short" not in a["text"] and a["text"].endswith("two�") and a["word_count"] == 26 and len(a["embedding"]) == 64
    files = io.find_documents(spark, str(tmp_path / "in"))
    h = io.corpus_hash(files).first()[0]
    (tmp_path / "in/a.txt").write_text("changed")
    assert h != io.corpus_hash(io.find_documents(spark, str(tmp_path / "in"))).first()[0]


def test_logs_and_artifacts(spark, tmp_path):
    p = tmp_path / "pairs.jsonl"
    p.write_text('{"id":"1","ai_text":"a","human_text":"b"}\nnot json\n{"id":"2","ai_text":"","human_text":"b"}\n\n')
    assert [r["id"] for r in io.read_pairs(spark, str(p)).collect()] == ["1"]
    log = spark.createDataFrame([("acc_001", "t")], "id string, text string")
    io.append_log(log, str(tmp_path / "log"))
    io.append_log(log, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    io.save_artifact(spark.createDataFrame([("v", 1.5)], "voice string, self_baseline double"), str(tmp_path / "fp"))
    r = io.load_artifact(spark, str(tmp_path / "fp"), "voice string, self_baseline double, feature_set string", {"feature_set": "v1"}).first()
    assert (r["self_baseline"], r["feature_set"]) == (1.5, "v1")
    jobs = spark.createDataFrame([("a",), ("b",), ("c",)], "job string")
    ledger = spark.createDataFrame([("a", "ok"), ("b", "failed")], "job string, status string")
    assert {r["job"] for r in io.pending(jobs, ledger, "job").collect()} == {"b", "c"}
    d = spark.createDataFrame([('{"x":{"text":"deep \\"q\\""},"y":1}',), ("{}",)], "j string")
    assert [r[0] for r in d.select(io.dig(F.col("j"), "text")).collect()] == ['deep "q"', None]
    d = spark.createDataFrame([('{"a":[{"b":{"n":1.5}},{"n":2}]}',), ("[no json",), (None,), ('{"n":null}',)], "j string")
    assert [r[0] for r in d.select(io.dig(F.col("j"), "n")).collect()] == ["1.5", None, None, None]
    assert spark.range(1).select(io.flat_name(F.lit("a/b/c.txt"))).first()[0] == "a__b__c.txt"


def test_pages_and_imports(spark):
    pages = spark.createDataFrame([("p", 2, "goes on\nhere."), ("p", 1, "A hyphen-\nated line \nthat "), ("p", 3, None)], "name string, page int, text string")
    assert io.page_text(pages).first()["text"] == "A hyphenated line that\n\n goes on here.\n\n"
    new = spark.createDataFrame([(1, "f", "x"), (2, "f", "y"), (3, "g", "x"), (4, "f", "z")], "k int, name string, text string")
    stored = spark.createDataFrame([("z",)], "t string").select(F.sha2("t", 256).alias("sha"))
    assert {(r["k"], r["import_name"]) for r in io.import_documents(new, stored, "k", "name", "text").collect()} == {(1, "f"), (2, "f-2")}


def test_windowed_stream(spark, tmp_path):
    src = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1.0, "fit"), ("b", "2024-01-02 00:00:00", 3.0, "fit"), ("c", "2024-03-01 00:00:00", 2.0, "off")], "cand_id string, t string, rmsz double, fit string")
    src.withColumn("created_at", F.to_timestamp("t")).drop("t").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("cand_id string, rmsz double, fit string, created_at timestamp").parquet(str(tmp_path / "in"))
    scorer.run_once(scorer.fit_rates(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    r = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(x["fit"], x["n"], x["mean_rmsz"]) for x in r if x["n"] == 2] == [("fit", 2, 2.0)]


def _pdf(stream, deflate=False):
    import zlib

    data = zlib.compress(stream) if deflate else stream
    kind = b"/Filter /FlateDecode " if deflate else b""
    return b"%PDF-1.4\n1 0 obj\n<< " + kind + b"/Length " + str(len(data)).encode() + b" >>\nstream\n" + data + b"\nendstream\nendobj\n%%EOF"


def test_text_layer_of_pages(spark, tmp_path):
    page = rb"BT /F1 12 Tf 72 720 Td (A hyphen-) Tj 0 -14 Td [(ated l) 20 (ine) -300 (that)] TJ T* (goes on \(here\).) Tj ET"
    for name, b in (("b.pdf", _pdf(page)), ("C.pdf", _pdf(page, True)), ("a.pdf", b"%PDF-1.4 nothing"), ("d.pdf", b"no page file")):
        (tmp_path / name).write_bytes(b)
    files = io.find_documents(spark, str(tmp_path), ordered=True)
    assert [r["name"] for r in files.collect()] == ["a.pdf", "b.pdf", "C.pdf", "d.pdf"]
    got = {r["name"]: (r["text"], r["readable"]) for r in io.read_texts(files).collect()}
    assert got == {"b.pdf": ("A hyphenated line that goes on (here).", True), "C.pdf": ("A hyphenated line that goes on (here).", True), "a.pdf": (None, False), "d.pdf": (None, False)}


def test_hashes_names_and_values(spark):
    f = spark.createDataFrame([(f"n{k}", f"text {k}") for k in range(40)], "name string, content string")
    h = io.corpus_tree_hash(f, buckets=8).first()[0]
    assert h == io.corpus_tree_hash(f.repartition(7), buckets=8).first()[0] != io.corpus_tree_hash(f.where("name <> 'n3'"), buckets=8).first()[0]
    assert io.corpus_tree_hash(f.limit(0)).count() == 1
    names = spark.createDataFrame([("A title: with/marks?",), ("  ",), ("x" * 200,), (None,)], "n string")
    assert [r[0] for r in names.select(io.safe_name(F.col("n"))).collect()] == ["A_title_withmarks", "untitled", "x" * 120, None]
    keys = spark.createDataFrame([("a",), ("z",)], "key string")
    meta = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    assert {tuple(r) for r in io.meta_values(keys, meta).collect()} == {("a", "1"), ("z", None)}


def test_stored_documents(spark):
    c = spark.createDataFrame([("f::1", "f", 1, "two"), ("f::0", "f", 0, "one"), ("f::0", "f", 0, "one"), ("g::0", "g", 0, None)], "id string, filename string, chunk_idx int, text string")
    book = spark.createDataFrame([("f", "cookbook"), ("h", "other")], "filename string, text string")
    assert {tuple(r) for r in io.store_documents(c, book).collect()} == {("f", "one\n\ntwo"), ("h", "other")}
