"""Every operator on tables with clashing column names, nulls everywhere, repeated rows, very long and empty texts, and no rows."""

import random

import pytest
from pyspark.sql import functions as F

from inkgauge.llm import diverse, leak, lookalike, mix, neardup, quality, spam, spans, split, vectors

CLASH = ("n", "k", "g", "m", "rep", "rec", "rank", "scope", "cls", "piece", "state", "word", "x", "y", "a", "b", "seed", "voice", "origin", "source")


def clashing(df):
    """df with columns of names the operators use themselves, all of them nonsense."""
    return df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns})


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(6)
    say = lambda n: " ".join(r.choice("the lamp was in a river of stone and it had not gone".split()) for _ in range(n)) + "."
    long_ = " ".join(say(30) for _ in range(4000))
    vec = [r.random() for _ in range(384)]
    rows = [("a::0", "a", "v", say(60), 0, vec), ("a::0", "a", "v", say(60), 0, vec), ("b::0", "b", None, long_, 0, [0.0] * 384), ("c::0", None, "v", "", None, [1.0]), ("d::0", "d", "v", None, 1, None), (None, None, None, None, None, None), ("e::0", "e", "v", "​ ​", 0, [r.random() for _ in range(384)])]
    rows[1] = (*rows[0][:3], rows[0][3], *rows[1][4:])
    chunks = spark.createDataFrame(rows, "id string, filename string, voice string, text string, chunk_idx int, embedding array<float>")
    docs = spark.createDataFrame([(1, long_, "s"), (2, "", "s"), (3, None, None), (None, "x", "s"), (4, say(40), None), (4, say(40), "t"), (5, "\n".join(["Home | Shop | Help | Basket"] * 9), "t")], "doc_id long, text string, source string")
    items = spark.createDataFrame([(1, long_[:300]), (2, ""), (3, None), (None, "x"), (4, "one word"), (4, "one word")], "item_id long, text string")
    targets = spark.createDataFrame([("m", "s", 1.0, 2), ("m", "s", 1.0, 2), ("m", "t", None, 1), ("m", None, 1.0, 1), ("m", "gone", 2.0, 1)], "blend string, source string, weight double, max_repeats int")
    return clashing(chunks), clashing(docs), clashing(items), targets


def each(tables):
    c, d, i, t = tables
    texts = c.select("id", "text", *CLASH[:4])
    r = c.select(F.col("id").alias("rec_id"), F.col("filename").alias("origin"), "text", *CLASH[:4])
    counts = lambda: mix.token_counts(d)
    return {
        "quality": lambda: quality.text_statistics(r),
        "neardup_pairs": lambda: neardup.similar_pairs(texts, 0.5, 3, 5),
        "neardup_classes": lambda: neardup.similar_classes(texts),
        "split": lambda: split.split_oversized(c),
        "reindexed": lambda: split.reindexed(c),
        "spans": lambda: spans.sharing_records(r),
        "shared_share": lambda: spans.shared_share(r),
        "nearest": lambda: vectors.nearest_vectors(c),
        "same_look": lambda: lookalike.same_look_pairs(r),
        "repaired": lambda: lookalike.repaired(r),
        "varied": lambda: diverse.varied_subset(c, k=4),
        "leaks": lambda: leak.leaks(d, i),
        "mix": lambda: mix.draw(counts(), mix.mix_plan(counts(), t)),
        "spam": lambda: spam.page_labels(d),
    }


NAMES = ("quality", "neardup_pairs", "neardup_classes", "split", "reindexed", "spans", "shared_share", "nearest", "same_look", "repaired", "varied", "leaks", "mix", "spam")
WANT = {
    "quality": lambda x: {r["rec_id"]: r["is_junk"] for r in x} == {"a::0": False, "b::0": False, "c::0": False, "e::0": False},
    "neardup_pairs": lambda x: x == [],
    "neardup_classes": lambda x: {r["id"] for r in x} == {"a::0", "b::0"},
    "split": lambda x: {r["id"] for r in x} == {"a::0", "b::0", "c::0", "e::0"} and max(r["word_count"] for r in x) <= 350,
    "reindexed": lambda x: sorted(r["chunk_idx"] for r in x if r["filename"] == "b") == list(range(sum(r["filename"] == "b" for r in x))),
    "spans": lambda x: x == [],
    "shared_share": lambda x: x == [],
    "nearest": lambda x: {(r["id"], r["neighbor"]) for r in x} == {("a::0", "e::0"), ("e::0", "a::0")},
    "same_look": lambda x: x == [],
    "repaired": lambda x: {r["rec_id"] for r in x} == {"a::0", "b::0", "c::0", "e::0"},
    "varied": lambda x: {r["id"] for r in x if r["voice"] is None} <= {"a::0", "e::0"} and x,
    "leaks": lambda x: {(r["doc_id"], r["item_id"]) for r in x} >= {(1, 1)},
    "mix": lambda x: {r["source"] for r in x} == {"s"},
    "spam": lambda x: {r["doc_id"] for r in x if r["is_spam"]} == {5} and {r["doc_id"] for r in x} == {1, 2, 4, 5},
}


@pytest.mark.parametrize("name", NAMES)
def test_edges(spark, tables, name):
    assert WANT[name](each(tables)[name]().collect()), name


@pytest.mark.parametrize("name", NAMES)
def test_no_rows(spark, tables, name):
    assert each([t.limit(0) for t in tables])[name]().count() == 0
