"""The registered queries of this subpackage: problem N's are named pN_..."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkgauge.llm import diverse, leak, lookalike, mix, neardup, quality, spam, spans, split, vectors
from inkgauge.llm.common import records
from inkgauge.session import checkpointed, table


def _chunks(s, d):
    return table(s, d, "chunks")


def _chunk_texts(s, d):
    return _chunks(s, d).select("id", "text")


def _documents(s, d):
    return table(s, d, "documents")


def p1_found(s, d):
    return quality.junk_records(records(s, d))


def p1_statistics(s, d):
    return quality.text_statistics(records(s, d))


def p2_found(s, d):
    return neardup.similar_pairs(_chunk_texts(s, d), threshold=0.5, k=3, min_words=20)


def p2_classes(s, d):
    return neardup.similar_classes(_chunk_texts(s, d))


def p3_found(s, d):
    return split.oversized_ids(_chunks(s, d))


def p3_pieces(s, d):
    return split.reindexed(_chunks(s, d))


def p4_found(s, d):
    return spans.sharing_records(records(s, d))


def p4_shared_share(s, d):
    x = spans.shared_share(records(s, d))
    return x.withColumns({"n_tokens": F.col("n_tokens").cast("long"), "longest_span": F.col("longest_span").cast("long"), "shared_share": F.round("shared_share", 6)})


def p4_spans(s, d):
    x = spans.maximal_spans(records(s, d))
    return x.select("rec_id", F.col("start").cast("long").alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"))


def p5_found(s, d):
    return vectors.close_pairs(_chunks(s, d))


def p5_nearest(s, d):
    return vectors.nearest_vectors(_chunks(s, d))


def p6_found(s, d):
    return lookalike.same_look_pairs(records(s, d))


def p6_classes(s, d):
    return lookalike.same_look_classes(records(s, d))


def p6_repaired(s, d):
    return lookalike.repaired(records(s, d)).distinct()


def p7_exemplars(s, d):
    return diverse.varied_subset(_chunks(s, d))


def p8_found(s, d):
    return leak.exact_leaks(_documents(s, d), table(s, d, "holdout_items"))


def p8_leaks(s, d):
    x = leak.leaks(_documents(s, d), table(s, d, "holdout_items"))
    return x.select("doc_id", "item_id", (F.col("n_exact") > 0).alias("has_run"), F.round("item_share", 6).alias("item_share"))


def _mix(s, d):
    counts = checkpointed(mix.token_counts(_documents(s, d)))  # three columns of numbers, read three times
    return counts, mix.mix_plan(counts, table(s, d, "mix_targets"))


def p9_mix(s, d):
    return mix.draw(*_mix(s, d))


def p9_shares(s, d):
    counts, plan = _mix(s, d)
    return mix.reached_shares(mix.draw(counts, plan), plan)


def p10_found(s, d):
    return spam.spam_pages(_documents(s, d))


def p10_labels(s, d):
    return spam.page_labels(_documents(s, d)).distinct()


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    from inkgauge.llm.oracle import SQL

    return SQL
