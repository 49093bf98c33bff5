"""Rule scans over texts: dashes, tells, hedges, numbers, sentence shapes, presence, quality.

Everything is an expression over one row; calibrations are one row per voice.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgauge.functions import patterns as P
from inkgauge.functions import textkit as T
from inkgauge.operators.quantiles import group_quantiles
from inkgauge.session import checkpointed, ship_code

LONG_CHARS = 200_000  # pairs of sentences of longer texts are spread over tasks


def _safe(x: Column, n: Column) -> Column:
    return F.coalesce(F.try_divide(x, n), F.lit(0.0))


# --- surface checks ---


def plain_dashes(t: Column) -> Column:
    """Dash runs of a plain text, rule lines left out."""
    return T.count(F.regexp_replace(t, P.RULE_LINE, ""), P.DASH_RUN)


def plain_scalpel(t: Column) -> Column:
    """Dash runs and the blanks beside them become a comma and a blank; rule lines stay."""
    fixed = F.transform(F.split(t, "\n"), lambda x: F.when(x.rlike(P.RULE_LINE), x).otherwise(F.regexp_replace(x, P.DASH_EDIT, ", ")))
    return F.regexp_replace(F.array_join(fixed, "\n"), r",[ \t]*,", ",")


def banned_words(t: Column, words: Column | tuple = P.TELL_WORDS) -> Column:
    """The words of a list that stand in a text, sorted; hyphens and apostrophes end a word here."""
    words = F.array(*(F.lit(w) for w in words)) if isinstance(words, tuple) else words
    found = T.find_all(F.lower(t), P.WORD_PLAIN)
    return F.array_sort(F.array_intersect(words, found))


def banned_phrases(t: Column, phrases: tuple = P.TELL_PHRASES) -> Column:
    low = F.lower(t)
    return F.filter(F.array(*(F.lit(p) for p in phrases)), lambda p: F.contains(low, p))


def hedges_per_200(t: Column) -> Column:
    return _safe(T.count(t, P.HEDGES_SOFT) * 200.0, F.size(T.words_unicode(t)))


def sentence_lengths(t: Column) -> Column:
    return F.filter(F.transform(T.sentences(t), lambda s: F.size(T.words_unicode(s))), lambda n: n > 0)


def burstiness(t: Column) -> Column:
    return T.stdev(sentence_lengths(t))


def numbers(t: Column) -> Column:
    """Distinct numbers as text: no separators, no zeros at the end of a fraction; by length, then value."""
    plain = F.transform(T.find_all(t, P.NUMBER), lambda x: F.regexp_replace(x, ",", ""))
    norm = F.transform(plain, lambda x: F.when(F.contains(x, F.lit(".")), F.regexp_replace(F.regexp_replace(x, "0+$", ""), r"\.$", "")).otherwise(x))
    return by_length(F.array_distinct(norm))


def by_length(a: Column) -> Column:
    return F.transform(F.array_sort(F.transform(a, lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))), lambda z: z["x"])


def citations(t: Column) -> Column:
    acro = F.filter(T.find_all(t, P.ACRONYM), lambda x: ~x.isin(*P.ACRONYM_SKIP))
    return F.array_sort(F.array_union(F.transform(T.find_all(t, P.CITATION), T.strip), acro))


def fidelity_sets(source: Column, output: Column) -> dict[str, Column]:
    """Numbers dropped and added, citations dropped."""
    a, b = numbers(source), numbers(output)
    return {"dropped_numbers": by_length(F.array_except(a, b)), "added_numbers": by_length(F.array_except(b, a)), "dropped_citations": F.array_except(citations(source), citations(output))}


# --- sentence shapes ---


def triads(t: Column) -> Column:
    def hit(s):
        clauses = F.filter(F.split(s, "[,;]"), lambda c: T.strip(c) != "")
        first = F.transform(clauses, lambda c: F.lower(F.coalesce(F.get(T.words_unicode(c), F.lit(0)), F.lit(""))))
        twice = F.exists(F.array(*(F.lit(o) for o in P.TRIAD_OPENERS)), lambda o: F.size(F.filter(first, lambda w: w == o)) >= 2)
        return s.rlike(P.TRIAD_SEQUENCE) | ((F.size(clauses) >= 3) & twice)

    return F.filter(T.sentences(t), hit)


def meta_asides(t: Column) -> Column:
    return F.transform(T.find_all(t, P.META_ASIDE), lambda x: F.regexp_replace(x, "^[, ]+|[, ]+$", ""))


def absence_punches(t: Column) -> Column:
    """array<struct<setup, punch>>: a long sentence and a short one after it that names an end."""
    pairs = T.adjacent(T.sentences(t), lambda a, b: F.struct(a.alias("setup"), b.alias("punch")))
    return F.filter(pairs, lambda z: (F.size(T.words_unicode(z["punch"])) <= P.PUNCH_WORDS) & (F.size(T.words_unicode(z["setup"])) >= P.SETUP_WORDS) & z["punch"].rlike(P.ABSENCE_PUNCH))


def leakage(t: Column) -> Column:
    return T.find_all(t, P.LEAKAGE)


def flourishes(t: Column) -> Column:
    """Matches in the last two sentences."""
    s = T.sentences(t)
    last = F.slice(s, F.greatest(F.size(s) - 1, F.lit(1)), F.lit(2))
    return F.flatten(F.transform(last, lambda x: T.find_all(x, P.FLOURISH)))


def rate(t: Column, pattern: str) -> Column:
    """Matches per 1,000 words."""
    return _safe(T.count(t, pattern) * 1000.0, F.size(T.words_unicode(t)))


def rhetoric_columns(t: Column) -> dict[str, Column]:
    return {
        "n_triads": F.size(triads(t)),
        "n_asides": F.size(meta_asides(t)),
        "n_punches": F.size(absence_punches(t)),
        "n_leaks": F.size(leakage(t)),
        "cleft_rate": rate(t, P.WH_CLEFT),
        "it_cleft_rate": rate(t, P.IT_CLEFT),
        "antithesis_rate": rate(t, P.ANTITHESIS),
        "n_flourishes": F.size(flourishes(t)),
    }


def band(value: Column, p25: Column, p95: Column) -> Column:
    """over, under or within an author's band; a 95th percentile of 0 switches the check off."""
    return F.when((p95 > 0) & (value > p95), "over").when((p25 > 0.05) & (value < p25), "under").otherwise("within")


# --- presence ---


def presence_columns(t: Column) -> dict[str, Column]:
    """Densities per 1,000 words, their total, weak hedges per 200."""
    n = F.greatest(F.size(T.words_unicode(t)), F.lit(1))
    d = {k: T.count(t, p) * 1000.0 / n for k, p in P.PRESENCE.items()}
    total = sum(d.values(), F.lit(0.0))
    return d | {"presence_total": total, "weak_hedges": T.count(t, P.WEAK_HEDGES) * 200.0 / n}


def presence_state(n_words: Column, floors: dict[str, Column]) -> dict[str, Column]:
    """measurable, absent classes, and missed floors by gap, over presence_columns()."""
    long_ = n_words >= P.DENSITY_WORDS
    measurable = n_words >= P.ABSENCE_WORDS
    gated = list(P.FIELD_FLOOR)
    zero = F.array_compact(F.array(*(F.when(F.col(k) == 0, F.lit(k)) for k in gated)))
    absent = F.when(long_, zero).when(measurable & (F.col("presence_total") < P.ABSENCE_TOTAL), F.array(*(F.lit(k) for k in gated))).otherwise(F.array().cast("array<string>"))
    gaps = F.array_compact(F.array(*(F.when(F.col(k) < floors[k], F.struct((F.col(k) - floors[k]).alias("gap"), F.lit(i).alias("i"), F.lit(k).alias("k"))) for i, k in enumerate(gated))))
    missed = F.when(long_, F.transform(F.array_sort(gaps), lambda z: z["k"])).otherwise(F.array().cast("array<string>"))
    missing = measurable & (F.col("epistemic") == 0) & (F.col("expectation") == 0)
    return {"measurable": measurable, "absent": absent, "missed": missed, "presence_missing": missing}


# --- quality ---


def content_words(t: Column) -> Column:
    return F.filter(F.transform(T.words_ascii(t), F.lower), lambda w: ~w.isin(*P.FUNCTION_WORDS) & (F.length(w) > 2))


def quality_columns(t: Column) -> dict[str, Column]:
    """density, specificity, filler; 0 below 40 words."""
    n = F.size(T.words_ascii(t))
    s = T.sentences(t)
    ok = n >= 40
    zero = F.lit(0.0)
    return {
        "density": F.when(ok, F.size(F.array_distinct(content_words(t))) * 100.0 / n).otherwise(zero),
        "specificity": F.when(ok, F.coalesce(T.share(s, lambda x: x.rlike(P.ANCHOR)), zero)).otherwise(zero),
        "filler": F.when(ok, T.count(t, P.FILLER) * 1000.0 / n).otherwise(zero),
    }


def worst_pair(sentences: list[list[str]]) -> tuple[float, int | None, int | None]:
    """(overlap, i, j) of the two sentences with the largest share of common words, of four words or more each; the first in order on ties."""
    at: dict[str, list[int]] = {}
    size = [len(c) for c in sentences]
    best = (0.0, 0, 0)
    for j, c in enumerate(sentences):
        if size[j] < 4:
            continue
        shared: Counter = Counter()
        for w in c:
            if w in at:
                shared.update(at[w])
                at[w].append(j)
            else:
                at[w] = [j]
        for i, n in shared.items():
            best = min(best, (-n / min(size[i], size[j]), i, j))
    return (-best[0], best[1], best[2]) if best[0] else (0.0, None, None)


def redundancy(df: DataFrame, key: str, text: str = "text", long_chars: int = LONG_CHARS) -> DataFrame:
    """(key, redundancy, i, j): the worst pair of sentences by overlap of content words; the first in order on ties.

    Sentence pairs are found through shared words, so only pairs with some
    overlap are ever formed: within a row, or, for texts of more than
    ``long_chars``, by a join on (key, word), so that a long text spreads over
    tasks. Texts below 40 words or without a pair give 0 and nulls.
    """
    ship_code(df.sparkSession)
    base = df.where(F.col(text).isNotNull()).select(key, text).dropDuplicates([key])
    words = F.transform(T.sentences(F.col(text)), lambda x: F.array_distinct(content_words(x)))
    enough = F.size(T.words_ascii(F.col(text))) >= 40

    def pairs(batches):
        for b in batches:
            found = [worst_pair(c or []) for c in b.column(1).to_pylist()]
            ov, i, j = zip(*found) if found else ((), (), ())
            yield pa.record_batch([b.column(0), pa.array(ov, pa.float64()), pa.array(i, pa.int32()), pa.array(j, pa.int32())], names=[key, "redundancy", "i", "j"])

    rest = F.length(text) > long_chars
    near = base.where(~rest).select(key, F.when(enough, words).alias("c")).mapInArrow(pairs, f"`{key}` {df.schema[key].dataType.simpleString()}, redundancy double, i int, j int")
    far = base.where(rest)
    s = T.exploded(far.where(enough), [key], words, "c", "i").where(F.size("c") >= 4)
    w = T.exploded(s, [key, "i", F.size("c").alias("n")], F.col("c"), "w")
    a, b = w.select(key, "w", "i", F.col("n").alias("ni")), w.select(key, "w", F.col("i").alias("j"), F.col("n").alias("nj"))
    p = a.join(b, [key, "w"]).where("i < j").groupBy(key, "i", "j").agg((F.count("*") / F.min(F.least("ni", "nj"))).alias("ov"))
    best = p.groupBy(key).agg(F.min(F.struct((-F.col("ov")).alias("d"), "i", "j")).alias("b"))
    spread = far.select(key).join(best, key, "left").select(key, F.coalesce(-F.col("b.d"), F.lit(0.0)).alias("redundancy"), F.col("b.i").alias("i"), F.col("b.j").alias("j"))
    return near.unionByName(spread)


def quality_flags(density_p25: Column, specificity_p25: Column) -> Column:
    """repetitive, padded, thin, vague, over redundancy, filler, density and specificity."""
    return F.array_compact(
        F.array(
            F.when(F.col("redundancy") >= 0.60, F.lit("repetitive")),
            F.when(F.col("filler") > 6.0, F.lit("padded")),
            F.when((density_p25 > 0) & (F.col("density") < density_p25), F.lit("thin")),
            F.when((specificity_p25 > 0) & (F.col("specificity") < specificity_p25), F.lit("vague")),
        )
    )


# --- calibrations, one row per voice ---


def measured(df: DataFrame, by: str = "voice", text: str = "text") -> DataFrame:
    """The measures all calibrations of a corpus need, one narrow row per text, written once: its texts are read once for all of them."""
    t = F.col(text)
    q, p = quality_columns(t), presence_columns(t)
    x = df.where(F.col(by).isNotNull() & t.isNotNull()).select(
        by, F.size(T.words_unicode(t)).alias("n"), F.size(T.words_ascii(t)).alias("n_ascii"), sentence_lengths(t).alias("l"), T.count(t, P.HEDGES_SOFT).alias("h"), plain_dashes(t).alias("d"),
        rate(t, P.WH_CLEFT).alias("c"), rate(t, P.ANTITHESIS).alias("a"), q["density"].alias("density"), q["specificity"].alias("specificity"), *(p[k].alias(k) for k in P.PRESENCE),
    )
    total = T.total(F.col("l"))
    three = F.when(F.size("l") >= 3, F.lit(1))  # null, and so out of the order statistics, where too short
    x = x.withColumns({"burst": three * T.stdev(F.col("l")), "mean_len": three * T.mean(F.col("l")), "hedge": three * F.col("h") * 200.0 / total, "dash": three * F.col("d") * 1000.0 / total, "three": three}).drop("l", "h", "d")
    return checkpointed(x)


def scrub_bands_of(x: DataFrame, by: str = "voice") -> DataFrame:
    """burstiness_floor, hedge_ceiling, dash_per1k_p95, mean_sentence_len, n_pieces of measured() texts of three sentences or more."""
    x = x.where("three = 1")
    q = group_quantiles(x, [by], {"burstiness_floor": ("burst", "even", 0.05), "hedge_ceiling": ("hedge", "even", 0.95), "dash_per1k_p95": ("dash", "even", 0.95), "mean_sentence_len": ("mean_len", "even", 0.5)})
    return x.groupBy(by).agg(F.count("*").alias("n_pieces")).join(q, by)


def scrub_calibration(df: DataFrame, by: str = "voice", text: str = "text") -> DataFrame:
    """burstiness_floor, hedge_ceiling, dash_per1k_p95, mean_sentence_len, n_pieces over texts of three sentences or more."""
    return scrub_bands_of(measured(df, by, text), by)


def tell_usage(df: DataFrame, words: tuple, by: str = "voice", text: str = "text") -> DataFrame:
    """(by, word, uses) of the words of a list in texts of three sentences or more; other words never leave their row."""
    t = F.col(text)
    x = df.where(F.col(by).isNotNull() & t.isNotNull()).where(F.size(sentence_lengths(t)) >= 3)
    w = T.exploded(x, [by], F.filter(T.words_unicode(F.lower(t)), lambda v: v.isin(*words)), "word")
    return w.groupBy(by, "word").agg(F.count("*").alias("uses"))


def word_usage(df: DataFrame, words: tuple, by: str = "voice", text: str = "text") -> DataFrame:
    """tell_usage() with a row of a null word for every voice that has texts, so that voices using none of the words stay."""
    none = df.where(F.col(by).isNotNull() & F.col(text).isNotNull()).select(by).distinct().select(by, F.lit(None).cast("string").alias("word"), F.lit(0).cast("long").alias("uses"))
    return tell_usage(df, words, by, text).unionByName(none)


def banlists(df: DataFrame, words: tuple = P.TELL_WORDS, least: int = 3, by: str = "voice", text: str = "text") -> DataFrame:
    """(by, word, banned): of each voice, the listed words it uses fewer than ``least`` times."""
    voices = df.where(F.col(by).isNotNull()).select(by).distinct()
    listed = voices.select(by, F.explode(F.array(*(F.lit(w) for w in words))).alias("word"))
    u = tell_usage(df, words, by, text)
    return listed.join(u, [by, "word"], "left").select(by, "word", (F.coalesce("uses", F.lit(0)) < least).alias("banned"))


def rhetoric_calibration(df: DataFrame, by: str = "voice", text: str = "text", min_words: int = 200) -> DataFrame:
    """Bands of cleft and antithesis rates over texts of min_words or more; defaults for voices without any."""
    return rhetoric_bands_of(measured(df, by, text), by, min_words)


def rhetoric_bands_of(x: DataFrame, by: str = "voice", min_words: int = 200) -> DataFrame:
    """rhetoric_calibration() of measured() texts."""
    long_ = F.when(F.col("n") >= min_words, F.lit(1))  # null, and so out of the aggregates, where too short
    x = x.select(by, long_.alias("one"), (F.col("c") * long_).alias("c"), (F.col("a") * long_).alias("a"))
    q = group_quantiles(x, [by], {"c95": ("c", "floor", 0.95), "a95": ("a", "floor", 0.95), "c25": ("c", "floor", 0.25), "a25": ("a", "floor", 0.25)})
    y = x.groupBy(by).agg(F.count("one").alias("n_pieces")).join(q, by)
    some = F.col("n_pieces") > 0
    return y.select(
        by,
        "n_pieces",
        F.when(some, F.greatest("c95", F.lit(1.0))).otherwise(2.0).alias("cleft_p95"),
        F.when(some, F.greatest("a95", F.lit(3.0))).otherwise(6.0).alias("antithesis_p95"),
        F.coalesce("c25", F.lit(0.0)).alias("cleft_p25"),
        F.coalesce("a25", F.lit(0.0)).alias("antithesis_p25"),
    )


def quality_calibration(df: DataFrame, by: str = "voice", text: str = "text", min_words: int = 200, min_pieces: int = 5) -> DataFrame:
    """Lower quartiles and medians of density and specificity over texts of min_words or more, of voices with min_pieces of them."""
    return quality_bands_of(measured(df, by, text), by, min_words, min_pieces)


def quality_bands_of(x: DataFrame, by: str = "voice", min_words: int = 200, min_pieces: int = 5) -> DataFrame:
    """quality_calibration() of measured() texts."""
    x = x.where(F.col("n_ascii") >= min_words).select(by, F.col("density").alias("d"), F.col("specificity").alias("s"))
    q = group_quantiles(x, [by], {"density_p25": ("d", "floor", 0.25), "specificity_p25": ("s", "floor", 0.25), "density_median": ("d", "linear", 0.5), "specificity_median": ("s", "linear", 0.5)})
    return x.groupBy(by).agg(F.count("*").alias("n_pieces")).where(F.col("n_pieces") >= min_pieces).join(q, by)


def presence_calibration(df: DataFrame, by: str = "voice", text: str = "text") -> DataFrame:
    """Medians of all classes and floors of the gated ones, over texts of 220 words or more."""
    return presence_floors_of(measured(df, by, text), by)


def presence_floors_of(x: DataFrame, by: str = "voice") -> DataFrame:
    """presence_calibration() of measured() texts."""
    x = x.where(F.col("n") >= P.ABSENCE_WORDS).select(by, *P.PRESENCE)
    q = group_quantiles(x, [by], {f"{k}_median": (k, "linear", 0.5) for k in P.PRESENCE} | {f"{k}_floor": (k, "even", 0.25) for k in P.FIELD_FLOOR})
    med = [F.round(f"{k}_median", 3).alias(f"{k}_median") for k in P.PRESENCE]
    floor = [F.round(F.greatest(f"{k}_floor", F.lit(f)), 3).alias(f"{k}_floor") for k, f in P.FIELD_FLOOR.items()]
    return x.groupBy(by).agg(F.count("*").alias("n_pieces")).join(q, by).select(by, "n_pieces", *med, *floor)


def numbered(df: DataFrame, by: str, order: list) -> Column:
    return F.row_number().over(Window.partitionBy(by).orderBy(*order))
