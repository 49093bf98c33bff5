"""A rewrite against its source: findings on eight axes, and the tiered verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.functions import patterns as P
from inkgauge.functions import textkit as T
from inkgauge.operators import markup, rules

FINDING = "array<struct<axis:string,severity:string,detail:string>>"


def _finding(axis: str, severity: str, detail: Column | str) -> Column:
    return F.struct(F.lit(axis).alias("axis"), F.lit(severity).alias("severity"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))


def _headings(t: Column, fmt: Column) -> Column:
    """array<struct<level, title>> of a text in its format."""
    tex = F.transform(T.find_all(t, P.HEADING_LATEX), lambda h: F.struct(F.regexp_extract(h, P.HEADING_LATEX, 1).alias("level"), F.regexp_extract(h, P.HEADING_LATEX, 2).alias("title")))
    md = F.transform(T.find_all(t, P.HEADING_MARKDOWN), lambda h: F.struct(F.regexp_extract(h, P.HEADING_MARKDOWN, 1).alias("level"), F.regexp_extract(h, P.HEADING_MARKDOWN, 2).alias("title")))
    none = F.array().cast("array<struct<level:string,title:string>>")
    return F.when(fmt == "latex", tex).when(fmt == "markdown", md).otherwise(none)


def _lengths(prose: Column) -> Column:
    return F.transform(T.sentences_loose(prose), lambda s: F.size(T.tokens(s)))


def _tics(t: Column) -> dict[str, Column]:
    return {"not-just-X": T.count(t, P.NOT_JUST), "wh-cleft": T.count(t, P.WH_CLEFT), "contrarian colon": T.count(t, P.COLON_HOOK)}


def with_findings(df: DataFrame, source: str, output: str, fmt: str | None = None) -> DataFrame:
    """df with ``findings``: array<axis, severity, detail> in the order of the axes; null where a text is.

    What several axes share (prose, headings, ranges, lengths) is written out
    as columns first, so that it is computed once per row.
    """
    keep = [F.col(f"`{c}`") for c in df.columns]
    s, o = F.col(source), F.col(output)
    sniffed = F.lower(F.coalesce(F.col(fmt), markup.guess_format(s))) if fmt else markup.guess_format(s)
    x = df.withColumn("_kind", F.when(sniffed == "tex", "latex").when(sniffed == "md", "markdown").otherwise(sniffed))
    kind = F.col("_kind")
    x = x.withColumns({"_sp": markup.to_prose(s, kind), "_op": markup.to_prose(o, kind), "_sh": _headings(s, kind), "_oh": _headings(o, kind), "_sr": T.find_all(s, P.NUMERIC_RANGE), "_or": T.find_all(o, P.NUMERIC_RANGE)})
    x = x.withColumns({"_sl": _lengths(F.col("_sp")), "_ol": _lengths(F.col("_op"))})
    sp, op, sh, oh, sr, orr, sl, ol = (F.col(c) for c in ("_sp", "_op", "_sh", "_oh", "_sr", "_or", "_sl", "_ol"))
    out: list[Column] = []
    out.append(F.when(T.count(o, P.SCAFFOLD) > 0, _finding("scaffold", "hard", F.concat(T.count(o, P.SCAFFOLD).cast("string"), F.lit(" artefacts")))))
    levels = F.array_sort(F.array_union(F.transform(sh, lambda h: h["level"]), F.transform(oh, lambda h: h["level"])))

    def level_diff(v):
        a, b = F.size(F.filter(sh, lambda h: h["level"] == v)), F.size(F.filter(oh, lambda h: h["level"] == v))
        return F.when(a != b, _finding("structure", "hard", F.concat_ws(" ", v, a.cast("string"), F.lit("->"), b.cast("string"))))

    structure = F.transform(levels, level_diff)
    out.append(F.when(F.size(orr) < F.size(sr), _finding("house-style", "hard", F.array_join(F.filter(sr, lambda r: ~F.array_contains(orr, r)), "; "))))
    enough = (F.size(sl) >= 8) & (F.size(ol) >= 8)

    def fell(new, old, tol):
        return enough & (old > 0) & (new < old * (1 - tol))

    out.append(F.when(fell(T.stdev(ol, True), T.stdev(sl, True), P.SD_DROP), _finding("rhythm", "hard", "variance fell")))
    out.append(F.when(fell(T.share(ol, lambda v: v >= P.LONG_WORDS), T.share(sl, lambda v: v >= P.LONG_WORDS), P.TAIL_DROP), _finding("rhythm", "hard", "long sentences fell")))
    out.append(F.when(fell(T.share(ol, lambda v: v < P.SHORT_WORDS), T.share(sl, lambda v: v < P.SHORT_WORDS), P.TAIL_DROP), _finding("rhythm", "hard", "short sentences fell")))
    for name, pattern in P.REGISTER.items():
        a, b = T.count(sp, pattern), T.count(op, pattern)
        text = F.concat(F.lit(f"{name} "), a.cast("string"), F.lit(" -> "), b.cast("string"))
        out.append(F.when((a == 0) & (b > 0), _finding("register", "hard", text)).when(b > F.greatest(a * P.REGISTER_GROWTH, a + P.REGISTER_SLACK), _finding("register", "soft", text)))

    def heading_tic(z):
        was, now = _tics(z["a"]["title"]), _tics(z["b"]["title"])
        return F.array(*(F.when((now[k] > 0) & (was[k] == 0), _finding("construction", "hard", F.concat(F.lit(f"{k}: "), z["b"]["title"]))) for k in now))

    same = F.size(sh) == F.size(oh)
    pairs = F.zip_with(sh, oh, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    headings = F.when(same, F.flatten(F.transform(pairs, heading_tic))).otherwise(F.array().cast(FINDING))
    was, now = _tics(sp), _tics(op)
    grew = F.array_compact(F.array(*(F.when(now[k] > was[k], F.lit(k)) for k in ("not-just-X", "wh-cleft"))))
    out.append(F.when(F.size(grew) > 0, _finding("construction", "soft", F.array_join(grew, "; "))))
    h0, h1, u0, u1 = T.count(sp, P.CLAIM_HEDGES), T.count(op, P.CLAIM_HEDGES), T.count(sp, P.UNIVERSALS), T.count(op, P.UNIVERSALS)
    out.append(F.when((h1 < h0) | (u1 > u0), _finding("claim-strength", "soft", F.concat(F.lit("hedges "), h0.cast("string"), F.lit(" -> "), h1.cast("string"), F.lit(", universals "), u0.cast("string"), F.lit(" -> "), u1.cast("string")))))
    n0, n1 = F.size(T.tokens(s)), F.size(T.tokens(o))
    out.append(F.when((n0 > 0) & (n1 / F.nullif(n0, F.lit(0)) - 1 > P.MAX_GROWTH), _finding("length", "hard", F.concat(n0.cast("string"), F.lit(" -> "), n1.cast("string")))))
    first, rest = F.array(out[0]), F.array(*out[1:])
    every = F.concat(first.cast(FINDING), structure.cast(FINDING), rest.cast(FINDING), headings.cast(FINDING))
    return x.select(*keep, F.when(s.isNotNull() & o.isNotNull(), F.array_compact(every)).alias("findings"))


def n_of(f: Column, severity: str) -> Column:
    return F.size(F.filter(f, lambda x: x["severity"] == severity))


def rendered(f: Column) -> Column:
    """The findings as lines, hard ones first; OK without any."""
    line = lambda x: F.concat(F.upper(x["severity"]), F.lit(" "), x["axis"], F.lit(": "), x["detail"])
    lines = F.transform(F.concat(F.filter(f, lambda x: x["severity"] == "hard"), F.filter(f, lambda x: x["severity"] == "soft")), line)
    return F.when(F.size(f) > 0, F.array_join(lines, "\n")).otherwise("OK")


# --- tiers ---

TIERS = ("correctness", "authenticity", "quality", "tics", "advisory")


def verdict(c: dict[str, Column]) -> Column:
    """array<struct<tier, source, message>> of the findings that hold, lowest tier first.

    c names boolean columns: added_numbers, dropped_citations, leaks, off,
    presence_missing, repetitive, padded, thin, vague, banned_words,
    banned_phrases, dashes, flourish, cleft_over, antithesis_over, triad,
    drifting, cleft_under, antithesis_under, low_burstiness.
    """
    plan = (
        ("added_numbers", 1, "fidelity", "numbers not in the source"),
        ("dropped_citations", 1, "fidelity", "citations dropped"),
        ("leaks", 1, "rhetoric", "the draft talks about its task"),
        ("off", 2, "fingerprint", "off voice"),
        ("presence_missing", 2, "presence", "nobody is in the draft"),
        ("repetitive", 3, "quality", "repetitive"),
        ("padded", 3, "quality", "padded"),
        ("thin", 3, "quality", "thin"),
        ("vague", 3, "quality", "vague"),
        ("banned_words", 4, "scrub", "tell words"),
        ("banned_phrases", 4, "scrub", "tell phrases"),
        ("dashes", 4, "scrub", "dashes"),
        ("flourish", 4, "rhetoric", "closing flourish"),
        ("cleft_over", 4, "rhetoric", "clefts over the band"),
        ("antithesis_over", 4, "rhetoric", "antithesis over the band"),
        ("triad", 4, "rhetoric", "triad"),
        ("drifting", 5, "fingerprint", "drifting"),
        ("cleft_under", 5, "rhetoric", "clefts under the band"),
        ("antithesis_under", 5, "rhetoric", "antithesis under the band"),
        ("low_burstiness", 5, "scrub", "low burstiness"),
    )
    rows = [F.when(c[k], F.struct(F.lit(t).alias("tier"), F.lit(src).alias("source"), F.lit(m).alias("message"))) for k, t, src, m in plan if k in c]
    return F.array_compact(F.array(*rows))


def worst_tier(v: Column) -> Column:
    return F.array_min(F.transform(v, lambda f: f["tier"]))


def blocks(v: Column, at: int = 2) -> Column:
    return F.exists(v, lambda f: f["tier"] <= at)


def hard_flags(text: Column, source: Column | None = None) -> Column:
    """em-dash, banned-phrase, fidelity-number, fidelity-citation, task-leakage: those that hold."""
    checks = [F.when(rules.plain_dashes(text) > 0, F.lit("em-dash")), F.when(F.size(rules.banned_phrases(text)) > 0, F.lit("banned-phrase"))]
    if source is not None:
        d = rules.fidelity_sets(source, text)
        checks.append(F.when(source.isNotNull() & ((F.size(d["dropped_numbers"]) > 0) | (F.size(d["added_numbers"]) > 0)), F.lit("fidelity-number")))
        checks.append(F.when(source.isNotNull() & (F.size(d["dropped_citations"]) > 0), F.lit("fidelity-citation")))
    checks.append(F.when(F.size(rules.leakage(text)) > 0, F.lit("task-leakage")))
    return F.array_compact(F.array(*checks))
