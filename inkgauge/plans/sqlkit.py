"""Pieces of DuckDB SQL that say the same as functions.textkit, in their own way."""

from __future__ import annotations

from inkgauge.functions import patterns as P


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(p: str) -> str:
    """A pattern as an RE2 literal."""
    return lit(p.replace("(?md)", "(?m)").replace("(?smd)", "(?sm)"))


def found(t: str, p: str) -> str:
    return f"regexp_extract_all({t}, {rx(p)})"


def n_found(t: str, p: str) -> str:
    return f"len({found(t, p)})"


def w1(t: str) -> str:
    return found(t, P.WORD_ASCII)


def w2(t: str) -> str:
    return found(t, P.WORD_UNICODE)


def tok(t: str) -> str:
    return found(t, P.TOKEN)


def strip(t: str) -> str:
    return f"regexp_replace({t}, {lit('^' + P.WS + '+|' + P.WS + '+$')}, '', 'g')"


_MARK = lit(r"([.!?])" + P.WS + r"+([\"'“‘(]?[A-Z0-9])")


def sents(t: str) -> str:
    """Marks cuts by a replacement, as RE2 has no lookaround."""
    cut = f"string_split(regexp_replace(p, {_MARK}, '\\1' || chr(1) || '\\2', 'g'), chr(1))"
    lines = f"list_filter(list_transform(string_split({t}, chr(10)), lambda q: {strip('q')}), lambda q: q <> '')"
    return f"list_filter(flatten(list_transform({lines}, lambda p: list_transform({cut}, lambda z: {strip('z')}))), lambda z: z <> '')"


def paras(t: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({t}, {lit(P.PARAGRAPH_GAP)}), lambda q: {strip('q')}), lambda q: q <> '')"


def r6(x: str) -> str:
    return f"(round({x}, 6) + 0.0)"


def sd(a: str) -> str:
    return f"coalesce(list_aggregate({a}, 'stddev_samp'), 0.0)"


def share(a: str, test: str) -> str:
    return f"(len(list_filter({a}, lambda e: {test})) / nullif(len({a}), 0)::double)"


def feature_cte(table: str, key: str, keep: str = "", where: str = "true", name: str = "feat") -> str:
    """CTEs ending in ``name`` (key, keep, n_words, the 13 surface features)."""
    k = f"{keep}, " if keep else ""
    dash = n_found(f"regexp_replace(text, {rx(P.RULE_LINE)}, '', 'g')", P.DASH_RUN)
    f = {
        "sent_len_mean": "list_avg(l)",
        "sent_len_stdev": sd("l"),
        "pct_short_sents": share("l", "e < 8"),
        "pct_long_sents": share("l", "e > 30"),
        "colons_per_100w": "(length(text) - length(replace(text, ':', ''))) * 100.0::double / len(w)",
        "semicolons_per_100w": "(length(text) - length(replace(text, ';', ''))) * 100.0::double / len(w)",
        "emdash_per_100w": f"{dash} * 100.0::double / len(w)",
        "question_rate": share("s", "e[-1:] = '?'"),
        "commas_per_sent": "(length(text) - length(replace(text, ',', '')))::double / len(s)",
        "para_len_mean": "coalesce(list_avg(pl), len(s))",
        "first_person_openers": share("s", f"regexp_matches(e, {rx(P.FIRST_PERSON)})"),
        "ttr": "len(list_distinct(list_transform(w[1:400], lambda e: lower(e)))) / len(w[1:400])::double",
        "word_len_mean": "list_avg(list_transform(w, lambda e: length(e)))",
    }
    cols = ", ".join(f"case when len(s) > 0 and len(w) >= 20 then {v} else 0.0::double end as {n}" for n, v in f.items())
    return (
        f"{name}_a as (select {key}, {k}text, {w1('text')} as w, {sents('text')} as s, list_transform({paras('text')}, lambda x: len({sents('x')})) as pl from {table} where text is not null and {where}), "
        f"{name}_b as (select *, list_transform(s, lambda x: len({w1('x')})) as l from {name}_a), "
        f"{name} as (select {key}, {k}len(w) as n_words, {cols} from {name}_b)"
    )


SURFACE = P.SURFACE


def fingerprint_cte(feat: str = "feat", by: str = "voice", name: str = "fp", min_words: int = P.MIN_PIECE_WORDS) -> str:
    """u: usable units; fp (by, n_pieces, f_m, f_s)."""
    cols = ", ".join(f"avg({f}) as {f}_m, coalesce(stddev_samp({f}), 0.0) as {f}_s" for f in SURFACE)
    return f"u as (select * from {feat} where {by} is not null and n_words >= {min_words}), {name} as (select {by}, count(*) as n_pieces, {cols} from u group by {by} having count(*) >= {P.MIN_PIECES})"


def z(f: str, unit: str = "x", fp: str = "y", clip: bool = True) -> str:
    v = f"case when {fp}.{f}_s > 1e-9 then ({unit}.{f} - {fp}.{f}_m) / {fp}.{f}_s else 0.0 end"
    return f"greatest(-4.0, least(4.0, {v}))" if clip else v


def rms(unit: str = "x", fp: str = "y") -> str:
    return "sqrt((" + " + ".join(f"pow({z(f, unit, fp)}, 2)" for f in SURFACE) + f") / {len(SURFACE)}.0)"


def encoded_cte(src: str, key: str, text: str, name: str) -> str:
    """name (key, p, v): the places of the hashed encoding of a table's texts that aren't 0, normalised; name_k has every key."""
    byte = "(strpos('0123456789abcdef', substr(md5(w), 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(md5(w), 2, 1)) - 1"
    return (
        f"{name}_w as (select {key}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')) as w from {src} where {text} is not null), {name}_b as (select {key}, {byte} as h from {name}_w), "
        f"{name}_v as (select {key}, h % 64 as p, sum(case when (h // 64) % 2 = 1 then 1 else -1 end)::double as v from {name}_b group by all), {name} as (select {key}, p, v / sqrt(sum(v * v) over (partition by {key})) as v from {name}_v where v <> 0), "
        f"{name}_k as (select distinct {key} from {src} where {text} is not null)"
    )


def encoded_sims(a: str, ka: str, b: str, kb: str, name: str) -> str:
    """name (ka, kb, sim): the dot product of every two encodings of a and b."""
    return f"{name}_s as (select a.{ka} as qa, b.{kb} as qb, sum(a.v * b.v) as sim from {a} a join {b} b using (p) group by all), {name} as (select a.{ka} as qa, b.{kb} as qb, coalesce(sim, 0.0) as sim from {a}_k a cross join {b}_k b left join {name}_s s on s.qa = a.{ka} and s.qb = b.{kb})"
