"""Queries: rule scans, fidelity, markup, chunking, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkgauge.functions import patterns as P
from inkgauge.functions import textkit as T
from inkgauge.operators import calibrate as C
from inkgauge.operators import chunking, feedback, fidelity, markup, rules
from inkgauge.plans import sqlkit as S
from inkgauge.plans.registry import query
from inkgauge.plans.style import _CAND, _CANDF, _LOO, calibration_units, candidate_units, doc_fit
from inkgauge.session import table

R = T.rounded

# Rows that show what the tables' invented prose never does.
SAMPLES = (
    ("s1", "We delve into a rich tapestry of holistic ideas, and it is important to note that robust synergy matters. Okay, here's my answer."),
    ("s2", "First the light goes, then the colour, then the warmth. The walk had been long and cold and nobody in the party had said a word for an hour. It was over."),
    ("s3", "What this shows is that the model, which is the part I like, was not a tool but a habit. The result holds -- mostly -- rather than everywhere, exactly where it hurts."),
    ("s4", "We suspected the effect was unexpected; to our surprise it seems to hold. I checked the logs and we rejected the rest. In short, it is kind of a puzzle."),
    ("s5", "In 2,000 cases (Smith et al., 2019) the WHO-2 index rose by 3.50 percent, as arXiv:2101.00001 reports."),
    ("s6", "----\nA dash — here\n----\nand one-- there , , end"),
    ("s7", "You don't really need this, do you? There is no reason whatsoever. In order to win, a number of things must happen."),
    ("s8", ""),
)
_SQL_SAMPLES = "samples as (select * from (values " + ", ".join(f"({S.lit(i)}, {S.lit(t)})" for i, t in SAMPLES).replace("\n", "' || chr(10) || '") + ") v(id, text))"
_TEXTS = f"{_SQL_SAMPLES}, {_CAND}, texts as (select id, text from samples union all select cand_id, text from c0)"


def samples(s):
    return s.createDataFrame(list(SAMPLES), "id string, text string")


def drafts(s, d):
    return table(s, d, "candidates").where("text is not null and voice is not null").select("cand_id", "task_id", "cand_idx", "voice", "text").dropDuplicates(["cand_id"])


def texts(s, d):
    return samples(s).unionByName(drafts(s, d).select(F.col("cand_id").alias("id"), "text"))


def _arr(x) -> F.Column:
    return F.array_join(x, "|")


_TELLS = "[" + ", ".join(S.lit(w) for w in P.TELL_WORDS) + "]"
_PHRASES = "[" + ", ".join(S.lit(w) for w in P.TELL_PHRASES) + "]"
_DASHES = S.n_found(f"regexp_replace(text, {S.rx(P.RULE_LINE)}, '', 'g')", P.DASH_RUN)
_SLEN = f"list_filter(list_transform({S.sents('text')}, lambda q: len({S.w2('q')})), lambda n: n > 0)"


_WORST3 = "list_sort([" + ", ".join(f"abs({S.z(f)})" for f in P.SURFACE) + "], 'desc')[1:3]"


def _fit(distance: str, worst: str = "") -> str:
    """off, drifting or fit, over self_baseline and fit_threshold."""
    drift = f"{distance} > self_baseline * {P.FIT_RATIO}" + (f" or len(list_filter({worst}, lambda v: v >= {P.FEATURE_Z})) >= {P.FEATURE_K}" if worst else "")
    limit = f"(case when fit_threshold > 0 then fit_threshold else self_baseline * {P.FIT_RATIO} end)"
    return f"case when {limit} > 0 and {distance} > {limit} then 'off' when self_baseline > 0 and ({drift}) then 'drifting' else 'fit' end"


@query(
    "scrub_scores",
    f"with {_TEXTS} select id, {_DASHES} as dashes, array_to_string(list_sort(list_filter({_TELLS}, lambda w: list_contains({S.found('lower(text)', P.WORD_PLAIN)}, w))), '|') as banned_words, "
    f"array_to_string(list_filter({_PHRASES}, lambda p: contains(lower(text), p)), '|') as banned_phrases, {S.r6(f'coalesce({S.n_found("text", P.HEDGES_SOFT)} * 200.0::double / nullif(len({S.w2("text")}), 0), 0.0)')} as hedges_per200, {S.r6(S.sd(_SLEN))} as burstiness from texts",
)
def scrub_scores(s, d):
    t = F.col("text")
    return texts(s, d).select("id", rules.plain_dashes(t).cast("long").alias("dashes"), _arr(rules.banned_words(t)).alias("banned_words"), _arr(rules.banned_phrases(t)).alias("banned_phrases"), R(rules.hedges_per_200(t)).alias("hedges_per200"), R(rules.burstiness(t)).alias("burstiness"))


_WORDS_TESTED = P.TELL_WORDS + ("garden", "quick", "hungry", "harbor", "silent", "meanwhile", "lantern", "jardin")
_TESTED = "(values " + ", ".join(f"({S.lit(w)})" for w in _WORDS_TESTED) + ") v(word)"


@query(
    "banlist_by_author",
    f"with p as (select voice, text, {_SLEN} as l from documents where text is not null and voice is not null), w as (select voice, unnest({S.w2('lower(text)')}) as word from p where len(l) >= 3), u as (select voice, word, count(*) as uses from w group by all) "
    f"select a.voice, v.word from (select distinct voice from documents where voice is not null and text is not null) a cross join {_TESTED} left join u on u.voice = a.voice and u.word = v.word where coalesce(uses, 0) < 3",
)
def banlist_by_author(s, d):
    docs = table(s, d, "documents").where("text is not null")
    return rules.banlists(docs, _WORDS_TESTED).where("banned").select("voice", "word")


def _even(x: str, p: str) -> str:
    return f"list_sort(list({x}))[round_even({p} * (count(*) - 1), 0)::int + 1]"


@query(
    "hedge_burstiness_calibration",
    f"with p as (select voice, {_SLEN} as l, {S.n_found('text', P.HEDGES_SOFT)} as h, {_DASHES} as dd from documents where text is not null and voice is not null), q as (select voice, {S.sd('l')} as b, list_avg(l) as m, h * 200.0::double / list_sum(l) as h, dd * 1000.0::double / list_sum(l) as dd from p where len(l) >= 3) "
    f"select voice, count(*) as n_pieces, {S.r6(_even('b', '0.05'))} as burstiness_floor, {S.r6(_even('h', '0.95'))} as hedge_ceiling, {S.r6(_even('dd', '0.95'))} as dash_per1k_p95, {S.r6(_even('m', '0.5'))} as mean_sentence_len, {_even('dd', '0.95')} >= 2.0 as uses_dashes from q group by voice",
)
def hedge_burstiness_calibration(s, d):
    c = rules.scrub_calibration(table(s, d, "documents"))
    return c.select("voice", "n_pieces", *(R(F.col(k)).alias(k) for k in ("burstiness_floor", "hedge_ceiling", "dash_per1k_p95", "mean_sentence_len")), (F.col("dash_per1k_p95") >= P.AUTHOR_DASH_MIN).alias("uses_dashes"))


def _num(t: str) -> str:
    return f"list_distinct(list_transform({S.found(t, P.NUMBER)}, lambda x: case when contains(x, '.') then regexp_replace(regexp_replace(replace(x, ',', ''), '0+$', ''), '\\.$', '') else replace(x, ',', '') end))"


def _cit(t: str) -> str:
    skip = "[" + ", ".join(S.lit(a) for a in P.ACRONYM_SKIP) + "]"
    return f"list_distinct(list_concat(list_transform({S.found(t, P.CITATION)}, lambda x: {S.strip('x')}), list_filter({S.found(t, P.ACRONYM)}, lambda x: not list_contains({skip}, x))))"


def _less(a: str, b: str) -> str:
    return f"array_to_string(list_transform(list_sort(list_transform(list_filter({a}, lambda x: not list_contains({b}, x)), lambda x: {{'n': length(x), 'x': x}})), lambda z: z.x), '|')"


@query(
    "number_citation_fidelity",
    f"with e as (select distinct id, ai_text, human_text from edit_pairs where ai_text is not null and human_text is not null), n as (select id, {_num('ai_text')} as a, {_num('human_text')} as b, {_cit('ai_text')} as ca, {_cit('human_text')} as cb from e) "
    f"select id, {_less('a', 'b')} as dropped_numbers, {_less('b', 'a')} as added_numbers, array_to_string(list_sort(list_filter(ca, lambda x: not list_contains(cb, x))), '|') as dropped_citations from n",
)
def number_citation_fidelity(s, d):
    e = table(s, d, "edit_pairs").where("ai_text is not null and human_text is not null").select("id", "ai_text", "human_text").distinct()
    x = rules.fidelity_sets(F.col("ai_text"), F.col("human_text"))
    return e.select("id", _arr(x["dropped_numbers"]).alias("dropped_numbers"), _arr(x["added_numbers"]).alias("added_numbers"), _arr(F.array_sort(x["dropped_citations"])).alias("dropped_citations"))


def _rate(p: str) -> str:
    return S.r6(f"coalesce({S.n_found('text', p)} * 1000.0::double / nullif(len({S.w2('text')}), 0), 0.0)")


_PUNCH = f"len(list_filter(range(2, len(s) + 1), lambda i: len({S.w2('s[i]')}) <= {P.PUNCH_WORDS} and len({S.w2('s[i - 1]')}) >= {P.SETUP_WORDS} and regexp_matches(s[i], {S.rx(P.ABSENCE_PUNCH)})))"
_OPENERS = "[" + ", ".join(S.lit(o) for o in P.TRIAD_OPENERS) + "]"
_CLAUSES = f"list_filter(regexp_split_to_array(e, '[,;]'), lambda c: {S.strip('c')} <> '')"
_TRIAD = (
    f"len(list_filter(s, lambda e: regexp_matches(e, {S.rx(P.TRIAD_SEQUENCE)}) or (len({_CLAUSES}) >= 3 and len(list_filter({_OPENERS}, lambda o: len(list_filter({_CLAUSES}, lambda c: lower(coalesce({S.w2('c')}[1], '')) = o)) >= 2)) > 0)))"
)


@query(
    "rhetoric_tics",
    f"with {_TEXTS}, x as (select id, text, {S.sents('text')} as s from texts) select id, {_TRIAD} as n_triads, {S.n_found('text', P.META_ASIDE)} as n_asides, {_PUNCH} as n_punches, {S.n_found('text', P.LEAKAGE)} as n_leaks, "
    f"{_rate(P.WH_CLEFT)} as cleft_rate, {_rate(P.ANTITHESIS)} as antithesis_rate, coalesce(list_sum(list_transform(s[greatest(len(s) - 1, 1):], lambda e: {S.n_found('e', P.FLOURISH)})), 0)::bigint as n_flourishes from x",
)
def rhetoric_tics(s, d):
    c = rules.rhetoric_columns(F.col("text"))
    n = [F.coalesce(c[k], F.lit(0)).cast("long").alias(k) for k in ("n_triads", "n_asides", "n_punches", "n_leaks", "n_flourishes")]
    return texts(s, d).select("id", *n, R(c["cleft_rate"]).alias("cleft_rate"), R(c["antithesis_rate"]).alias("antithesis_rate"))


def _no_lookahead(t: str, p: str) -> tuple[str, str]:
    """(text, pattern) for RE2 of a pattern with one negative lookahead after white space: where it forbids a match, the white space before is taken out of the text."""
    head, rest = p.split("(?!", 1)
    depth = 1
    for k, c in enumerate(rest):
        depth += {"(": 1, ")": -1}.get(c, 0)
        if not depth:
            break
    before = head.removesuffix(P.WS + "+")
    flags, before = (before[:4], before[4:]) if before.startswith("(?i)") else ("", before)
    return f"regexp_replace({t}, {S.lit(f'{flags}({before}){P.WS}+({rest[:k]})')}, '\\1' || chr(1) || '\\2', 'g')", head + rest[k + 1 :]


_IT = _no_lookahead("text", P.IT_CLEFT)


@query("it_clefts", f"with {_TEXTS} select id, {S.r6(f'coalesce({S.n_found(*_IT)} * 1000.0::double / nullif(len({S.w2("text")}), 0), 0.0)')} as it_cleft_rate from texts")
def it_clefts(s, d):
    return texts(s, d).select("id", R(rules.rhetoric_columns(F.col("text"))["it_cleft_rate"]).alias("it_cleft_rate"))


def _floor(x: str, p: str) -> str:
    return f"list_sort(list({x}))[floor({p} * (count(*) - 1))::int + 1]"


_RHET = f"""r as (select voice, len({S.w2('text')}) as n, {S.n_found('text', P.WH_CLEFT)} * 1000.0::double / nullif(len({S.w2('text')}), 0) as c, {S.n_found('text', P.ANTITHESIS)} * 1000.0::double / nullif(len({S.w2('text')}), 0) as a from documents where text is not null and voice is not null),
b as (select voice, count(*) as n_pieces, greatest({_floor('c', '0.95')}, 1.0) as cleft_p95, greatest({_floor('a', '0.95')}, 3.0) as antithesis_p95, {_floor('c', '0.25')} as cleft_p25, {_floor('a', '0.25')} as antithesis_p25 from r where n >= 200 group by voice)"""


@query(
    "rhetoric_bands",
    f"with {_RHET} select v.voice, coalesce(n_pieces, 0) as n_pieces, {S.r6('coalesce(cleft_p95, 2.0)')} as cleft_p95, {S.r6('coalesce(antithesis_p95, 6.0)')} as antithesis_p95, {S.r6('coalesce(cleft_p25, 0.0)')} as cleft_p25, {S.r6('coalesce(antithesis_p25, 0.0)')} as antithesis_p25 from (select distinct voice from r) v left join b using (voice)",
)
def rhetoric_bands(s, d):
    c = rules.rhetoric_calibration(table(s, d, "documents"))
    return c.select("voice", "n_pieces", *(R(F.col(k)).alias(k) for k in ("cleft_p95", "antithesis_p95", "cleft_p25", "antithesis_p25")))


_WORDN = f"greatest(len({S.w2('text')}), 1)"


@query(
    "presence_density",
    f"with {_TEXTS}, x as (select id, {_WORDN} as n, {', '.join(f'{S.n_found("text", p)} * 1000.0::double / {_WORDN} as {k}' for k, p in P.PRESENCE.items())}, {S.n_found('text', P.WEAK_HEDGES)} * 200.0::double / {_WORDN} as weak from texts) "
    f"select id, {', '.join(f'{S.r6(k)} as {k}' for k in P.PRESENCE)}, {S.r6(' + '.join(P.PRESENCE))} as total, {S.r6('weak')} as weak_hedges, n >= 220 as measurable, n >= 220 and epistemic = 0 and expectation = 0 as missing from x",
)
def presence_density(s, d):
    t = F.col("text")
    x = texts(s, d).select("id", F.size(T.words_unicode(t)).alias("n"), *(c.alias(k) for k, c in rules.presence_columns(t).items()))
    st = rules.presence_state(F.col("n"), {k: F.lit(v) for k, v in P.FIELD_FLOOR.items()})
    return x.select("id", *(R(F.col(k)).alias(k) for k in P.PRESENCE), R(F.col("presence_total")).alias("total"), R(F.col("weak_hedges")).alias("weak_hedges"), st["measurable"].alias("measurable"), st["presence_missing"].alias("missing"))


@query(
    "presence_floors",
    f"with x as (select voice, {', '.join(f'{S.n_found("text", p)} * 1000.0::double / {_WORDN} as {k}' for k, p in P.PRESENCE.items())} from documents where text is not null and voice is not null and len({S.w2('text')}) >= 220) "
    f"select voice, count(*) as n_pieces, {', '.join(f'round(median({k}), 3) + 0.0 as {k}_median' for k in P.PRESENCE)}, {', '.join(f'round(greatest({_even(k, "0.25")}, {v}), 3) + 0.0 as {k}_floor' for k, v in P.FIELD_FLOOR.items())} from x group by voice",
)
def presence_floors(s, d):
    return rules.presence_calibration(table(s, d, "documents"))


_FUNC = "[" + ", ".join(S.lit(w) for w in dict.fromkeys(P.FUNCTION_WORDS)) + "]"


def _content(t: str) -> str:
    return f"list_filter(list_transform({S.w1(t)}, lambda w: lower(w)), lambda w: length(w) > 2 and not list_contains({_FUNC}, w))"


_Q = f"""case when len({S.w1('text')}) >= 40 then len(list_distinct({_content('text')})) * 100.0::double / len({S.w1('text')}) else 0.0 end as density,
case when len({S.w1('text')}) >= 40 then coalesce(len(list_filter({S.sents('text')}, lambda e: regexp_matches(e, {S.rx(P.ANCHOR)}))) / nullif(len({S.sents('text')}), 0)::double, 0.0) else 0.0 end as specificity,
case when len({S.w1('text')}) >= 40 then {S.n_found('text', P.FILLER)} * 1000.0::double / len({S.w1('text')}) else 0.0 end as filler"""


@query("quality_scores", f"with {_TEXTS}, q as (select id, {_Q} from texts) select id, {S.r6('density')} as density, {S.r6('specificity')} as specificity, {S.r6('filler')} as filler from q")
def quality_scores(s, d):
    return texts(s, d).select("id", *(R(c).alias(k) for k, c in rules.quality_columns(F.col("text")).items()))


@query(
    "quality_bands",
    f"with q as (select voice, {_Q} from documents where text is not null and voice is not null and len({S.w1('text')}) >= 200) select voice, count(*) as n_pieces, {S.r6(_floor('density', '0.25'))} as density_p25, {S.r6(_floor('specificity', '0.25'))} as specificity_p25, {S.r6('median(density)')} as density_median, {S.r6('median(specificity)')} as specificity_median from q group by voice having count(*) >= 5",
)
def quality_bands(s, d):
    c = rules.quality_calibration(table(s, d, "documents"))
    return c.select("voice", "n_pieces", *(R(F.col(k)).alias(k) for k in ("density_p25", "specificity_p25", "density_median", "specificity_median")))


def _redundancy(src: str, key: str) -> str:
    """CTEs ending in red (key, ov, i, j): the worst pair of sentences of the texts of a table with 40 words or more that have any."""
    return (
        f"rx as (select {key}, {S.sents('text')} as s, len({S.w1('text')}) as n from {src} where text is not null), rc as (select {key}, unnest(range(0, len(s))) as i, unnest(list_transform(s, lambda e: list_distinct({_content('e')}))) as c from rx where n >= 40), "
        f"rk as (select * from rc where len(c) >= 4), rp as (select a.{key}, a.i, b.i as j, len(list_intersect(a.c, b.c)) / least(len(a.c), len(b.c))::double as ov from rk a join rk b on a.{key} = b.{key} and a.i < b.i), "
        f"red as (select * from (select *, row_number() over (partition by {key} order by ov desc, i, j) as rn from rp where ov > 0) where rn = 1)"
    )


@query(
    "max_redundancy_pair",
    f"with {_redundancy('documents', 'doc_id')} select rx.doc_id, {S.r6('coalesce(ov, 0.0)')} as redundancy, coalesce(i, -1) as i, coalesce(j, -1) as j from rx left join red using (doc_id)",
)
def max_redundancy_pair(s, d):
    x = rules.redundancy(table(s, d, "documents"), "doc_id")
    return x.select("doc_id", R(F.col("redundancy")).alias("redundancy"), F.coalesce("i", F.lit(-1)).cast("long").alias("i"), F.coalesce("j", F.lit(-1)).cast("long").alias("j"))


_QB = f"qb as (select voice, {_floor('density', '0.25')} as density_p25, {_floor('specificity', '0.25')} as specificity_p25 from (select voice, {_Q} from documents where text is not null and voice is not null and len({S.w1('text')}) >= 200) group by voice having count(*) >= 5)"
_QUALITY = {"repetitive": "coalesce(ov, 0.0) >= 0.6", "padded": "filler > 6.0", "thin": "density_p25 > 0 and density < density_p25", "vague": "specificity_p25 > 0 and specificity < specificity_p25"}


@query(
    "quality_flags",
    f"with {_CAND}, {_redundancy('c0', 'cand_id')}, {_QB}, dq as (select cand_id, voice, {_Q} from c0) select cand_id, array_to_string(list_filter([{', '.join(f'case when {v} then {S.lit(k)} end' for k, v in _QUALITY.items())}], lambda x: x is not null), '|') as flags from dq left join red using (cand_id) left join qb using (voice)",
)
def quality_flags(s, d):
    """Flags of every draft against its voice's quality bands."""
    c = drafts(s, d)
    q = c.select("cand_id", "voice", *(x.alias(k) for k, x in rules.quality_columns(F.col("text")).items())).join(rules.redundancy(c, "cand_id"), "cand_id")
    q = q.join(rules.quality_calibration(table(s, d, "documents")).select("voice", "density_p25", "specificity_p25"), "voice", "left")
    zero = lambda k: F.coalesce(F.col(k), F.lit(0.0))
    return q.select("cand_id", _arr(rules.quality_flags(zero("density_p25"), zero("specificity_p25"))).alias("flags"))


@query("dash_scalpel_plain", f"with {_TEXTS}, l as (select id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: case when regexp_matches(x, {S.rx(P.RULE_LINE)}) then x else regexp_replace(x, {S.rx(P.DASH_EDIT)}, ', ', 'g') end), chr(10)) as t, {_DASHES} as n from texts) select id, regexp_replace(t, ',[ \\t]*,', ',', 'g') as fixed, n from l")
def dash_scalpel_plain(s, d):
    return texts(s, d).select("id", rules.plain_scalpel(F.col("text")).alias("fixed"), rules.plain_dashes(F.col("text")).cast("long").alias("n"))


@query("format_sniff", f"select doc_id, case when regexp_matches(text, {S.rx(P.LATEX_SIGNS)}) then 'latex' when regexp_matches(text, {S.rx(P.MARKDOWN_SIGNS)}) then 'markdown' else 'plain' end as fmt from documents where text is not null")
def format_sniff(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", markup.guess_format(F.col("text")).alias("fmt"))


def _demarkdown(t: str) -> str:
    """The steps of Markdown to prose; RE2 has no back references, so paired marks are spelled out."""
    for pattern, new in markup.MARKDOWN_STEPS:
        if pattern.endswith("\\1"):
            pattern, new = r"\*\*(.+?)\*\*|__(.+?)__|\*(.+?)\*|_(.+?)_", "$1$2$3$4"
        t = f"regexp_replace({t}, {S.rx(pattern)}, {S.lit(new.replace('$', chr(92)))}, 'g')"
    return S.strip(t)


# plain and Markdown texts, as all of the tables are; LaTeX has tests of its own
@query(
    "document_prose",
    f"with x as (select doc_id::varchar as id, text from documents where text is not null union all select id, any_value(text) from chunks where text is not null group by id) select id, case when regexp_matches(text, {S.rx(P.LATEX_SIGNS)}) then null when regexp_matches(text, {S.rx(P.MARKDOWN_SIGNS)}) then {_demarkdown('text')} else text end as prose from x",
)
def document_prose(s, d):
    """Documents and chunks as prose, by their sniffed format."""
    x = table(s, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("id"), "text")
    y = table(s, d, "chunks").where("text is not null").select("id", "text").dropDuplicates(["id"])
    return x.unionByName(y).select("id", markup.to_prose(F.col("text")).alias("prose"))


# what may not be edited in a Markdown text, and the parts between; plain texts are one part
_SPAN = "'(?sm:^```.*?^```)|(?m:^\\|.*\\|[ \\t]*$)|`[^`]*`|\\]\\([^)]*\\)'"
_PARTS = f"""ck as (select id, any_value(text) as text from chunks where text is not null group by id), md as (select id, text, regexp_matches(text, {S.rx(P.MARKDOWN_SIGNS)}) and not regexp_matches(text, {S.rx(P.LATEX_SIGNS)}) as md from ck),
sp as (select id, text, case when md then regexp_extract_all(text, {_SPAN}) else [] end as spans, case when md then regexp_split_to_array(text, {_SPAN}) else [text] end as parts from md)"""


@query(
    "protected_spans",
    f"with {_PARTS}, ab as (select id, k, length(parts[k]) as gap, coalesce(list_sum(list_transform(parts[1:k], lambda q: length(q))), 0) + coalesce(list_sum(list_transform(spans[1:k - 1], lambda q: length(q))), 0) as a, length(spans[k]) as n from (select *, unnest(range(1, len(spans) + 1)) as k from sp where len(spans) > 0)), "
    "g as (select id, a, a + n as b, sum(case when k > 1 and gap = 0 then 0 else 1 end) over (partition by id order by k) as i from ab) select id, min(a)::int as a, max(b)::int as b from g group by id, i",
)
def protected_spans(s, d):
    x = table(s, d, "chunks").where("text is not null").select("id", "text").dropDuplicates(["id"])
    return T.exploded(x, ["id"], markup.protected_spans("text", markup.guess_format(F.col("text"))), "z").select("id", "z.a", "z.b")




def _lines_of(line: str, edit: str) -> str:
    """Over the lines x of a part q: rule lines one way, the others another."""
    return f"list_transform(string_split(q, chr(10)), lambda x: case when regexp_matches(x, {S.rx(P.RULE_LINE)}) then {line} else {edit} end)"


_EDITED = "array_to_string(" + _lines_of("x", f"regexp_replace(x, {S.rx(P.DASH_EDIT)}, ', ', 'g')") + ", chr(10))"
_EDITS = "list_sum(" + _lines_of("0", S.n_found("x", P.DASH_EDIT)) + ")"


@query(
    "dash_scalpel_markup",
    f"with {_PARTS}, ed as (select id, spans, list_transform(parts, lambda q: {_EDITED}) as parts, list_sum(list_transform(parts, lambda q: {_EDITS})) as n from sp) select id, regexp_replace(array_to_string(list_transform(range(1, len(parts) + 1), lambda k: parts[k] || coalesce(spans[k], '')), ''), ',[ \\t]*,', ',', 'g') as text, n::int as n from ed",
)
def dash_scalpel_markup(s, d):
    x = table(s, d, "chunks").where("text is not null").select("id", "text").dropDuplicates(["id"])
    return x.select("id", markup.scalpel("text", markup.guess_format(F.col("text"))).alias("z")).select("id", "z.text", "z.n")


# --- rewrites ---


def edits(s, d):
    return table(s, d, "edit_pairs").where("ai_text is not null and human_text is not null").select("id", "ai_text", "human_text").distinct()


@query(
    "rewrite_counts",
    "with e as (select distinct id, ai_text, human_text from edit_pairs where ai_text is not null and human_text is not null) select id, "
    + ", ".join(f"{S.n_found('ai_text', p)} as {k.replace(' ', '_')}_before, {S.n_found('human_text', p)} as {k.replace(' ', '_')}_after" for k, p in P.REGISTER.items())
    + f", len({S.tok('ai_text')}) as words_before, len({S.tok('human_text')}) as words_after, coalesce(len({S.tok('human_text')}) / nullif(len({S.tok('ai_text')}), 0)::double - 1 > 0.1, false) as too_long, {S.n_found('human_text', P.UNIVERSALS)} as universals_after, {S.n_found('ai_text', P.CLAIM_HEDGES)} as hedges_before from e",
)
def rewrite_counts(s, d):
    a, b = F.col("ai_text"), F.col("human_text")
    cols = []
    for k, p in P.REGISTER.items():
        k = k.replace(" ", "_")
        cols += [T.count(a, p).cast("long").alias(f"{k}_before"), T.count(b, p).cast("long").alias(f"{k}_after")]
    n0, n1 = F.size(T.tokens(a)).cast("long"), F.size(T.tokens(b)).cast("long")
    long_ = F.coalesce(F.try_divide(n1, n0) - 1 > P.MAX_GROWTH, F.lit(False))
    return edits(s, d).select("id", *cols, n0.alias("words_before"), n1.alias("words_after"), long_.alias("too_long"), T.count(b, P.UNIVERSALS).cast("long").alias("universals_after"), T.count(a, P.CLAIM_HEDGES).cast("long").alias("hedges_before"))


def _loose(t: str) -> str:
    """Token counts of the loose sentences of a text."""
    cut = f"string_split(regexp_replace({t}, {S.lit('([.!?])' + P.WS + '+')}, '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda q: len({S.tok('q')})), lambda n: n >= 2)"


def _row(axis: str, severity: str, test: str, detail: str) -> str:
    return f"case when {test} then {{'axis': '{axis}', 'severity': '{severity}', 'detail': {detail}}} end"


def _fell(new: str, old: str, tol: float) -> str:
    return f"len(sl) >= 8 and len(ol) >= 8 and {old} > 0 and {new} < {old} * (1 - {tol})"


def _both(name: str, pattern: str) -> tuple[str, str, str]:
    a, b = S.n_found("ai_text", pattern), S.n_found("human_text", pattern)
    return a, b, f"{S.lit(name)} || {a}::varchar || ' -> ' || {b}::varchar"


_LEN = f"len({S.tok('ai_text')})", f"len({S.tok('human_text')})"
_FINDINGS = [
    _row("scaffold", "hard", f"{S.n_found('human_text', P.SCAFFOLD)} > 0", f"{S.n_found('human_text', P.SCAFFOLD)}::varchar || ' artefacts'"),
    _row("house-style", "hard", "len(orr) < len(sr)", "array_to_string(list_filter(sr, lambda r: not list_contains(orr, r)), '; ')"),
    _row("rhythm", "hard", _fell("list_aggregate(ol, 'stddev_pop')", "list_aggregate(sl, 'stddev_pop')", P.SD_DROP), "'variance fell'"),
    _row("rhythm", "hard", _fell(S.share("ol", f"e >= {P.LONG_WORDS}"), S.share("sl", f"e >= {P.LONG_WORDS}"), P.TAIL_DROP), "'long sentences fell'"),
    _row("rhythm", "hard", _fell(S.share("ol", f"e < {P.SHORT_WORDS}"), S.share("sl", f"e < {P.SHORT_WORDS}"), P.TAIL_DROP), "'short sentences fell'"),
]
for _name, _pattern in P.REGISTER.items():
    _a, _b, _text = _both(f"{_name} ", _pattern)
    _FINDINGS.append(f"case when {_a} = 0 and {_b} > 0 then {{'axis': 'register', 'severity': 'hard', 'detail': {_text}}} when {_b} > greatest({_a} * {P.REGISTER_GROWTH}, {_a} + {P.REGISTER_SLACK}) then {{'axis': 'register', 'severity': 'soft', 'detail': {_text}}} end")
_GREW = f"list_filter([case when {S.n_found('human_text', P.NOT_JUST)} > {S.n_found('ai_text', P.NOT_JUST)} then 'not-just-X' end, case when {S.n_found('human_text', P.WH_CLEFT)} > {S.n_found('ai_text', P.WH_CLEFT)} then 'wh-cleft' end], lambda x: x is not null)"
_H, _U = _both("hedges ", P.CLAIM_HEDGES), _both(", universals ", P.UNIVERSALS)
_FINDINGS += [
    _row("construction", "soft", f"len({_GREW}) > 0", f"array_to_string({_GREW}, '; ')"),
    _row("claim-strength", "soft", f"{_H[1]} < {_H[0]} or {_U[1]} > {_U[0]}", f"{_H[2]} || {_U[2]}"),
    _row("length", "hard", f"{_LEN[0]} > 0 and {_LEN[1]}::double / nullif({_LEN[0]}, 0) - 1 > {P.MAX_GROWTH}", f"{_LEN[0]}::varchar || ' -> ' || {_LEN[1]}::varchar"),
]
# Pairs of plain text, as all of the tables are: the axes of headings and the prose of other formats have tests of their own.
_EDIT_FINDINGS = (
    f"ed as (select distinct id, ai_text, human_text from edit_pairs where ai_text is not null and human_text is not null), ex as (select *, {_loose('ai_text')} as sl, {_loose('human_text')} as ol, {S.found('ai_text', P.NUMERIC_RANGE)} as sr, {S.found('human_text', P.NUMERIC_RANGE)} as orr from ed), "
    f"ef as (select id, list_filter([{', '.join(_FINDINGS)}], lambda x: x is not null) as f from ex)"
)


@query(
    "rewrite_findings",
    f"with {_EDIT_FINDINGS} select id, ok, z.axis as axis, z.severity as severity, z.detail as detail from (select id, len(list_filter(f, lambda x: x.severity = 'hard')) = 0 as ok, unnest(f) as z from ef where len(f) > 0 union all select id, true, null from ef where len(f) = 0)",
)
def rewrite_findings(s, d):
    x = fidelity.with_findings(edits(s, d), "ai_text", "human_text")
    return x.select("id", (fidelity.n_of(F.col("findings"), "hard") == 0).alias("ok"), F.explode_outer("findings").alias("z")).select("id", "ok", "z.axis", "z.severity", "z.detail")


@query(
    "rewrite_report",
    f"with {_EDIT_FINDINGS} select id, len(list_filter(f, lambda x: x.severity = 'hard')) as n_hard, len(list_filter(f, lambda x: x.severity = 'soft')) as n_soft, "
    "case when len(f) = 0 then 'OK' else array_to_string(list_transform(list_concat(list_filter(f, lambda x: x.severity = 'hard'), list_filter(f, lambda x: x.severity = 'soft')), lambda x: upper(x.severity) || ' ' || x.axis || ': ' || x.detail), chr(10)) end as report from ef",
)
def rewrite_report(s, d):
    """The findings of every edit as text, hard ones first."""
    x = fidelity.with_findings(edits(s, d), "ai_text", "human_text")
    f = F.col("findings")
    return x.select("id", fidelity.n_of(f, "hard").cast("long").alias("n_hard"), fidelity.n_of(f, "soft").cast("long").alias("n_soft"), fidelity.rendered(f).alias("report"))


# what _CAND, _LOO and the calibrations say of every draft, its source being the first draft of its task
_LESS_ANY = "len(list_filter({a}, lambda x: not list_contains({b}, x))) > 0"
_VERDICT = (
    ("added_numbers", 1, "fidelity", "numbers not in the source", "src is not null and cand_idx <> 0 and " + _LESS_ANY.format(a=_num("text"), b=_num("src"))),
    ("dropped_citations", 1, "fidelity", "citations dropped", "src is not null and cand_idx <> 0 and " + _LESS_ANY.format(a=_cit("src"), b=_cit("text"))),
    ("leaks", 1, "rhetoric", "the draft talks about its task", f"{S.n_found('text', P.LEAKAGE)} > 0"),
    ("off", 2, "fingerprint", "off voice", "fit = 'off'"),
    ("presence_missing", 2, "presence", "nobody is in the draft", f"len({S.w2('text')}) >= {P.ABSENCE_WORDS} and {S.n_found('text', P.PRESENCE['epistemic'])} = 0 and {S.n_found('text', P.PRESENCE['expectation'])} = 0"),
    *((k, 3, "quality", k, v) for k, v in _QUALITY.items()),
    ("banned_words", 4, "scrub", "tell words", f"len(list_filter({_TELLS}, lambda w: list_contains({S.found('lower(text)', P.WORD_PLAIN)}, w))) > 0"),
    ("banned_phrases", 4, "scrub", "tell phrases", f"len(list_filter({_PHRASES}, lambda p: contains(lower(text), p))) > 0"),
    ("dashes", 4, "scrub", "dashes", f"{_DASHES} > 0"),
    ("flourish", 4, "rhetoric", "closing flourish", f"coalesce(list_sum(list_transform(s[greatest(len(s) - 1, 1):], lambda e: {S.n_found('e', P.FLOURISH)})), 0) > 0"),
    ("cleft_over", 4, "rhetoric", "clefts over the band", "cleft_p95 > 0 and c > cleft_p95"),
    ("antithesis_over", 4, "rhetoric", "antithesis over the band", "antithesis_p95 > 0 and a > antithesis_p95"),
    ("triad", 4, "rhetoric", "triad", f"{_TRIAD} > 0"),
    ("drifting", 5, "fingerprint", "drifting", "fit = 'drifting'"),
    ("cleft_under", 5, "rhetoric", "clefts under the band", "not coalesce(cleft_p95 > 0 and c > cleft_p95, false) and cleft_p25 > 0.05 and c < cleft_p25"),
    ("antithesis_under", 5, "rhetoric", "antithesis under the band", "not coalesce(antithesis_p95 > 0 and a > antithesis_p95, false) and antithesis_p25 > 0.05 and a < antithesis_p25"),
    ("low_burstiness", 5, "scrub", "low burstiness", "burst > 0 and burst < burstiness_floor"),
)
_RATES = f"""coalesce({S.n_found('text', P.WH_CLEFT)} * 1000.0::double / nullif(len({S.w2('text')}), 0), 0.0) as c, coalesce({S.n_found('text', P.ANTITHESIS)} * 1000.0::double / nullif(len({S.w2('text')}), 0), 0.0) as a, {S.sd(_SLEN)} as burst"""
_VERDICT_CTE = (
    f"{_LOO}, {_CAND}, {_CANDF}, cw as (select x.cand_id, x.voice, {S.rms()} as rmsz, {_WORST3} as worst from cf x join fp y using (voice)), cfit as (select cand_id, rmsz, {_fit('rmsz', 'worst')} as fit from cw join base using (voice)), "
    f"{_redundancy('c0', 'cand_id')}, {_QB}, {_RHET}, rb as (select v.voice, coalesce(cleft_p95, 2.0) as cleft_p95, coalesce(antithesis_p95, 6.0) as antithesis_p95, coalesce(cleft_p25, 0.0) as cleft_p25, coalesce(antithesis_p25, 0.0) as antithesis_p25 from (select distinct voice from r) v left join b using (voice)), "
    f"sb as (select voice, {_even('b', '0.05')} as burstiness_floor from (select voice, {S.sd('l')} as b from (select voice, {_SLEN} as l from documents where text is not null and voice is not null) where len(l) >= 3) group by voice), "
    f"first as (select task_id, min(text) as src from c0 where cand_idx = 0 group by task_id), "
    f"wide as (select c0.cand_id, c0.task_id, c0.cand_idx, c0.voice, c0.text, src, fit, cfit.rmsz as dist, ov, density, specificity, filler, density_p25, specificity_p25, cleft_p95, antithesis_p95, cleft_p25, antithesis_p25, burstiness_floor, {S.sents('c0.text')} as s, {_RATES.replace('text', 'c0.text')} from c0 left join first using (task_id) left join cfit using (cand_id) left join red using (cand_id) left join (select cand_id, {_Q} from c0) qs using (cand_id) left join qb using (voice) left join rb using (voice) left join sb using (voice)), "
    f"found as (select *, list_filter([{', '.join(f'case when {v} then {{{chr(39)}tier{chr(39)}: {t}, {chr(39)}source{chr(39)}: {S.lit(src)}, {chr(39)}message{chr(39)}: {S.lit(m)}}} end' for _, t, src, m, v in _VERDICT)}], lambda x: x is not null) as v from wide)"
)


def appraised(s, d):
    """Every draft with its findings as columns: distance and fit, rules, presence, quality, fidelity to the first draft of its task.

    Features of documents and of drafts, and the row-wise rule measures, are
    written once; calibrations are one row per voice.
    """
    c = drafts(s, d)
    t = F.col("text")
    u = calibration_units(s, d)
    base = C.baselines(C.leave_one_out(u)).drop("n_pieces")
    dist = C.with_distance(candidate_units(s, d), C.fingerprint(u)).join(base, "voice").select("cand_id", F.col("rmsz").alias("dist"), "self_baseline", "fit_threshold", C.fit_state(F.col("rmsz"), F.col("fit_threshold"), F.col("self_baseline"), C.worst_features()).alias("fit"))
    docs = rules.measured(table(s, d, "documents"))
    first = c.where("cand_idx = 0").groupBy("task_id").agg(F.min("text").alias("src"))
    f = rules.fidelity_sets(F.col("src"), t)
    rewritten = F.col("src").isNotNull() & (F.col("cand_idx") != 0)
    x = c.join(first, "task_id", "left").select(
        "cand_id", "task_id", "cand_idx", "voice", *(v.alias(k) for k, v in rules.rhetoric_columns(t).items()), *(v.alias(k) for k, v in rules.presence_columns(t).items()), *(v.alias(k) for k, v in rules.quality_columns(t).items()),
        F.size(T.words_unicode(t)).alias("n"), rules.burstiness(t).alias("burst"), rules.hedges_per_200(t).alias("hedges"), rules.plain_dashes(t).alias("dashes"), rules.banned_words(t).alias("bw"), rules.banned_phrases(t).alias("bp"),
        *(F.when(rewritten, v).otherwise(F.array().cast("array<string>")).alias(k) for k, v in f.items()),
    )
    x = x.join(rules.redundancy(c, "cand_id").select("cand_id", "redundancy"), "cand_id").join(dist, "cand_id", "left")
    x = x.join(rules.rhetoric_bands_of(docs).drop("n_pieces"), "voice", "left").join(rules.scrub_bands_of(docs).select("voice", "burstiness_floor", "hedge_ceiling"), "voice", "left").join(rules.quality_bands_of(docs).select("voice", "density_p25", "specificity_p25"), "voice", "left")
    return x


def tiers():
    """The findings of appraised() drafts in tiers."""
    band = {k: rules.band(F.col(f"{k}_rate"), F.coalesce(f"{k}_p25", F.lit(0.0)), F.coalesce(f"{k}_p95", F.lit(0.0))) for k in ("cleft", "antithesis")}
    return fidelity.verdict({
        "added_numbers": F.size("added_numbers") > 0, "dropped_citations": F.size("dropped_citations") > 0,
        "leaks": F.col("n_leaks") > 0, "off": F.col("fit") == "off", "drifting": F.col("fit") == "drifting", "presence_missing": (F.col("n") >= P.ABSENCE_WORDS) & (F.col("epistemic") == 0) & (F.col("expectation") == 0),
        "repetitive": F.col("redundancy") >= 0.6, "padded": F.col("filler") > 6, "thin": (F.col("density_p25") > 0) & (F.col("density") < F.col("density_p25")), "vague": (F.col("specificity_p25") > 0) & (F.col("specificity") < F.col("specificity_p25")),
        "banned_words": F.size("bw") > 0, "banned_phrases": F.size("bp") > 0, "dashes": F.col("dashes") > 0, "flourish": F.col("n_flourishes") > 0,
        "cleft_over": band["cleft"] == "over", "antithesis_over": band["antithesis"] == "over", "cleft_under": band["cleft"] == "under", "antithesis_under": band["antithesis"] == "under",
        "triad": F.col("n_triads") > 0, "low_burstiness": (F.col("burst") > 0) & (F.col("burst") < F.col("burstiness_floor")),
    })


@query(
    "verdict_tiers",
    f"with {_VERDICT_CTE.removeprefix('with ')}, e as (select cand_id, (select min(z.tier) from (select unnest(v) as z)) as worst, len(list_filter(v, lambda z: z.tier <= 2)) > 0 as blocks, v from found) select cand_id, worst, blocks, z.tier as tier, z.source as source, z.message as message from (select cand_id, worst, blocks, unnest(v) as z from e where len(v) > 0 union all select cand_id, worst, blocks, null from e where len(v) = 0)",
)
def verdict_tiers(s, d):
    """Findings of every draft in tiers against its voice's calibrations and the first draft of its task; all twenty can fire."""
    y = appraised(s, d).withColumn("v", tiers())
    return y.select("cand_id", fidelity.worst_tier(F.col("v")).alias("worst"), fidelity.blocks(F.col("v")).alias("blocks"), F.explode_outer("v").alias("z")).select("cand_id", "worst", "blocks", "z.tier", "z.source", "z.message")


@query("edit_segments")
def edit_segments(s, d):
    return feedback.edit_rows(edits(s, d), "id")


# --- chunking, pieces ---


# paragraphs as chunking packs them: where a run that fills the target ends, sentences of those above the cap, and the walk from run to run
_CLEAN = f"regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')"
_PACK = f"""with recursive pd as (select doc_id, list_filter(list_transform(regexp_split_to_array({_CLEAN}, {S.lit(P.PARAGRAPH_GAP)}), lambda q: {S.strip('regexp_replace(q, ' + S.lit(P.WS + '+') + ', chr(32), ' + S.lit('g') + ')')}), lambda q: len({S.tok('q')}) >= {P.PARAGRAPH_MIN}) as p from documents where text is not null),
pw as (select *, list_transform(p, lambda q: len({S.tok('q')})) as w from pd where len(p) > 0), pu as (select *, list_concat([0], list_transform(range(1, len(w) + 1), lambda i: list_sum(w[1:i])::bigint)) as u from pw),
os as (select doc_id, k, string_split(regexp_replace(p[k], {S.lit('([.!?])' + P.WS + '+')}, '\\1' || chr(1), 'g'), chr(1)) as s from (select doc_id, p, w, unnest(range(1, len(p) + 1)) as k from pw) where w[k] > {P.CHUNK_CAP}),
ou as (select *, list_concat([0], list_transform(range(1, len(s) + 1), lambda i: list_sum(list_transform(s[1:i], lambda q: len({S.tok('q')})))::bigint)) as v from os),
og(doc_id, k, a, parts) as (select doc_id, k, 0::bigint, []::varchar[] from ou union all select doc_id, k, e, list_append(parts, array_to_string(s[a + 1:e], ' ')) from (select og.doc_id, og.k, og.a, parts, s, greatest(og.a + 1, len(list_filter(v, lambda x: x <= v[og.a + 1] + {P.CHUNK_TARGET})) - 1) as e from og join ou using (doc_id, k) where og.a < len(s))),
od as (select doc_id, k, parts from og join ou using (doc_id, k) where og.a = len(s)),
pk(doc_id, pos, parts, fin) as (select doc_id, 0::bigint, []::varchar[], false from pu
  union all select doc_id, case when big then pos + 1 when small then e else greatest(e - 1, pos + 1) end, case when big then list_concat(parts, bigs) when small then list_append(parts[:len(parts) - 1], parts[len(parts)] || chr(10) || chr(10) || chunk) else list_append(parts, chunk) end, not big and not small and e = n
  from (select *, u[e + 1] - u[pos + 1] < {P.CHUNK_MIN} and len(parts) > 0 as small, array_to_string(p[pos + 1:e], chr(10) || chr(10)) as chunk from (select pk.doc_id, pk.pos, pk.parts, p, u, len(p) as n, w[pk.pos + 1] > {P.CHUNK_CAP} as big, od.parts as bigs, greatest(pk.pos + 1, len(list_filter(u, lambda x: x <= u[pk.pos + 1] + {P.CHUNK_TARGET})) - 1) as e from pk join pu using (doc_id) left join od on od.doc_id = pk.doc_id and od.k = pk.pos + 1 where not pk.fin and pk.pos < len(p)))),
pf as (select pk.doc_id, pk.parts from pk join pu using (doc_id) where pk.fin or pk.pos >= len(p))"""


@query("chunks_overlap", f"{_PACK} select printf('%s::%03d', doc_id::varchar, k) as id, doc_id::varchar as filename, k as chunk_idx, t as text, len({S.tok('t')}) as word_count from (select doc_id, unnest(range(0, len(parts))) as k, unnest(parts) as t from pf)")
def chunks_overlap(s, d):
    x = chunking.chunked(table(s, d, "documents").select("doc_id", "text"), "doc_id")
    return x.withColumns({"chunk_idx": F.col("chunk_idx").cast("long"), "word_count": F.col("word_count").cast("long")})


@query("pieces", "with c as (select id, any_value(filename) as filename, any_value(chunk_idx) as chunk_idx, any_value(text) as text from chunks where filename is not null and text is not null group by id) select filename, string_agg(text, chr(10) || chr(10) order by chunk_idx, id) as text from c group by filename")
def pieces(s, d):
    return chunking.pieces(table(s, d, "chunks"))


@query(
    "segmentation_plan",
    f"with n as (select voice, len({S.tok('text')}) as n from documents where text is not null), a as (select voice, count(*) as n_pieces, sum(n)::bigint as total_words, max(n) as longest, list_sort(list(n))[count(*) // 2 + 1] as mid from n where n > 0 group by voice) "
    f"select voice, n_pieces, total_words, n_pieces >= 3 and longest >= mid * 6.0 as lopsided, greatest(400, least(1500, total_words // 39))::int as target from a",
)
def segmentation_plan(s, d):
    return chunking.segmentation(table(s, d, "documents"), "voice", len(P.SURFACE))


# cuts of a text by the running word sums of its paragraphs, one after the other
_SEGMENTS = f"""sn as (select voice, len({S.tok('text')}) as n from documents where text is not null), sa as (select voice, greatest({P.SEGMENT_MIN}, least({P.SEGMENT_WORDS}, sum(n)::bigint // {3 * len(P.SURFACE)}))::int as target from sn where n > 0 group by voice),
st as (select doc_id, voice, text, target, list_filter(string_split(text, chr(10) || chr(10)), lambda q: {S.strip('q')} <> '') as p from documents join sa using (voice) where text is not null and voice is not null),
sw as (select *, list_transform(p, lambda q: len({S.tok('q')})) as w from st), su as (select *, list_transform(range(1, len(w) + 1), lambda i: coalesce(list_sum(w[1:i]), 0)) as upto from sw),
sc(doc_id, a, b, seg) as (select doc_id, 0::bigint, 0::bigint, -1::bigint from su where len({S.tok('text')}) > target
  union all select doc_id, a2, b2, seg + 1 from (select su.doc_id, sc.b as a2, seg, coalesce((list_filter(range(sc.b + 1, len(upto) + 1), lambda j: upto[j] - case when sc.b > 0 then upto[sc.b] else 0 end >= target))[1],
    case when upto[len(upto)] - case when sc.b > 0 then upto[sc.b] else 0 end >= target // 3 then len(upto) end) as b2 from sc join su using (doc_id) where sc.b < len(upto)) where b2 is not null and b2 > a2),
sg as (select doc_id, voice, 0::bigint as seg, text from su where len({S.tok('text')}) <= target union all select doc_id, voice, seg, array_to_string(p[a + 1:b], chr(10) || chr(10)) from sc join su using (doc_id) where seg >= 0)"""


@query("calibration_segments", f"with recursive {_SEGMENTS} select doc_id, voice, seg, len({S.tok('text')}) as words, md5(text) as text_md5 from sg")
def calibration_segments(s, d):
    """Documents' pieces cut where their voice's lengths are lopsided or few."""
    docs = table(s, d, "documents").where("text is not null and voice is not null").select("doc_id", "voice", "text")
    p = chunking.segmentation(docs, "voice", len(P.SURFACE))
    x = T.exploded(docs.join(p.select("voice", "target"), "voice"), ["doc_id", "voice"], chunking.segment_udf("text", "target"), "text", "seg")
    return x.select("doc_id", "voice", F.col("seg").cast("long").alias("seg"), F.size(T.tokens(F.col("text"))).alias("words"), F.md5("text").alias("text_md5"))


@query("paragraphs", f"with p as (select doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), {S.lit(P.PARAGRAPH_GAP)}), lambda q: {S.strip('regexp_replace(q, ' + S.lit(P.WS + '+') + ', chr(32), ' + S.lit('g') + ')')}), lambda q: len({S.tok('q')}) >= 8) as p from documents where text is not null) select doc_id, unnest(range(0, len(p))) as idx, unnest(p) as paragraph from p")
def paragraphs(s, d):
    x = T.exploded(table(s, d, "documents").where("text is not null"), ["doc_id"], chunking.paragraphs_of(F.col("text")), "paragraph", "idx")
    return x.select("doc_id", F.col("idx").cast("long").alias("idx"), "paragraph")


@query("openings", f"with x as (select doc_id, coalesce({S.sents('text')}[1], '') as f from documents where text is not null) select doc_id, array_to_string({S.tok('f')}[1:15], ' ') as opening from x")
def openings(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", chunking.opening(F.col("text")).alias("opening"))


@query("off_voice_state", f"{_LOO}, dw as (select x.doc_id, x.voice, {S.rms()} as rmsz, {_WORST3} as worst from u x join fp y using (voice)) select doc_id, {_fit('rmsz', 'worst')} as state from dw join base using (voice)")
def off_voice_state(s, d):
    x = doc_fit(s, d)
    return x.select("doc_id", C.fit_state(F.col("rmsz"), F.col("fit_threshold"), F.col("self_baseline"), C.worst_features()).alias("state"))
