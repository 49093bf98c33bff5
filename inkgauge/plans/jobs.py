"""Queries: pipelines over drafts and voices, evaluation jobs, audits, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkgauge.functions import patterns as P
from inkgauge.functions import textkit as T
from inkgauge.operators import blend, chunking, evalstats, gate, pipelines, rules
from inkgauge.operators import calibrate as C
from inkgauge.operators import features as X
from inkgauge.plans import checks as K
from inkgauge.plans import selection as L
from inkgauge.plans import sqlkit as S
from inkgauge.plans import style as Y
from inkgauge.plans.registry import query
from inkgauge.session import checkpointed, table
from inkgauge.sources import io

R = T.rounded
_NL = "chr(10)"

# --- reports ---

_CEIL = f"hc as (select voice, {K._even('h', '0.95')} as hedge_ceiling from (select voice, h * 200.0::double / list_sum(l) as h from (select voice, {K._SLEN} as l, {S.n_found('text', P.HEDGES_SOFT)} as h from documents where text is not null and voice is not null) where len(l) >= 3) group by voice)"
_HEDGES = f"coalesce({S.n_found('text', P.HEDGES_SOFT)} * 200.0::double / nullif(len({S.w2('text')}), 0), 0.0)"
_TIER_LINES = "list_transform(v, lambda z: case when z.tier <= 2 then 'HIGH ' when z.tier <= 4 then 'MEDIUM ' else 'LOW ' end || z.source || ': ' || z.message)"


def _tier(test: str) -> str:
    return f"len(list_filter(v, lambda z: {test}))"


@query(
    "appraisal_reports",
    f"{K._VERDICT_CTE}, {_CEIL} select cand_id, {_tier('z.tier <= 2')} as n_blocking, len(v) as n_findings, {_tier('z.source in (' + S.lit('scrub') + ', ' + S.lit('fidelity') + ') and z.tier <= 4')} = 0 as is_clean, {_tier('z.source = ' + S.lit('rhetoric') + ' and z.tier >= 4')} > 0 as rhetoric_advisory, {_tier('z.source = ' + S.lit('presence'))} > 0 as presence_missing, "
    f"coalesce({_HEDGES} > hedge_ceiling, false) as hedging, case when len(v) = 0 then 'CLEAN' else array_to_string({_TIER_LINES}, {_NL}) end as report from found left join hc using (voice)",
)
def appraisal_reports(s, d):
    """Every draft's findings put together: counts, roll-ups and lines by weight."""
    x = K.appraised(s, d).withColumn("v", K.tiers())
    v = F.col("v")
    n = lambda test: F.size(F.filter(v, test)).cast("long")
    weight = lambda z: F.when(z["tier"] <= 2, "HIGH ").when(z["tier"] <= 4, "MEDIUM ").otherwise("LOW ")
    lines = F.transform(v, lambda z: F.concat(weight(z), z["source"], F.lit(": "), z["message"]))
    return x.select(
        "cand_id", n(lambda z: z["tier"] <= 2).alias("n_blocking"), F.size(v).cast("long").alias("n_findings"), (n(lambda z: z["source"].isin("scrub", "fidelity") & (z["tier"] <= 4)) == 0).alias("is_clean"),
        (n(lambda z: (z["source"] == "rhetoric") & (z["tier"] >= 4)) > 0).alias("rhetoric_advisory"), (n(lambda z: z["source"] == "presence") > 0).alias("presence_missing"),
        F.coalesce(F.col("hedges") > F.col("hedge_ceiling"), F.lit(False)).alias("hedging"), F.when(F.size(v) > 0, F.array_join(lines, "\n")).otherwise("CLEAN").alias("report"),
    )


# --- composing: scalpel, distance, flags, fidelity, gate, choice ---

_SCALPEL = f"regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: case when regexp_matches(x, {S.rx(P.RULE_LINE)}) then x else regexp_replace(x, {S.rx(P.DASH_EDIT)}, ', ', 'g') end), chr(10)), ',[ \\t]*,', ',', 'g')"
_FID_NUM = f"src is not null and (len(list_filter({K._num('src')}, lambda x: not list_contains({K._num('text')}, x))) > 0 or len(list_filter({K._num('text')}, lambda x: not list_contains({K._num('src')}, x))) > 0)"
_FID_CIT = f"src is not null and len(list_filter({K._cit('src')}, lambda x: not list_contains({K._cit('text')}, x))) > 0"
_COMPOSE = (
    f"{Y._LOO}, {Y._CAND}, first as (select task_id, min(text) as src from c0 where cand_idx = 0 group by task_id), "
    f"fx as (select cand_id, task_id, cand_idx, voice, {K._DASHES} as n_fixed, {_SCALPEL} as text, case when cand_idx <> 0 then src end as src from c0 left join first using (task_id)), {S.feature_cte('fx', 'cand_id', 'voice', name='ff')}, "
    f"fd as (select x.cand_id, {S.rms()} as rmsz from ff x join fp y using (voice)), "
    f"fl as (select cand_id, {L._FLAGS} as plain_flags, case when {_FID_NUM} then 1 else 0 end + case when {_FID_CIT} then 1 else 0 end as n_fidelity from fx), "
    "sd as (select fx.cand_id, fx.task_id, fx.cand_idx, fx.voice, n_fixed, rmsz, self_baseline, coalesce(p.max_rmsz, case when fit_threshold > 0 then fit_threshold else self_baseline * 1.6 end) as lim, plain_flags + n_fidelity as n_flags, n_fidelity, round(case when coalesce(self_baseline, 0) > 0 then abs(rmsz - self_baseline) else rmsz end, 9) as aim "
    "from fx left join fd using (cand_id) join fl using (cand_id) left join base using (voice) left join profiles p on p.slug = fx.voice), "
    "ok as (select * from sd where rmsz <= lim and n_fidelity = 0), fr as (select * from ok a where not exists (select 1 from ok b where b.task_id = a.task_id and b.rmsz <= a.rmsz and b.n_flags <= a.n_flags and (b.rmsz < a.rmsz or b.n_flags < a.n_flags))), "
    "pf as (select task_id, cand_id, 'front' as route from (select *, row_number() over (partition by task_id order by aim, cand_idx) as rn from fr) where rn = 1), "
    "lb as (select task_id, cand_id, 'fallback' as route from (select *, row_number() over (partition by task_id order by n_fidelity, aim nulls last, cand_idx) as rn from sd where task_id not in (select task_id from pf)) where rn = 1), "
    "ch as (select * from pf union all select * from lb)"
)


def scored(s, d):
    """Drafts through the chain, each verified against the first draft of its task."""
    c = K.drafts(s, d)
    first = c.where("cand_idx = 0").groupBy("task_id").agg(F.min("text").alias("src"))
    x = c.join(first, "task_id", "left").withColumn("source", F.when(F.col("cand_idx") != 0, F.col("src"))).drop("src")
    return checkpointed(pipelines.scored_drafts(x, Y.calibration_units(s, d), table(s, d, "profiles")))


@query("draft_scores", f"{_COMPOSE} select cand_id, n_fixed, {S.r6('rmsz')} as rmsz, {S.r6('lim')} as gate_limit, n_flags, n_fidelity, coalesce(rmsz <= lim and n_fidelity = 0, false) as passes from sd")
def draft_scores(s, d):
    """Every draft after the scalpel: distance, limit, flags, and whether it passes the gate with its fidelity."""
    ok = F.coalesce((F.col("rmsz") <= F.col("limit")) & F.col("fidelity_ok"), F.lit(False))
    return scored(s, d).select("cand_id", F.col("n_fixed").cast("long").alias("n_fixed"), R(F.col("rmsz")).alias("rmsz"), R(F.col("limit")).alias("gate_limit"), F.col("n_flags").cast("long").alias("n_flags"), F.col("n_fidelity").cast("long").alias("n_fidelity"), ok.alias("passes"))


@query("compose_choice", f"{_COMPOSE} select ch.task_id, cand_id, route, coalesce(n, 0) as n_survivors from ch left join (select task_id, count(*) as n from ok group by task_id) n on n.task_id = ch.task_id")
def compose_choice(s, d):
    """The draft each task ends with: chain, gate with fidelity, Pareto front, target band, else the least bad."""
    return pipelines.chosen(scored(s, d))


@query(
    "rewrite_rounds",
    f"{_COMPOSE}, rr as (select task_id, cand_id, coalesce(rmsz <= lim and n_fidelity = 0, false) as pass, row_number() over (partition by task_id order by cand_idx, cand_id) as rnd from sd), r3 as (select * from rr where rnd <= 3), "
    "a as (select task_id, min(rnd) filter (where pass) as f, max(rnd) as l from r3 group by task_id) select a.task_id, coalesce(f, l) as rounds, f is not null as passed, cand_id from a join r3 on r3.task_id = a.task_id and r3.rnd = coalesce(f, l)",
)
def rewrite_rounds(s, d):
    """How many attempts each task takes until a draft passes the gate, of three at most."""
    x = pipelines.rewrite_rounds(scored(s, d))
    return x.withColumn("rounds", F.col("rounds").cast("long"))


@query(
    "selection_ab",
    f"{_COMPOSE}, ab as (select voice, 'chosen' as arm, abs(rmsz - self_baseline) as dev from sd join ch using (task_id, cand_id) where rmsz is not null and self_baseline is not null union all select voice, 'first', abs(rmsz - self_baseline) from sd where cand_idx = 0 and rmsz is not null and self_baseline is not null) "
    f"select voice, arm, count(*) as n, {S.r6('avg(dev)')} as mean_abs_dev from ab group by voice, arm",
)
def selection_ab(s, d):
    """Per voice: how far chosen drafts and first drafts are from the voice's own baseline."""
    x = scored(s, d)
    dev = F.abs(F.col("rmsz") - F.col("self_baseline")).alias("dev")
    a = x.join(pipelines.chosen(x).select("task_id", "cand_id"), ["task_id", "cand_id"]).select("voice", F.lit("chosen").alias("arm"), dev)
    b = x.where("cand_idx = 0").select("voice", F.lit("first").alias("arm"), dev)
    return a.unionByName(b).where("dev is not null").groupBy("voice", "arm").agg(F.count("*").alias("n"), R(F.avg("dev")).alias("mean_abs_dev"))


# --- retrieval ---


def _hybrid(s, d, **options):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    q = table(s, d, "briefs").select(F.col("id").alias("query_id"), F.col("task").alias("text"))
    return pipelines.hybrid(docs, q, 3, **options).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


_VECTORS = f"{S.encoded_cte('documents', 'doc_id', 'text', 'ed')}, {S.encoded_cte('briefs', 'id', 'task', 'eb')}, {S.encoded_sims('eb', 'id', 'ed', 'doc_id', 'sm')}, vr as (select qa as query_id, qb as id, row_number() over (partition by qa order by round(sim, 9) desc, qb) as rank from sm)"


@query(
    "hybrid_retrieval",
    f"{L._BM25}, {_VECTORS}, u2 as (select query_id, id, 1.0::double / (60 + rank) as s, 0 as l, rank as r from vr where rank <= 27 union all select query_id, id, 1.0::double / (60 + rank), 1, rank from kw where rank <= 27), "
    "f2 as (select query_id, id, sum(s) as rrf, min(l * 1000 + r) as o from u2 group by all), g2 as (select *, row_number() over (partition by query_id order by round(rrf, 12) desc, o, id) as rank from f2) select query_id, id, rank from g2 where rank <= 3",
)
def hybrid_retrieval(s, d):
    """Three anchors per brief: wide recall by vector and keyword, fused."""
    return _hybrid(s, d)


@query("vector_retrieval", f"with {_VECTORS} select query_id, id, rank from vr where rank <= 3")
def vector_retrieval(s, d):
    """The same without the keyword side."""
    return _hybrid(s, d, keyword=False)


@query("diverse_retrieval")
def diverse_retrieval(s, d):
    """The same, diversified from three times as many."""
    return _hybrid(s, d, diversify=True)


# --- calibration ---

_NEED = f"""need as (select voice, (n_pieces >= 3 and longest >= mid * 6.0) or n_pieces < {3 * len(P.SURFACE)} as need from (select voice, count(*) as n_pieces, max(n) as longest, list_sort(list(n))[count(*) // 2 + 1] as mid from sn where n > 0 group by voice))"""
_PIPE = f"with recursive {K._SEGMENTS}, {_NEED}, pu as (select doc_id, voice, seg, text from sg join need using (voice) where need union all select doc_id, voice, 0, text from documents join need using (voice) where not need and text is not null), px as (select doc_id::varchar || '/' || seg::varchar as unit, voice, text from pu), {S.feature_cte('px', 'unit', 'voice')}, {S.fingerprint_cte()}"


def segmented_units(s, d):
    """Features of the calibration units of every voice, cut where its pieces are lopsided or few."""
    t = pipelines.calibration_texts(table(s, d, "documents"), "doc_id")
    x = t.select(F.concat_ws("/", F.col("doc_id").cast("string"), F.col("seg").cast("string")).alias("unit"), "voice", "text")
    return checkpointed(C.usable(X.with_features(x).drop("text")))


@query(
    "calibration_pipeline",
    f"{_PIPE}, rest as (select a.unit, a.voice, {', '.join(f'avg(b.{f}) as {f}_m, coalesce(stddev_samp(b.{f}), 0.0) as {f}_s' for f in P.SURFACE)} from u a join u b on a.voice = b.voice and a.unit <> b.unit where a.voice in (select voice from fp) group by all), loo as (select x.unit, x.voice, {S.rms('x', 'y')} as loo from u x join rest y using (unit, voice)) "
    f"select voice, count(*) as n_units, {S.r6('avg(loo)')} as self_baseline, {S.r6('quantile_cont(loo, 0.95)')} as fit_threshold, case when count(*) < 13 then 'very thin' when count(*) < 39 then 'thin' else 'ok' end as confidence from loo group by voice",
)
def calibration_pipeline(s, d):
    """From a voice's documents to its calibration: segments where needed, features, leave-one-out, threshold, confidence."""
    x = C.baselines(C.leave_one_out(segmented_units(s, d)))
    return x.select("voice", F.col("n_pieces").alias("n_units"), R(F.col("self_baseline")).alias("self_baseline"), R(F.col("fit_threshold")).alias("fit_threshold"), C.confidence(F.col("n_pieces"), len(P.SURFACE)).alias("confidence"))


@query(
    "segmented_fingerprint",
    f"{_PIPE}, l as (" + " union all ".join(f"select voice, n_pieces, '{f}' as feature, {f}_m as m, {f}_s as sd from fp" for f in P.SURFACE) + f") select voice, n_pieces, feature, {S.r6('m')} as mean, {S.r6('sd')} as std from l",
)
def segmented_fingerprint(s, d):
    return C.fingerprint_long(C.fingerprint(segmented_units(s, d))).select("voice", "n_pieces", "feature", R(F.col("mean")).alias("mean"), R(F.col("std")).alias("std"))


@query("threshold_backfill", f"{Y._LOO} select slug, {S.r6('coalesce(p.max_rmsz, b.fit_threshold)')} as max_rmsz, p.max_rmsz is null and b.fit_threshold is not null as filled from profiles p left join base b on b.voice = p.slug")
def threshold_backfill(s, d):
    """Profiles without a limit get their voice's 95th percentile; nothing else is recomputed."""
    base = C.baselines(C.leave_one_out(Y.calibration_units(s, d))).select(F.col("voice").alias("slug"), "fit_threshold")
    p = table(s, d, "profiles").join(base, "slug", "left")
    return p.select("slug", R(F.coalesce("max_rmsz", "fit_threshold")).alias("max_rmsz"), (F.col("max_rmsz").isNull() & F.col("fit_threshold").isNotNull()).alias("filled"))


# --- composites in full ---

EXPLICIT = ("robust", "silent")  # words an author asks to keep
_USES = f"us as (select voice, word, count(*) as uses from (select voice, unnest({S.w2('lower(text)')}) as word, len({K._SLEN}) as k from documents where text is not null and voice is not null) where k >= 3 group by all)"
_LISTED = "(values " + ", ".join(f"({S.lit(w)})" for w in dict.fromkeys(K._WORDS_TESTED + EXPLICIT)) + ") v(word)"
_KEPT = f"{_USES}, wl as (select a.voice, v.word, v.word in ({', '.join(S.lit(w) for w in EXPLICIT)}) or coalesce(uses, 0) >= 3 as kept from (select distinct voice from documents where voice is not null and text is not null) a cross join {_LISTED} left join us on us.voice = a.voice and us.word = v.word)"


def word_lists(s, d):
    u = rules.word_usage(table(s, d, "documents"), K._WORDS_TESTED + EXPLICIT)
    return pipelines.kept_and_banned(u, K._WORDS_TESTED, EXPLICIT)


@query("kept_words", f"with {_KEPT} select voice, word, kept from wl")
def kept_words(s, d):
    """Every listed word of every voice: kept (used three times, or asked for) or banned."""
    return word_lists(s, d)


def _shares(s, d):
    return blend.shares(blend.usable_parts(table(s, d, "profiles")), L._doc_counts(s, d))


@query("composite_words", f"{Y._FP}, {L._SHARES}, {_KEPT} select slug, word, not bool_or(kept) as banned from sh join wl on wl.voice = sh.source group by slug, word")
def composite_words(s, d):
    """Composites: banned where every part bans, kept where one keeps."""
    return pipelines.blended_words(word_lists(s, d), _shares(s, d))


_POOLED = f"pl as (select slug as voice, text from documents join sh on sh.source = documents.voice where text is not null)"
_POOLR = K._RHET.replace("from documents where text is not null and voice is not null", "from pl")


@query(
    "composite_bands",
    f"{Y._FP}, {L._SHARES}, {_POOLED}, {_POOLR}, pq as (select voice, count(*) as n_pieces, {K._floor('density', '0.25')} as density_p25, {K._floor('specificity', '0.25')} as specificity_p25 from (select voice, {K._Q} from pl where len({S.w1('text')}) >= 200) group by voice having count(*) >= 5) "
    f"select v.voice as slug, coalesce(b.n_pieces, 0) as n_long, {S.r6('coalesce(cleft_p95, 2.0)')} as cleft_p95, {S.r6('coalesce(antithesis_p95, 6.0)')} as antithesis_p95, {S.r6('density_p25')} as density_p25, {S.r6('specificity_p25')} as specificity_p25 from (select distinct voice from r) v left join b using (voice) left join pq using (voice)",
)
def composite_bands(s, d):
    """Rhetoric and quality bands of composites over the texts of all their parts together."""
    sh = _shares(s, d)
    docs = table(s, d, "documents").where("text is not null").select(F.col("voice").alias("source"), "text").join(sh.select("slug", "source"), "source")
    m = rules.measured(docs, by="slug")
    x = rules.rhetoric_bands_of(m, by="slug").join(rules.quality_bands_of(m, by="slug").select("slug", "density_p25", "specificity_p25"), "slug", "left")
    return x.select("slug", F.col("n_pieces").alias("n_long"), *(R(F.col(k)).alias(k) for k in ("cleft_p95", "antithesis_p95", "density_p25", "specificity_p25")))


@query("composite_summary", f"{Y._FP}, {L._SHARES} select slug, count(*) as n_sources, sum(n)::bigint as n_pieces, string_agg(source || ' ' || round_even(share * 100, 0)::int::varchar || '%', ', ' order by share desc, source) as parts from sh group by slug")
def composite_summary(s, d):
    """Composites in words: their parts by share."""
    x = _shares(s, d)
    rows = F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("o"), "source", F.concat("source", F.lit(" "), F.bround(F.col("share") * 100, 0).cast("int").cast("string"), F.lit("%")).alias("t"))))
    return x.groupBy("slug").agg(F.count("*").alias("n_sources"), F.sum("n").alias("n_pieces"), F.array_join(F.transform(rows, lambda r: r["t"]), ", ").alias("parts"))


# --- evaluation ---

_ARMS = f"{Y._FP}, {Y._CAND}, {Y._CANDF}, ad as (select x.task_id, x.cand_id, x.cand_idx, x.voice, {S.rms()} as rmsz from cf x join fp y using (voice)), pd as (select a.voice, a.task_id, a.rmsz as a, b.rmsz as b from ad a join ad b on a.task_id = b.task_id and a.cand_idx = 0 and b.cand_idx = 1)"
_SIGN = "least(1.0, 2 * list_sum(list_transform(range(0, (least(w, n - w) + 1)::bigint), lambda k: exp(lgamma((n + 1)::double) - lgamma((k + 1)::double) - lgamma((n - k + 1)::double) - n * ln(2)))))"
_PAIRED = f"{_ARMS}, pg as (select voice, count(*) as n, count_if(b - a < 0)::bigint as w, avg(a) as ma, avg(b) as mb from pd group by voice), pp as (select *, {_SIGN} as p from pg)"


def paired(s, d):
    z = C.with_distance(Y.candidate_units(s, d), C.fingerprint(Y.calibration_units(s, d)))
    a = z.where("cand_idx = 0").select("task_id", "voice", F.col("rmsz").alias("a"))
    b = z.where("cand_idx = 1").select("task_id", F.col("rmsz").alias("b"))
    x = a.join(b, "task_id").withColumn("delta", F.col("b") - F.col("a"))
    t = evalstats.sign_test(x, ["voice"])
    return t.join(x.groupBy("voice").agg(F.avg("a").alias("ma"), F.avg("b").alias("mb")), "voice")


@query("paired_arms", f"{_PAIRED} select voice, n, w as improved, {S.r6('ma')} as first_arm, {S.r6('mb')} as second_arm, {S.r6('mb - ma')} as delta, {S.r6('p')} as p from pp")
def paired_arms(s, d):
    """First against second drafts of the same tasks on the voice's ruler, with the sign test."""
    return paired(s, d).select("voice", "n", "improved", R(F.col("ma")).alias("first_arm"), R(F.col("mb")).alias("second_arm"), R(F.col("mb") - F.col("ma")).alias("delta"), R(F.col("p")).alias("p"))


_VERDICT = "case when n < 6 then 'too few pairs to tell' when p < 0.05 and w * 2 > n then 'better' when p < 0.05 then 'worse' else 'no difference shown' end"


@query("campaign_report", f"{_PAIRED} select voice, '| ' || voice || ' | ' || w::varchar || '/' || n::varchar || ' | ' || round_even(p * 10000, 0)::int::varchar || ' | ' || {_VERDICT} || ' |' as line from pp")
def campaign_report(s, d):
    """The paired arms as lines of a table: wins, p in ten thousandths, what can be said at this size."""
    p = F.col("p")
    verdict = F.when(F.col("n") < 6, "too few pairs to tell").when((p < 0.05) & (F.col("improved") * 2 > F.col("n")), "better").when(p < 0.05, "worse").otherwise("no difference shown")
    return paired(s, d).select("voice", F.concat(F.lit("| "), "voice", F.lit(" | "), F.col("improved").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" | "), F.bround(p * 10000, 0).cast("int").cast("string"), F.lit(" | "), verdict, F.lit(" |")).alias("line"))


@query(
    "fool_rates",
    f"{Y._LOO}, {L._ONE}, {L._THRESHOLDS}, tk as (select cand_id, max(coalesce(len({S.tok('text')}), 0)) as n from candidates group by cand_id), "
    f"fo as (select one.voice, one.rmsz, case when n < 48 or detector_score is null or threshold is null then 'uncertain' when case when low_is_machine then detector_score < threshold else detector_score > threshold end then 'machine' else 'human' end as label from one join tk using (cand_id) left join dt using (voice) where emdash_fixed > 0 and voice is not null), "
    f"fa as (select voice, count(*) as n, count_if(label = 'human')::bigint as fooled, avg(rmsz) as mean_rmsz from fo group by voice) select fa.voice, n, fooled, {S.r6('fooled / n::double')} as fool_rate, {S.r6('mean_rmsz / nullif(self_baseline, 0)')} as ratio, coalesce(mean_rmsz <= 2 * self_baseline, false) as passes from fa left join base using (voice)",
)
def fool_rates(s, d):
    """Per voice: the share of machine-made drafts taken for a human's, and their distance over the voice's own (bar: twice)."""
    x = L.scored(s, d)
    label = L.detector_labels(s, d)
    base = C.baselines(C.leave_one_out(Y.calibration_units(s, d))).select("voice", "self_baseline")
    a = x.where("machine and voice is not null").join(label, "cand_id").groupBy("voice").agg(F.count("*").alias("n"), F.sum(F.when(F.col("label") == "human", 1).otherwise(0)).alias("fooled"), F.avg("rmsz").alias("m"))
    b = F.col("self_baseline")
    return a.join(base, "voice", "left").select("voice", "n", "fooled", R(F.col("fooled") / F.col("n")).alias("fool_rate"), R(F.try_divide("m", b)).alias("ratio"), F.coalesce(F.col("m") <= b * 2, F.lit(False)).alias("passes"))


_TRAIN = "strpos('0123456789abcdef', substr(md5(doc_id::varchar), 1, 1)) <= 11"


@query(
    "split_ab",
    f"with {Y._CUTS}, tr as (select * from uc where {_TRAIN}), te as (select * from uc where not ({_TRAIN})), tf as (select voice, count(*) as n_pieces, {', '.join(f'avg({f}) as {f}_m, coalesce(stddev_samp({f}), 0.0) as {f}_s' for f in Y._EVERY)} from tr group by voice having count(*) >= {P.MIN_PIECES}), "
    + ", ".join(f"own_{k} as (select x.voice, avg({Y._rms(fs)}) as own from tr x join tf y using (voice) group by x.voice), out_{k} as (select x.voice, count(*) as n, avg({Y._rms(fs)}) as held, avg(case when {Y._rms(fs)} > own * 1.6 then 1.0 else 0.0 end) as flagged from te x join tf y using (voice) join own_{k} using (voice) group by x.voice)" for k, fs in (("surface", P.SURFACE), ("all", Y._EVERY)))
    + " "
    + " union all ".join(f"select voice, '{k}' as features, n, {S.r6('held')} as held_out, {S.r6('flagged')} as flagged from out_{k}" for k in ("surface", "all")),
)
def split_ab(s, d):
    """Calibrated on eleven of sixteen documents (by md5), the rest held out: distances and flag rates with and without cadence."""
    u = checkpointed(C.usable(Y.cadence_fit(s, d)))
    train = F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1)) <= 11
    tr, te = u.where(train), u.where(~train)
    out = None
    for name, fs in (("surface", P.SURFACE), ("all", P.SURFACE + P.CADENCE)):
        fp = C.fingerprint(tr, fs)
        own = C.with_distance(tr, fp, fs).groupBy("voice").agg(F.avg("rmsz").alias("own"))
        x = C.with_distance(te, fp, fs).join(own, "voice").groupBy("voice").agg(F.count("*").alias("n"), R(F.avg("rmsz")).alias("held_out"), R(F.avg((F.col("rmsz") > F.col("own") * P.FIT_RATIO).cast("double"))).alias("flagged"))
        y = x.select("voice", F.lit(name).alias("features"), "n", "held_out", "flagged")
        out = y if out is None else out.unionByName(y)
    return out


_CANDC = f"cc as (select c0.*, lo, hi from c0 join cut using (voice)), {Y.cadence_cte('cc', 'cand_id', 'ck', 'lo', 'hi')}, cq as (select ck.*, cc.voice, cc.cand_idx from ck join cc using (cand_id)), cx as (select x.cand_id, x.voice, x.cand_idx, {Y._rms(P.CADENCE)} as dist, {', '.join(f'abs({S.z(f)}) as {f}' for f in P.CADENCE)} from cq x join fc y using (voice))"


@query(
    "config_audit",
    f"with {Y._CUTS}, {Y._CAND}, {_CANDC}, hu as (select x.voice, round({Y._rms(P.CADENCE)}, 9) as dist from uc x join fc y using (voice)), ci as (select voice, cand_idx, count(*) as n, avg(dist) as dist from cx group by all), "
    "au as (select cx.voice, cand_idx, sum(case when hu.dist < round(cx.dist, 9) then 1.0 when hu.dist = round(cx.dist, 9) then 0.5 else 0.0 end) / count(*) as auc from cx join hu on hu.voice = cx.voice group by all), "
    "lz as (" + " union all ".join(f"select voice, cand_idx, '{f}' as feature, {i} as idx, avg({f}) as az from cx group by all" for i, f in enumerate(P.CADENCE)) + "), "
    "wz as (select voice, cand_idx, string_agg(feature, '|' order by round(az, 9) desc, idx) as worst from (select *, row_number() over (partition by voice, cand_idx order by round(az, 9) desc, idx) as rn from lz) where rn <= 5 group by all) "
    f"select voice, cand_idx, n, {S.r6('dist')} as mean_cadence, {S.r6('auc')} as auroc, worst from ci join au using (voice, cand_idx) join wz using (voice, cand_idx)",
)
def config_audit(s, d):
    """Per voice and draft number: cadence distance, how well it tells drafts from the voice's documents, the five features furthest off."""
    u = checkpointed(C.usable(Y.cadence_fit(s, d)))
    fp = C.fingerprint(u, P.CADENCE)
    cuts = u.select("voice", "lo", "hi").distinct()
    c = K.drafts(s, d).join(cuts, "voice")
    z = checkpointed(C.with_distance(X.with_features(c, cadence=True, lo=F.col("lo"), hi=F.col("hi")).drop("text"), fp, P.CADENCE))
    keys = ["voice", "cand_idx"]
    # distances counted by value first; the documents' stand beside each draft number of their voice (as many as a slate has drafts)
    human = C.with_distance(u, fp, P.CADENCE).groupBy("voice", F.round("rmsz", 9).alias("rmsz")).agg(F.count("*").alias("p")).join(z.select(*keys).distinct(), "voice")
    drafts = z.groupBy(*keys, F.round("rmsz", 9).alias("rmsz")).agg(F.count("*").alias("q"))
    zero = F.lit(0).cast("long")
    auc = evalstats.auroc_of_counts(human.select(*keys, "rmsz", "p", zero.alias("q")).unionByName(drafts.select(*keys, "rmsz", zero.alias("p"), "q")), keys, "rmsz")
    means = z.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("rmsz").alias("dist"), *(F.round(F.avg(F.abs(f"{f}__z")), 9).alias(f) for f in P.CADENCE))
    worst = F.slice(F.array_sort(F.array(*(F.struct((-F.col(f)).alias("d"), F.lit(i).alias("i"), F.lit(f).alias("f")) for i, f in enumerate(P.CADENCE)))), 1, 5)
    return means.join(auc, keys).select(*keys, "n", R(F.col("dist")).alias("mean_cadence"), R(F.col("auroc")).alias("auroc"), F.array_join(F.transform(worst, lambda r: r["f"]), "|").alias("worst"))


_DIST_OF = "select x.doc_id, x.voice, {r} as dist from (select f.*, {c} from f_{h} f join k_{h} k using (doc_id) where n_words >= {m}) x join fb y using (voice)"


def _order_dist(h: str, fs) -> str:
    return _DIST_OF.format(r=f"round({Y._rms(fs)}, 9)", c=", ".join("k." + f for f in P.CADENCE), h=h, m=P.MIN_PIECE_WORDS)


@query(
    "order_auroc",
    f"with {', '.join(Y._PROBE)}, " + ", ".join(f"{n}_{h} as ({_order_dist(h, fs)})" for n, fs in (("surface", P.SURFACE), ("cadence", P.CADENCE)) for h in ("control", "ramp"))
    + " " + " union all ".join(f"select a.voice, '{n}' as features, {S.r6('sum(case when a.dist < b.dist then 1.0 when a.dist = b.dist then 0.5 else 0.0 end) / count(*)')} as auroc from {n}_control a join {n}_ramp b on a.voice = b.voice group by a.voice" for n in ("surface", "cadence")),
)
def order_auroc(s, d):
    """Per voice: how well surface and cadence distances tell documents from the same documents with sentences by length."""
    docs = table(s, d, "documents").where("text is not null and voice is not null").select("doc_id", "voice", "text")
    u = checkpointed(C.usable(X.with_features(docs, cadence=True)).drop("text"))
    out = None
    both = None
    for how in ("control", "ramp"):
        x = X.with_features(docs.withColumn("text", chunking.perturbed(T.sentences(F.col("text")), how)), cadence=True)
        x = checkpointed(C.usable(x).drop("text")).withColumn("real", F.lit(how == "control"))
        both = x if both is None else both.unionByName(x)
    for name, fs in (("surface", P.SURFACE), ("cadence", P.CADENCE)):
        z = C.with_distance(both, C.fingerprint(u, fs), fs).select("voice", "real", F.round("rmsz", 9).alias("rmsz"))
        y = evalstats.auroc(z, "real", "rmsz", "voice").select("voice", F.lit(name).alias("features"), R(F.col("auroc")).alias("auroc"))
        out = y if out is None else out.unionByName(y)
    return out


# --- audits ---


@query(
    "portability_audit",
    f"{Y._LOO}, us0 as (select voice, count(*) as n from u group by voice) select slug, coalesce(us0.n, 0) as n_pieces, array_to_string(list_filter([case when coalesce(us0.n, 0) = 0 then 'empty' end, case when us0.n < 3 * {len(P.SURFACE)} then 'thin' end, case when p.max_rmsz < b.self_baseline then 'gate below baseline' end, case when p.max_rmsz is not null then 'gate hard-coded' end], lambda x: x is not null), '|') as problems from profiles p left join us0 on us0.voice = p.slug left join base b on b.voice = p.slug",
)
def portability_audit(s, d):
    """Profiles that would not carry over: no calibration, a thin one, a limit set by hand, one below the voice's own baseline."""
    u = Y.calibration_units(s, d)
    n = u.groupBy(F.col("voice").alias("slug")).agg(F.count("*").alias("n"))
    base = C.baselines(C.leave_one_out(u)).select(F.col("voice").alias("slug"), "self_baseline")
    p = table(s, d, "profiles").join(n, "slug", "left").join(base, "slug", "left")
    found = F.array_compact(F.array(F.when(F.coalesce("n", F.lit(0)) == 0, F.lit("empty")), F.when(F.col("n") < 3 * len(P.SURFACE), F.lit("thin")), F.when(F.col("max_rmsz") < F.col("self_baseline"), F.lit("gate below baseline")), F.when(F.col("max_rmsz").isNotNull(), F.lit("gate hard-coded"))))
    return p.select("slug", F.coalesce("n", F.lit(0)).alias("n_pieces"), F.array_join(found, "|").alias("problems"))


@query(
    "health_checks",
    "with st as (select voice, count(*) as chunks, count_if(text is null or text = '') as empty, count_if(embedding is null) as no_vector from (select distinct id, voice, text, embedding from chunks where voice is not null) group by voice), ac as (select voice, count(distinct seq) as accepted, max(seq) as last_seq from accepted_log where voice is not null group by voice), br as (select voice, count(*) as briefs from briefs where voice is not null group by voice) "
    "select slug, coalesce(chunks, 0) as chunks, coalesce(empty, 0)::bigint as empty, coalesce(no_vector, 0)::bigint as no_vector, coalesce(accepted, 0) as accepted, last_seq, coalesce(briefs, 0) as briefs, author is null as no_author, case when coalesce(chunks, 0) = 0 then 'no store' when empty + no_vector > 0 then 'gaps' else 'ok' end as store from profiles p left join st on st.voice = slug left join ac on ac.voice = slug left join br on br.voice = slug",
)
def health_checks(s, d):
    """Per profile: its store, accepted drafts and briefs, and what is missing."""
    c = table(s, d, "chunks").where("voice is not null").select("id", "voice", "text", F.col("embedding").isNull().alias("nv")).dropDuplicates(["id", "voice"])
    one = lambda test: F.sum(F.when(test, 1).otherwise(0))
    st = c.groupBy(F.col("voice").alias("slug")).agg(F.count("*").alias("chunks"), one(F.coalesce("text", F.lit("")) == "").alias("empty"), one(F.col("nv")).alias("no_vector"))
    ac = table(s, d, "accepted_log").where("voice is not null").groupBy(F.col("voice").alias("slug")).agg(F.count_distinct("seq").alias("accepted"), F.max("seq").alias("last_seq"))
    br = table(s, d, "briefs").where("voice is not null").groupBy(F.col("voice").alias("slug")).agg(F.count("*").alias("briefs"))
    x = table(s, d, "profiles").join(st, "slug", "left").join(ac, "slug", "left").join(br, "slug", "left")
    zero = lambda k: F.coalesce(k, F.lit(0)).alias(k)
    store = F.when(F.coalesce("chunks", F.lit(0)) == 0, "no store").when(F.col("empty") + F.col("no_vector") > 0, "gaps").otherwise("ok")
    return x.select("slug", zero("chunks"), zero("empty"), zero("no_vector"), zero("accepted"), "last_seq", zero("briefs"), F.col("author").isNull().alias("no_author"), store.alias("store"))


# --- kits, profiles, files ---


@query(
    "brief_kits",
    f"{L._BM25}, {Y._FP.removeprefix('with ')}, an as (select query_id, string_agg(id::varchar, ', ' order by rank) as ids from kw where rank <= 3 group by query_id), {_KEPT}, av as (select voice, string_agg(word, ', ' order by word) as words from wl where not kept group by voice) "
    f"select b.id as brief_id, array_to_string(list_filter(['VOICE: ' || b.voice, 'SENTENCES: ' || round_even(sent_len_mean_m, 0)::int::varchar || ' words', 'AVOID: ' || words, 'ANCHORS: ' || ids, 'TASK: ' || b.task], lambda x: x is not null), {_NL}) as kit from briefs b left join fp on fp.voice = b.voice left join av on av.voice = b.voice left join an on an.query_id = b.id",
)
def brief_kits(s, d):
    """What a writer of each brief is handed: voice, sentence length, words to avoid, anchors, task."""
    fp = C.fingerprint(Y.calibration_units(s, d)).select("voice", F.col("sent_len_mean__m").alias("m"))
    av = word_lists(s, d).where("not kept").groupBy("voice").agg(F.array_join(F.array_sort(F.collect_list("word")), ", ").alias("words"))
    an = L._keyword(s, d, 3).groupBy(F.col("query_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda r: r["id"].cast("string")), ", ").alias("ids"))
    x = table(s, d, "briefs").join(fp, "voice", "left").join(av, "voice", "left").join(an, "id", "left")
    lines = F.array_compact(F.array(F.concat(F.lit("VOICE: "), "voice"), F.concat(F.lit("SENTENCES: "), F.bround("m", 0).cast("int").cast("string"), F.lit(" words")), F.concat(F.lit("AVOID: "), "words"), F.concat(F.lit("ANCHORS: "), "ids"), F.concat(F.lit("TASK: "), "task")))
    return x.select(F.col("id").alias("brief_id"), F.array_join(lines, "\n").alias("kit"))


@query("resolved_profiles", "with f as (select max(slug) filter (where slug = 'example') as ex, min(slug) as first from profiles) select b.id as brief_id, coalesce(p.slug, f.ex, f.first) as slug from briefs b left join (select distinct slug from profiles) p on p.slug = b.voice cross join f")
def resolved_profiles(s, d):
    """The profile each brief runs under: its voice's, else the example, else the first."""
    x = pipelines.resolved(table(s, d, "briefs").select(F.col("id").alias("brief_id"), "voice"), table(s, d, "profiles"), "voice")
    return x.select("brief_id", "slug")


@query("cloned_profile", "with m as (select min(slug) as slug from profiles) select slug, author, lang, max_rmsz from profiles where slug <> 'copy' union all select 'copy', author, lang, null from profiles join m using (slug)")
def cloned_profile(s, d):
    """The profiles and a copy of the first one without its limit."""
    p = table(s, d, "profiles")
    first = p.agg(F.min("slug")).first()[0]  # one value
    return pipelines.cloned(p, first, "copy", max_rmsz=F.lit(None).cast("double")).select("slug", "author", "lang", "max_rmsz")


@query("voice_layers", f"with y as (select slug as voice, 0 as o, '' as g, 'voice ' || slug || coalesce(' by ' || author, '') as t from profiles union all select voice, 1, coalesce(genre, ''), task from briefs where voice is not null and coalesce(trim(task), '') <> '') select voice, string_agg(trim(t), {_NL} || {_NL} || '---' || {_NL} || {_NL} order by o, g, trim(t)) as text from y group by voice")
def voice_layers(s, d):
    """Per voice one text: the core, then its layers by genre."""
    core = table(s, d, "profiles").select(F.col("slug").alias("voice"), F.lit(0).alias("o"), F.lit("").alias("g"), F.concat(F.lit("voice "), "slug", F.coalesce(F.concat(F.lit(" by "), "author"), F.lit(""))).alias("text"))
    layers = table(s, d, "briefs").where("voice is not null").select("voice", F.lit(1).alias("o"), F.coalesce("genre", F.lit("")).alias("g"), F.col("task").alias("text"))
    return pipelines.layered(core.unionByName(layers), "voice", ["o", "g"])


_MARKER = "=== DRAFT ==="


@query("slate_parts", f"with {Y._CAND}, raw as (select task_id, string_agg(text, {_NL} || '{_MARKER}' || {_NL} order by cand_idx, cand_id) as raw from c0 group by task_id), pt as (select task_id, raw, list_filter(list_transform(string_split(raw, '{_MARKER}'), lambda q: {S.strip('q')}), lambda q: len({S.tok('q')}) >= 20)[1:3] as p from raw) select task_id, unnest(range(0, case when len(p) > 0 then len(p) else 1 end)) as part, unnest(case when len(p) > 0 then list_transform(p, lambda q: md5(q)) else [md5({S.strip('raw')})] end) as text_md5 from pt")
def slate_parts(s, d):
    """Answers of several drafts in one text, taken apart at their marker; the first three of twenty tokens or more, else the whole."""
    c = K.drafts(s, d).groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("cand_idx", "cand_id", "text"))).alias("z"))  # a slate is a handful
    raw = c.select("task_id", F.array_join(F.transform("z", lambda r: r["text"]), f"\n{_MARKER}\n").alias("raw"))
    x = T.exploded(raw, ["task_id"], chunking.slate_parts(F.col("raw"), _MARKER, 3), "text", "part")
    return x.select("task_id", F.col("part").cast("long").alias("part"), F.md5("text").alias("text_md5"))


@query("neutral_briefs", f"with x as (select doc_id, string_split(regexp_replace({S.strip('text')}, {S.lit('([.!?])' + P.WS + '+')}, '\\1' || chr(1), 'g'), chr(1))[1] as f from documents where text is not null) select doc_id, 'Write a short piece on this subject: ' || array_to_string({S.tok('f')}[1:15], ' ') as brief from x")
def neutral_briefs(s, d):
    """A brief from the opening of every document that carries its subject and nothing else."""
    return table(s, d, "documents").where("text is not null").select("doc_id", chunking.neutral_brief(F.col("text")).alias("brief"))


@query("safe_names", "select distinct filename, case when n = '' then 'untitled' else substr(n, 1, 120) end as safe from (select filename, replace(trim(regexp_replace(filename, '[^\\p{L}\\p{N}_\\s.-]', '', 'g')), ' ', '_') as n from chunks where filename is not null)")
def safe_names(s, d):
    return table(s, d, "chunks").where("filename is not null").select("filename").distinct().select("filename", io.safe_name(F.col("filename")).alias("safe"))


@query("meta_lookup", "with m as (select id as key, voice || '/' || coalesce(genre, '') as value from briefs) select k.key, (select max(value) from m where m.key = k.key) as value from (select distinct brief_id as key from candidates where brief_id is not null union select 'absent') k")
def meta_lookup(s, d):
    """Stored values by key; null where there is none."""
    meta = table(s, d, "briefs").select(F.col("id").alias("key"), F.concat("voice", F.lit("/"), F.coalesce("genre", F.lit(""))).alias("value"))
    keys = table(s, d, "candidates").where("brief_id is not null").select(F.col("brief_id").alias("key")).unionByName(s.createDataFrame([("absent",)], "key string")).distinct()
    return io.meta_values(keys, meta)


@query("dug_scores", f"with {L._ONE} select cand_id, detector_score as score from one")
def dug_scores(s, d):
    """A score dug out of nested JSON; null where it is null or the text is no JSON."""
    x = L.scored(s, d).select("cand_id", F.to_json(F.struct(F.struct(F.array(F.struct("detector_score", "task_id")).alias("rows"), F.lit("x").alias("kind")).alias("result"))).alias("j"))
    return x.select("cand_id", io.dig(F.col("j"), "detector_score").cast("double").alias("score"))


_ACCEPT = f"""{_COMPOSE}, {L._ONE}, {L._THRESHOLDS}"""


def _before_after(s, d):
    """First and second drafts of a task: chain scores and detector scores side by side."""
    x = scored(s, d).join(L.scored(s, d).select("cand_id", "detector_score"), "cand_id", "left")
    a = x.where("cand_idx = 0").select("task_id", "voice", F.col("detector_score").alias("d0"), F.col("n_flags").alias("f0"))
    b = x.where("cand_idx = 1").select("task_id", F.col("detector_score").alias("d1"), F.col("n_flags").alias("f1"), "rmsz", "limit", "n_fidelity")
    return a.join(b, "task_id")


_SIDES = "ba as (select a.task_id, a.voice, oa.detector_score as d0, ob.detector_score as d1, a.n_flags as f0, b.n_flags as f1, b.rmsz, b.lim, b.n_fidelity from sd a join sd b on a.task_id = b.task_id and a.cand_idx = 0 and b.cand_idx = 1 left join one oa on oa.cand_id = a.cand_id left join one ob on ob.cand_id = b.cand_id)"


@query("detector_accept", f"{_ACCEPT}, {_SIDES} select task_id, coalesce(case when coalesce(low_is_machine, true) then d1 > d0 else d1 < d0 end and rmsz <= lim and n_fidelity = 0, false) as accepted from ba left join dt using (voice)")
def detector_accept(s, d):
    """Whether a task's second draft may replace its first: a gain the way the voice's detector points, within its limit, true to the first."""
    t = evalstats.detector_threshold(L.scored(s, d).where("voice is not null and machine is not null"), "machine", "detector_score", "voice", fpr=0.05).select("voice", "direction")
    x = _before_after(s, d).join(t, "voice", "left")
    ok = gate.detector_accepted(F.col("d0"), F.col("d1"), F.coalesce("direction", F.lit("low_is_machine")), F.col("rmsz"), F.col("limit"), F.col("n_fidelity"))
    return x.select("task_id", F.coalesce(ok, F.lit(False)).alias("accepted"))


@query("repair_accept", f"{_ACCEPT}, {_SIDES} select task_id, f0 as flags_before, f1 as flags_after, coalesce(f1 < f0 and (f1 = 0 or rmsz <= lim) and n_fidelity <= 0, false) as accepted from ba")
def repair_accept(s, d):
    """Second drafts as repairs of first ones: fewer flags, clean or within the limit, no less true."""
    x = _before_after(s, d)
    ok = gate.repair_accepted(F.col("f0"), F.col("f1"), F.col("rmsz"), F.col("limit"), F.lit(0), F.col("n_fidelity"))
    return x.select("task_id", F.col("f0").cast("long").alias("flags_before"), F.col("f1").cast("long").alias("flags_after"), F.coalesce(ok, F.lit(False)).alias("accepted"))


# --- detector, discrimination, recalibration, campaign ---


@query(
    "detector_signals",
    f"with {L._ONE}, {L._THRESHOLDS}, tk as (select cand_id, max(coalesce(len({S.tok('text')}), 0)) as n from candidates group by cand_id) select one.cand_id, detector_score is not null and threshold is not null as available, case when detector_score is null or threshold is null then null when n < 48 then 'uncertain' when case when low_is_machine then detector_score < threshold else detector_score > threshold end then 'machine' else 'human' end as label, "
    f"case when detector_score is null or threshold is null then null else {S.r6('case when low_is_machine then detector_score - threshold else threshold - detector_score end')} end as margin from one join tk using (cand_id) left join dt using (voice)",
)
def detector_signals(s, d):
    """What the detector says of every draft: whether it can say anything, its label and the margin on the human side."""
    t = evalstats.detector_threshold(L.scored(s, d).where("voice is not null and machine is not null"), "machine", "detector_score", "voice", fpr=0.05).select("voice", "threshold", "direction")
    n = table(s, d, "candidates").groupBy("cand_id").agg(F.max(F.coalesce(F.size(T.tokens(F.col("text"))), F.lit(0))).alias("n_tokens"))
    x = L.scored(s, d).join(n, "cand_id").join(t, "voice", "left")
    ok = F.col("detector_score").isNotNull() & F.col("threshold").isNotNull()
    label = evalstats.detector_label(F.col("detector_score"), F.col("n_tokens"), F.col("threshold"), F.col("direction"))
    gap = F.col("detector_score") - F.col("threshold")
    return x.select("cand_id", ok.alias("available"), F.when(ok, label).alias("label"), F.when(ok, R(F.when(F.col("direction") == "low_is_machine", gap).otherwise(-gap))).alias("margin"))


@query(
    "detector_loop",
    f"{_ACCEPT}, {_SIDES}, lp as (select voice, d0, case when coalesce(case when coalesce(low_is_machine, true) then d1 > d0 else d1 < d0 end and rmsz <= lim and n_fidelity = 0, false) then d1 else d0 end as d2, threshold, low_is_machine from ba join dt using (voice) where d0 is not null) "
    f"select voice, count(*) as n, {S.r6('avg(case when case when low_is_machine then d0 < threshold else d0 > threshold end then 1.0 else 0.0 end)')} as machine_before, {S.r6('avg(case when case when low_is_machine then d2 < threshold else d2 > threshold end then 1.0 else 0.0 end)')} as machine_after from lp group by voice",
)
def detector_loop(s, d):
    """Per voice: the share of first drafts a detector calls a machine's, before and after accepted replacements by second ones."""
    t = evalstats.detector_threshold(L.scored(s, d).where("voice is not null and machine is not null"), "machine", "detector_score", "voice", fpr=0.05).select("voice", "threshold", "direction")
    x = _before_after(s, d).where("d0 is not null").join(t, "voice")
    ok = F.coalesce(gate.detector_accepted(F.col("d0"), F.col("d1"), F.col("direction"), F.col("rmsz"), F.col("limit"), F.col("n_fidelity")), F.lit(False))
    x = x.withColumn("d2", F.when(ok, F.col("d1")).otherwise(F.col("d0")))
    low = F.col("direction") == "low_is_machine"
    share = lambda c: R(F.avg(F.when(low, F.col(c) < F.col("threshold")).otherwise(F.col(c) > F.col("threshold")).cast("double")))
    return x.groupBy("voice").agg(F.count("*").alias("n"), share("d0").alias("machine_before"), share("d2").alias("machine_after"))


@query(
    "discrimination",
    f"{Y._LOO}, {Y._CAND}, {Y._CANDF}, ds as (select x.voice, round({S.rms()}, 9) as dist from cf x join fp y using (voice)), hs as (select voice, round(loo, 9) as dist from loo) "
    f"select ds.voice, {S.r6('sum(case when hs.dist < ds.dist then 1.0 when hs.dist = ds.dist then 0.5 else 0.0 end) / count(*)')} as auroc from ds join hs using (voice) group by ds.voice",
)
def discrimination(s, d):
    """Per voice: how well the distance tells its own documents (each left out of the ruler) from drafts."""
    u = Y.calibration_units(s, d)
    own = checkpointed(C.leave_one_out(u).select("voice", F.lit(True).alias("real"), F.round("loo", 9).alias("dist")))
    other = checkpointed(C.with_distance(Y.candidate_units(s, d), C.fingerprint(u)).select("voice", F.lit(False).alias("real"), F.round("rmsz", 9).alias("dist")))
    x = own.unionByName(other).join(other.select("voice").distinct(), "voice", "left_semi").join(own.select("voice").distinct(), "voice", "left_semi")
    return evalstats.auroc(x, "real", "dist", "voice").select("voice", R(F.col("auroc")).alias("auroc"))


@query(
    "recalibration_effect",
    f"{Y._FP}, {Y._ACC}, {Y._ACCF}, wu as (select voice, 1.0::double as wt, {', '.join(P.SURFACE)} from u union all select voice, 1.0 + 3.0 * pow(0.5::double, steps_back / 3.0::double), {', '.join(P.SURFACE)} from af where n_words >= {P.MIN_PIECE_WORDS}), "
    f"wm as (select voice, count(*) as n_pieces, {Y._WCOLS} from wu group by voice having count(*) >= 5), ws as (select voice, {Y._WSD} from wu join wm using (voice) group by voice), wf as (select * from wm join ws using (voice)), "
    f"b0 as (select x.voice, count(*) as n, avg({S.rms()}) as d from af x join fp y using (voice) group by x.voice), b1 as (select x.voice, avg({S.rms()}) as d from af x join wf y using (voice) group by x.voice) "
    f"select voice, n, {S.r6('b0.d')} as before, {S.r6('b1.d')} as after, {S.r6('b1.d - b0.d')} as change from b0 join b1 using (voice)",
)
def recalibration_effect(s, d):
    """Per voice: the mean distance of its accepted drafts before and after they weigh in its ruler, newer ones more."""
    u, acc = Y.calibration_units(s, d), Y.accepted_units(s, d)
    one = u.select("voice", F.lit(1.0).alias("weight"), *P.SURFACE).unionByName(C.usable(acc).select("voice", C.recency_weight(F.col("steps_back")).alias("weight"), *P.SURFACE))
    mean = lambda fp: C.with_distance(acc, fp).groupBy("voice").agg(F.count("*").alias("n"), F.avg("rmsz").alias("d"))
    x = mean(C.fingerprint(u)).join(mean(C.weighted_fingerprint(one)).select("voice", F.col("d").alias("e")), "voice")
    return x.select("voice", "n", R(F.col("d")).alias("before"), R(F.col("e")).alias("after"), R(F.col("e") - F.col("d")).alias("change"))


_JOBS = ("build", "audit", "ab")


@query(
    "campaign_jobs",
    "with st as (select distinct voice from documents where voice is not null), ac as (select distinct voice from accepted_log where voice is not null), pr as (select a.voice, count(*) as n from candidates a where cand_idx = 1 and voice is not null group by voice) "
    "select slug as voice, j.job, case j.job when 'build' then st.voice is not null when 'audit' then st.voice is not null and ac.voice is not null else st.voice is not null and coalesce(n, 0) > 0 end as runnable from profiles cross join (values ('build'), ('audit'), ('ab')) j(job) left join st on st.voice = slug left join ac on ac.voice = slug left join pr on pr.voice = slug",
)
def campaign_jobs(s, d):
    """The jobs of every voice and whether its tables hold what they need."""
    some = lambda t, name, where="true": table(s, d, t).where("voice is not null").where(where).select(F.col("voice").alias("slug")).distinct().withColumn(name, F.lit(True))
    p = table(s, d, "profiles").select("slug").join(some("documents", "docs"), "slug", "left").join(some("accepted_log", "acc"), "slug", "left").join(some("candidates", "pairs", "cand_idx = 1"), "slug", "left")
    has = lambda c: F.coalesce(c, F.lit(False))
    ready = {"build": has("docs"), "audit": has("docs") & has("acc"), "ab": has("docs") & has("pairs")}
    rows = F.explode(F.array(*(F.struct(F.lit(j).alias("job"), ready[j].alias("runnable")) for j in _JOBS))).alias("z")
    return p.select(F.col("slug").alias("voice"), rows).select("voice", "z.job", "z.runnable")


@query("brief_prompts", "select id as brief_id, array_to_string(list_filter(['Write a ' || coalesce(genre, 'piece') || ' of ' || target_words[1]::varchar || case when len(target_words) > 1 and target_words[2] <> target_words[1] then ' to ' || target_words[2]::varchar else '' end || ' words.', 'Voice: ' || voice || '.', task], lambda x: x is not null), chr(10)) as prompt from briefs")
def brief_prompts(s, d):
    """The request of each brief as text: form and length, voice, task; what is null falls out."""
    n = F.col("target_words")
    length = F.concat(F.get(n, F.lit(0)).cast("string"), F.when((F.size(n) > 1) & (F.get(n, F.lit(1)) != F.get(n, F.lit(0))), F.concat(F.lit(" to "), F.get(n, F.lit(1)).cast("string"))).otherwise(""))
    lines = F.array(F.concat(F.lit("Write a "), F.coalesce("genre", F.lit("piece")), F.lit(" of "), length, F.lit(" words.")), F.concat(F.lit("Voice: "), "voice", F.lit(".")), F.col("task"))
    return table(s, d, "briefs").select(F.col("id").alias("brief_id"), F.array_join(F.array_compact(lines), "\n").alias("prompt"))


# --- regression limits, worst features, other segments and stores ---


@query(
    "fit_regression",
    f"{Y._LOO}, dw as (select x.doc_id, x.voice, {S.rms()} as rmsz, {K._WORST3} as worst from u x join fp y using (voice)), st as (select voice, {K._fit('rmsz', 'worst')} as state from dw join base using (voice)), g as (select voice, count(*) as n, count_if(state = 'off') / count(*)::double as hard, count_if(state = 'drifting') / count(*)::double as soft from st group by voice) "
    f"select voice, n, {S.r6('hard')} as hard_rate, {S.r6('soft')} as advisory_rate, hard <= 0.08 and soft <= 0.35 as passes from g",
)
def fit_regression(s, d):
    """Per voice: how often the fit rule, its three worst features included, calls the voice's own documents off or drifting; at most 8 % and 35 % may be."""
    x = Y.doc_fit(s, d).select("voice", C.fit_state(F.col("rmsz"), F.col("fit_threshold"), F.col("self_baseline"), C.worst_features()).alias("state"))
    rate = lambda v: F.avg((F.col("state") == v).cast("double"))
    g = x.groupBy("voice").agg(F.count("*").alias("n"), rate("off").alias("hard"), rate("drifting").alias("soft"))
    return g.select("voice", "n", R(F.col("hard")).alias("hard_rate"), R(F.col("soft")).alias("advisory_rate"), ((F.col("hard") <= 0.08) & (F.col("soft") <= 0.35)).alias("passes"))


@query(
    "cadence_gap_features",
    f"with {Y._CUTS}, lg as (select * from (select *, row_number() over (partition by voice, seq order by id) as k from accepted_log where text is not null and voice is not null) where k = 1), lc as (select voice || chr(0) || seq::varchar as akey, voice, text, lo, hi from lg join cut using (voice) where len({S.tok('text')}) >= 80), {Y.cadence_cte('lc', 'akey', 'ca', 'lo', 'hi')}, "
    "lz as (" + " union all ".join(f"select x.voice, '{f}' as feature, {i} as idx, avg(abs({S.z(f)})) as az from (select ca.*, lc.voice from ca join lc using (akey)) x join fc y using (voice) group by x.voice" for i, f in enumerate(P.CADENCE)) + "), "
    f"r as (select *, row_number() over (partition by voice order by round(az, 9) desc, idx) as rank from lz) select voice, rank, feature, {S.r6('az')} as mean_abs_z from r where rank <= 5",
)
def cadence_gap_features(s, d):
    """The five cadence features in which a voice's accepted drafts are furthest from its documents."""
    u = checkpointed(C.usable(Y.cadence_fit(s, d)))
    acc = table(s, d, "accepted_log").where("text is not null and voice is not null").dropDuplicates(["voice", "seq"]).where(F.size(T.tokens(F.col("text"))) >= 80).select("id", "voice", "text")
    a = X.with_features(acc.join(u.select("voice", "lo", "hi").distinct(), "voice"), cadence=True, lo=F.col("lo"), hi=F.col("hi")).drop("text")
    z = C.with_distance(a, C.fingerprint(u, P.CADENCE), P.CADENCE).groupBy("voice").agg(*(F.avg(F.abs(f"{f}__z")).alias(f) for f in P.CADENCE))
    rows = F.slice(F.array_sort(F.array(*(F.struct((-F.round(f, 9)).alias("d"), F.lit(i).alias("i"), F.lit(f).alias("feature"), F.col(f).alias("az")) for i, f in enumerate(P.CADENCE)))), 1, 5)
    return z.select("voice", F.posexplode(rows).alias("k", "w")).select("voice", (F.col("k") + 1).cast("long").alias("rank"), "w.feature", R(F.col("w.az")).alias("mean_abs_z"))


_CUT_ALL = K._SEGMENTS[: K._SEGMENTS.rindex("sg as (")].rstrip().rstrip(",").replace(f"from su where len({S.tok('text')}) > target", "from su")


@query("cut_all_segments", f"with recursive {_CUT_ALL} select doc_id, seg, len({S.tok('t')}) as words from (select doc_id, seg, array_to_string(p[a + 1:b], chr(10) || chr(10)) as t from sc join su using (doc_id) where seg >= 0)")
def cut_all_segments(s, d):
    """Documents' pieces when short ones are cut as well, so that what is below a third of the target falls out."""
    docs = table(s, d, "documents").where("text is not null and voice is not null").select("doc_id", "voice", "text")
    p = chunking.segmentation(docs, "voice", len(P.SURFACE))
    x = T.exploded(docs.join(p.select("voice", "target"), "voice"), ["doc_id"], chunking.cut_all_udf("text", "target"), "text", "seg")
    return x.select("doc_id", F.col("seg").cast("long").alias("seg"), F.size(T.tokens(F.col("text"))).cast("long").alias("words"))


@query(
    "stored_documents",
    "with c as (select id, any_value(filename) as filename, any_value(chunk_idx) as chunk_idx, any_value(text) as text from chunks where filename is not null and text is not null group by id), p as (select filename, string_agg(text, chr(10) || chr(10) order by chunk_idx, id) as text from c group by filename), "
    "b as (select task as filename, min(text) as text from accepted_log where task is not null and text is not null group by task) select filename, md5(text) as text_md5 from p union all select filename, md5(text) from b where filename not in (select filename from p)",
)
def stored_documents(s, d):
    """The documents of a store: its pieces, and of the cookbook's (accepted drafts by task) those that have no chunks."""
    book = table(s, d, "accepted_log").where("task is not null and text is not null").groupBy(F.col("task").alias("filename")).agg(F.min("text").alias("text"))
    return io.store_documents(table(s, d, "chunks"), book).select("filename", F.md5("text").alias("text_md5"))
