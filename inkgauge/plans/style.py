"""Queries: features, fingerprints, distances, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkgauge.functions import patterns as P
from inkgauge.functions import textkit as T
from inkgauge.operators import calibrate as C
from inkgauge.operators import chunking, evalstats, feedback
from inkgauge.operators import features as X
from inkgauge.plans import sqlkit as S
from inkgauge.plans.registry import query
from inkgauge.session import checkpointed, table

R = T.rounded


def doc_units(s: SparkSession, d: str, **options) -> DataFrame:
    """Features of every document with a text."""
    docs = table(s, d, "documents").where("text is not null").select("doc_id", "voice", "text")
    return X.with_features(docs, **options).drop("text")


def calibration_units(s: SparkSession, d: str) -> DataFrame:
    """The features of usable documents, written once: calibration, leave-one-out and scoring read them several times.

    A row of features is some hundred bytes, whatever its text.
    """
    return checkpointed(C.usable(doc_units(s, d)))


def doc_fit(s: SparkSession, d: str) -> DataFrame:
    """Documents of voices with a fingerprint: z columns, rmsz, and the voice's baseline and threshold."""
    u = calibration_units(s, d)
    fp = C.fingerprint(u)
    base = C.baselines(C.leave_one_out(u)).drop("n_pieces")
    return C.with_distance(u, fp).join(base, "voice")


_FEAT = S.feature_cte("documents", "doc_id", "voice")
_FP = f"with {_FEAT}, {S.fingerprint_cte()}"
_DIST = f"{_FP}, dist as (select x.doc_id, x.voice, {S.rms()} as rmsz from u x join fp y using (voice))"
# every unit against the mean and deviation of the others, by definition
_LOO = (
    f"{_FP}, rest as (select a.doc_id, a.voice, "
    + ", ".join(f"avg(b.{f}) as {f}_m, coalesce(stddev_samp(b.{f}), 0.0) as {f}_s" for f in P.SURFACE)
    + f" from u a join u b on a.voice = b.voice and a.doc_id <> b.doc_id where a.voice in (select voice from fp) group by all), loo as (select x.doc_id, x.voice, {S.rms('x', 'y')} as loo from u x join rest y using (doc_id, voice)), "
    "base as (select voice, count(*) as n_pieces, avg(loo) as self_baseline, quantile_cont(loo, 0.95) as fit_threshold from loo group by voice)"
)


@query("surface_features", f"with {_FEAT} select doc_id, n_words, " + ", ".join(f"{S.r6(f)} as {f}" for f in P.SURFACE) + " from feat")
def surface_features(s, d):
    return doc_units(s, d).select("doc_id", F.col("n_words").cast("long").alias("n_words"), *(R(F.col(f)).alias(f) for f in P.SURFACE))


@query("author_fingerprint", f"{_FP}, l as (" + " union all ".join(f"select voice, n_pieces, '{f}' as feature, {f}_m as m, {f}_s as sd from fp" for f in P.SURFACE) + f") select voice, n_pieces, feature, {S.r6('m')} as mean, {S.r6('sd')} as std from l")
def author_fingerprint(s, d):
    return C.fingerprint_long(C.fingerprint(calibration_units(s, d))).select("voice", "n_pieces", "feature", R(F.col("mean")).alias("mean"), R(F.col("std")).alias("std"))


@query("style_distance", f"{_DIST} select doc_id, voice, {S.r6('rmsz')} as rmsz from dist")
def style_distance(s, d):
    u = calibration_units(s, d)
    return C.with_distance(u, C.fingerprint(u)).select("doc_id", "voice", R(F.col("rmsz")).alias("rmsz"))


@query("off_voice_docs", f"{_LOO}, dist as (select x.doc_id, x.voice, {S.rms()} as rmsz from u x join fp y using (voice)) select doc_id, voice, {S.r6('rmsz')} as rmsz, {S.r6('fit_threshold')} as fit_threshold from dist join base using (voice) where rmsz > fit_threshold")
def off_voice_docs(s, d):
    return doc_fit(s, d).where(F.col("rmsz") > F.col("fit_threshold")).select("doc_id", "voice", R(F.col("rmsz")).alias("rmsz"), R(F.col("fit_threshold")).alias("fit_threshold"))


@query(
    "worst_features_top3",
    f"{_FP}, l as (" + " union all ".join(f"select x.doc_id, '{f}' as feature, {i} as idx, {S.z(f)} as z from u x join fp y using (voice)" for i, f in enumerate(P.SURFACE)) + f"), r as (select *, row_number() over (partition by doc_id order by round(abs(z), 9) desc, idx) as rank from l) select doc_id, rank, feature, {S.r6('z')} as z from r where rank <= 3",
)
def worst_features_top3(s, d):
    u = calibration_units(s, d)
    x = C.with_distance(u, C.fingerprint(u))
    x = x.withColumns({f"{f}__z": F.round(F.col(f"{f}__z"), 9) for f in P.SURFACE})
    return x.select("doc_id", F.posexplode(C.worst_features()).alias("i", "w")).select("doc_id", (F.col("i") + 1).cast("long").alias("rank"), "w.feature", R(F.col("w.z")).alias("z"))


@query("loo_baseline", f"{_LOO} select voice, n_pieces, {S.r6('self_baseline')} as self_baseline, {S.r6('fit_threshold')} as fit_threshold from base")
def loo_baseline(s, d):
    return C.baselines(C.leave_one_out(calibration_units(s, d))).select("voice", "n_pieces", R(F.col("self_baseline")).alias("self_baseline"), R(F.col("fit_threshold")).alias("fit_threshold"))


_STATS = ", ".join(f"avg({f}) as {f}_m, coalesce(stddev_samp({f}), 0.0) as {f}_s" for f in P.SURFACE)
_PAIR = "sqrt((" + " + ".join(f"pow(case when y.{f}_s > 1e-9 then (a.{f} - b.{f}) / y.{f}_s else 0.0 end, 2)" for f in P.SURFACE) + f") / {len(P.SURFACE)}.0)"


@query(
    "corpus_spread",
    f"{_FP}, smp as (select * from (select *, row_number() over (partition by voice order by md5(doc_id::varchar), doc_id) as rn from u) where rn <= {P.SPREAD_SAMPLE}), st as (select voice, count(*) as n_units, {_STATS} from smp group by voice) "
    f"select y.voice, any_value(y.n_units) as n_units, {S.r6(f'coalesce(avg({_PAIR}), 0.0)')} as spread from st y left join smp a on a.voice = y.voice left join smp b on b.voice = y.voice and a.rn < b.rn where b.rn is not null or y.n_units = 1 group by y.voice",
)
def corpus_spread(s, d):
    return C.corpus_spread(calibration_units(s, d), "doc_id").select("voice", "n_units", R(F.col("spread")).alias("spread"))


@query("calibration_confidence", f"{_FP} select voice, n_pieces, case when n_pieces < 13 then 'very thin' when n_pieces < 39 then 'thin' else 'ok' end as confidence from fp")
def calibration_confidence(s, d):
    return C.fingerprint(calibration_units(s, d)).select("voice", "n_pieces", C.confidence(F.col("n_pieces"), len(P.SURFACE)).alias("confidence"))


def accepted_units(s, d) -> DataFrame:
    """Features of the distinct accepted drafts, with how many newer ones their voice has."""
    log = feedback.with_steps_back(table(s, d, "accepted_log").where("text is not null"))
    return checkpointed(X.with_features(log.select("id", "voice", "seq", "steps_back", "text")).drop("text"))


_ACC = "acc0 as (select * from (select *, row_number() over (partition by voice, seq order by id) as k from accepted_log where text is not null and voice is not null) where k = 1), acc as (select *, row_number() over (partition by voice order by seq desc) - 1 as steps_back from acc0)"
_ACCF = S.feature_cte("acc", "id", "voice, seq, steps_back", name="af")
_WCOLS = ", ".join(f"sum(wt * {f}) / sum(wt) as {f}_m" for f in P.SURFACE)
_WSD = ", ".join(f"sqrt(sum(wt * pow({f} - {f}_m, 2)) / sum(wt)) as {f}_s" for f in P.SURFACE)


@query(
    "recency_recalibration",
    f"with {_FEAT}, {_ACC}, {_ACCF}, wu as (select voice, 1.0::double as wt, {', '.join(P.SURFACE)} from feat where voice is not null and n_words >= 120 union all select voice, 1.0 + 3.0 * pow(0.5::double, steps_back / 3.0::double), {', '.join(P.SURFACE)} from af where n_words >= 120), "
    f"wm as (select voice, count(*) as n_pieces, {_WCOLS} from wu group by voice having count(*) >= 5), ws as (select voice, {_WSD} from wu join wm using (voice) group by voice), l as ("
    + " union all ".join(f"select voice, n_pieces, '{f}' as feature, {f}_m as m, {f}_s as sd from wm join ws using (voice)" for f in P.SURFACE)
    + f") select voice, n_pieces, feature, {S.r6('m')} as mean, {S.r6('sd')} as std from l",
)
def recency_recalibration(s, d):
    one = calibration_units(s, d).select("voice", F.lit(1.0).alias("weight"), *P.SURFACE)
    acc = C.usable(accepted_units(s, d)).select("voice", C.recency_weight(F.col("steps_back")).alias("weight"), *P.SURFACE)
    return C.fingerprint_long(C.weighted_fingerprint(one.unionByName(acc))).select("voice", "n_pieces", "feature", R(F.col("mean")).alias("mean"), R(F.col("std")).alias("std"))


_CAND = "c0 as (select * from (select *, row_number() over (partition by cand_id order by created_at, rmsz) as k from candidates where text is not null and voice is not null) where k = 1)"
_CANDF = S.feature_cte("c0", "cand_id", "task_id, cand_idx, voice", name="cf")


def candidate_units(s, d) -> DataFrame:
    """Features of the distinct drafts with a text and a voice."""
    c = table(s, d, "candidates").where("text is not null and voice is not null").select("cand_id", "task_id", "cand_idx", "voice", "text").dropDuplicates(["cand_id"])
    return checkpointed(X.with_features(c).drop("text"))


@query(
    "accepted_target_distance",
    f"{_FP}, {_ACC}, {_ACCF}, {_CAND}, {_CANDF}, tm as (select voice, {', '.join(f'avg({f}) as {f}_m' for f in P.SURFACE)} from af group by voice), tg as (select tm.*, {', '.join(f'fp.{f}_s' for f in P.SURFACE)} from tm join fp using (voice)) select x.cand_id, {S.r6(S.rms())} as distance from cf x join tg y using (voice)",
)
def accepted_target_distance(s, d):
    fp = C.fingerprint(calibration_units(s, d))
    target = C.accepted_target(accepted_units(s, d), fp)
    return C.with_distance(candidate_units(s, d), target).select("cand_id", R(F.col("rmsz")).alias("distance"))


@query(
    "sentence_terciles",
    f"with l as (select voice, unnest(list_transform({S.sents('text')}, lambda x: len({S.w1('x')}))) as n from documents where text is not null and voice is not null) select voice, case when count(*) < 10 then 12.0 else {S.r6('quantile_cont(n::double, 1/3::double)')} end as lo, case when count(*) < 10 then 22.0 else {S.r6('quantile_cont(n::double, 2/3::double)')} end as hi from l where n > 0 group by voice",
)
def sentence_terciles(s, d):
    x = X.sentence_cuts(table(s, d, "documents").where("voice is not null"))
    return x.select("voice", R(F.col("lo")).alias("lo"), R(F.col("hi")).alias("hi"))


def cadence_cte(src: str, key: str, name: str = "cad", lo: str = "12", hi: str = "22") -> str:
    """CTEs ending in ``name`` (key, the 13 cadence features) of the texts of a table; lo and hi may be columns of it."""
    n = name
    feats = {
        "sl_autocorr1": "case when m.cnt > 2 and m.var > 1e-9 then ag.c1 / m.var else 0.0 end",
        "sl_autocorr2": "case when m.cnt > 3 and m.var > 1e-9 then ag.c2 / m.var else 0.0 end",
        "sl_delta_abs": "ag.da / m.mean",
        "sl_delta_sd": "coalesce(ag.ds, 0.0) / m.mean",
        "sl_dir_changes": "coalesce(dc.dir, 0.0)",
        "sl_run_mean": "m.cnt / (ag.ch + 1)::double",
        "sl_trans_entropy": "coalesce(en.h, 0.0)",
        "sl_short_after_long": "coalesce(ag.sal, 0.0)",
        "para_open_ratio": "coalesce(po.o / m.mean, 0.0)",
        "para_close_ratio": "coalesce(po.cl / m.mean, 0.0)",
        "clause_len_mean": "coalesce(cl.cm, 0.0)",
        "clause_len_cv": "coalesce(cl.cs / cl.cm, 0.0)",
        "clause_per_sent": "coalesce(cl.per, 0.0)",
    }
    cols = ", ".join(f"case when coalesce(m.cnt, 0) >= 4 then {v} else 0.0 end as {k}" for k, v in feats.items())
    return f"""
{n}_a as (select {key}, {S.sents('text')} as s, {S.paras('text')} as p, {lo} as lo, {hi} as hi from {src} where text is not null),
{n}_b as (select {key}, unnest(s) as sent, generate_subscripts(s, 1) as pos from {n}_a),
{n}_c0 as (select {key}, pos, sent, len({S.w1('sent')}) as n from {n}_b),
{n}_c as (select {key}, row_number() over (partition by {key} order by pos) as i, n from {n}_c0 where n > 0),
{n}_m as (select {key}, count(*) as cnt, avg(n) as mean, sum(pow(n - mu, 2)) as var from (select *, avg(n) over (partition by {key}) as mu from {n}_c) group by {key}),
{n}_w as (select c.{key}, i, n, n - mean as dev, lead(n - mean, 1) over x as dev1, lead(n - mean, 2) over x as dev2, lead(n, 1) over x - n as delta,
  case when n <= a.lo then 0 when n > a.hi then 2 else 1 end as cls from {n}_c c join {n}_m m using ({key}) join {n}_a a using ({key}) window x as (partition by c.{key} order by i)),
{n}_w2 as (select *, lead(cls) over (partition by {key} order by i) as nxt from {n}_w),
{n}_sg as (select {key}, sign(delta) as sg, lead(sign(delta)) over (partition by {key} order by i) as ng from {n}_w where delta <> 0),
{n}_dc as (select {key}, case when count(*) > 1 then sum(case when ng is not null and sg <> ng then 1 else 0 end) / (count(*) - 1)::double else 0.0 end as dir from {n}_sg group by {key}),
{n}_tr as (select {key}, cls, nxt, count(*) as k from {n}_w2 where nxt is not null group by all),
{n}_en as (select {key}, -sum(k / t * log2(k / t)) as h from (select *, sum(k) over (partition by {key})::double as t from {n}_tr) group by {key}),
{n}_ag as (select {key}, sum(dev * dev1) as c1, sum(dev * dev2) as c2, avg(abs(delta)) as da, stddev_samp(delta) as ds, sum(case when nxt is not null and nxt <> cls then 1 else 0 end) as ch,
  sum(case when nxt = 0 and cls = 2 then 1 else 0 end) / nullif(sum(case when nxt is not null and cls = 2 then 1 else 0 end), 0)::double as sal from {n}_w2 group by {key}),
{n}_pp as (select {key}, unnest(list_filter(list_transform(p, lambda q: {S.sents('q')}), lambda z: len(z) > 0)) as ss from {n}_a),
{n}_po as (select {key}, avg(len({S.w1('ss[1]')})) as o, avg(len({S.w1('ss[-1]')})) as cl from {n}_pp group by {key}),
{n}_cq as (select {key}, pos, unnest(list_filter(list_transform(regexp_split_to_array(sent, '[,;:]'), lambda q: len({S.w1('q')})), lambda v: v > 0)) as k from {n}_c0),
{n}_cl as (select {key}, avg(k) as cm, coalesce(stddev_samp(k), 0.0) as cs, count(*) / count(distinct pos)::double as per from {n}_cq group by {key}),
{n} as (select a.{key}, {cols} from {n}_a a left join {n}_m m using ({key}) left join {n}_ag ag using ({key}) left join {n}_dc dc using ({key}) left join {n}_en en using ({key}) left join {n}_po po using ({key}) left join {n}_cl cl using ({key}))"""


@query("cadence_features", f"with {cadence_cte('documents', 'doc_id')} select doc_id, " + ", ".join(f"{S.r6(f)} as {f}" for f in P.CADENCE) + " from cad")
def cadence_features(s, d):
    return doc_units(s, d, cadence=True).select("doc_id", *(R(F.col(f)).alias(f) for f in P.CADENCE))


def cadence_fit(s, d) -> DataFrame:
    """Documents with 26 features under their voice's own sentence classes."""
    docs = table(s, d, "documents").where("text is not null and voice is not null").select("doc_id", "voice", "text")
    cuts = X.sentence_cuts(docs)
    x = X.with_features(docs.join(cuts, "voice"), cadence=True, lo=F.col("lo"), hi=F.col("hi"))
    return x.drop("text")


def _rms(features, unit: str = "x", fp: str = "y") -> str:
    return "sqrt((" + " + ".join(f"pow({S.z(f, unit, fp)}, 2)" for f in features) + f") / {len(features)}.0)"


_EVERY = P.SURFACE + P.CADENCE
# usable documents (uc) and the accepted drafts of 80 tokens or more (ac) with 26 features, both under the voice's own sentence classes
_CUTS = f"""vd as (select doc_id, voice, text from documents where text is not null and voice is not null),
ln as (select voice, unnest(list_transform({S.sents('text')}, lambda x: len({S.w1('x')}))) as n from vd),
cut as (select voice, case when count(*) < 10 then 12.0 else quantile_cont(n::double, 1/3::double) end as lo, case when count(*) < 10 then 22.0 else quantile_cont(n::double, 2/3::double) end as hi from ln where n > 0 group by voice),
vc as (select vd.*, lo, hi from vd join cut using (voice)), {cadence_cte('vc', 'doc_id', 'cd', 'lo', 'hi')}, {S.feature_cte('documents', 'doc_id', 'voice')},
uc as (select feat.*, {', '.join('cd.' + f for f in P.CADENCE)} from feat join cd using (doc_id) where voice is not null and n_words >= {P.MIN_PIECE_WORDS}),
fc as (select voice, count(*) as n_pieces, {', '.join(f'avg({f}) as {f}_m, coalesce(stddev_samp({f}), 0.0) as {f}_s' for f in _EVERY)} from uc group by voice having count(*) >= {P.MIN_PIECES})"""


_LOOC = (
    "restc as (select a.doc_id, a.voice, "
    + ", ".join(f"avg(b.{f}) as {f}_m, coalesce(stddev_samp(b.{f}), 0.0) as {f}_s" for f in P.CADENCE)
    + f" from uc a join uc b on a.voice = b.voice and a.doc_id <> b.doc_id where a.voice in (select voice from fc) group by all), own as (select x.voice, avg({_rms(P.CADENCE)}) as corpus from uc x join restc y using (doc_id, voice) group by x.voice)"
)


@query(
    "cadence_gap_audit",
    f"with {_CUTS}, {_LOOC}, lg as (select * from (select *, row_number() over (partition by voice, seq order by id) as k from accepted_log where text is not null and voice is not null) where k = 1), "
    f"lc as (select voice || chr(0) || seq::varchar as akey, voice, text, lo, hi from lg join cut using (voice) where len({S.tok('text')}) >= 80), {cadence_cte('lc', 'akey', 'ca', 'lo', 'hi')}, "
    f"acc as (select x.voice, avg({_rms(P.CADENCE)}) as accepted, count(*) as n_accepted from (select ca.*, lc.voice from ca join lc using (akey)) x join fc y using (voice) group by x.voice) "
    f"select voice, n_accepted, {S.r6('corpus')} as corpus, {S.r6('accepted')} as accepted, {S.r6('accepted - corpus')} as gap, case when accepted - corpus > 0.3 then 'wide' when accepted - corpus > 0.1 then 'some' else 'none' end as verdict from own join acc using (voice)",
)
def cadence_gap_audit(s, d):
    """Per voice: leave-one-out cadence distance of its documents, cadence distance of its accepted drafts, the gap."""
    u = checkpointed(C.usable(cadence_fit(s, d)))
    own = C.leave_one_out(u, P.CADENCE).groupBy("voice").agg(F.avg("loo").alias("corpus"))
    acc = table(s, d, "accepted_log").where("text is not null and voice is not null").dropDuplicates(["voice", "seq"])
    acc = acc.where(F.size(T.tokens(F.col("text"))) >= 80).select("id", "voice", "text")
    cuts = u.select("voice", "lo", "hi").distinct()
    a = X.with_features(acc.join(cuts, "voice"), cadence=True, lo=F.col("lo"), hi=F.col("hi")).drop("text")
    x = C.with_distance(a, C.fingerprint(u, P.CADENCE), P.CADENCE).groupBy("voice").agg(F.avg("rmsz").alias("accepted"), F.count("*").alias("n_accepted"))
    gap = F.col("accepted") - F.col("corpus")
    return own.join(x, "voice").select("voice", "n_accepted", R(F.col("corpus")).alias("corpus"), R(F.col("accepted")).alias("accepted"), R(gap).alias("gap"), F.when(gap > 0.3, "wide").when(gap > 0.1, "some").otherwise("none").alias("verdict"))


@query("cadence_distance", f"with {_CUTS} select x.doc_id, x.voice, {S.r6(_rms(_EVERY))} as rmsz, {S.r6(_rms(P.CADENCE))} as cadence_rmsz from uc x join fc y using (voice)")
def cadence_distance(s, d):
    u = checkpointed(C.usable(cadence_fit(s, d)))
    every = P.SURFACE + P.CADENCE
    x = C.with_distance(u, C.fingerprint(u, every), every)
    return x.select("doc_id", "voice", R(F.col("rmsz")).alias("rmsz"), R(C.cadence_rms()).alias("cadence_rmsz"))


def _reordered(key: str) -> str:
    """Sentences ordered by a key and put together in paragraphs of five."""
    rows = f"list_sort(list_transform(range(1, len(s) + 1), lambda i: {{'k': {key}, 'i': i, 'x': s[i]}}))"
    return f"array_to_string(list_transform(range(0, len(s), 5), lambda a: array_to_string(list_transform(({rows})[a + 1:a + 5], lambda r: r.x), ' ')), chr(10) || chr(10))"


_ORDERS = {"control": "i", "ramp": f"len({S.w1('s[i]')})", "shuffle": "md5(s[i] || (i - 1)::varchar || '7')"}
_PROBE = [f"ps as (select doc_id, voice, {S.sents('text')} as s from documents where text is not null and voice is not null)", S.feature_cte("documents", "doc_id", "voice"), cadence_cte("documents", "doc_id", "cad"),
    f"ub as (select feat.*, {', '.join('cad.' + f for f in P.CADENCE)} from feat join cad using (doc_id) where voice is not null and n_words >= {P.MIN_PIECE_WORDS}), fb as (select voice, count(*) as n_pieces, {', '.join(f'avg({f}) as {f}_m, coalesce(stddev_samp({f}), 0.0) as {f}_s' for f in P.SURFACE + P.CADENCE)} from ub group by voice having count(*) >= {P.MIN_PIECES})"]
for _how, _key in _ORDERS.items():
    _PROBE += [f"p_{_how} as (select doc_id, voice, {_reordered(_key)} as text from ps)", S.feature_cte(f"p_{_how}", "doc_id", "voice", name=f"f_{_how}"), cadence_cte(f"p_{_how}", "doc_id", f"k_{_how}")]


@query(
    "blindness_probe",
    f"with {', '.join(_PROBE)} "
    + " union all ".join(f"select x.voice, '{h}' as \"order\", {S.r6('avg(' + _rms(P.SURFACE) + ')')} as surface, {S.r6('avg(' + _rms(P.CADENCE) + ')')} as cadence from (select f.*, {', '.join('k.' + f for f in P.CADENCE)} from f_{h} f join k_{h} k using (doc_id) where n_words >= {P.MIN_PIECE_WORDS}) x join fb y using (voice) group by x.voice" for h in _ORDERS),
)
def blindness_probe(s, d):
    """Mean distances of control, ramp and shuffled sentence orders under surface and cadence fingerprints."""
    docs = table(s, d, "documents").where("text is not null and voice is not null").select("doc_id", "voice", "text")
    u = checkpointed(C.usable(X.with_features(docs, cadence=True)).drop("text"))
    out = None
    for how in ("control", "ramp", "shuffle"):
        x = X.with_features(docs.withColumn("text", chunking.perturbed(T.sentences(F.col("text")), how)), cadence=True)
        x = checkpointed(C.usable(x).drop("text"))
        a = C.with_distance(x, C.fingerprint(u), P.SURFACE).groupBy("voice").agg(F.avg("rmsz").alias("surface"))
        b = C.with_distance(x, C.fingerprint(u, P.CADENCE), P.CADENCE).groupBy("voice").agg(F.avg("rmsz").alias("cadence"))
        y = a.join(b, "voice").select("voice", F.lit(how).alias("order"), R(F.col("surface")).alias("surface"), R(F.col("cadence")).alias("cadence"))
        out = y if out is None else out.unionByName(y)
    return out


@query(
    "held_out_eval",
    f"{_FP}, h as (select * from (select doc_id, voice, row_number() over (partition by voice order by length(text) desc, doc_id) as rn from documents where text is not null and voice is not null) where rn <= 5), l as ("
    + " union all ".join(f"select x.voice, '{f}' as feature, abs({S.z(f)}) as az from feat x join h using (doc_id, voice) join fp y using (voice)" for f in P.SURFACE)
    + f") select voice, feature, count(*) as n, {S.r6('avg(az)')} as mean_abs_z from l group by voice, feature",
)
def held_out_eval(s, d):
    docs = table(s, d, "documents").where("text is not null and voice is not null").select("doc_id", "voice", "text")
    w = Window.partitionBy("voice").orderBy(F.length("text").desc(), "doc_id")
    held = docs.withColumn("rn", F.row_number().over(w)).where("rn <= 5")
    z = C.with_distance(X.with_features(held).drop("text"), C.fingerprint(calibration_units(s, d)))
    rows = F.array(*(F.struct(F.lit(f).alias("feature"), F.abs(F.col(f"{f}__z")).alias("az")) for f in P.SURFACE))
    return z.select("voice", F.explode(rows).alias("r")).groupBy("voice", "r.feature").agg(F.count("*").alias("n"), R(F.avg("r.az")).alias("mean_abs_z"))


@query(
    "false_alarm_rates",
    f"{_LOO}, dist as (select x.doc_id, x.voice, {S.rms()} as rmsz from u x join fp y using (voice)), st as (select voice, case when rmsz > fit_threshold then 'off' when rmsz > self_baseline * 1.6 then 'drifting' else 'fit' end as state from dist join base using (voice)) "
    f"select voice, count(*) as n, {S.r6('count_if(state = ' + S.lit('off') + ') / count(*)::double')} as hard_rate, {S.r6('count_if(state = ' + S.lit('drifting') + ') / count(*)::double')} as advisory_rate from st group by voice",
)
def false_alarm_rates(s, d):
    x = doc_fit(s, d).select("voice", C.fit_state(F.col("rmsz"), F.col("fit_threshold"), F.col("self_baseline")).alias("state"))
    rate = lambda v: R(F.avg((F.col("state") == v).cast("double")))
    return x.groupBy("voice").agg(F.count("*").alias("n"), rate("off").alias("hard_rate"), rate("drifting").alias("advisory_rate"))


@query("distinctive_cluster")
def distinctive_cluster(s, d):
    u = calibration_units(s, d)
    return evalstats.cluster_pick(C.with_distance(u, C.fingerprint(u)), P.SURFACE, "doc_id").select("doc_id", R(F.col("distance")).alias("distance"))


# Advice by cadence feature, for too high and too low.
ADVICE = {
    "sl_autocorr1": ("long and short sentences bunch", "lengths alternate mechanically"),
    "sl_autocorr2": ("the rhythm repeats on a cycle", "no shape over several sentences"),
    "sl_delta_abs": ("jumps in length are violent", "neighbours are too close in length"),
    "sl_delta_sd": ("changes of length are erratic", "every change has one size"),
    "sl_dir_changes": ("lengths zigzag too regularly", "lengths drift in long runs"),
    "sl_run_mean": ("runs of one length are too long", "length switches at every sentence"),
    "sl_trans_entropy": ("the order of lengths is scattered", "the order of lengths is predictable"),
    "sl_short_after_long": ("short punches after long ones are overused", "long sentences rarely land on a short one"),
    "para_open_ratio": ("paragraphs open long", "paragraphs open abruptly"),
    "para_close_ratio": ("paragraphs trail off", "paragraphs end clipped"),
    "clause_len_mean": ("clauses run long", "clauses are chopped"),
    "clause_len_cv": ("clause lengths vary wildly", "clauses are all alike"),
    "clause_per_sent": ("too many clauses to a sentence", "too few clauses to a sentence"),
}


_HINT = "case feature " + " ".join(f"when '{k}' then case when z > 0 then {S.lit(a)} else {S.lit(b)} end" for k, (a, b) in ADVICE.items()) + " end"


@query(
    "cadence_hints",
    f"with {_CUTS}, lz as (" + " union all ".join(f"select x.doc_id, '{f}' as feature, {i} as idx, {S.z(f)} as z from uc x join fc y using (voice)" for i, f in enumerate(P.CADENCE)) + f"), rz as (select *, row_number() over (partition by doc_id order by round(abs(z), 9) desc, idx) as rank from lz) select doc_id, feature, {S.r6('z')} as z, {_HINT} as advice from rz where rank = 1",
)
def cadence_hints(s, d):
    """The advice for the worst cadence feature of every usable document."""
    u = checkpointed(C.usable(cadence_fit(s, d)))
    x = C.with_distance(u, C.fingerprint(u, P.CADENCE), P.CADENCE)
    x = x.withColumns({f"{f}__z": F.round(F.col(f"{f}__z"), 9) for f in P.CADENCE})
    x = x.select("doc_id", C.worst_features(P.CADENCE, 1)[0].alias("w")).select("doc_id", "w.feature", "w.z")
    hint = F.create_map(*(v for k, (hi, lo) in ADVICE.items() for v in (F.lit(k), F.struct(F.lit(hi).alias("hi"), F.lit(lo).alias("lo")))))
    return x.withColumn("h", hint[F.col("feature")]).select("doc_id", "feature", R(F.col("z")).alias("z"), F.when(F.col("z") > 0, F.col("h.hi")).otherwise(F.col("h.lo")).alias("advice"))
