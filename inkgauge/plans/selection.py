"""Queries: retrieval, composites, slates, feedback, evaluation, sources, streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkgauge.functions import patterns as P
from inkgauge.functions import textkit as T
from inkgauge.operators import blend, chunking, evalstats, feedback, fidelity, gate, retrieve, rules
from inkgauge.operators import calibrate as C
from inkgauge.plans import sqlkit as S
from inkgauge.plans.checks import _PHRASES, _SLEN, _TELLS, _TESTED, _WORDN, _WORDS_TESTED, _even, _fit, drafts, edits
from inkgauge.plans.registry import query
from inkgauge.plans.style import _CAND, _CANDF, _FP, _LOO, _PAIR, _STATS, calibration_units, candidate_units
from inkgauge.session import shared_folder, table
from inkgauge.sources import io
from inkgauge.streaming import scorer

R = T.rounded

# --- retrieval ---


@query(
    "cosine_topk",
    f"with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings where embedding is not null), n as (select vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as e from v), "
    f"p as (select a.vec_id as query_id, b.vec_id as id, list_dot_product(a.e, b.e) as sim from n a join n b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0), r as (select *, row_number() over (partition by query_id order by round(sim, 9) desc, id) as rank from p) select query_id, id, rank, {S.r6('sim')} as sim from r where rank <= 10",
)
def cosine_topk(s, d):
    """The ten nearest others of every vector whose id is divisible by 20."""
    v = table(s, d, "embeddings").where("embedding is not null").select("vec_id", retrieve.normalized(F.col("embedding")).alias("vec"))
    q = v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    x = retrieve.vector_topk(v, q, 11, "vec_id").where("query_id <> id").drop("rank")
    w = Window.partitionBy("query_id").orderBy(F.round("sim", 9).desc(), "id")
    return x.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 10").select("query_id", "id", "rank", R(F.col("sim")).alias("sim"))


_FOLD = lambda t: f"translate(lower({t}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"
_BM25 = f"""with dd as (select doc_id as id, {S.found(_FOLD('text'), P.WORD_PLAIN)} as w from documents where text is not null),
st as (select count(*) as n, avg(len(w)) as avglen from dd), post as (select id, len, term, count(*) as tf from (select id, len(w) as len, unnest(w) as term from dd) group by all),
dfs as (select term, count(*) as df from post group by term),
qt as (select distinct id as query_id, unnest(list_filter({S.found(_FOLD('task'), P.WORD_PLAIN)}, lambda x: length(x) > 3)[1:15]) as term from briefs where task is not null),
sc as (select query_id, post.id, -sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 0) * 0 + (case when ln((n - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n - df + 0.5) / (df + 0.5)) end) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avglen))) as score from qt join post using (term) join dfs using (term) cross join st group by all),
kw as (select *, row_number() over (partition by query_id order by round(score, 9), id) as rank from sc)"""


def brief_bm25(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    q = table(s, d, "briefs").select(F.col("id").alias("query_id"), F.col("task").alias("text"))
    return retrieve.bm25(docs, q)


def _keyword(s, d, k):
    return retrieve.topk(brief_bm25(s, d).withColumn("raw", F.col("score")).withColumn("score", F.round("score", 9)), k)


@query("bm25_topk", f"{_BM25} select query_id, id, rank, {S.r6('score')} as score from kw where rank <= 15")
def bm25_topk(s, d):
    return _keyword(s, d, 15).select("query_id", "id", F.col("rank").cast("long").alias("rank"), R(F.col("raw")).alias("score"))


def _overlap(s, d, k):
    """A second list: documents by the number of distinct query terms they hold."""
    docs = table(s, d, "documents").where("text is not null")
    q = table(s, d, "briefs").where("task is not null").select(F.col("id").alias("query_id"), F.explode(F.array_distinct(T.query_terms(retrieve.fold_accents(F.col("task"))))).alias("term"))
    w = T.exploded(docs, [F.col("doc_id").alias("id")], F.array_distinct(T.find_all(retrieve.fold_accents(F.col("text")), P.WORD_PLAIN)), "term")
    n = w.join(q, "term").groupBy("query_id", "id").agg(F.count("*").alias("score"))
    return retrieve.topk(n, k, ascending=False)


_OVER = "ov as (select query_id, post.id, count(*) as score from qt join post using (term) group by all), ovr as (select *, row_number() over (partition by query_id order by score desc, id) as rank from ov)"


@query(
    "rrf_hybrid",
    f"{_BM25}, {_OVER}, u as (select query_id, id, 1.0::double / (60 + rank) as s, 0 as l, rank as r from ovr where rank <= 15 union all select query_id, id, 1.0::double / (60 + rank), 1, rank from kw where rank <= 15), "
    f"f as (select query_id, id, sum(s) as rrf, min(l * 1000 + r) as o from u group by all), g as (select *, row_number() over (partition by query_id order by round(rrf, 12) desc, o, id) as rank from f) select query_id, id, rank, {S.r6('rrf')} as rrf from g where rank <= 5",
)
def rrf_hybrid(s, d):
    x = retrieve.rrf([_overlap(s, d, 15), _keyword(s, d, 15)], 5)
    return x.select("query_id", "id", F.col("rank").cast("long").alias("rank"), R(F.col("rrf")).alias("rrf"))


@query(
    "anchor_overlap",
    f"{_BM25}, {_OVER}, a as (select query_id, list(id) as x from ovr where rank <= 5 group by all), b as (select query_id, list(id) as y from kw where rank <= 5 group by all) select query_id, len(list_intersect(x, y)) as shared, {S.r6('len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y)))::double')} as jaccard from a join b using (query_id)",
)
def anchor_overlap(s, d):
    a = _overlap(s, d, 5).groupBy("query_id").agg(F.collect_set("id").alias("x"))
    b = _keyword(s, d, 5).groupBy("query_id").agg(F.collect_set("id").alias("y"))
    n = F.size(F.array_intersect("x", "y"))
    return a.join(b, "query_id").select("query_id", n.cast("long").alias("shared"), R(n / F.size(F.array_union("x", "y"))).alias("jaccard"))


# greedy picks one after the other, each list of picks a row
_MMR = f"""with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e0 from embeddings where embedding is not null), n as (select vec_id, list_transform(e0, lambda x: x / sqrt(list_dot_product(e0, e0))) as e from v),
al as (select a.vec_id as query_id, b.vec_id as id, list_dot_product(a.e, b.e) as sim from n a join n b on a.vec_id % 20 = 0), pool as (select * from (select *, row_number() over (partition by query_id order by sim desc, id) as rank from al) where rank <= 36),
pp as (select a.query_id, a.id as i, b.id as j, list_dot_product(x.e, y.e) as c from pool a join pool b on a.query_id = b.query_id and a.id <> b.id join n x on x.vec_id = a.id join n y on y.vec_id = b.id),
mm(query_id, picked, k) as (select distinct query_id, []::bigint[], 0 from pool
  union all select query_id, list_append(picked, (list(id order by round(score, 10) desc, rank))[1]), k + 1 from (select m.query_id, m.picked, m.k, pool.id, pool.rank, {P.MMR_LAMBDA} * any_value(sim) - (1 - {P.MMR_LAMBDA}) * coalesce(max(c) filter (where list_contains(m.picked, pp.j)), 0.0) as score
    from mm m join pool on pool.query_id = m.query_id left join pp on pp.query_id = m.query_id and pp.i = pool.id where m.k < 8 and not list_contains(m.picked, pool.id) group by m.query_id, m.picked, m.k, pool.id, pool.rank) group by query_id, picked, k)
select query_id, picked[k] as id, k as pick from mm where k > 0"""


@query("mmr_diversified", _MMR)
def mmr_diversified(s, d):
    v = table(s, d, "embeddings").where("embedding is not null").select("vec_id", retrieve.normalized(F.col("embedding")).alias("vec"))
    q = v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    pool = retrieve.vector_topk(v, q, 36, "vec_id").join(v.withColumnRenamed("vec_id", "id"), "id")
    return retrieve.mmr(pool, 8)


@query(
    "accepted_anchors",
    f"with al as (select * from (select *, row_number() over (partition by voice, seq order by id) as k from accepted_log where text is not null and voice is not null) where k = 1), bv as (select * from briefs where voice is not null), {S.encoded_cte('al', 'id', 'text', 'ea')}, {S.encoded_cte('bv', 'id', 'task', 'eb')}, {S.encoded_sims('eb', 'id', 'ea', 'id', 'sm')}, "
    f"j as (select bv.id as query_id, al.id, al.seq, sim, count(*) over (partition by bv.id) as n, row_number() over (partition by bv.id order by al.seq, al.id) - 1 as i from bv join al on al.voice = bv.voice join sm on sm.qa = bv.id and sm.qb = al.id), "
    f"k as (select query_id, id, sim + case when n > 1 then i * {P.RECENCY_NUDGE} / (n - 1)::double else 0.0 end as blended from j), r as (select *, row_number() over (partition by query_id order by round(blended, 9) desc, id) as rank from k) select query_id, id, rank, {S.r6('blended')} as blended from r where rank <= 3",
)
def accepted_anchors(s, d):
    """The three accepted drafts of a brief's voice that are closest to it, newer ones favoured."""
    acc = table(s, d, "accepted_log").where("text is not null and voice is not null").dropDuplicates(["voice", "seq"]).select("id", "voice", "seq", retrieve.encode(F.col("text")).alias("v"))
    b = table(s, d, "briefs").where("voice is not null").select(F.col("id").alias("query_id"), "voice", retrieve.encode(F.col("task")).alias("q"))
    x = b.join(acc, "voice").withColumn("sim", retrieve.dot(F.col("v"), F.col("q")))
    x = retrieve.recency_ranked(x, "seq")
    w = Window.partitionBy("query_id").orderBy(F.round("blended", 9).desc(), "id")
    return x.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3").select("query_id", "id", "rank", R(F.col("blended")).alias("blended"))


# --- composites ---


def _doc_counts(s, d):
    return calibration_units(s, d).groupBy(F.col("voice").alias("source")).agg(F.count("*").alias("n"))


_PARTS = "pt0 as (select slug, unnest(compose_from).profile as source, unnest(compose_from).weight as weight, unnest(range(0, len(compose_from))) as pos from profiles), pt as (select slug, source, weight from (select *, row_number() over (partition by slug, source order by pos) as rn from pt0 where source <> slug and weight > 0) where rn = 1 and source in (select slug from profiles))"
_SHARES = f"{_PARTS}, cnt as (select voice as source, count(*) as n from u group by voice), sh as (select slug, source, weight, n, weight / sum(weight) over (partition by slug) as share from pt join cnt using (source))"


@query("source_shares", f"{_FP}, {_SHARES} select slug, source, n, {S.r6('share')} as share, {S.r6('weight / n')} as piece_weight from sh")
def source_shares(s, d):
    x = blend.shares(blend.usable_parts(table(s, d, "profiles")), _doc_counts(s, d))
    return x.select("slug", "source", "n", R(F.col("share")).alias("share"), R(F.col("weight") / F.col("n")).alias("piece_weight"))


@query(
    "composite_problems",
    "with " + _PARTS + ", k as (select slug as source, author from profiles) select distinct * from (select slug, 'self' as problem, source from pt0 where source = slug union all select slug, 'repeated', source from pt0 group by all having count(*) > 1 union all select slug, 'unknown', source from pt0 where source not in (select slug from profiles) "
    "union all select slug, 'no store', source from pt0 where source in (select slug from profiles) and source not in (select voice from documents where voice is not null) union all select slug, 'weight', source from pt0 where weight is null or weight <= 0 "
    "union all select slug, 'mixed authors', null from pt0 join k using (source) group by slug having count(distinct author) > 1)",
)
def composite_problems(s, d):
    return blend.problems(table(s, d, "profiles"), table(s, d, "documents").where("voice is not null").select("voice"))


@query(
    "composite_scrub",
    f"{_FP}, {_SHARES}, p0 as (select voice, {_SLEN} as l, {S.n_found('text', P.HEDGES_SOFT)} as h from documents where text is not null and voice is not null), p1 as (select voice, {S.sd('l')} as b, list_avg(l) as m, h * 200.0::double / list_sum(l) as h from p0 where len(l) >= 3), "
    f"cal as (select voice as source, count(*) as np, {_even('b', '0.05')} as b, {_even('h', '0.95')} as h, {_even('m', '0.5')} as m from p1 group by voice) select slug, sum(np)::bigint as n_pieces, {S.r6('sum(b * share)')} as burstiness_floor, {S.r6('sum(h * share)')} as hedge_ceiling, {S.r6('sum(m * share)')} as mean_sentence_len from sh join cal using (source) group by slug",
)
def composite_scrub(s, d):
    sh = blend.shares(blend.usable_parts(table(s, d, "profiles")), _doc_counts(s, d))
    x = blend.blended_scrub(rules.scrub_calibration(table(s, d, "documents")), sh)
    return x.select("slug", "n_pieces", *(R(F.col(k)).alias(k) for k in ("burstiness_floor", "hedge_ceiling", "mean_sentence_len")))


_BANNED = f"bw as (select a.voice as source, v.word, coalesce(uses, 0) < 3 as banned from (select distinct voice from documents where voice is not null and text is not null) a cross join {_TESTED} left join (select voice, word, count(*) as uses from (select voice, unnest({S.w2('lower(text)')}) as word, len({_SLEN}) as k from documents where text is not null and voice is not null) where k >= 3 group by all) u on u.voice = a.voice and u.word = v.word)"


@query("composite_banlist", f"{_FP}, {_SHARES}, {_BANNED} select slug, word from sh join bw using (source) group by slug, word having bool_and(banned)")
def composite_banlist(s, d):
    sh = blend.shares(blend.usable_parts(table(s, d, "profiles")), _doc_counts(s, d))
    return blend.blended_banlist(rules.banlists(table(s, d, "documents").where("text is not null"), _WORDS_TESTED), sh)


_WCU = ", ".join(f"sum(wt * {f}) / sum(wt) as {f}_m" for f in P.SURFACE)
_WSU = ", ".join(f"sqrt(sum(wt * pow({f} - {f}_m, 2)) / sum(wt)) as {f}_s" for f in P.SURFACE)


@query(
    "composite_fingerprint",
    f"{_FP}, {_SHARES}, cu as (select slug, weight / sh.n as wt, {', '.join('u.' + f for f in P.SURFACE)} from u join sh on sh.source = u.voice), cm as (select slug, count(*) as n_pieces, {_WCU} from cu group by slug having count(*) >= 5), cs as (select slug, {_WSU} from cu join cm using (slug) group by slug), l as ("
    + " union all ".join(f"select slug, n_pieces, '{f}' as feature, {f}_m as m, {f}_s as sd from cm join cs using (slug)" for f in P.SURFACE)
    + f") select slug, n_pieces, feature, {S.r6('m')} as mean, {S.r6('sd')} as std from l",
)
def composite_fingerprint(s, d):
    u = calibration_units(s, d)
    sh = blend.shares(blend.usable_parts(table(s, d, "profiles")), u.groupBy(F.col("voice").alias("source")).agg(F.count("*").alias("n")))
    fp = C.weighted_fingerprint(blend.weighted_units(u, sh), by="slug")
    return C.fingerprint_long(fp, by="slug").select("slug", "n_pieces", "feature", R(F.col("mean")).alias("mean"), R(F.col("std")).alias("std"))


@query(
    "blended_anchors",
    f"{_BM25}, {_FP.removeprefix('with ')}, {_SHARES}, bk as (select sc.query_id, sc.id, sh.slug, sh.source, sh.share, row_number() over (partition by sc.query_id, sh.source order by round(score, 9), sc.id) as rank from sc join briefs bf on bf.id = sc.query_id join documents dc on dc.doc_id = sc.id join sh on sh.slug = bf.voice and sh.source = dc.voice), "
    "al as (select *, greatest(case when share >= 0.05 then 1 else 0 end, round_even(share * 6, 0)::int) as slots from bk), pl as (select *, row_number() over (partition by query_id order by rank, share desc, source) as place from al where rank <= slots) select query_id, id, source, place from pl where place <= 6",
)
def blended_anchors(s, d):
    """Six anchors per brief of a composite voice, from its parts' documents by keyword rank and share."""
    sh = blend.shares(blend.usable_parts(table(s, d, "profiles")), _doc_counts(s, d))
    b = table(s, d, "briefs").where("voice is not null").select(F.col("id").alias("query_id"), F.col("voice").alias("slug"))
    docs = table(s, d, "documents").where("voice is not null").select(F.col("doc_id").alias("id"), F.col("voice").alias("source"))
    x = brief_bm25(s, d).join(b, "query_id").join(docs, "id").join(sh.select("slug", "source", "share"), ["slug", "source"])
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "source").orderBy(F.round("score", 9), "id")))
    return retrieve.blended(x.where("rank <= 6"), 6).select("query_id", "id", "source", F.col("place").cast("long").alias("place"))


# --- slates ---


def first_rows(c):
    """One row per cand_id: of repeated rows, whose scores may differ, the earliest, then the one of the lowest rmsz."""
    w = Window.partitionBy("cand_id").orderBy(F.col("created_at").asc_nulls_last(), F.col("rmsz").asc_nulls_last())
    return c.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "created_at")


def slate(s, d):
    """Distinct drafts with a distance, their number of hard flags, and their voice's threshold and baseline."""
    c = first_rows(table(s, d, "candidates").where("text is not null and voice is not null and rmsz is not null").select("cand_id", "task_id", "cand_idx", "voice", "rmsz", "text", "created_at"))
    return c.select("cand_id", "task_id", "cand_idx", "voice", "rmsz", F.size(fidelity.hard_flags(F.col("text"))).alias("n_flags"))


_FLAGS = (
    f"(case when {S.n_found('regexp_replace(text, ' + S.rx(P.RULE_LINE) + ', ' + S.lit('') + ', ' + S.lit('g') + ')', P.DASH_RUN)} > 0 then 1 else 0 end + case when len(list_filter([" + ", ".join(S.lit(p) for p in P.TELL_PHRASES) + f"], lambda p: contains(lower(text), p))) > 0 then 1 else 0 end + case when {S.n_found('text', P.LEAKAGE)} > 0 then 1 else 0 end)"
)
_SLATE = f"{_CAND.replace('text is not null and voice is not null', 'text is not null and voice is not null and rmsz is not null')}, sl as (select cand_id, task_id, cand_idx, voice, rmsz, {_FLAGS} as n_flags from c0)"


@query("gate_survivors", f"{_LOO}, {_SLATE} select cand_id, {S.r6('rmsz')} as rmsz, {S.r6('coalesce(p.max_rmsz, b.fit_threshold)')} as rmsz_max from sl left join base b using (voice) left join profiles p on p.slug = sl.voice where rmsz <= coalesce(p.max_rmsz, b.fit_threshold)")
def gate_survivors(s, d):
    """Drafts within their profile's limit, or within the voice's 95th percentile where the profile sets none."""
    base = C.baselines(C.leave_one_out(calibration_units(s, d))).drop("n_pieces")
    p = table(s, d, "profiles").select(F.col("slug").alias("voice"), F.coalesce(F.col("max_rmsz").cast("string"), F.lit("auto")).alias("setting"))
    x = slate(s, d).join(p, "voice", "left").join(base, "voice", "left").withColumn("limit", gate.threshold(F.coalesce("setting", F.lit("auto")), F.col("fit_threshold"), F.col("self_baseline")))
    return gate.survivors(x, F.col("limit")).select("cand_id", R(F.col("rmsz")).alias("rmsz"), R(F.col("limit")).alias("rmsz_max"))


@query("pareto_front", f"with {_SLATE} select cand_id, task_id, n_flags from sl a where not exists (select 1 from sl b where b.task_id = a.task_id and b.rmsz <= a.rmsz and b.n_flags <= a.n_flags and (b.rmsz < a.rmsz or b.n_flags < a.n_flags))")
def pareto_front(s, d):
    return gate.pareto_front(slate(s, d)).select("cand_id", "task_id", "n_flags")


@query("least_bad", f"{_LOO}, {_SLATE}, r as (select cand_id, task_id, row_number() over (partition by task_id order by n_flags, case when b.self_baseline > 0 then abs(rmsz - b.self_baseline) else rmsz end, cand_idx) as rn from sl left join base b using (voice)) select task_id, cand_id from r where rn = 1")
def least_bad(s, d):
    base = C.baselines(C.leave_one_out(calibration_units(s, d))).select("voice", "self_baseline")
    x = slate(s, d).join(base, "voice", "left")
    return gate.least_bad(x, F.coalesce("self_baseline", F.lit(0.0)), hard="n_flags", mode="band").select("task_id", "cand_id")


@query(
    "slate_spread",
    f"{_FP}, {_CAND}, {_CANDF}, zz as (select x.task_id, x.cand_id, [{', '.join(S.z(f) for f in P.SURFACE)}] as v from cf x join fp y using (voice)), n as (select task_id, count(*) as n_units from zz group by task_id), "
    f"pr as (select a.task_id, avg(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda q: pow(q[1] - q[2], 2))) / {len(P.SURFACE)}.0)) as spread from zz a join zz b on a.task_id = b.task_id and a.cand_id < b.cand_id group by a.task_id) select task_id, n_units, {S.r6('coalesce(spread, 0.0)')} as spread from n left join pr using (task_id)",
)
def slate_spread(s, d):
    z = C.with_distance(candidate_units(s, d), C.fingerprint(calibration_units(s, d)))
    return gate.slate_spread(z, P.SURFACE, order="cand_id").select("task_id", "n_units", R(F.col("spread")).alias("spread"))


_SMP = f"smp as (select * from (select *, row_number() over (partition by voice order by md5(doc_id::varchar), doc_id) as rn from u) where rn <= {P.SPREAD_SAMPLE}), sst as (select voice, count(*) as n_units, {_STATS} from smp group by voice), csp as (select y.voice, coalesce(avg({_PAIR}), 0.0) as corpus_spread from sst y left join smp a on a.voice = y.voice left join smp b on b.voice = y.voice and a.rn < b.rn where b.rn is not null or y.n_units = 1 group by y.voice)"
_SLATES = (
    f"zz as (select x.task_id, x.cand_id, x.voice, [{', '.join(S.z(f) for f in P.SURFACE)}] as v from cf x join fp y using (voice)), nn as (select task_id, count(*) as n_units, min(voice) as voice from zz group by task_id), "
    f"pr as (select a.task_id, avg(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda q: pow(q[1] - q[2], 2))) / {len(P.SURFACE)}.0)) as spread from zz a join zz b on a.task_id = b.task_id and a.cand_id < b.cand_id group by a.task_id), sp as (select nn.task_id, n_units, voice, coalesce(spread, 0.0) as spread from nn left join pr using (task_id))"
)


@query("slate_collapse", f"{_FP}, {_SMP}, {_CAND}, {_CANDF}, {_SLATES} select task_id, n_units, {S.r6('spread')} as spread, {S.r6('spread / nullif(corpus_spread, 0)')} as ratio, corpus_spread > 0 and spread < corpus_spread * 0.5 as collapsed from sp join csp using (voice)")
def slate_collapse(s, d):
    """Slates that spread less than half as wide as their voice's documents."""
    u = calibration_units(s, d)
    z = C.with_distance(candidate_units(s, d), C.fingerprint(u))
    voice = z.groupBy("task_id").agg(F.min("voice").alias("voice"))
    own = C.corpus_spread(u, "doc_id").select("voice", F.col("spread").alias("corpus_spread"))
    x = gate.slate_spread(z, P.SURFACE).join(voice, "task_id").join(own, "voice")
    return x.select("task_id", "n_units", R(F.col("spread")).alias("spread"), R(F.try_divide("spread", "corpus_spread")).alias("ratio"), gate.collapsed(F.col("spread"), F.col("corpus_spread")).alias("collapsed"))


_LINES = f"""list_filter([case when dashes > 0 then 'HIGH dashes: ' || dashes::varchar end, case when len(bp) > 0 then 'HIGH phrases: ' || array_to_string(bp, ', ') end,
case when len(bw) > 0 then 'HIGH words: ' || array_to_string(bw, ', ') end, case when hedges > 2 then 'MEDIUM hedges' end], lambda x: x is not null)"""


@query(
    "scrub_report",
    f"with {_CAND}, x as (select cand_id, {S.n_found('regexp_replace(text, ' + S.rx(P.RULE_LINE) + ', ' + S.lit('') + ', ' + S.lit('g') + ')', P.DASH_RUN)} as dashes, list_filter({_PHRASES}, lambda p: contains(lower(text), p)) as bp, list_sort(list_filter({_TELLS}, lambda w: list_contains({S.found('lower(text)', P.WORD_PLAIN)}, w))) as bw, {S.n_found('text', P.HEDGES_SOFT)} * 200.0::double / nullif(len({S.w2('text')}), 0) as hedges from c0) "
    f"select cand_id, case when len({_LINES}) = 0 then 'CLEAN' else array_to_string({_LINES}, chr(10)) end as report from x",
)
def scrub_report(s, d):
    """The findings of every draft as lines of text."""
    t = F.col("text")
    x = drafts(s, d).select("cand_id", rules.plain_dashes(t).alias("dashes"), rules.banned_phrases(t).alias("bp"), rules.banned_words(t).alias("bw"), rules.hedges_per_200(t).alias("hedges"))
    lines = F.array_compact(F.array(
        F.when(F.col("dashes") > 0, F.concat(F.lit("HIGH dashes: "), F.col("dashes").cast("string"))),
        F.when(F.size("bp") > 0, F.concat(F.lit("HIGH phrases: "), F.array_join("bp", ", "))),
        F.when(F.size("bw") > 0, F.concat(F.lit("HIGH words: "), F.array_join("bw", ", "))),
        F.when(F.col("hedges") > 2, F.lit("MEDIUM hedges")),
    ))
    return x.select("cand_id", F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise("CLEAN").alias("report"))


_PF = f"pfl as (select voice, {', '.join(f'round(greatest({_even(k, "0.25")}, {v}), 3) + 0.0 as {k}_floor' for k, v in P.FIELD_FLOOR.items())} from (select voice, {', '.join(f'{S.n_found("text", p)} * 1000.0::double / {_WORDN} as {k}' for k, p in P.PRESENCE.items())} from documents where text is not null and voice is not null and len({S.w2('text')}) >= {P.ABSENCE_WORDS}) group by voice)"
_GATED = list(P.FIELD_FLOOR)
_ABSENT = f"case when n >= {P.DENSITY_WORDS} then list_filter([{', '.join(f'case when {k} = 0 then {S.lit(k)} end' for k in _GATED)}], lambda x: x is not null) when n >= {P.ABSENCE_WORDS} and {' + '.join(P.PRESENCE)} < {P.ABSENCE_TOTAL} then [{', '.join(S.lit(k) for k in _GATED)}] else [] end"
_MISSED = f"case when n >= {P.DENSITY_WORDS} then list_transform(list_sort(list_filter([{', '.join(f'case when {k} < {k}_floor then {{{chr(39)}gap{chr(39)}: {k} - {k}_floor, {chr(39)}i{chr(39)}: {i}, {chr(39)}k{chr(39)}: {S.lit(k)}}} end' for i, k in enumerate(_GATED))}], lambda x: x is not null)), lambda z: z.k) else [] end"


@query(
    "presence_states",
    f"with {_CAND}, {_PF}, pd as (select cand_id, voice, len({S.w2('text')}) as n, {', '.join(f'{S.n_found("text", p)} * 1000.0::double / {_WORDN} as {k}' for k, p in P.PRESENCE.items())} from c0), px as (select pd.*, {', '.join(f'coalesce({k}_floor, {v}) as {k}_floor' for k, v in P.FIELD_FLOOR.items())} from pd left join pfl using (voice)) "
    f"select cand_id, n >= {P.ABSENCE_WORDS} as measurable, array_to_string({_ABSENT}, '|') as absent, array_to_string({_MISSED}, '|') as missed, n >= {P.ABSENCE_WORDS} and epistemic = 0 and expectation = 0 as presence_missing from px",
)
def presence_states(s, d):
    """Every draft against its voice's presence floors: measurable, absent classes, missed floors."""
    t = F.col("text")
    cal = rules.presence_calibration(table(s, d, "documents")).select("voice", *(f"{k}_floor" for k in P.FIELD_FLOOR))
    x = drafts(s, d).select("cand_id", "voice", F.size(T.words_unicode(t)).alias("n"), *(c.alias(k) for k, c in rules.presence_columns(t).items())).join(cal, "voice", "left")
    st = rules.presence_state(F.col("n"), {k: F.coalesce(f"{k}_floor", F.lit(v)) for k, v in P.FIELD_FLOOR.items()})
    return x.select("cand_id", st["measurable"].alias("measurable"), F.array_join(st["absent"], "|").alias("absent"), F.array_join(st["missed"], "|").alias("missed"), st["presence_missing"].alias("presence_missing"))


_TOP3 = "r as (select qa as query_id, qb as id, sim, row_number() over (partition by qa order by round(sim, 9) desc, qb) as rank from sm {where}) select query_id, id, rank, " + S.r6("sim") + " as sim from r where rank <= 3"


@query(
    "transform_demos",
    f"with ed as (select distinct id, ai_text, human_text from edit_pairs where ai_text is not null and human_text is not null), {S.encoded_cte('ed', 'id', 'human_text', 'ee')}, {S.encoded_cte('briefs', 'id', 'task', 'eb')}, {S.encoded_sims('eb', 'id', 'ee', 'id', 'sm')}, {_TOP3.format(where='')}",
)
def transform_demos(s, d):
    """The three edits whose human side is closest to each brief."""
    e = edits(s, d).select("id", retrieve.encode(F.col("human_text")).alias("vec"))
    q = table(s, d, "briefs").where("task is not null").select(F.col("id").alias("query_id"), retrieve.encode(F.col("task")).alias("vec"))
    return _three(retrieve.vector_topk(e, q, 12))


def _three(x):
    """The three of the highest similarity to 9 places, ties to the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.round("sim", 9).desc(), "id")
    return x.drop("rank").withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3").select("query_id", "id", "rank", R(F.col("sim")).alias("sim"))


@query(
    "nearest_pieces",
    f"with qd as (select doc_id, text from documents where doc_id % 20 = 0), {S.encoded_cte('documents', 'doc_id', 'text', 'ed')}, {S.encoded_cte('qd', 'doc_id', 'text', 'eq')}, {S.encoded_sims('eq', 'doc_id', 'ed', 'doc_id', 'sm')}, {_TOP3.format(where='where qa <> qb')}",
)
def nearest_pieces(s, d):
    """The three documents closest to every document whose id is divisible by 20, itself left out."""
    v = table(s, d, "documents").where("text is not null").select("doc_id", retrieve.encode(F.col("text")).alias("vec"))
    q = v.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    return _three(retrieve.vector_topk(v, q, 16, "doc_id").where("query_id <> id"))


# --- evaluation ---

_ONE = "one as (select * from (select *, row_number() over (partition by cand_id order by created_at, rmsz) as k from candidates) where k = 1)"


def scored(s, d):
    c = first_rows(table(s, d, "candidates").select("cand_id", "task_id", "cand_idx", "voice", "rmsz", "detector_score", "emdash_fixed", "created_at"))
    return c.withColumn("machine", F.col("emdash_fixed") > 0)


@query(
    "auroc_by_label",
    f"with {_ONE}, h as (select voice, detector_score as s from one where emdash_fixed <= 0 and detector_score is not null and voice is not null), a as (select voice, detector_score as s from one where emdash_fixed > 0 and detector_score is not null and voice is not null), "
    f"n as (select voice, count_if(emdash_fixed > 0)::bigint as n_pos, count_if(emdash_fixed <= 0)::bigint as n_neg from one where detector_score is not null and voice is not null and emdash_fixed is not null group by voice), w as (select a.voice, sum(case when a.s < h.s then 1.0 when a.s = h.s then 0.5 else 0.0 end) / count(*) as auc from a join h using (voice) group by a.voice) "
    f"select n.voice, n_pos, n_neg, {S.r6('coalesce(auc, 0.5)')} as auroc from n left join w using (voice)",
)
def auroc_by_label(s, d):
    x = evalstats.auroc(scored(s, d).where("voice is not null"), "machine", "detector_score", "voice")
    return x.select("voice", "n_pos", "n_neg", R(F.col("auroc")).alias("auroc"))


_PCT = lambda p: f"list_sort(list(s) filter (where not m))[round_even({p} * (count(*) filter (where not m) - 1), 0)::int + 1]"


@query(
    "detector_threshold",
    f"with {_ONE}, x as (select voice, emdash_fixed > 0 as m, detector_score as s from one where detector_score is not null and voice is not null and emdash_fixed is not null), "
    f"g as (select voice, count_if(not m)::bigint as n_human, count_if(m)::bigint as n_ai, avg(s) filter (where not m) as hm, coalesce(stddev_samp(s) filter (where not m), 0.0) as hs, avg(s) filter (where m) as am, coalesce(stddev_samp(s) filter (where m), 0.0) as sa, {_PCT('0.05')} as low, {_PCT('0.95')} as high from x group by voice having count_if(not m) >= 3 and count_if(m) >= 3), "
    "w as (select a.voice, sum(case when a.s < h.s then 1.0 when a.s = h.s then 0.5 else 0.0 end) / count(*) as auc from x a join x h on a.voice = h.voice and a.m and not h.m group by a.voice) "
    "select voice, n_human, n_ai, round(case when auc >= 0.5 then low else high end, 5) + 0.0 as threshold, case when auc >= 0.5 then 'low_is_machine' else 'high_is_machine' end as direction, round(greatest(auc, 1 - auc), 4) + 0.0 as auroc, round(round(hm, 12), 5) + 0.0 as human_mean, round(round(hs, 12), 5) + 0.0 as human_stdev, round(round(am, 12), 5) + 0.0 as ai_mean, round(round(sa, 12), 5) + 0.0 as ai_stdev from g join w using (voice)",
)
def detector_threshold(s, d):
    return evalstats.detector_threshold(scored(s, d).where("voice is not null and machine is not null"), "machine", "detector_score", "voice", fpr=0.05)


_THRESHOLDS = (
    f"dx as (select voice, emdash_fixed > 0 as m, detector_score as s from one where detector_score is not null and voice is not null and emdash_fixed is not null), "
    f"dg as (select voice, {_PCT('0.05')} as low, {_PCT('0.95')} as high from dx group by voice having count_if(not m) >= 3 and count_if(m) >= 3), "
    "dw as (select a.voice, sum(case when a.s < h.s then 1.0 when a.s = h.s then 0.5 else 0.0 end) / count(*) as auc from dx a join dx h on a.voice = h.voice and a.m and not h.m group by a.voice), "
    "dt as (select voice, round(case when auc >= 0.5 then low else high end, 5) as threshold, auc >= 0.5 as low_is_machine from dg join dw using (voice))"
)


@query(
    "detector_labels",
    f"with {_ONE}, {_THRESHOLDS}, tk as (select cand_id, max(coalesce(len({S.tok('text')}), 0)) as n from candidates group by cand_id) select one.cand_id, case when n < 48 or detector_score is null or threshold is null then 'uncertain' when case when low_is_machine then detector_score < threshold else detector_score > threshold end then 'machine' else 'human' end as label from one join tk using (cand_id) left join dt using (voice)",
)
def detector_labels(s, d):
    x = scored(s, d)
    t = evalstats.detector_threshold(x.where("voice is not null and machine is not null"), "machine", "detector_score", "voice", fpr=0.05).select("voice", "threshold", "direction")
    n = table(s, d, "candidates").select("cand_id", F.coalesce(F.size(T.tokens(F.col("text"))), F.lit(0)).alias("n_tokens")).dropDuplicates(["cand_id"])
    return x.join(n, "cand_id").join(t, "voice", "left").select("cand_id", evalstats.detector_label(F.col("detector_score"), F.col("n_tokens"), F.col("threshold"), F.col("direction")).alias("label"))


@query(
    "ab_sign_test",
    f"with {_ONE}, d as (select a.voice, b.rmsz - a.rmsz as delta from one a join one b on a.task_id = b.task_id and a.cand_idx = 0 and b.cand_idx = 1 where a.voice is not null and a.rmsz is not null and b.rmsz is not null), g as (select voice, count_if(delta < 0)::bigint as improved, count(*) as n from d group by voice) "
    f"select voice, improved, n, {S.r6('least(1.0, 2 * list_sum(list_transform(range(0, (least(improved, n - improved) + 1)::bigint), lambda k: exp(lgamma((n + 1)::double) - lgamma((k + 1)::double) - lgamma((n - k + 1)::double) - n * ln(2)))))')} as p from g",
)
def ab_sign_test(s, d):
    c = scored(s, d)
    a = c.where("cand_idx = 0").select("task_id", "voice", F.col("rmsz").alias("a"))
    b = c.where("cand_idx = 1").select("task_id", F.col("rmsz").alias("b"))
    x = a.join(b, "task_id").where("voice is not null").select("voice", (F.col("b") - F.col("a")).alias("delta"))
    return evalstats.sign_test(x, ["voice"]).select("voice", "improved", "n", R(F.col("p")).alias("p"))


@query(
    "config_rollup",
    f"with {_ONE} select voice, cand_idx, count(*) as n, round(avg(rmsz), 9) as mean_rmsz, {S.r6('coalesce(stddev_samp(rmsz), 0.0)')} as sd_rmsz, {S.r6('count_if(detector_score < 0.9) / nullif(count(detector_score), 0)::double')} as machine_share from one where voice is not null group by voice, cand_idx",
)
def config_rollup(s, d):
    x = scored(s, d).where("voice is not null")
    m = F.sum(F.when(F.col("detector_score") < 0.9, 1).otherwise(0)) / F.nullif(F.count("detector_score"), F.lit(0))
    return x.groupBy("voice", "cand_idx").agg(F.count("*").alias("n"), R(F.avg("rmsz"), 9).alias("mean_rmsz"), R(F.coalesce(F.stddev_samp("rmsz"), F.lit(0.0))).alias("sd_rmsz"), R(m).alias("machine_share"))


_NO_LOOK = f"list_transform(string_split(regexp_replace(text, {S._MARK}, '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda q: len({S.w1('q')}))"
_PM = {
    "emdash_per_100w": f"({S.n_found('text', '—')} + {S.n_found('text', '--')}) * 100.0::double / n",
    "md_structure_per_1kw": f"({S.n_found('text', P.BOLD_HEADER)} + {S.n_found('text', P.BULLET)}) * 1000.0::double / n",
    "tricolon_per_1kw": f"{S.n_found('text', P.TRICOLON)} * 1000.0::double / n",
    "para_cv": "coalesce(" + S.sd("pl") + " / nullif(list_avg(pl), 0), 0.0)",
    "sent_cv": "coalesce(" + S.sd("sl") + " / nullif(list_avg(sl), 0), 0.0)",
}


@query(
    "corpus_purity",
    f"with p as (select doc_id, voice, text, len({S.w1('text')}) as n, list_filter({_NO_LOOK}, lambda v: v > 0) as sl, list_transform({S.paras('text')}, lambda q: len({S.w1('q')})) as pl from documents where text is not null and voice is not null), "
    f"m as (select doc_id, voice, {', '.join(f'{v} as {k}' for k, v in _PM.items())}, {S.n_found('text', P.PLACEHOLDER)} as ph from p where n >= 200), st as (select voice, {', '.join(f'avg({k}) as {k}_m, coalesce(stddev_samp({k}), 0.0) as {k}_s' for k in _PM)} from m group by voice having count(*) >= 8), "
    f"z as (select voice, doc_id, ph * 10.0 + {' + '.join(f'greatest(0.0, case when {k}_s > 1e-9 then ({k} - {k}_m) / {k}_s else 0.0 end * {P.PURITY[k]})' for k in _PM)} as susp from m join st using (voice)), r as (select *, row_number() over (partition by voice order by round(susp, 9) desc, doc_id) as rank from z) select voice, doc_id, rank, {S.r6('susp')} as suspicion from r where rank <= 6",
)
def corpus_purity(s, d):
    x = evalstats.purity_outliers(table(s, d, "documents"), "doc_id")
    return x.select("voice", "doc_id", F.col("rank").cast("long").alias("rank"), R(F.col("suspicion")).alias("suspicion"))


# --- sources, logs ---


@query(
    "import_dedupe",
    "with h as (select doc_id, coalesce(source, 'unknown') as source, text, sha256(text) as sha from documents where text is not null), f as (select min(doc_id) as doc_id, sha from h group by sha), k as (select h.doc_id, h.source, h.sha from h join f using (doc_id, sha) where sha not in (select sha256(text) from accepted_log where text is not null)), "
    "n as (select *, row_number() over (partition by source order by doc_id) as n from k) select doc_id, case when n > 1 then source || '-' || n::varchar else source end as import_name, sha from n",
)
def import_dedupe(s, d):
    docs = table(s, d, "documents").where("text is not null").select("doc_id", F.coalesce("source", F.lit("unknown")).alias("source"), "text")
    stored = table(s, d, "accepted_log").where("text is not null").select(F.sha2("text", 256).alias("sha"))
    return io.import_documents(docs, stored, "doc_id", "source", "text").select("doc_id", "import_name", "sha")


@query(
    "import_report",
    f"with n as (select source, doc_id, len({S.tok('text')}) as words from documents where text is not null and source is not null), r as (select *, row_number() over (partition by source order by words desc, doc_id) as rn from n) select source, count(*) as docs, sum(words)::bigint as words, string_agg(doc_id::varchar, '|' order by rn) filter (where rn <= 3) as top3, sum(words) < 20000 as thin, max(words) > sum(words) * 0.5 as dominated from r group by source",
)
def import_report(s, d):
    x = table(s, d, "documents").where("text is not null and source is not null").select("source", "doc_id", F.size(T.tokens(F.col("text"))).alias("words"))
    total = x.groupBy("source").agg(F.count("*").alias("docs"), F.sum("words").alias("words"), F.max("words").alias("most"))
    w = Window.partitionBy("source").orderBy(F.col("words").desc(), "doc_id")
    top = x.withColumn("rn", F.row_number().over(w)).where("rn <= 3").groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "doc_id"))), lambda r: r["doc_id"].cast("string")), "|").alias("top3"))
    return total.join(top, "source").select("source", "docs", "words", "top3", (F.col("words") < 20000).alias("thin"), (F.col("most") > F.col("words") * 0.5).alias("dominated"))


@query("corpus_hash", "with h as (select distinct id, filename, sha256(text) as h from chunks where text is not null and filename is not null) select filename, sha256(string_agg(id || ':' || h, chr(10) order by lower(id), id, h)) as corpus_hash from h group by filename")
def corpus_hash(s, d):
    x = table(s, d, "chunks").where("text is not null and filename is not null").select("id", "filename", F.encode("text", "UTF-8").alias("content")).distinct()
    return io.corpus_hash(x, "filename", "id", "content")


@query("pending_tasks", "select distinct task_id from candidates where task_id is not null and task_id not in (select task from accepted_log where task is not null)")
def pending_tasks(s, d):
    jobs = table(s, d, "candidates").where("task_id is not null").select("task_id").distinct()
    ledger = table(s, d, "accepted_log").where("task is not null").select(F.col("task").alias("task_id"), F.lit("ok").alias("status"))
    return io.pending(jobs, ledger, "task_id")


@query(
    "event_trail",
    "select coalesce(source, 'none') as source, voice, count(*) as n, count(distinct substr(sha1(text), 1, 12)) as texts, max(seq) as last_seq from (select distinct id, voice, text, source, seq from accepted_log) where text is not null group by all",
)
def event_trail(s, d):
    x = table(s, d, "accepted_log").select("id", "voice", "text", "source", "seq").distinct().where("text is not null")
    x = x.withColumn("event", feedback.event("accept", F.col("text")))
    sha = F.col("event.text_sha")
    return x.groupBy(F.coalesce("source", F.lit("none")).alias("source"), "voice").agg(F.count("*").alias("n"), F.count_distinct(sha).alias("texts"), F.max("seq").alias("last_seq"))


@query("accepted_numbers", "with o as (select voice, seq, min(id) as id from accepted_log where voice is not null group by all) select voice, seq, 'acc_' || lpad((row_number() over (partition by voice order by seq))::varchar, 3, '0') as acc_id from o")
def accepted_numbers(s, d):
    return feedback.accepted_ids(table(s, d, "accepted_log").where("voice is not null").select("voice", "seq")).select("voice", "seq", "acc_id")


@query("edit_kinds", "select granularity, move, count(distinct id) as pairs, count(distinct task) as tasks from edit_pairs where coalesce(trim(ai_text), '') <> '' and coalesce(trim(human_text), '') <> '' group by all")
def edit_kinds(s, d):
    x = table(s, d, "edit_pairs").where("coalesce(trim(ai_text), '') <> '' and coalesce(trim(human_text), '') <> ''")
    return x.groupBy("granularity", "move").agg(F.count_distinct("id").alias("pairs"), F.count_distinct("task").alias("tasks"))


@query(
    "profile_listing",
    "with c as (select voice, count(*) as docs from documents where voice is not null group by voice) select slug, coalesce(author, 'unknown') as author, coalesce(feature_set, 'v1') as feature_set, coalesce(max_rmsz::varchar, 'auto') as gate, len(compose_from) > 0 as composite, coalesce(docs, 0) as docs from profiles left join c on c.voice = slug",
)
def profile_listing(s, d):
    n = table(s, d, "documents").where("voice is not null").groupBy(F.col("voice").alias("slug")).agg(F.count("*").alias("docs"))
    p = table(s, d, "profiles").join(n, "slug", "left")
    return p.select("slug", F.coalesce("author", F.lit("unknown")).alias("author"), F.coalesce("feature_set", F.lit("v1")).alias("feature_set"), F.coalesce(F.col("max_rmsz").cast("string"), F.lit("auto")).alias("gate"), (F.size("compose_from") > 0).alias("composite"), F.coalesce("docs", F.lit(0)).alias("docs"))


@query("doctor", f"{_LOO} select b.voice, b.n_pieces, case when b.n_pieces < 39 then 'thin' else 'ok' end as density, case when p.max_rmsz < 0.75 * b.fit_threshold then 'tight' else 'ok' end as gate from base b left join profiles p on p.slug = b.voice")
def doctor(s, d):
    base = C.baselines(C.leave_one_out(calibration_units(s, d)))
    p = table(s, d, "profiles").select(F.col("slug").alias("voice"), "max_rmsz")
    x = base.join(p, "voice", "left")
    return x.select("voice", "n_pieces", F.when(F.col("n_pieces") < 3 * len(P.SURFACE), "thin").otherwise("ok").alias("density"), F.when(F.col("max_rmsz") < F.col("fit_threshold") * 0.75, "tight").otherwise("ok").alias("gate"))


@query("slugs", "select distinct source, case when regexp_replace(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') = '' then 'profile' else regexp_replace(substr(regexp_replace(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40), '-+$', '') end as slug from documents where source is not null")
def slugs(s, d):
    return table(s, d, "documents").where("source is not null").select("source").distinct().select("source", chunking.slug(F.col("source")).alias("slug"))


@query("streamed_scores", f"{_LOO}, {_CAND}, {_CANDF}, cd as (select x.cand_id, x.voice, {S.rms()} as rmsz from cf x join fp y using (voice)) select cand_id, voice, {S.r6('rmsz')} as rmsz, {_fit('rmsz')} as fit from cd join base using (voice)")
def streamed_scores(s, d):
    """Drafts scored as a stream against static calibrations, to a table in the shared folder."""
    u = calibration_units(s, d)
    fp, base = C.fingerprint(u), C.baselines(C.leave_one_out(u))
    src = table(s, d, "candidates").select("cand_id", "voice", "text", "created_at")
    root = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    arrivals = s.readStream.schema(src.schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/candidates.parquet") if _is_dir(s, f"{d}/candidates.parquet") else s.readStream.schema(src.schema).option("pathGlobFilter", "candidates.parquet").parquet(d)
    x = arrivals.where("text is not null and voice is not null").withColumn("created_at", F.coalesce("created_at", F.current_timestamp()))
    x = x.withWatermark("created_at", "7 days").dropDuplicatesWithinWatermark(["cand_id"])  # repeats may come for a week; older keys leave the state
    scorer.run_once(scorer.score_stream(x, fp, base), f"{root}/out", f"{root}/state")
    return s.read.parquet(f"{root}/out").select("cand_id", "voice", R(F.col("rmsz")).alias("rmsz"), "fit")


def _is_dir(s, path: str) -> bool:
    jvm = s.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
