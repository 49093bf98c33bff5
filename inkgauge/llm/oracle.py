"""SQL of the queries here that DuckDB can express on whole tables, by definition rather than by method."""

# a token is a run between white space as Python's str.split() sees it
_TOKEN = r"'[^\x{0009}-\x{000d}\x{001c}-\x{0020}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'"
_WORD = r"'[\p{L}\p{N}_]+'"

# every run of 30 tokens of a record, its place, and whether it stands in another origin; runs of places make the maximal spans
_SPANS = f"""
r as (select distinct id as rec_id, coalesce(filename, chr(0)) as origin, text from chunks where id is not null and text is not null
  union select distinct cand_id, coalesce(task_id, chr(0)), text from candidates where cand_id is not null and text is not null),
t as (select rec_id, origin, regexp_extract_all(text, {_TOKEN}) as w from r),
g as (select rec_id, origin, unnest(range(0, len(w) - 29)) as pos, unnest(list_transform(range(1, len(w) - 28), lambda k: array_to_string(w[k:k + 29], ' '))) as gram from t where len(w) >= 30),
s as (select gram from g group by gram having count(distinct origin) > 1),
h as (select distinct rec_id, pos from g where gram in (select gram from s)),
i as (select rec_id, pos, pos - row_number() over (partition by rec_id order by pos) as grp from h),
sp as (select rec_id, min(pos) as start, max(pos) - min(pos) + 30 as n_tokens from i group by rec_id, grp)"""

SQL: dict[str, str] = {
    "p3_found": f"select distinct id from chunks where text is not null and id is not null and len(regexp_extract_all(text, {_TOKEN})) > 350",
    # every run of 30 tokens that stands in two origins
    "p4_found": f"""
with r as (select distinct id as rec_id, coalesce(filename, chr(0)) as origin, text from chunks where id is not null and text is not null
  union select distinct cand_id, coalesce(task_id, chr(0)), text from candidates where cand_id is not null and text is not null),
t as (select rec_id, origin, regexp_extract_all(text, {_TOKEN}) as w from r),
g as (select rec_id, origin, unnest(list_transform(range(1, len(w) - 28), lambda k: array_to_string(w[k:k + 29], ' '))) as gram from t where len(w) >= 30),
s as (select gram from g group by gram having count(distinct origin) > 1)
select distinct rec_id from g where gram in (select gram from s)
""",
    "p4_spans": f"with {_SPANS} select rec_id, start, n_tokens from sp",
    "p4_shared_share": f"with {_SPANS}, c as (select rec_id, count(distinct k) as shared_tokens from (select rec_id, unnest(range(start, start + n_tokens)) as k from sp) group by rec_id), n as (select rec_id, count(*) as n_spans, max(n_tokens) as longest_span from sp group by rec_id), "
    "z as (select rec_id, max(len(w)) as n_tokens from t group by rec_id) select rec_id, n_tokens, shared_tokens, n_spans, longest_span, round(shared_tokens / n_tokens::double, 6) as shared_share from c join n using (rec_id) join z using (rec_id)",
    # every pair of vectors
    "p5_found": """
with v as (select id, any_value(list_transform(embedding, lambda x: x::double)) as e from chunks where id is not null and len(embedding) = 384 group by id),
n as (select id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as e from v where list_dot_product(e, e) > 0),
p as (select a.id as a, b.id as b, list_dot_product(a.e, b.e) as cos from n a join n b on a.id <> b.id),
k as (select *, row_number() over (partition by a order by cos desc, b) as rank from p)
select distinct least(a, b) as id_a, greatest(a, b) as id_b from k where rank <= 5 and cos >= 0.8
""",
    # every run of 13 words, or of all words of a shorter item
    "p8_found": f"""
with i as (select distinct item_id, regexp_extract_all(lower(text), {_WORD}) as w from holdout_items where text is not null),
iw as (select item_id, least(13, len(w)) as n, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda k: array_to_string(w[k:k + least(13, len(w)) - 1], ' '))) as gram from i where len(w) > 0),
sizes as (select distinct n from iw),
d as (select doc_id, regexp_extract_all(lower(text), {_WORD}) as w from documents where text is not null),
dw as (select doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) as gram from d cross join sizes where len(w) >= n)
select distinct doc_id, item_id from dw join iw using (n, gram)
""",
    # every item with an equal run, or whose weighted five-word shingles stand in the document to four fifths
    "p8_leaks": f"""
with i as (select distinct item_id, text, regexp_extract_all(lower(text), {_WORD}) as w from holdout_items where text is not null and item_id is not null), iw as (select * from i where len(w) > 0),
ig as (select distinct item_id, text, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda k: array_to_string(w[k:k + least(5, len(w)) - 1], ' '))) as gram from iw),
wt as (select gram, ln(1 + (select count(*) from iw) / count(*)::double) as weight from ig group by gram), igw as (select item_id, text, gram, weight from ig join wt using (gram)), tot as (select item_id, text, sum(weight) as total from igw group by all),
d as (select distinct doc_id, text as doc, regexp_extract_all(lower(text), {_WORD}) as w from documents where text is not null and doc_id is not null),
dg as (select distinct doc_id, doc, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda k: array_to_string(w[k:k + least(5, len(w)) - 1], ' '))) as gram from d where len(w) > 0),
sh as (select doc_id, item_id, max(part / total) as share from (select doc_id, doc, item_id, text, sum(weight) as part from dg join igw using (gram) group by all) join tot using (item_id, text) group by all),
rw as (select item_id, least(13, len(w)) as n, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda k: array_to_string(w[k:k + least(13, len(w)) - 1], ' '))) as gram from iw), sizes as (select distinct n from rw),
dw as (select doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) as gram from d cross join sizes where len(w) >= n), ru as (select distinct doc_id, item_id from dw join rw using (n, gram))
select coalesce(ru.doc_id, sh.doc_id) as doc_id, coalesce(ru.item_id, sh.item_id) as item_id, ru.doc_id is not null as has_run, round(coalesce(share, 0.0), 6) as item_share from ru full join sh on sh.doc_id = ru.doc_id and sh.item_id = ru.item_id where ru.doc_id is not null or share >= 0.8
""",
}
