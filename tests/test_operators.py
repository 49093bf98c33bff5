"""Operators against small brute-force versions and stated cases."""

import math
import random
import re
import statistics as st

import pytest
from pyspark.sql import functions as F

from inkgauge.functions import patterns as P
from inkgauge.functions import textkit as T
from inkgauge.operators import blend, calibrate, chunking, evalstats, feedback, fidelity, gate, markup, quantiles, retrieve, rules
from inkgauge.operators import features as X


def one(spark, text, col):
    return spark.createDataFrame([(text,)], "text string").select(col.alias("v")).first()["v"]


def texts(spark, rows, cols="id string, text string"):
    return spark.createDataFrame(rows, cols)


def prose(lens, per=5):
    s = [" ".join(["Word"] + ["word"] * (n - 1)) + "." for n in lens]
    return "\n\n".join(" ".join(s[i : i + per]) for i in range(0, len(s), per))


# --- text ---


def test_words_and_sentences(spark):
    t = "It's 3.5 km. She said “No.” He left!\n\nÜber-Tests don't end? “Yes.” 4 more\x0b\x85now."
    assert one(spark, t, T.words_ascii(F.col("text"))) == re.findall(r"[A-Za-z']+", t)
    assert one(spark, t, T.words_unicode(F.col("text"))) == re.findall(r"\b[\w']+\b", t)
    assert one(spark, t, T.tokens(F.col("text"))) == t.split()
    gap = re.compile(r"(?<=[.!?])\s+(?=[\"'“‘(]?[A-Z0-9])")
    want = [s.strip() for p in t.split("\n") if p.strip() for s in gap.split(p.strip()) if s.strip()]
    assert one(spark, t, T.sentences(F.col("text"))) == want
    assert one(spark, "", T.sentences(F.col("text"))) == [] and one(spark, None, T.sentences(F.col("text"))) is None


def test_percentiles(spark, monkeypatch):
    r = random.Random(0)
    specs = {"e5": ("x", "even", 0.05), "e95": ("x", "even", 0.95), "f25": ("x", "floor", 0.25), "c5": ("x", "cut", 0.5), "c9": ("x", "cut", 0.9), "l95": ("x", "linear", 0.95), "l5": ("y", "linear", 0.5)}
    groups = {f"g{n}": [float(r.randrange(30)) for _ in range(n)] for n in (1, 2, 5, 10, 11, 20, 41, 900)} | {"tie": [0.0] * 700 + [1.0]}
    d = spark.createDataFrame([(g, x, -x) for g, v in groups.items() for x in v] + [("none", None, None)], "g string, x double, y double")
    for small in (5000, 100):  # 100: large groups go by intervals
        monkeypatch.setattr(quantiles, "SMALL", small)
        got = {x["g"]: x for x in quantiles.group_quantiles(d, ["g"], specs).collect()}
        assert got["none"]["e5"] is None and set(got) == set(groups) | {"none"}
        for g, v in groups.items():
            s, n = sorted(v), len(v)
            pos = 0.95 * (n - 1)
            lin = s[int(pos)] + (pos - int(pos)) * (s[min(int(pos) + 1, n - 1)] - s[int(pos)])
            want = [s[int(round(0.05 * (n - 1)))], s[int(round(0.95 * (n - 1)))], s[int(0.25 * (n - 1))], s[n // 2], s[min(n - 1, int(n * 0.9))]]
            assert [got[g][k] for k in ("e5", "e95", "f25", "c5", "c9")] == want, g
            assert got[g]["l95"] == pytest.approx(lin) and got[g]["l5"] == pytest.approx(-st.median(v))


# --- features ---


def test_surface_is_blind_to_order_and_cadence_is_not(spark):
    lens = [4, 30] * 20
    d = texts(spark, [("alt", prose(lens)), ("ramp", prose(sorted(lens)))])
    r = {x["id"]: x for x in X.with_features(d, cadence=True).collect()}
    for f in P.SURFACE:
        assert r["alt"][f] == pytest.approx(r["ramp"][f]), f
    assert r["alt"]["sl_autocorr1"] < -0.5 < 0.5 < r["ramp"]["sl_autocorr1"]
    assert r["alt"]["sl_dir_changes"] == 1 and r["ramp"]["sl_run_mean"] > r["alt"]["sl_run_mean"] == 1
    assert r["alt"]["sl_short_after_long"] == 1 and r["alt"]["sent_len_mean"] == 17 and r["alt"]["para_len_mean"] == 5
    assert r["alt"]["sent_len_stdev"] == pytest.approx(st.stdev(lens))


def test_degenerate_texts(spark):
    d = spark.createDataFrame([("e", "", 1), ("n", None, 2), ("s", "Too short.", 3), ("a", "''' " * 30, 4)], "id string, text string, n_words_kept int")
    r = {x["id"]: x for x in X.with_features(d, cadence=True).collect()}
    assert all(r[k][f] == 0 for k in "es" for f in P.SURFACE + P.CADENCE)
    assert all(r["n"][f] is None for f in P.SURFACE) and r["n"]["n_words"] == 0
    assert r["a"]["n_words"] == 30 and r["e"]["n_words_kept"] == 1
    assert X.with_features(d.limit(0)).count() == 0


def test_long_text(spark):
    t = " ".join(["The lamp was lit, and it burned; nobody saw."] * 20_000)
    r = X.with_features(texts(spark, [("x", t)]), cadence=True).first()
    assert r["n_words"] == 180_000 and r["sent_len_mean"] == 9 and r["sl_trans_entropy"] == 0


# --- calibration ---


def units(spark, rows):
    cols = ", ".join(f"{f} double" for f in P.SURFACE)
    return spark.createDataFrame(rows, f"id string, voice string, n_words int, {cols}")


def loo_brute(rows):
    out = {}
    for r in rows:
        rest = [x for x in rows if x[1] == r[1] and x[0] != r[0]]
        z = []
        for k in range(3, 3 + len(P.SURFACE)):
            v = [x[k] for x in rest]
            m, s = st.mean(v), st.stdev(v)
            z.append(max(-4, min(4, (r[k] - m) / s)) if s > 1e-9 else 0.0)
        out[r[0]] = math.sqrt(sum(x * x for x in z) / len(z))
    return out


def test_leave_one_out_closed_form(spark):
    r = random.Random(1)
    rows = [(f"u{k}", "ab"[k % 2], 200, *[0.1 + (r.random() if j else 0) for j in range(13)]) for k in range(24)]
    rows[3] = (*rows[3][:3], 7.0, *rows[3][4:])  # a feature that is constant but for one unit: held out, its z is 0
    got = {x["id"]: x["loo"] for x in calibrate.leave_one_out(units(spark, rows)).collect()}
    assert got == pytest.approx(loo_brute(rows))
    few = units(spark, rows[:6])
    assert calibrate.fingerprint(few).count() == 0 and calibrate.leave_one_out(few).count() == 0


def test_z_is_clipped_and_flat_features_count_nothing(spark):
    d = spark.createDataFrame([(5.0, 1.0, 1e-6), (5.0, 1.0, 0.0), (-5.0, 1.0, 1e-6)], "x double, m double, s double")
    assert [r[0] for r in d.select(calibrate.z_of(F.col("x"), F.col("m"), F.col("s"))).collect()] == [4, 0, -4]


def test_recency_weights(spark):
    d = spark.range(4).select(calibrate.recency_weight(F.col("id")).alias("w"), calibrate.recency_weight(F.col("id"), half_life=0).alias("z"))
    r = d.collect()
    assert [x["w"] for x in r] == pytest.approx([4, 1 + 3 * 0.5 ** (1 / 3), 1 + 3 * 0.5 ** (2 / 3), 2.5]) and [x["z"] for x in r] == [4, 1, 1, 1]


def test_weights_shift_the_mean(spark):
    rows = [(f"u{k}", "a", 200, *[float(k)] * 13) for k in range(6)]
    d = units(spark, rows).withColumn("weight", F.when(F.col("id") == "u5", 5.0).otherwise(1.0))
    r = calibrate.weighted_fingerprint(d).first()
    m = (0 + 1 + 2 + 3 + 4 + 25) / 10
    assert r["ttr__m"] == pytest.approx(m) and r["ttr__s"] == pytest.approx(math.sqrt((sum((k - m) ** 2 for k in range(5)) + 5 * (5 - m) ** 2) / 10))


# --- rules ---


def test_dashes(spark):
    t = "HEAD\n------\nA b — c. d-- e---f, , g\n* * *\n-word"
    assert one(spark, t, rules.plain_dashes(F.col("text"))) == 3
    assert one(spark, t, rules.plain_scalpel(F.col("text"))) == "HEAD\n------\nA b, c. d, e, f, g\n* * *\n-word"
    tex = r"Range 0.17--0.21 and text---here, $a---b$ \cite{x---y}."
    assert markup.edit_dashes(tex, "latex") == (r"Range 0.17--0.21 and text, here, $a---b$ \cite{x---y}.", 1)
    md = "A — b `c — d`\n```\nx -- y\n```\n"
    assert markup.edit_dashes(md, "md") == ("A, b `c — d`\n```\nx -- y\n```\n", 1)


def test_shapes(spark):
    tri = "First the light goes, then the colour, then the warmth."
    assert one(spark, tri, F.size(rules.triads(F.col("text")))) == 1
    assert one(spark, "The last days, the last hours, the last seconds.", F.size(rules.triads(F.col("text")))) == 0
    punch = " ".join(["Slow"] + ["walk"] * 16) + ". That house is gone. Long after it is gone they still spoke of nothing else at all."
    assert [r["punch"] for r in one(spark, punch, rules.absence_punches(F.col("text")))] == ["That house is gone."]
    assert one(spark, "It ended, which is the part I like.", F.size(rules.meta_asides(F.col("text")))) == 1
    assert one(spark, "Okay, here's my answer.\nOkay, so we go.", F.size(rules.leakage(F.col("text")))) == 2
    end = "Exactly where it began. He left. It fails precisely when it matters."
    assert one(spark, end, rules.flourishes(F.col("text"))) == ["precisely when"]


def test_numbers_and_citations(spark):
    assert one(spark, "1,200 then 3.50 and 12 and 3.5 and 7.0", rules.numbers(F.col("text"))) == ["7", "12", "3.5", "1200"]
    assert one(spark, "Lee et al. and (Roe, 2001) use BERT not GPT, arXiv:2101.00001", rules.citations(F.col("text"))) == ["(Roe, 2001)", "BERT", "Lee et al.", "arXiv:2101.00001"]


def test_presence_and_quality(spark):
    flat = "The method runs on data. " * 60
    there = flat + "We suspected that the result was unexpected."
    d = texts(spark, [("flat", flat), ("there", there)])
    x = d.select("id", F.size(T.words_unicode(F.col("text"))).alias("n"), *(c.alias(k) for k, c in rules.presence_columns(F.col("text")).items()))
    s = rules.presence_state(F.col("n"), {k: F.lit(v) for k, v in P.FIELD_FLOOR.items()})
    r = {v["id"]: v for v in x.select("id", *(c.alias(k) for k, c in s.items())).collect()}
    assert r["flat"]["presence_missing"] and r["flat"]["absent"] == ["epistemic", "expectation"] and not r["there"]["presence_missing"]
    q = rules.redundancy(texts(spark, [("d", "Iron lamps burned along every harbor wall tonight. " * 6), ("n", None), ("s", "Short.")]), "id")
    got = {v["id"]: v for v in q.collect()}
    assert got["d"]["redundancy"] == 1 and (got["d"]["i"], got["d"]["j"]) == (0, 1) and got["s"]["redundancy"] == 0 and "n" not in got


def test_redundancy_pairs_of_texts_without_a_join(spark, sf_dir):
    """Sentences of a text meet in its row; longer texts give the same by the join."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    near, far = rules.redundancy(d, "doc_id"), rules.redundancy(d, "doc_id", long_chars=-1)
    rows = {tuple(r) for r in near.collect()}
    assert rows == {tuple(r) for r in far.collect()} and len(rows) >= 90 and any(r[1] for r in rows)
    assert {tuple(r) for r in rules.redundancy(d, "doc_id", long_chars=900).collect()} == rows
    assert rules.worst_pair([["a", "b", "c", "d"], ["a", "b"], ["a", "b", "x", "y", "z"], ["c", "d", "e", "f"]]) == (0.5, 0, 2)


# --- rewrites ---


def findings(spark, a, b):
    r = fidelity.with_findings(spark.createDataFrame([(a, b)], "a string, b string"), "a", "b").first()["findings"]
    return None if r is None else {(x["axis"], x["severity"]) for x in r}


def test_rewrite_findings(spark):
    src = "# Head one\n\nThe trial may have run 0.17--0.21 cases. " + prose([6, 40, 7, 38, 9, 41, 5, 36, 8, 30])
    assert findings(spark, src, src) == set()
    assert ("structure", "hard") in findings(spark, src, src.replace("# Head one\n\n", ""))
    assert ("house-style", "hard") in findings(spark, src, src.replace("0.17--0.21", "0.17, 0.21"))
    assert ("rhythm", "hard") in findings(spark, src, "# Head one\n\nThe trial may have run 0.17--0.21 cases. " + prose([20] * 11))
    assert ("register", "hard") in findings(spark, src, src + " You know.")
    assert ("length", "hard") in findings(spark, src, src + " more words" * 40)
    assert ("claim-strength", "soft") in findings(spark, src, src.replace("may have run", "always ran"))
    assert ("construction", "hard") in findings(spark, src, src.replace("Head one", "Not just head one"))
    assert ("scaffold", "hard") in findings(spark, src, "Here is the text.\n" + src)
    assert findings(spark, None, "x") is None and findings(spark, "", "") == set()


def test_prose_of_markup(spark):
    tex = "\\section{A title.}\nText with $x^2$ and \\textbf{bold \\emph{deep}} 1--2 % gone\n\\begin{table}a\\end{table} see \\ref{t}."
    assert one(spark, tex, markup.to_prose(F.col("text"))) == "A title. \nText with value and bold deep 1–2 \n see ."
    md = "# Title.\n\n- item **bold** [link](http://x)\n\n| a | b |\n\n> quote `code`"
    assert one(spark, md, markup.to_prose(F.col("text"))) == "Title.\n\nitem bold link\n\n \n\nquote code"
    assert markup.find_spans("a `b` [c](d) `e`", "md") == [(2, 5), (8, 12), (13, 16)]
    assert one(spark, "<p>One &amp; two</p><script>x</script>", markup.strip_tags(F.col("text"))) == "One & two"


# --- chunks ---


def test_packing_loses_nothing():
    r = random.Random(4)
    for _ in range(60):
        paras = [" ".join(f"p{k}w{j}." if j % 9 == 8 else f"p{k}w{j}" for j in range(r.choice([8, 30, 100, 180, 400]))) for k in range(r.randrange(1, 30))]
        out = chunking.pack(paras)
        assert {w for c in out for w in c.split()} == {w for p in paras for w in p.split()}
        assert all(len(c.split()) <= 500 for c in out)
    assert chunking.pack([]) == []
    hundred = chunking.pack([" ".join([f"x{k}"] * 100) for k in range(23)])
    assert len(hundred) == 23


def test_segments_and_targets(spark):
    long_ = "\n\n".join(" ".join(["w"] * 100) for _ in range(50))
    assert [len(s.split()) for s in chunking.segments(long_, 800)] == [800] * 6
    assert chunking.segments("a b c", 800) == ["a b c"] and chunking.segments("a b c", 800, cut_all=True) == []
    d = spark.createDataFrame([("v", " ".join(["w"] * n)) for n in (800, 800, 800, 800, 800, 20_000)] + [("e", " ".join(["w"] * 50)), ("e", None)], "voice string, text string")
    r = {x["voice"]: x for x in chunking.segmentation(d, "voice", 13).collect()}
    assert r["v"]["lopsided"] and r["v"]["target"] == 24_000 // 39 and not r["e"]["lopsided"] and r["e"]["target"] == 400


def test_pieces_and_ids(spark):
    c = spark.createDataFrame([("f::1", "f", 1, "b"), ("f::0", "f", 0, "a"), ("f::0", "f", 0, "a"), ("g::0", "g", 0, None), ("h", None, 0, "x")], "id string, filename string, chunk_idx int, text string")
    assert {tuple(r) for r in chunking.pieces(c).collect()} == {("f", "a\n\nb")}


# --- retrieval ---


def test_bm25_by_hand(spark):
    docs = {1: "lamp stone river", 2: "lamp lamp garden", 3: "été stone", 4: "other words", 5: ""}
    d = spark.createDataFrame(list(docs.items()) + [(6, None)], "id long, text string")
    q = spark.createDataFrame([("q", "lamp ete stone"), ("n", None)], "query_id string, text string")
    got = {r["id"]: r["score"] for r in retrieve.bm25(d, q).collect()}
    n, avg = 5, sum(len(t.split()) for t in docs.values()) / 5
    def score(words, term, df):
        tf = words.count(term)
        idf = math.log((n - df + 0.5) / (df + 0.5))
        return (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / avg))
    want = {i: -(score(t.replace("été", "ete").split(), "lamp", 2) + score(t.replace("été", "ete").split(), "stone", 2)) for i, t in docs.items() if i in (1, 2, 3)}
    assert got == pytest.approx(want)


def test_fusion_and_exclusion(spark):
    a = spark.createDataFrame([("q", i, r) for r, i in enumerate("abcd", 1)], "query_id string, id string, rank int")
    b = spark.createDataFrame([("q", i, r) for r, i in enumerate("dxa", 1)], "query_id string, id string, rank int")
    r = [(x["id"], x["rrf"]) for x in retrieve.rrf([a, b], 3).orderBy("rank").collect()]
    assert [i for i, _ in r] == ["a", "d", "b"] and r[0][1] == pytest.approx(1 / 61 + 1 / 63)
    out = spark.createDataFrame([("a",)], "id string")
    assert [x["id"] for x in retrieve.rrf([a, b], 2, excluded=out).orderBy("rank").collect()] == ["d", "b"]


def test_mmr_spreads(spark):
    pool = spark.createDataFrame([("q", "a", 1, 1.0, [1.0, 0.0]), ("q", "b", 2, 0.99, [1.0, 0.0]), ("q", "c", 3, 0.5, [0.0, 1.0])], "query_id string, id string, rank int, sim double, vec array<double>")
    assert [r["id"] for r in retrieve.mmr(pool, 2).orderBy("pick").collect()] == ["a", "c"]


def test_topk_variants_agree(spark):
    r = random.Random(2)
    rows = spark.createDataFrame([(k, [r.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for k in range(60)] + [(99, None)], "id long, vec array<double>")
    q = rows.where("id < 3").withColumnRenamed("id", "query_id")
    a = {tuple(x) for x in retrieve.vector_topk(rows, q, 5).select("query_id", "id", "rank").collect()}
    b = {tuple(x) for x in retrieve.vector_topk(rows, q, 5, block=2).select("query_id", "id", "rank").collect()}
    assert a == b and len(a) == 15


# --- slates, composites, feedback ---


def test_pareto_against_dominance(spark):
    r = random.Random(3)
    rows = [(f"c{k}", f"t{k % 40}", k, float(r.randrange(5)), r.randrange(4)) for k in range(300)]
    d = spark.createDataFrame(rows, "cand_id string, task_id string, cand_idx int, rmsz double, n_flags int")
    want = {a[0] for a in rows if not any(b[1] == a[1] and b[3] <= a[3] and b[4] <= a[4] and (b[3] < a[3] or b[4] < a[4]) for b in rows)}
    assert {x["cand_id"] for x in gate.pareto_front(d).collect()} == want


def test_gate_rules(spark):
    d = spark.createDataFrame([("auto", 2.0, 1.0), ("auto", 0.0, 1.0), ("0.7", 2.0, 1.0), (None, 2.0, 1.0)], "s string, p double, b double")
    assert [r[0] for r in d.select(gate.threshold(F.col("s"), F.col("p"), F.col("b"))).collect()] == pytest.approx([2.0, 1.6, 0.7, 1.1])
    x = spark.createDataFrame([("t", 0, 2, 0.5), ("t", 1, 0, 0.9), ("t", 2, 0, 0.7), ("u", 0, 1, None)], "task_id string, cand_idx int, n_hard int, rmsz double")
    assert {(r["task_id"], r["cand_idx"]) for r in gate.least_bad(x).collect()} == {("t", 2), ("u", 0)}


def test_composites(spark):
    p = spark.createDataFrame([("m", "A", [("a", 3.0), ("b", 0.5), ("a", 1.0), ("m", 1.0), ("zz", 1.0), ("c", -1.0)]), ("a", "A", []), ("b", "B", []), ("c", "A", None)], "slug string, author string, compose_from array<struct<profile string, weight double>>")
    counts = spark.createDataFrame([("a", 11), ("b", 193)], "source string, n long")
    s = {r["source"]: r for r in blend.shares(blend.usable_parts(p), counts).collect()}
    assert s["a"]["share"] == pytest.approx(3 / 3.5) and sum(r["share"] for r in s.values()) == pytest.approx(1)
    store = spark.createDataFrame([("a",)], "voice string")
    assert {(r["problem"], r["source"]) for r in blend.problems(p, store).collect()} == {("self", "m"), ("repeated", "a"), ("unknown", "zz"), ("no store", "b"), ("no store", "c"), ("no store", "m"), ("weight", "c"), ("mixed authors", None)}
    b = spark.createDataFrame([("a", "x", True), ("a", "y", True), ("b", "x", True), ("b", "y", False)], "voice string, word string, banned boolean")
    assert [r["word"] for r in blend.blended_banlist(b, blend.shares(blend.usable_parts(p), counts)).collect()] == ["x"]


def test_edit_pairs(spark):
    a, b = ["One.", "Two is here now.", "Three."], ["One.", "Two was there all along then.", "Three.", "Four is new and long."]
    assert feedback.changed_runs(a, b) == [("Two is here now.", "Two was there all along then.")]
    d = spark.createDataFrame([("e", "Same. Old words stay put.", "Same. New words come in here."), ("s", "x", "x"), ("n", None, "x")], "id string, ai_text string, human_text string")
    assert {(r["id"], r["granularity"]) for r in feedback.edit_rows(d, "id").collect()} == {("e", "document"), ("e", "segment")}


# --- statistics ---


def test_auroc_and_sign_test(spark):
    r = random.Random(6)
    rows = [("g", r.random() < 0.4, float(r.randrange(8))) for _ in range(200)] + [("g", None, 1.0), ("g", True, None), ("h", True, 1.0)]
    d = spark.createDataFrame(rows, "g string, m boolean, s double")
    pos, neg = ([s for g, m, s in rows if g == "g" and m is v and s is not None] for v in (True, False))
    want = sum(1.0 if a < b else 0.5 if a == b else 0.0 for a in pos for b in neg) / (len(pos) * len(neg))
    got = {x["g"]: x["auroc"] for x in evalstats.auroc(d, "m", "s", "g").collect()}
    assert got == pytest.approx({"g": want, "h": 0.5})
    t = spark.createDataFrame([("a", -1.0)] * 7 + [("b", -1.0)] * 5 + [("b", 0.0)] * 2 + [("c", None)], "k string, delta double")
    p = {x["k"]: (x["improved"], x["n"], round(x["p"], 4)) for x in evalstats.sign_test(t, ["k"]).collect()}
    assert p == {"a": (7, 7, 0.0156), "b": (5, 7, 0.4531)}


def test_empty_tables(spark):
    e = spark.createDataFrame([], "id string, voice string, text string")
    for f in (rules.scrub_calibration, rules.rhetoric_calibration, rules.quality_calibration, rules.presence_calibration):
        assert f(e).count() == 0
    u = X.with_features(e)
    assert calibrate.corpus_spread(u, "id").count() == calibrate.fingerprint(u).count() == 0
    assert retrieve.bm25(e, e.select(F.col("id").alias("query_id"), "text")).count() == 0
