"""Text operators against brute force, by small fixtures and the smallest tables."""

import random
import re
import unicodedata

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgauge.llm import leak, lookalike, neardup, quality, spam, spans, split
from inkgauge.llm.common import WORD, expand_pairs, records

REC = "rec_id string, origin string, text string"


def rows(df):
    return {tuple(r) for r in df.collect()}


def words(n, seed=0, vocab=2000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocab)}" for _ in range(n)]


# --- problem 6 ---


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("rather", "rаthеr", True),
        ("Full text!", "Ｆｕｌｌ text！", True),
        ("café", "café", True),
        ("fix", "ﬁx", True),
        ("a b", "a b", True),
        ("a b", "a b", True),
        ("word", "wo​rd﻿", True),
        ("so-called", "so‑called", True),
        ("so-called", "so‐called", True),
        ("cell", "ⅽeІl".replace("І", "l"), True),
        ("a b", "a  b", False),
        ("a\nb", "a b", False),
        ("cafe", "café", False),
        ("x2", "x²", False),
        ("Word", "word", False),
        ("“q”", '"q"', False),
        ("a-b", "a–b", False),
        ("room 1", "room 7", False),
    ],
)
def test_one_form(a, b, same):
    assert (lookalike.one_form(a) == lookalike.one_form(b)) is same
    assert lookalike.one_form(lookalike.one_form(b)) == lookalike.one_form(b)


def test_repair_needs_a_known_word():
    assert lookalike.repair("rаthеr", {"rather"}) == "rather"
    assert lookalike.repair("rаthеr", set()) == "rаthеr"
    assert lookalike.repair("мир", {"mup"}) == "мир"  # a word of its own script
    assert lookalike.script_of("rаther") == "latin"


def test_plain_characters_stay():
    assert [c for c in map(chr, range(0x11000)) if lookalike._PLAIN.fullmatch(c) and lookalike._map_char(ord(c)) != c] == []
    assert lookalike.one_form("d\u0133o") == "dijo"


def test_repair_goes_by_the_dominant_script():
    vocabulary = {"a", "o", "cop", "pope", "rather"}
    for kept in ("а", "о", "сор", "ο", "рорe"):  # Cyrillic and Greek words, and one that is mostly Cyrillic
        assert lookalike.repair(f"x {kept} y", vocabulary) == f"x {kept} y"
    assert lookalike.repair("rаther рope", vocabulary) == "rather pope"


def test_same_look_pairs_brute_force(spark, sf_dir):
    r = records(spark, sf_dir)
    got = rows(lookalike.same_look_pairs(r))
    all_ = {x["rec_id"]: x["text"] for x in r.collect()}
    by = {}
    for i, t in all_.items():
        by.setdefault(lookalike.one_form(t), []).append(i)
    want = {(min(a, b), max(a, b)) for ids in by.values() for a in ids for b in ids if a < b and all_[a] != all_[b]}
    assert got == want and want
    rep = dict(lookalike.repaired(r).collect())
    assert set(rep) == set(all_)


def test_same_look_edge_cases(spark):
    d = spark.createDataFrame([("a", "o", ""), ("b", "o", "​"), ("c", "o", None), ("d", "o", "x"), ("d", "o", "x"), ("e", "p", "x"), (None, "o", "x")], REC)
    assert rows(lookalike.same_look_pairs(d)) == {("a", "b")}
    assert lookalike.same_look_pairs(d.limit(0)).count() == 0
    assert rows(lookalike.same_look_classes(d).select("rec_id", "class_id")) == {("a", "a"), ("b", "a")}


# --- problem 1 ---

PROSE = "The house was quiet and she did not know what to say. They had gone to the river in the morning, and it was still dark when the first of them came back."


# One paragraph in each of many languages, none of which the operators have words of.
TONGUES = {
    "ru": "Вечером мы долго шли вдоль реки, и никто не хотел говорить первым. Снег лежал на крышах, а в окнах горел тёплый свет. Она сказала, что письмо пришло ещё утром, но он не поверил ей.",
    "tr": "Akşam olunca nehir boyunca uzun süre yürüdük ve kimse ilk sözü söylemek istemedi. Çatıların üstünde kar vardı, pencerelerde sıcak bir ışık yanıyordu. Mektubun sabah geldiğini söyledi ama o buna inanmadı.",
    "pl": "Wieczorem długo szliśmy wzdłuż rzeki i nikt nie chciał odezwać się pierwszy. Na dachach leżał śnieg, a w oknach paliło się ciepłe światło. Powiedziała, że list przyszedł rano, ale on jej nie uwierzył.",
    "zh": "傍晚我们沿着河走了很久，谁也不想先开口。屋顶上积着雪，窗子里亮着温暖的灯光。她说信是早上到的，可是他不相信她的话。",
    "fi": "Illalla kävelimme pitkään joen vartta, eikä kukaan halunnut puhua ensimmäisenä. Katoilla oli lunta ja ikkunoissa paloi lämmin valo. Hän sanoi, että kirje oli tullut aamulla, mutta mies ei uskonut häntä.",
    "pt": "À noite caminhámos muito tempo ao longo do rio e ninguém quis falar primeiro. Havia neve nos telhados e uma luz quente nas janelas. Ela disse que a carta tinha chegado de manhã, mas ele não acreditou.",
    "ar": "في المساء مشينا طويلا على ضفة النهر ولم يرد أحد أن يتكلم أولا. كان الثلج على السطوح وكان ضوء دافئ في النوافذ. قالت إن الرسالة وصلت في الصباح لكنه لم يصدقها.",
    "hi": "शाम को हम नदी के किनारे देर तक चलते रहे और कोई भी पहले बोलना नहीं चाहता था। छतों पर बर्फ़ थी और खिड़कियों में गर्म रोशनी जल रही थी। उसने कहा कि चिट्ठी सुबह आई थी।",
    "ja": "夕方、私たちは川沿いを長い間歩いたが、誰も先に話そうとしなかった。屋根には雪が積もり、窓には暖かい光がともっていた。手紙は朝届いたと彼女は言った。",
    "el": "Το βράδυ περπατήσαμε πολλή ώρα δίπλα στο ποτάμι και κανείς δεν ήθελε να μιλήσει πρώτος. Υπήρχε χιόνι στις στέγες και ζεστό φως στα παράθυρα. Είπε ότι το γράμμα ήρθε το πρωί.",
}
BAD = [
    "- iron lamp\n- garden\n- cold stone bridge\n- paper\n- lantern", "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |", "00000000  fd 6a a6 89\n00000010  36 d8 b9 a1", '{"ab":12,"cd":[1,2],"ef":null,"gh":"xy"}',
    "qwlkj asdlk qpwoe zmxnc alskd pqowi eurty lkjas dmnzx qowie", "x\t1\t2\ny\t3\t4\nz\t5\t6", "+---+---+\n| a | b |\n+---+---+\n| c | d |\n+---+---+", "~#§ _r1l!i ;,¬!!eI 11§ Io<l^¤> a ,¬^!<^ ¦<**¦> ¬^<>|; < ¦> I§°<: *1:¤§^ o~¦_",
]


def good_and_bad(text, common=frozenset()):
    c = quality.text_counts(text, common)
    return c[7], sum(c[8:])


@pytest.mark.parametrize("tongue", sorted(TONGUES))
def test_prose_of_any_language(tongue):
    t = TONGUES[tongue]
    for x in (t, t.upper(), f"> {t}", f"**{t}**", t.replace(". ", ".\n"), "\n".join([t] * 20), f"— {t}"):
        good, bad = good_and_bad(x)
        assert good > 0 and not bad, x
    assert not spam.label_page("\n".join([t, t[::-1].capitalize() if tongue == "zh" else t]))[1].count(1)
    _, states, _ = spam.label_page(t)
    assert set(states) == {0}


def test_junk_kinds():
    for good in (PROSE, PROSE.upper(), PROSE.replace(" ", "\n"), f"> {PROSE}", f"**{PROSE}**", "Der Fluss war nicht tief und wir haben das Wasser gesehen.", "Le jardin que nous avons vu dans la nuit est sans une porte.", "Hemos visto el jardín y la casa, pero no había nada que decir."):
        assert good_and_bad(good)[0] > 0 and not good_and_bad(good)[1], good
    for t in BAD:
        assert good_and_bad(t)[1] > good_and_bad(t)[0], t
    # without any mark of a sentence only words known from the corpus, or that come again, tell prose
    bare = re.sub(r"[.,]", "", PROSE).lower()
    assert good_and_bad(bare, frozenset("the was and did not what to had in it when of".split()))[0] > 0
    assert good_and_bad(f"{bare} {bare}")[1] == 0


def test_statistics_do_not_depend_on_pieces(spark):
    r = random.Random(5)
    text = "\n".join(" ".join(r.choice(["the", "lamp", "was", "cold,", "stone!", "a_b", "12", "~~"]) for _ in range(r.randrange(1, 30))) + r.choice([".", "", "?”"]) for _ in range(80))
    one_line = " ".join(words(400, 3))
    d = spark.createDataFrame([("a", "o", text), ("a", "o", text), ("b", "o", one_line), ("n", "o", None), ("e", "o", ""), ("w", "o", "x" * 900), ("m", "o", "\n\n".join([PROSE, *BAD, *TONGUES.values()]))], REC)
    common = frozenset(["the", "was"])
    whole = {x["rec_id"]: x for x in quality.text_statistics(d, common=common).collect()}
    assert set(whole) == {"a", "b", "e", "w", "m"}
    for size in (97, 500, 7):
        assert {x["rec_id"]: x for x in quality.text_statistics(d, piece_chars=size, common=common).collect()} == whole, size
    assert whole["a"]["n_words"] == len(re.findall(r"\w+", text)) and whole["e"]["mean_word_len"] is None and not whole["e"]["is_junk"]
    assert whole["a"]["n_chars"] == len(text) and whole["w"]["is_junk"]
    assert quality.text_statistics(d.limit(0)).count() == 0


def test_kinds_do_not_depend_on_pieces():
    r = random.Random(11)
    parts = [PROSE, PROSE.replace(". ", ".\n"), *BAD, *TONGUES.values(), "", " ", "“Quoted.”", "a" * 700, "- one. \n- two, three, four; five\n\n", "\n", "\t\t", "x  y  z", "Ti­tle"]
    for _ in range(120):
        t = r.choice(["\n", "\n\n", " "]).join(r.choice(parts) for _ in range(r.randrange(1, 9)))
        want = quality.text_counts(t)
        for size in (1, 2, 3, 13, 97, 256, 500, 1999):
            assert quality.text_counts(t, piece_chars=size) == want, (size, t)


def test_common_words_count_every_text(spark):
    """Words on the bound of one text in 200 all pass, as no text is left out of the counts."""
    word = F.concat(F.lit("zq"), F.translate((F.col("id") % 200).cast("string"), "0123456789", "abcdefghij"))
    prose = spark.range(20_000).select(F.col("id").cast("string").alias("rec_id"), F.concat(F.lit("The old gate was kept near "), word, F.lit(" until noon.")).alias("text"))
    lists = spark.range(2_000).select(F.concat(F.lit("l"), "id").alias("rec_id"), F.lit("iron, tin, lead, zinc, gold, salt, coal, wool").alias("text"))
    found = quality.common_words(prose.unionByName(lists))
    assert found >= {w for r in prose.select(F.split("text", " ")[6].alias("w")).distinct().collect() for w in [r["w"]]} and len(found) == 208


def test_common_words_are_learned(spark, sf_dir):
    found = quality.common_words(records(spark, sf_dir))
    assert {"the", "of", "was", "und", "le"} <= found and len(found) <= quality.MOST_WORDS
    r = random.Random(8)
    nouns = [f"noun{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    d = [(f"p{k}", f"The {r.choice(nouns)} of the {r.choice(nouns)} was in a {r.choice(nouns)}. It was not the {r.choice(nouns)}.") for k in range(900)]
    d += [(f"l{k}", "\n".join(f"- {r.choice(nouns)} {r.choice(nouns)}" for _ in range(40))) for k in range(90)]
    assert quality.common_words(spark.createDataFrame(d, "rec_id string, text string")) == {"the", "of", "was", "in", "a", "it", "not"}
    assert quality.common_words(records(spark, sf_dir).limit(0)) == frozenset()


# --- problem 10 ---


def test_spam_pages(spark):
    essay = " ".join([PROSE, "She would not be the one to tell them, and nobody asked her for the reason of it.", "In the end they went home by the old road, which was longer but not as dark."])
    docs = {
        1: essay,
        2: "\n".join(f'<a href="https://site{i}.example/x">lamp stone {i}</a>' for i in range(30)),
        3: " ".join(f"cheap pens cheap pens online writing help {i % 3}" for i in range(40)),
        4: "\n".join(f"Tags: lamp, stone, river, paper {w}, thread" for w in words(20, 1)),
        5: "\n".join(f"Green Lamp SKU-{i:05d} $12.{i:02d} in stock" for i in range(25)),
        6: essay + "\n\nReferences\n" + "\n".join(f"Nolan, B. ({1990 + i}). Lamp stone river. Journal, {i}–{i + 9}." for i in range(5)),
        7: "\n".join(f"The best leather pen is the leather pen of {w}. Buy a leather pen, the leather pen for you!" for w in words(20, 9)),
        8: essay + "\nSee https://a.example/b for more.",
        9: "",
        10: None,
    }
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {x[0] for x in spam.spam_pages(d.union(d)).collect()} == {2, 3, 4, 5, 7}
    assert spam.page_labels(d).where("doc_id = 9").first()["non_prose_share"] is None
    assert spam.spam_pages(d.limit(0)).count() == 0


def test_a_fitted_model_labels_as_its_pages_do():
    r = random.Random(3)
    pages = {"".join(r.choice("pppo") for _ in range(20)): 40 for _ in range(5)} | {"".join(r.choice("ttttno") for _ in range(20)): 4 for _ in range(5)} | {"": 3}
    model = spam.fit({k: v for k, v in pages.items() if k})
    for rows in model[:2]:
        assert all(abs(sum(np.exp(x)) - 1) < 1e-9 for x in rows)
    assert set(spam.viterbi("pppoppo", model=model)) == {0} and set(spam.viterbi("tttnntto", model=model)) == {2}
    assert spam.fit({}) == spam.PRIOR_MODEL or np.allclose(spam.fit({})[0], spam.PRIOR_MODEL[0])


def test_menus_are_no_prose():
    page = "\n".join(f"Home | Shop | Contact {k} | Help | Basket" for k in range(20))
    assert set(spam.label_page(page)[1]) == {3} and set(spam.label_page(f"{PROSE}\n{PROSE}\nHome | Shop | Help | Basket")[1][:2]) == {0}


def test_viterbi_keeps_runs():
    assert set(spam.viterbi("pppppppp")) == {0} and spam.viterbi("llllnlll") == [1] * 8


# --- problem 3 ---


def test_split_brute_force(spark, sf_dir):
    texts = [" ".join(words(n, n)) + tail for n in (0, 1, 349, 350, 351, 700, 1234) for tail in ("", ".\n\nEnd.")]
    texts += ["\n\n".join(" ".join(words(37, k)) + "." for k in range(40)), " ".join(f"s{k} " + " ".join(words(9, k)) + "." for k in range(200)), " ".join(words(800, 8))]
    for t in texts:
        pieces = split.split_text(t)
        tokens, at = t.split(), 0
        for k, (x, n, o) in enumerate(pieces):
            p = x.split()
            assert len(p) == n <= 350
            if k:
                assert 20 <= o <= 60 and tokens[at - o : at] == p[:o]
            assert p[o:] == tokens[at : at + n - o]
            at += n - o
        assert at == len(tokens)
    sentences = split.split_text(texts[-2])
    assert all(x.rstrip().endswith(".") for x, _, _ in sentences)
    d = spark.createDataFrame([("a", "f", texts[5], 0), ("a", "f", texts[5], 0), ("b", "f", None, 1), ("c", "f", "", 2)], "id string, filename string, text string, chunk_idx int")
    got = split.split_oversized(d).orderBy("id", "chunk_idx").collect()
    assert [(r["id"], r["chunk_idx"]) for r in got] == [("a", k) for k in range(len(split.split_text(texts[5])))] + [("c", 0)]
    assert [r["chunk_idx"] for r in split.reindexed(d).orderBy("chunk_idx").collect()] == list(range(len(got)))
    assert split.oversized_ids(d.limit(0)).count() == 0
    found = {r[0] for r in split.oversized_ids(spark.read.parquet(f"{sf_dir}/chunks.parquet")).collect()}
    assert found == {i for i, t in duckdb.sql(f"select id, text from '{sf_dir}/chunks.parquet' where text is not null").fetchall() if len(t.split()) > 350}


# --- problem 2 ---


def shingle_set(t, k):
    w = WORD.findall(lookalike.one_form(t).lower())
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}, len(w)


def jaccard_pairs(texts, k, threshold, least):
    s = {i: shingle_set(t, k) for i, t in texts.items()}
    ids = sorted(i for i in s if s[i][1] >= least)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(s[a][0] & s[b][0]) >= threshold * len(s[a][0] | s[b][0])}


def variants():
    base = {f"b{k}": words(120, k, 50_000) for k in range(12)}
    out = {k: " ".join(v) for k, v in base.items()}
    r = random.Random(1)
    for k, v in base.items():
        for n in (2, 6, 12, 25, 60):
            w = list(v)
            for _ in range(n):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            out[f"{k}_{n}"] = " ".join(w)
        out[f"{k}_copy"] = " ".join(v).upper().lower()
    out["short"] = "only a few words"
    return out


@pytest.mark.parametrize("hot", [neardup.HOT, 2])
def test_similar_pairs_brute_force(spark, hot, monkeypatch):
    texts = variants()
    d = spark.createDataFrame(list(texts.items()) + [("b0", texts["b0"]), ("none", None)], "id string, text string")
    if hot != neardup.HOT:  # every bucket of three is hot: links come from the second bands
        monkeypatch.setattr(neardup.similar_texts, "__defaults__", (0.8, 5, 1, hot))
    got = rows(neardup.similar_pairs(d, 0.5, 3, 20))
    want = jaccard_pairs(texts, 3, 0.5, 20)
    assert got <= want and len(want - got) <= 0.01 * len(want)


def test_similar_on_tables_and_edges(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/chunks.parquet").select("id", "text")
    texts = {r[0]: r[1] for r in t.where("text is not null").collect()}
    assert rows(neardup.similar_pairs(t, 0.5, 3, 20)) == jaccard_pairs(texts, 3, 0.5, 20)
    empty = spark.createDataFrame([], "id string, text string")
    assert neardup.similar_pairs(empty, 0.5, 3, 20).count() == 0
    same = spark.createDataFrame([(f"i{k:03d}", PROSE) for k in range(50)] + [("z", "")], "id string, text string")
    c = neardup.similar_classes(same).collect()
    assert len(c) == 50 and {(r["class_id"], r["n_copies"], r["n_links"]) for r in c} == {("i000", 50, 0)}


def test_hot_buckets_are_joined_in_full(spark):
    """All share one band and no second one: a close pair is found in a bucket of more than HOT, within and across blocks."""
    r = np.random.default_rng(6)
    n, bands = neardup.HOT + 60, neardup.N_HASH // neardup.band_rows(0.8)
    keys = r.permutation(n * bands).reshape(n, bands).astype(np.uint32) + np.uint32(9)
    keys[:, 3] = 5
    sketch = r.integers(0, 256, (n, neardup.N_SKETCH), dtype=np.uint8)
    close = {(k, k + 100) for k in range(60)}
    for a, b in close:
        sketch[b, : neardup.N_SKETCH - 8] = sketch[a, : neardup.N_SKETCH - 8]
    d = spark.createDataFrame([(k, str(k), keys[k].tobytes(), sketch[k].tobytes()) for k in range(n)], "rep long, id string, keys binary, sketch binary")
    assert rows(neardup.likely_pairs(neardup.candidate_pairs(d), d, 0.8)) == close
    assert rows(neardup.candidate_pairs(d, threshold=0.8, block=50)) == close


def test_bucket_scan_over_batches():
    import pyarrow as pa

    r = random.Random(3)
    rows_ = sorted((r.randrange(40), r.randrange(1000)) for _ in range(400)) + [(99, k) for k in range(50)]
    for cut in (1, 7, 64, 1000):
        batches = [pa.record_batch([pa.array([x[1] for x in rows_[k : k + cut]]), pa.array([x[0] for x in rows_[k : k + cut]])], names=["rep", "key"]) for k in range(0, len(rows_), cut)]
        out = [x for b in neardup.bucket_pairs(iter(batches), 30) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        by = {}
        for k, v in rows_:
            by.setdefault(k, []).append(v)
        pairs = {(min(a, b), max(a, b)) for k, v in by.items() if len(v) <= 30 for a in v for b in v if a != b}
        assert {(a, b) for a, b, h in out if not h} >= pairs
        hot = {(b, a) for a, b, h in out if h}
        assert {(99, k) for k in range(50)} <= hot  # all rows of the hot bucket are flagged ...
        extra = {(a, b) for a, b, h in out if not h} - pairs
        assert not extra  # ... and none is paired


# --- problem 4 ---


def shared_brute(recs, n):
    by = {}
    for i, (o, t) in recs.items():
        w = t.split()
        for k in range(len(w) - n + 1):
            by.setdefault(tuple(w[k : k + n]), set()).add((i, o))
    return {i for v in by.values() if len({o for _, o in v}) > 1 for i, _ in v}


def test_shared_spans_brute_force(spark, sf_dir):
    r = random.Random(2)
    boiler = words(45, 77)
    recs = {}
    for k in range(90):
        w = words(r.randrange(0, 160), 100 + k)
        if k % 3 == 0:
            at = r.randrange(len(w) + 1)
            w[at:at] = boiler[r.randrange(3) : 45 - r.randrange(20)]
        recs[f"r{k:02d}"] = (f"o{k % 7}", " ".join(w))
    recs["same"] = ("o1", recs["r00"][1] + "\n" + recs["r00"][1])
    recs["tie"] = ("oz", "la " * 200)
    recs["tie2"] = ("oy", "la " * 31)
    d = spark.createDataFrame([(i, o, t) for i, (o, t) in recs.items()] + [("n", "o", None), ("e", None, "")], REC)
    assert {x[0] for x in spans.sharing_records(d.union(d.limit(5))).collect()} == shared_brute(recs, 30)
    share = {x["rec_id"]: x for x in spans.shared_share(d).collect()}
    assert set(share) == shared_brute(recs, 30)
    assert share["tie"]["shared_tokens"] == 200 and share["tie"]["n_spans"] == 1 and share["tie2"]["longest_span"] == 31
    assert spans.sharing_records(d.limit(0)).count() == 0
    x = records(spark, sf_dir)
    all_ = {i: (o, t) for i, o, t in x.collect()}
    assert {v[0] for v in spans.sharing_records(x).collect()} == shared_brute(all_, 30)


# --- problem 8 ---


def leaks_brute(docs, items, run=13):
    out = set()
    for j, t in items.items():
        w = WORD.findall(t.lower())
        n = min(run, len(w))
        want = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for i, x in docs.items():
            v = WORD.findall(x.lower())
            if any(tuple(v[k : k + n]) in want for k in range(len(v) - n + 1)):
                out.add((i, j))
    return out


def test_leaks_brute_force(spark, sf_dir):
    items = {k: " ".join(words(11 + 3 * k, k)) for k in range(12)}
    docs = {}
    r = random.Random(4)
    for k in range(40):
        w = words(r.randrange(0, 90), 500 + k)
        if k % 2:
            src = items[k % 12].split()
            a = r.randrange(max(1, len(src) - 12))
            at = r.randrange(len(w) + 1)
            w[at:at] = [x.upper() + "," for x in src[a : a + r.choice([8, 12, 13, 20])]]
        docs[k] = " ".join(w)
    dd = spark.createDataFrame([*docs.items(), (999, None), (998, "")], "doc_id long, text string")
    ii = spark.createDataFrame([*items.items(), (77, ""), (78, None)], "item_id long, text string")
    want = leaks_brute(docs, items)
    assert rows(leak.exact_leaks(dd, ii)) == want and want
    assert rows(leak.leaks(dd, ii, block_words=60).where("n_exact > 0").select("doc_id", "item_id")) == want
    assert leak.exact_leaks(dd.limit(0), ii).count() == leak.exact_leaks(dd, ii.limit(0)).count() == 0
    d, i = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "holdout_items"))
    want = leaks_brute(dict(d.where("text is not null").select("doc_id", "text").collect()), dict(i.where("text is not null").select("item_id", "text").collect()))
    assert rows(leak.exact_leaks(d, i)) == want


def test_edited_items_are_found(spark):
    r = random.Random(12)
    items = {k: words(r.randrange(14, 120), 900 + k) for k in range(60)}
    docs, want = {}, {}
    for k, w in items.items():
        for edits in (0, 1, 2, 3):
            x = list(w)
            for p in r.sample(range(len(x)), edits):
                x[p] = f"new{r.randrange(999)}"
            docs[4 * k + edits] = " ".join(words(r.randrange(40), k) + x + words(r.randrange(40), k + 1))
            grams = {tuple(w[a : a + 5]) for a in range(len(w) - 4)}
            have = {tuple(x[a : a + 5]) for a in range(len(x) - 4)}
            if len(grams & have) >= 0.85 * len(grams):
                want[4 * k + edits, k] = edits
    dd = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    ii = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x for x in leak.leaks(dd, ii).collect()}
    assert len(want.keys() & got.keys()) >= 0.97 * len(want) and sum(v > 0 for v in want.values()) > 60
    assert all(x["n_exact"] or x["item_share"] >= 0.8 for x in got.values())
    cut = {tuple(x) for x in leak.leaks(dd, ii, block_words=400).collect()}
    assert cut == {tuple(x) for x in got.values()}  # whatever the blocks


def test_unicode_helpers():
    assert unicodedata.normalize("NFC", lookalike.light_form("é")) == "é"
    assert F is not None


def test_pairs_of_hot_classes_meet_in_blocks(spark):
    r = random.Random(2)
    members = [(f"i{k:03d}", "big" if k < 150 else f"c{r.randrange(12)}") for k in range(220)]
    pairs = {("big", "big"), ("big", "c1"), ("c2", "c2"), ("c3", "c4"), ("c1", "c1")}
    by = {}
    for i, c in members:
        by.setdefault(c, []).append(i)
    want = {(min(x, y), max(x, y)) for a, b in pairs for x in by.get(a, []) for y in by.get(b, []) if x != y}
    for block in (7, 1000):
        got = [tuple(sorted(x)) for x in expand_pairs(spark.createDataFrame(members, "id string, cls string"), spark.createDataFrame(sorted(pairs), "a string, b string"), block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_reindexed_numbers_run_through_hot_files(spark):
    r = random.Random(4)
    d = [(f"x{k:03d}", r.choice(["hot", "hot", "hot", "b", None]), r.choice([0, 1, 1, 1, 7, None]), " ".join(words(r.choice([3, 360, 900]), k))) for k in range(90)]
    d += d[:9] + [("x001", "zz", 99, d[1][3]), ("n", "b", 1, None)]
    got = {}
    for x in split.reindexed(spark.createDataFrame(d, "id string, filename string, chunk_idx int, text string")).collect():
        got.setdefault(x["filename"], []).append((x["chunk_idx"], x["id"], x["text"]))
    low = lambda v: (v is not None, v or type(v)() if v is not None else 0)
    name = lambda v: (v is not None, v or "")
    want, seen = {}, {}
    for i, f, o, t in d:
        if t is not None and (i not in seen or (name(f), low(o)) < seen[i][0]):
            seen[i] = ((name(f), low(o)), f, o, t)
    for i, (_, f, o, t) in sorted(seen.items(), key=lambda z: (low(z[1][2]), z[0])):
        want.setdefault(f, []).extend((i, p) for p, _, _ in split.split_text(t))
    assert {f: [(i, t) for _, i, t in sorted(v)] for f, v in got.items()} == want
    assert all([k for k, _, _ in sorted(v)] == list(range(len(v))) for v in got.values())
