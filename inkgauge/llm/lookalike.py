"""Problem 6: one form for text that looks the same.

Rules per character come from the Unicode database (width forms, joined
letters, blanks, format characters); letters of other scripts that look like
a Latin one are a fixed table. Word repair is script-aware: a token is looked
at letter by letter only if it has look-alikes and most of its letters are Latin.

Two forms are offered. ``one_form`` maps every look-alike, which is what the
equality of equal-looking records needs (two copies may be disguised in
different letters of the same rare word, so that neither spelling is in any
vocabulary). ``repair`` keeps a token as it is unless its dominant script is Latin and the
Latin result is a word of the corpus' own vocabulary.
"""

from __future__ import annotations

import re
import unicodedata

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgauge.llm.common import expand_pairs, map_rows
from inkgauge.session import checkpointed

# Letters that look like the Latin letter they stand beside.
LOOKALIKE = dict(
    zip(
        "АВЕЗКМНОРСТУХЅІЈԌԚԜҮаеорсухѕіјһԁԛԝӏ"
        "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϜοϲϳνρυ"
        "ՕՍօոսհզց"
        "ɡɑɩᴏᴠᴡᴢᴄ"
        "ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓤꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ",
        "ABE3KMHOPCTYXSIJGQWYaeopcyxsijhdqwl"
        "ABEZHIKMNOPTYXCFocjvpu"
        "OUonuhqg"
        "gaiovwzc"
        "BPdDTGKJCZFMNLSRRVHWXYAEIOU",
        strict=True,
    )
)
HYPHENS = "‐‑﹣－⁃֊᠆˗"
SIGNS = dict(zip("∶⁄∕․ǃ", "://.!", strict=True))  # signs that look like a Latin one
NOT_MAPPED = "З"
for _c in NOT_MAPPED + "ꓒꓤυ":
    LOOKALIKE.pop(_c, None)
KEPT_CONTROLS = "\t\n\r\x0b\x0c\x85\x1c\x1d\x1e"
WIDTHLESS_EXTRA = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


def _map_char(code: int) -> str | None:
    """What a character becomes; '' if it has neither ink nor width, itself if it stays."""
    c = chr(code)
    if c in HYPHENS:
        return "-"
    if c in LOOKALIKE:
        return LOOKALIKE[c]
    if c in SIGNS:
        return SIGNS[c]
    cat = unicodedata.category(c)
    if code in WIDTHLESS_EXTRA or cat == "Cf" or (cat == "Cc" and c not in KEPT_CONTROLS):
        return ""
    if cat == "Zs" or c in "\t⠀ㅤ":
        return " "
    kind, _, rest = unicodedata.decomposition(c).partition("> ")
    if kind in ("<wide", "<narrow", "<small", "<font", "<noBreak"):
        return "".join(_map_char(int(x, 16)) or "" for x in rest.split())
    if kind == "<compat" and cat in ("Ll", "Lu", "Lt", "Nl"):
        parts = "".join(chr(int(x, 16)) for x in rest.split())
        if parts.isascii() and parts.isalpha() and c != "ſ":
            return parts
    return c


class _Table(dict):
    def __missing__(self, code: int) -> str:
        v = self[code] = _map_char(code)
        return v


_TABLE = _Table()
# A text of these characters only is its own form.
_PLAIN = re.compile("[ !-~\nÀ-ÖØ-öø-ıĴ-ž“”‘’–—…]*")
_ACCENTED_OTHER = re.compile("[Ͱ-׿ἀ-῿]")


def one_form(text: str) -> str:
    """The one form of a text: equal for texts that look the same, different otherwise."""
    if text.isascii() and _PLAIN.fullmatch(text):
        return text
    if _PLAIN.fullmatch(text):
        return text
    if "\r\n" in text:
        text = text.replace("\r\n", "\n")
    if _ACCENTED_OTHER.search(text):  # an accented letter of another script may have a look-alike base
        text = unicodedata.normalize("NFD", text)
    return unicodedata.normalize("NFC", text.translate(_TABLE))


def script_of(token: str) -> str:
    """The script most letters of a token belong to: latin, greek, cyrillic, armenian, other or none."""
    n: dict[str, int] = {}
    for c in token:
        if c.isalpha():
            name = unicodedata.name(c, "OTHER").removeprefix("FULLWIDTH ").split(" ", 1)[0].lower()
            name = name if name in ("latin", "greek", "cyrillic", "armenian") else "other"
            n[name] = n.get(name, 0) + 1
    return max(n, key=lambda k: (n[k], k == "latin")) if n else "none"


def is_suspect(token: str) -> bool:
    """A token with look-alikes whose dominant script is Latin; words of another script stay."""
    return any(c in LOOKALIKE for c in token) and script_of(token) == "latin"


def light_form(text: str) -> str:
    """Everything of the one form but the look-alike letters."""
    return unicodedata.normalize("NFC", "".join(c if c in LOOKALIKE else _TABLE[ord(c)] for c in text))


_TOKEN = re.compile(r"\w+")


def suspect_forms(text: str) -> list[str]:
    """Latin results of a text's suspect tokens, lower-cased."""
    if text.isascii():
        return []
    return [one_form(t).lower() for t in _TOKEN.findall(light_form(text)) if not t.isascii() and is_suspect(t)]


def repair(text: str, vocabulary: set[str]) -> str:
    """Substitute look-alikes in suspect tokens whose Latin result is in the vocabulary."""
    if text.isascii():
        return text

    def fix(m: re.Match) -> str:
        t = m.group()
        if t.isascii() or not is_suspect(t):
            return t
        r = one_form(t)
        return r if r.lower() in vocabulary else t

    return _TOKEN.sub(fix, light_form(text))


def form_keys(records: DataFrame, id_col: str = "rec_id", text_col: str = "text") -> DataFrame:
    """Rows (rec_id, form_key, text_key): 128-bit keys of a text's one form and of the stored text.

    Null texts give no row; the empty text and texts without ink share the key of "".
    """

    def keys(b):
        ids, texts = b.column(0), b.column(1).to_pylist()
        return {"rec_id": ids, "form_key": [xxhash.xxh3_128_digest(one_form(t).encode("utf-8", "surrogatepass")) for t in texts], "text_key": [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts]}

    return map_rows(records.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("rec_id"), F.col(text_col).alias("text")), keys, "rec_id string, form_key binary, text_key binary")


def same_look_pairs(records: DataFrame) -> DataFrame:
    """Pairs (rec_a < rec_b) of records whose texts differ as stored but have one form.

    First the spellings of a form are paired, which are one row each however
    many copies they have, then the records of two spellings. Copies of one
    spelling never meet. Both steps are cut into blocks (``expand_pairs``).
    """
    k = checkpointed(form_keys(records).distinct())
    mixed = k.groupBy("form_key").agg(F.min("text_key").alias("lo"), F.max("text_key").alias("hi")).where("lo <> hi").select("form_key")
    k = k.join(mixed, "form_key", "left_semi")
    spellings = k.select(F.col("text_key").alias("id"), F.col("form_key").alias("cls")).distinct()
    forms = mixed.select(F.col("form_key").alias("a"), F.col("form_key").alias("b"))
    two = expand_pairs(spellings, forms).select(F.col("x").alias("a"), F.col("y").alias("b"))
    both = expand_pairs(k.select(F.col("rec_id").alias("id"), F.col("text_key").alias("cls")), two)
    return both.select(F.least("x", "y").alias("rec_a"), F.greatest("x", "y").alias("rec_b"))


def same_look_classes(records: DataFrame) -> DataFrame:
    """One row per record of a form with several spellings: (rec_id, class_id, n_spellings, n_records)."""
    k = form_keys(records).distinct()
    c = k.groupBy("form_key").agg(F.min("rec_id").alias("class_id"), F.count_distinct("text_key").alias("n_spellings"), F.count("*").alias("n_records")).where("n_spellings > 1")
    return k.join(c, "form_key").select("rec_id", "class_id", "n_spellings", "n_records")


def repaired(records: DataFrame) -> DataFrame:
    """(rec_id, text) with every text in its repaired form, the vocabulary gate included.

    The suspect Latin forms are few; the corpus' plain words are reduced to
    those forms map-side by a semi-join, so only confirmed forms travel back,
    attached to the records that hold them.
    """

    def suspects(b):
        ids, out = b.column(0).to_pylist(), {"rec_id": [], "form": []}
        for i, t in zip(ids, b.column(1).to_pylist(), strict=True):
            for f in set(suspect_forms(t)):
                out["rec_id"].append(i)
                out["form"].append(f)
        return out

    def plain_words(b):
        words: set[str] = set()
        for t in b.column(0).to_pylist():
            words.update(w for w in _TOKEN.findall(t.lower()) if w.isascii() or not is_suspect(w))
        return {"form": sorted(words)}

    r = records.where("text is not null and rec_id is not null").select("rec_id", "text")
    s = map_rows(r, suspects, "rec_id string, form string").distinct()
    v = map_rows(r.select("text"), plain_words, "form string").distinct()
    good = s.join(v, "form", "left_semi").groupBy("rec_id").agg(F.collect_set("form").alias("vocab"))

    def mend(b):
        return {"rec_id": b.column(0), "text": [repair(t, set(v or ())) for t, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]}

    return map_rows(r.join(good, "rec_id", "left").select("rec_id", "text", "vocab"), mend, "rec_id string, text string")
