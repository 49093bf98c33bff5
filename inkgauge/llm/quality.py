"""Problem 1: text quality statistics of every record, and which are not prose.

Lines of a text form runs: neighbouring lines that aren't blank and bear the
same mark (none, list, table), as their first HEAD characters show. A run is
known by its counts alone, which add up, and its kind by ratios of these: mean
word length, symbol ratio, sentence ends and lines that end in punctuation,
share of common words. Common words aren't a fixed list: they are learned from
the corpus, as the words that stand in sentences but hardly in lists. Prose of
languages the corpus doesn't hold is known by its sentences.

A long text is cut every ``piece_chars`` characters, wherever that is. Each
piece gives its open run at either end and the sums of those between; a word,
a sentence end and a line's mark are looked at with HEAD characters of what
follows and LEFT of what stands before, and are counted in the piece in which
they begin (a line's end: where it ends). Neighbouring pieces merge as
fragments do, in two levels of a tree, so that no count and no kind depends on
the cut.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgauge.llm.common import map_rows
from inkgauge.llm.lookalike import one_form
from inkgauge.session import checkpointed

PIECE_CHARS, FAN_IN = 1 << 20, 32
HEAD, LEFT = 256, 48
RARE, LIFT, LONGEST = 200, 3.0, 12  # a common word is in one of RARE texts with sentences, LIFT times its rate elsewhere, not longer than LONGEST
MOST_WORDS = 4_000

# Signs that belong to words of scripts that write vowels as marks.
MARKS = "̀-ͯ҃-֑҇-ֽؐ-ًؚ-ٰٟۖ-ۭऀ-ॣঀ-෿ั-ฺ็-๎ါ-ှ឴-៓‌‍"
WORD = re.compile(rf"[\w{MARKS}]+")
_WORD_START = re.compile(rf"[\w{MARKS}]")
_UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿]")
_SYMBOL = re.compile(rf"[^\w\s.,;:!?'\"“”‘’«»„()\-–—。，、！？；：「」『』（）।؟،؛…{MARKS}]")
SENTENCE_END = ".!?…。！？।؟۔"
CLOSERS = "\"'”’»)]}*_」』）"
_STOP = re.compile(rf"(?:(?<=[^\W\d_][^\W\d_])[.!?…؟۔]|(?<=[^\W\d_][\"'”’»)*_])[.!?…؟۔]|(?<=[{MARKS}])[.!?…])[.!?…]*[{re.escape(CLOSERS)}]{{0,3}}(?=\s|\Z)|[。！？।]")
_SEPARATORS = re.compile(r"[;|/&\t]")
_LIST = re.compile(
    r"\s*(?:[-*+•–▪◦‣·]\s+\S|\(?\d{1,4}[.)]\s|\\(?:begin|end|hline|item)|[\[{}\]<]|[0-9a-fA-F]{6,}\s|\d{4}-\d\d-\d\d|.*\.{5}|.*(?:[^,;|/\s]+[;|/] ?){4,})"
)
_TABLE = re.compile(r"\s*(?:\||\+[-=+]{3})|.*\t.*\t|\S+(?: {2,}\S+){2,}|.*&.*&|.*\\\\\s*$")

# The counts of a run, in this order; all add up.
RUN = ("chars", "words", "word_chars", "symbols", "lines", "ended", "common", "numeric", "stops", "commas", "seps", "unspaced", "short")
N_RUN = len(RUN)
PLAIN, LISTED, TABLED, BLANK, CLOSED = 0, 1, 2, 3, 4
KINDS = ("prose", "list", "table", "junk")
COUNTS = ("n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "punct_lines", "common_words", "prose_chars", "list_chars", "table_chars", "junk_chars")


def mark_of(head: str) -> int:
    """PLAIN, LISTED, TABLED or BLANK by the first characters of a line."""
    if not head or head.isspace():
        return BLANK
    if _TABLE.match(head):
        return TABLED
    return LISTED if _LIST.match(head) else PLAIN


def kind_of(mark: int, run: list) -> str:
    """prose, list, table or junk by the counts of a run and the set of its short words.

    A run of under five words without marks (a title) spoils nothing and counts as prose.
    """
    chars, words, word_chars, symbols, lines, ended, common, numeric, stops, commas, seps, unspaced, short = run[:N_RUN]
    if unspaced * 3 > word_chars:  # scripts without blanks: two signs to a word
        words = max(words, unspaced // 2)
    marked = mark != PLAIN
    if mark != TABLED and chars > 20 and (symbols > 0.25 * chars or (words >= 8 and word_chars < 2.2 * words and not unspaced)):
        return "junk"
    if chars > 40 and chars > 25 * words:  # encoded data: hardly a word, or words of no language
        return "junk"
    if words < 5 and not marked:
        return "prose"
    share = common / max(1, words)
    if share >= (0.2 if marked else 0.15) or (words < 12 and share >= 0.1 and not marked):
        return "prose"
    between = commas + seps
    if numeric <= 0.2 * words and symbols <= 0.1 * chars:
        # sentences: of four words or more on average, and none without an end for long
        if 3.5 * stops <= words <= 45 * stops and between <= 0.35 * words and (not marked or max(stops, ended) * 2 >= lines):
            return "prose"
        # running words without marks: the short ones come again and again, as only those of a grammar do
        if not marked and words >= 25 and between <= 0.25 * words and short >= 0.15 * words and short >= 1.4 * int.bit_count(run[N_RUN]):
            return "prose"
        if unspaced * 3 > word_chars and not marked and between <= 0.25 * words and chars >= 15 * lines:
            return "prose"
    if mark == TABLED or commas > 0.3 * words:
        return "table"
    return "list" if marked or chars < 45 * lines or seps > 0.2 * words else "junk"


def counts_of(text: str, left: str, right: str, common: frozenset | set, starts: int, ends: int) -> list:
    """The counts of a fragment between what stands before and after it; starts lines begin in it and ``ends`` of those that end there end in punctuation."""
    words = WORD.findall(text.lower())
    word_chars = sum(map(len, words))
    if words:
        if left and _WORD_START.match(left[-1]) and _WORD_START.match(text[0]):
            del words[0]  # it began before
        if words and right and _WORD_START.match(right[0]) and _WORD_START.match(text[-1]):
            words[-1] += WORD.match(right.lower()).group()
    plain = text.isascii()
    around = left[-2:] + text + right[:8]
    lo, hi = len(left[-2:]), len(left[-2:]) + len(text)
    stops = sum(lo <= m.start() < hi for m in _STOP.finditer(around)) if left or right else len(_STOP.findall(text))
    short, seen = 0, 0
    numeric = in_list = 0
    for w in words:
        if w in common:
            in_list += 1
        if len(w) <= 3:
            if w[0].isdigit():
                numeric += 1
            else:
                short += 1
                seen |= 1 << (hash_of(w) & 255)
        elif w[0].isdigit():
            numeric += 1
    return [
        len(text) - text.count("\n"), len(words), word_chars, len(_SYMBOL.findall(text)), starts, ends, in_list, numeric, stops,
        text.count(",") + (0 if plain else text.count("，") + text.count("、")), len(_SEPARATORS.findall(text)), 0 if plain else len(_UNSPACED.findall(text)), short, seen,
    ]


_HASH: dict[str, int] = {}


def hash_of(word: str) -> int:
    """A small hash that is the same in every process."""
    h = _HASH.get(word)
    if h is None:
        if len(_HASH) > 200_000:
            _HASH.clear()
        h = 0
        for c in word:
            h = (h * 1000003 ^ ord(c)) & 0xFFFFFFFF
        h = _HASH[word] = h ^ h >> 15
    return h


def added(a: list, b: list) -> list:
    out = [x + y for x, y in zip(a, b)]
    out[N_RUN] = a[N_RUN] | b[N_RUN]
    return out


def _ends_well(line: str) -> bool:
    return line.rstrip().rstrip(CLOSERS)[-1:] in SENTENCE_END if line and not line.isspace() and line.rstrip().rstrip(CLOSERS) else False


def piece_runs(piece: str, left: str, right: str, common: frozenset | set) -> tuple[list | None, list]:
    """(what goes on from the line before, runs [mark, counts]) of a piece between its neighbours' characters."""
    lines = piece.split("\n")
    head = None
    if left and left[-1] != "\n":  # the piece begins within a line
        x = lines.pop(0)
        if x:  # else the piece before held the line's end
            over = bool(lines) or not right or right[0] == "\n"
            head = counts_of(x, left, right if not lines else "\n", common, 0, int(over and _ends_well(left.rsplit("\n", 1)[-1] + x)))
    if right and lines and not lines[-1] and piece:
        lines.pop()  # the next piece begins a line of its own
    runs: list = []
    group: list[str] = []
    was, good = None, 0

    def close(after: str):
        if group:
            text = "\n".join(group)
            runs.append([was, counts_of(text, "", after, common, len(group) if was != BLANK else 0, good)])

    last = len(lines) - 1
    for k, x in enumerate(lines):
        after = right if k == last and piece and not piece.endswith("\n") else ""  # its line goes on
        m = mark_of(x[:HEAD] + after[: max(0, HEAD - len(x))].split("\n", 1)[0] if after else x[:HEAD])
        if m != was:
            close("")
            group, was, good = [], m, 0
        group.append(x)
        if not after or after[0] == "\n":
            good += m != BLANK and _ends_well(x)
    if group:
        close(right if right and not piece.endswith("\n") else "")
    return head, runs


def closed(runs: list) -> list:
    """One entry [CLOSED, sums of kinds, sums of counts] in place of runs that can't grow any more."""
    kinds, total = [0] * 4, [0] * (N_RUN + 1)
    for mark, *rest in runs:
        if mark == CLOSED:
            kinds = [a + b for a, b in zip(kinds, rest[0])]
            total = [a + b for a, b in zip(total, rest[1][:N_RUN] + [0])]
            continue
        c = rest[0]
        if mark != BLANK:
            kinds[KINDS.index(kind_of(mark, c))] += c[0]
        total = [a + b for a, b in zip(total, c[:N_RUN] + [0])]
    return [CLOSED, kinds, total]


def compressed(runs: list) -> list:
    return runs if len(runs) < 4 else [runs[0], closed(runs[1:-1]), runs[-1]]


def merged(a: tuple[list | None, list], b: tuple[list | None, list]) -> tuple[list | None, list]:
    """Two neighbouring stretches of a text as one."""
    (head, runs), (more, after) = a, b
    if more is not None:
        if runs:
            runs = [*runs[:-1], [runs[-1][0], added(runs[-1][1], more)]]
        else:
            head = more if head is None else added(head, more)
    if runs and after and runs[-1][0] == after[0][0]:
        runs, after = [*runs[:-1], [runs[-1][0], added(runs[-1][1], after[0][1])]], after[1:]
    return head, compressed(runs + after)


def sums_of(state: tuple[list | None, list]) -> tuple[int, ...]:
    """The counts of COUNTS of a whole text, but for the stored length."""
    _, kinds, total = closed(state[1])
    return (*total[:7], *kinds)


def text_counts(text: str, common: frozenset | set = frozenset(), piece_chars: int = PIECE_CHARS) -> tuple[int, ...]:
    """The counts of COUNTS of a text, without a table; n_chars is that of the one form without line feeds."""
    t = one_form(text)
    state = (None, [])
    for k in range(0, max(1, len(t)), piece_chars):
        state = merged(state, piece_runs(t[k : k + piece_chars], t[max(0, k - LEFT) : k], t[k + piece_chars : k + piece_chars + HEAD], common))
    return sums_of(state)


# --- common words ---


def common_words(records: DataFrame, key: str = "rec_id") -> frozenset[str]:
    """Words that stand in the sentences of many texts but hardly in lists, counted over all texts.

    A word counts once per text and side; which runs teach what is said by
    ``teaching_side()``, which knows no word. The MOST_WORDS most widespread
    pass, so the set is bounded.
    """
    once = records.select(key, "text").dropDuplicates([key])

    def count(b):
        both, texts = (Counter(), Counter()), [0, 0]
        for t in b.column(0).to_pylist():
            words: tuple[set, set] = (set(), set())
            for side, w in taught(t):
                words[side].update(w)
            for side in (0, 1):
                both[side].update(words[side])
                texts[side] += bool(words[side])
        words = sorted(both[0] | both[1])
        return {"word": [None, *words], "prose": [texts[0], *(both[0][w] for w in words)], "other": [texts[1], *(both[1][w] for w in words)]}

    c = checkpointed(map_rows(once.select("text"), count, "word string, prose long, other long").groupBy("word").agg(F.sum("prose").alias("prose"), F.sum("other").alias("other")))
    t = c.where("word is null").first()
    if t is None or not t["prose"]:
        return frozenset()
    p, o = t["prose"], t["other"]
    rate = F.col("prose") / p
    keep = c.where((F.col("prose") >= 3) & (rate * RARE >= 1) & (rate >= LIFT * (F.col("other") + 1) / max(RARE, o)))
    return frozenset(r["word"] for r in keep.where("word is not null").orderBy(F.desc("prose"), "word").limit(MOST_WORDS).collect())


def taught(text: str):
    """(side, words) of the runs of a text that teach."""
    for mark, group in _groups(one_form(text)):
        if mark == BLANK:
            continue
        words = WORD.findall(group.lower())
        side = teaching_side(mark, group, words)
        if side is not None:
            yield side, {w for w in set(words) if len(w) <= LONGEST and not w[0].isdigit()}


def teaching_side(mark: int, group: str, found: list[str]) -> int | None:
    """0 of a run (its lines, its words) that is surely sentences, 1 of one that surely is none (short lines or parts, no end of a sentence), else None."""
    words, stops = len(found), len(_STOP.findall(group))
    if mark == PLAIN and 3.5 * stops <= words <= 30 * stops and sum(w[0].isdigit() for w in found) <= 0.1 * words:
        return 0
    if stops or words < 8:
        return None
    parts = group.count("\n") + 1 + group.count(",") + (0 if group.isascii() else group.count("，") + group.count("、")) + len(_SEPARATORS.findall(group))
    return 1 if words <= 5 * parts and parts >= 4 else None


def _groups(text: str):
    """(mark, lines as one text) of each run."""
    was, group = None, []
    for x in text.split("\n"):
        m = mark_of(x[:HEAD])
        if m != was:
            if group:
                yield was, "\n".join(group)
            was, group = m, []
        group.append(x)
    if group:
        yield was, "\n".join(group)


# --- the statistics ---


def text_statistics(records: DataFrame, piece_chars: int = PIECE_CHARS, common: frozenset | None = None) -> DataFrame:
    """One row per distinct rec_id: counts, ratios and the rule outcomes.

    Counts are those of the text's one form, n_chars that of the stored text.
    Null texts give no row. An empty text has zero counts, null ratios and is
    neither prose nor junk. Repeated rows of an id count once. ``is_junk``: more
    than half of the characters in runs stand in lists, tables or junk. Without
    ``common``, the common words are learned from the records.
    """
    src = records.where("text is not null and rec_id is not null").select("rec_id", "text")
    if common is None:
        common = common_words(src)
    small = pa.schema([("rec_id", pa.string()), ("g", pa.int32()), ("k", pa.int32()), ("state", pa.binary()), ("piece", pa.string()), ("left", pa.string()), ("right", pa.string())])

    def cut(batches):
        """Short texts as their state, long ones as pieces with what stands around them."""
        for b in batches:
            out = {n: [] for n in small.names}

            def row(*v, out=out):
                for c, x in zip(out.values(), v, strict=True):
                    c.append(x)

            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = one_form(text)
                if len(t) <= piece_chars:
                    row(i, 0, 0, pickle.dumps((len(text), piece_runs(t, "", "", common) if piece_chars < len(t) else (None, [closed(piece_runs(t, "", "", common)[1])]))), None, None, None)
                    continue
                for k, a in enumerate(range(0, len(t), piece_chars)):
                    row(i, k // FAN_IN, k, pickle.dumps((0 if k else len(text), None)), t[a : a + piece_chars], t[max(0, a - LEFT) : a], t[a + piece_chars : a + piece_chars + HEAD])
            yield pa.record_batch(list(map(pa.array, out.values(), small.types)), schema=small)

    def level(df: DataFrame, last: bool) -> DataFrame:
        """Neighbouring rows of a (rec_id, g), in the order of k, merged into one; of repeated rows one counts."""
        types = [pa.string(), pa.int32(), pa.int32(), pa.binary()] if not last else [pa.string(), *[pa.int64()] * len(COUNTS)]
        names = ["rec_id", "g", "k", "state"] if not last else ["rec_id", *COUNTS]

        def merge(batches):
            key, at, chars, state = None, None, 0, (None, [])
            rows: list[tuple] = []

            def done():
                if key is not None:
                    rows.append((key[0], 0, key[1], pickle.dumps((chars, state))) if not last else (key[0], chars, *sums_of(state)[1:]))

            def batch(rows):
                return pa.record_batch([pa.array(c, type=t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types, strict=True)], names=names)

            for b in batches:
                cols = b.to_pydict()
                for j in range(b.num_rows):
                    now = (cols["rec_id"][j], cols["g"][j])
                    if now != key:
                        done()
                        key, at, chars, state = now, None, 0, (None, [])
                    if cols["k"][j] == at:
                        continue
                    at = cols["k"][j]
                    n, s = pickle.loads(cols["state"][j])
                    if s is None:
                        s = piece_runs(cols["piece"][j], cols["left"][j], cols["right"][j], common)
                    chars += n
                    state = s if state == (None, []) else merged(state, s)
                if len(rows) >= 4096:
                    yield batch(rows)
                    rows.clear()
            done()
            yield batch(rows)

        schema = "rec_id string, g int, k int, state binary" if not last else "rec_id string, " + ", ".join(f"{c} long" for c in COUNTS)
        return df.repartition("rec_id", "g").sortWithinPartitions("rec_id", "g", "k").mapInArrow(merge, schema)

    from inkgauge.session import ship_code

    ship_code(records.sparkSession)
    pieces = src.mapInArrow(cut, "rec_id string, g int, k int, state binary, piece string, left string, right string")
    s = level(level(pieces, False), True)
    bad = F.col("list_chars") + F.col("table_chars") + F.col("junk_chars")
    ratio = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return s.select(
        "rec_id",
        *COUNTS,
        ratio("word_chars", "n_words").alias("mean_word_len"),
        ratio("n_symbols", "n_chars").alias("symbol_ratio"),
        ratio("punct_lines", "n_lines").alias("punct_line_share"),
        ratio("common_words", "n_words").alias("common_word_share"),
        F.try_divide(bad, bad + F.col("prose_chars")).alias("non_prose_share"),
        F.coalesce(F.try_divide(bad, bad + F.col("prose_chars")) > 0.5, F.lit(False)).alias("is_junk"),
    )


def junk_records(records: DataFrame) -> DataFrame:
    """The rec_id of records that are lists, tables or junk for more than half of their text."""
    return text_statistics(records).where("is_junk").select("rec_id")
