"""LaTeX and Markdown to prose, protected spans, span-aware edits."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from inkgauge.functions import patterns as P
from inkgauge.functions import textkit as T

# Patterns of markup.
ENVIRONMENT = r"(?s)\\begin\{(" + "|".join(e.replace("*", r"\*") for e in P.DROPPED_ENVIRONMENTS) + r")\}.*?\\end\{\1\}"
MATH = r"(?s)\$\$.*?\$\$|(?<!\\)\$[^$]*\$|\\\[.*?\\\]|\\\(.*?\\\)"
REFERENCE = r"\\(?:cite[tp]?|ref|eqref|label|autoref|nameref|input|include|bibliography|bibliographystyle)\s*\{[^{}]*\}"
WRAPPER = r"\\(?:textbf|textit|emph|texttt|textsc|underline|footnote|caption|textnormal|mbox|text)\s*\{([^{}]*)\}"
FENCE = r"(?smd)^```.*?^```"
MD_TABLE = r"(?md)^\|.*\|[ \t]*$"
ENVIRONMENT_DEPTH = 3  # environments nested in one another that are dropped
LATEX_STEPS = [
    (r"(?md)(?<!\\)%.*$", ""),
    *[(ENVIRONMENT, " ")] * ENVIRONMENT_DEPTH,
    (MATH, " value "),
    (r"\\(?:sub){0,2}section\*?\{([^{}]*?)\.*\}", " $1. "),
    (REFERENCE, " "),
    *[(WRAPPER, "$1")] * 4,
    (r"\\[a-zA-Z@]+\*?(?:\[[^\]]*\])?", " "),
    (r"\\([%&_$#])", "$1"),
    ("~", " "),
    ("---", "—"),
    ("--", "–"),
    (r"[{}]", ""),
    (r"[ \t]+", " "),
    (r"\n{3,}", "\n\n"),
]
MARKDOWN_STEPS = [
    (FENCE, " "),
    (MD_TABLE, " "),
    (r"(?md)^#{1,6}[ \t]+(.*?)\.*$", "$1."),
    (r"!\[[^\]]*\]\([^)]*\)", " "),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"`([^`]*)`", "$1"),
    (r"(\*\*|__|\*|_)(.+?)\1", "$2"),
    (r"(?md)^[ \t]*[-*+][ \t]+", ""),
    (r"(?md)^[ \t]*>[ \t]?", ""),
    (r"[ \t]+", " "),
]
SPAN_SOURCES = {
    "latex": (ENVIRONMENT, r"(?s)\$\$.*?\$\$|(?<!\\)\$[^$]*\$", r"(?s)\\\[.*?\\\]|\\\(.*?\\\)", REFERENCE, r"\\[a-zA-Z@]+\*?\{[^{}]*\}", r"\d[\d,.]*\s*-{2,3}\s*\d[\d,.]*", r"(?m)^\s*\\(?:usepackage|documentclass|newcommand|def)\b.*$"),
    "markdown": (FENCE, MD_TABLE, r"`[^`]*`", r"\]\([^)]*\)"),
}


def guess_format(t: Column) -> Column:
    return F.when(t.rlike(P.LATEX_SIGNS), "latex").when(t.rlike(P.MARKDOWN_SIGNS), "markdown").otherwise("plain")


def _chain(t: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, new in steps:
        t = F.regexp_replace(t, pattern, new)
    return t


def detex(t: Column, math_word: str = "value") -> Column:
    """Prose of a LaTeX text; headings become sentences, formulas one word, environments of data fall out."""
    return T.strip(_chain(t, [(p, f" {math_word} " if p == MATH else new) for p, new in LATEX_STEPS]))


def demarkdown(t: Column) -> Column:
    """Prose of a Markdown text; fences, tables and images fall out, headings become sentences."""
    return T.strip(_chain(t, MARKDOWN_STEPS))


def to_prose(t: Column, fmt: Column | None = None) -> Column:
    kind = F.lower(F.coalesce(fmt, guess_format(t))) if fmt is not None else guess_format(t)
    return F.when(kind.isin("latex", "tex"), detex(t)).when(kind.isin("markdown", "md"), demarkdown(t)).otherwise(t)


def strip_tags(t: Column) -> Column:
    """Text of an HTML page: scripts, styles and tags out, common entities in."""
    return T.strip(_chain(t, [(r"(?is)<(script|style)\b.*?</\1>", " "), (r"(?i)<(?:br|/p|/div|/h[1-6]|/li)\s*/?>", "\n"), (r"(?s)<[^>]*>", ""), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]))


# Offsets of matches have no built-in expression, so spans are found in Arrow batches.

def _compiled(kind: str) -> list[re.Pattern]:
    if kind not in _CACHE:
        _CACHE[kind] = [re.compile(p.replace("(?smd)", "(?sm)").replace("(?md)", "(?m)")) for p in SPAN_SOURCES.get(kind, ())]
    return _CACHE[kind]


_CACHE: dict[str, list[re.Pattern]] = {}


def _kind(text: str, fmt: str | None) -> str:
    if fmt:
        return {"tex": "latex", "md": "markdown"}.get(fmt.lower(), fmt.lower())
    if re.search(P.LATEX_SIGNS, text):
        return "latex"
    return "markdown" if re.search(P.MARKDOWN_SIGNS.replace("(?md)", "(?m)"), text) else "plain"


def find_spans(text: str, fmt: str | None = None) -> list[tuple[int, int]]:
    """Merged, sorted character ranges an edit must leave alone."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(m.span() for p in _compiled(_kind(text, fmt)) for m in p.finditer(text)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def edit_dashes(text: str, fmt: str | None = None) -> tuple[str, int]:
    """Dash runs outside spans and rule lines replaced by a comma; how many were."""
    kind = _kind(text, fmt)
    dash = re.compile(P.DASH_EDIT_LATEX if kind == "latex" else P.DASH_EDIT)
    rule = re.compile(P.RULE_LINE.replace("(?md)", "(?m)"))
    out, n, at = [], 0, 0
    for a, b in [*find_spans(text, kind), (len(text), len(text))]:
        lines = []
        for line in text[at:a].split("\n"):
            if not rule.fullmatch(line):
                line, k = dash.subn(", ", line)
                n += k
            lines.append(line)
        out += ["\n".join(lines), text[a:b]]
        at = b
    return re.sub(r",[ \t]*,", ",", "".join(out)), n


@F.pandas_udf(returnType=ArrayType(StructType([StructField("a", IntegerType()), StructField("b", IntegerType())])))
def protected_spans(text: pd.Series, fmt: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else [{"a": a, "b": b} for a, b in find_spans(t, f)] for t, f in zip(text, fmt, strict=True)])


@F.pandas_udf(returnType=StructType([StructField("text", StringType()), StructField("n", IntegerType())]))
def scalpel(text: pd.Series, fmt: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if t is None else edit_dashes(t, f) for t, f in zip(text, fmt, strict=True)]
    return pd.DataFrame(rows, columns=["text", "n"])
