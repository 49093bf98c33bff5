"""Column builders: words, tokens, sentences, paragraphs, array statistics, percentiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkgauge.functions import patterns as P


def find_all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, rf"^{P.WS}+|{P.WS}+$", "")


def words_ascii(c: Column) -> Column:
    """Runs of ASCII letters and apostrophes."""
    return find_all(c, P.WORD_ASCII)


def words_unicode(c: Column) -> Column:
    """Runs of letters, digits and underscores, inner apostrophes included."""
    return find_all(c, P.WORD_UNICODE)


def tokens(c: Column) -> Column:
    """Runs between white space."""
    return find_all(c, P.TOKEN)


def query_terms(c: Column, most: int = 15) -> Column:
    """Lower-cased plain words of more than three characters, the first ``most``."""
    return F.slice(F.filter(find_all(F.lower(c), P.WORD_PLAIN), lambda w: F.length(w) > 3), 1, most)


def _nonempty(a: Column) -> Column:
    return F.filter(a, lambda x: x != "")


def sentences(c: Column) -> Column:
    """Per line, cut before a capital or digit that follows an end mark and white space."""
    lines = _nonempty(F.transform(F.split(c, "\n"), strip))
    return F.flatten(F.transform(lines, lambda p: _nonempty(F.transform(F.split(p, P.SENTENCE_GAP), strip))))


def sentences_loose(c: Column, least: int = 2) -> Column:
    """Over the whole text, cut after any end mark; parts of fewer than ``least`` tokens are left out."""
    return F.filter(F.split(c, P.LOOSE_GAP), lambda s: F.size(tokens(s)) >= least)


def paragraphs(c: Column) -> Column:
    return _nonempty(F.transform(F.split(c, P.PARAGRAPH_GAP), strip))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def mean(a: Column) -> Column:
    """Null of an empty array."""
    return total(a) / F.nullif(F.size(a), F.lit(0))


def stdev(a: Column, population: bool = False) -> Column:
    """Sample (or population) deviation; 0 of fewer than two values. One pass (Welford).

    A lambda must not hold an expression over the whole array, such as its
    mean: it would be evaluated once per element.
    """
    zero = F.lit(0.0)
    start = F.struct(zero.alias("n"), zero.alias("m"), zero.alias("s"))

    def step(acc, x):
        x = x.cast("double")
        d = x - acc["m"]
        m = acc["m"] + d / (acc["n"] + 1)
        return F.struct((acc["n"] + 1).alias("n"), m.alias("m"), (acc["s"] + d * (x - m)).alias("s"))

    return F.aggregate(a, start, step, lambda acc: F.when(acc["n"] > 1, F.sqrt(acc["s"] / (acc["n"] if population else acc["n"] - 1))).otherwise(zero))


def share(a: Column, test) -> Column:
    return F.size(F.filter(a, test)) / F.nullif(F.size(a), F.lit(0))


def adjacent(a: Column, fn, lag: int = 1) -> Column:
    """fn of each element and the one lag places on."""
    n = F.greatest(F.size(a) - lag, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + lag), n), fn)


def exploded(df, keep: list, values: Column, name: str, pos: str | None = None):
    """Rows of an array's elements.

    The outer generators: for the plain ones the optimizer adds a filter on the
    array's size below, and with it computes the array, however dear, twice.
    """
    if pos is None:
        return df.select(*keep, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())
    return df.select(*keep, F.posexplode_outer(values).alias(pos, name)).where(F.col(name).isNotNull())


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)


def pct_linear(c: Column, p: float) -> Column:
    """An aggregate: linear interpolation at p * (n - 1). Its state holds the distinct values; see operators.quantiles for real numbers."""
    return F.percentile(c, F.lit(p))
