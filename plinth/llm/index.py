"""Edit-distance joins through deletion neighbourhoods, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deletions(c: Column, most: int = 1) -> Column:
    """The distinct strings left by deleting up to ``most`` (0, 1 or 2) characters of ``c``."""

    def once(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))

    empty = F.array().cast("array<string>")
    one = F.when(F.length(c) > 1, once(c)).otherwise(empty)
    if most <= 0:
        return F.array(c)
    if most == 1:
        return F.array_distinct(F.concat(F.array(c), one))
    two = F.flatten(F.transform(one, lambda x: F.when(F.length(x) > 1, once(x)).otherwise(empty)))
    return F.array_distinct(F.concat(F.array(c), one, two))


#: Words of more letters have too many deletions and are met by their parts; a few lengths take both ways, so that no pair falls between them.
LONG = 64


def part_keys(c: Column, most: int = 2) -> Column:
    """The ``most`` + 1 equal parts of a string, each with its number and the string's length: ``probe_keys`` of any string within ``most`` edits has one of them."""
    n, k = F.length(c), most + 1
    cut_ = lambda i: F.floor(i * n / F.lit(k)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: F.concat_ws("|", n, i, F.substring(c, cut_(i) + 1, cut_(i + 1) - cut_(i))))


def probe_keys(c: Column, most: int = 2) -> Column:
    """What the parts of strings within ``most`` edits may be: one part at least is intact and has moved by ``most`` at most."""
    n, k = F.length(c), most + 1
    cut_ = lambda i, m: F.floor(i * m / F.lit(k)).cast("int")
    shifts = F.sequence(F.lit(-most), F.lit(most))

    def of(m: Column, i: Column) -> Column:
        size = cut_(i + 1, m) - cut_(i, m)
        at = F.filter(F.transform(shifts, lambda d: cut_(i, m) + d), lambda p: (p >= 0) & (p + size <= n))
        return F.transform(at, lambda p: F.concat_ws("|", m, i, F.substring(c, p + 1, size)))

    return F.flatten(F.transform(F.sequence(n - most, n + most), lambda m: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: of(m, i)))))


def short_keys(c: Column, most: Column | int) -> Column:
    """The deletions under which strings within ``most`` (0 to 2) edits meet; none for long strings. Both sides of a join take the same."""
    m = F.lit(most) if isinstance(most, int) else most
    few = F.when(m <= 0, deletions(c, 0)).when(m == 1, deletions(c, 1)).otherwise(deletions(c, 2))
    return F.when(F.length(c) <= LONG + 2, few).otherwise(F.array().cast("array<string>"))


def long_keys(c: Column, probe: bool) -> Column:
    """The parts under which long strings within two edits meet; none for short strings. One side of a join takes them with ``probe``, the other without."""
    return F.when(F.length(c) > LONG - 2, probe_keys(c) if probe else part_keys(c)).otherwise(F.array().cast("array<string>"))


def near_keys(c: Column, most: Column | int, probe: bool) -> Column:
    """``short_keys`` and ``long_keys`` together."""
    return F.concat(short_keys(c, most), long_keys(c, probe))


def edit_join(words: DataFrame, vocabulary: DataFrame, *, short: int = 4, long: int = 6) -> DataFrame:
    """word, entry, distance: words and vocabulary entries at most 0, 1 or 2 edits apart, by the word's length.

    Both sides are one column of distinct strings (``word``, ``entry``). Words under ``short`` characters must be
    equal; those under ``long`` may have one edit. Two strings at distance d share a string left by deleting at most
    d characters of each, or, if they are long, an intact part (``near_keys``), so the join is an equi-join on these, never of all
    pairs; the distance itself follows. Two letters in exchanged places count as one edit of the result, and as two against the limit.
    """
    most = F.when(F.length("word") < short, 0).when(F.length("word") < long, 1).otherwise(2)
    w = words.where("word is not null and word <> ''").select("word", F.explode(near_keys(F.col("word"), most, True)).alias("v"))
    e = vocabulary.where("entry is not null and entry <> ''").select("entry", F.explode(near_keys(F.col("entry"), 2, False)).alias("v"))
    hits = w.join(e, "v").select("word", "entry").distinct()
    d = F.levenshtein("word", "entry")
    letters = lambda c: F.array_sort(F.split(c, ""))
    swapped = (d == 2) & (F.length("word") == F.length("entry")) & (letters("word") == letters("entry"))
    return hits.withColumn("distance", d).where(F.col("distance") <= most).withColumn("distance", F.when(swapped, 1).otherwise(F.col("distance")))
