"""String similarity in column expressions; Python only for many pairs of distinct values."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two texts, as a fold over a row of the dynamic programme."""
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    zero = F.array_repeat(F.lit(0), F.size(chars(b)) + 1)

    def row(before: Column, x: Column) -> Column:
        step = F.aggregate(
            F.sequence(F.lit(0), F.size(chars(b)) - 1), F.array(F.lit(0)),
            lambda acc, j: F.concat(acc, F.array(F.when(F.get(chars(b), j) == x, F.get(before, j) + 1).otherwise(F.greatest(F.get(before, j + 1), F.element_at(acc, -1))))),
        )
        return F.when(F.size(chars(b)) > 0, step).otherwise(before)

    return F.element_at(F.aggregate(chars(a), zero, row), -1)


def indel_ratio(a: Column, b: Column) -> Column:
    """100 x twice the common subsequence over both lengths: similarity by insertions and deletions."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(200.0 * lcs_length(a, b) / total)


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda t: t != "")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    """``indel_ratio`` of the texts with their words in order."""
    return indel_ratio(sorted_tokens(a), sorted_tokens(b))


def token_set_ratio(a: Column, b: Column) -> Column:
    """The best ``indel_ratio`` among the common words and the common words with each side's rest; 100 if one's words are all in the other."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda t: t != ""))
    both = F.array_join(F.array_sort(F.array_intersect(words(a), words(b))), " ")
    rest = lambda x, y: F.array_join(F.array_sort(F.array_except(words(x), words(y))), " ")
    ab, ba = F.trim(F.concat_ws(" ", both, rest(a, b))), F.trim(F.concat_ws(" ", both, rest(b, a)))
    inside = (both != "") & ((rest(a, b) == "") | (rest(b, a) == ""))
    with_both = F.when(both != "", F.greatest(indel_ratio(both, ab), indel_ratio(both, ba))).otherwise(0.0)
    return F.when(inside, F.lit(100.0)).otherwise(F.greatest(with_both, indel_ratio(ab, ba)))


def partial_ratio(a: Column, b: Column) -> Column:
    """The best ``indel_ratio`` of the shorter text with a window of its length in the longer."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(long) - F.length(short) + 1))
    return F.when(F.length(short) == 0, F.lit(0.0)).otherwise(F.array_max(F.transform(starts, lambda i: indel_ratio(short, F.substring(long, i, F.length(short))))))


def token_overlap(a: Column, b: Column) -> Column:
    """Common words over the larger number of words."""
    words = lambda c: F.array_distinct(F.split(F.lower(F.trim(c)), r"[\s_]+"))
    return F.size(F.array_intersect(words(a), words(b))) / F.greatest(F.size(words(a)), F.size(words(b)))


def letters(c: Column) -> Column:
    """A bigint with a bit for each of 64 classes of characters that occur in a text."""
    return F.aggregate(F.split(c, ""), F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(F.when(x == "", F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(x).bitwiseAND(63)))))


def near_pairs(left: DataFrame, right: DataFrame, a: str, b: str, cutoff: float, on: Column | None = None, salts: int = 16) -> DataFrame:
    """The rows of both sides (within ``on``) whose texts ``a`` and ``b`` may have a similarity of ``cutoff`` (0 to 1) or more; no such pair is lost.

    A ratio of twice the common characters over both lengths leaves at most ``(1 - cutoff)`` of the lengths' sum uncommon. The difference of
    lengths, the classes of characters that one side alone has, and the edit distance are each at most the number of uncommon characters.
    The right side meets each of ``salts`` parts of the left, so that one hot key spreads over tasks.
    """
    x = left.withColumns({"__m": letters(F.col(a)), "__s": F.pmod(F.xxhash64(a), F.lit(salts)).cast("int")})
    y = right.withColumns({"__n": letters(F.col(b)), "__t": F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))})
    most = f"cast(floor((length({a}) + length({b})) * {1 - cutoff!r}D + 1e-9D) as int)"
    close = F.expr(f"abs(length({a}) - length({b})) <= {most} and bit_count(__m ^ __n) <= {most} and levenshtein({a}, {b}, {most}) >= 0")
    same = F.col("__s") == F.col("__t")
    return x.join(y, same if on is None else on & same).where(close).drop("__m", "__n", "__s", "__t")


@F.pandas_udf(T.DoubleType())
def matching_blocks_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff and Obershelp's ratio, 0 to 1. Call it on distinct pairs."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a word of bits at a time."""
    full, mask = (1 << len(a)) - 1, {}
    for i, x in enumerate(a):
        mask[x] = mask.get(x, 0) | 1 << i
    v = full
    for x in b:
        u = v & mask.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@F.pandas_udf(T.DoubleType())
def indel_ratio_of_pairs(a: pd.Series, b: pd.Series) -> pd.Series:
    """``indel_ratio`` of many pairs, without a row of the dynamic programme for each character. Call it on distinct pairs."""
    return pd.Series([200.0 * _common(x, y) / (len(x) + len(y)) if x or y else 100.0 for x, y in zip(a, b, strict=True)], dtype="float64")


def _window_ratio(a: str, b: str) -> float:
    """The best ``indel_ratio`` of the shorter text with a window of its length in the longer, those that begin or end with it included."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    n = len(a)
    return max(200.0 * _common(a, w) / (n + len(w)) for i in range(1 - n, len(b)) if (w := b[max(0, i) : i + n]))


def _set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    p, q = f"{both} {' '.join(sorted(x - y))}".strip(), f"{both} {' '.join(sorted(y - x))}".strip()
    if both and (x <= y or y <= x):
        return 100.0
    ratio = lambda s, t: 200.0 * _common(s, t) / (len(s) + len(t)) if s or t else 100.0
    return max(ratio(p, q), ratio(both, p) if both else 0.0, ratio(both, q) if both else 0.0)


@F.pandas_udf(T.DoubleType())
def best_of_three(a: pd.Series, b: pd.Series) -> pd.Series:
    """The best of the token-set, token-sort and window similarities of many pairs. Call it on distinct pairs of lower-case texts."""

    def one(x: str, y: str) -> float:
        s, t = " ".join(sorted(x.split())), " ".join(sorted(y.split()))
        return max(_set_ratio(x, y), 200.0 * _common(s, t) / (len(s) + len(t)) if s or t else 100.0, _window_ratio(x, y))

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
