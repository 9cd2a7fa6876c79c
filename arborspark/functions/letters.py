"""Letter-pair similarity of texts (Simon White's measure): multiset Dice over the letter pairs of all words.

Texts are left-trimmed and upper-cased, words are parted by white space.  Null or
empty texts compare as -1; two texts without letter pairs as 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def letter_pairs(text: Column) -> Column:
    """All letter pairs of a text, with repeats."""
    words = F.filter(F.split(F.upper(F.ltrim(text)), r"\s+"), lambda w: F.length(w) > 1)
    return F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))))


def _times(pairs: Column, pair: Column) -> Column:
    return F.size(F.filter(pairs, lambda x: x == pair))


def shared_pairs(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, pair: n + F.least(_times(a, pair), _times(b, pair)))


def text_similarity(a: Column, b: Column) -> Column:
    pa, pb = letter_pairs(a), letter_pairs(b)
    size = F.size(pa) + F.size(pb)
    missing = a.isNull() | b.isNull() | (F.length(a) == 0) | (F.length(b) == 0)
    return F.when(missing, F.lit(-1.0)).when(size == 0, F.lit(0.0)).otherwise(2.0 * shared_pairs(pa, pb) / F.greatest(size, F.lit(1)))


def best_matches(texts_a: Column, texts_b: Column) -> Column:
    """For each text of array a its greatest similarity to a text of array b; [-1] if either is null or empty."""
    none = texts_a.isNull() | texts_b.isNull() | (F.size(texts_a) < 1) | (F.size(texts_b) < 1)
    return F.when(none, F.array(F.lit(-1.0))).otherwise(F.transform(texts_a, lambda a: F.array_max(F.transform(texts_b, lambda b: text_similarity(a, b)))))


def fragments(text: Column, separator: str, removed: str) -> Column:
    """A text split at a literal separator; characters of the class `removed` go, then empty fragments.

    Empty fragments at the end go in any case.
    """
    parts = F.split(text, "\\Q" + separator + "\\E")
    if removed:
        return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, f"[{removed}]", "")), lambda x: x != "")
    solid = F.transform(parts, lambda x, i: F.when(x != "", i + 1).otherwise(0))
    return F.slice(parts, F.lit(1), F.array_max(solid))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x) / F.size(values)


def complex_similarity(a: Column, b: Column, separator: str = ";", removed: str = "") -> Column:
    """Mean of the two means of best matches between the fragments of two texts."""
    missing = a.isNull() | b.isNull() | (F.length(a) == 0) | (F.length(b) == 0)
    fa, fb = fragments(a, separator, removed), fragments(b, separator, removed)
    return F.when(missing, F.lit(-1.0)).otherwise((_mean(best_matches(fa, fb)) + _mean(best_matches(fb, fa))) / 2)
