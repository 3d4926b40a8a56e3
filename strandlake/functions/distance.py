"""Distance predicates (FN19, FN20, A7)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .alphabet import window


def hamming(query: Column, ref: Column, pos: Column, k: int | None = None) -> Column:
    """Mismatches of the query with the window of its length at pos; with k, null where the edit distance is greater.

    An edit distance is never above the number of mismatches, and levenshtein() stops beyond k: with k, few windows have
    their letters compared one by one.
    """
    m = F.length(query)
    if k is not None:
        return F.when(F.levenshtein(query, window(ref, pos, m), k) >= 0, hamming(query, ref, pos))
    q, w = query.cast("binary"), F.substring(ref.cast("binary"), (pos + 1).cast("int"), m)
    return F.aggregate(F.sequence(F.lit(1), m), F.lit(0), lambda a, i: a + F.when(F.substring(q, i, F.lit(1)) == F.substring(w, i, F.lit(1)), 0).otherwise(1))


def edit(query: Column, ref: Column, pos: Column, k: int) -> Column:
    """Least edit distance of the query to any substring that starts at pos, null above k.

    Decision: hits are a set keyed by start, with the least errors over all match lengths m-k to m+k.
    """
    m = F.length(query)
    lengths = F.sequence(F.greatest(m - k, F.lit(0)), m + k)
    return F.array_min(F.filter(F.transform(lengths, lambda n: F.levenshtein(query, window(ref, pos, n), k)), lambda d: d >= 0))
