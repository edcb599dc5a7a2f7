"""BM25 with IDF over distinct trigrams, as column expressions; scores run from 0 to 100."""

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.5, 0.75


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def norm(length: Column, average: Column) -> Column:
    """The length's share of a term's weight; 1 for an empty corpus."""
    return F.when(average > 0, F.lit(1 - B) + F.lit(B) * length / average).otherwise(F.lit(1.0))


def term(idf_: Column, norm_: Column) -> Column:
    """A trigram's weight; it occurs once in a document, as trigrams are distinct."""
    return idf_ * F.lit(K1 + 1) / (F.lit(1.0) + F.lit(K1) * norm_)


def score_max(n: Column) -> Column:
    """The greatest weight of one term, by which sums are normalised."""
    return F.log((n + F.lit(0.5)) / F.lit(0.5) + F.lit(1.0)) * F.lit(K1 + 1)


def scaled(total: Column, most: Column) -> Column:
    return F.round(F.least(total / most * F.lit(100.0), F.lit(100.0)), 2)


def field_score(trigrams: Column, idfs: Column, norm_: Column) -> Column:
    """Sum of terms of a field's trigrams that the map idfs (trigram -> idf) has."""
    hits = F.filter(trigrams, lambda t: F.map_contains_key(idfs, t))
    return F.aggregate(hits, F.lit(0.0), lambda a, t: a + term(F.element_at(idfs, t), norm_))
