"""Column expressions shared by operators and queries.

Everything here composes ``pyspark.sql.functions`` so it stays inside
whole-stage codegen; nothing is evaluated in Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "col_", "blank_to_null", "not_blank", "year_of", "date_rest", "numeric_stop",
    "whitespace_to_commas", "first_digits", "runs_of", "tokens", "chi_sq", "pmi",
    "normalise_name", "similarity", "partial_similarity", "round6", "ts_text",
]


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c) -> Column:
    """``nullif(trim(c), '')`` — the single ingest-time null rule."""
    return F.nullif(F.trim(col_(c)), F.lit(""))


def not_blank(c) -> Column:
    """Not null and not blank after trimming."""
    c = col_(c)
    return c.isNotNull() & (F.trim(c) != "")


def year_of(c) -> Column:
    """Text before the first '-' (the whole string when there is none)."""
    return F.split_part(col_(c), F.lit("-"), F.lit(1))


def date_rest(c) -> Column:
    """Text after the first '-', null when there is none."""
    return F.try_element_at(F.split(col_(c), "-", 2), F.lit(2))


def ts_text(c) -> Column:
    """Timestamp rendered as the crawler's ``YYYY-MM-DD hh:mm:ss`` text."""
    return F.date_format(col_(c), "yyyy-MM-dd HH:mm:ss")


def numeric_stop(c) -> Column:
    """True for the strings '0' ... '9999' (no leading zeros), i.e. the
    reference's numeric stop list expressed as a predicate, not a 10 000-row table."""
    c = col_(c)
    return c.rlike("^[0-9]{1,4}$") & ((c == "0") | (F.substring(c, 1, 1) != "0"))


def whitespace_to_commas(c) -> Column:
    """Every whitespace or Unicode space character becomes one ',' (no collapsing)."""
    return F.regexp_replace(col_(c), r"[\s\p{Z}]", ",")


def first_digits(c) -> Column:
    """First run of digits, null when there is none."""
    return F.nullif(F.regexp_extract(col_(c), r"(\d+)", 1), F.lit(""))


def runs_of(c, between: str) -> Column:
    """The maximal runs between matches of ``between``, none of them empty.

    Splitting reads a text once; ``regexp_extract_all`` copies the whole text for
    every match, which is quadratic in the text."""
    return F.array_remove(F.split(col_(c), between), "")


def tokens(c, lower: bool = True) -> Column:
    """N1 'words' mode: maximal runs of letters (any script), lower-cased."""
    c = col_(c)
    if lower:
        c = F.lower(c)
    return runs_of(c, r"\P{L}+")


def _d(x) -> Column:
    return col_(x).cast("double")


def chi_sq(n_ii, n_ix, n_xi, n_xx) -> Column:
    """Pearson chi-square of the 2x2 table given marginals (bigram/word
    association).  n_ii joint count, n_ix and n_xi marginals, n_xx total.
    Zero denominators give 0 instead of a division error."""
    a, ix, xi, n = _d(n_ii), _d(n_ix), _d(n_xi), _d(n_xx)
    b = ix - a          # n_io
    c = xi - a          # n_oi
    d = n - a - b - c   # n_oo
    den = (a + b) * (a + c) * (b + d) * (c + d)
    return F.when(den == 0, F.lit(0.0)).otherwise(n * F.pow(a * d - b * c, 2) / den)


def pmi(n_ii, n_ix, n_xi, n_xx) -> Column:
    """F1 alternative measure: log2(n_ii * n_xx / (n_ix * n_xi))."""
    num = _d(n_ii) * _d(n_xx)
    den = _d(n_ix) * _d(n_xi)
    return F.when((num <= 0) | (den <= 0), F.lit(None).cast("double")).otherwise(F.log2(num / den))


def normalise_name(c) -> Column:
    """N14 pre-processing: lower case, every non letter/digit -> space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(col_(c)), r"[^\p{L}\p{N}]+", " "))


def similarity(a, b) -> Column:
    """N14 similarity 0..100 from the Levenshtein distance of two strings."""
    a, b = col_(a), col_(b)
    m = F.greatest(F.length(a), F.length(b))
    return F.when(m == 0, F.lit(100)).otherwise(
        F.round(F.lit(100.0) * (F.lit(1.0) - F.levenshtein(a, b) / m)).cast("int"))


def partial_similarity(a, b) -> Column:
    """N14 'partial' mode: best similarity of the shorter string against every
    same-length window of the longer one (handles containment)."""
    a, b = col_(a), col_(b)
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long_ = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    ls, ll = F.length(short), F.length(long_)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(ll - ls + 1, F.lit(1))),
                          lambda i: similarity(short, F.substring(long_, i, ls)))
    return F.when(ls == 0, F.lit(0)).otherwise(F.array_max(windows))


def round6(c) -> Column:
    return F.round(col_(c).cast("double"), 6)
