"""Vector arithmetic as column expressions (accumulated in double)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published precision of scores and vector elements, int8 range.
SCORE_DIGITS = 6
ELEMENT_DIGITS = 6
INT8_MAX = 127


def inner_product(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; null when either vector has length zero.

    Pass stored norms to avoid summing the squares again.
    """
    lengths = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.try_divide(inner_product(a, b), lengths)


def round_score(score: Column) -> Column:
    return F.round(score, SCORE_DIGITS)


def normalize(a: Column) -> Column:
    """Unit-length copy; a zero vector stays zero."""
    scaled = F.transform(
        F.array(norm(a)),
        lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))),
    )
    return F.element_at(scaled, 1)


def max_abs(a: Column) -> Column:
    return F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))


def quantize_int8(a: Column, peak: float | Column) -> Column:
    """Scalar int8 codes for a table-wide peak absolute value.

    Elements beyond the peak (only possible for queries) saturate.
    """
    peak = peak if isinstance(peak, Column) else F.lit(float(peak))

    def code(x: Column) -> Column:
        scaled = F.round(F.coalesce(F.try_divide(x.cast("double"), peak), F.lit(0.0)) * F.lit(INT8_MAX))
        return F.greatest(F.lit(-INT8_MAX), F.least(F.lit(INT8_MAX), scaled)).cast("tinyint")

    return F.transform(a, code)


def hash_buckets(text: Column, dim: int) -> Column:
    """Signed bucket code in ``[0, 2 * dim)`` for each token of a text.

    Codes below ``dim`` add one to their bucket, the others take one away.
    """
    tokens = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: t != "")
    return F.transform(
        tokens,
        lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint"), F.lit(2 * dim)).cast("int"),
    )


def hash_vector(text: Column, dim: int = 64) -> Column:
    """Feature-hashed, L2-normalised bag of words, computed within the row.

    Nothing is exploded or grouped, so there is no shuffle. A text without
    tokens, or whose signs cancel, gets the zero vector.
    """

    def totals(codes: Column) -> Column:
        def bucket(i: Column) -> Column:
            return F.size(F.array_remove(codes, i + dim)) - F.size(F.array_remove(codes, i))

        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), bucket)

    counts = F.element_at(F.transform(F.array(hash_buckets(text, dim)), totals), 1)
    unit = F.element_at(F.transform(F.array(counts), normalize), 1)
    return F.transform(unit, lambda x: x.cast("float"))
