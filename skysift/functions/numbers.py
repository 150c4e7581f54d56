"""Column functions on scores, fractions, tiers and outcomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Relative score from which a record counts as high or middle.
HIGH_RATIO, MIDDLE_RATIO = 0.70, 0.40

# Summed grid score from which a record counts as high or middle.
HIGH_SUM, MIDDLE_SUM = 35, 20


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def volunteer_rating(weighted_count: Column | str) -> Column:
    """Weighted vote count in percent as a fraction; blank stays null."""
    return F.trim(_col(weighted_count).cast("string")).try_cast("double") * 0.01


def fraction(c: Column | str) -> Column:
    """Percentage or fraction as a fraction within [0, 1]."""
    c = _col(c)
    return F.least(F.greatest(F.when(c > 1, c / 100).otherwise(c), F.lit(0.0)), F.lit(1.0))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 when the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def f1_of(precision: Column, recall: Column) -> Column:
    return share(2 * (precision * recall), precision + recall)


def score_tier(score: Column | str, top: Column | str | float) -> Column:
    """high / middle / low by score relative to the top score, none without a positive top."""
    top = F.lit(top) if isinstance(top, (int, float)) else _col(top)
    ratio = F.try_divide(_col(score).cast("double"), top.cast("double"))
    return (
        F.when(top.isNull() | (top <= 0), "none")
        .when(ratio >= HIGH_RATIO, "high")
        .when(ratio >= MIDDLE_RATIO, "middle")
        .otherwise("low")
    )


def score_percent(score: Column | str, top: Column | str) -> Column:
    score, top = _col(score), _col(top)
    return F.when(top > 0, score / top * 100).otherwise(0.0)


def sum_tier(score: Column | str) -> Column:
    score = _col(score)
    return F.when(score >= HIGH_SUM, "high").when(score >= MIDDLE_SUM, "middle").otherwise("low")


def at_least(score: Column | str, threshold: float, strict: bool = False) -> Column:
    score = _col(score)
    return score > threshold if strict else score >= threshold


def expert_tier(score: Column | str, threshold: float = 0.4, strict: bool = False) -> Column:
    return (
        F.when(at_least(score, threshold, strict), "high")
        .when(_col(score) > 0, "middle")
        .otherwise("low")
    )


def outcome(score: Column | str, truth: Column | str, threshold: Column | float) -> Column:
    """tp / fp / fn / tn for the prediction score >= threshold; truth is 0 or 1."""
    cut = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    chosen, truth = _col(score) >= cut, _col(truth).cast("int") == 1
    return (
        F.when(truth & chosen, "tp").when(~truth & chosen, "fp").when(truth, "fn").otherwise("tn")
    )


def histogram_bin(score: Column | str, how: str) -> Column:
    """Bin of a score: exact (6 digits), trunc (towards zero) or halfeven (nearest whole)."""
    score = _col(score).cast("double")
    if how == "exact":
        return F.bround(score, 6)
    if how == "trunc":
        return score.cast("bigint")
    if how == "halfeven":
        return F.bround(score, 0).cast("bigint")
    raise ValueError(f"unknown bin rule {how!r}")


def grid_bin(x: Column | str, width: float) -> Column:
    """Index of the nearest multiple of `width`, ties to even."""
    return F.bround(_col(x) / F.lit(width), 0).cast("bigint")
