"""Scores and checks from judgment logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skysift.operators.ordering import first_in


class IntegrityError(RuntimeError):
    """A round's decisions do not cover the images that entered it."""


def valid_grades(log: DataFrame, slots: int = 16, low: int = 1, high: int = 5) -> DataFrame:
    """Grid judgments with a slot and a score in range; the rest name no image."""
    return log.filter(F.col("slot").between(1, slots) & F.col("score").between(low, high))


def last_judgments(log: DataFrame, keys: list[str] = ("run", "round", "id"), ordinal: str = "seq") -> DataFrame:
    """The last judgment per run, round and image: a retried group replaces the first try."""
    return first_in(log, list(keys), [F.col(ordinal).desc()])


def likert_sum(log: DataFrame, images: DataFrame, *, keys: list[str] = ("id",), score: str = "score") -> DataFrame:
    """Sum of grades per image over the full image set, 0 when never chosen."""
    sums = log.groupBy(*keys).agg(F.sum(score).alias("_s"))
    return images.join(sums, list(keys), "left").withColumn("imagescore", F.coalesce("_s", F.lit(0))).drop("_s")


def selection_count(log: DataFrame, images: DataFrame, *, keys: list[str] = ("id",)) -> DataFrame:
    """How often each image was selected."""
    counts = log.groupBy(*keys).agg(F.count("*").alias("_c"))
    return images.join(counts, list(keys), "left").withColumn("imagescore", F.coalesce("_c", F.lit(0))).drop("_c")


def rounds_survived(log: DataFrame, keys: list[str] = ("run", "id")) -> DataFrame:
    """Rounds an image was kept in, byes included."""
    return log.groupBy(*keys).agg(F.sum("kept").alias("imagescore"))


def mean_over_runs(
    scores: DataFrame, *, id_col: str = "filename", run: str = "run", score: str = "imagescore",
    coords: tuple[str, ...] = ("SourceRA", "SourceDec"), ordinal: str | None = None,
) -> DataFrame:
    """Mean score over the runs an image is in, their number, and the first run's coordinates."""
    aggs = [F.avg(score).alias("avg_score"), F.count("*").alias("n_runs")]
    if coords:
        order = F.struct(F.col(run), *([F.col(ordinal)] if ordinal else []))
        aggs.append(F.min_by(F.struct(*coords), order).alias("_at"))
    means = scores.groupBy(id_col).agg(*aggs)
    return means.select(id_col, "avg_score", "n_runs", *[F.col(f"_at.{c}").alias(c) for c in coords])


def run_audit(means: DataFrame, runs: int) -> DataFrame:
    """Images in all runs and in the union."""
    return means.agg(
        F.count("*").alias("images"), F.count(F.when(F.col("n_runs") == runs, 1)).alias("in_all_runs")
    )


def matched_by_source(matched: DataFrame) -> DataFrame:
    return matched.groupBy("matched_source").agg(F.count("*").alias("n"))


def reasoning_per_image(log: DataFrame, *, keys: list[str] = ("id",), which: str = "first", order: list[str] = ("round", "seq")) -> DataFrame:
    """First or last non-empty reasoning of each image in judgment order."""
    if which not in ("first", "last"):
        raise ValueError(f"unknown choice {which!r}")
    sort = [F.col(c).asc() if which == "first" else F.col(c).desc() for c in order]
    return first_in(log.filter(F.col("reasoning") != ""), list(keys), sort).select(*keys, "reasoning")


def tokens_by_round(log: DataFrame, group: str = "grp") -> DataFrame:
    """Tokens per run and round and their running totals.

    Each call's tokens stand on every row of its group, so a group counts once.
    """
    cols = ["input_tokens", "output_tokens"]
    calls = log.groupBy("run", "round", group).agg(*[F.max(c).alias(c) for c in cols])
    rounds = calls.groupBy("run", "round").agg(*[F.sum(c).alias(c) for c in cols])
    # Rounds of a run are few: at most the logarithm of its images.
    w = Window.partitionBy("run").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    totals = [F.sum(c).over(w).alias(f"cumulative_{c}") for c in cols]
    return rounds.select("run", "round", *cols, (F.col(cols[0]) + F.col(cols[1])).alias("total_tokens"), *totals)


def run_tokens(log: DataFrame, group: str = "grp") -> DataFrame:
    calls = log.groupBy("run", "round", group).agg(
        F.max("input_tokens").alias("i"), F.max("output_tokens").alias("o")
    )
    return calls.groupBy("run").agg(F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"))


def round_integrity(active: DataFrame, seen: DataFrame, keys: list[str] = ("run", "id")) -> DataFrame:
    """Images that entered a round and are missing from its decisions, and the other way round."""
    a, s = active.select(*keys).distinct(), seen.select(*keys).distinct()
    missing = a.join(s, list(keys), "left_anti").withColumn("problem", F.lit("missing"))
    extra = s.join(a, list(keys), "left_anti").withColumn("problem", F.lit("extra"))
    return missing.unionByName(extra)


def require_integrity(active: DataFrame, seen: DataFrame, keys: list[str] = ("run", "id")) -> None:
    bad = round_integrity(active, seen, keys).limit(10).collect()
    if bad:
        raise IntegrityError("decisions do not match the images of the round: " + ", ".join(map(str, bad)))
