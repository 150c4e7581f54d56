"""Cost per run, replicate statistics, leaderboards and provider summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# USD per million tokens (input, output).
PRICES = {"gemini": (0.25, 1.50), "qwen": (0.45, 3.00)}

# Run-name parts that give a provider and a test format, first match wins.
PROVIDER_PARTS = [("gemini", ["gemini"]), ("qwen", ["qwen"])]
FORMAT_PARTS = [
    ("single-elim", ["single_elim", "single-elim", "singleelim"]),
    ("tournament", ["tournament"]),
    ("likert", ["likert"]),
    ("hybrid", ["hybrid"]),
]
EXPERT_FORMAT_PARTS = [
    ("single-elim", ["single_elim", "single-elim", "singleelim", "single_elimination", "sineli"]),
    ("tournament", ["tournament", "tourna"]),
    ("grid-likert", ["grid", "likert"]),
]
SHOT_PARTS = [
    ("few-shot", ["few_shot", "few-shot", "fewshot"]),
    ("no-shot", ["no_shot", "no-shot", "noshot"]),
]


def _named(text: Column, parts: list[tuple[str, list[str]]], otherwise: str | None = None) -> Column:
    found = F.lit(None).cast("string") if otherwise is None else F.lit(otherwise)
    for name, words in reversed(parts):
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        found = F.when(hit, name).otherwise(found)
    return found


def describe_runs(df: DataFrame, name: str = "stem", parent: str | None = "parent") -> DataFrame:
    """provider and format of runs by their name, then their folder; null format when unknown."""
    text = F.lower(F.concat_ws(" ", name, *([parent] if parent else [])))
    return df.withColumn("provider", _named(text, PROVIDER_PARTS, "other")).withColumn(
        "format", _named(text, FORMAT_PARTS)
    )


def describe_expert_runs(df: DataFrame, name: str = "stem") -> DataFrame:
    """provider, format and shot of runs by name; runs with an unknown format or shot are left out."""
    text = F.lower(F.col(name))
    named = (
        df.withColumn("provider", _named(text, PROVIDER_PARTS, "other"))
        .withColumn("format", _named(text, EXPERT_FORMAT_PARTS))
        .withColumn("shot", _named(text, SHOT_PARTS))
    )
    return named.filter(F.col("format").isNotNull() & F.col("shot").isNotNull())


def with_cost(runs: DataFrame, prices: dict[str, tuple[float, float]] | None = None, images: str = "n_images") -> DataFrame:
    """Add cost and cost per 1000 images from tokens; an unknown provider costs nothing."""
    table = runs.sparkSession.createDataFrame(
        [(p, i, o) for p, (i, o) in (prices or PRICES).items()], "provider string, _in double, _out double"
    )
    # The price table is a handful of literal rows.
    joined = runs.join(F.broadcast(table), "provider", "left")
    cost = F.coalesce(
        F.col("input_tokens") / 1_000_000 * F.col("_in") + F.col("output_tokens") / 1_000_000 * F.col("_out"),
        F.lit(0.0),
    )
    per_1k = F.when(F.col(images) > 0, F.col("cost") / F.col(images) * 1000).otherwise(0.0)
    return joined.withColumn("cost", cost).withColumn("cost_per_1k", per_1k).drop("_in", "_out")


def replicate_stats(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean and sample deviation per metric; one replicate has deviation 0."""
    aggs = []
    for m in metrics:
        aggs += [
            F.coalesce(F.avg(m), F.lit(0.0)).alias(f"{m}_mean"),
            F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std"),
        ]
    return df.groupBy(*keys).agg(F.count("*").alias("n_reps"), *aggs)


def leaderboard(stats: DataFrame, by: str = "f1_mean", ties: list[str] = ()) -> DataFrame:
    return stats.orderBy(F.col(by).desc(), *ties)


def mean_pr_curve(points: DataFrame, groups: list[str], run: str, step: int = 50) -> DataFrame:
    """Interpolated precision on the recall grid 0, 1/step, … 1, averaged over replicates.

    Interpolated precision at r is the best precision at a recall of at least r;
    0 where a replicate does not reach r.
    """
    # Every point first goes to the highest grid place it reaches, so the grid is
    # met by at most step + 1 rows per run.
    def place(r: Column) -> Column:
        guess = F.floor(r * step)
        up = (guess + 1) / step <= r
        down = guess / step > r
        return F.when(up, guess + 1).when(down, guess - 1).otherwise(guess).cast("int")

    peaks = points.groupBy(*groups, run, place(F.col("recall")).alias("_at")).agg(F.max("precision").alias("_p"))
    spread = peaks.withColumn("_g", F.explode(F.sequence(F.lit(0), F.col("_at"))))
    best = spread.groupBy(*groups, run, "_g").agg(F.max("_p").alias("_p"))
    sums = best.groupBy(*groups, "_g").agg(F.sum("_p").alias("_sum"))
    reps = points.select(*groups, run).distinct().groupBy(*groups).agg(F.count("*").alias("_n"))
    grid = reps.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(step))))
    joined = grid.join(sums, [*groups, "_g"], "left")
    mean = F.coalesce("_sum", F.lit(0.0)) / F.col("_n")
    return joined.select(*groups, (F.col("_g") / step).alias("recall"), mean.alias("precision"))


def histogram_over_replicates(hist: DataFrame, groups: list[str], run: str) -> DataFrame:
    """Mean and deviation of counts per bin over replicates; a bin a replicate lacks counts 0.

    Missing bins are added in the formulas from the number of replicates, not as rows.
    """
    full = hist.withColumn("total", F.col("interesting") + F.col("boring"))
    # Replicates are counted from the same columns as the sums below, so both read one shuffle.
    reps = full.groupBy(*groups, run).agg(F.sum("total").alias("_t")).filter(F.col("_t") > 0)
    reps = reps.groupBy(*groups).agg(F.count("*").alias("_r"))
    names = ["interesting", "boring", "total"]
    whole = {c: F.col(c).cast("decimal(19,0)") for c in names}
    sums = full.groupBy(*groups, "bin").agg(
        *[F.sum(whole[c]).alias(f"_s_{c}") for c in names], *[F.sum(whole[c] * whole[c]).alias(f"_q_{c}") for c in names]
    )
    joined = sums.join(reps, groups)
    outs = []
    for c in names:
        s, q, r = F.col(f"_s_{c}"), F.col(f"_q_{c}"), F.col("_r")
        # Whole numbers throughout, so the deviation loses nothing to cancellation.
        apart = (r.cast("decimal(10,0)") * q - s * s).cast("double")
        outs += [
            (s.cast("double") / r).alias(f"{c}_mean"),
            F.when(r > 1, F.sqrt(apart / (r * (r - 1)))).otherwise(0.0).alias(f"{c}_std"),
        ]
    return joined.select(*groups, "bin", *outs)


def provider_summary(runs: DataFrame) -> DataFrame:
    """Per provider: best F1 and recall with their formats, means, total and cheapest cost.

    Runs need provider, format, run, f1, recall_at_n, pr_auc, cost, cost_per_1k.
    The first run settles ties.
    """

    def leader(order: Column) -> Column:
        return F.min(F.struct(order.alias("by"), F.col("run"), F.col("format")))

    sums = runs.groupBy("provider").agg(
        F.count("*").alias("runs"),
        F.avg("f1").alias("avg_f1"),
        F.avg("pr_auc").alias("avg_auc"),
        F.avg("recall_at_n").alias("avg_recall_at_n"),
        F.sum("cost").alias("total_cost"),
        leader(-F.col("f1")).alias("_f"),
        leader(-F.col("recall_at_n")).alias("_r"),
        leader(F.col("cost_per_1k")).alias("_c"),
    )
    return sums.select(
        "provider", "runs", "avg_f1", "avg_auc", "avg_recall_at_n", "total_cost",
        (-F.col("_f.by")).alias("best_f1"), F.col("_f.format").alias("best_config"),
        (-F.col("_r.by")).alias("best_recall_at_n"), F.col("_r.format").alias("best_recall_config"),
        F.col("_c.by").alias("cheapest_cost_per_1k"), F.col("_c.format").alias("cheapest_config"),
    )


def group_index(groups: DataFrame, within: str = "provider", by: list[str] = ("format",)) -> DataFrame:
    """Stable 0-based number of each group within its provider, for colours."""
    names = groups.select(within, *by).distinct()
    place = F.dense_rank().over(Window.partitionBy(within).orderBy(*by)) - 1
    return groups.join(names.withColumn("group_index", place), [within, *by])
