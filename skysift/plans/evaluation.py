"""Evaluation of many judge runs in one job, from one set of score bands."""

from __future__ import annotations

from pyspark.sql import DataFrame

from skysift.operators import bands, replicates

KEYS = ["run", "provider", "format"]


def evaluate_runs(
    scores: DataFrame, tokens: DataFrame, *, n: int = 100, dialect: str = "step",
    prices: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """One row per run: best threshold, precision-recall area, recall among the top n, tokens and cost.

    Scores hold run, provider, format, image, score, truth. Runs without a
    token record have tokens and cost 0.
    """
    runs = bands.run_summary(bands.score_bands(scores, KEYS), KEYS, n, dialect).join(tokens, "run", "left")
    return replicates.with_cost(runs.fillna(0, ["input_tokens", "output_tokens"]), prices)


METRICS = ["f1", "precision", "recall", "pr_auc", "recall_at_n", "cost", "cost_per_1k", "input_tokens", "output_tokens",
           "threshold"]


def dashboard(scores: DataFrame, tokens: DataFrame, *, n: int = 100) -> dict[str, DataFrame]:
    """Runs, leaderboard of replicate groups, provider summary, mean curves and histograms."""
    runs = evaluate_runs(scores, tokens, n=n)
    groups = ["provider", "format"]
    banded = bands.score_bands(scores, KEYS)
    hist = bands.histogram(scores, KEYS)
    return {
        "runs": runs,
        "leaderboard": replicates.leaderboard(replicates.replicate_stats(runs, groups, METRICS), "f1_mean", groups),
        "providers": replicates.provider_summary(runs),
        "curves": replicates.mean_pr_curve(bands.pr_points(banded, KEYS), groups, "run"),
        "histograms": replicates.histogram_over_replicates(hist, groups, "run"),
    }
