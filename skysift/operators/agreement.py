"""Experts, volunteers and judges compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.functions.numbers import at_least, grid_bin, share
from skysift.operators.ordering import first_in


def latest_votes(votes: DataFrame, image: str = "image", expert: str = "expert", ordinal: str = "seq") -> DataFrame:
    """The last vote of each expert on each image."""
    return first_in(votes, [image, expert], [F.col(ordinal).desc()])


def first_urls(votes: DataFrame, image: str = "image", url: str = "url", ordinal: str = "seq") -> DataFrame:
    """The first non-empty link seen for each image."""
    return first_in(votes.filter(F.col(url) != ""), [image], [F.col(ordinal)]).select(image, url)


def expert_scores(votes: DataFrame, image: str = "image", expert: str = "expert", vote: str = "vote") -> DataFrame:
    """Share of yes votes per image, counts, and the experts who said yes in name order.

    Votes hold one row per image and expert, so a group is never larger than the
    number of experts.
    """
    yes = F.col(vote) == 1
    return votes.groupBy(image).agg(
        F.count("*").alias("expert_n"),
        F.count(F.when(yes, 1)).alias("expert_selected_n"),
        (F.count(F.when(yes, 1)) / F.count("*")).alias("expert_score"),
        F.array_sort(F.collect_list(F.when(yes, F.col(expert)))).alias("selected_by"),
    )


def agreement(
    ai: DataFrame,
    votes: DataFrame,
    *,
    image: str = "image",
    how: str = "full",
    threshold: float = 0.4,
    strict: bool = False,
    missing_text: dict[str, str] | None = None,
) -> DataFrame:
    """Judge results joined with expert scores.

    full: all images of either side. whitelist: the judge's images only, votes on
    others are dropped before they are counted. Images the judge lacks have score
    0 and the given texts; images without votes have expert score 0.
    """
    if how == "whitelist":
        votes = votes.join(ai.select(image), image, "left_semi")
    scores = expert_scores(votes, image)
    marked = ai.withColumn("_in_ai", F.lit(True))
    joined = marked.join(scores, image, "left" if how == "whitelist" else "full_outer")
    positive = at_least(F.col("expert_score"), threshold, strict)
    filled = (
        joined.withColumn("missing_from_ai", F.col("_in_ai").isNull())
        .withColumn("missing_from_experts", F.col("expert_n").isNull())
        .withColumn("score", F.coalesce(F.col("score").cast("double"), F.lit(0.0)))
        .withColumn("expert_score", F.coalesce("expert_score", F.lit(0.0)))
        .withColumn("expert_n", F.coalesce("expert_n", F.lit(0)))
        .withColumn("expert_selected_n", F.coalesce("expert_selected_n", F.lit(0)))
        .withColumn("selected_by", F.coalesce("selected_by", F.array().cast("array<string>")))
        .withColumn("expert_positive", F.when(positive, 1).otherwise(0))
    )
    for c, text in (missing_text or {}).items():
        filled = filled.withColumn(c, F.when(F.col("missing_from_ai"), text).otherwise(F.col(c)))
    return filled.drop("_in_ai")


def order_by_experts(rows: DataFrame, score: str = "score") -> DataFrame:
    return rows.orderBy(F.col("expert_score").desc(), F.col(score).desc(), F.col("expert_selected_n").desc(), "image")


def agreement_counters(rows: DataFrame, anomaly: str | None = None) -> DataFrame:
    """Report counters in one pass; expert means run over images with a vote."""
    rated = F.col("expert_n") > 0
    aggs = [
        F.count("*").alias("total_images"),
        F.count(F.when(rated, 1)).alias("rated_images"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_score"),
        F.coalesce(F.avg(F.when(rated, F.col("expert_score"))), F.lit(0.0)).alias("avg_expert_score"),
        F.coalesce(F.sum("expert_positive"), F.lit(0)).alias("expert_positive"),
        F.count(F.when(F.col("missing_from_ai"), 1)).alias("missing_from_ai"),
        F.count(F.when(F.col("missing_from_experts"), 1)).alias("missing_from_experts"),
    ]
    if anomaly:
        aggs.append(F.coalesce(F.avg(anomaly), F.lit(0.0)).alias("avg_anomaly"))
    return rows.agg(*aggs)


def votes_histogram(rows: DataFrame, experts: int | DataFrame, selected: str = "ai_selected") -> DataFrame:
    """Images by number of yes votes 0 … experts, split by the judge's choice; empty k kept.

    `experts` is their number, or votes from which it is counted.
    """
    yes = F.col(selected) == 1
    counts = rows.filter(F.col("expert_n") > 0).groupBy(F.col("expert_selected_n").alias("k")).agg(
        F.count(F.when(yes, 1)).alias("ai_yes"), F.count(F.when(F.col(selected) == 0, 1)).alias("ai_no")
    )
    if isinstance(experts, int):
        size = rows.sparkSession.range(1).select(F.lit(experts).cast("bigint").alias("_m"))
    else:
        size = experts.agg(F.count_distinct("expert").alias("_m"))
    spine = size.select("_m", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_m"))).alias("k"))
    zero = F.lit(0)
    return spine.join(counts, "k", "left").select(
        "k", share(F.col("k"), F.col("_m")).alias("share"),
        F.coalesce("ai_yes", zero).alias("ai_yes"), F.coalesce("ai_no", zero).alias("ai_no"),
    )


def density(df: DataFrame, x: str, y: str, x_width: float, y_width: float) -> DataFrame:
    """Number of points in each point's bin, and the opacity it is drawn with.

    Bins are counted first and joined back, so a crowded bin stays spread out.
    """
    binned = df.withColumn("x_bin", grid_bin(x, x_width)).withColumn("y_bin", grid_bin(y, y_width))
    counts = binned.groupBy("x_bin", "y_bin").agg(F.count("*").alias("density"))
    weight = F.least(F.lit(0.92), F.lit(0.16) + F.lit(0.10) * (F.col("density") - 1))
    return binned.join(counts, ["x_bin", "y_bin"]).withColumn("weight", weight)


def volunteer_consensus(votes: DataFrame, subject: str = "image", user: str = "user", selected: str = "selected") -> DataFrame:
    """Classifications, selections, distinct users and percent selected per subject.

    Users are deduplicated before they are counted, so a subject that draws a
    large share of all votes is not counted in one task.
    """
    per_user = votes.groupBy(subject, user).agg(
        F.count("*").alias("_n"), F.sum(F.col(selected).cast("bigint")).alias("_s")
    )
    totals = per_user.groupBy(subject).agg(
        F.sum("_n").alias("count"), F.sum("_s").alias("selected_count"), F.count("*").alias("unique_user_count")
    )
    percent = F.round(F.col("selected_count") * 100 / F.col("unique_user_count"), 2)
    return totals.withColumn("percent_selected", percent)


def anomaly_score(image_score: Column | str, feature_score: Column | str) -> Column:
    """Anomaly as the weighted mean of image and feature scores."""
    a = F.col(image_score) if isinstance(image_score, str) else image_score
    b = F.col(feature_score) if isinstance(feature_score, str) else feature_score
    return a * 0.8 + b * 0.2
