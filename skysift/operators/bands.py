"""Evaluation of scored images against truth, from score bands.

A band is all images of one run with one score. Bands are made in one map-side
combined aggregation; every metric here derives from running totals over bands,
row by row or by another combined aggregation, never from a pass per threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.functions.numbers import f1_of, histogram_bin, share
from skysift.operators.ordering import first_in, running, score_buckets, stacked

# Images written by one task at a time when a band is expanded to ranks.
EXPAND_CHUNK = 65536


def score_bands(df: DataFrame, keys: list[str], score: str = "score", truth: str = "truth") -> DataFrame:
    """Bands with n, tp, their running totals n_ge, tp_ge from the top, and key totals n_all, p_all."""
    bands = (
        df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
        .groupBy(*keys, F.col(score).cast("double").alias("score"))
        .agg(F.count("*").alias("n"), F.count(F.when(F.col(truth).cast("int") == 1, 1)).alias("tp"))
    )
    return running(
        bands, keys, score_buckets("score"), [F.col("score").desc()],
        {"n_ge": "n", "tp_ge": "tp"}, {"n_all": "n", "p_all": "tp"},
    )


def _point(threshold: Column, kind: str, n: Column, tp: Column) -> Column:
    """Confusion counts of the prediction score >= threshold from images and positives chosen."""
    return F.struct(
        threshold.cast("double").alias("threshold"),
        F.lit(kind).alias("kind"),
        tp.alias("tp"),
        (n - tp).alias("fp"),
        (F.col("p_all") - tp).alias("fn"),
        (F.col("n_all") - F.col("p_all") - (n - tp)).alias("tn"),
    )


def _rated(points: DataFrame, keys: list[str]) -> DataFrame:
    precision, recall = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    rated = points.withColumn("precision", precision).withColumn("recall", recall)
    return rated.withColumn("f1", f1_of(F.col("precision"), F.col("recall"))).select(
        *keys, "threshold", "kind", "tp", "fp", "fn", "tn", "precision", "recall", "f1"
    )


def threshold_metrics(
    bands: DataFrame, keys: list[str], *, floor: bool = False, top: bool = False, cuts: tuple[float, ...] = ()
) -> DataFrame:
    """Confusion counts, precision, recall and F1 at every score.

    `floor` adds the threshold one below the lowest score (everything chosen),
    `top` one above the highest (nothing chosen), `cuts` fixed thresholds.
    """
    none = F.lit(0).cast("bigint")
    points = [_point(F.col("score"), "score", F.col("n_ge"), F.col("tp_ge"))]
    # The lowest and the highest band also stand for the points beyond them.
    if floor:
        lowest = F.col("n_ge") == F.col("n_all")
        points.append(F.when(lowest, _point(F.col("score") - 1, "floor", F.col("n_all"), F.col("p_all"))))
    if top:
        highest = F.col("n_ge") == F.col("n")
        points.append(F.when(highest, _point(F.col("score") + 1, "top", none, none)))
    frames = [bands.select(*keys, F.explode(F.array_compact(F.array(*points))).alias("_p")).select(*keys, "_p.*")]
    if cuts:
        whole = bands.groupBy(*keys).agg(
            F.max("n_all").alias("n_all"), F.max("p_all").alias("p_all"),
            *[F.coalesce(F.sum(F.when(F.col("score") >= c, F.col(v))), F.lit(0)).alias(f"_{v}{i}")
              for i, c in enumerate(cuts) for v in ("n", "tp")],
            *[F.count(F.when(F.col("score") == c, 1)).alias(f"_has{i}") for i, c in enumerate(cuts)],
        )
        extra = [F.when(F.col(f"_has{i}") == 0, _point(F.lit(c), "cut", F.col(f"_n{i}"), F.col(f"_tp{i}")))
                 for i, c in enumerate(cuts)]
        frames.append(whole.select(*keys, F.explode(F.array_compact(F.array(*extra))).alias("_p")).select(*keys, "_p.*"))
    return _rated(stacked(frames), keys)


# Which sweep each rule runs over and how it orders the points; the first one wins.
BEST_RULES = {
    # Highest F1, then the lowest threshold, down to one below the lowest score.
    "t1": ({"floor": True}, ["f1", "-threshold"]),
    # Highest F1, recall, precision, then the highest threshold.
    "t2": ({}, ["f1", "recall", "precision", "threshold"]),
    # Highest F1, precision, recall, then the lowest threshold, up to one above the highest score.
    "t3": ({"top": True}, ["f1", "precision", "recall", "-threshold"]),
    # As t3 with the highest threshold last, over the scores and 0 and 1.
    "t4": ({"cuts": (0.0, 1.0)}, ["f1", "precision", "recall", "threshold"]),
    # Highest F1, then the lowest score; nothing for a key without positives.
    "t5": ({}, ["f1", "-threshold"]),
}


def best_threshold(bands: DataFrame, keys: list[str], rule: str = "t1") -> DataFrame:
    """The best point of each key under one of BEST_RULES."""
    sweep, by = BEST_RULES[rule]
    if rule == "t5":
        bands = bands.filter(F.col("p_all") > 0)
    points = threshold_metrics(bands, keys, **sweep)
    order = [F.col(c[1:]).asc() if c.startswith("-") else F.col(c).desc() for c in by]
    return first_in(points, keys, order).drop("kind")


def _area(dialect: str) -> Column:
    """What a band adds to the area under the precision-recall curve."""
    gained = share(F.col("tp"), F.col("p_all"))
    here = share(F.col("tp_ge"), F.col("n_ge"))
    before = share(F.col("tp_ge") - F.col("tp"), F.col("n_ge") - F.col("n"))
    first = F.col("n_ge") == F.col("n")
    if dialect == "step":
        return F.when(first, 0.0).otherwise(gained * here)
    if dialect == "trapezoid":
        return gained * (before + here) / 2
    if dialect == "library":
        return gained * (F.when(first, 1.0).otherwise(before) + here) / 2
    raise ValueError(f"unknown dialect {dialect!r}")


def pr_auc(
    bands: DataFrame, keys: list[str], dialect: str = "step", reach: float | None = None
) -> DataFrame:
    """Area under the precision-recall curve.

    step: precision of the current point times the recall gained, nothing before
    the first point. trapezoid: from the empty point (0, 0) through all
    thresholds. sorted: the same with points sorted by (recall, precision); with
    `reach`, the empty point exists only for keys whose scores stay below it.
    library: trapezoid that starts at (recall 0, precision 1), no row for a key
    without positives.
    """
    if dialect == "sorted":
        return _sorted_auc(bands, keys, reach)
    if dialect == "library":
        bands = bands.filter(F.col("p_all") > 0)
    return bands.groupBy(*keys).agg(F.sum(_area(dialect)).alias("pr_auc"))


def _sorted_auc(bands: DataFrame, keys: list[str], reach: float | None) -> DataFrame:
    """Points of one recall level run from its lowest to its highest precision.

    A level starts at the band that adds positives, where precision is highest,
    and the step into it joins the level before at that level's own start.
    """
    precision = share(F.col("tp_ge"), F.col("n_ge"))
    levels = bands.groupBy(*keys, "tp_ge").agg(
        F.min(precision).alias("low"), F.max(precision).alias("high"),
        F.max("tp").alias("gain"), F.max("p_all").alias("p_all"), F.max("score").alias("_top"),
    )
    steps = levels.withColumn("_from", F.col("tp_ge") - F.col("gain"))
    start = levels.select(*keys, F.col("tp_ge").alias("_from"), F.col("high").alias("_high"))
    joined = steps.join(start, [*keys, "_from"], "left")
    # Without a band of its own, level 0 is the empty point.
    empty = F.lit(0.0) if reach is None else F.when(F.col("_top") < reach, 0.0)
    area = share(F.col("gain"), F.col("p_all")) * (F.coalesce("_high", empty) + F.col("low")) / 2
    # Level 0 itself gains nothing; it keeps keys without positives in the result.
    gained = F.when(F.col("gain") > 0, F.coalesce(area, F.lit(0.0))).otherwise(0.0)
    return joined.groupBy(*keys).agg(F.sum(gained).alias("pr_auc"))


def _recall_place(n: int) -> tuple[Column, Column]:
    """(whether rank n falls into the band, expected recall there)."""
    place = F.least(F.greatest(F.lit(n), F.lit(1)), F.col("n_all"))
    above = F.col("n_ge") - F.col("n")
    hits = F.col("tp_ge") - F.col("tp") + F.col("tp") * (place - above) / F.col("n")
    return (above < place) & (place <= F.col("n_ge")), share(hits, F.col("p_all"))


def recall_at(bands: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Exact expected recall among the top n under a random order of ties.

    n is held within 1 and the number of images; no positives give 0.
    """
    inside, recall = _recall_place(n)
    return bands.filter(inside).select(*keys, recall.alias("recall_at_n"))


def run_summary(bands: DataFrame, keys: list[str], n: int, dialect: str = "step") -> DataFrame:
    """Best threshold under rule t1, area, recall among the top n and sizes, in one aggregation."""
    precision, recall = share(F.col("tp_ge"), F.col("n_ge")), share(F.col("tp_ge"), F.col("p_all"))
    # Choosing everything has the lowest band's metrics at a lower threshold, so it stands in for that band.
    threshold = F.col("score") - F.when(F.col("n_ge") == F.col("n_all"), 1.0).otherwise(0.0)
    point = F.struct(f1_of(precision, recall).alias("f1"), (-threshold).alias("t"), precision.alias("precision"),
                     recall.alias("recall"))
    inside, recall_there = _recall_place(n)
    sums = bands.groupBy(*keys).agg(
        F.max(point).alias("_b"), F.sum(_area(dialect)).alias("pr_auc"),
        F.max(F.when(inside, recall_there)).alias("recall_at_n"),
        F.max("n_all").alias("n_images"), F.max("p_all").alias("positives"),
    )
    return sums.select(
        *keys, "n_images", "positives", (-F.col("_b.t")).alias("threshold"), F.col("_b.f1").alias("f1"),
        F.col("_b.precision").alias("precision"), F.col("_b.recall").alias("recall"), "pr_auc", "recall_at_n",
    )


def recall_curve(bands: DataFrame, keys: list[str]) -> DataFrame:
    """Expected recall at every rank. A band is cut into chunks before it is expanded."""
    chunks = bands.filter(F.col("p_all") > 0).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / EXPAND_CHUNK)))
    )
    # Chunks of one large band leave the task they were made in.
    spread = chunks.repartition(*keys, "score", "_chunk")
    first = F.col("_chunk") * EXPAND_CHUNK + 1
    ranks = spread.withColumn("_k", F.explode(F.sequence(first, F.least(F.col("n"), first + EXPAND_CHUNK - 1))))
    hits = F.col("tp_ge") - F.col("tp") + F.col("tp") * (F.col("_k") / F.col("n"))
    return ranks.select(
        *keys, (F.col("n_ge") - F.col("n") + F.col("_k")).alias("rank"), (hits / F.col("p_all")).alias("recall")
    )


def pr_points(bands: DataFrame, keys: list[str]) -> DataFrame:
    """The step curve: the highest-threshold point of each recall level, from the first band on."""
    first = F.col("n_ge") == F.col("n")
    kept = bands.filter(first | (F.col("tp") > 0))
    return kept.select(*keys, F.col("score").alias("threshold"),
                       share(F.col("tp_ge"), F.col("p_all")).alias("recall"),
                       share(F.col("tp_ge"), F.col("n_ge")).alias("precision"))


def histogram(
    df: DataFrame, keys: list[str], score: str = "score", truth: str = "truth", bin: str = "exact"
) -> DataFrame:
    """Images per score bin, split by truth."""
    yes = F.col(truth).cast("int") == 1
    return df.groupBy(*keys, histogram_bin(score, bin).alias("bin")).agg(
        F.count(F.when(yes, 1)).alias("interesting"), F.count(F.when(~F.coalesce(yes, F.lit(False)), 1)).alias("boring")
    )


def class_means(df: DataFrame, score: str = "score", label: str = "classification") -> DataFrame:
    """Mean score per class, ascending, with the grand mean last."""
    named = df.withColumn("_c", F.coalesce(F.col(label), F.lit("")))
    means = named.rollup("_c").agg(F.avg(score).alias("mean_score"), F.grouping("_c").alias("is_total"))
    name = F.when(F.col("is_total") == 1, "Total Average").when(F.col("_c") == "", "No classification").otherwise(
        F.col("_c")
    )
    ordered = means.select(name.alias("label"), "mean_score", F.col("is_total").cast("int").alias("is_total"))
    return ordered.orderBy("is_total", "mean_score", "label")


def detail_histogram(df: DataFrame, score: str = "score", label: str = "classification", outcome: str = "outcome") -> DataFrame:
    """Counts per (class, bin), per (outcome, bin) and per bin, in one pass."""
    named = df.select(
        F.coalesce(F.col(label), F.lit("")).alias("_c"), F.col(outcome).alias("_o"),
        histogram_bin(score, "trunc").alias("bin"),
    )
    sets = named.groupingSets([["_c", "bin"], ["_o", "bin"], ["bin"]], "_c", "_o", "bin").agg(
        F.count("*").alias("n"), F.grouping("_c").alias("_gc"), F.grouping("_o").alias("_go")
    )
    kind = F.when(F.col("_gc") == 0, "class").when(F.col("_go") == 0, "outcome").otherwise("all")
    subset = F.when(F.col("_gc") == 0, F.col("_c")).when(F.col("_go") == 0, F.col("_o")).otherwise("__all__")
    return sets.select(kind.alias("kind"), subset.alias("subset"), "bin", "n")


def top_images(df: DataFrame, keys: list[str], n: int = 20, score: str = "score", id_col: str = "image") -> DataFrame:
    """The n best-scored images per key with their rank; the id settles ties."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(id_col))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
