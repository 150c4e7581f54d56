"""Queries on judge scores, runs, experts and volunteers."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysift.functions import numbers, text
from skysift.operators import agreement, bands, matching, regression, replicates, tallies, views as report
from skysift.operators.ordering import exact_quantiles
from skysift.plans.evaluation import evaluate_runs
from workload import views
from workload.registry import r6, register
from workload.views import with_views

RUN = ["run"]

# Bands with running totals, shared by the oracles below.
BANDS = """bands AS (SELECT run, score, count(*) AS n, sum(truth) AS tp,
    sum(count(*)) OVER w AS n_ge, sum(sum(truth)) OVER w AS tp_ge,
    sum(count(*)) OVER (PARTITION BY run) AS n_all, sum(sum(truth)) OVER (PARTITION BY run) AS p_all
    FROM v_scores GROUP BY run, score WINDOW w AS (PARTITION BY run ORDER BY score DESC))"""
POINTS = BANDS + """, raw AS (SELECT run, score AS threshold, 'score' AS kind, tp_ge AS tp, n_ge - tp_ge AS fp, p_all - tp_ge AS fn,
    n_all - p_all - (n_ge - tp_ge) AS tn FROM bands
    UNION ALL SELECT run, min(score) - 1, 'floor', max(p_all), max(n_all) - max(p_all), 0, 0 FROM bands GROUP BY run
    UNION ALL SELECT run, max(score) + 1, 'top', 0, 0, max(p_all), max(n_all) - max(p_all) FROM bands GROUP BY run),
  pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM raw),
  points AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pr)"""
POINT_COLUMNS = """threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn,
    round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"""


def _bands(spark, sf):
    return bands.score_bands(views.scores(spark, sf), RUN)


@register("threshold_sweep", with_views(f"SELECT run, kind, {POINT_COLUMNS} FROM points", "v_scores", more=POINTS))
def threshold_sweep(spark, sf):
    return r6(bands.threshold_metrics(_bands(spark, sf), RUN, floor=True, top=True))


def _best(rule: str, kinds: str, order: str, extra: str = "") -> None:
    sql = with_views(
        f"""SELECT run, {POINT_COLUMNS} FROM points WHERE kind IN ({kinds}) {extra}
        QUALIFY row_number() OVER (PARTITION BY run ORDER BY {order}) = 1""", "v_scores", more=POINTS)

    @register(f"best_threshold_{rule}", sql)
    def best(spark, sf):
        return r6(bands.best_threshold(_bands(spark, sf), RUN, rule))


_best("t1", "'score', 'floor'", "f1 DESC, threshold")
_best("t2", "'score'", "f1 DESC, recall DESC, precision DESC, threshold DESC")
_best("t3", "'score', 'top'", "f1 DESC, precision DESC, recall DESC, threshold")
_best("t5", "'score'", "f1 DESC, threshold", "AND tp + fn > 0")

ROLES = """x AS (SELECT image, sum(vote) / count(*) AS expert_score FROM v_votes GROUP BY image),
  r AS (SELECT x.expert_score AS s, ai_selected AS t FROM v_ai a JOIN x ON a.image = x.image),
  cuts AS (SELECT DISTINCT s AS cutoff FROM r UNION SELECT 0.0 UNION SELECT 1.0),
  c AS (SELECT cutoff, count(*) FILTER (s >= cutoff AND t = 1) AS tp, count(*) FILTER (s >= cutoff AND t = 0) AS fp,
    count(*) FILTER (s < cutoff AND t = 1) AS fn, count(*) FILTER (s < cutoff AND t = 0) AS tn FROM cuts, r GROUP BY cutoff),
  pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM c),
  points AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pr)"""


def _swapped(spark, sf):
    """Bands of expert scores with the judge's choice as truth."""
    votes = agreement.latest_votes(views.votes(spark, sf))
    rows = agreement.agreement(views.ai_results(spark, sf), votes, how="whitelist", threshold=0.4, strict=True)
    rated = rows.filter(F.col("expert_n") > 0).withColumn("set", F.lit("all"))
    return bands.score_bands(rated, ["set"], "expert_score", "ai_selected")


@register("best_threshold_t4", with_views(
    """SELECT 'all' AS set, round(cutoff, 6) AS threshold, tp, fp, fn, tn, round(precision, 6) AS precision,
    round(recall, 6) AS recall, round(f1, 6) AS f1 FROM points
    ORDER BY points.f1 DESC, points.precision DESC, points.recall DESC, cutoff DESC LIMIT 1""", "v_votes", "v_ai", more=ROLES))
def best_threshold_t4(spark, sf):
    return r6(bands.best_threshold(_swapped(spark, sf), ["set"], "t4"))


@register("pr_auc_swapped", with_views(
    """SELECT 'all' AS set, round(sum((recall - r0) * (precision + p0) / 2), 6) AS pr_auc FROM (SELECT recall, precision,
    lag(recall) OVER w AS r0, lag(precision) OVER w AS p0 FROM points WINDOW w AS (ORDER BY recall, precision))""",
    "v_votes", "v_ai", more=ROLES))
def pr_auc_swapped(spark, sf):
    return r6(bands.pr_auc(_swapped(spark, sf), ["set"], "sorted", reach=1.0))


def _auc(dialect: str, sql: str) -> None:
    @register(f"pr_auc_{dialect}", with_views(sql, "v_scores", more=POINTS))
    def auc(spark, sf):
        return r6(bands.pr_auc(_bands(spark, sf), RUN, dialect))


_LAGGED = """SELECT run, round(coalesce(sum((recall - r0) * {height}), 0), 6) AS pr_auc FROM (SELECT run, recall, precision,
    lag(recall) OVER w AS r0, lag(precision) OVER w AS p0 FROM points WHERE kind IN ({kinds})
    WINDOW w AS (PARTITION BY run ORDER BY {order})) GROUP BY run"""
_auc("step", _LAGGED.format(height="precision", kinds="'score', 'floor'", order="threshold DESC"))
_auc("trapezoid", _LAGGED.format(height="(precision + p0) / 2", kinds="'score', 'top'", order="threshold DESC"))
_auc("sorted", _LAGGED.format(height="(precision + p0) / 2", kinds="'score', 'top'", order="recall, precision"))
_auc("library", """SELECT run, round(sum((recall - coalesce(r0, 0)) * (precision + coalesce(p0, 1)) / 2), 6) AS pr_auc FROM (
    SELECT run, recall, precision, lag(recall) OVER w AS r0, lag(precision) OVER w AS p0 FROM points
    WHERE kind = 'score' AND tp + fn > 0 WINDOW w AS (PARTITION BY run ORDER BY threshold DESC)) GROUP BY run""")


@register("recall_curve", with_views(
    """SELECT run, (n_ge - n + k)::BIGINT AS rank, round((tp_ge - tp + tp * k / n) / p_all, 6) AS recall FROM (
    SELECT *, unnest(generate_series(1, n)) AS k FROM bands WHERE p_all > 0)""", "v_scores", more=BANDS))
def recall_curve(spark, sf):
    return r6(bands.recall_curve(_bands(spark, sf), RUN))


RECALL_AT = """SELECT run, CASE WHEN p_all > 0 THEN (tp_ge - tp + tp * (least({n}, n_all) - (n_ge - n)) / n) / p_all ELSE 0.0 END AS recall_at_n
    FROM bands WHERE n_ge - n < least({n}, n_all) AND least({n}, n_all) <= n_ge"""


@register("recall_at_n", with_views(
    f"SELECT run, round(recall_at_n, 6) AS recall_at_n FROM ({RECALL_AT.format(n=5)})", "v_scores", more=BANDS))
def recall_at_n(spark, sf):
    return r6(bands.recall_at(_bands(spark, sf), RUN, 5))


# One row per run: metrics, tokens and cost.
RUNS = POINTS + """, best AS (SELECT * FROM points WHERE kind != 'top' QUALIFY row_number() OVER (PARTITION BY run ORDER BY f1 DESC, threshold) = 1),
  auc AS (""" + _LAGGED.format(height="precision", kinds="'score', 'floor'", order="threshold DESC").replace("round(", "(").replace(", 6)", ")") + """),
  rec AS (""" + RECALL_AT.format(n=5) + """),
  names AS (SELECT run, any_value(provider) AS provider, any_value(format) AS format, count(*) AS n_images FROM v_scores GROUP BY run),
  costs AS (SELECT n.*, input_tokens, output_tokens, input_tokens / 1000000 * (CASE provider WHEN 'gemini' THEN 0.25 ELSE 0.45 END)
    + output_tokens / 1000000 * (CASE provider WHEN 'gemini' THEN 1.5 ELSE 3.0 END) AS cost FROM names n JOIN v_tokens t ON n.run = t.run),
  runs AS (SELECT c.*, cost / n_images * 1000 AS cost_per_1k, b.f1, b.precision, b.recall, b.threshold, auc.pr_auc, recall_at_n
    FROM costs c JOIN best b ON c.run = b.run JOIN auc ON c.run = auc.run JOIN rec ON c.run = rec.run)"""


def run_table(spark, sf, n: int = 5):
    """All runs evaluated in one job from one set of bands."""
    return evaluate_runs(views.scores(spark, sf), views.run_tokens(spark, sf), n=n)


@register("cost_per_run", with_views(
    "SELECT run, provider, format, n_images, round(cost, 9) AS cost, round(cost_per_1k, 9) AS cost_per_1k FROM runs",
    "v_scores", "v_tokens", more=RUNS))
def cost_per_run(spark, sf):
    scores = views.scores(spark, sf)
    runs = scores.groupBy("run", "provider", "format").agg(F.count("*").alias("n_images"))
    costed = replicates.with_cost(runs.join(views.run_tokens(spark, sf), "run"))
    return r6(costed.select("run", "provider", "format", "n_images", "cost", "cost_per_1k"), digits=9)


METRICS = ["f1", "precision", "recall", "pr_auc", "cost", "cost_per_1k", "threshold", "recall_at_n"]


@register("replicate_leaderboard", with_views(
    "SELECT provider, format, count(*) AS n_reps, " + ", ".join(
        f"round(avg({m}), 9) AS {m}_mean, round(coalesce(stddev_samp({m}), 0), 9) AS {m}_std" for m in METRICS)
    + " FROM runs GROUP BY provider, format", "v_scores", "v_tokens", more=RUNS))
def replicate_leaderboard(spark, sf):
    stats = replicates.replicate_stats(run_table(spark, sf), ["provider", "format"], METRICS)
    return replicates.leaderboard(r6(stats, digits=9), "f1_mean", ["provider", "format"])


@register("provider_summary", with_views(
    """SELECT provider, count(*) AS runs, round(avg(f1), 9) AS avg_f1, round(avg(pr_auc), 9) AS avg_auc,
    round(avg(recall_at_n), 9) AS avg_recall_at_n, round(sum(cost), 9) AS total_cost,
    round(max(f1), 9) AS best_f1, first(format ORDER BY f1 DESC, run) AS best_config,
    round(max(recall_at_n), 9) AS best_recall_at_n, first(format ORDER BY recall_at_n DESC, run) AS best_recall_config,
    round(min(cost_per_1k), 9) AS cheapest_cost_per_1k, first(format ORDER BY cost_per_1k, run) AS cheapest_config
    FROM runs GROUP BY provider""", "v_scores", "v_tokens", more=RUNS))
def provider_summary(spark, sf):
    return r6(replicates.provider_summary(run_table(spark, sf)), digits=9)


@register("pr_grid_mean", with_views(
    """SELECT provider, format, g / 50 AS recall, round(avg(p), 6) AS precision FROM (
    SELECT n.run, provider, format, g, coalesce(max(precision) FILTER (recall >= g / 50), 0.0) AS p
    FROM names n JOIN (SELECT * FROM points WHERE kind = 'score') p ON n.run = p.run, generate_series(0, 50) t(g)
    GROUP BY n.run, provider, format, g) GROUP BY provider, format, g""", "v_scores", more=POINTS + """,
    names AS (SELECT run, any_value(provider) AS provider, any_value(format) AS format FROM v_scores GROUP BY run)"""))
def pr_grid_mean(spark, sf):
    keys = ["provider", "format", "run"]
    points = bands.pr_points(bands.score_bands(views.scores(spark, sf), keys), keys)
    return r6(replicates.mean_pr_curve(points, ["provider", "format"], "run"), "precision")


_HIST = "SELECT run, {bin} AS bin, count(*) FILTER (truth = 1) AS interesting, count(*) FILTER (truth != 1) AS boring FROM {src} GROUP BY run, {bin}"


@register("score_histogram_exact", with_views(_HIST.format(bin="score", src="v_scores"), "v_scores"))
def score_histogram_exact(spark, sf):
    return bands.histogram(views.scores(spark, sf), RUN, bin="exact")


@register("score_histogram_trunc", with_views(_HIST.format(bin="trunc(score / 4)::BIGINT", src="v_scores"), "v_scores"))
def score_histogram_trunc(spark, sf):
    return bands.histogram(views.scores(spark, sf).withColumn("score", F.col("score") / 4), RUN, bin="trunc")


@register("score_histogram_halfeven", with_views(
    _HIST.format(bin="round_even(score / 4, 0)::BIGINT", src="v_scores"), "v_scores"))
def score_histogram_halfeven(spark, sf):
    return bands.histogram(views.scores(spark, sf).withColumn("score", F.col("score") / 4), RUN, bin="halfeven")


@register("histogram_replicates", with_views(
    "SELECT provider, format, bin, " + ", ".join(
        f"round(avg({c}), 6) AS {c}_mean, round(coalesce(stddev_samp({c}), 0), 6) AS {c}_std" for c in ("interesting", "boring", "total"))
    + """ FROM (SELECT b.*, r.run, coalesce(i, 0) AS interesting, coalesce(o, 0) AS boring, coalesce(i, 0) + coalesce(o, 0) AS total
    FROM bins b JOIN runs r USING (provider, format) LEFT JOIN counts c ON c.run = r.run AND c.bin = b.bin) GROUP BY provider, format, bin""",
    "v_scores", more="""counts AS (SELECT run, score AS bin, count(*) FILTER (truth = 1) AS i, count(*) FILTER (truth != 1) AS o
      FROM v_scores GROUP BY run, score),
    bins AS (SELECT DISTINCT provider, format, score AS bin FROM v_scores), runs AS (SELECT DISTINCT provider, format, run FROM v_scores)"""))
def histogram_replicates(spark, sf):
    hist = bands.histogram(views.scores(spark, sf), ["provider", "format", "run"])
    return r6(replicates.histogram_over_replicates(hist, ["provider", "format"], "run"))


CLASSES = "rows AS (SELECT score, CASE WHEN truth = 1 THEN run ELSE '' END AS classification, truth FROM v_scores)"


def _classed(spark, sf):
    rows = views.scores(spark, sf)
    return rows.withColumn("classification", F.when(F.col("truth") == 1, F.col("run")).otherwise(""))


@register("class_mean_rollup", with_views(
    """SELECT CASE WHEN grouping(classification) = 1 THEN 'Total Average' WHEN classification = '' THEN 'No classification'
    ELSE classification END AS label, round(avg(score), 6) AS mean_score, grouping(classification)::INT AS is_total
    FROM rows GROUP BY ROLLUP (classification)""", "v_scores", more=CLASSES))
def class_mean_rollup(spark, sf):
    return r6(bands.class_means(_classed(spark, sf)))


OUTCOME = """CASE WHEN truth = 1 AND score >= 4 THEN 'tp' WHEN truth != 1 AND score >= 4 THEN 'fp' WHEN truth = 1 THEN 'fn' ELSE 'tn' END"""


@register("detail_histogram_grouping_sets", with_views(
    f"""SELECT CASE WHEN grouping(classification) = 0 THEN 'class' WHEN grouping(outcome) = 0 THEN 'outcome' ELSE 'all' END AS kind,
    CASE WHEN grouping(classification) = 0 THEN classification WHEN grouping(outcome) = 0 THEN outcome ELSE '__all__' END AS subset,
    bin, count(*) AS n FROM (SELECT classification, {OUTCOME} AS outcome, trunc(score)::BIGINT AS bin FROM rows)
    GROUP BY GROUPING SETS ((classification, bin), (outcome, bin), (bin))""", "v_scores", more=CLASSES))
def detail_histogram_grouping_sets(spark, sf):
    rows = _classed(spark, sf).withColumn("outcome", numbers.outcome("score", "truth", 4.0))
    return bands.detail_histogram(rows)


@register("top_images", with_views(
    """SELECT run, image, score, row_number() OVER w AS rank FROM v_scores
    WINDOW w AS (PARTITION BY run ORDER BY score DESC, image) QUALIFY row_number() OVER w <= 20""", "v_scores"))
def top_images(spark, sf):
    return bands.top_images(views.scores(spark, sf), RUN).select("run", "image", "score", "rank")


@register("report_set", with_views(
    """SELECT image, score, truth, rank <= 50 AS in_top FROM (SELECT *, row_number() OVER (ORDER BY score DESC, image) AS rank FROM v_scores)
    WHERE rank <= 50 OR truth = 1""", "v_scores"))
def report_set(spark, sf):
    return report.report_set(views.scores(spark, sf), 50).select("image", "score", "truth", "in_top")


@register("score_tiers", with_views(
    f"""SELECT image, CASE WHEN m <= 0 THEN 'none' WHEN score / m >= 0.7 THEN 'high' WHEN score / m >= 0.4 THEN 'middle' ELSE 'low' END AS tier,
    round(CASE WHEN m > 0 THEN score / m * 100 ELSE 0 END, 6) AS percent, {OUTCOME} AS outcome,
    CASE WHEN score >= 35 THEN 'high' WHEN score >= 20 THEN 'middle' ELSE 'low' END AS sum_tier
    FROM v_scores, (SELECT max(score) AS m FROM v_scores)""", "v_scores"))
def score_tiers(spark, sf):
    rows = report.with_top_score(views.scores(spark, sf), "score")
    return r6(rows.select("image", numbers.score_tier("score", "top_score").alias("tier"),
                          numbers.score_percent("score", "top_score").alias("percent"),
                          numbers.outcome("score", "truth", 4.0).alias("outcome"), numbers.sum_tier("score").alias("sum_tier")))


@register("group_index", with_views(
    "SELECT DISTINCT provider, format, dense_rank() OVER (PARTITION BY provider ORDER BY format) - 1 AS group_index FROM v_scores",
    "v_scores"))
def group_index(spark, sf):
    groups = views.scores(spark, sf).select("provider", "format").distinct()
    return replicates.group_index(groups).select("provider", "format", F.col("group_index").cast("bigint").alias("group_index"))


@register("describe_runs", """SELECT url, CASE WHEN u LIKE '%gemini%' THEN 'gemini' WHEN u LIKE '%qwen%' THEN 'qwen' ELSE 'other' END AS provider,
    CASE WHEN u LIKE '%single_elim%' THEN 'single-elim' WHEN u LIKE '%tournament%' THEN 'tournament' WHEN u LIKE '%likert%' THEN 'likert'
    WHEN u LIKE '%hybrid%' THEN 'hybrid' END AS format FROM (SELECT url, lower(url || ' ' ||
    (['gemini_tournament_1', 'Qwen_Single_Elim_tournament', 'x_likert', 'hybrid', 'other'])[page_id % 5 + 1]) AS u FROM pages)""")
def describe_runs(spark, sf):
    names = ["gemini_tournament_1", "Qwen_Single_Elim_tournament", "x_likert", "hybrid", "other"]
    pages = views.table(spark, sf, "pages").select(
        "url", F.get(F.array(*[F.lit(n) for n in names]), (F.col("page_id") % 5).cast("int")).alias("parent"))
    return replicates.describe_runs(pages, "url", "parent").select("url", "provider", "format")


# --- experts and volunteers ---------------------------------------------------

EXPERTS = """x AS (SELECT image, count(*) AS expert_n, sum(vote)::BIGINT AS expert_selected_n, sum(vote) / count(*) AS expert_score,
    coalesce(string_agg(expert, ',' ORDER BY expert) FILTER (vote = 1), '') AS selected_by FROM v_votes GROUP BY image)"""


@register("expert_score", with_views(
    "SELECT image, expert_n, expert_selected_n, round(expert_score, 6) AS expert_score, selected_by FROM x", "v_votes", more=EXPERTS))
def expert_score(spark, sf):
    rows = agreement.expert_scores(agreement.latest_votes(views.votes(spark, sf)))
    return r6(rows.withColumn("selected_by", F.array_join("selected_by", ",")))


FULL = EXPERTS + """, f AS (SELECT coalesce(a.image, x.image) AS image, coalesce(a.score, 0) AS score,
    CASE WHEN a.image IS NULL THEN 'Not present.' ELSE reasoning END AS reasoning, coalesce(expert_n, 0) AS expert_n,
    coalesce(expert_selected_n, 0) AS expert_selected_n, coalesce(expert_score, 0) AS expert_score,
    CASE WHEN coalesce(expert_score, 0) >= 0.4 THEN 1 ELSE 0 END AS expert_positive,
    a.image IS NULL AS missing_from_ai, x.image IS NULL AS missing_from_experts, ai_selected
    FROM v_ai a FULL JOIN x ON a.image = x.image)"""


def _full(spark, sf, how="full"):
    votes = agreement.latest_votes(views.votes(spark, sf))
    return agreement.agreement(views.ai_results(spark, sf), votes, how=how, missing_text={"reasoning": "Not present."})


@register("ai_expert_full_join", with_views(
    """SELECT image, score, reasoning, expert_n, expert_selected_n, round(expert_score, 6) AS expert_score, expert_positive,
    missing_from_ai, missing_from_experts FROM f""", "v_votes", "v_ai", more=FULL))
def ai_expert_full_join(spark, sf):
    return r6(_full(spark, sf).select("image", "score", "reasoning", "expert_n", "expert_selected_n", "expert_score",
                                      "expert_positive", "missing_from_ai", "missing_from_experts"))


@register("agreement_counters", with_views(
    """SELECT count(*) AS total_images, count(*) FILTER (expert_n > 0) AS rated_images, round(avg(score), 6) AS avg_score,
    round(avg(expert_score) FILTER (expert_n > 0), 6) AS avg_expert_score, sum(expert_positive)::BIGINT AS expert_positive,
    count(*) FILTER (missing_from_ai) AS missing_from_ai, count(*) FILTER (missing_from_experts) AS missing_from_experts FROM f""",
    "v_votes", "v_ai", more=FULL))
def agreement_counters(spark, sf):
    return r6(agreement.agreement_counters(_full(spark, sf)))


@register("votes_histogram", with_views(
    """SELECT k, round(k / m, 6) AS share, count(*) FILTER (f.ai_selected = 1) AS ai_yes, count(*) FILTER (f.ai_selected = 0) AS ai_no
    FROM (SELECT count(DISTINCT expert) AS m, unnest(generate_series(0, count(DISTINCT expert))) AS k FROM v_votes)
    LEFT JOIN f ON f.expert_selected_n = k AND f.expert_n > 0 AND NOT missing_from_ai GROUP BY k, m""", "v_votes", "v_ai", more=FULL))
def votes_histogram(spark, sf):
    votes = agreement.latest_votes(views.votes(spark, sf))
    rows = agreement.agreement(views.ai_results(spark, sf), votes, how="whitelist")
    return r6(agreement.votes_histogram(rows, votes))


@register("density_bins", with_views(
    """SELECT image, round_even(score / 1.0, 0)::BIGINT AS x_bin, round_even(expert_score / 0.02, 0)::BIGINT AS y_bin,
    count(*) OVER (PARTITION BY round_even(score / 1.0, 0), round_even(expert_score / 0.02, 0)) AS density,
    round(least(0.92, 0.16 + 0.1 * (density - 1)), 6) AS weight FROM f WHERE expert_n > 0""", "v_votes", "v_ai", more=FULL))
def density_bins(spark, sf):
    rated = _full(spark, sf).filter(F.col("expert_n") > 0).select("image", "score", "expert_score")
    return r6(agreement.density(rated, "score", "expert_score", 1.0, 0.02).select("image", "x_bin", "y_bin", "density", "weight"))


@register("expert_tiers", with_views(
    """SELECT image, CASE WHEN expert_score >= 0.4 THEN 'high' WHEN expert_score > 0 THEN 'middle' ELSE 'low' END AS loose,
    CASE WHEN expert_score > 0.5 THEN 'high' WHEN expert_score > 0 THEN 'middle' ELSE 'low' END AS strict,
    printf('%.1f%%', 100 * expert_score) AS text, list_contains(string_split(selected_by, ','), 'click') AS by_click
    FROM x""", "v_votes", more=EXPERTS))
def expert_tiers(spark, sf):
    rows = agreement.expert_scores(agreement.latest_votes(views.votes(spark, sf)))
    return rows.select("image", numbers.expert_tier("expert_score").alias("loose"),
                       numbers.expert_tier("expert_score", 0.5, True).alias("strict"),
                       text.percent_text("expert_score").alias("text"), report.selected_by("click").alias("by_click"))


@register("volunteer_consensus", """SELECT user_id % 97 AS image, count(*) AS count, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS selected_count,
    count(DISTINCT user_id) AS unique_user_count,
    round(100 * sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) / count(DISTINCT user_id), 2) AS percent_selected FROM events GROUP BY user_id % 97""")
def volunteer_consensus(spark, sf):
    votes = views.table(spark, sf, "events").select(
        (F.col("user_id") % 97).alias("image"), F.col("user_id").alias("user"), (F.col("value") > 50).cast("int").alias("selected"))
    return agreement.volunteer_consensus(votes)


@register("anomaly_scores", """SELECT event_id, round(0.8 * value + 0.2 * (event_id % 7), 6) AS anomaly_score,
    round(value * 0.01, 6) AS volunteer_rating,
    round(least(greatest(CASE WHEN value > 1 THEN value / 100 ELSE value END, 0), 1), 6) AS fraction FROM events""")
def anomaly_scores(spark, sf):
    e = views.table(spark, sf, "events")
    return r6(e.select("event_id", agreement.anomaly_score("value", F.col("event_id") % 7).alias("anomaly_score"),
                       numbers.volunteer_rating("value").alias("volunteer_rating"), numbers.fraction("value").alias("fraction")))


@register("agreement_whitelist", with_views(
    """SELECT a.image, a.score, coalesce(expert_n, 0) AS expert_n, round(coalesce(expert_score, 0), 6) AS expert_score,
    CASE WHEN coalesce(expert_score, 0) > 0.4 THEN 1 ELSE 0 END AS expert_positive FROM v_ai a LEFT JOIN x ON a.image = x.image""",
    "v_votes", "v_ai", more=EXPERTS))
def agreement_whitelist(spark, sf):
    votes = agreement.latest_votes(views.votes(spark, sf))
    rows = agreement.agreement(views.ai_results(spark, sf), votes, how="whitelist", strict=True)
    return r6(rows.select("image", "score", "expert_n", "expert_score", "expert_positive"))


@register("results_with_truth", with_views(
    "SELECT a.image, score, vote FROM v_ai a JOIN v_votes v ON a.image = v.image WHERE expert = 'click'", "v_ai", "v_votes"))
def results_with_truth(spark, sf):
    truth = agreement.latest_votes(views.votes(spark, sf)).filter("expert = 'click'").select("image", "vote")
    return matching.restrict_to_truth(views.ai_results(spark, sf).select("image", "score"), truth)


@register("examples_left_out", with_views(
    "SELECT image FROM v_ai WHERE image NOT IN (SELECT user_id FROM events)", "v_ai"))
def examples_left_out(spark, sf):
    seen = views.table(spark, sf, "events").select(F.col("user_id").alias("image")).distinct()
    return report.exclude(views.ai_results(spark, sf).select("image"), seen, "image")


@register("all_ids", with_views("SELECT image FROM v_ai UNION SELECT image FROM v_votes", "v_ai", "v_votes"))
def all_ids(spark, sf):
    return report.all_ids([views.ai_results(spark, sf), views.votes(spark, sf)], "image")


@register("first_rows", "SELECT c_custkey, c_name, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 1000")
def first_rows(spark, sf):
    return report.first_rows(views.table(spark, sf, "customer"), 1000, "c_custkey", ["c_custkey", "c_name", "c_mktsegment"])


@register("chosen_formats", with_views(
    "SELECT run, count(*) AS n FROM v_scores WHERE format IN ('likert', 'hybrid') GROUP BY run", "v_scores"))
def chosen_formats(spark, sf):
    return views.scores(spark, sf).filter(report.format_in("likert", "hybrid")).groupBy("run").agg(F.count("*").alias("n"))


# --- regression ----------------------------------------------------------------


@register("linear_fit", """SELECT l_returnflag AS flag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
    round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2,
    min(l_quantity) AS x_min, max(l_quantity) AS x_max FROM lineitem GROUP BY l_returnflag""")
def linear_fit(spark, sf):
    li = views.table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "flag")
    fit = regression.linear_fit(li, ["flag"], "l_quantity", "l_extendedprice")
    return fit.select("flag", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"),
                      F.round("r2", 6).alias("r2"), "x_min", "x_max")


# Normal equations of two features around their means, after median imputation.
OLS = """med AS (SELECT quantile_cont(x1, 0.5) AS m1, quantile_cont(x2, 0.5) AS m2 FROM v_reg),
  t AS (SELECT coalesce(x1, m1) AS a, coalesce(x2, m2) AS b, y FROM v_reg, med),
  c AS (SELECT covar_pop(a, a) AS saa, covar_pop(b, b) AS sbb, covar_pop(a, b) AS sab, covar_pop(a, y) AS say, covar_pop(b, y) AS sby,
    avg(a) AS ma, avg(b) AS mb, avg(y) AS my, max(y) AS top FROM t),
  s AS (SELECT *, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS ka, (sby * saa - say * sab) / (saa * sbb - sab * sab) AS kb FROM c),
  pred AS (SELECT a, b, least(greatest(my + ka * (a - ma) + kb * (b - mb), 0), CASE WHEN top <= 1 THEN 1.0 ELSE 100.0 END) AS p FROM t, s)"""


def _predicted(spark, sf):
    rows = views.regression_rows(spark, sf)
    return regression.fit_predict(rows, rows, ["x1", "x2"], "y")


@register("ols_two_features", with_views(
    "SELECT a AS x1, b AS x2, round(p, 4) AS expert_score, count(*) AS n FROM pred GROUP BY a, b, round(p, 4)", "v_reg", more=OLS))
def ols_two_features(spark, sf):
    rows = views.regression_rows(spark, sf)
    model = regression.fit_linear(rows, ["x1", "x2"], "y")
    filled = rows.select("x1", F.coalesce("x2", F.lit(model.medians[1])).alias("x2"), F.round(model.predict(rows), 4).alias("expert_score"))
    return filled.groupBy("x1", "x2", "expert_score").agg(F.count("*").alias("n"))


@register("prediction_describe", with_views(
    """SELECT count(p) AS count, round(avg(p), 4) AS mean, round(stddev_samp(p), 4) AS std, round(min(p), 4) AS min,
    round(quantile_cont(p, 0.25), 4) AS q25, round(quantile_cont(p, 0.5), 4) AS q50, round(quantile_cont(p, 0.75), 4) AS q75,
    round(max(p), 4) AS max FROM pred""", "v_reg", more=OLS))
def prediction_describe(spark, sf):
    stats = regression.describe(_predicted(spark, sf), "expert_score")
    return stats.select("count", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


@register("exact_quartiles", """SELECT l_returnflag AS flag, round(quantile_cont(l_extendedprice, 0.25), 4) AS q25,
    round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.75), 4) AS q75
    FROM lineitem GROUP BY l_returnflag""")
def exact_quartiles(spark, sf):
    li = views.table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "flag")
    out = exact_quantiles(li, ["flag"], "l_extendedprice", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return out.select("flag", *[F.round(c, 4).alias(c) for c in ("q25", "q50", "q75")])


# --- judgment logs ---------------------------------------------------------------


@register("likert_sum", with_views(
    """SELECT c_custkey AS id, coalesce(s, 0)::BIGINT AS imagescore FROM customer LEFT JOIN (SELECT id, sum(score) AS s FROM v_log
    WHERE slot BETWEEN 1 AND 16 AND score BETWEEN 1 AND 5 GROUP BY id) l ON c_custkey = l.id""", "v_log"))
def likert_sum(spark, sf):
    log = tallies.valid_grades(views.judgment_log(spark, sf))
    return tallies.likert_sum(log, views.judged_items(spark, sf))


@register("selection_count", with_views(
    """SELECT c_custkey AS id, coalesce(c, 0)::BIGINT AS imagescore FROM customer LEFT JOIN (SELECT id, count(*) AS c FROM v_log
    WHERE kept = 1 GROUP BY id) l ON c_custkey = l.id""", "v_log"))
def selection_count(spark, sf):
    log = views.judgment_log(spark, sf).filter(F.col("kept") == 1)
    return tallies.selection_count(log, views.judged_items(spark, sf))


@register("rounds_survived", with_views(
    """SELECT run, id, sum(kept)::BIGINT AS imagescore FROM (SELECT * FROM v_log
    QUALIFY row_number() OVER (PARTITION BY run, round, id ORDER BY seq DESC) = 1) GROUP BY run, id""", "v_log"))
def rounds_survived(spark, sf):
    return tallies.rounds_survived(tallies.last_judgments(views.judgment_log(spark, sf)))


@register("mean_over_runs", with_views(
    """SELECT id, round(avg(s), 6) AS avg_score, count(*) AS n_runs, first(first_seq ORDER BY run) AS first_seq
    FROM (SELECT id, run, sum(score) AS s, min(seq) AS first_seq FROM v_log GROUP BY id, run) GROUP BY id""", "v_log"))
def mean_over_runs(spark, sf):
    log = views.judgment_log(spark, sf)
    runs = log.groupBy("id", "run").agg(F.sum("score").alias("imagescore"), F.min("seq").alias("first_seq"))
    return r6(tallies.mean_over_runs(runs, id_col="id", coords=("first_seq",)))


@register("run_audit", with_views(
    """SELECT count(*) AS images, count(*) FILTER (n = 3) AS in_all_runs FROM (SELECT id, count(DISTINCT run) AS n FROM v_log GROUP BY id)""",
    "v_log"))
def run_audit(spark, sf):
    runs = views.judgment_log(spark, sf).groupBy("id", "run").agg(F.sum("score").alias("imagescore"))
    return tallies.run_audit(tallies.mean_over_runs(runs, id_col="id", coords=()), 3)


def _reasoning(which: str, direction: str) -> None:
    @register(f"reasoning_{which}", with_views(
        f"""SELECT id, reasoning FROM v_log WHERE reasoning != ''
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY round {direction}, seq {direction}) = 1""", "v_log"))
    def reasoning(spark, sf):
        return tallies.reasoning_per_image(views.judgment_log(spark, sf), which=which)


_reasoning("first", "ASC")
_reasoning("last", "DESC")


@register("token_totals_by_round", with_views(
    """SELECT run, round, i::BIGINT AS input_tokens, o::BIGINT AS output_tokens, (i + o)::BIGINT AS total_tokens,
    (sum(i) OVER w)::BIGINT AS cumulative_input_tokens, (sum(o) OVER w)::BIGINT AS cumulative_output_tokens FROM (
    SELECT run, round, sum(i) AS i, sum(o) AS o FROM (SELECT run, round, grp, max(input_tokens) AS i, max(output_tokens) AS o FROM v_log
    GROUP BY run, round, grp) GROUP BY run, round) WINDOW w AS (PARTITION BY run ORDER BY round)""", "v_log"))
def token_totals_by_round(spark, sf):
    return tallies.tokens_by_round(views.judgment_log(spark, sf))


@register("round_integrity", with_views(
    """SELECT run, id, 'missing' AS problem FROM (SELECT DISTINCT run, id FROM v_log WHERE slot > 8) a
      WHERE NOT EXISTS (SELECT 1 FROM v_log s WHERE s.slot <= 8 AND s.kept = 1 AND s.run = a.run AND s.id = a.id)
    UNION ALL SELECT run, id, 'extra' FROM (SELECT DISTINCT run, id FROM v_log WHERE slot <= 8 AND kept = 1) s
      WHERE NOT EXISTS (SELECT 1 FROM v_log a WHERE a.slot > 8 AND s.run = a.run AND s.id = a.id)""", "v_log"))
def round_integrity(spark, sf):
    log = views.judgment_log(spark, sf)
    return tallies.round_integrity(log.filter("slot > 8"), log.filter("slot <= 8 AND kept = 1"))
