"""Evaluation, agreement and regression on edge rows, against plain Python."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from skysift.operators import agreement, bands, regression, replicates, views
from skysift.operators.ordering import exact_quantiles, positions, running, score_bucket, score_buckets, top_in
from skysift.plans.evaluation import dashboard


def scored(spark, runs):
    rows = [(run, i, float(s), int(t)) for run, pairs in runs.items() for i, (s, t) in enumerate(pairs)]
    return spark.createDataFrame(rows, "run string, image long, score double, truth int")


def banded(spark, pairs):
    return bands.score_bands(scored(spark, {"r": pairs}), ["run"])


def confusion(pairs, t):
    tp = sum(1 for s, y in pairs if s >= t and y)
    fp = sum(1 for s, y in pairs if s >= t and not y)
    fn = sum(1 for s, y in pairs if s < t and y)
    p = tp / (tp + fp) if tp + fp else 0.0
    r = tp / (tp + fn) if tp + fn else 0.0
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


CASES = {
    "mixed": [(5, 1), (5, 0), (4, 1), (3, 0), (3, 0), (1, 1), (0, 0)],
    "all equal": [(2, 1), (2, 0), (2, 0)],
    "no positives": [(3, 0), (2, 0), (1, 0)],
    "all positives": [(3, 1), (2, 1)],
    "negative scores": [(-1, 1), (-2.5, 0), (-2.5, 1), (7, 0)],
    "one": [(1, 1)],
}


@pytest.mark.parametrize("name", CASES)
def test_rules_and_areas(spark, name):
    pairs = CASES[name]
    b = banded(spark, pairs)
    scores = sorted({float(s) for s, _ in pairs}, reverse=True)
    low, high = scores[-1] - 1, scores[0] + 1
    f1 = {t: confusion(pairs, t) for t in [*scores, low, high]}
    want = {
        "t1": max([*scores, low], key=lambda t: (f1[t][2], -t)),
        "t2": max(scores, key=lambda t: (f1[t][2], f1[t][1], f1[t][0], t)),
        "t3": max([high, *scores], key=lambda t: (f1[t][2], f1[t][0], f1[t][1], -t)),
        "t5": max(scores, key=lambda t: (f1[t][2], -t)),
    }
    positives = sum(y for _, y in pairs)
    for rule, t in want.items():
        got = bands.best_threshold(b, ["run"], rule).collect()
        if rule == "t5" and not positives:
            assert got == []
            continue
        assert got[0]["threshold"] == t, rule
        assert (got[0]["precision"], got[0]["recall"], got[0]["f1"]) == pytest.approx(f1[t])
    if name == "all equal":
        assert want["t1"] == low

    steps, seen = 0.0, None
    for t in [*scores, low]:
        p, r, _ = f1[t]
        if seen is not None and r != seen:
            steps += (r - seen) * p
        seen = r
    curve = [(0.0, 0.0)] + [(f1[t][1], f1[t][0]) for t in scores]

    def trapezoid(points):
        return sum((x1 - x0) * (y0 + y1) / 2 for (x0, y0), (x1, y1) in zip(points, points[1:]))

    areas = {"step": steps, "trapezoid": trapezoid(curve), "sorted": trapezoid(sorted(curve)),
             "library": trapezoid([(0.0, 1.0)] + curve[1:])}
    for dialect, area in areas.items():
        got = bands.pr_auc(b, ["run"], dialect).collect()
        if dialect == "library" and not positives:
            assert got == []
        else:
            assert got[0]["pr_auc"] == pytest.approx(area), dialect
    summary = bands.run_summary(b, ["run"], 2).first()
    assert summary["threshold"] == want["t1"] and summary["f1"] == pytest.approx(f1[want["t1"]][2])
    assert summary["pr_auc"] == pytest.approx(steps)


@pytest.mark.parametrize("name", CASES)
def test_recall(spark, name):
    pairs = sorted(CASES[name], reverse=True)
    b, positives = banded(spark, pairs), sum(y for _, y in pairs)

    def expected(n):
        n = max(1, min(n, len(pairs)))
        cut = pairs[n - 1][0]
        above = [y for s, y in pairs if s > cut]
        tie = [y for s, y in pairs if s == cut]
        return (sum(above) + sum(tie) * (n - len(above)) / len(tie)) / positives if positives else 0.0

    for n in (0, 1, 2, 3, 99):
        assert bands.recall_at(b, ["run"], n).first()["recall_at_n"] == pytest.approx(expected(n))
    curve = [(r["rank"], r["recall"]) for r in bands.recall_curve(b, ["run"]).orderBy("rank").collect()]
    if not positives:
        assert curve == []
        return
    assert [k for k, _ in curve] == list(range(1, len(pairs) + 1))
    values = [v for _, v in curve]
    assert values == sorted(values) and values[-1] == pytest.approx(1.0)
    assert values == pytest.approx([expected(n) for n in range(1, len(pairs) + 1)])


def test_wide_band_is_expanded_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(bands, "EXPAND_CHUNK", 7)
    pairs = [(1, i % 5 == 0) for i in range(100)] + [(2, 1)]
    curve = bands.recall_curve(banded(spark, pairs), ["run"]).orderBy("rank").collect()
    assert [r["rank"] for r in curve] == list(range(1, 102)) and curve[-1]["recall"] == pytest.approx(1.0)


def test_many_scores_in_many_buckets(spark):
    rng = random.Random(1)
    pairs = [(rng.lognormvariate(0, 3) * rng.choice([-1, 1]), rng.random() < 0.3) for _ in range(3000)]
    got = {r["score"]: r["n_ge"] for r in banded(spark, pairs).collect()}
    ordered = sorted((s for s, _ in pairs), reverse=True)
    assert got == {s: i + 1 for i, s in enumerate(ordered)}


def test_crowded_scores_are_split(spark):
    # 100,000 distinct scores within a thousandth, and one far below them.
    n = 100_000
    near = spark.range(n).select(F.lit("r").alias("run"), F.col("id").alias("image"), (0.999 + F.col("id") / (n * 1000)).alias("score"), F.lit(1).alias("truth"))
    df = near.union(spark.createDataFrame([("r", n, -5.0, 0)], near.schema))
    last = near.groupBy(score_buckets("score")[-1].alias("b")).count()
    assert last.count() > 400 and last.agg(F.max("count")).first()[0] < 500
    got = bands.score_bands(df, ["run"]).join(near.select("score", (n - F.col("image")).alias("place")), "score", "left")
    assert got.filter("place is null").select("score", "n_ge", "tp_ge", "n_all", "p_all").collect() == [(-5.0, n + 1, n, n + 1, n)]
    assert got.filter("place = n_ge and place = tp_ge and n_all = 100001").count() == n


def test_positions_and_running(spark):
    rows = [(k, i, (i * 37) % 101) for k in ("a", "b") for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(5)
    placed = positions(df, ["k"], score_bucket("v"), [F.col("v"), F.col("i")], "p", "n").collect()
    for k in ("a", "b"):
        mine = sorted((r["v"], r["i"], r["p"]) for r in placed if r["k"] == k)
        assert [p for *_, p in mine] == list(range(200))
    assert {r["n"] for r in placed} == {200}
    total = running(df, ["k"], score_bucket("v"), [F.col("v"), F.col("i")], {"s": "v"}, {"all": "v"}).collect()
    assert max(r["s"] for r in total) == total[0]["all"] == sum((i * 37) % 101 for i in range(200))


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [3.0] * 5, [1e9 + i * 1e-3 for i in range(101)], [-5.0, 0.0, 0.0, 2.0, 1e6]])
def test_quantiles(spark, values):
    df = spark.createDataFrame([("g", v) for v in values], "g string, x double")
    got = exact_quantiles(df, ["g"], "x", {"a": 0.25, "b": 0.5, "c": 0.9}).first()

    def want(q):
        s, at = sorted(values), (len(values) - 1) * q
        lo = int(at)
        return s[lo] + (s[min(lo + 1, len(s) - 1)] - s[lo]) * (at - lo)

    assert [got["a"], got["b"], got["c"]] == pytest.approx([want(0.25), want(0.5), want(0.9)], rel=1e-12)


def test_top_in_limits_before_the_shuffle(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    plan = top_in(df, ["k"], [F.col("id")], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") and "Partial" in plan


# --- replicates --------------------------------------------------------------------


def test_replicate_stats(spark):
    runs = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "g string, f1 double")
    got = {r["g"]: (r["n_reps"], r["f1_mean"], r["f1_std"]) for r in replicates.replicate_stats(runs, ["g"], ["f1"]).collect()}
    assert got == {"a": (2, 2.0, pytest.approx(2**0.5)), "b": (1, 2.0, 0.0)}


def test_histogram_over_replicates(spark):
    hist = spark.createDataFrame(
        [("g", "r1", 0.0, 4, 1), ("g", "r2", 0.0, 2, 1), ("g", "r1", 1.0, 3, 0), ("h", "r3", 0.0, 5, 0)],
        "g string, run string, bin double, interesting long, boring long")
    got = {(r["g"], r["bin"]): r for r in replicates.histogram_over_replicates(hist, ["g"], "run").collect()}
    assert got[("g", 0.0)]["interesting_mean"] == 3.0 and got[("g", 0.0)]["interesting_std"] == pytest.approx(statistics.stdev([4, 2]))
    # A bin one replicate lacks counts 0 there.
    assert got[("g", 1.0)]["total_mean"] == 1.5 and got[("g", 1.0)]["total_std"] == pytest.approx(statistics.stdev([3, 0]))
    assert got[("h", 0.0)]["total_std"] == 0.0


def test_histogram_counts_beyond_long_products(spark):
    big = 5_000_000_000
    hist = spark.createDataFrame([("g", "r1", 0.0, big, 0), ("g", "r2", 0.0, big + 2, 0)],
                                 "g string, run string, bin double, interesting long, boring long")
    got = replicates.histogram_over_replicates(hist, ["g"], "run").first()
    assert got["interesting_std"] == pytest.approx(2**0.5)


def test_names_and_cost(spark):
    names = [("gemini_single_elim_tournament_1", ""), ("run", "qwen_hybrid"), ("x_likert", ""), ("gemini_x", "")]
    got = replicates.describe_runs(spark.createDataFrame(names, "stem string, parent string")).collect()
    assert [(r["provider"], r["format"]) for r in got] == [("gemini", "single-elim"), ("qwen", "hybrid"), ("other", "likert"), ("gemini", None)]
    stems = spark.createDataFrame([("gemini_tourna_few_shot_1",), ("qwen_grid_noshot",), ("gemini_grid",)], "stem string")
    got = {r["stem"]: (r["provider"], r["format"], r["shot"]) for r in replicates.describe_expert_runs(stems).collect()}
    assert got == {"gemini_tourna_few_shot_1": ("gemini", "tournament", "few-shot"), "qwen_grid_noshot": ("qwen", "grid-likert", "no-shot")}
    runs = spark.createDataFrame([("gemini", 10, 2_000_000, 1_000_000), ("other", 10, 5, 5), ("qwen", 0, 1_000_000, 0)],
                                 "provider string, n_images long, input_tokens long, output_tokens long")
    got = {r["provider"]: (r["cost"], r["cost_per_1k"]) for r in replicates.with_cost(runs).collect()}
    assert got == {"gemini": (2.0, 200.0), "other": (0.0, 0.0), "qwen": (0.45, 0.0)}


def test_dashboard(spark):
    s = scored(spark, {"a": CASES["mixed"], "b": CASES["all equal"], "c": CASES["no positives"]})
    s = s.withColumn("provider", F.when(F.col("run") == "c", "qwen").otherwise("gemini")).withColumn("format", F.lit("likert"))
    tokens = spark.createDataFrame([("a", 100, 10)], "run string, input_tokens long, output_tokens long")
    tables = dashboard(s, tokens, n=2)
    assert tables["runs"].count() == 3 and tables["leaderboard"].first()["provider"] == "gemini"
    assert tables["providers"].filter("provider = 'qwen'").first()["best_recall_at_n"] == 0.0
    assert tables["curves"].groupBy("provider").count().filter("count != 51").count() == 0


# --- agreement ------------------------------------------------------------------------


def test_votes_last_wins_and_joins(spark):
    votes = spark.createDataFrame(
        [("x", "ann", 0, 1, ""), ("x", "ann", 1, 2, "u1"), ("x", "bob", 0, 3, "u2"), ("y", "ann", 0, 4, ""), ("only", "bob", 1, 5, "")],
        "image string, expert string, vote int, seq long, url string")
    last = agreement.latest_votes(votes)
    assert {(r["image"], r["url"]) for r in agreement.first_urls(votes).collect()} == {("x", "u1")}
    ai = spark.createDataFrame([("x", 3.0, 1), ("y", 1.0, 0), ("z", 2.0, 1)], "image string, score double, ai_selected int")
    full = {r["image"]: r for r in agreement.agreement(ai.withColumn("ra", F.lit("1")), last, missing_text={"ra": "N/A"}).collect()}
    assert full["x"]["expert_score"] == 0.5 and full["x"]["selected_by"] == ["ann"] and full["x"]["expert_positive"] == 1
    assert full["only"]["missing_from_ai"] and full["only"]["score"] == 0.0 and full["only"]["ra"] == "N/A"
    assert full["z"]["missing_from_experts"] and full["z"]["expert_score"] == 0.0 and full["z"]["selected_by"] == []
    listed = agreement.agreement(ai, last, how="whitelist", threshold=0.5, strict=True)
    assert {r["image"]: r["expert_positive"] for r in listed.collect()} == {"x": 0, "y": 0, "z": 0}
    hist = agreement.votes_histogram(listed, 3).orderBy("k").collect()
    assert [(r["k"], r["ai_yes"], r["ai_no"]) for r in hist] == [(0, 0, 1), (1, 1, 0), (2, 0, 0), (3, 0, 0)]
    counters = agreement.agreement_counters(agreement.agreement(ai, last)).first()
    assert (counters["total_images"], counters["rated_images"], counters["missing_from_ai"], counters["missing_from_experts"]) == (4, 3, 1, 1)


def test_density(spark):
    df = spark.createDataFrame([(0.5, 0.01), (0.4, 0.0), (1.5, 0.02), (30.0, 1.0)] + [(9.0, 0.5)] * 20, "x double, y double")
    got = agreement.density(df, "x", "y", 1.0, 0.02).collect()
    assert {r["density"] for r in got if r["x"] == 9.0} == {20} and max(r["weight"] for r in got) == pytest.approx(0.92)
    assert [r["density"] for r in got if r["x"] == 0.5] == [2]  # halves go to the even bin


# --- regression ------------------------------------------------------------------------


@pytest.mark.parametrize(
    "points, want",
    [([(1, 2), (2, 4), (3, 6)], (2.0, 0.0, 1.0)), ([(1, 1), (1, 3)], (0.0, 2.0, 0.0)), ([(1, 5), (2, 5)], (0.0, 5.0, 0.0)),
     ([(4, 9)], (0.0, 0.0, 0.0))],
)
def test_linear_fit(spark, points, want):
    df = spark.createDataFrame([("g", float(x), float(y)) for x, y in points], "g string, x double, y double")
    r = regression.linear_fit(df, ["g"], "x", "y").first()
    assert (r["slope"], r["intercept"], r["r2"]) == pytest.approx(want)
    flat = len({x for x, _ in points}) < 2
    assert regression.linear_fit(df, ["g"], "x", "y", "drop").count() == (0 if flat else 1)
    assert (r["y_min"] is None) == flat


def test_fit_without_rows(spark):
    assert regression.linear_fit(spark.createDataFrame([], "g string, x double, y double"), ["g"], "x", "y").count() == 0


def test_regression_imputes_and_clips(spark):
    import numpy as np

    rng = random.Random(3)
    rows = [(rng.random(), rng.random() if i % 7 else None) for i in range(80)]
    rows = [(a, b, min(1.0, 0.3 * a + 0.9 * (b or 0.5))) for a, b in rows] + [(0.1, 0.2, None)]
    train = spark.createDataFrame([(str(a), b, y) for a, b, y in rows], "a string, b double, y double")
    model = regression.fit_linear(train, ["a", "b"], "y")
    used = [r for r in rows if r[2] is not None]
    med = statistics.median([b for _, b, _ in used if b is not None])
    x = np.array([[1, a, med if b is None else b] for a, b, _ in used])
    beta = np.linalg.lstsq(x, np.array([y for *_, y in used]), rcond=None)[0]
    assert [model.intercept, *model.coefficients] == pytest.approx(beta.tolist()) and model.upper == 1.0
    out = regression.fit_predict(train, spark.createDataFrame([("9", 9.0), ("-9", None), ("n/a", None)], "a string, b double"), ["a", "b"], "y")
    got = [r["expert_score"] for r in out.collect()]
    assert got[0] == 1.0 and got[1] == 0.0 and 0 < got[2] < 1
    percent = train.withColumn("y", F.col("y") * 80)
    assert regression.fit_linear(percent, ["a", "b"], "y").upper == 100.0


def test_regression_errors(spark):
    df = spark.createDataFrame([(1.0, None, 0.5)], "a double, b double, y double")
    with pytest.raises(ValueError, match="missing on every"):
        regression.fit_linear(df, ["a", "b"], "y")
    with pytest.raises(ValueError, match="lacks columns"):
        regression.fit_linear(df, ["a", "c"], "y")
    with pytest.raises(ValueError, match="no training row"):
        regression.fit_linear(df.withColumn("y", F.lit(None).cast("double")), ["a"], "y")


def test_dependent_features(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 3.0 * i + 1) for i in range(10)], "a double, b double, y double")
    m = regression.fit_linear(df, ["a", "b"], "y")
    assert m.coefficients[0] + 2 * m.coefficients[1] == pytest.approx(3.0) and m.intercept == pytest.approx(1.0)


def test_report_set_and_classes(spark):
    s = scored(spark, {"r": [(5, 0), (4, 1), (3, 0), (3, 1)]})
    assert {r["image"]: r["in_top"] for r in views.report_set(s, 1).collect()} == {0: True, 1: False, 3: False}
    named = s.withColumn("classification", F.when(F.col("truth") == 1, "ring"))
    got = [(r["label"], r["mean_score"]) for r in bands.class_means(named).collect()]
    assert got == [("ring", 3.5), ("No classification", 4.0), ("Total Average", 3.75)]
    assert s.filter(views.class_is("run", None)).count() == 0 and named.filter(views.class_is("classification", None)).count() == 2


def test_bands_read_their_input_once(spark, tmp_path):
    scored(spark, {"a": CASES["mixed"], "b": CASES["all positives"]}).write.parquet(str(tmp_path / "s"))
    b = bands.score_bands(spark.read.parquet(str(tmp_path / "s")), ["run"])
    for df in (bands.recall_at(b, ["run"], 2), bands.run_summary(b, ["run"], 2)):
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert final.count("Scan parquet") == 1 and "ReusedExchange" in final
