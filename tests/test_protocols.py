"""Assignment and protocols: sizes, failures, stops and repeatability."""

import pytest
from pyspark.sql import functions as F

from skysift.operators import assignment, tallies
from skysift.plans import judges, protocols
from skysift.session import TableStore


def ids(spark, n):
    return spark.range(n).select(F.col("id"))


def pool(spark, n):
    return ids(spark, n).withColumn("run", F.lit(1))


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 6, 7, 8])
def test_groups_and_byes(spark, n):
    got = assignment.assign_groups(pool(spark, n), 4, 42, 1).collect()
    grouped = [r for r in got if r["grp"] is not None]
    assert len(grouped) == n - n % 4 and len(got) == n
    assert sorted((r["grp"], r["slot"]) for r in grouped) == [(i // 4 + 1, i % 4 + 1) for i in range(n - n % 4)]
    ragged = assignment.assign_groups(pool(spark, n), 4, 42, 1, leftover="ragged").collect()
    assert sorted((r["grp"], r["slot"]) for r in ragged) == [(i // 4 + 1, i % 4 + 1) for i in range(n)]


def test_order_depends_on_seed_and_round_only(spark):
    def order(n_parts, seed, round_no):
        rows = assignment.shuffled(pool(spark, 50).repartition(n_parts), seed, round_no).collect()
        return [r["id"] for r in sorted(rows, key=lambda r: r["idx"])]

    assert order(1, 1, 1) == order(9, 1, 1)
    assert len({tuple(order(2, s, r)) for s in (1, 2) for r in (1, 2)}) == 4
    assert sorted(order(2, 1, 1)) == list(range(50))


def test_batches(spark):
    got = assignment.assign_batches(pool(spark, 13), 10, 16, 42).collect()
    assert len(got) == 130 and max(r["batch"] for r in got) == 9
    assert sorted(r["idx"] for r in got) == list(range(130))
    assert sum(1 for r in got if r["batch"] == 9) == 130 - 8 * 16
    per_batch = {}
    for r in got:
        per_batch.setdefault(r["batch"], []).append(r["id"])
    assert any(len(set(v)) < len(v) for v in per_batch.values())  # an image may be twice in a grid


def test_copies_of_a_small_file_are_made_and_hashed_in_many_tasks(spark, tmp_path):
    # A pool of millions is one file of a few MB: one task made and hashed all its copies, each hash twice.
    pool(spark, 40).coalesce(1).write.parquet(str(tmp_path / "pool"))
    placed = assignment.assign_batches(spark.read.parquet(str(tmp_path / "pool")), 10, 16, 42)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    branches = plan.split("Generate explode(")[1:]
    # Places and counts per bucket: each makes the copies above a shuffle of the rows, and hashes a copy once.
    assert len(branches) == 2 and all("REPARTITION_BY_NUM" in b.split("FileScan")[0] for b in branches)
    assert plan.count("md5(") == 2
    assert sorted(r["idx"] for r in placed.collect()) == list(range(400))


@pytest.mark.parametrize("budget, size", [(None, 20), (12, 12), (3, 5), (100, 20)])
def test_subset(spark, budget, size):
    records = spark.range(20).select("id", (F.col("id") < 5).cast("int").alias("interesting"))
    rows = assignment.stratified_subset(records, budget, [44, 45]).collect()
    for run in (1, 2):
        mine = [r for r in rows if r["run"] == run]
        assert len(mine) == size and sum(r["interesting"] for r in mine) == 5
        assert sorted(r["index"] for r in mine) == list(range(size))
    if budget == 12:
        assert len({frozenset(r["id"] for r in rows if r["run"] == run) for run in (1, 2)}) == 2


def keep_low(groups):
    return judges.rule_judge(F.when(F.col("id") < 10, 1).otherwise(0))(groups)


def test_retention(spark):
    out = protocols.retention(ids(spark, 40), keep_low, size=4, stop=protocols.rounds(3), seed=1)
    scores = {r["id"]: r["imagescore"] for r in out.scores.collect()}
    assert len(scores) == 40 and all(scores[i] == 3 for i in range(10)) and max(scores.values()) == 3
    # 40 → 10; two of the 10 sit out as byes and stay.
    assert out.survivors.count() == 10 and out.rounds == {1: 3}
    assert out.log.filter("bye = 1 and kept = 0").count() == 0
    again = protocols.retention(ids(spark, 40).repartition(7), keep_low, size=4, stop=protocols.rounds(3), seed=1)
    assert sorted(map(tuple, again.log.select("round", "id", "grp", "slot").collect())) == sorted(
        map(tuple, out.log.select("round", "id", "grp", "slot").collect()))


def test_runs_go_through_one_job_each_with_its_seed(spark):
    items = assignment.with_runs(ids(spark, 24), [7, 8])
    both = protocols.retention(items, keep_low, size=4, stop=protocols.rounds(2))
    for run, seed in ((1, 7), (2, 8)):
        alone = protocols.retention(ids(spark, 24), keep_low, size=4, stop=protocols.rounds(2), seed=seed)
        want = {r["id"]: r["imagescore"] for r in alone.scores.collect()}
        assert {r["id"]: r["imagescore"] for r in both.scores.filter(F.col("run") == run).collect()} == want


def test_empty_round_ends_the_run(spark):
    out = protocols.retention(ids(spark, 8), judges.rule_judge(F.lit(0)), size=4, seed=1)
    assert out.survivors.count() == 0 and out.rounds == {1: 1} and out.scores.agg(F.max("imagescore")).first()[0] == 0
    none = protocols.retention(ids(spark, 0), keep_low, seed=1)
    assert none.scores.count() == 0 and none.rounds == {}


def fail_odd(groups):
    return judges.rule_judge(F.when(F.col("grp") % 2 == 0, F.lit(0)))(groups)


@pytest.mark.parametrize("policy, kept", [("keep", 4), ("drop", 0)])
def test_failed_groups(spark, policy, kept):
    out = protocols.retention(ids(spark, 8), fail_odd, size=4, stop=protocols.rounds(1), seed=1, on_failure=policy)
    assert out.survivors.count() == kept


def test_failure_can_raise(spark):
    with pytest.raises(protocols.ProtocolError, match="failed"):
        protocols.retention(ids(spark, 8), fail_odd, size=4, seed=1, on_failure="raise")


def test_judge_that_loses_images_is_caught(spark):
    with pytest.raises(tallies.IntegrityError, match="missing"):
        protocols.retention(ids(spark, 8), lambda g: keep_low(g.filter("slot > 1")), size=4, seed=1)
    with pytest.raises(tallies.IntegrityError, match="twice"):
        protocols.retention(ids(spark, 8), lambda g: keep_low(g.union(g)), size=4, seed=1)


def test_weak_stop(spark):
    most = judges.rule_judge(F.when(F.col("id") % 10 != 0, 1).otherwise(0))
    out = protocols.retention(ids(spark, 100), most, size=2, stop=protocols.weak(20, 5), seed=1, score="final")
    assert out.rounds == {1: 1} and out.scores.agg(F.sum("imagescore")).first()[0] == out.survivors.count() == 90


def test_exact_target(spark):
    none_low = judges.rule_judge(F.when(F.col("id") % 3 == 0, 1).otherwise(0))
    out = protocols.retention(ids(spark, 50), none_low, size=4, stop=protocols.target(40), seed=1, leftover="ragged", score="final")
    left = {r["id"] for r in out.survivors.collect()}
    assert len(left) == 40 and {i for i in range(50) if i % 3 == 0} <= left
    log = out.log.orderBy("idx").collect()
    assert {r["id"] for r in [r for r in log if r["kept"] == 0][:10]} == set(range(50)) - left
    with pytest.raises(protocols.ProtocolError, match="removed no image"):
        protocols.retention(ids(spark, 50), judges.rule_judge(F.lit(1)), stop=protocols.target(40), seed=1)
    with pytest.raises(protocols.ProtocolError, match="cannot be brought down"):
        protocols.retention(ids(spark, 5), keep_low, stop=protocols.target(40), seed=1)
    done = protocols.retention(ids(spark, 5), keep_low, stop=protocols.target(5), seed=1, score="final")
    assert done.survivors.count() == 5 and done.log.count() == 0


def strongest(groups):
    return judges.best_of_pair(F.col("id"))(groups)


@pytest.mark.parametrize("n, wins", [(1, 0), (2, 1), (5, 3), (8, 3), (9, 4)])
def test_elimination(spark, n, wins):
    out = protocols.elimination(ids(spark, n), strongest, seed=3)
    best = protocols.champion(out).first()
    assert best["id"] == n - 1 and best["imagescore"] == wins
    games = out.log.filter("bye = 0").count() // 2 if wins else 0
    assert games == n - 1


def test_power_of_two(spark):
    with pytest.raises(protocols.ProtocolError, match="power of two"):
        protocols.elimination(ids(spark, 6), strongest, seed=3, power_of_two=True)
    assert protocols.elimination(ids(spark, 4), strongest, seed=3, power_of_two=True).rounds == {1: 2}


def test_pair_without_single_winner(spark):
    both = judges.rule_judge(F.lit(1))
    with pytest.raises(protocols.ProtocolError, match="winner"):
        protocols.elimination(ids(spark, 4), both, seed=3)
    out = protocols.elimination(ids(spark, 5), both, seed=3, on_failure="drop")
    assert out.survivors.count() == 1 and out.log.filter("kept = 1").count() == 1  # only the bye is left


def test_grid(spark):
    grade = judges.rule_judge(F.when(F.col("id") == 1, 5).when(F.col("id") == 2, 9).when(F.col("id") == 3, 1), "score")
    out = protocols.rating_grid(ids(spark, 6), grade, side=4, views=10, seed=1)
    assert {r["id"]: r["imagescore"] for r in out.scores.collect()} == {0: 0, 1: 50, 2: 0, 3: 10, 4: 0, 5: 0}
    counted = protocols.rating_grid(ids(spark, 6), grade, side=3, views=10, seed=1, score="count")
    assert {r["id"]: r["imagescore"] for r in counted.scores.collect()}[1] == 10


def test_hybrid(spark):
    first, second, scores = protocols.hybrid(ids(spark, 40), keep_low, judges.rule_judge(F.lit(2), "score"), seed=1)
    got = {r["id"]: r["imagescore"] for r in scores.collect()}
    assert all(got[i] == 20 for i in range(10)) and sum(v > 0 for v in got.values()) == first.survivors.count() == 10


def test_judge_runs_once_and_a_named_run_goes_on(spark):
    calls = spark.sparkContext.accumulator(0)

    def call(group):
        calls.add(1)
        return group[["slot"]].assign(kept=[int(i % 2 == 0) for i in group["id"]], input_tokens=7, output_tokens=1)

    judge = judges.model_judge(call, ["id"])
    store = TableStore(spark, "named-run")
    out = protocols.retention(ids(spark, 18), judge, size=4, stop=protocols.rounds(1), seed=1, store=store)
    out.scores.count(), out.survivors.count(), out.log.count()
    assert calls.value == 4
    assert tallies.run_tokens(out.log).first()["input_tokens"] == 28
    again = protocols.retention(ids(spark, 18), judge, size=4, stop=protocols.rounds(1), seed=1, store=TableStore(spark, "named-run"))
    assert again.scores.count() == 18 and calls.value == 4
    store.drop()
    assert store.read("pool") is None


def test_model_judge_failure_keeps_the_group(spark):
    def call(group):
        if 3 in set(group["id"]):
            raise RuntimeError("no answer")
        return group[["slot"]].assign(kept=0)

    out = protocols.retention(ids(spark, 8), judges.model_judge(call, ["id"]), size=4, stop=protocols.rounds(1), seed=1)
    left = {r["id"] for r in out.survivors.collect()}
    assert len(left) == 4 and 3 in left and out.log.filter("failed = 1").count() == 4


def test_model_judge_for_grids(spark):
    def call(group):
        chosen = group[group["id"] == 2]
        return chosen[["slot"]].assign(score=4)

    out = protocols.rating_grid(ids(spark, 5), judges.model_judge(call, ["id"], "score"), side=2, views=3, seed=1)
    assert {r["id"]: r["imagescore"] for r in out.scores.collect()} == {0: 0, 1: 0, 2: 12, 3: 0, 4: 0}


def test_tokens_of_calls_that_select_nothing(spark):
    def call(group):
        chosen = group[group["id"] == 2]
        return chosen[["slot"]].assign(score=4), {"input_tokens": 7, "output_tokens": 1}

    out = protocols.rating_grid(ids(spark, 8), judges.model_judge(call, ["id"], "score"), side=2, views=1, seed=1)
    got = tallies.run_tokens(out.log).first()
    assert (got["input_tokens"], got["output_tokens"]) == (14, 2)
    assert sum(r["imagescore"] for r in out.scores.collect()) == 4


def test_valid_grades_and_last_judgment(spark):
    log = spark.createDataFrame([(0, 3), (17, 3), (1, 0), (16, 5), (2, 6), (3, None)], "slot int, score int")
    assert [tuple(r) for r in tallies.valid_grades(log).collect()] == [(16, 5)]
    log = spark.createDataFrame([(1, 1, 5, 0, 1), (1, 1, 5, 1, 2)], "run int, round int, id long, kept int, seq long")
    assert tallies.last_judgments(log).first()["kept"] == 1


def test_tokens_count_once_per_group(spark):
    log = spark.createDataFrame(
        [(1, 1, 1, 10, 1), (1, 1, 1, 10, 1), (1, 1, 2, 5, 2), (1, 2, 1, 3, 3)],
        "run int, round int, grp long, input_tokens long, output_tokens long")
    got = [(r["round"], r["input_tokens"], r["total_tokens"], r["cumulative_input_tokens"]) for r in
           tallies.tokens_by_round(log).orderBy("round").collect()]
    assert got == [(1, 15, 18, 15), (2, 3, 6, 18)]


def test_mean_over_runs(spark):
    rows = spark.createDataFrame([("a", 2, 4, 9.0), ("a", 1, 2, 8.0), ("b", 2, 1, 7.0)], "filename string, run int, imagescore int, SourceRA double")
    means = tallies.mean_over_runs(rows, coords=("SourceRA",))
    assert {r["filename"]: (r["avg_score"], r["n_runs"], r["SourceRA"]) for r in means.collect()} == {"a": (3.0, 2, 8.0), "b": (1.0, 1, 7.0)}
    assert tallies.run_audit(means, 2).first().asDict() == {"images": 2, "in_all_runs": 1}


def test_assembly(spark):
    scores = spark.createDataFrame([(1, 0), (2, 5), (3, 5)], "id long, imagescore long")
    why = spark.createDataFrame([(1, "no"), (2, "yes")], "id long, reasoning string")
    got = protocols.assemble(scores, None, why).collect()
    assert [(r["id"], r["reasoning"]) for r in got] == [(2, "yes"), (3, ""), (1, "")]


@pytest.mark.parametrize("name", sorted(protocols.PRESETS))
def test_presets(spark, name):
    items = spark.range(16).select("id", (F.col("id") < 3).cast("int").alias("interesting"))
    changes = {"seeds": [1]} | ({"target": 12} if "target" in protocols.PRESETS[name] else {}) | ({"rounds": 1} if "rounds" in protocols.PRESETS[name] else {})
    kind = protocols.PRESETS[name]["protocol"]
    grade = lambda g: judges.rule_judge(F.lit(1), "score")(g)
    judge = {"elimination": strongest, "rating_grid": grade}.get(kind, keep_low)
    out = protocols.run_preset(name, items, judge, grade, **changes)
    scores = out[2] if kind == "hybrid" else out.scores
    assert scores.count() == 16 and scores.agg(F.max("imagescore")).first()[0] > 0


def test_ledger_keeps_answers_of_a_broken_round(spark, tmp_path):
    (tmp_path / "calls").mkdir()

    def call(group):
        first = group["id"].min()
        (tmp_path / "calls" / f"{first}-{len(list((tmp_path / 'calls').glob(f'{first}-*')))}").touch()
        if 3 in set(group["id"]) and not (tmp_path / "mended").exists():
            raise KeyError("a fault of the program")
        return group[["slot"]].assign(kept=[int(i % 2 == 0) for i in group["id"]], input_tokens=7, output_tokens=1)

    ledger = judges.CallLedger(f"file:{tmp_path}/ledger")
    play = lambda: protocols.retention(ids(spark, 40), judges.model_judge(call, ["id"], ledger=ledger), size=4, stop=protocols.rounds(1), seed=1)
    with pytest.raises(Exception, match="a fault of the program"):
        play()
    written = list((tmp_path / "ledger").rglob("[0-9]*.parquet"))
    (tmp_path / "mended").touch()
    out = play()
    assert {r["id"] for r in out.survivors.collect()} == set(range(0, 40, 2))
    assert tallies.run_tokens(out.log).first()["input_tokens"] == 70
    seen = [p.name.split("-")[0] for p in (tmp_path / "calls").iterdir()]
    assert len(set(seen)) == 10 and len(written) < 10
    # Only the group that broke, and calls that had not been answered when the job ended, are made again.
    assert len(seen) <= 10 + (10 - len(written))
    play()
    assert len(list((tmp_path / "calls").iterdir())) == len(seen)
