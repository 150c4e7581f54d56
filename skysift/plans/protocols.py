"""Scoring protocols: tournaments, eliminations, rating grids and their hybrid.

Only the loop over rounds runs on the driver, and only counts per run come to
it. Each round is one job for all runs that are still going; its decisions are
written before they are used, which fixes what the judge said, cuts lineage and
is the judgment log.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.operators.assignment import assign_batches, assign_groups, fixed_slice, stratified_subset, with_runs
from skysift.operators.ordering import positions
from skysift.operators.tallies import IntegrityError, require_integrity, rounds_survived, valid_grades
from skysift.plans.judges import GROUP, Judge, with_tokens
from skysift.session import TableStore

# Settings of the usual protocols.
RETENTION_ROUNDS, RETENTION_SIZE = 10, 4
GRID_SIDE, GRID_VIEWS = 4, 10
WEAK_REMOVED, WEAK_ROUNDS = 20, 2
TARGET_LEFT = 100


# The published settings, by data set. Keys are arguments of the protocol named.
PRESETS = {
    "pilot_likert": {"protocol": "rating_grid", "side": 4, "views": 10, "seeds": [44, 45, 46], "budget": 20_000},
    "pilot_tournament": {"protocol": "retention", "size": 4, "rounds": 10, "seeds": [44, 45, 46], "budget": 20_000},
    "pilot_elimination": {"protocol": "elimination", "seeds": [44, 45, 46], "budget": 20_000},
    "pilot_hybrid": {"protocol": "hybrid", "size": 4, "side": 4, "views": 10, "seeds": [44, 45, 46], "budget": 20_000},
    "volunteer_selection": {"protocol": "rating_grid", "side": 3, "views": 10, "score": "count", "seeds": [42], "slice": 1000},
    "volunteer_grid": {"protocol": "rating_grid", "side": 3, "views": 10, "seeds": [42], "slice": 1000},
    "volunteer_large_grid": {"protocol": "rating_grid", "side": 4, "views": 10, "seeds": [42], "slice": 1000},
    "volunteer_elimination": {"protocol": "elimination", "power_of_two": True, "seeds": [42], "slice": 1024},
    "volunteer_filter": {"protocol": "retention", "size": 2, "min_removed": 20, "rounds": 2, "score": "final", "seeds": [42], "slice": 1000},
    "expert_grid": {"protocol": "rating_grid", "side": 4, "views": 10, "seeds": [42, 42, 42]},
    "expert_tournament": {"protocol": "retention", "size": 2, "rounds": 10, "seeds": [42, 42, 42]},
    "expert_elimination": {"protocol": "elimination", "seeds": [42, 42, 42]},
    "regression_filter": {"protocol": "retention", "size": 4, "target": 100, "leftover": "ragged", "score": "final", "seeds": [42]},
}


class ProtocolError(RuntimeError):
    """A protocol cannot go on or does not reach its aim."""


@dataclass
class Stop:
    """When a run ends: after `rounds`, on a round that removes fewer than `min_removed`, or at `target` left."""

    rounds: int | None = None
    min_removed: int | None = None
    target: int | None = None
    min_left: int = 1

    def over(self, round_no: int, before: int, after: int) -> bool:
        if self.target is not None:
            return after == self.target
        if after < self.min_left or (self.rounds is not None and round_no >= self.rounds):
            return True
        return self.min_removed is not None and before - after < self.min_removed

    def starts(self, n: int) -> bool:
        if self.target is not None:
            if n < self.target:
                raise ProtocolError(f"{n} images cannot be brought down to {self.target}")
            return n > self.target
        return n >= self.min_left and self.rounds != 0


def rounds(n: int = RETENTION_ROUNDS) -> Stop:
    return Stop(rounds=n)


def weak(min_removed: int = WEAK_REMOVED, max_rounds: int | None = WEAK_ROUNDS) -> Stop:
    return Stop(rounds=max_rounds, min_removed=min_removed, min_left=2)


def target(left: int = TARGET_LEFT) -> Stop:
    return Stop(target=left)


@dataclass
class Outcome:
    """Scores of all images, the judgment log, the images left, and rounds played per run."""

    scores: DataFrame
    log: DataFrame
    survivors: DataFrame
    rounds: dict


def _start(items: DataFrame, seed: int | None, columns: list[str], id_col: str) -> DataFrame:
    """run, seed, id and the columns the judge reads."""
    run = F.col("run") if "run" in items.columns else F.lit(1)
    seeds = F.lit(seed) if seed is not None else F.col("seed")
    return items.select(run.cast("int").alias("run"), seeds.cast("int").alias("seed"),
                        F.col(id_col).alias("id"), *columns)


def _checksum(condition: Column | None = None) -> Column:
    """Order-free sum that tells whether two sets of ids are the same."""
    h = F.xxhash64("id").cast("decimal(20,0)")
    return F.sum(h if condition is None else F.when(condition, h))


def _pool_counts(pool: DataFrame) -> dict:
    rows = pool.groupBy("run").agg(F.count("*").alias("n"), _checksum().alias("sum")).collect()
    return {r["run"]: (r["n"], r["sum"]) for r in rows}


@dataclass
class _Round:
    table: DataFrame
    stats: dict


def _play(
    pool: DataFrame, live: dict, judge: Judge, size: int, round_no: int, leftover: str, store: TableStore, failed: Column
) -> _Round:
    """Assign, judge, write and check one round."""
    name = f"log/round={round_no}"

    def make() -> DataFrame:
        groups = assign_groups(pool, size, F.col("seed"), round_no, leftover=leftover).withColumn(
            "round", F.lit(round_no)
        )
        judged = with_tokens(judge(groups))
        bye = F.col("grp").isNull()
        cols = [*pool.columns, "idx", "grp", "slot", "input_tokens", "output_tokens"]
        return judged.select(
            *cols,
            F.when(bye, 1).otherwise(F.coalesce(F.col("kept").cast("int"), failed)).alias("kept"),
            F.when(bye, 1).otherwise(0).alias("bye"),
            F.when(~bye & F.col("kept").isNull(), 1).otherwise(0).alias("failed"),
        )

    table = store.write_once(name, make)
    kept = F.col("kept") == 1
    rows = table.groupBy("run").agg(
        F.count("*").alias("n"), _checksum().alias("sum"), F.count(F.when(kept, 1)).alias("kept"),
        _checksum(kept).alias("kept_sum"), F.sum("failed").alias("failed"),
    ).collect()
    stats = {r["run"]: r for r in rows}
    for run, (n, total) in live.items():
        r = stats.get(run)
        if (r["n"], r["sum"]) != (n, total) if r else n > 0:
            require_integrity(pool, table)
            raise IntegrityError(f"round {round_no} of run {run}: an image was judged twice")
    return _Round(table, stats)



def _failure_value(on_failure: str) -> Column:
    if on_failure not in ("keep", "drop", "raise"):
        raise ValueError(f"unknown failure policy {on_failure!r}")
    return F.lit(1 if on_failure == "keep" else 0)


def _log(store: TableStore, played: int, like: DataFrame, spark) -> DataFrame:
    if not played:
        empty = like.withColumn("idx", F.lit(0).cast("bigint"))
        for c, t in (("grp", "bigint"), ("slot", "int"), ("kept", "int"), ("input_tokens", "bigint"),
                     ("output_tokens", "bigint"), ("bye", "int"), ("failed", "int"), ("round", "int")):
            empty = empty.withColumn(c, F.lit(0).cast(t))
        return empty.limit(0)
    return spark.read.parquet(store.path("log"))


def retention(
    items: DataFrame,
    judge: Judge,
    *,
    size: int = RETENTION_SIZE,
    stop: Stop | None = None,
    seed: int | None = None,
    on_failure: str = "keep",
    leftover: str = "bye",
    score: str = "rounds",
    columns: list[str] = (),
    id_col: str = "id",
    store: TableStore | None = None,
) -> Outcome:
    """Rounds of keep-or-reject groups.

    Items hold the id, optionally run and seed, and the `columns` the judge
    reads, which should be narrow. score: "rounds" survived, or "final" for 1 in
    the last pool and 0 elsewhere. A target stop applies only the first
    rejections of the last round, in round order, that reach it exactly.
    """
    stop = stop or rounds()
    failed = _failure_value(on_failure)
    spark = items.sparkSession
    store = store or TableStore(spark)
    start = _start(items, seed, list(columns), id_col)
    pool = store.write_once("pool", lambda: start)
    live = {run: c for run, c in _pool_counts(pool).items() if stop.starts(c[0])}
    finished = [pool.filter(~F.col("run").isin(list(live)))]
    active, played, round_no = pool.filter(F.col("run").isin(list(live))), {}, 0
    while live:
        round_no += 1
        done = _play(active, live, judge, size, round_no, leftover, store, failed)
        if on_failure == "raise" and any(r["failed"] for r in done.stats.values()):
            raise ProtocolError(f"round {round_no}: the judge failed on a group")
        kept = done.table.filter(F.col("kept") == 1)
        after = {run: (r["kept"], r["kept_sum"]) for run, r in done.stats.items()}
        if stop.target is not None:
            kept, after = _trim(done, kept, after, live, stop.target, round_no, store)
        kept = kept.select(*pool.columns)
        ended = [run for run, (n, _) in live.items() if stop.over(round_no, n, after[run][0])]
        for run in live:
            played[run] = round_no
        finished.append(kept.filter(F.col("run").isin(ended)))
        live = {run: after[run] for run in live if run not in ended}
        active = kept.filter(F.col("run").isin(list(live)))
    survivors = reduce(DataFrame.unionByName, finished)
    log = _log(store, round_no, start, spark)
    won = rounds_survived(log) if score == "rounds" else survivors.select("run", "id", F.lit(1).alias("imagescore"))
    scores = pool.select("run", "id").join(won, ["run", "id"], "left").fillna(0, ["imagescore"])
    return Outcome(scores, log, survivors.select("run", "id"), played)


def _trim(done: _Round, kept: DataFrame, after: dict, live: dict, left: int, round_no: int, store: TableStore):
    """Keep rejected images beyond the removals that reach the target."""
    over = {}
    for run, (n, _) in live.items():
        removed = n - after[run][0]
        if removed == 0:
            raise ProtocolError(f"round {round_no} of run {run} removed no image with {n} left, {left} wanted")
        if after[run][0] < left:
            over[run] = n - left
    if not over:
        return kept, after
    out = done.table.filter((F.col("kept") == 0) & F.col("run").isin(list(over)))
    # Places follow the round order; buckets of it keep a large round in many tasks.
    ranked = positions(out, ["run"], F.shiftright("idx", 20), [F.col("idx")], "_place")
    quota = F.coalesce(*[F.when(F.col("run") == run, F.lit(n)) for run, n in over.items()])
    spared = ranked.filter(F.col("_place") >= quota).drop("_place")
    pool = store.write(kept.select(*done.table.columns).unionByName(spared.select(*done.table.columns)), f"trim{round_no}")
    return pool, {run: c for run, c in after.items() if run not in over} | {
        run: c for run, c in _pool_counts(pool).items() if run in over
    }


def elimination(
    items: DataFrame,
    judge: Judge,
    *,
    seed: int | None = None,
    power_of_two: bool = False,
    on_failure: str = "raise",
    columns: list[str] = (),
    id_col: str = "id",
    store: TableStore | None = None,
) -> Outcome:
    """Pairs with one winner each, a bye counting as a win, until one image is left.

    on_failure "raise" stops on a pair without exactly one winner; "drop" lets
    such a pair vanish.
    """
    if on_failure not in ("raise", "drop"):
        raise ValueError("elimination can only raise or drop on failure")
    spark = items.sparkSession
    store = store or TableStore(spark)
    start = _start(items, seed, list(columns), id_col)
    pool = store.write_once("pool", lambda: start)
    counts = _pool_counts(pool)
    if power_of_two and any(n & (n - 1) for n, _ in counts.values()):
        raise ProtocolError("the number of images must be a power of two")
    live = {run: c for run, c in counts.items() if c[0] > 1}
    finished = [pool.filter(~F.col("run").isin(list(live)))]
    active, played, round_no = pool.filter(F.col("run").isin(list(live))), {}, 0
    while live:
        round_no += 1
        done = _play(active, live, _one_winner(judge), 2, round_no, "bye", store, F.lit(0))
        after = {run: (r["kept"], r["kept_sum"]) for run, r in done.stats.items()}
        if on_failure == "raise":
            for run, (n, _) in live.items():
                if after[run][0] != (n + 1) // 2:
                    raise ProtocolError(f"round {round_no} of run {run}: a pair has no single winner")
        kept = done.table.filter(F.col("kept") == 1).select(*pool.columns)
        ended = [run for run in live if after[run][0] <= 1]
        for run in live:
            played[run] = round_no
        finished.append(kept.filter(F.col("run").isin(ended)))
        live = {run: after[run] for run in live if run not in ended}
        active = kept.filter(F.col("run").isin(list(live)))
    survivors = reduce(DataFrame.unionByName, finished).select("run", "id")
    log = _log(store, round_no, start, spark)
    scores = pool.select("run", "id").join(rounds_survived(log), ["run", "id"], "left").fillna(0, ["imagescore"])
    return Outcome(scores, log, survivors, played)


def _one_winner(judge: Judge) -> Judge:
    """Void the decisions of a pair that does not have exactly one winner."""

    def checked(groups: DataFrame) -> DataFrame:
        judged = with_tokens(judge(groups))
        kept = F.coalesce(F.col("kept").cast("int"), F.lit(0))
        wins = F.sum(kept).over(Window.partitionBy(*GROUP))
        return judged.withColumn("kept", F.when(wins == 1, kept))

    return checked


def champion(outcome: Outcome) -> DataFrame:
    """The last image of each run with its score."""
    return outcome.survivors.join(outcome.scores, ["run", "id"])


def rating_grid(
    items: DataFrame,
    judge: Judge,
    *,
    side: int = GRID_SIDE,
    views: int = GRID_VIEWS,
    score: str = "sum",
    seed: int | None = None,
    columns: list[str] = (),
    id_col: str = "id",
    store: TableStore | None = None,
) -> Outcome:
    """Every image shown `views` times in random grids and graded 1-5 when selected.

    score: "sum" of grades or "count" of selections. Grades out of range and
    failed calls give no rows.
    """
    if score not in ("sum", "count"):
        raise ValueError(f"unknown score {score!r}")
    spark = items.sparkSession
    store = store or TableStore(spark)
    pool = store.write_once("pool", lambda: _start(items, seed, list(columns), id_col))

    def make() -> DataFrame:
        batches = assign_batches(pool, views, side * side, F.col("seed")).withColumnRenamed("batch", "grp")
        judged = with_tokens(judge(batches.withColumn("round", F.lit(1))))
        extra = ["reasoning"] if "reasoning" in judged.columns else []
        return judged.select("run", "round", "grp", "slot", "id", "idx", "score", *extra, "input_tokens", "output_tokens")

    log = store.write_once("grid", make)
    graded = valid_grades(log, side * side) if score == "sum" else log.filter(F.col("score") > 0)
    value = F.sum("score") if score == "sum" else F.count("*")
    sums = graded.groupBy("run", "id").agg(value.cast("bigint").alias("imagescore"))
    scores = pool.select("run", "id").join(sums, ["run", "id"], "left").fillna(0, ["imagescore"])
    return Outcome(scores, log, pool.select("run", "id"), {})


def hybrid(
    items: DataFrame,
    judge1: Judge,
    judge2: Judge,
    *,
    size: int = RETENTION_SIZE,
    side: int = GRID_SIDE,
    views: int = GRID_VIEWS,
    seed: int | None = None,
    on_failure: str = "keep",
    columns: list[str] = (),
    id_col: str = "id",
    store: TableStore | None = None,
) -> tuple[Outcome, Outcome, DataFrame]:
    """One retention round, then a rating grid over its survivors; eliminated images score 0."""
    first = retention(items, judge1, size=size, stop=rounds(1), seed=seed, on_failure=on_failure,
                      columns=columns, id_col=id_col, store=store)
    start = _start(items, seed, list(columns), id_col)
    left = start.join(first.survivors, ["run", "id"], "left_semi")
    second = rating_grid(left, judge2, side=side, views=views, columns=columns, store=store)
    scores = start.select("run", "id").join(second.scores, ["run", "id"], "left").fillna(0, ["imagescore"])
    return first, second, scores


def assemble(
    scores: DataFrame, meta: DataFrame | None = None, reasoning: DataFrame | None = None, *, key: str = "id",
    order: bool = True,
) -> DataFrame:
    """Result rows: score, reasoning where the score is positive, metadata; best first, then by id."""
    out = scores
    if reasoning is not None:
        keys = [c for c in ("run", key) if c in reasoning.columns and c in scores.columns]
        out = out.join(reasoning, keys, "left").withColumn(
            "reasoning", F.when(F.col("imagescore") > 0, F.coalesce("reasoning", F.lit(""))).otherwise("")
        )
    if meta is not None:
        out = out.join(meta, key, "left")
    return out.orderBy(F.col("imagescore").desc(), key) if order else out


def run_preset(name: str, items: DataFrame, judge: Judge, judge2: Judge | None = None, **changes):
    """A published setting on items with id (and interesting, where a budget applies)."""
    p = {**PRESETS[name], **changes}
    kind, seeds = p.pop("protocol"), p.pop("seeds")
    n, budget = p.pop("slice", None), p.pop("budget", None)
    if n is not None:
        items = fixed_slice(items, n)
    if budget is not None:
        items = stratified_subset(items, budget, seeds)
    else:
        items = with_runs(items, seeds)
    if kind == "retention":
        stop = Stop(rounds=p.pop("rounds", None), min_removed=p.pop("min_removed", None), target=p.pop("target", None))
        return retention(items, judge, stop=stop, **p)
    if kind == "elimination":
        return elimination(items, judge, **p)
    if kind == "hybrid":
        return hybrid(items, judge, judge2, **p)
    return rating_grid(items, judge, **p)
