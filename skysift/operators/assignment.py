"""Seeded sampling and the assignment of images to groups, pairs and grids.

Every order is by a hash of (seed, round, id), so it does not depend on how the
data is partitioned and a lost task gives the same rows again. All runs go
through one job: `run` is part of every key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.operators.ordering import hash_bucket, hash_key, positions


def shuffled(
    df: DataFrame, seed: Column | int, round: Column | int = 0, *, keys: list[str] = ("run",), id_col: str = "id",
    copy: str | None = None, out: str = "idx", total: str | None = None,
) -> DataFrame:
    """Add each row's exact place in a seeded random order of its run."""
    parts = [seed, round, id_col] + ([copy] if copy else [])
    keyed = df.withColumn("_key", hash_key(*parts))
    order = [F.col("_key"), F.col(id_col)] + ([F.col(copy)] if copy else [])
    # A hash of text is never null. Said here, Spark need not work it out once more to ask.
    bucket = F.coalesce(hash_bucket("_key"), F.lit(0))
    return positions(keyed, list(keys), bucket, order, out, total).drop("_key")


def with_runs(df: DataFrame, seeds: list[int]) -> DataFrame:
    """One copy of the rows per seed: run 1, 2, … with its seed."""
    runs = F.array(*[F.struct(F.lit(i).alias("run"), F.lit(s).alias("seed")) for i, s in enumerate(seeds, 1)])
    return df.withColumn("_r", F.explode(runs)).select("_r.run", "_r.seed", *df.columns)


def stratified_subset(
    records: DataFrame, budget: int | None, seeds: list[int], *, id_col: str = "id", positive: str = "interesting"
) -> DataFrame:
    """Per seed, all positives and random negatives up to the budget, indexed in random order."""
    runs = with_runs(records, seeds)
    if budget is not None:
        is_pos = F.col(positive).cast("int") == 1
        kinds = runs.withColumn("_kind", F.when(is_pos, 1).otherwise(0))
        # Negatives are taken by another order than the final one. Counts per bucket of that order tell
        # in which bucket the last one taken lies; rows beyond it are left out before any is placed.
        kinds = kinds.withColumn("_cut", hash_bucket(hash_key(F.col("seed"), -1, id_col)))
        sizes = kinds.groupBy("run", "_cut").agg(F.sum("_kind").alias("_p"), F.sum(1 - F.col("_kind")).alias("_n"))
        whole = Window.partitionBy("run")
        before = whole.orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.select("run", "_cut", F.sum("_p").over(whole).alias("_pos"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        reach = sizes.groupBy("run").agg(F.first("_pos").alias("_pos"), F.max(F.when(F.col("_before") < F.lit(budget) - F.col("_pos"), F.col("_cut"))).alias("_last"))
        near = kinds.join(reach, "run").filter((F.col("_kind") == 1) | (F.col("_cut") <= F.col("_last")))
        positives = near.filter("_kind = 1")
        placed = shuffled(near.filter("_kind = 0"), F.col("seed"), -1, id_col=id_col, out="_place")
        taken = placed.filter(F.col("_place") < F.lit(budget) - F.col("_pos")).drop("_place")
        runs = positives.unionByName(taken).drop("_kind", "_cut", "_pos", "_last")
    return shuffled(runs, F.col("seed"), 0, id_col=id_col, out="index")


def assign_groups(
    pool: DataFrame, size: int, seed: Column | int, round: Column | int, *, leftover: str = "bye", id_col: str = "id"
) -> DataFrame:
    """Groups of `size` in a seeded order: grp and slot from 1.

    bye: the rows past the last full group get grp null. ragged: they form a
    smaller last group.
    """
    if leftover not in ("bye", "ragged"):
        raise ValueError(f"unknown leftover rule {leftover!r}")
    placed = shuffled(pool, seed, round, id_col=id_col, total="_n")
    grp, slot = F.floor(F.col("idx") / size) + 1, F.col("idx") % size + 1
    if leftover == "bye":
        full = F.col("idx") < F.col("_n") - F.col("_n") % size
        grp, slot = F.when(full, grp), F.when(full, slot)
    return placed.withColumn("grp", grp.cast("bigint")).withColumn("slot", slot.cast("int")).drop("_n")


def assign_pairs(pool: DataFrame, seed: Column | int, round: Column | int, *, id_col: str = "id") -> DataFrame:
    """Pairs with at most one bye."""
    return assign_groups(pool, 2, seed, round, id_col=id_col)


def assign_batches(pool: DataFrame, copies: int, size: int, seed: Column | int, *, id_col: str = "id") -> DataFrame:
    """`copies` of each row shuffled together and cut into batches; the last may be short.

    One image can be twice in a batch. Give it ids only: it multiplies the rows.
    """
    # The rows are dealt over all tasks before they are multiplied and hashed: a pool of millions is a
    # file of a few MB, which one task would read.
    parts = int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = pool.repartition(parts, "run", id_col)
    many = spread.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    placed = shuffled(many, seed, 0, id_col=id_col, copy="copy")
    return placed.withColumn("batch", (F.floor(F.col("idx") / size) + 1).cast("bigint")).withColumn(
        "slot", (F.col("idx") % size + 1).cast("int")
    )


def fixed_slice(df: DataFrame, n: int, *, id_col: str = "id") -> DataFrame:
    """The first n rows by id."""
    return df.orderBy(id_col).limit(n)
