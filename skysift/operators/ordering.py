"""Running totals, positions, quantiles and picks that hold for hot groups.

A window over a whole group puts that group in one task. Here a group is cut
into buckets that follow the sort order; totals per bucket are aggregated before
they are shuffled, and the window over a whole group sees one row per bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Buckets of a 60-bit hash: enough that each holds a few million of 10^10 rows.
HASH_BUCKET_BITS = 12

# Buckets of equal width between the ends of a column whose quantiles are sought.
EVEN_BUCKETS = 4096


def hash_key(*parts: Column | str | int) -> Column:
    """60-bit number from the md5 of the parts joined by '-': a seeded, portable shuffle key."""
    cols = [F.lit(p) if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p) for p in parts]
    text = F.concat_ws("-", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def hash_bucket(key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.shiftright(key, 60 - HASH_BUCKET_BITS)


def score_bucket(score: Column | str, per_e: int = 1024) -> Column:
    """Bucket that never falls as the score rises; about `per_e` per factor of e."""
    score = (F.col(score) if isinstance(score, str) else score).cast("double")
    size = F.log1p(F.least(F.abs(score), F.lit(1e300)))
    return F.floor(F.signum(score) * size * per_e).cast("bigint")


def score_buckets(score: Column | str) -> list[Column]:
    """Ever finer buckets of falling scores, 1024 of each in one of the last, for scores crowded in a narrow range."""
    fine = -score_bucket(score, 1024 * 1024)
    return [F.shiftright(fine, 10), fine]


def running(
    df: DataFrame,
    keys: list[str],
    bucket: Column | list[Column],
    order: list[Column],
    sums: dict[str, str],
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Add inclusive running sums (`out -> column`) per key in `order`, and key totals.

    `bucket` must not fall along `order`; a list holds ever finer buckets, each inside
    the one before it. Rows equal under `order` are summed in an arbitrary order, so it
    should be total. Keys must not be null.
    """
    totals = totals or {}
    wanted = sorted({*sums.values(), *totals.values()})
    buckets = bucket if isinstance(bucket, list) else [bucket]
    names = [f"_bucket{i}" for i in range(len(buckets))]
    # The join below asks for keys that are not null. Asked for here, the filter is the same on
    # both sides of it, so that both read one and the same shuffle of df.
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in [*keys, *names]])
    tagged = df.withColumns(dict(zip(names, buckets, strict=True))).filter(present)
    # The finest bucket stands first: Spark sorts by 8 bytes of the first column, and keys are often few.
    groups = [*names[::-1], *keys]
    within = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)

    sizes = tagged.groupBy(*keys, *names).agg(*[F.sum(c).alias(f"_sum_{c}") for c in wanted])
    offsets = _offsets(sizes, keys, names, sums, totals)
    local = tagged.select("*", *[F.sum(c).over(within).alias(f"_run_{o}") for o, c in sums.items()])
    joined = local.join(offsets, groups)
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[(F.col(f"_run_{o}") + F.col(f"_off_{o}")).alias(o) for o in sums],
        *[F.col(f"_tot_{o}").alias(o) for o in totals],
    )


def _offsets(sizes: DataFrame, keys: list[str], names: list[str], sums: dict[str, str], totals: dict[str, str]) -> DataFrame:
    """Sums of all that comes before each bucket (_off_) and of its whole key (_tot_).

    A window sees the finer buckets of one coarser bucket, or the coarsest ones of a key.
    """
    outer = [*keys, *names[:-1]]
    before = Window.partitionBy(*outer).orderBy(names[-1]).rowsBetween(Window.unboundedPreceding, -1)
    offs = {o: F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)) for o, c in sums.items()}
    if len(names) == 1:
        whole = Window.partitionBy(*outer)
        return sizes.select(*outer, names[-1], *[c.alias(f"_off_{o}") for o, c in offs.items()],
                            *[F.sum(f"_sum_{c}").over(whole).alias(f"_tot_{o}") for o, c in totals.items()])
    wanted = sorted({*sums.values(), *totals.values()})
    coarser = sizes.groupBy(*outer).agg(*[F.sum(f"_sum_{c}").alias(f"_sum_{c}") for c in wanted])
    base = _offsets(coarser, keys, names[:-1], sums, totals)
    base = base.withColumnsRenamed({f"_off_{o}": f"_base_{o}" for o in sums})
    inner = sizes.select(*outer, names[-1], *[c.alias(f"_in_{o}") for o, c in offs.items()])
    return inner.join(base, outer).select(
        *outer, names[-1], *[(F.col(f"_in_{o}") + F.col(f"_base_{o}")).alias(f"_off_{o}") for o in sums],
        *[f"_tot_{o}" for o in totals],
    )


def positions(
    df: DataFrame,
    keys: list[str],
    bucket: Column,
    order: list[Column],
    out: str = "idx",
    total: str | None = None,
) -> DataFrame:
    """Exact 0-based position of each row within its key, and optionally the key's size."""
    ones = df.withColumn("_one", F.lit(1).cast("bigint"))
    ranked = running(ones, keys, bucket, order, {out: "_one"}, {total: "_one"} if total else None)
    return ranked.withColumn(out, F.col(out) - 1).drop("_one")


def first_in(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key. Spark limits each task's share of a group before the shuffle."""
    return top_in(df, keys, order, 1).drop("_rank")


def top_in(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str = "_rank") -> DataFrame:
    """First n rows per key with their 1-based rank; n is a small feature size."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= n)


def exact_quantiles(df: DataFrame, keys: list[str], col: str, wanted: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per key.

    The built-in exact percentile holds all distinct values of a group in one
    task; this one sorts them in buckets.
    """
    values = df.filter(F.col(col).isNotNull()).groupBy(*keys, F.col(col).alias("_v")).agg(F.count("*").alias("_n"))
    ends = values.groupBy(*keys).agg(F.min("_v").cast("double").alias("_min"), F.max("_v").cast("double").alias("_max"))
    # Buckets of equal width and buckets of equal ratio both follow the order, so their pair does:
    # one splits values crowded far from 0, the other a long tail.
    width = F.nullif(F.col("_max") - F.col("_min"), F.lit(0.0))
    even = F.coalesce(F.floor((F.col("_v") - F.col("_min")) / width * EVEN_BUCKETS), F.lit(0)).cast("bigint")
    placed = values.join(ends, keys)
    ranked = running(placed, keys, F.struct(even.alias("even"), score_bucket("_v").alias("ratio")), [F.col("_v")],
                     {"_upto": "_n"}, {"_all": "_n"})

    def value_at(place: Column) -> Column:
        inside = (F.col("_upto") - F.col("_n") <= place) & (place < F.col("_upto"))
        return F.max(F.when(inside, F.col("_v").cast("double")))

    picks, outs = [], []
    for name, q in wanted.items():
        place = (F.col("_all") - 1) * F.lit(q)
        picks += [
            value_at(F.floor(place)).alias(f"_lo_{name}"),
            value_at(F.ceil(place)).alias(f"_hi_{name}"),
            F.max(place - F.floor(place)).alias(f"_part_{name}"),
        ]
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        outs.append((low + (high - low) * F.col(f"_part_{name}")).alias(name))
    return ranked.groupBy(*keys).agg(*picks).select(*keys, *outs)


def stacked(frames: list[DataFrame]) -> DataFrame:
    """Union by name, absent columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
