"""Mixing sources to target weights by Sainte-Laguë apportionment.

Words are counted once per document. Sources share a budget by weight, no one
above `most` times its own words. The budget is cut into blocks of equal size,
which go to sources by highest quotients of their targets, and in each source to
its shards by highest quotients of their words. In a shard, documents lie end to
end in seeded order; its quota is a number of whole rounds over all its blocks
and one run of blocks, around the end if need be, from a seeded start. What a
document gives is the overlap of its stretch with that run, so blocks are never
made one by one, and only the two documents at the ends of a run are cut.

Only ids, hashes and sizes are shuffled. Shards are cut by a hash, in number by
the words of their source, so a source that holds a third of all rows is spread.

Defined results: a null or empty text has size 0 and gives 0; null is a source
of its own, the last; repeated rows are documents of their own; with no words
all targets are 0; an empty table gives no rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.session import TableStore

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
# Words of a block. Small, so that the quota of a small source comes near its target; blocks of a run are adjacent.
BLOCK_WORDS = 16
# Words of a shard, and the most shards of one source; only narrow rows are sorted in a shard, millions fit.
SHARD_WORDS = 1 << 15
SHARDS = 4096


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Add `target` to rows (source, source_size): the budget by weight, the excess over the caps shared anew.

    Sources by code point, null last, take the weights in turn. Sorted by cap per
    unit of weight, the capped sources come first; the first source that stays
    below its cap when all before it are capped sets the level for the rest.
    """
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source"))
    at = F.row_number().over(ordered) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (at % len(weights) + 1).cast("int")).cast("double")
    cap = (F.col("source_size") * most).cast("double")
    ranked = sizes.withColumn("_w", weight).withColumn("_cap", cap).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    before = Window.orderBy("_ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    level = left / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    levels = ranked.withColumn("_level", level)
    settled = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(whole)["_level"]
    levels = levels.withColumn("_level", settled)
    return levels.select("source", "source_size", F.least("_cap", F.col("_level") * F.col("_w")).alias("target"))


def apportion(rows: DataFrame, group: list[str], votes: str, cap: str, seats: str) -> DataFrame:
    """Sainte-Laguë: add `quota`, the seats that each row wins of its group's `seats`, at most `cap`.

    A row's q-th seat has the quotient votes / (2q + 1). All seats that are sure
    are given at once: with n rows and S seats no row's quota differs from its
    exact share by more than share * n / 2S + 1, so only that band of quotients is
    ranked, which has some 3 rows for each row of the group.
    """
    g = Window.partitionBy(*group) if group else Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = rows.withColumn("_votes", F.sum(votes).over(g)).withColumn("_n", F.count("*").over(g))
    exact = F.coalesce(F.col(votes) / F.nullif(F.col("_votes"), F.lit(0.0)) * F.col(seats), F.lit(0.0))
    band = F.ceil(exact * F.col("_n") / (2 * F.greatest(F.col(seats), F.lit(1)))) + 1
    near = sums.withColumn("_low", F.least(F.greatest(F.floor(exact) - band, F.lit(0)), F.col(cap)).cast("long")).withColumn(
        "_high", F.least(F.floor(exact) + band + 1, F.col(cap)).cast("long"))
    near = near.withColumn("_sure", F.sum("_low").over(g))
    quotas = near.withColumn("_q", F.explode(F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low"), F.col("_high") - 1)).otherwise(F.array(F.lit(-1).cast("long")))))
    quotient = F.when(F.col("_q") >= 0, F.col(votes) / (2 * F.col("_q") + 1)).otherwise(F.lit(-1.0))
    keys = [c for c in rows.columns if c not in group]
    best = Window.partitionBy(*group).orderBy(F.desc("_quotient"), *[F.asc(k) for k in keys], "_q")
    won = quotas.withColumn("_quotient", quotient).withColumn("_rank", F.row_number().over(best))
    mine = (F.col("_q") >= 0) & (F.col(votes) > 0) & (F.col("_rank") <= F.col(seats) - F.col("_sure"))
    same = [*[F.col(c) for c in rows.columns]]
    return won.groupBy(*same, "_low").agg(F.sum(F.when(mine, 1).otherwise(0)).alias("_more")).select(
        *same, (F.col("_low") + F.col("_more")).alias("quota"))


def taken_upto(x: Column, start: Column, run: Column, total: Column) -> Column:
    """Words before place x that lie in the run [start, start + run) laid around a ring of `total` words."""
    flat = F.least(x, start + run) - F.least(x, start)
    wrapped = F.least(x, F.greatest(start + run - total, F.lit(0)))
    return flat + wrapped


def shares(docs: DataFrame, store: TableStore, seed: int = 7, block: int = BLOCK_WORDS, id_col: str = "doc_id",
           text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, row_key, size, source_size, target, taken, cut_from, cut_words.

    `taken` is `taken div size` whole copies and, if it is no multiple, cut_words
    words from word cut_from on, counted around the document's end.
    """
    text = docs[text_col]
    counted = docs.select(docs[id_col].alias("doc_id"), docs[source_col].cast("string").alias("source"),
                          F.xxhash64(docs[id_col], text).alias("row_key"),
                          F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    counted = store.write(counted, "sizes")
    sources = counted.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = targets(sources).withColumn("_seats", F.round(F.sum("target").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) / block).cast("long"))
    wanted = wanted.withColumn("_most", F.ceil(F.col("source_size") * MOST / block).cast("long"))
    wanted = store.write(apportion(wanted, [], "target", "_most", "_seats").select("source", "source_size", "target", F.col("quota").alias("source_quota")), "targets")

    n_shards = F.greatest(F.least(F.ceil(F.col("source_size") / SHARD_WORDS), F.lit(SHARDS)), F.lit(1))
    placed = counted.join(wanted, counted["source"].eqNullSafe(wanted["source"])).drop(wanted["source"])
    placed = placed.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "row_key"), n_shards))
    sized = placed.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("source_quota").alias("source_quota"))
    sized = sized.withColumn("_most", (MOST * F.ceil(F.col("words") / block)).cast("long"))
    # A null source is a group of its own in windows and groupings.
    quotas = apportion(sized, ["source"], "words", "_most", "source_quota").select("source", "shard", "words", "quota")
    quotas = store.write(quotas, "quotas")

    ring = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "row_key"), "row_key", F.col("doc_id").isNull(), "doc_id")
    laid = placed.withColumn("_end", F.sum("size").over(ring.rowsBetween(Window.unboundedPreceding, 0)))
    laid = laid.join(quotas, laid["source"].eqNullSafe(quotas["source"]) & (laid["shard"] == quotas["shard"])).select(
        laid["doc_id"], laid["row_key"], laid["size"], laid["source_size"], laid["target"], laid["source"], laid["shard"], "_end", "words", "quota")
    blocks_of = F.ceil(F.col("words") / block)
    rounds = F.coalesce((F.col("quota") / F.nullif(blocks_of, F.lit(0))).cast("long"), F.lit(0).cast("long"))
    start = F.coalesce(F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), F.nullif(blocks_of, F.lit(0))), F.lit(0)) * block
    laid = laid.withColumn("_rounds", rounds).withColumn("_start", start)
    laid = laid.withColumn("_run", F.least((F.col("quota") - F.col("_rounds") * blocks_of) * block, F.col("words")))
    begin = F.col("_end") - F.col("size")
    upto = functools.partial(taken_upto, start=F.col("_start"), run=F.col("_run"), total=F.col("words"))
    extra = upto(F.col("_end")) - upto(begin)
    first = F.when((begin >= F.col("_start")) & (begin < F.col("_start") + F.col("_run")) | (begin < F.col("_start") + F.col("_run") - F.col("words")), F.lit(0)).otherwise(F.greatest(F.col("_start") - begin, F.lit(0)))
    # A run that wraps may touch both ends of one document and leave its middle; then the tail is taken first.
    tail_first = (first == 0) & (extra < F.col("size")) & (upto(F.col("_end")) > upto(F.col("_end") - 1)) & (F.col("size") > 0)
    gap_end = F.col("_start") - begin
    taken = F.least(F.col("_rounds") * F.col("size") + extra, F.col("size") * MOST)
    return laid.select("doc_id", "row_key", "size", "source_size", "target", taken.cast("long").alias("taken"),
                       F.when(tail_first, gap_end).otherwise(first).cast("long").alias("cut_from"), extra.cast("long").alias("cut_words"))


def mix(docs: DataFrame, store: TableStore, seed: int = 7) -> DataFrame:
    """The mixed documents, with the columns of `docs`: whole copies, and pieces cut between words.

    A piece keeps the white space inside it; n_chars, where it is there, counts
    the piece. Rows alike in id and text give equal parts of what they take.
    """
    got = shares(docs, store, seed).groupBy("row_key").agg(
        F.count("*").alias("_alike"), F.sum("taken").alias("_taken"), F.max("size").alias("_size"), F.max("cut_from").alias("_from"))
    got = got.select(F.col("row_key").alias("_row_key"), "_size", F.expr("_taken div _alike").alias("_take"),
                     F.when(F.col("_alike") == 1, F.col("_from")).otherwise(0).alias("_from")).filter("_take > 0")
    names = docs.columns
    joined = docs.withColumn("_row_key", F.xxhash64("doc_id", "text")).join(got, "_row_key")
    joined = joined.withColumn("_whole", F.expr("_take div _size")).withColumn("_part", F.expr("_take % _size"))
    n = F.col("_whole") + (F.col("_part") > 0).cast("int")
    rows = joined.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), n)))
    units = F.regexp_extract_all("text", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    to_end = F.least(F.col("_part"), F.col("_size") - F.col("_from")).cast("int")
    tail = F.array_join(F.slice(units, (F.col("_from") + 1).cast("int"), to_end), "")
    head = F.array_join(F.slice(units, F.lit(1), (F.col("_part") - to_end).cast("int")), "")
    piece = F.when(F.col("_part") > to_end, F.concat(tail, F.lit("\n"), head)).otherwise(tail)
    cut = F.col("_k") > F.col("_whole")
    rows = rows.withColumn("_text", F.when(cut, piece).otherwise(F.col("text")))
    out = {"text": F.col("_text"), "n_chars": F.when(cut, F.length("_text")).otherwise(F.col("n_chars") if "n_chars" in names else F.lit(None))}
    return rows.select(*[out[c].cast(docs.schema[c].dataType).alias(c) if c in out else F.col(f"`{c}`") for c in names])
