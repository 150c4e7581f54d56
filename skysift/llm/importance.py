"""Resampling documents towards a target corpus: hashed-feature weights, Gumbel scores, ranks by regular sampling.

Every run of up to `max_words` consecutive words is a feature, hashed into one
of `buckets`. How often each bucket occurs in the documents and in the target
texts gives the bucket's gain; the gains are an array of `buckets` numbers, a
bound set by the parameter and not by the corpus. A document's weight is the sum
of its features' gains, its score the weight plus seeded Gumbel noise, so that
the highest scores are a draw without replacement in proportion to exp(weight).

Ranks come from parallel sorting by regular sampling. Each task sorts its run of
scored rows and takes regular samples of it; samples of up to MERGED_RUNS runs
are merged and thinned to regular ones again until one set is left, which gives
the splitters. Rows between two splitters are a segment. Segments are counted,
and only those that hold a drawn rank are exchanged; a segment is sorted where it
lands, and the counts of the segments before it make its positions exact ranks.
Equal rows, a hot source or copies do not crowd a segment beyond what share one
(score, id): the splitters are taken of both.

Defined results: a null or empty text has no feature and weight 0; a null id
counts as an empty one in the noise and sorts first among equal scores; repeated
rows are ranked one by one; an empty table gives no rows, an empty target is
one without counts. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.llm.arrays import LOWER, blocks
from skysift.session import TableStore

BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
# Percent of the documents with enough words that are drawn.
DRAWN_PERCENT = 10

# Most segments that ranks are cut into; a segment is sorted on disk where it is large.
MOST_SEGMENTS = 512
# Regular samples of a run for each segment: a segment exceeds its share by one part in this many at each merging.
OVERSAMPLING = 4
# Runs whose samples are merged in one task.
MERGED_RUNS = 64
# Words longer than this many bytes are hashed one by one.
LONG_WORD = 48

# Bytes of a word once A-Z is lower-cased: digits, a-z and all of a character outside ASCII.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def feature_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased texts end to end, and each text's first word (n + 1 values)."""
    word = np.zeros(len(buf) + 1, bool)
    word[:-1] = _WORD[buf]
    begins = word[:-1].copy()
    begins[1:] &= ~word[:-2]
    first = offs[:-1][offs[:-1] < len(buf)]
    begins[first] = word[first]
    ends = word[:-1] & ~word[1:]
    last = offs[1:][offs[1:] > 0] - 1
    ends[last] |= word[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offs)


def span_crcs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each span, all spans advancing byte by byte together; long ones by themselves."""
    size = ends - starts
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(-np.minimum(size, LONG_WORD + 1), kind="stable")
    n_long = int(np.searchsorted(-size[order], -LONG_WORD, "left")) if len(order) else 0
    for i in order[:n_long].tolist():
        out[i] = zlib.crc32(buf[starts[i] : ends[i]])
    order = order[n_long:]
    at, left = starts[order], size[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    alive = np.searchsorted(-left, -np.arange(LONG_WORD + 1), "left")  # spans longer than 0, 1, ...
    for k in range(int(left[0]) if len(left) else 0):
        n = alive[k]
        crc[:n] = _CRC[(crc[:n] ^ buf[at[:n] + k]) & 255] ^ crc[:n] >> 8
    out[order] = ~crc
    return out


def bucket_batches(batches: Iterator[pa.RecordBatch], at: int, max_words: int, buckets: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    """(batch, first row, end row, buckets of all features, offsets per row), a block of rows at a time."""
    for batch in batches:
        for i, j, buf, offs in blocks(batch.column(at)):
            buf = LOWER[buf]
            starts, ends, first = feature_spans(buf, offs)
            hashed = span_crcs(buf, starts, ends)
            if max_words == 1:
                yield batch, i, j, hashed % np.uint32(buckets), first
                continue
            raw = buf.tobytes()
            found: list[int] = []
            offsets = [0]
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                found += hashed[a:b].tolist()
                words = [raw[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                for n in range(2, max_words + 1):
                    found += [zlib.crc32(b" ".join(words[k : k + n])) for k in range(len(words) - n + 1)]
                offsets.append(len(found))
            yield batch, i, j, np.asarray(found, np.uint32) % np.uint32(buckets), np.asarray(offsets)


def bucket_counts(df: DataFrame, text_col: str = "text", max_words: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): occurrences of each bucket's features; a task adds up its rows before anything is shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, _, _, found, _ in bucket_batches(batches, 0, max_words, buckets):
            total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    counted = df.select(df[text_col].alias("text")).mapInArrow(work, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, text_col: str = "text", max_words: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket: how much more frequent it is in the target, in thousandths of a natural logarithm."""
    s, t = (bucket_counts(df, text_col, max_words, buckets).withColumn("of", F.lit(k)) for k, df in enumerate((documents, target)))
    both = s.unionByName(t).groupBy("bucket").pivot("of", [0, 1]).agg(F.sum("n"))
    rows = both.select("bucket", F.coalesce("0", F.lit(0)).alias("s"), F.coalesce("1", F.lit(0)).alias("t")).collect()
    counts = np.zeros((2, buckets))
    for r in rows:  # one row for each bucket at most
        counts[:, r.bucket] = r.s, r.t
    all_s, all_t = counts.sum(axis=1)
    return np.floor(1000 * np.log((counts[1] + 1) * (all_s + buckets) / ((counts[0] + 1) * (all_t + buckets)))).astype(np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Seeded Gumbel noise of an id, in thousandths."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def scored(documents: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_words: int = 1,
           buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every document."""
    gain = gains(documents, target, text_col, max_words, buckets)
    rows = documents.select(documents[id_col].alias("doc_id"), documents[text_col].alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, j, found, first in bucket_batches(batches, 1, max_words, buckets):
            upto = np.concatenate([[0], np.cumsum(gain[found])])
            n = np.diff(first)
            # n words have n + (n - 1) + ... features, down to runs of max_words.
            n_words = n if max_words == 1 else np.asarray([_words_of(k, max_words) for k in n.tolist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array(n_words), pa.array(n), pa.array(upto[first[1:]] - upto[first[:-1]])],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    out = rows.mapInArrow(work, f"doc_id {id_type}, n_words long, n_features long, weight long")
    return out.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def _words_of(features: int, max_words: int) -> int:
    words = 0
    while sum(max(0, words - k) for k in range(max_words)) < features:
        words += 1
    return words


def regular_samples(runs: DataFrame, n: int) -> DataFrame:
    """(run, score, doc_id, weight): about n to 2n regular samples of each task's sorted rows (score falling, id rising).

    A run is read once in its order; when 2n samples are held, every other one goes and the stride doubles.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        stride, seen, held = 1, 0, []
        for batch in batches:
            score, ids = batch.column(0), batch.column(1)
            for i in range(-seen % stride, batch.num_rows, stride):
                held.append((score[i].as_py(), ids[i].as_py()))
            seen += batch.num_rows
            while len(held) > 2 * n:
                held, stride = held[::2], stride * 2
        run = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([run] * len(held), pa.int64()), pa.array([h[0] for h in held], pa.int64()),
             pa.array([h[1] for h in held], batch_type), pa.array([float(stride)] * len(held))],
            names=["run", "score", "doc_id", "weight"])

    ordered = runs.select("score", "doc_id").sortWithinPartitions(F.desc("score"), F.asc_nulls_first("doc_id"))
    kind = ordered.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(kind)
    return ordered.mapInArrow(work, f"run long, score long, doc_id {kind.simpleString()}, weight double")


def _thinned(pdf: pd.DataFrame, n: int) -> pd.DataFrame:
    """n regular ones of merged samples, each of the same part of their whole weight."""
    pdf = pdf.sort_values(["score", "doc_id"], ascending=[False, True], na_position="first", ignore_index=True)
    upto = pdf.weight.cumsum().to_numpy()
    at = np.unique(np.searchsorted(upto, (np.arange(n) + 0.5) * upto[-1] / n))
    out = pdf.iloc[at].copy()
    out["weight"] = np.diff(np.concatenate([[0.0], np.where(at == at[-1], upto[-1], upto[at])]))
    return out


def splitters(runs: DataFrame, segments: int, store: TableStore) -> list[tuple[int, object]]:
    """At most segments - 1 pairs (score, id), in order of rank, that cut the rows into nearly equal parts."""
    n = segments * OVERSAMPLING
    samples = store.write(regular_samples(runs, n), "samples-0")
    level = 0
    while True:
        level += 1
        merged = samples.withColumn("run", F.floor(F.col("run") / MERGED_RUNS))
        merged = merged.groupBy("run").applyInPandas(lambda pdf: _thinned(pdf, n), samples.schema)
        samples = store.write(merged, f"samples-{level}")
        last = samples.agg(F.max("run")).first()[0]
        if not last:
            break
    rows = sorted(((r.score, r.doc_id, r.weight) for r in samples.collect()), key=lambda r: (-r[0], r[1] is not None, r[1]))
    whole, upto, cuts = sum(r[2] for r in rows), 0.0, []
    for score, doc_id, weight in rows:
        if upto + weight >= whole * (len(cuts) + 1) / segments and len(cuts) < segments - 1 and (not cuts or cuts[-1] != (score, doc_id)):
            cuts.append((score, doc_id))
        upto += weight
    return cuts


def with_segment(runs: DataFrame, cuts: list[tuple[int, object]]) -> DataFrame:
    """Add `_segment`: how many splitters come before a row or are equal to it."""

    def before(score: Column, doc_id: Column, cut: tuple[int, object]) -> Column:
        follows = F.lit(True) if cut[1] is None else F.coalesce(doc_id >= F.lit(cut[1]), F.lit(False))
        return (score < cut[0]) | (score == cut[0]) & follows

    # Halving over the sorted splitters: a few nested conditions in place of one for each splitter.
    def place(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(before(F.col("score"), F.col("doc_id"), cuts[mid]), place(mid + 1, hi)).otherwise(place(lo, mid))

    return runs.withColumn("_segment", place(0, len(cuts)).cast("int"))


def ranked(rows: DataFrame, drawn: int, segments: int, store: TableStore) -> DataFrame:
    """Add `rank`, 1 to `drawn` by falling score and rising id, null for all others; `rows` must be a written table."""
    none = F.lit(None).cast("long")
    if drawn <= 0:
        return rows.withColumn("rank", none)
    cuts = splitters(rows, segments, store)
    placed = store.write(with_segment(rows, cuts), "placed")
    sizes = sorted((r["_segment"], r["n"]) for r in placed.groupBy("_segment").agg(F.count("*").alias("n")).collect())
    before, upto = {}, 0
    for segment, n in sizes:
        if upto < drawn:
            before[segment] = upto
        upto += n
    last = max(before)
    first_rank = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), *[F.col(c) for c in rows.columns if c not in ("score", "doc_id")]]
    local = F.row_number().over(Window.partitionBy("_segment").orderBy(*order))
    rank = (first_rank[F.col("_segment")] + local).cast("long")
    high = placed.filter(F.col("_segment") <= last).withColumn("rank", rank)
    high = high.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    low = placed.filter(F.col("_segment") > last).withColumn("rank", none)
    return high.unionByName(low).drop("_segment")


def resample(documents: DataFrame, target: DataFrame, store: TableStore, id_col: str = "doc_id", text_col: str = "text",
             max_words: int = 1, buckets: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = DRAWN_PERCENT,
             segments: int | None = None) -> DataFrame:
    """doc_id, n_features, weight, score, rank: the draw of `percent` of the documents with at least `min_words` words.

    `segments` is as many as Spark's shuffle partitions unless given, MOST_SEGMENTS at most.
    """
    rows = store.write(scored(documents, target, id_col, text_col, max_words, buckets, seed), "scored")
    fit = F.col("n_words") >= min_words
    n = rows.filter(fit).count()
    if segments is None:
        segments = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keep = ["doc_id", "n_features", "weight", "score"]
    out = ranked(rows.filter(fit).select(*keep), percent * n // 100, max(1, min(segments, MOST_SEGMENTS)), store)
    rest = rows.filter(~fit).select(*keep, F.lit(None).cast("long").alias("rank"))
    return out.unionByName(rest)
