"""Near-duplicates by b-bit MinHash, confirmed on whole shingle sets.

Each task makes, for every text, the digest of its whole set of shingles, band
keys of ROWS minima each, and a signature of the low BITS bits of all minima.
Texts of one set are a class of one representative; only these go on. Documents
that share a band key are candidates. Their similarity is first estimated from
the equal places of the packed signatures, corrected for chance collisions;
estimates well below the threshold are left out, the rest is confirmed on whole
texts.

No large bucket emits all its pairs. Buckets of up to SMALL_BUCKET representatives
are compared in full; a larger one compares its smallest member with all others.
Where it then still holds several components, members outside the leading one are
compared with the others, and only pairs with a high estimate leave that join. No
pair of a bucket is missed that is not linked already. Confirmation takes the
likeliest pair of each document first, joins components, and looks at other pairs
only where they still differ.

Defined results: null, empty and wordless texts have no shingles and no links;
a text of fewer than five words is one shingle; rows that share an id are one
document with several texts; rows without id are never linked; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.llm.arrays import LOWER, blocks, mix, span_hashes, window_hashes, word_spans
from skysift.llm.components import components
from skysift.session import TableStore

SHINGLE_WORDS = 5
PERCENT = 75
# 32 bands of 4: a pair at 0.75 shares none with a probability of 5e-6, a pair at 0.3 shares one in 23 of 100 cases.
BANDS, ROWS, BITS = 32, 4, 4
HASHES = BANDS * ROWS
# An estimate has a standard deviation of 0.041 at 0.75; four and a half below it, 4 of 1e6 pairs at 0.75 would be left out.
LEAST_ESTIMATE = 0.57
SMALL_BUCKET = 32

_RNG = np.random.default_rng(20240502)
_FACTORS = _RNG.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_TERMS = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
# Strays of large buckets are compared by longer signatures: a standard deviation of 0.0145, again four and a half.
LONG_HASHES, LEAST_LONG_ESTIMATE = 1024, 0.685
_LONG_FACTORS = _RNG.integers(0, 1 << 31, LONG_HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_LONG_TERMS = _RNG.integers(0, 1 << 32, LONG_HASHES, dtype=np.uint32)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    low = LOWER[buf]
    starts, ends, first = word_spans(low, offs)
    hashes, at = window_hashes(span_hashes(low, starts, ends), first, size)
    return [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def minima(sets: list[np.ndarray], factors: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Mixed minima (n x hashes) of sets that are not empty."""
    values = (mix(np.concatenate(sets)) >> np.uint64(32)).astype(np.uint32)
    begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    out = np.empty((len(sets), len(factors)), np.uint32)
    for k, (factor, term) in enumerate(zip(factors, terms, strict=True)):
        out[:, k] = np.minimum.reduceat(values * factor + term, begin)
    return mix(out.astype(np.uint64) + (np.arange(len(factors), dtype=np.uint64) << np.uint64(32)))


def low_bits(wide: np.ndarray) -> np.ndarray:
    """The low BITS bits of all minima of a row, packed into signed words."""
    low = (wide & np.uint64((1 << BITS) - 1)).reshape(len(wide), -1, 64 // BITS)
    return (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64).view(np.int64)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (n x BANDS) and packed low bits of sets that are not empty."""
    wide = minima(sets, _FACTORS, _TERMS)
    keys = np.zeros((len(sets), BANDS), np.uint64)
    for r in range(ROWS):
        keys = mix(keys * np.uint64(31) + wide[:, r::ROWS] + np.arange(BANDS, dtype=np.uint64))
    return keys.view(np.int64), low_bits(wide)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_key, n_shingles, digest, bands, bits per row; the last three null for a text without words."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[id_col], docs[text_col]).alias("row_key"), docs[text_col].alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in blocks(batch.column(2)):
                sets = shingle_sets(buf, offs)
                full = [k for k, s in enumerate(sets) if len(s)]
                bands, bits, digests = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                if full:
                    keys, packed = signatures([sets[k] for k in full])
                    for k, a, b in zip(full, keys, packed, strict=True):
                        bands[k], bits[k] = a, b
                        digests[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest()
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(digests, pa.binary()), pa.array(bands, longs), pa.array(bits, longs)],
                    names=["doc_id", "row_key", "n_shingles", "digest", "bands", "bits"])

    return rows.mapInArrow(work, "doc_id long, row_key long, n_shingles long, digest binary, bands array<long>, bits array<long>")


def shingle_rows(texts: DataFrame) -> DataFrame:
    """(node, shingles, long_bits) of rows (node, text), the text not without words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in blocks(batch.column(1)):
                sets = shingle_sets(buf, offs)
                full = [k for k, s in enumerate(sets) if len(s)]
                if full:
                    bits = low_bits(minima([sets[k] for k in full], _LONG_FACTORS, _LONG_TERMS))
                    longs = pa.list_(pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(full)), pa.array([sets[k].view(np.int64) for k in full], longs),
                                                      pa.array(list(bits), longs)], names=["node", "shingles", "long_bits"])

    return texts.select("node", "text").mapInArrow(work, "node long, shingles array<long>, long_bits array<long>")


def holders(sets: DataFrame) -> DataFrame:
    """(shingle, low, high): least and largest node that hold a shingle, once for all rows of a batch that share it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            values = column.flatten().to_numpy()
            nodes = np.repeat(batch.column(0).to_numpy(), np.diff(column.offsets.to_numpy()))
            order = np.argsort(values, kind="stable")
            values, nodes = values[order], nodes[order]
            first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
            low, high = (np.minimum.reduceat(nodes, first), np.maximum.reduceat(nodes, first)) if len(first) else (nodes, nodes)
            yield pa.RecordBatch.from_arrays([pa.array(values[first]), pa.array(low), pa.array(high)], names=["shingle", "low", "high"])

    return sets.select("node", "shingles").mapInArrow(work, "shingle long, low long, high long")


def estimate(x: Column, y: Column, hashes: int = HASHES) -> Column:
    """Similarity by the equal places of two packed signatures, corrected for places that are equal by chance."""
    def places(a: Column, b: Column) -> Column:
        d = a.bitwiseXOR(b)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(F.lit(0x1111111111111111)))

    unequal = F.aggregate(F.zip_with(x, y, places), F.lit(0), lambda total, n: total + n)
    chance = 0.5 ** BITS
    return ((1 - unequal / hashes) - chance) / (1 - chance)


def estimated(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs (a, b) whose estimate reaches LEAST_ESTIMATE, with it."""
    left = marks.select(F.col("node").alias("a"), F.col("bits").alias("_x"))
    right = marks.select(F.col("node").alias("b"), F.col("bits").alias("_y"))
    joined = pairs.join(left, "a").join(right, "b").withColumn("likely", estimate(F.col("_x"), F.col("_y")))
    return joined.filter(F.col("likely") >= LEAST_ESTIMATE).groupBy("a", "b").agg(F.max("likely").alias("likely"))


def compared(members: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of bucket members (bucket, node, n, center): all of a small bucket, the centre's of a large one."""
    small = members.filter(F.col("n") <= SMALL_BUCKET).select("bucket", "node")
    inside = small.select("bucket", F.col("node").alias("a")).join(small.select("bucket", F.col("node").alias("b")), "bucket").filter("a < b").select("a", "b")
    star = members.filter((F.col("n") > SMALL_BUCKET) & (F.col("center") < F.col("node")))
    return inside.union(star.select(F.col("center").alias("a"), F.col("node").alias("b")))


def strays(links: _Links, members: DataFrame, marks: DataFrame) -> DataFrame:
    """Likely pairs between components that meet in a large bucket.

    Most members of such a bucket are linked with its centre, so one component
    leads. The members of all buckets it leads are one group, each once; those
    outside the component are compared with the group. A pair's intersection is at
    most the smaller number of shingles that either shares with anyone in the groups;
    where that bound is below the threshold, the pair, or the document, is out for
    certain. Only likely pairs of the rest leave the join.
    """
    known = links.with_components(members, "node", "_c")
    counts = known.groupBy("bucket", "_c").agg(F.count("*").alias("_n"))
    led = counts.groupBy("bucket").agg(F.max(F.struct("_n", "_c"))["_c"].alias("leader"), F.min("_c").alias("_l"), F.max("_c").alias("_h")).filter("_l < _h")
    group = known.join(led.select("bucket", "leader"), "bucket").select("leader", "node", "_c").distinct().join(marks.select("node", "bits"), "node")
    group = links.store.write(group, "led")
    sets = links.store.write(shingle_rows(links.texts.join(group.select("node").distinct(), "node", "left_semi")), "led-sets")
    sizes = sets.groupBy("node").agg(F.min(F.size("shingles")).alias("n"), F.sum(F.size("shingles")).alias("_all"), F.when(F.count("*") == 1, F.first("long_bits")).alias("long_bits"))
    # A shingle that only one node holds is shared with none.
    alone = holders(sets).groupBy("shingle").agg(F.min("low").alias("node"), F.max("high").alias("_high")).filter("node = _high").groupBy("node").agg(F.count("*").alias("_alone"))
    support = sizes.join(alone, "node", "left").withColumn("most", F.col("_all") - F.coalesce("_alone", F.lit(0))).drop("_all", "_alone")
    support = support.filter(100 * F.col("most") >= PERCENT * F.col("n"))
    group = links.store.write(group.join(support, "node"), "led-able")
    own = group.filter("_c <> leader").select("leader", F.col("node").alias("_p"), F.col("_c").alias("_pc"), F.col("bits").alias("_x"), F.col("most").alias("_m"), F.col("n").alias("_pn"), F.col("long_bits").alias("_long"))
    likely = estimate(F.col("_x"), F.col("bits"))
    # With s shared at most, similarity reaches PERCENT only if (100 + PERCENT) * s >= PERCENT * (both sizes).
    able = (100 + PERCENT) * F.least("most", "_m") >= PERCENT * (F.col("n") + F.col("_pn"))
    # An id with several texts has no signature of its own and goes on to them.
    close = F.coalesce(estimate(F.col("_long"), F.col("long_bits"), LONG_HASHES) >= LEAST_LONG_ESTIMATE, F.lit(True))
    met = group.join(own, (group["leader"] == own["leader"]) & (F.col("_c") != F.col("_pc")) & able & (likely >= LEAST_ESTIMATE) & close)
    pairs = met.select(F.least("node", "_p").alias("a"), F.greatest("node", "_p").alias("b"), likely.alias("likely"))
    return pairs.groupBy("a", "b").agg(F.max("likely").alias("likely"))


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= PERCENT * union of their shingle sets."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("_ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("_tb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "_ta", "_tb")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            xs = (s for *_, buf, offs in blocks(batch.column(2)) for s in shingle_sets(buf, offs))
            ys = (s for *_, buf, offs in blocks(batch.column(3)) for s in shingle_sets(buf, offs))
            for k, (x, y) in enumerate(zip(xs, ys, strict=True)):
                both = len(x) + len(y) - len(np.union1d(x, y)) if len(x) * 100 >= PERCENT * len(y) and len(y) * 100 >= PERCENT * len(x) else 0
                keep[k] = both > 0 and 100 * both >= PERCENT * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return joined.mapInArrow(work, "a long, b long").distinct()


class _Links:
    """Confirmed links so far and the component of each linked node."""

    def __init__(self, store: TableStore, texts: DataFrame):
        self.store, self.texts, self.turn = store, texts, 0
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None

    def with_components(self, df: DataFrame, node: str, out: str) -> DataFrame:
        if self.labels is None:
            return df.withColumn(out, F.col(node))
        labels = self.labels.select(F.col("node").alias(node), F.col("component").alias("_component"))
        return df.join(labels, node, "left").withColumn(out, F.coalesce("_component", node)).drop("_component")

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose ends are not in one component yet."""
        known = self.with_components(self.with_components(pairs, "a", "_ca"), "b", "_cb")
        return known.filter("_ca <> _cb").select("a", "b")

    def add(self, links: DataFrame) -> None:
        self.turn += 1
        new = self.store.write(links, f"confirmed{self.turn}")
        if new.isEmpty():
            return
        self.links = new if self.links is None else self.links.union(new)
        self.labels = components(self.links, self.store, f"labels{self.turn}")

    def settle(self, pairs: DataFrame) -> None:
        """Confirm what links the pairs hold, as far as they join components."""
        pairs = self.store.write(pairs, f"pairs{self.turn}")
        if pairs.isEmpty():
            return
        first = pairs.groupBy("b").agg(F.max(F.struct("likely", "a"))["a"].alias("a"))
        self.add(confirmed(self.store.write(first.select("a", "b"), f"first{self.turn}"), self.texts))
        self.add(confirmed(self.store.write(self.apart(pairs.join(first, ["a", "b"], "left_anti")), f"rest{self.turn}"), self.texts))


def near_duplicates(docs: DataFrame, store: TableStore) -> DataFrame:
    """One row per row of `docs`: doc_id, row_key, n_shingles, component_id, kept."""
    prints = store.write(fingerprints(docs), "fingerprints")
    known = prints.filter("doc_id is not null and digest is not null")
    classes = store.write(known.groupBy("digest").agg(F.min("doc_id").alias("node")), "classes")
    of_class = known.select("doc_id", "digest", "bands", "bits").join(classes, "digest").filter("doc_id = node").dropDuplicates(["digest"])
    marks = store.write(of_class.select("node", "bands", "bits"), "marks")

    keys = marks.select("node", F.explode("bands").alias("bucket"))
    sizes = keys.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("_low"), F.max("node").alias("_high")).filter("_low < _high")
    sizes = store.write(sizes, "buckets")
    pairs = sizes.filter("n = 2").select(F.col("_low").alias("a"), F.col("_high").alias("b"))
    members = store.write(keys.join(sizes.filter("n > 2").select("bucket", "n", F.col("_low").alias("center")), "bucket").distinct(), "members0")
    pairs = store.write(estimated(pairs.union(compared(members)).distinct(), marks), "candidates")
    large = members.filter(F.col("n") > SMALL_BUCKET)

    # Texts of candidates only, written once for all confirmations; by the same plan at every size.
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).union(large.select("node")).distinct()
    texts = store.write(docs.select(docs["doc_id"].cast("long").alias("node"), docs["text"].alias("text")).join(wanted.hint("merge"), "node", "left_semi").distinct(), "texts")
    links = _Links(store, texts)
    # Rows that share an id but not their text join the classes of these texts.
    same_id = known.select("doc_id", "digest").join(classes, "digest").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b")
    links.add(same_id.select("a", "b").distinct())
    links.settle(pairs)
    if not large.isEmpty():
        links.settle(store.write(strays(links, large.select("bucket", "node"), marks), "strays"))

    whole = prints.select("doc_id", "row_key", "n_shingles", "digest").join(classes, "digest", "left").withColumn("_node", F.coalesce("node", "doc_id")).drop("node", "digest")
    out = links.with_components(whole.withColumnRenamed("_node", "node"), "node", "component_id")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", "row_key", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"))


def keep_one(docs: DataFrame, store: TableStore) -> DataFrame:
    """One document of each group of near-duplicates, with the columns of `docs`; of repeated rows one stays."""
    kept = near_duplicates(docs, store).filter("kept").select(F.col("row_key").alias("_row_key")).distinct()
    keyed = docs.withColumn("_row_key", F.xxhash64("doc_id", "text"))
    return keyed.join(kept, "_row_key", "left_semi").dropDuplicates(["_row_key"]).select(*[f"`{c}`" for c in docs.columns])
