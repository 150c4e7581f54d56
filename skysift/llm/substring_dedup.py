"""Substring de-duplication by content-defined chunks.

A gear hash rolls over the bytes of a text; a chunk ends behind a word at whose
end the hash is the least among RADIUS words on either side, so a cut depends on
its neighbourhood alone and an insertion moves only the cuts near it. Windows of
WINDOW chunks are compared by digest. A window that occurs in documents with a
smaller id, or before in the same text, names the place to compare with: the run
of such windows is extended word by word to the left and right along the text of
the first document, and is taken out when it has LEAST_WORDS words and more.

Tasks write one row of digests per text. Digests are combined before they are
shuffled, only those of several documents meet the windows again, and only the
words around the ends of runs are carried from one document to the others.

Defined results: null and empty texts stay; rows that share an id are one document;
rows without id are one document after all others; of equal documents the one with
the smallest id stays whole; repeated rows are cut alike; an empty table gives no rows;
columns other than doc_id and text are not looked at. Words are what white space
parts. An end of a run is extended along the first document that holds its outermost
window, and by at most CONTEXT words: longer equal stretches have cuts of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.llm.arrays import _power_tables, blocks, mix, span_hashes, word_spans
from skysift.session import TableStore

LAST = (1 << 63) - 1
# Words on either side among which a cut has the least hash: chunks of some 7 words.
RADIUS = 3
# A stretch without a cut, as of one word again and again, is cut after this many words.
LONGEST = 64
WINDOW = 2
# A run goes from this many words on, so a passage of 50 still goes where one end is not extended.
LEAST_WORDS = 30
CONTEXT = 32

_GEAR = np.random.default_rng(20240503).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Gear hash at every byte: hash = (hash << 2) + value of the byte, so 16 bytes count, by doubling windows inside each text."""
    h = _GEAR[buf]
    for k in (1, 2, 4, 8):
        shifted = np.zeros_like(h)
        shifted[k:] = h[:-k] << np.uint32(2 * k)
        heads = offs[:-1, None] + np.arange(k)
        shifted[heads[heads < offs[1:, None]]] = 0
        h = h + shifted
    return h


def cut_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, first word of each text (n + 1 values), and whether a chunk begins at each word."""
    starts, ends, first = word_spans(buf, offs)
    n = len(starts)
    if not n:
        return starts, ends, first, np.zeros(0, bool)
    value = gear(buf, offs)[ends - 1]
    at = np.arange(n)
    behind = at - np.repeat(first[:-1], np.diff(first))
    ahead = np.repeat(first[1:], np.diff(first)) - 1 - at
    least = np.ones(n, bool)
    for k in range(1, min(RADIUS, n - 1) + 1):
        least[k:] &= (behind[k:] < k) | (value[:-k] > value[k:])
        least[:-k] &= (ahead[:-k] < k) | (value[k:] >= value[:-k])
    begins = behind == 0
    begins[1:] |= least[:-1]
    since = at - np.maximum.accumulate(np.where(begins, at, 0))
    return starts, ends, first, begins | (since % LONGEST == 0)


def chunks(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ends of all chunks, and for each text the number of its first chunk (n + 1 values); texts without words have none."""
    starts, _, first, begins = cut_words(buf, offs)
    heads = np.flatnonzero(begins)
    firsts = np.searchsorted(heads, first)
    ends = np.append(starts[heads[1:]], offs[-1]) if len(heads) else np.zeros(0, np.int64)
    full = np.diff(firsts) > 0
    ends[firsts[1:][full] - 1] = offs[1:][full]
    return ends, firsts


class Windows:
    """Words, and windows of WINDOW chunks, of the texts of one block; windows of text t: where[t] to where[t + 1]."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.offs = offs
        self.starts, ends, self.first, begins = cut_words(buf, offs)
        self.words = span_hashes(buf, self.starts, ends)
        heads = np.flatnonzero(begins)
        firsts = np.searchsorted(heads, self.first)
        counts = np.maximum(np.diff(firsts) - WINDOW + 1, 0)
        self.where = np.concatenate([[0], np.cumsum(counts)])
        chunk = np.repeat(firsts[:-1] - self.where[:-1], counts) + np.arange(self.where[-1])
        bounds = np.append(heads, len(self.starts))
        self.begin, self.end = bounds[chunk], bounds[chunk + WINDOW]
        power, inverse = _power_tables(len(self.words) + 1)
        sums = np.zeros(len(self.words) + 1, np.uint64)
        np.cumsum(self.words * power[: len(self.words)], out=sums[1:])
        hashed = (sums[self.end] - sums[self.begin]) * inverse[self.begin] + (self.end - self.begin).astype(np.uint64)
        self.digests = mix(hashed).view(np.int64)

    def earlier(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the windows of text t that occur before in it, without overlap, and of their first occurrences."""
        a, b = int(self.where[t]), int(self.where[t + 1])
        _, at, back = np.unique(self.digests[a:b], return_index=True, return_inverse=True)
        source = at[back] + a
        own = np.arange(a, b)
        again = self.end[source] <= self.begin[own]
        return own[again], source[again]

    def around(self, t: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Words before window k of text t, nearest first, and behind it, CONTEXT of them at most, as 32 bits."""
        low, high = max(int(self.first[t]), int(self.begin[k]) - CONTEXT), min(int(self.first[t + 1]), int(self.end[k]) + CONTEXT)
        short = self.words[low:high].astype(np.uint32).view(np.int32)
        return short[: int(self.begin[k]) - low][::-1], short[int(self.end[k]) - low :]


def agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading values are equal."""
    n = min(len(a), len(b))
    unlike = np.flatnonzero(a[:n] != b[:n])
    return int(unlike[0]) if len(unlike) else n


def keyed(docs: DataFrame) -> DataFrame:
    """doc, row_key, doc_id and text of each row; doc and row_key stand for the row."""
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(docs["doc_id"], docs["text"]).alias("row_key"), docs["doc_id"], docs["text"])


def window_table(rows: DataFrame) -> DataFrame:
    """doc, row_key, digests of the windows of each text in order, and whether one comes again in it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in blocks(batch.column(2)):
                w = Windows(buf, offs)
                digests = pa.ListArray.from_arrays(pa.array(w.where, pa.int32()), pa.array(w.digests))
                own = pa.array([len(w.earlier(t)[0]) > 0 for t in range(j - i)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), digests, own], names=["doc", "row_key", "digests", "own"])

    return rows.select("doc", "row_key", "text").mapInArrow(work, "doc long, row_key long, digests array<long>, own boolean")


def context_table(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """digest and the words before and behind its first place in the first document, for the digests that `wanted` names per doc."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in blocks(batch.column(2)):
                w = Windows(buf, offs)
                keys, digests, before, behind = [], [], [], []
                for t in range(j - i):
                    a, b = int(w.where[t]), int(w.where[t + 1])
                    found, at = np.unique(w.digests[a:b], return_index=True)
                    for k in (at[np.isin(found, batch.column(3)[i + t].values.to_numpy())] + a).tolist():
                        left, right = w.around(t, k)
                        keys.append(batch.column(1)[i + t].as_py())
                        digests.append(int(w.digests[k]))
                        before.append(left)
                        behind.append(right)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(digests, pa.int64()), pa.array(before, pa.list_(pa.int32())), pa.array(behind, pa.list_(pa.int32()))],
                                                 names=["row_key", "digest", "before", "behind"])

    texts = rows.join(wanted, "doc").select("doc", "row_key", "text", "wanted")
    found = texts.mapInArrow(work, "row_key long, digest long, before array<int>, behind array<int>")
    return found.groupBy("digest").agg(F.min(F.struct("row_key", "before", "behind")).alias("x")).select("digest", "x.before", "x.behind")


def runs(places: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    if not len(places):
        return []
    breaks = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.append(0, breaks + 1)].tolist(), places[np.append(breaks, len(places) - 1)].tolist(), strict=True))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, with those that meet made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeated_spans(w: Windows, t: int, places: np.ndarray, before: dict[int, np.ndarray], behind: dict[int, np.ndarray], least: int) -> tuple[list[tuple[int, int]], int]:
    """Spans of words of text t that repeat, and the number of its repeated windows.

    `places`: windows that occur in documents before; `before` and `behind`: the
    words around the windows at the ends of their runs, by digest.
    """
    base, low, high = int(w.where[t]), int(w.first[t]), int(w.first[t + 1])
    none = np.zeros(0, np.int32)
    spans = []
    for a, b in runs(places + base):
        left, right = w.around(t, a)[0], w.around(t, b)[1]
        spans.append((int(w.begin[a]) - agree(left, before.get(int(w.digests[a]), none)), int(w.end[b]) + agree(right, behind.get(int(w.digests[b]), none))))
    own, source = w.earlier(t)
    source_of = dict(zip(own.tolist(), source.tolist(), strict=True))
    for a, b in runs(own):
        begin, other = int(w.begin[a]), int(w.begin[source_of[a]])
        end, behind_it = int(w.end[b]), int(w.end[source_of[b]])
        left = agree(w.words[max(low, begin - LONGEST) : begin][::-1], w.words[max(low, other - LONGEST) : other][::-1])
        right = agree(w.words[end : min(high, end + LONGEST)], w.words[behind_it : min(high, behind_it + LONGEST)])
        spans.append((begin - left, end + right))
    return [(a, b) for a, b in merged(spans) if b - a >= least], len(np.union1d(places + base, own))


def drop_repeats(docs: DataFrame, store: TableStore, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, the text without repeated runs, n_chars of it, n_repeated (windows), cut (byte bounds), kept, for each row of `docs`."""
    key = ["doc", "row_key"]
    rows = keyed(docs)
    table = store.write(window_table(rows), "windows")
    shared = table.select("doc", F.explode("digests").alias("digest")).groupBy("digest").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("_last"))
    shared = store.write(shared.filter("first_doc < _last").select("digest", "first_doc"), "shared")
    later = table.select(*key, F.posexplode("digests").alias("pos", "digest")).join(shared, "digest").filter("doc > first_doc")
    hits = later.groupBy(key).agg(F.sort_array(F.collect_set(F.struct("pos", "digest", "first_doc"))).alias("w"))
    hits = hits.withColumn("n", F.size("w"))
    opens = lambda x, i: (i == 0) | (F.get("w", i - 1)["pos"] < x["pos"] - 1)
    closes = lambda x, i: (i == F.col("n") - 1) | (F.get("w", i + 1)["pos"] > x["pos"] + 1)
    hits = store.write(hits.select(*key, F.col("w.pos").alias("places"), F.filter("w", opens).alias("heads"), F.filter("w", closes).alias("tails")), "hits")
    ends = hits.select(*key, F.lit(True).alias("head"), F.explode("heads").alias("e")).union(hits.select(*key, F.lit(False), F.explode("tails")))
    ends = ends.select(*key, "head", F.col("e.digest").alias("digest"), F.col("e.first_doc").alias("first_doc"))
    wanted = store.write(ends.groupBy(F.col("first_doc").alias("doc")).agg(F.collect_set("digest").alias("wanted")), "wanted")
    context = store.write(context_table(rows, wanted), "context")
    around = ends.select(*key, "head", "digest").distinct().join(context, "digest")
    around = around.groupBy(key).agg(F.collect_list(F.struct("head", "digest", F.when(F.col("head"), F.col("before")).otherwise(F.col("behind")).alias("words"))).alias("around"))
    marks = hits.select(*key, "places").join(around, key).join(table.filter("own").select(*key).distinct(), key, "full")
    marks = store.write(marks.select(*key, F.coalesce("places", F.array().cast("array<int>")).alias("places"),
                                     F.col("around.head").alias("heads"), F.col("around.digest").alias("digests"), F.col("around.words").alias("words")), "marks")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in blocks(batch.column(1)):
                w = Windows(buf, offs) if batch.column(2).slice(i, j - i).null_count < j - i else None
                texts, cuts, counts = [], [], []
                for t in range(j - i):
                    row, spans, n = i + t, [], 0
                    if batch.column(2)[row].is_valid:
                        before, behind = {}, {}
                        if batch.column(3)[row].is_valid:
                            for head, digest, near in zip(*(batch.column(c)[row].values for c in (3, 4, 5)), strict=True):
                                (before if head.as_py() else behind)[digest.as_py()] = near.values.to_numpy()
                        spans, n = repeated_spans(w, t, batch.column(2)[row].values.to_numpy().astype(np.int64), before, behind, least)
                    edges = np.append(w.starts, offs[t + 1]) if spans else None
                    limit = int(w.first[t + 1]) if spans else 0
                    cut = [int(offs[t + 1] if x == limit else edges[x]) - int(offs[t]) for span in spans for x in span]
                    raw = buf[offs[t] : offs[t + 1]].tobytes()
                    keep = zip([0, *cut[1::2]], [*cut[::2], len(raw)], strict=True)
                    texts.append(b"".join(raw[a:b] for a, b in keep).decode() if batch.column(1)[row].is_valid else None)
                    cuts.append(cut)
                    counts.append(n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(cuts, pa.list_(pa.int64()))],
                                                 names=["doc_id", "text", "n_repeated", "cut"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    base = rows.join(marks, key, "left").select("doc_id", "text", "places", "heads", "digests", "words")
    out = base.mapInArrow(work, f"doc_id {kind}, text string, n_repeated long, cut array<long>")
    return out.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated", "cut", (F.size("cut") == 0).alias("kept"))
