"""Packing whole documents into few sequences by swap-based local search.

Each task tokenizes its own rows and packs them in blocks of BLOCK_TOKENS tokens.
A block starts from best fit in falling order. Then the least filled sequence
gives its pieces away: one is moved where it fits, or exchanged against a shorter
one (one for one), against two that are together shorter, or two against one, always
the exchange that shrinks the giver most. Each step raises the sum of squared
fills, so the search ends; a sequence that has given everything away is gone. It
stops at the lower bound of the block's lengths, or after PATIENCE givers in a
row could not be emptied.

Sequences that are not nearly full are then taken apart and packed again, the
rows of many tasks together, level by level until one group is left or a level
does not halve what is open. These levels move only lengths and checksums; a level
is a written table, so a lost executor repeats one task and no text is tokenized
twice.

Defined results: a null or empty text is the end id alone; a document longer than
a sequence is cut so that all pieces but the first are whole sequences; null ids are
kept; repeated rows are packed as often as they occur; an empty table gives no rows.
Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.llm.arrays import blocks
from skysift.session import TableStore

CAPACITY = 1024
END_ID = 2
# Tokens packed together: some 4,000 sequences.
BLOCK_TOKENS = 1 << 22
# Givers in a row that may keep a piece before the search ends.
PATIENCE = 256
# Sequences filled below this share are packed again with those of other tasks.
OPEN_BELOW = 15 / 16


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing has fewer sequences: the tokens, and the long pieces of which no two fit together (Martello and Toth's L2)."""
    counts = np.bincount(lengths, minlength=capacity + 1)
    n, size = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * np.arange(capacity + 1))])
    half = capacity // 2
    k = np.arange(half + 1)
    # Of lengths up to x there are n[x + 1].
    alone = n[-1] - n[capacity - k + 1]
    wide = n[capacity - k + 1] - n[half + 1]
    room = wide * capacity - (size[capacity - k + 1] - size[half + 1])
    small = size[half + 1] - size[k]
    return int((alone + wide + np.maximum(0, -((room - small) // capacity))).max())


class Bins:
    """Sequences of one block and what can be exchanged between them.

    For each free room r: the sequences that have it, a bit set of the lengths they hold and one of the sums of
    two lengths they hold, so that the best exchange is found by shifting bit sets.
    """

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []
        self.at_room: dict[int, set[int]] = {}
        self.holders: dict[tuple[int, int, int], set[int]] = {}
        self.masks: dict[tuple[int, int], int] = {}

    def best_fit(self) -> None:
        """Longest first, each into the fullest sequence that takes it."""
        rooms, stacks = 0, {}
        for i in sorted(range(len(self.lengths)), key=self.lengths.__getitem__, reverse=True):
            length = self.lengths[i]
            fits = rooms >> length
            if fits:
                room = length + (fits & -fits).bit_length() - 1
                b = stacks[room].pop()
                if not stacks[room]:
                    rooms ^= 1 << room
                self.items[b].append(i)
                self.fill[b] += length
            else:
                b, room = len(self.items), self.capacity
                self.items.append([i])
                self.fill.append(length)
            room -= length
            if room:
                stacks.setdefault(room, []).append(b)
                rooms |= 1 << room

    def _sums(self, b: int) -> tuple[set[int], set[int]]:
        held = sorted(self.lengths[i] for i in self.items[b])
        pairs = {held[k] + held[m] for k in range(len(held)) for m in range(k) if k == m + 1 or held[m] != held[m + 1]}
        return set(held), pairs

    def enter(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        if not room:
            return
        self.at_room.setdefault(room, set()).add(b)
        for size, sums in enumerate(self._sums(b), 1):
            for s in sums:
                self.holders.setdefault((size, room, s), set()).add(b)
                self.masks[size, room] = self.masks.get((size, room), 0) | 1 << s

    def leave(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        if not room:
            return
        self.at_room[room].discard(b)
        if not self.at_room[room]:
            del self.at_room[room]
        for size, sums in enumerate(self._sums(b), 1):
            for s in sums:
                some = self.holders[size, room, s]
                some.discard(b)
                if not some:
                    del self.holders[size, room, s]
                    self.masks[size, room] ^= 1 << s

    def _best(self, giver: int) -> tuple[int, list[int], int, int, int] | None:
        """(how much the giver shrinks, its pieces that go, receiver, lengths that come back as size and sum)."""
        items = self.items[giver]
        by_length = {self.lengths[i]: i for i in items}
        rooms = sorted(self.at_room, reverse=True)
        if not rooms:
            return None
        best = None
        # Only steps that raise the sum of squared fills: the receiver must end above where the giver began,
        # so its room may exceed what the giver gives by less than this.
        spare = self.capacity - self.fill[giver]
        # Moves: the longest piece that fits anywhere, into the least room that takes it.
        for length in sorted(by_length, reverse=True):
            fitting = [r for r in rooms if r >= length]
            if fitting and fitting[-1] < length + spare:
                return length, [by_length[length]], next(iter(self.at_room[fitting[-1]])), 0, 0
        gives = [([i], length, (1, 2)) for length, i in by_length.items()]
        held = sorted(items, key=self.lengths.__getitem__)
        pairs = {self.lengths[a] + self.lengths[b]: [a, b] for k, a in enumerate(held) for b in held[:k]}
        gives += [(two, length, (1,)) for length, two in pairs.items()]
        for room in rooms:
            if best and best[0] >= room:
                break  # a receiver takes no more than its room
            for going, length, sizes in gives:
                low = max(1, length - room)
                for size in sizes:
                    back = self.masks.get((size, room), 0) >> low
                    if back:
                        s = low + (back & -back).bit_length() - 1
                        shrinks = length - s
                        if 0 < shrinks and room < shrinks + spare and (not best or shrinks > best[0]):
                            best = shrinks, going, next(iter(self.holders[size, room, s])), size, s
        return best

    def _returned(self, b: int, size: int, total: int) -> list[int]:
        held = {}
        for i in self.items[b]:
            if size == 1 and self.lengths[i] == total:
                return [i]
            if size == 2:
                if total - self.lengths[i] in held:
                    return [held[total - self.lengths[i]], i]
                held[self.lengths[i]] = i
        return []

    def empty_out(self, giver: int) -> bool:
        """Give away what the giver holds, step by step; it is entered again if something stays."""
        self.leave(giver)
        while self.items[giver]:
            step = self._best(giver)
            if step is None:
                break
            shrinks, going, receiver, size, total = step
            self.leave(receiver)
            back = self._returned(receiver, size, total)
            self.items[giver] = [i for i in self.items[giver] if i not in going] + back
            self.items[receiver] = [i for i in self.items[receiver] if i not in back] + going
            self.fill[giver] -= shrinks
            self.fill[receiver] += shrinks
            self.enter(receiver)
        if self.items[giver]:
            self.enter(giver)
        return not self.items[giver]

    def search(self, least: int) -> None:
        n = len(self.items)
        for b in range(n):
            self.enter(b)
        failures, tried = 0, set()
        while n > least and failures < PATIENCE:
            givers = [b for bs in self.at_room.values() for b in bs if b not in tried]
            if not givers:
                break
            for b in sorted(givers, key=lambda b: (self.fill[b], b))[: PATIENCE]:
                if n <= least or failures >= PATIENCE:
                    break
                if b not in self.at_room.get(self.capacity - self.fill[b], ()):
                    continue  # filled up meanwhile
                if self.empty_out(b):
                    n, failures = n - 1, 0
                else:
                    failures += 1
                    tried.add(b)


def packed(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Sequences of the numbers of pieces, each piece once and none above `capacity`."""
    bins = Bins(lengths, capacity)
    bins.best_fit()
    least = lower_bound(np.asarray(lengths, np.int64), capacity) if lengths else 0
    if len(bins.items) > least:
        bins.search(least)
    return [x for x in bins.items if x]


COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "doc_tokens"]
SCHEMA = "doc_id {id}, piece int, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean"


def _placed(held: list[pa.RecordBatch], seq: int, capacity: int) -> tuple[int, pa.RecordBatch]:
    """The pieces of a block with their sequences; `open` where a sequence is to be packed again."""
    table = pa.Table.from_batches(held).combine_chunks()
    lengths = table.column("length").to_numpy()
    rows, seqs, offsets, is_open = [], [], [], []
    short = np.flatnonzero(lengths < capacity)
    whole = np.flatnonzero(lengths >= capacity)
    rows += whole.tolist()
    seqs += range(seq, seq + len(whole))
    offsets += [0] * len(whole)
    is_open += [False] * len(whole)
    seq += len(whole)
    sizes = lengths[short].tolist()
    for items in packed(sizes, capacity):
        at = 0
        for i in items:
            rows.append(int(short[i]))
            seqs.append(seq)
            offsets.append(at)
            at += sizes[i]
        is_open += [at < capacity * OPEN_BELOW] * len(items)
        seq += 1
    taken = table.take(pa.array(rows, pa.int64()))
    arrays = [c.combine_chunks() for c in taken.columns]
    arrays = [a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in arrays]
    return seq, pa.RecordBatch.from_arrays(
        [*arrays, pa.array(seqs, pa.int64()), pa.array(offsets, pa.int64()), pa.array(is_open, pa.bool_())], names=[*COLUMNS, "sequence_id", "offset", "open"])


def _pieces(ids_of: pa.Array, ids: np.ndarray, at: np.ndarray, capacity: int) -> pa.RecordBatch:
    """Pieces of documents whose ids lie end to end."""
    sizes = np.diff(at)
    n = -(-sizes // capacity)
    head = sizes - (n - 1) * capacity
    row = np.repeat(np.arange(len(sizes)), n)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
    length = np.where(piece == 0, head[row], capacity)
    raw = ids.astype("<u4")
    first = at[:-1][row] + start
    crc = [zlib.crc32(raw[a : a + k]) for a, k in zip(first.tolist(), length.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [ids_of.take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(sizes[row])],
        names=COLUMNS)


def pack(df: DataFrame, vocabulary: str, store: TableStore, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    schema = SCHEMA.format(id=rows.schema["doc_id"].dataType.simpleString())

    def first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from skysift.llm.byte_tokens import byte_ids

        coder, seq, held, n_held = byte_ids(vocabulary), TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            for i, j, buf, offs in blocks(batch.column(1)):
                ids, at = coder.encode(buf, offs, end_id)
                held.append(_pieces(batch.column(0).slice(i, j - i), ids, at, capacity))
                n_held += len(ids)
                if n_held >= block_tokens:
                    seq, out = _placed(held, seq, capacity)
                    yield out
                    held, n_held = [], 0
        if held:
            yield _placed(held, seq, capacity)[1]

    def next_level(level: int):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seq, held, n_held = level << 57 | TaskContext.get().partitionId() << 33, [], 0
            for batch in batches:
                held.append(batch)
                n_held += sum(batch.column(3).to_pylist())
                if n_held >= 4 * block_tokens:
                    seq, out = _placed(held, seq, capacity)
                    yield out
                    held, n_held = [], 0
            if held:
                yield _placed(held, seq, capacity)[1]
        return work

    level, out = 1, store.write(rows.mapInArrow(first_level, schema), "level-1")
    done = out.filter("not open")
    while True:
        open_ = out.filter("open")
        tokens = open_.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        groups = -(-tokens // block_tokens)
        if not groups or level > 1 and 2 * groups > last:
            break
        order = [F.desc("length"), F.asc("doc_id"), F.asc("piece"), F.asc("ids_crc32")]
        dealt = open_.select(*COLUMNS).repartition(groups, F.xxhash64("doc_id", "piece", "ids_crc32") if groups > 1 else F.lit(0)).sortWithinPartitions(*order)
        level, last = level + 1, groups
        out = store.write(dealt.mapInArrow(next_level(level), schema), f"level-{level}")
        done = done.unionByName(out.filter("not open"))
        if groups == 1:
            open_ = out.filter("open")
            break
    return done.unionByName(open_).drop("open")
