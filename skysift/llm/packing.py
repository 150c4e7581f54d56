"""Packing token pieces of documents into fixed windows by minimum bin slack.

Each task tokenizes its own rows and packs them in blocks of PACK_TOKENS
tokens, so nothing is shuffled, memory is bounded, and a lost task makes the
same pieces again. Documents longer than a window give full windows; what
remains of each is an item. A window takes the longest item and, by subset sums
over the multiset of remaining lengths held as one bitset, the counts per
length that come closest to its capacity. If that leaves a slack, the head of
one more item fills it. The last tokens of a block are cut at powers of two, the
lengths that need no padding.

Defined results: a null or empty text is the end id alone; null ids are kept;
repeated rows are packed as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from skysift.llm.arrays import blocks

CAPACITY = 4096
END_ID = 2
# Tokens packed together: some 1,000 windows, of which at most 12 are short ones.
PACK_TOKENS = 1 << 22

Piece = tuple[int, int, int]  # item, start within the item, length


def closest_fill(lengths: list[int], counts: dict[int, int], target: int) -> dict[int, int]:
    """How many items of each length to take so that their sum is the largest one not above target.

    `lengths` ascend. Bit s of `reach` says that sum s can be made; counts are split into powers of two.
    """
    reach, steps, full = 1, [], 1 << target
    keep = (full << 1) - 1
    for at in range(bisect.bisect_right(lengths, target) - 1, -1, -1):
        length = lengths[at]
        left, k = min(counts[length], target // length), 1
        while left:
            k = min(k, left)
            left -= k
            steps.append((length, k, reach))
            reach = (reach | reach << (length * k)) & keep
            if reach & full:
                break
            k *= 2
        if reach & full:
            break
    total = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + k
            total -= length * k
    return taken


def pack_lengths(sizes: list[int], capacity: int = CAPACITY) -> list[list[Piece]]:
    """Windows of pieces that cover every item of 1 to `capacity` tokens exactly once."""
    items: dict[int, list[tuple[int, int]]] = {}
    for i, size in enumerate(sizes):
        items.setdefault(size, []).append((i, 0))
    for stack in items.values():
        stack.reverse()
    counts = {length: len(stack) for length, stack in items.items()}
    lengths = sorted(counts)
    left = sum(sizes)
    windows: list[list[Piece]] = []

    def take(length: int) -> tuple[int, int]:
        item = items[length].pop()
        counts[length] -= 1
        if not counts[length]:
            del lengths[bisect.bisect_left(lengths, length)]
        return item

    def give(length: int, item: tuple[int, int]) -> None:
        if not counts.get(length):
            bisect.insort(lengths, length)
            items.setdefault(length, [])
            counts[length] = 0
        items[length].append(item)
        counts[length] += 1

    while left > capacity:
        longest = lengths[-1]
        window = [(*take(longest), longest)]
        room = capacity - longest
        if room:
            for length, n in closest_fill(lengths, counts, room).items():
                window += [(*take(length), length) for _ in range(n)]
                room -= length * n
        if room:
            # No set fills the window: every item left is longer than the slack, so one is cut.
            length = lengths[-1]
            item, start = take(length)
            window.append((item, start, room))
            give(length - room, (item, start + room))
        windows.append(window)
        left -= capacity
    rest = [(*take(length), length) for length in lengths[::-1] for _ in range(counts[length])]
    for bit in range(left.bit_length() - 1, -1, -1):
        room = left & 1 << bit
        window = []
        while room:
            item, start, length = rest.pop(0)
            used = min(length, room)
            window.append((item, start, used))
            if used < length:
                rest.insert(0, (item, start + used, length - used))
            room -= used
        if window:
            windows.append(window)
    return windows


def pack(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if asked for.

    `sequence_id` is unique over the result: the task's number and a count within it.
    """
    rows = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from skysift.llm.tokens import word_ids

        coder = word_ids(vocabulary)
        base = TaskContext.get().partitionId() << 40
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        n_held = 0
        for batch in batches:
            for i, j, buf, offs in blocks(batch.column(1)):
                ids, at = coder.encode(buf, offs, end_id)
                held.append((batch.column(0).slice(i, j - i), ids, at))
                n_held += len(ids)
                if n_held >= PACK_TOKENS:
                    out = packed(held, base)
                    base = int(out[0])
                    yield out[1]
                    held, n_held = [], 0
        if held:
            yield packed(held, base)[1]

    def packed(held, base) -> tuple[int, pa.RecordBatch]:
        doc = pa.chunked_array([h[0] for h in held]).combine_chunks()
        sizes = np.concatenate([np.diff(h[2]) for h in held])
        begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        ids = np.concatenate([h[1] for h in held]).astype("<u4")
        cols: dict[str, list[int]] = {k: [] for k in ("row", "start", "length", "seq", "offset")}

        def add(row, start, length, seq, offset):
            for k, v in zip(cols, (row, start, length, seq, offset), strict=True):
                cols[k].append(int(v))

        seq = base
        for row in np.flatnonzero(sizes >= capacity):
            for start in range(0, int(sizes[row]) - capacity + 1, capacity):
                add(row, start, capacity, seq, 0)
                seq += 1
        rows_left = np.flatnonzero(sizes % capacity)
        head = sizes[rows_left] - sizes[rows_left] % capacity
        for window in pack_lengths((sizes[rows_left] % capacity).tolist(), capacity):
            offset = 0
            for item, start, length in window:
                add(rows_left[item], head[item] + start, length, seq, offset)
                offset += length
            seq += 1
        row, start, length = (np.asarray(cols[k], np.int64) for k in ("row", "start", "length"))
        a = begin[row] + start
        arrays = [
            doc.take(pa.array(row)), pa.array(start), pa.array(length),
            pa.array([zlib.crc32(ids[x : x + n]) for x, n in zip(a.tolist(), length.tolist(), strict=True)], pa.int64()),
            pa.array(sizes[row], pa.int64()), pa.array(cols["seq"], pa.int64()), pa.array(cols["offset"], pa.int64()),
        ]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            arrays.append(pa.array([ids[x : x + n].astype(np.int32) for x, n in zip(a.tolist(), length.tolist(), strict=True)], pa.list_(pa.int32())))
            names.append("ids")
        return seq, pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(work, schema + (", ids array<int>" if with_ids else ""))
