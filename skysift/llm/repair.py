"""Repair of conversation structure by weighted interval parsing.

A conversation should read as an optional system turn and then user and
assistant turns in pairs: `(s?(ua)+)?` over the initials of its roles. Edits have
costs: keep a row (0), give it the role user or assistant (3), delete it (4), insert
an empty row (3); a truncated row that is not deleted adds 3.

The grammar, in Chomsky normal form, has a symbol X(p, q) for "what leads from
state p to state q" of that pattern, the rules X(p, q) -> X(p, r) X(r, q) for every
r, and one terminal rule for each edit of a row. Insertions read no row: their
closure is joined to each row's cell from the left and once at the end. The cell
of a span holds, for each symbol, the least (cost, audit), where the audit is the
edits' initials; cells are combined bottom-up by span length. As these rules
exist for every middle state, a span's cell is the same from whichever split, so
one split a span is enough and n rows need n - 1 cells instead of their square; a
test holds this against the chart over all splits. Least audits join to least
audits: of two equally dear edit strings over the same rows, neither can begin
the other.

At scale: rows are range-partitioned by (conversation, turn), so a conversation
that holds a third of all rows is spread over many tasks. Each task's stretch of
a conversation is one span, whose cell (16 costs and audits) is all that leaves
the task; the cells of a conversation are then combined in order, and every
stretch gets its part of the audit back to rewrite its own rows. Texts are never
gathered; a digest reads them as a stream.

Defined results: null conversation ids are one conversation; a null role or text
is one space; rows of one turn follow by role and text; null turns come first; a
role that starts with none of s, u, a can't be kept; repeated rows are duplicates
after the first; a conversation without rows has zeros and an empty audit; an empty
table gives no rows. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.session import TableStore

SPACE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# Of every 20 (conversation, turn) one is dropped, emptied, stripped of sentence ends, repeated, made a user's.
DAMAGES = 20

# States: 0 nothing yet, 1 after the system turn, 2 after a user's, 3 after an assistant's turn.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, FINAL = range(4), (0, 3)
ROLES = {"u": "user", "a": "assistant"}
MUST_DELETE, OTHER = "x", "o"

Cell = tuple[tuple[int, int, int, str], ...]  # (from state, to state, cost, audit), one for each reachable pair

# Spans up to this many rows are remembered by their kinds of rows: most conversations are short and alike.
REMEMBERED_SPAN = 8


def _least(found: list[tuple[int, int, int, str]]) -> Cell:
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for p, q, cost, audit in found:
        old = best.get((p, q))
        if old is None or (cost, audit) < old:
            best[p, q] = cost, audit
    return tuple((p, q, *value) for (p, q), value in sorted(best.items()))


def joined(left: Cell, right: Cell) -> Cell:
    """Cell of two neighbouring spans."""
    return _least([(p, q, a + c, b + d) for p, r, a, b in left for s, q, c, d in right if r == s])


def _closure() -> Cell:
    """Insertions alone, any number of them."""
    one = [(p, q, INSERT, "I") for (p, r), q in STEPS.items() if r in ROLES]
    cell = _least([(p, p, 0, "") for p in STATES])
    for _ in STATES:
        cell = _least([*cell, *joined(cell, _least(one))])
    return cell


INSERTIONS = _closure()


@functools.cache
def row_cell(kind: str) -> Cell:
    """Edits of one row of a kind: the initial of its role, a capital if it is truncated, or x if it must go."""
    found = [(p, p, DELETE, "D") for p in STATES]
    if kind != MUST_DELETE:
        extra = TRUNCATED if kind.isupper() else 0
        for (p, r), q in STEPS.items():
            if r == kind.lower():
                found.append((p, q, extra, "K"))
            if r in ROLES:
                found.append((p, q, REROLE + extra, "R"))
    return joined(INSERTIONS, _least(found))


@functools.lru_cache(1 << 16)
def _short_span(kinds: str) -> Cell:
    if len(kinds) == 1:
        return row_cell(kinds)
    half = len(kinds) // 2
    return joined(_short_span(kinds[:half]), _short_span(kinds[half:]))


def combined(cells: list[Cell]) -> Cell:
    """Neighbours joined in pairs, level by level, until one span is left."""
    while len(cells) > 1:
        pairs = [joined(a, b) for a, b in zip(cells[::2], cells[1::2], strict=False)]
        cells = pairs + cells[len(cells) - len(cells) % 2 :]
    return cells[0]


def span_cell(kinds: str) -> Cell:
    return combined([_short_span(kinds[k : k + REMEMBERED_SPAN]) for k in range(0, len(kinds), REMEMBERED_SPAN)])


def best_edits(cell: Cell) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    return min((cost, audit) for p, q, cost, audit in joined(cell, INSERTIONS) if p == 0 and q in FINAL)


def damaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text with seeded faults: rows dropped, emptied, truncated, repeated, given to the user."""
    key = F.concat(F.coalesce(df[conv_col].cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(df[turn_col].cast("string"), F.lit(" ")))
    rows = df.select(
        df[conv_col].alias("conv_id"), df[turn_col].alias("turn"), F.coalesce(df[role_col], F.lit(" ")).alias("role"),
        F.coalesce(df[text_col], F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % DAMAGES).alias("_damage"),
    ).filter(F.col("_damage") != 0)
    damage = F.col("_damage")
    copies = F.explode(F.sequence(F.lit(1), F.when(damage == 3, 2).otherwise(1)))
    return rows.select(
        "conv_id", "turn", F.when(damage == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(damage == 1, "").when(damage == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        copies.alias("_copy"),
    ).drop("_copy")


SUMMARY = ("conv_id {conv}, segment long, n_rows long, blank long, duplicate long, truncated long, illegal long, first_initial string, "
           "last_initial string, min_turn long, max_turn long, n_turns long, cells array<struct<p:int,q:int,cost:long,audit:string>>")


def segments(rows: DataFrame, store: TableStore) -> tuple[DataFrame, DataFrame]:
    """The rows in order, with their fault and place, and the summary of each task's stretch of a conversation."""
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    content = F.rtrim(F.col("text"), F.lit(SPACE))
    last = F.substring(content, -1, 1)
    parts = [F.col("conv_id").isNull().cast("string"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.length("role").cast("string"),
             F.col("role"), F.col("text")]
    rows = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", (content == "").alias("blank"),
        (~last.isin(".", "!", "?")).alias("truncated"), F.md5(F.concat_ws("\n", *parts)).alias("digest"),
    )
    # A repeat at a later turn: only texts that occur again are joined, equal rows of one turn are told apart below.
    seen = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct(F.col("turn").isNotNull().alias("set"), "turn")).alias("first"))
    again = seen.filter("n > 1").select("digest", F.col("first.turn").alias("_first"), F.lit(True).alias("_again"))
    marked = rows.join(again, "digest", "left").withColumn("later", F.coalesce("_again", F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("_first")))
    marked = store.write(marked.drop("_first", "_again"), "marked")
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    ordered = marked.select("conv_id", "turn", "role", "text", "blank", "truncated", "later", "digest")
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order)
    fields = pa.schema([("segment", pa.int64()), ("place", pa.int64())])
    summary_type = pa.struct([
        ("n_rows", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
        ("first_initial", pa.string()), ("last_initial", pa.string()), ("min_turn", pa.int64()), ("max_turn", pa.int64()), ("n_turns", pa.int64()),
        ("cells", pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, place = TaskContext.get().partitionId(), 0
        stretch: Stretch | None = None
        previous = None

        def closing(conv: pa.Array) -> pa.RecordBatch:
            nothing = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string())]
            return pa.RecordBatch.from_arrays(
                [conv, *nothing, pa.array([segment], fields[0].type), pa.array([-1], fields[1].type), pa.array([stretch.summary()], summary_type)],
                names=["conv_id", "turn", "role", "text", "segment", "place", "summary"])

        current: pa.Array | None = None
        for batch in batches:
            n = batch.num_rows
            convs, turns, roles = (batch.column(k).to_pylist() for k in range(3))
            blank, truncated, later, digests = (batch.column(k).to_pylist() for k in range(4, 8))
            for i in range(n):
                this = convs[i], turns[i], digests[i]
                if stretch is None or convs[i] != previous[0]:
                    if stretch is not None:
                        yield closing(current)
                    stretch, current = Stretch(), batch.column(0).slice(i, 1)
                stretch.add(turns[i], roles[i], blank[i], later[i] or this == previous, truncated[i])
                previous = this
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array([segment] * n, pa.int64()),
                 pa.array(range(place, place + n), pa.int64()), pa.nulls(n, summary_type)],
                names=["conv_id", "turn", "role", "text", "segment", "place", "summary"])
            place += n
        if stretch is not None:
            yield closing(current)

    summary = ("struct<n_rows:long,blank:long,duplicate:long,truncated:long,illegal:long,first_initial:string,last_initial:string,"
               "min_turn:long,max_turn:long,n_turns:long,cells:array<struct<p:int,q:int,cost:long,audit:string>>>")
    out = store.write(ordered.mapInArrow(work, f"conv_id {conv_type}, turn long, role string, text string, segment long, place long, summary {summary}"), "ordered")
    return out.filter("place >= 0").drop("summary"), out.filter("place < 0").select("conv_id", "segment", "summary")


class Stretch:
    """Counts and kinds of the rows of one conversation that one task has seen, in order."""

    def __init__(self) -> None:
        self.kinds: list[str] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.n_turns = 0
        self.first = self.last = self.min_turn = self.max_turn = None

    def add(self, turn: int | None, role: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        initial = role[:1]
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        self.last = initial
        if turn is not None and turn != self.max_turn:
            self.n_turns += 1
            self.min_turn = turn if self.min_turn is None else self.min_turn
            self.max_turn = turn
        kind = initial if initial in ("s", "u", "a") else OTHER
        if blank:
            self.blank += 1
            kind = MUST_DELETE
        elif duplicate:
            self.duplicate += 1
            kind = MUST_DELETE
        elif truncated:
            self.truncated += 1
            kind = kind.upper()
        self.kinds.append(kind)

    def summary(self) -> dict:
        cells = [dict(zip(("p", "q", "cost", "audit"), x, strict=True)) for x in span_cell("".join(self.kinds))]
        return {"n_rows": len(self.kinds), "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal,
                "first_initial": self.first, "last_initial": self.last, "min_turn": self.min_turn, "max_turn": self.max_turn,
                "n_turns": self.n_turns, "cells": cells}


def _split(audit: str, sizes: list[int]) -> list[str]:
    """The audit of each stretch of so many rows; insertions go with the row that follows, the last ones with the last stretch."""
    parts, at = [], 0
    for k, n in enumerate(sizes):
        start = at
        if k == len(sizes) - 1:
            at = len(audit)
        else:
            while n:
                n -= audit[at] != "I"
                at += 1
        parts.append(audit[start:at])
    return parts


def parsed(summaries: DataFrame, store: TableStore) -> DataFrame:
    """One row per conversation: its counts, cost and audit, and each stretch's part of the audit with the number of turns kept before it."""
    conv_type = summaries.schema["conv_id"].dataType.simpleString()
    one = summaries.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("segment", "summary"))).alias("stretches"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_type = pa.list_(pa.struct([("segment", pa.int64()), ("edits", pa.string()), ("written", pa.int64()), ("system", pa.bool_())]))
        names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
        for batch in batches:
            cols: dict[str, list] = {k: [] for k in [*names, "audit", "parts"]}
            for stretches in batch.column(1).to_pylist():
                all_ = [x["summary"] for x in stretches]
                cell = combined([tuple((c["p"], c["q"], c["cost"], c["audit"]) for c in x["cells"]) for x in all_])
                cost, audit = best_edits(cell)
                turns = [x for x in all_ if x["min_turn"] is not None]
                met = sum(a["max_turn"] == b["min_turn"] for a, b in zip(turns, turns[1:], strict=False))
                gaps = turns[-1]["max_turn"] - turns[0]["min_turn"] + 1 - (sum(x["n_turns"] for x in turns) - met) if turns else 0
                between = sum(a["last_initial"] + b["first_initial"] not in ("su", "ua", "au") for a, b in zip(all_, all_[1:], strict=False))
                parts, written, edits = [], 0, _split(audit, [x["n_rows"] for x in all_])
                # An odd number of turns can only be pairs after a system turn.
                system = sum(e != "D" for e in audit) % 2 == 1
                for x, part in zip(stretches, edits, strict=True):
                    parts.append({"segment": x["segment"], "edits": part, "written": written, "system": system})
                    written += sum(e != "D" for e in part)
                sums = {k: sum(x[k] for x in all_) for k in ("blank", "duplicate", "truncated", "illegal")}
                for k, v in {**sums, "illegal": sums["illegal"] + between, "gaps": gaps, "cost": cost, "audit": audit, "parts": parts}.items():
                    cols[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(cols[k], pa.int64()) for k in names], pa.array(cols["audit"], pa.string()), pa.array(cols["parts"], part_type)],
                names=["conv_id", *names, "audit", "parts"])

    schema = (f"conv_id {conv_type}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
              "parts array<struct<segment:long,edits:string,written:long,system:boolean>>")
    return store.write(one.mapInArrow(work, schema), "parsed")


def written_role(index: int, system: bool) -> str:
    """Role of the index-th turn (from 0) of a repaired conversation; of the system turn only its own."""
    return "assistant" if (index - system) % 2 else "user"


def repaired(rows: DataFrame, results: DataFrame) -> DataFrame:
    """The rows of every repaired conversation: conv_id, segment, place, step (their order), turn, role, text, edit (K, R or I)."""
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    plans = results.select("conv_id", F.explode("parts").alias("part")).select(
        "conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"),
        F.col("part.segment").alias("segment"), F.lit(-1).cast("long").alias("place"), F.col("part.edits").alias("edits"),
        F.col("part.written").alias("written"), F.col("part.system").alias("system"))
    both = rows.withColumns({"edits": F.lit(None).cast("string"), "written": F.lit(None).cast("long"), "system": F.lit(None).cast("boolean")}).unionByName(plans)
    both = both.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "place")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits, at, end, written, system = "", 0, 0, 0, False
        for batch in batches:
            places, plan, before, of_system = (batch.column(k).to_pylist() for k in (5, 6, 7, 8))
            roles = batch.column(2).to_pylist()
            take: list[int] = []
            text_at: list[int | None] = []
            steps, new_roles, kinds = [], [], []
            for i, place in enumerate(places):
                if place < 0:
                    edits, at, written, system = plan[i], 0, before[i], of_system[i]
                    end = len(edits.rstrip("I"))  # the insertions from here on follow the last row
                    continue
                step, done = 0, False
                while at < len(edits) and (not done or at >= end):
                    edit, done = edits[at], done or edits[at] != "I"
                    at += 1
                    if edit != "D":
                        take.append(i)
                        text_at.append(None if edit == "I" else i)
                        steps.append(step)
                        new_roles.append(roles[i] if edit == "K" else written_role(written, system))
                        kinds.append(edit)
                        step, written = step + 1, written + 1
            chosen = pa.array(take, pa.int64())
            own = pa.array(text_at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(chosen), batch.column(4).take(chosen), batch.column(5).take(chosen), pa.array(steps, pa.int32()),
                 batch.column(1).take(own), pa.array(new_roles, pa.string()), batch.column(3).take(own).fill_null(""), pa.array(kinds, pa.string())],
                names=["conv_id", "segment", "place", "step", "turn", "role", "text", "edit"])

    return both.select("conv_id", "turn", "role", "text", "segment", "place", "edits", "written", "system").mapInArrow(
        work, f"conv_id {conv_type}, segment long, place long, step int, turn long, role string, text string, edit string")


def digests(lines: DataFrame) -> DataFrame:
    """conv_id, sha256 of `role:text` of its rows joined by newlines; a stream of rows, of which one is held at a time."""
    conv_type = lines.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "segment", "place", "step"]
    ordered = lines.select(*order, F.concat("role", F.lit(":"), "text").alias("line")).repartition("conv_id").sortWithinPartitions(*order)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, conv, hasher = None, None, None

        def closing() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([current, pa.array([hasher.hexdigest()])], names=["conv_id", "repaired_sha256"])

        for batch in batches:
            for i, (this, line) in enumerate(zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                if hasher is None or this != conv:
                    if hasher is not None:
                        yield closing()
                    conv, current, hasher = this, batch.column(0).slice(i, 1), hashlib.sha256()
                else:
                    hasher.update(b"\n")
                hasher.update(line.encode())
        if hasher is not None:
            yield closing()

    return ordered.mapInArrow(work, f"conv_id {conv_type}, repaired_sha256 string")


def repair(rows: DataFrame, store: TableStore) -> tuple[DataFrame, DataFrame]:
    """(one row per conversation with its counts, cost and audit; the rows of the repaired conversations)."""
    ordered, summaries = segments(rows, store)
    results = parsed(summaries, store)
    return results, repaired(ordered, results)


def report(conversations: DataFrame, rows: DataFrame, store: TableStore) -> DataFrame:
    """Counts, cost, audit and digest of every conversation id of `conversations`, parsed from `rows`."""
    results, lines = repair(rows, store)
    ids = conversations.select("conv_id").distinct()
    found = results.drop("parts").withColumnRenamed("conv_id", "_conv")
    hashes = digests(lines).withColumnRenamed("conv_id", "_of")
    out = ids.join(found, ids["conv_id"].eqNullSafe(found["_conv"]), "left").join(hashes, ids["conv_id"].eqNullSafe(hashes["_of"]), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
