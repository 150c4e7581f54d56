"""Judges: how a user's model, a rule or an existing score decides on groups of images.

A judge is a function from a DataFrame of groups to the same rows with a
decision. Groups hold run, round, grp, slot, id and the item columns; a decision
is `kept` 0/1 for retention and elimination, `score` for rating grids. A null
decision is a failed call. Token counts are optional. Rows with a null grp sit
the round out; they must come back, and whatever is decided on them is ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs, parquet
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Judge = Callable[[DataFrame], DataFrame]

GROUP = ["run", "round", "grp"]


class CallFailed(Exception):
    """A call that gave no usable answer."""


# What counts as a failed call. Anything else, as a TypeError or a KeyError, is a fault of the program and ends the job.
FAILURES = (CallFailed, OSError, RuntimeError, ValueError)


class CallLedger:
    """Answers of finished calls, one file each, in a folder that all executors can reach.

    A task that runs again after its executor was lost, and a run that goes on
    where it stopped, read the answer instead of calling again. A file is moved to
    its name when it is whole. Failed calls are not written, so they are tried again.
    The folder is opened by pyarrow in the tasks: a plain path or a URI it knows.
    """

    def __init__(self, root: str):
        self.root = re.sub("^file:/+", "/", root)

    def _place(self, key: tuple[int, int, int]) -> tuple[fs.FileSystem, str]:
        system, root = fs.FileSystem.from_uri(self.root)
        run, round_, grp = key
        # Folders of some thousand calls each.
        return system, f"{root}/run={run}/round={round_}/part={grp // 4096}/{grp}.parquet"

    def find(self, key: tuple[int, int, int]) -> pd.DataFrame | None:
        system, path = self._place(key)
        if system.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with system.open_input_file(path) as f:
            return parquet.read_table(f).to_pandas()

    def add(self, key: tuple[int, int, int], answer: pd.DataFrame) -> None:
        system, path = self._place(key)
        folder, _, name = path.rpartition("/")
        system.create_dir(folder, recursive=True)
        draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as f:
            parquet.write_table(pa.Table.from_pandas(answer, preserve_index=False), f)
        system.move(draft, path)


def with_tokens(df: DataFrame) -> DataFrame:
    for c in ("input_tokens", "output_tokens"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(0).cast("bigint"))
    return df


def rule_judge(decision: Column, out: str = "kept") -> Judge:
    """Judge given by a column expression over one row."""
    return lambda groups: with_tokens(groups.withColumn(out, decision))


def best_of_pair(strength: Column) -> Judge:
    """The stronger image of each pair wins; the lower slot wins a tie."""

    def judge(groups: DataFrame) -> DataFrame:
        # A pair is two rows, so the window is small and the check of winners reuses its shuffle.
        rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(strength.desc(), "slot"))
        return with_tokens(groups.withColumn("kept", F.when(rank == 1, 1).otherwise(0)))

    return judge


def model_judge(
    call: Callable[[pd.DataFrame], pd.DataFrame], columns: list[str], decision: str = "kept", *, retries: int = 0,
    failures: tuple[type[Exception], ...] = FAILURES, ledger: CallLedger | None = None,
) -> Judge:
    """Judge given by a Python call on one group of images.

    `call` takes a group in slot order with `columns` and returns slot, the
    decision and optionally input_tokens and output_tokens; or a pair of such a frame
    and the call's tokens by name, so that a call that selects nothing counts. Whole groups are
    gathered into one row each, so Spark spreads the calls over tasks and Arrow
    moves many groups at a time. A call that raises one of `failures` leaves the group
    undecided; any other error ends the job. With a `ledger` each answer is written as
    soon as it is there, and a group that has one is not called for again.
    """
    schema = f"run int, round int, grp bigint, slot int, {decision} int, input_tokens bigint, output_tokens bigint"

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["run", "round", "grp", "slot", decision, "input_tokens", "output_tokens"]
        for batch in batches:
            outs = []
            for run, round_, grp, rows in zip(batch["run"], batch["round"], batch["grp"], batch["rows"]):
                known = ledger.find((run, round_, grp)) if ledger else None
                if known is not None:
                    outs.append(known[names])
                    continue
                group = pd.DataFrame([dict(r) if isinstance(r, dict) else r.asDict() for r in rows])
                group = group.sort_values("slot").reset_index(drop=True)
                found = None
                for _ in range(retries + 1):
                    try:
                        found = call(group)
                        break
                    except failures:
                        continue
                answered = found is not None
                found, spent = found if isinstance(found, tuple) else (found, {})
                found = pd.DataFrame(columns=["slot", decision]) if found is None else found
                # The tokens of a call stand on all rows of its group, whatever it selects.
                for c in ("input_tokens", "output_tokens"):
                    most = found[c].max() if c in found and len(found) else None
                    spent = {c: 0 if pd.isna(most) else int(most), **spent}
                chosen = found.reindex(columns=["slot", decision]).astype({"slot": "int64"})
                found = group[["slot"]].merge(chosen, on="slot", how="left").assign(run=run, round=round_, grp=grp, **spent)
                if ledger and answered:
                    ledger.add((run, round_, grp), found[names].astype({decision: "Int32"}))
                outs.append(found[names])
            if outs:
                out = pd.concat(outs)
                out[decision] = out[decision].astype("Int32")
                yield out

    def judge(groups: DataFrame) -> DataFrame:
        # A group is at most the size of one grid.
        packed = groups.filter(F.col("grp").isNotNull()).groupBy(*GROUP).agg(F.collect_list(F.struct("slot", *columns)).alias("rows"))
        found = packed.mapInPandas(decide, schema)
        if decision == "kept":
            found = found.drop_duplicates([*GROUP, "slot"])
        return groups.join(found, [*GROUP, "slot"], "left")

    return judge


def model_verdicts(call: Callable[[str, str], tuple[bool, str]], *, failures: tuple[type[Exception], ...] = FAILURES) -> Judge:
    """Verdict judge given by a Python call on (object name, payload) -> (verdict, reason).

    A call that raises one of `failures` gives no verdict; any other error ends the job.
    """

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, payload in zip(batch["object_name"], batch["payload"]):
                try:
                    rows.append((name, *call(name, payload)))
                except failures:
                    rows.append((name, None, None))
            yield pd.DataFrame(rows, columns=["object_name", "genuinely_discussed", "reasoning"])

    schema = "object_name string, genuinely_discussed boolean, reasoning string"
    return lambda payloads: payloads.select("object_name", "payload").mapInPandas(decide, schema)
