"""Cross-match cascade: each catalog sees only what the ones before left unmatched."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.operators.skyjoin import best_in_cone
from skysift.session import TableStore

# Columns a match adds, with the type a missing value has.
MATCH_COLUMNS = {
    "object_name": "string",
    "object_type": "string",
    "ref_count": "bigint",
    "redshift": "double",
    "arxiv_url": "string",
    "summary": "string",
}


@dataclass
class Catalog:
    """One step of a cascade.

    `df` has ra, dec and an id. `columns` gives the match columns it fills.
    `pick` is "nearest", or (column, descending) pairs that order the objects in the
    cone. `top_n` limits the step to the best-scored items.
    """

    name: str
    df: DataFrame
    radius: float
    id_col: str = "id"
    columns: dict[str, Column] = field(default_factory=dict)
    pick: str | list[tuple[Column | str, bool]] = "nearest"
    top_n: int | None = None


def cascade(
    items: DataFrame, catalogs: list[Catalog], *, id_col: str = "filename", score: str = "avg_score",
    store: TableStore | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(matched, unmatched) items. Items need id, score, ra and dec.

    Matched rows gain matched_source and MATCH_COLUMNS; unmatched rows gain one
    checked_<catalog> flag per step. Each step is written once, so that no step
    is computed again by the ones after it.
    """
    store = store or TableStore(items.sparkSession)
    blank = [F.lit(None).cast(t).alias(c) for c, t in MATCH_COLUMNS.items()]
    done = None
    if not catalogs:
        raise ValueError("a cascade needs at least one catalog")
    left = items.select("*", F.lit(None).cast("string").alias("matched_source"), *blank)
    for n, cat in enumerate(catalogs):
        flag = f"checked_{cat.name.lower()}"
        if cat.top_n is None:
            todo = left.withColumn(flag, F.lit(1))
        else:
            best = left.orderBy(F.col(score).desc(), F.col(id_col)).limit(cat.top_n).select(id_col, F.lit(1).alias(flag))
            todo = left.join(best, id_col, "left").fillna(0, [flag])
        found = _matches(todo.filter(F.col(flag) == 1), cat, id_col)
        step = todo.drop("matched_source", *MATCH_COLUMNS).join(found, id_col, "left")
        step = store.write(step, f"step{n}")
        hits = step.filter(F.col("matched_source").isNotNull())
        done = hits if done is None else done.unionByName(hits, allowMissingColumns=True)
        left = step.filter(F.col("matched_source").isNull())
    matched = done.select(*items.columns, "matched_source", *MATCH_COLUMNS)
    return matched, left.drop("matched_source", *MATCH_COLUMNS)


def _matches(items: DataFrame, cat: Catalog, id_col: str) -> DataFrame:
    """One chosen catalog row per item: the item's id and the match columns."""
    filled = [cat.columns.get(c, F.lit(None)).cast(t).alias(f"_m_{c}") for c, t in MATCH_COLUMNS.items()]
    order = [] if cat.pick == "nearest" else cat.pick
    ranks = [(F.col(c) if isinstance(c, str) else c).alias(f"_o{i}") for i, (c, _) in enumerate(order)]
    side = cat.df.select(F.col(cat.id_col).alias("_cat"), "ra", "dec", *filled, *ranks)
    by = [(f"_o{i}", down) for i, (_, down) in enumerate(order)]
    best = best_in_cone(
        items, side, cat.radius, by or None, left_id=id_col, right_id="_cat", keep=side.columns[3:],
    )
    return best.select(
        F.col("left_id").alias(id_col), F.lit(cat.name).alias("matched_source"),
        *[F.col(f"_m_{c}").alias(c) for c in MATCH_COLUMNS],
    )
