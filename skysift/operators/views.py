"""Selections, orders and counters of the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.functions.numbers import at_least
from skysift.operators.literature import is_true
from skysift.operators.ordering import stacked

EXEMPT_SOURCE = "HF"  # fixed value: matches that come from a paper need no verdict


def text_matches(haystack: str, query: str) -> Column:
    return F.col(haystack).contains(query.strip().lower())


def score_is(score: str, which: str) -> Column:
    if which == "all":
        return F.lit(True)
    return F.col(score) > 0 if which == "nonzero" else F.col(score) == 0


def status_is(which: str) -> Column:
    """unidentified-checked / -unchecked / -reclassified, matched-<source>, all."""
    open_item = (F.col("status") == "unidentified") & ~F.col("reclassified")
    if which == "all":
        return F.lit(True)
    if which == "unidentified-checked":
        return open_item & (F.col("checked_ned") == 1)
    if which == "unidentified-unchecked":
        return open_item & (F.col("checked_ned") != 1)
    if which == "unidentified-reclassified":
        return F.col("reclassified")
    if which.startswith("matched-"):
        return (F.col("status") == "matched") & (F.lower("matched_source") == which.split("-", 1)[1].lower())
    raise ValueError(f"unknown status {which!r}")


def class_is(label: str, name: str | None) -> Column:
    """Class equal to a name, or no class for None."""
    value = F.coalesce(F.col(label), F.lit(""))
    return value == "" if name is None else value == name


def truth_is(truth: str, value: int) -> Column:
    return F.col(truth).cast("int") == value


def selected_by(expert: str, column: str = "selected_by") -> Column:
    return F.array_contains(column, expert)


def expert_positive(threshold: float = 0.4, strict: bool = False) -> Column:
    return at_least("expert_score", threshold, strict)


def format_in(*formats: str) -> Column:
    """Runs of chosen test formats."""
    return F.col("format").isin(*formats)


def exclude(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Rows that are not among the few-shot examples."""
    return rows.join(names.select(key), key, "left_anti")


def report_set(rows: DataFrame, n: int, *, score: str = "score", id_col: str = "image", truth: str = "truth") -> DataFrame:
    """The top n rows by score, and every interesting one."""
    order = [F.col(score).desc(), F.col(id_col)]
    top = rows.orderBy(*order).limit(n).select(id_col, F.lit(True).alias("in_top"))
    marked = rows.join(top, id_col, "left").withColumn("in_top", F.coalesce("in_top", F.lit(False)))
    return marked.filter(F.col("in_top") | truth_is(truth, 1))


def combined_status(unidentified: DataFrame, matched: DataFrame) -> DataFrame:
    """Unidentified and matched rows in one table with their status."""
    a = unidentified.withColumn("status", F.lit("unidentified"))
    b = matched.withColumn("status", F.lit("matched")).withColumn("checked_ned", F.lit(0))
    rows = stacked([a, b])
    for c in ("matched_source", "object_name"):
        rows = rows.withColumn(c, F.coalesce(c, F.lit("")))
    return rows


def apply_verdicts(rows: DataFrame, verdicts: DataFrame, exempt: str = EXEMPT_SOURCE) -> DataFrame:
    """Matched rows no paper discusses become unidentified; objects without a verdict stay."""
    said = verdicts.select("object_name", is_true("genuinely_discussed").alias("_yes"), F.col("reasoning").alias("_why"))
    joined = rows.join(said, "object_name", "left")
    demoted = (F.col("status") == "matched") & (F.col("matched_source") != exempt) & F.coalesce(~F.col("_yes"), F.lit(False))
    return (
        joined.withColumn("reclassified", demoted)
        .withColumn("not_discussed_reasoning", F.when(demoted, F.col("_why")))
        .withColumn("status", F.when(demoted, "unidentified").otherwise(F.col("status")))
        .drop("_yes", "_why")
    )


def report_counters(rows: DataFrame, bibliography: DataFrame, id_col: str = "filename") -> DataFrame:
    """Totals of the unidentified report in one row."""
    with_papers = bibliography.select(F.col(id_col)).distinct().withColumn("_has", F.lit(1))
    joined = rows.join(with_papers, id_col, "left")
    open_item = F.col("status") == "unidentified"
    return joined.agg(
        F.count("*").alias("total"),
        F.count(F.when(open_item, 1)).alias("unidentified"),
        F.count(F.when(~open_item, 1)).alias("matched"),
        F.count(F.when(open_item & (F.col("checked_ned") == 1), 1)).alias("checked"),
        F.count(F.when(open_item & (F.col("checked_ned") != 1), 1)).alias("unchecked"),
        F.count(F.when(F.col("reclassified"), 1)).alias("reclassified"),
        F.count("_has").alias("with_bibliography"),
        F.coalesce(F.avg("avg_score"), F.lit(0.0)).alias("avg_score"),
        F.coalesce(F.max("avg_score"), F.lit(0.0)).alias("max_score"),
    )


def with_top_score(rows: DataFrame, score: str, out: str = "top_score") -> DataFrame:
    """Rows with the highest score of all, from a one-row aggregate."""
    top = rows.agg(F.coalesce(F.max(score), F.lit(0)).alias(out))
    return rows.crossJoin(F.broadcast(top))  # one row


def by_references(rows: DataFrame, refs: str = "ref_count", score: str = "avg_score", id_col: str = "filename") -> DataFrame:
    return rows.orderBy(F.col(refs).desc(), F.col(score).desc(), id_col)


def by_score(rows: DataFrame, score: str, id_col: str) -> DataFrame:
    return rows.orderBy(F.col(score).desc(), id_col)


def bibliography_order(rows: DataFrame, id_col: str = "filename", year: str = "year") -> DataFrame:
    return rows.orderBy(id_col, F.coalesce(F.col(year), F.lit(0)), "bibcode")


def first_rows(rows: DataFrame, n: int, ordinal: str, fields: list[str]) -> DataFrame:
    """The first n rows of a catalog in file order with the fields shown."""
    return rows.orderBy(ordinal).limit(n).select(*fields)


def missing_and_extra(expected: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    a, b = expected.select(key), seen.select(key)
    return a.subtract(b).withColumn("problem", F.lit("missing")).unionByName(
        b.subtract(a).withColumn("problem", F.lit("extra"))
    )


def all_ids(frames: list[DataFrame], key: str) -> DataFrame:
    return stacked([f.select(key) for f in frames]).distinct()
