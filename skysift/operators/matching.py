"""Joins by name: metadata, file names in any spelling, truth restriction, resume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.functions import text
from skysift.functions.numbers import volunteer_rating
from skysift.operators.ordering import first_in

META_COLUMNS = ["RA", "Dec", "anomaly_score", "URL", "volunteer_rating"]


def metadata_lookup(subjects: DataFrame, ordinal: str | None = None) -> DataFrame:
    """Volunteer metadata by file stem; the last row of a stem wins."""
    name = text.strip("filename")
    rated = subjects.filter(name != "").withColumn("stem", text.stem(name)).withColumn(
        "volunteer_rating", volunteer_rating("normalized_weighted_count")
    )
    order = F.col(ordinal) if ordinal else F.monotonically_increasing_id()
    last = first_in(rated.withColumn("_o", order), ["stem"], [F.col("_o").desc()])
    return last.select("stem", *META_COLUMNS)


def enrich(results: DataFrame, lookup: DataFrame, name: str = "filename") -> DataFrame:
    """Results with the volunteer metadata of their stem, null where there is none."""
    keyed = results.withColumn("stem", text.stem(name))
    return keyed.join(lookup, "stem", "left").drop("stem")


def match_by_name(left: DataFrame, right: DataFrame, left_col: str, right_col: str, right_row: str) -> DataFrame:
    """Right row of each left name under any spelling; the smallest row wins.

    Both sides are written once per spelling; the smallest row per spelling is
    aggregated before the join.
    """
    keys = right.select(F.explode(text.name_keys(right_col)).alias("_key"), F.col(right_row).alias("_row"))
    lookup = keys.groupBy("_key").agg(F.min("_row").alias("_row"))
    names = left.select(left_col).distinct()
    spelled = names.select(left_col, F.explode(text.name_keys(left_col)).alias("_key"))
    found = spelled.join(lookup, "_key").groupBy(left_col).agg(F.min("_row").alias(right_row))
    return left.join(found, left_col, "left")


def restrict_to_truth(results: DataFrame, truth: DataFrame, key: str = "image") -> DataFrame:
    """Results with truth, for images that have it."""
    return results.join(truth, key)


def with_truth_only(results: DataFrame, truth: DataFrame, key: str = "image") -> DataFrame:
    return results.join(truth.select(key), key, "left_semi")


def last_by_name(rows: DataFrame, keys: list[str], ordinal: list[str]) -> DataFrame:
    """The last row per name in file order."""
    return first_in(rows, keys, [F.col(c).desc() for c in ordinal])


def unmatched(todo: DataFrame, done: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows whose key is not done yet."""
    keys = [key] if isinstance(key, str) else key
    return todo.join(done.select(*keys), keys, "left_anti")


def mark_done(done: DataFrame, checked: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Done table extended by what was checked; an empty answer is recorded as matched = 0."""
    hits = found.select(key).distinct().withColumn("matched", F.lit(1))
    new = checked.select(key).distinct().join(hits, key, "left").fillna(0, ["matched"])
    return done.select(key, "matched").unionByName(new.join(done.select(key), key, "left_anti"))


def fan_out(images: DataFrame, papers: DataFrame, key: str = "object_name", id_col: str = "filename") -> DataFrame:
    """Papers held once per object, given to every image of the object."""
    return images.select(id_col, key).join(papers, key)
