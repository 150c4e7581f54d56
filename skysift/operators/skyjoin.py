"""Joins by position: all pairs in a cone, nearest neighbour, labels and relabels.

Both sides meet on sky cells by an ordinary equi-join, so Spark shuffles and
splits the work; the exact distance is checked inside the join. Rows without a
position match nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from skysift.functions import sky
from skysift.operators import skypyramid

RADIUS_OLD, RADIUS_NEW = 10.0, 3.0  # fixed values: label radii in arc seconds


def _placed(df: DataFrame, id_col: str, ra: str, dec: str, extra: Sequence[str], tag: str) -> DataFrame:
    known = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in (ra, dec)]
    return df.filter(known[0] & known[1]).select(
        F.col(id_col).alias(f"{tag}_id"),
        F.col(ra).cast("double").alias(f"{tag}_ra"),
        F.col(dec).cast("double").alias(f"{tag}_dec"),
        *[F.col(c) for c in extra],
    )


def _spread(df: DataFrame, tag: str, radius: float, height: float) -> DataFrame:
    """One row per cell the circle around a row can reach: zones first, then cells of each zone."""
    ra, dec, z = F.col(f"{tag}_ra"), F.col(f"{tag}_dec"), F.col("_zone")
    zones = df.withColumn("_zone", F.explode(sky.zones_around(dec, radius, height)))
    cells = zones.withColumn("_turn", F.explode(sky.cells_around(ra, dec, z, radius, height)))
    return cells.withColumn("_c", F.pmod("_turn", sky.zone_cells(z, height))).drop("_turn")


def _homed(df: DataFrame, tag: str, height: float) -> DataFrame:
    """The one cell a row lies in."""
    z = sky.zone(F.col(f"{tag}_dec"), height)
    return df.withColumn("_zone", z).withColumn("_c", sky.cell(F.col(f"{tag}_ra"), F.col("_zone"), height))


def _separation() -> Column:
    return sky.separation_arcsec(F.col("left_ra"), F.col("left_dec"), F.col("right_ra"), F.col("right_dec"))


def sky_cone(
    left: DataFrame,
    right: DataFrame,
    radius_arcsec: float,
    *,
    left_id: str = "id",
    right_id: str = "id",
    left_pos: tuple[str, str] = ("ra", "dec"),
    right_pos: tuple[str, str] = ("ra", "dec"),
    keep: Sequence[str] = (),
    spread: str = "left",
) -> DataFrame:
    """All pairs within the radius: left_id, right_id, sep and right's `keep` columns.

    `spread` names the side written once per reachable cell; name the smaller one.
    """
    height = sky.zone_height(radius_arcsec)
    a = _placed(left, left_id, *left_pos, [], "left")
    b = _placed(right, right_id, *right_pos, keep, "right")
    if spread == "left":
        a, b = _spread(a, "left", radius_arcsec, height), _homed(b, "right", height)
    else:
        a, b = _homed(a, "left", height), _spread(b, "right", radius_arcsec, height)
    near = (a["_zone"] == b["_zone"]) & (a["_c"] == b["_c"]) & (_separation() <= radius_arcsec)
    return a.join(b, near).select("left_id", "right_id", _separation().alias("sep"), *keep)


def best_in_cone(
    left: DataFrame,
    right: DataFrame,
    radius_arcsec: float,
    order: list[tuple[Column | str, bool]] | None = None,
    *,
    left_id: str = "id",
    right_id: str = "id",
    left_pos: tuple[str, str] = ("ra", "dec"),
    right_pos: tuple[str, str] = ("ra", "dec"),
    keep: Sequence[str] = (),
    left_keep: Sequence[str] = (),
) -> DataFrame:
    """First right row within the radius of each left row: the nearest, or the first in `order`; the smallest id wins a tie.

    Gives left_id, right_id, sep and the kept columns of both sides. `order` is (column, descending) pairs
    over `keep` columns; a descending column must be a number, null values come last in either direction.
    """
    a = _placed(left, left_id, *left_pos, left_keep, "left")
    b = _placed(right, right_id, *right_pos, keep, "right").withColumnsRenamed({"right_ra": "ra", "right_dec": "dec"})
    keys = []
    for k, (column, descending) in enumerate(order or []):
        column = F.col(column) if isinstance(column, str) else column
        if descending and not isinstance(b.select(column.alias("k")).schema["k"].dataType, NumericType):
            raise ValueError("a descending order needs a number")
        keys += [column.isNull().alias(f"n{k}"), (-column if descending else column).alias(f"k{k}")]
    b = b.select("ra", "dec", F.struct(*keys, "right_id").alias("order"), F.struct("right_id", *keep).alias("values"))
    return skypyramid.search(a, b, radius_arcsec, order is None, list(left_keep)).select(
        "left_id", "values.right_id", "sep", *[f"values.{c}" for c in keep], *left_keep)


def sky_nearest(left: DataFrame, right: DataFrame, radius_arcsec: float, **names) -> DataFrame:
    """Nearest right row of each left row within the radius; the smallest id wins a tie."""
    return best_in_cone(left, right, radius_arcsec, **names)


def label_by_truth(
    images: DataFrame, truth: DataFrame, radius_arcsec: float, *, id_col: str = "id", ordinal: str = "ordinal"
) -> DataFrame:
    """Class of each image that is the nearest one to a truth entry within the radius.

    Several entries on one image: the last one in truth order names the class.
    Truth needs ordinal, ra, dec, class.
    """
    named = sky_nearest(truth, images, radius_arcsec, left_id=ordinal, right_id=id_col, left_keep=["class"])
    # Grouped by the image, so that Spark knows there is one label each and leaves a join with them out where none is used.
    last = named.groupBy(F.col("right_id").alias(id_col)).agg(F.max_by("class", "left_id").alias("class"))
    return last.select(id_col, F.trim("class").alias("classification"))


def labeled_records(images: DataFrame, labels: DataFrame, *, id_col: str = "id") -> DataFrame:
    """All images with interesting 0/1 and classification, empty where unlabeled."""
    joined = images.join(labels, id_col, "left")
    name = F.coalesce("classification", F.lit(""))
    return joined.withColumn("classification", name).withColumn(
        "interesting", F.when(name != "", 1).otherwise(0)
    )


def relabel(
    results: DataFrame,
    truth: DataFrame,
    old_radius: float = RADIUS_OLD,
    new_radius: float = RADIUS_NEW,
    *,
    id_col: str = "id",
    ordinal: str = "ordinal",
) -> tuple[DataFrame, DataFrame]:
    """Labels at a tighter radius, and an audit of the labels held so far.

    An image takes the class of its closest truth entry; the first entry wins a tie.
    Results need id, ra, dec, interesting, classification. The audit counts the
    old labels, those the old radius does not give again, those kept and demoted.
    """
    named = sky_nearest(truth, results, old_radius, left_id=ordinal, right_id=id_col, left_keep=["class"])
    best = named.groupBy(F.col("right_id").alias(id_col)).agg(F.min(F.struct("sep", "left_id", "class")).alias("_best")).select(
        id_col, F.col("_best.sep").alias("_sep"), F.trim("_best.class").alias("_class")
    )
    joined = results.withColumnRenamed("interesting", "_was").join(best, id_col, "left")
    inside = F.col("_sep").isNotNull() & (F.col("_sep") <= new_radius)
    marked = joined.withColumn("interesting", F.when(inside, 1).otherwise(0)).withColumn(
        "classification", F.when(inside, F.col("_class")).otherwise("")
    )
    was = F.col("_was").cast("int") == 1
    audit = marked.agg(
        F.count(F.when(was, 1)).alias("old_labels"),
        F.count(F.when(was & F.col("_sep").isNull(), 1)).alias("not_recovered"),
        F.count(F.when(F.col("interesting") == 1, 1)).alias("kept"),
        F.count(F.when(was & (F.col("interesting") == 0), 1)).alias("demoted"),
    )
    return marked.select(*results.columns), audit


def nearest_mention(
    images: DataFrame, mentions: DataFrame, lookup: DataFrame, radius_arcsec: float = RADIUS_NEW, *, id_col: str = "id"
) -> DataFrame:
    """Nearest resolved mention of each image with its name, link and summary."""
    named = best_in_cone(
        images, mentions, radius_arcsec, left_id=id_col, right_id="mention_id",
        right_pos=("resolved_ra_deg", "resolved_dec_deg"), keep=["resolved_name", "ned_object_name"],
    ).withColumnRenamed("right_id", "mention_id")
    name = F.coalesce(
        F.when(F.col("resolved_name") != "", F.col("resolved_name")),
        F.when(F.col("ned_object_name") != "", F.col("ned_object_name")),
        F.lit(""),
    )
    texts = lookup.select("mention_id", "arxiv_url", "summary")
    return named.join(texts, "mention_id", "left").select(
        F.col("left_id").alias(id_col),
        "mention_id",
        name.alias("object_name"),
        F.coalesce("arxiv_url", F.lit("")).alias("arxiv_url"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        "sep",
    )


def most_referenced(images: DataFrame, objects: DataFrame, radius_arcsec: float = RADIUS_NEW, *, id_col: str = "id") -> DataFrame:
    """Most-referenced object in the cone of each image; no count is 0, ties go to the smallest oid."""
    counted = objects.withColumn("ref_count", F.coalesce("nbref", F.lit(0)))
    best = best_in_cone(
        images, counted, radius_arcsec, [("ref_count", True)],
        left_id=id_col, right_id="oid", keep=["main_id", "otype", "ref_count"],
    )
    return best.select(F.col("left_id").alias(id_col), F.col("right_id").alias("oid"),
                       F.col("main_id").alias("object_name"), F.col("otype").alias("object_type"), "ref_count")


def cone_bibliography(
    images: DataFrame,
    objects: DataFrame,
    has_ref: DataFrame,
    ref: DataFrame,
    radius_arcsec: float = RADIUS_NEW,
    *,
    id_col: str = "id",
) -> DataFrame:
    """Papers of every object in the cone of each image, not only of the best one."""
    pairs = sky_cone(images, objects, radius_arcsec, left_id=id_col, right_id="oid", keep=["main_id"], spread="right")
    linked = pairs.join(has_ref, pairs["right_id"] == has_ref["oidref"])
    papers = linked.join(ref, F.col("oidbibref") == F.col("oidbib"))
    return papers.select(F.col("left_id").alias(id_col), "main_id", "bibcode", "year", "title")
