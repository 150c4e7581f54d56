"""Readers for catalogs, truth lists, result files, votes and volunteer data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.functions import text
from skysift.operators.ordering import first_in
from skysift.sources import schemas
from skysift.sources.schemas import require_columns

def _file_order() -> list[Column]:
    """Where a row stands: file, split and place within the split."""
    return [
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("ordinal"),
    ]


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """id, ra, dec of a catalog; the last row of an id wins. Reads three columns."""
    raw = require_columns(spark.read.parquet(path), "SourceID", "SourceRA", "SourceDec", what="catalog")
    rows = raw.select(F.col("SourceID").cast("bigint").cast("string").alias("id"), F.col("SourceRA").alias("ra"),
                      F.col("SourceDec").alias("dec"), *_file_order())
    return first_in(rows, ["id"], [F.col("file").desc(), F.col("ordinal").desc()]).select("id", "ra", "dec")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Truth list with its row order as `ordinal`. The list is a file people edit, read as one split."""
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=True)
    require_columns(raw, "SourceID", "Classification", "RA", "Dec", what="truth list")
    return raw.select(
        "SourceID", F.trim("Classification").alias("class"), F.col("RA").try_cast("double").alias("ra"),
        F.col("Dec").try_cast("double").alias("dec"), F.monotonically_increasing_id().alias("ordinal"),
    )


def _widest_header(spark: SparkSession, path: str, glob: str) -> int:
    """Cells of the widest line of all files that can be a header: one with a file name column."""
    lines = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter=glob)
    # A comma inside quotes counts too, which makes the schema wider than need be, never narrower.
    heads = lines.filter(F.lower("value").rlike("|".join(schemas.FILENAME_NAMES)) & F.contains("value", F.lit(",")))
    widths = heads.agg(F.max(F.size(F.split("value", ",")))).first()[0]
    return widths or 1


def _raw_csv(spark: SparkSession, path: str, glob: str, multiline: bool) -> DataFrame:
    """All rows of all files as arrays of texts, headers included, as wide as the widest header."""
    fields = [f"_c{i}" for i in range(max(_widest_header(spark, path, glob), 3))]
    raw = spark.read.csv(
        path, schema=", ".join(f"{f} string" for f in fields), header=False, multiLine=multiline,
        recursiveFileLookup=True, pathGlobFilter=glob, quote='"', escape='"',
    )
    cells = F.array(*[F.regexp_replace(F.coalesce(f, F.lit("")), "^﻿", "") for f in fields])
    return raw.select(cells.alias("cells"), *_file_order()).withColumn("blank", F.forall("cells", lambda c: F.trim(c) == ""))


def _names(cells: Column) -> Column:
    return F.transform(cells, lambda c: F.lower(F.trim(c)))


def _pick(*names: str) -> Column:
    """Cell under the first header that is one of the names, null when the file has no such column."""
    at = F.array_position(F.transform("header", lambda h: h.isin(list(names))), True)
    return F.when(at > 0, F.get("cells", (at - 1).cast("int")))


def read_results(
    spark: SparkSession, path: str, *, glob: str = "*.csv", multiline: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(rows, run metadata) of result files of any header shape below a folder.

    Rows: file, stem, parent, ordinal, image, score, truth, and the texts the
    file holds. Files without a name and a score column give no rows. Metadata:
    one row per file with the token totals of its footer, null where absent.
    """
    raw = _raw_csv(spark, path, glob, multiline)
    # A header is a file's first row; one row per file, matched by its column names.
    is_header = F.exists(_names(F.col("cells")), lambda c: c.isin(schemas.FILENAME_NAMES)) & F.exists(
        _names(F.col("cells")), lambda c: c.isin(schemas.SCORE_NAMES)
    )
    heads = first_in(raw.filter(is_header), ["file"], [F.col("ordinal")]).select(
        "file", _names(F.col("cells")).alias("header"), F.col("ordinal").alias("_head")
    )
    lead = F.col("cells")[0]
    body = raw.filter(~F.col("blank") & ~lead.startswith("#")).join(heads, "file").filter(F.col("ordinal") > F.col("_head"))
    name, folder = F.regexp_extract("file", r"([^/]*)$", 1), F.regexp_extract("file", r"([^/]*)/[^/]*$", 1)
    rows = body.select(
        "file", text.stem(name).alias("stem"), folder.alias("parent"), "ordinal",
        text.base_name(_pick(*schemas.FILENAME_NAMES)).alias("image"),
        F.trim(_pick(*schemas.SCORE_NAMES)).try_cast("double").alias("score"),
        F.when(_pick(*schemas.TRUTH_NAMES).isNotNull(), text.parse_binary(_pick(*schemas.TRUTH_NAMES))).alias("truth"),
        _pick("classification").alias("classification"),
        text.parse_float(_pick("sourcera", "source_ra", "ra")).alias("ra"),
        text.parse_float(_pick("sourcedec", "source_dec", "dec")).alias("dec"),
        _pick("reasoning").alias("reasoning"),
        text.parse_float(_pick("anomalyscore", "anomaly_score", "anomaly")).alias("anomaly_score"),
        _pick("url").alias("url"),
        text.parse_float(_pick("volunteer_rating", "volunteerrating", "volunteer")).alias("volunteer_rating"),
    ).filter((F.col("image") != "") & F.col("score").isNotNull())

    marks = raw.filter(lead.startswith("#")).select(
        "file", F.lower(F.trim(F.regexp_replace(lead, "^[# ]+", ""))).alias("key"),
        F.regexp_replace(F.col("cells")[1], "[, ]", "").alias("value"),
    )

    def total(key: str, kind: str) -> Column:
        return F.max(F.when(F.col("key") == key, F.col("value").try_cast(kind)))

    meta = marks.groupBy("file").agg(
        total("totalinputtokens", "bigint").alias("input_tokens"),
        total("totaloutputtokens", "bigint").alias("output_tokens"),
        total("totaltokens", "bigint").alias("total_tokens"),
        total("totalcostusd", "double").alias("cost_usd"),
    )
    files = heads.select("file", text.stem(name).alias("stem"), folder.alias("parent"))
    return rows, files.join(meta, "file", "left")


def judged(rows: DataFrame) -> DataFrame:
    """Rows of files that have a truth column; a file without one says nothing about its images.

    A cell that is there but can't be read as a yes is a no.
    """
    return rows.filter(F.col("truth").isNotNull())


def last_rows(rows: DataFrame) -> DataFrame:
    """One row per image and file: the last one."""
    return first_in(rows, ["file", "image"], [F.col("ordinal").desc()])


def read_votes(spark: SparkSession, path: str, *, glob: str = "expert_scores_*.csv") -> DataFrame:
    """Expert votes: image, expert, vote, url, seq. The expert is in the file name."""
    raw = _raw_csv(spark, path, glob, True)
    is_header = F.exists(_names(F.col("cells")), lambda c: c.isin(schemas.FILENAME_NAMES))
    heads = first_in(raw.filter(is_header), ["file"], [F.col("ordinal")]).select(
        "file", _names(F.col("cells")).alias("header"), F.col("ordinal").alias("_head")
    )
    body = raw.filter(~F.col("blank")).join(heads, "file").filter(F.col("ordinal") > F.col("_head"))

    def filled(*names: str) -> Column:
        return F.coalesce(*[F.when(_pick(n) != "", _pick(n)) for n in names], F.lit(""))

    return body.select(
        text.base_name(filled("name", "filename")).alias("image"),
        text.expert_name(F.url_decode("file")).alias("expert"),
        text.parse_binary(filled("interesting", "selected", "vote")).alias("vote"),
        F.trim(filled("url")).alias("url"),
        F.struct("file", "ordinal").alias("seq"),
    ).filter(F.col("image") != "")


def expert_images(votes: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Distinct images over all experts, minus the few-shot examples."""
    names = votes.select("image").distinct()
    return names if excluded is None else names.join(excluded.select("image"), "image", "left_anti")


def read_subjects(spark: SparkSession, path: str, *, drop_malformed: bool = False) -> DataFrame:
    """Volunteer subject table with its row order."""
    mode = "DROPMALFORMED" if drop_malformed else "PERMISSIVE"
    rows = spark.read.csv(path, schema=schemas.VOLUNTEER_SUBJECTS, header=True, mode=mode, quote='"', escape='"')
    return rows.select("*", F.struct(*_file_order()).alias("ordinal"))


def read_consensus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=schemas.CONSENSUS, header=True, sep=" ", quote='"')


def read_subject_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Subject export with its JSON columns as maps and its times as timestamps."""
    raw = spark.read.csv(path, schema=schemas.SUBJECTS, header=True, quote='"', escape='"', multiLine=True)
    out = raw
    for c in ("metadata", "locations"):
        out = out.withColumn(c, F.from_json(c, "map<string,string>"))
    for c in ("retired_at", "created_at", "updated_at"):
        out = out.withColumn(c, F.try_to_timestamp(F.regexp_replace(c, " UTC$", ""), F.lit("yyyy-MM-dd HH:mm:ss")))
    return out


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=schemas.TAGS, multiLine=True)


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=schemas.COMMENTS, multiLine=True)


def read_resolved_mentions(spark: SparkSession, path: str) -> DataFrame:
    """Mentions with a resolved position."""
    rows = spark.read.parquet(path).select(
        "mention_id", "has_resolved_coordinates", "resolved_ra_deg", "resolved_dec_deg", "resolved_name", "ned_object_name"
    )
    placed = rows.filter(F.col("has_resolved_coordinates") & F.col("resolved_ra_deg").isNotNull() & F.col("resolved_dec_deg").isNotNull())
    return placed.filter(~F.isnan("resolved_ra_deg") & ~F.isnan("resolved_dec_deg")).drop("has_resolved_coordinates")


def read_mention_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("mention_id", "arxiv_url", "summary")


def read_bibliography(spark: SparkSession, path: str) -> DataFrame:
    """Papers per file with the name they were found by: main_id, else object_name."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    alias = text.first_non_empty(raw, "main_id", "object_name")
    return raw.select("filename", "bibcode", "year", "title", alias.alias("alias"), F.monotonically_increasing_id().alias("seq"))


def papers_per_file(bibliography: DataFrame) -> DataFrame:
    """All papers of a file as one array in file order; for files with few papers."""
    paper = F.struct("seq", "bibcode", "year", "title", "alias")
    return bibliography.groupBy("filename").agg(F.array_sort(F.collect_list(paper)).alias("papers"))


def read_images(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Encoded images by name; protocols carry ids and join these where a judge needs them."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return raw.select(text.base_name("path").alias("filename"), F.col("content").alias("image"), "length")


