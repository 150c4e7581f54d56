"""Input schemas, column aliases and the check that required columns are there."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Names under which result files hold a column.
FILENAME_NAMES = ["filename", "name"]
SCORE_NAMES = ["imagescore", "image_score", "ai", "ai_selected"]
TRUTH_NAMES = ["interesting", "is_interesting", "label"]

CATALOG = (
    "MatchID bigint, SourceID bigint, SourceRA double, SourceDec double, XImage double, YImage double, "
    "ImageName string, Instrument string, Detector string, Filter string, CI double, KronRadius double, "
    "Flags int, Det string, fits_path string, original_shard_index int, is_saturated boolean, shard_index int"
)
TRUTH = "SourceID string, Classification string, RA double, Dec double, Referenced string"
# The file name is a 17-digit id, so it is text.
VOLUNTEER_SUBJECTS = (
    "subject_id bigint, count int, selected_count int, unique_user_count int, filename string, RA double, "
    "Dec double, URL string, anomaly_score double, image_score double, feature_score double, "
    "percent_selected double, normalized_weighted_count double"
)
CONSENSUS = "subject_id bigint, count int, selected_count int, unique_user_count int"
SUBJECTS = (
    "subject_id bigint, project_id int, workflow_id int, subject_set_id int, metadata string, locations string, "
    "classifications_count int, retired_at string, retirement_reason string, created_at string, updated_at string"
)
COMMENTS = (
    "board_id bigint, board_title string, board_description string, discussion_id bigint, discussion_title string, "
    "comment_id bigint, comment_body string, comment_focus_id bigint, comment_focus_type string, "
    "comment_user_id bigint, comment_user_login string, comment_created_at timestamp"
)
TAGS = (
    "id bigint, name string, section string, created_at timestamp, user_id bigint, comment_id bigint, "
    "taggable_id bigint, taggable_type string, project_id bigint, user_login string"
)
BIBLIOGRAPHY = "filename string, main_id string, object_name string, bibcode string, year string, title string"


class MissingColumns(ValueError):
    """An input lacks required columns."""


def require_columns(df: DataFrame, *columns: str, what: str = "input") -> DataFrame:
    """The DataFrame itself; raises from its schema alone, before any job runs."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise MissingColumns(f"{what} lacks columns: {', '.join(missing)}")
    return df
