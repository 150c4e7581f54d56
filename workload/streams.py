"""Streams of the judgment log, run until they have caught up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.session import TableStore
from skysift.streaming import progress
from workload.registry import register

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def _events(spark, sf) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf)


def _caught_up(spark, totals: DataFrame, key: list[str]) -> DataFrame:
    store = TableStore(spark)
    query = progress.catch_up(totals, store.path("totals"), store.path("progress"))
    query.awaitTermination()
    return progress.latest(spark, store.path("totals"), key)


@register("stream_running_scores", """SELECT event_id % 3 AS run, user_id AS id,
    sum(CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END)::BIGINT AS imagescore, count(*) AS rounds_seen
    FROM events GROUP BY event_id % 3, user_id""")
def stream_running_scores(spark, sf):
    e = F.col("event_id")
    log = _events(spark, sf).select(
        (e % 3).cast("int").alias("run"), e.alias("round"), F.col("user_id").alias("id"),
        F.when(F.col("event_type").isin("click", "purchase"), 1).otherwise(0).alias("kept"))
    return _caught_up(spark, progress.running_scores(log), ["run", "id"])


@register("stream_running_tokens", """SELECT run, count(*) AS calls, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens FROM (
    SELECT DISTINCT (event_id // 4) % 3 AS run, event_id // 4 AS grp, event_id // 4 AS i, (event_id // 4) % 11 AS o FROM events) GROUP BY run""")
def stream_running_tokens(spark, sf):
    g = F.floor(F.col("event_id") / 4)
    log = _events(spark, sf).select((g % 3).cast("int").alias("run"), F.lit(1).alias("round"), g.alias("grp"),
                                    g.alias("input_tokens"), (g % 11).alias("output_tokens"))
    return _caught_up(spark, progress.running_tokens(log), ["run"])
