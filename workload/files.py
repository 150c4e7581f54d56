"""Queries that write given tables as the library's input and output files and read them back, and views of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.functions import numbers
from skysift.operators import agreement, literature, matching, replicates, views as report
from skysift.session import TableStore
from skysift.sources import readers, sinks
from workload import views
from workload.registry import register

# --- result files: a folder per run, a header, rows and a footer of token totals


def _result_files(spark: SparkSession, sf: str) -> str:
    """Result files of every source; every fourth source's have no truth column."""
    docs = views.table(spark, sf, "documents").join(views.table(spark, sf, "labels"), "doc_id", "left")
    known = F.substring("source", 4, 9).cast("int") % 4 != 0
    cells = [F.concat(F.lit("/d/d"), F.col("doc_id").cast("string"), F.lit(".png")), F.floor(F.col("n_chars") / 500).cast("string")]
    truth = F.when(F.col("quality") == 1, "Yes").when(F.col("quality") == 0, "0.0").otherwise("")
    lines = docs.select("source", F.lit(1).alias("part"), F.col("doc_id").alias("at"),
                        F.when(known, F.concat_ws(",", *cells, truth)).otherwise(F.concat_ws(",", *cells)).alias("value"))
    runs = docs.groupBy("source").agg(F.sum("n_chars").alias("n"))
    head = runs.select("source", F.lit(0).alias("part"), F.lit(0).cast("long").alias("at"),
                       F.when(known, "Filename,ImageScore,interesting").otherwise("Filename,ImageScore").alias("value"))
    foot = runs.select("source", F.lit(2).alias("part"), F.lit(0).cast("long").alias("at"),
                       F.concat(F.lit('# TotalInputTokens,"'), F.format_number("n", 0), F.lit('"')).alias("value"))
    path = TableStore(spark).path("runs")
    ordered = lines.union(head).union(foot).repartition("source").sortWithinPartitions("source", "part", "at")
    ordered.select("source", "value").write.partitionBy("source").text(path)
    return path


@register("result_rows", """SELECT 'source=' || source AS parent, 'd' || doc_id || '.png' AS image, (n_chars // 500)::DOUBLE AS score,
    CASE WHEN substr(source, 4)::INT % 4 = 0 THEN NULL WHEN quality = 1 THEN 1 ELSE 0 END AS truth FROM documents LEFT JOIN labels USING (doc_id)""")
def result_rows(spark, sf):
    rows, _ = readers.read_results(spark, _result_files(spark, sf), glob="*.txt", multiline=False)
    return rows.select("parent", "image", "score", "truth")


@register("result_totals", "SELECT 'source=' || source AS parent, sum(n_chars)::BIGINT AS input_tokens FROM documents GROUP BY source")
def result_totals(spark, sf):
    _, meta = readers.read_results(spark, _result_files(spark, sf), glob="*.txt", multiline=False)
    return meta.select("parent", "input_tokens")


@register("results_judged", """SELECT 'source=' || source AS parent, count(*) AS n, count(*) FILTER (quality = 1) AS positives FROM documents LEFT JOIN labels USING (doc_id)
    WHERE substr(source, 4)::INT % 4 != 0 GROUP BY source""")
def results_judged(spark, sf):
    """Files without a truth column are left out of an evaluation, not counted as negatives."""
    rows, _ = readers.read_results(spark, _result_files(spark, sf), glob="*.txt", multiline=False)
    return readers.judged(rows).groupBy("parent").agg(F.count("*").alias("n"), F.count(F.when(F.col("truth") == 1, 1)).alias("positives"))


# --- expert files: one file an expert


def _vote_files(spark: SparkSession, sf: str) -> str:
    e = views.table(spark, sf, "events")
    row = F.concat(F.lit("/p/u"), F.col("user_id").cast("string"), F.lit(".png,"), F.when(F.col("value") > 50, "Yes").otherwise("no"))
    rows = e.select("event_type", F.lit(1).alias("part"), F.col("event_id").alias("at"), row.alias("value"))
    heads = e.select("event_type").distinct().select("event_type", F.lit(0).alias("part"), F.lit(0).cast("long").alias("at"), F.lit("name,interesting").alias("value"))
    store = TableStore(spark)
    rows.union(heads).repartition("event_type").sortWithinPartitions("event_type", "part", "at").select("event_type", "value").write.partitionBy(
        "event_type").text(store.path("votes"))
    # The expert is named by the file, which Spark's writer names by the task.
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(store.path("votes")).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.listStatus(path(store.path("votes"))):
        if folder.isDirectory():
            expert = folder.getPath().getName().split("=")[1]
            for file in fs.listStatus(folder.getPath()):
                fs.rename(file.getPath(), path(folder.getPath(), f"expert_scores_{expert}.csv"))
    return store.path("votes")


@register("expert_votes", """SELECT 'u' || user_id || '.png' AS image, event_type AS expert, count(*) AS votes, (count(*) FILTER (value > 50)) AS chosen
    FROM events GROUP BY 1, 2""")
def expert_votes(spark, sf):
    votes = readers.read_votes(spark, _vote_files(spark, sf))
    return votes.groupBy("image", "expert").agg(F.count("*").alias("votes"), F.sum("vote").alias("chosen"))


@register("expert_image_names", "SELECT DISTINCT 'u' || user_id || '.png' AS image FROM events WHERE user_id % 3 != 0")
def expert_image_names(spark, sf):
    votes = readers.read_votes(spark, _vote_files(spark, sf))
    few = views.table(spark, sf, "events").filter("user_id % 3 = 0").select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".png")).alias("image"))
    return readers.expert_images(votes, few.distinct())


# --- catalogs and volunteer exports


@register("catalog_coordinates", """SELECT o_custkey::VARCHAR AS id, arg_max(o_totalprice, o_orderkey) AS ra, max(o_orderkey)::DOUBLE AS dec FROM orders GROUP BY o_custkey""")
def catalog_coordinates(spark, sf):
    path = TableStore(spark).path("catalog")
    catalog = views.table(spark, sf, "orders").select(F.col("o_custkey").alias("SourceID"), F.col("o_totalprice").alias("SourceRA"),
                                                      F.col("o_orderkey").cast("double").alias("SourceDec"), "o_orderstatus")
    catalog.repartitionByRange("SourceID").sortWithinPartitions("SourceID", "SourceDec").write.parquet(path)
    return readers.read_coordinates(spark, path)


@register("consensus_rows", """SELECT user_id AS subject_id, count(*) AS count, (count(*) FILTER (value > 50)) AS selected_count, count(DISTINCT event_type) AS unique_user_count
    FROM events GROUP BY user_id""")
def consensus_rows(spark, sf):
    path = TableStore(spark).path("consensus")
    views.table(spark, sf, "events").groupBy(F.col("user_id").alias("subject_id")).agg(
        F.count("*").alias("count"), F.count(F.when(F.col("value") > 50, 1)).alias("selected_count"), F.countDistinct("event_type").alias("unique_user_count"),
    ).write.csv(path, sep=" ", header=True)
    return readers.read_consensus(spark, path)


# Rows of one array in an export written for these queries.
ARRAY_ROWS = 2000


def _array_files(rows: DataFrame, at: str, path: str) -> None:
    """Files that each hold one JSON array."""
    arrays = rows.groupBy(F.floor(F.col(at) / ARRAY_ROWS).alias("_file")).agg(F.collect_list(F.to_json(F.struct(*rows.columns))).alias("all"))
    arrays.select(F.concat(F.lit("[\n"), F.array_join("all", ",\n"), F.lit("\n]")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)


@register("tag_rows", """SELECT event_id AS id, event_type AS name, user_id, date_trunc('millisecond', ts) AS created_at, props AS section FROM events""")
def tag_rows(spark, sf):
    e = views.table(spark, sf, "events")
    path = TableStore(spark).path("tags")
    _array_files(e.select(F.col("event_id").alias("id"), F.col("event_type").alias("name"), F.col("props").alias("section"),
                          F.col("ts").alias("created_at"), "user_id"), "id", path)
    return readers.read_tags(spark, path).select("id", "name", "user_id", "created_at", "section")


@register("comment_rows", """SELECT conv_id * 100 + turn AS comment_id, conv_id AS discussion_id, role AS comment_user_login, text AS comment_body FROM conversations""")
def comment_rows(spark, sf):
    c = views.table(spark, sf, "conversations")
    path = TableStore(spark).path("comments")
    _array_files(c.select((F.col("conv_id") * 100 + F.col("turn")).alias("comment_id"), F.col("conv_id").alias("discussion_id"),
                          F.col("role").alias("comment_user_login"), F.col("text").alias("comment_body")), "comment_id", path)
    return readers.read_comments(spark, path).select("comment_id", "discussion_id", "comment_user_login", "comment_body")


@register("subject_metadata_rows", """SELECT event_id AS subject_id, json_extract_string(props, '$.k') AS k, date_trunc('second', ts) AS created_at FROM events""")
def subject_metadata_rows(spark, sf):
    path = TableStore(spark).path("subjects")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))
    nothing = F.lit(None).cast("string")
    views.table(spark, sf, "events").select(
        F.col("event_id").alias("subject_id"), F.lit(1).alias("project_id"), F.lit(2).alias("workflow_id"), F.lit(3).alias("subject_set_id"),
        F.col("props").alias("metadata"), nothing.alias("locations"), F.lit(4).alias("classifications_count"), nothing.alias("retired_at"),
        nothing.alias("retirement_reason"), stamp.alias("created_at"), stamp.alias("updated_at"),
    ).write.csv(path, header=True, quote='"', escape='"')
    rows = readers.read_subject_metadata(spark, path)
    return rows.select("subject_id", F.col("metadata")["k"].alias("k"), "created_at")


@register("mention_rows", """SELECT page_id::VARCHAR AS mention_id, (page_id % 360)::DOUBLE AS ra, url AS arxiv_url FROM pages WHERE page_id % 3 = 1""")
def mention_rows(spark, sf):
    store = TableStore(spark)
    k = F.col("page_id")
    views.table(spark, sf, "pages").select(
        k.cast("string").alias("mention_id"), (k % 3 != 0).alias("has_resolved_coordinates"),
        F.when(k % 3 == 2, float("nan")).otherwise(k % 360).cast("double").alias("resolved_ra_deg"), F.lit(0.5).alias("resolved_dec_deg"),
        F.lit("").alias("resolved_name"), F.lit("x").alias("ned_object_name"), F.col("url").alias("arxiv_url"), F.col("html").alias("summary"),
    ).write.parquet(store.path("mentions"))
    placed = readers.read_resolved_mentions(spark, store.path("mentions"))
    return placed.join(readers.read_mention_texts(spark, store.path("mentions")), "mention_id").select(
        "mention_id", F.col("resolved_ra_deg").alias("ra"), "arxiv_url")


@register("bibliography_rows", """SELECT 'f' || (item_id % 7) AS filename, item_id::VARCHAR AS bibcode, text AS title,
    CASE WHEN item_id % 2 = 0 THEN 'm' || item_id ELSE 'o' || item_id END AS alias FROM benchmark""")
def bibliography_rows(spark, sf):
    path = TableStore(spark).path("bibliography")
    k = F.col("item_id")
    name = F.concat(F.lit("m"), k.cast("string"))
    views.table(spark, sf, "benchmark").select(
        F.concat(F.lit("f"), (k % 7).cast("string")).alias("filename"), F.when(k % 2 == 0, name).alias("main_id"),
        F.concat(F.lit("o"), k.cast("string")).alias("object_name"), k.cast("string").alias("bibcode"), F.lit("2001").alias("year"), F.col("text").alias("title"),
    ).write.csv(path, header=True, quote='"', escape='"')
    return readers.read_bibliography(spark, path).select("filename", "bibcode", "title", "alias")


# --- ordered tables: written in order, their places read back from files and rows


def _places(spark, df: DataFrame, name: str) -> DataFrame:
    path = TableStore(spark).path(name)
    df.write.parquet(path)
    return sinks.read_places(spark, path)


@register("results_in_order", """SELECT doc_id AS id, row_number() OVER (ORDER BY source, n_chars DESC, doc_id) - 1 AS place FROM documents""")
def results_in_order(spark, sf):
    path = TableStore(spark).path("out")
    docs = views.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("imagescore"), "source")
    sinks.write_results(docs, None, path, by=["source"])
    return sinks.read_places(spark, f"{path}/results").select("id", "place")


@register("order_by_score", "SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS place FROM documents")
def order_by_score(spark, sf):
    docs = views.table(spark, sf, "documents").select("doc_id", "n_chars")
    return _places(spark, report.by_score(docs, "n_chars", "doc_id"), "scored").select("doc_id", "place")


@register("order_by_experts", """SELECT image, row_number() OVER (ORDER BY expert_score DESC, score DESC, expert_selected_n DESC, image) - 1 AS place FROM (
    SELECT o_orderkey AS image, (o_custkey % 10) / 10 AS expert_score, o_custkey % 4 AS score, o_orderkey % 3 AS expert_selected_n FROM orders)""")
def order_by_experts(spark, sf):
    rows = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("image"), (F.col("o_custkey") % 10 / 10).alias("expert_score"),
                                                   (F.col("o_custkey") % 4).alias("score"), (F.col("o_orderkey") % 3).alias("expert_selected_n"))
    return _places(spark, agreement.order_by_experts(rows), "experts").select("image", "place")


@register("order_by_references", """SELECT p_partkey AS filename, row_number() OVER (ORDER BY p_size DESC, p_retailprice DESC, p_partkey) - 1 AS place FROM part""")
def order_by_references(spark, sf):
    rows = views.table(spark, sf, "part").select(F.col("p_partkey").alias("filename"), F.col("p_size").alias("ref_count"), F.col("p_retailprice").alias("avg_score"))
    return _places(spark, report.by_references(rows), "references").select("filename", "place")


@register("order_bibliography", """SELECT l_orderkey AS filename, bibcode, row_number() OVER (ORDER BY l_orderkey, coalesce(year, 0), bibcode) - 1 AS place FROM (
    SELECT l_orderkey, l_linenumber AS bibcode, CASE WHEN l_partkey % 5 != 0 THEN l_suppkey END AS year FROM lineitem)""")
def order_bibliography(spark, sf):
    rows = views.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("filename"), F.col("l_linenumber").alias("bibcode"),
                                                     F.when(F.col("l_partkey") % 5 != 0, F.col("l_suppkey")).alias("year"))
    return _places(spark, report.bibliography_order(rows), "bibliography").select("filename", "bibcode", "place")


@register("cascade_files", """SELECT 'matched' AS name, count(*) AS n FROM customer WHERE c_custkey % 2 = 0 UNION ALL
    SELECT 'unidentified', count(*) FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT 'bibliography_simbad', count(*) FROM orders""")
def cascade_files(spark, sf):
    path = TableStore(spark).path("cascade")
    c = views.table(spark, sf, "customer")
    sinks.write_cascade(c.filter("c_custkey % 2 = 0"), c.filter("c_custkey % 2 = 1"), {"simbad": views.table(spark, sf, "orders")}, path, fmt="csv")
    counts = [spark.read.csv(f"{path}/{n}", header=True, escape='"').agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
              for n in ("matched", "unidentified", "bibliography_simbad")]
    return counts[0].union(counts[1]).union(counts[2])


@register("extended_table", """SELECT o_custkey AS id, CASE WHEN o_custkey % 2 = 0 THEN 'old' ELSE 'new' END AS said FROM (SELECT DISTINCT o_custkey FROM orders)""")
def extended_table(spark, sf):
    """What is there stays; only rows with new keys are added."""
    kept = sinks.VersionedTable(spark, TableStore(spark).path("versions"))
    ids = views.table(spark, sf, "orders").select(F.col("o_custkey").alias("id")).distinct()
    kept.write(ids.filter("id % 2 = 0").withColumn("said", F.lit("old")))
    return kept.extend(ids.withColumn("said", F.lit("new")), "id")


# --- selections


@register("score_zero_and_nonzero", """SELECT c_custkey AS id, CASE WHEN c_nationkey % 9 > 0 THEN 'nonzero' ELSE 'zero' END AS which FROM customer""")
def score_zero_and_nonzero(spark, sf):
    rows = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 9).alias("score"))
    return rows.filter(report.score_is("score", "zero")).select("id", F.lit("zero").alias("which")).union(
        rows.filter(report.score_is("score", "nonzero")).select("id", F.lit("nonzero").alias("which")))


@register("class_or_none", """SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN 'none' ELSE 'urgent' END AS which FROM orders
    WHERE o_custkey % 3 = 0 OR o_orderpriority = '1-URGENT'""")
def class_or_none(spark, sf):
    rows = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderpriority")).alias("label"))
    return rows.filter(report.class_is("label", None)).select("id", F.lit("none").alias("which")).union(
        rows.filter(report.class_is("label", "1-URGENT")).select("id", F.lit("urgent").alias("which")))


@register("outcome_rows", """SELECT doc_id AS image, CASE WHEN quality = 1 THEN CASE WHEN n_chars // 500 >= 3 THEN 'tp' ELSE 'fn' END
    ELSE CASE WHEN n_chars // 500 >= 3 THEN 'fp' ELSE 'tn' END END AS outcome FROM documents JOIN labels USING (doc_id) WHERE outcome IN ('fp', 'fn')""")
def outcome_rows(spark, sf):
    rows = views.scores(spark, sf).withColumn("outcome", numbers.outcome("score", "truth", 3.0))
    return rows.filter(F.col("outcome").isin("fp", "fn")).select("image", "outcome")


@register("only_with_truth", "SELECT doc_id AS image FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def only_with_truth(spark, sf):
    docs = views.table(spark, sf, "documents").select(F.col("doc_id").alias("image"))
    return matching.with_truth_only(docs, views.table(spark, sf, "labels").select(F.col("doc_id").alias("image")))


@register("object_aliases", """SELECT DISTINCT object_name, alias FROM (SELECT 'p' || p_partkey AS object_name, 'p' || p_partkey AS alias FROM part
    UNION ALL SELECT 'p' || l_partkey, l_returnflag || l_suppkey FROM lineitem WHERE l_suppkey % 4 != 0)""")
def object_aliases(spark, sf):
    objects = views.table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("object_name"))
    found = views.table(spark, sf, "lineitem").select(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("object_name"),
        F.when(F.col("l_suppkey") % 4 == 0, "").otherwise(F.concat("l_returnflag", F.col("l_suppkey").cast("string"))).alias("alias"))
    return literature.aliases_of(objects, found)


@register("expert_runs", """SELECT stem, CASE WHEN k % 2 = 0 THEN 'gemini' ELSE 'qwen' END AS provider, CASE WHEN k % 3 = 0 THEN 'few-shot' ELSE 'no-shot' END AS shot FROM (
    SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'Gemini' ELSE 'qwen' END || '_grid_' || CASE WHEN o_orderkey % 3 = 0 THEN 'few_shot' ELSE 'no_shot' END || '_' || o_orderkey AS stem FROM orders)""")
def expert_runs(spark, sf):
    k = F.col("o_orderkey")
    stem = F.concat(F.when(k % 2 == 0, "Gemini").otherwise("qwen"), F.lit("_grid_"), F.when(k % 3 == 0, "few_shot").otherwise("no_shot"), F.lit("_"), k.cast("string"))
    return replicates.describe_expert_runs(views.table(spark, sf, "orders").select(stem.alias("stem"))).select("stem", "provider", "shot")
