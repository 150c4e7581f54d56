"""The given tables seen as the library's inputs, in Spark and in SQL.

Both sides use whole-number arithmetic wherever a value decides a group, a
threshold or an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PHI_STEP, RA_TURN = 13750776, 36000000
DEC_STEP, DEC_TURN = 7919, 20011
FORMATS = ["single-elim", "tournament", "likert", "hybrid"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Judge scores with truth: run, image, score, truth, provider, format."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    number = F.substring("source", 4, 9).cast("int")
    fmt = F.get(F.array(*[F.lit(f) for f in FORMATS]), number % 4)
    return docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").select(
        F.col("source").alias("run"), F.col("doc_id").alias("image"),
        F.floor(F.col("n_chars") / 500).cast("double").alias("score"), F.col("quality").alias("truth"),
        F.when(number % 2 == 0, "gemini").otherwise("qwen").alias("provider"), fmt.alias("format"),
    )


def run_tokens(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.groupBy(F.col("source").alias("run")).agg(
        F.sum("n_chars").alias("input_tokens"), F.sum(F.floor(F.col("n_chars") / 10)).alias("output_tokens")
    )


def judgment_log(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("id"), (e % 3).cast("int").alias("run"), (e % 5 + 1).cast("int").alias("round"),
        (e % 18).cast("int").alias("slot"), (e % 7).cast("int").alias("score"),
        F.when(F.col("event_type").isin("click", "purchase"), 1).otherwise(0).alias("kept"),
        F.floor(e / 4).alias("grp"), e.alias("seq"), F.floor(e / 4).alias("input_tokens"),
        (F.floor(e / 4) % 11).alias("output_tokens"),
        F.when(F.col("event_type") == "error", "").otherwise(F.concat(F.lit("because "), F.col("props"))).alias("reasoning"),
    )


def votes(spark: SparkSession, sf: str) -> DataFrame:
    """All votes cast; the last one per image and expert counts."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("image"), F.col("event_type").alias("expert"),
        F.when(F.col("value") > 50, 1).otherwise(0).alias("vote"), F.col("event_id").alias("seq"),
    )


def ai_results(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as judged images; half of them are ones the experts also saw."""
    return table(spark, sf, "customer").select(
        (F.col("c_custkey") * 2).alias("image"), (F.col("c_nationkey") % 9).cast("double").alias("score"),
        (F.col("c_nationkey") % 2).cast("int").alias("ai_selected"), F.col("c_mktsegment").alias("reasoning"),
    )


def _ra(k):
    return ((k * PHI_STEP) % RA_TURN) / 100000.0


def _dec(k):
    return F.degrees(F.asin((k * DEC_STEP % DEC_TURN) / 10005.5 - 1))


def images(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("id"), _ra(k).alias("ra"), _dec(k).alias("dec"), F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("avg_score"),
    )


def _near(df: DataFrame, spark: SparkSession, sf: str, key, arcsec) -> DataFrame:
    """Rows placed at an image chosen by key, moved in declination."""
    n = table(spark, sf, "customer").agg(F.count("*").alias("_n"))
    spot = df.crossJoin(F.broadcast(n)).withColumn("_k", key % F.col("_n"))  # one row
    return spot.withColumn("ra", _ra(F.col("_k"))).withColumn("dec", _dec(F.col("_k")) + arcsec / 3600).drop("_n", "_k")


def truth(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    placed = o.withColumn("ra", _ra(F.col("o_custkey"))).withColumn(
        "dec", _dec(F.col("o_custkey")) + (F.col("o_orderkey") % 7 * 2 + 0.5) / 3600
    )
    return placed.select(F.col("o_orderkey").alias("ordinal"), "ra", "dec", F.col("o_orderpriority").alias("class"))


def objects(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size")
    placed = _near(p, spark, sf, F.col("p_partkey"), F.col("p_partkey") % 5 + 0.5)
    name = F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))
    return placed.select(F.col("p_partkey").alias("oid"), name.alias("main_id"), F.col("p_type").alias("otype"),
                         F.col("p_size").alias("nbref"), "ra", "dec")


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    placed = _near(s, spark, sf, F.col("s_suppkey") * 7, F.lit(1.5))
    named = F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).otherwise("")
    return placed.select(
        F.col("s_suppkey").cast("string").alias("mention_id"), F.col("ra").alias("resolved_ra_deg"),
        F.col("dec").alias("resolved_dec_deg"), named.alias("resolved_name"),
        F.concat(F.lit("ned "), F.col("s_nationkey").cast("string")).alias("ned_object_name"),
    )


def mention_texts(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").filter(F.col("s_acctbal") > 0)
    return s.select(F.col("s_suppkey").cast("string").alias("mention_id"),
                    F.concat(F.lit("abs/"), F.col("s_suppkey").cast("string")).alias("arxiv_url"),
                    F.col("s_name").alias("summary"))


def second_objects(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    placed = o.withColumn("ra", _ra(F.col("o_custkey"))).withColumn(
        "dec", _dec(F.col("o_custkey")) + (F.col("o_orderkey") % 9 + 0.5) / 3600
    )
    return placed.select(F.col("o_orderkey").alias("oid"), F.col("o_orderstatus").alias("prefphytype"), "ra", "dec",
                         (F.col("o_orderkey") % 13).cast("int").alias("n_crosref"))


def has_ref(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("oidref"), F.col("l_orderkey").alias("oidbibref")).distinct()


def ref(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("oidbib"), F.concat(F.year("o_orderdate").cast("string"), F.lit("B"), F.col("o_orderkey").cast("string")).alias("bibcode"),
                    F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("title"))


def _top_letter(c: str):
    """Largest one-letter value; as a number it is aggregated by hash."""
    return F.char(F.max(F.ascii(c)))


def papers(spark: SparkSession, sf: str) -> DataFrame:
    """Papers of objects: one per part and order."""
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("object_name"), F.col("l_orderkey").alias("bibcode")).agg(
        F.max(F.year("l_shipdate")).alias("year"), _top_letter("l_returnflag").alias("title"),
        _top_letter("l_linestatus").alias("alias"),
    ).withColumn("seq", F.col("bibcode"))


def bibliography(spark: SparkSession, sf: str, status: str) -> DataFrame:
    """Papers of images in one of two catalogs."""
    li = table(spark, sf, "lineitem").filter(F.col("l_linestatus") == status)
    return li.groupBy(F.col("l_suppkey").alias("filename"), F.col("l_orderkey").alias("bibcode")).agg(
        F.max(F.year("l_shipdate")).alias("year"), _top_letter("l_returnflag").alias("title"),
    ).withColumn("alias", F.lit(status)).withColumn("seq", F.col("bibcode"))


def matched(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("filename"), F.col("c_acctbal").alias("avg_score"), F.col("c_custkey").alias("ordinal"),
        F.concat(F.lit("obj"), (F.floor(F.col("c_custkey") / 3)).cast("string")).alias("object_name"),
        F.col("c_mktsegment").alias("object_type"), (F.col("c_nationkey") * 2).cast("bigint").alias("ref_count"),
        F.when(F.col("c_custkey") % 4 == 0, "HF").when(F.col("c_custkey") % 4 == 1, "NED").otherwise("SIMBAD").alias("matched_source"),
    )


def verdict_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts so far, one per part."""
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("object_name"), F.col("p_size").cast("bigint").alias("n_papers_checked"),
                    F.lit(0).cast("bigint").alias("n_name_hits"), (F.col("p_size") % 3 == 0).alias("genuinely_discussed"),
                    F.col("p_type").alias("reasoning"))


def fulltext_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Full-text hits: orders told for parts, some of them known papers."""
    li = table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R")
    return li.groupBy(F.col("l_partkey").alias("object_name"), (F.col("l_orderkey") + F.col("l_linenumber") % 2).alias("bibcode")).agg(
        F.max(F.year("l_shipdate")).alias("year"), _top_letter("l_linestatus").alias("title"),
        _top_letter("l_returnflag").alias("matched_alias"), F.min("l_orderkey").alias("seq"))


def text_papers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("source").alias("object_name"), F.col("doc_id").alias("bibcode"), F.lit("").alias("title"),
        F.col("text").alias("abstract"))


def text_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Passages an object may be quoted by: whole benchmark items, and the opening and the whole first line of its first document."""
    passages = table(spark, sf, "benchmark").select(
        F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("object_name"), F.col("text").alias("alias"))
    docs = table(spark, sf, "documents")
    first = docs.groupBy("source").agg(F.min_by("text", "doc_id").alias("text"))
    starts = F.array(F.substring("text", 1, 24), F.split_part("text", F.lit("\n"), F.lit(1)))
    return passages.union(first.select("source", F.explode(starts))).distinct()


def coordinate_names(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with a catalog name that holds a coordinate designation."""
    k = F.col("c_custkey")
    prefix = F.when(k % 4 == 0, "SDSS ").when(k % 4 == 1, "NAME ").when(k % 4 == 2, "Gaia DR3 ").otherwise("")
    tail = F.when(k % 3 == 0, " galaxy").otherwise("")
    ra = F.lpad((k * 7919 % 240000).cast("string"), 6, "0")
    dec = F.lpad((k * 104729 % 900000).cast("string"), 6, "0")
    name = F.concat(prefix, F.lit("J"), ra, F.lit("."), (k % 90 + 10).cast("string"),
                    F.when(k % 2 == 0, "+").otherwise("-"), dec, F.lit("."), (k % 10).cast("string"), tail)
    plain = F.concat(prefix, F.col("c_mktsegment"), F.lit(" "), F.col("c_name"), tail)
    return table(spark, sf, "customer").select(
        F.concat(F.lit("o"), k.cast("string")).alias("object_name"), F.when(k % 5 == 0, plain).otherwise(name).alias("alias"))


def judged_items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))


def regression_rows(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        F.when(F.col("l_orderkey") % 11 != 0, F.col("l_discount")).alias("x2"), F.col("l_quantity").alias("x1"),
        (F.col("l_extendedprice") / 1000).alias("y"))


# ---------------------------------------------------------------------------

_RA = "((({k}) * 13750776) % 36000000) / 100000.0"
_DEC = "degrees(asin(((({k}) * 7919) % 20011) / 10005.5 - 1))"
_N = "(SELECT count(*) FROM customer)"


def _at(k: str, arcsec: str = "0") -> str:
    return f"{_RA.format(k=k)} AS ra, {_DEC.format(k=k)} + ({arcsec}) / 3600.0 AS dec"


SEP = (
    "degrees(2 * asin(sqrt(least(1.0, pow(sin(radians({b}.dec - {a}.dec) / 2), 2) + cos(radians({a}.dec)) "
    "* cos(radians({b}.dec)) * pow(sin(radians({b}.ra - {a}.ra) / 2), 2))))) * 3600"
)


def md5_key(*parts: str) -> str:
    return "('0x' || substr(md5(concat_ws('-', " + ", ".join(parts) + ")), 1, 15))::BIGINT"


SQL = {
    "v_scores": """SELECT d.source AS run, d.doc_id AS image, (d.n_chars // 500)::DOUBLE AS score, l.quality AS truth,
        CASE WHEN substr(d.source, 4)::INT % 2 = 0 THEN 'gemini' ELSE 'qwen' END AS provider,
        (['single-elim', 'tournament', 'likert', 'hybrid'])[substr(d.source, 4)::INT % 4 + 1] AS format
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "v_tokens": """SELECT source AS run, sum(n_chars)::BIGINT AS input_tokens, sum(n_chars // 10)::BIGINT AS output_tokens
        FROM documents GROUP BY source""",
    "v_log": """SELECT user_id AS id, event_id % 3 AS run, event_id % 5 + 1 AS round, event_id % 18 AS slot, event_id % 7 AS score,
        CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS kept, event_id // 4 AS grp, event_id AS seq,
        event_id // 4 AS input_tokens, (event_id // 4) % 11 AS output_tokens,
        CASE WHEN event_type = 'error' THEN '' ELSE 'because ' || props END AS reasoning FROM events""",
    "v_votes": """SELECT user_id AS image, event_type AS expert, CASE WHEN value > 50 THEN 1 ELSE 0 END AS vote, event_id AS seq
        FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""",
    "v_ai": """SELECT c_custkey * 2 AS image, (c_nationkey % 9)::DOUBLE AS score, c_nationkey % 2 AS ai_selected,
        c_mktsegment AS reasoning FROM customer""",
    "v_images": f"SELECT c_custkey AS id, {_at('c_custkey')}, c_mktsegment AS segment, c_acctbal AS avg_score FROM customer",
    "v_truth": f"""SELECT o_orderkey AS ordinal, {_at('o_custkey', 'o_orderkey % 7 * 2 + 0.5')}, o_orderpriority AS class
        FROM orders""",
    "v_objects": f"""SELECT p_partkey AS oid, p_name || ' ' || p_partkey AS main_id, p_type AS otype, p_size AS nbref,
        {_at(f'p_partkey % {_N}', 'p_partkey % 5 + 0.5')} FROM part""",
    "v_mentions": f"""SELECT s_suppkey::VARCHAR AS mention_id, {_at(f's_suppkey * 7 % {_N}', '1.5')},
        CASE WHEN s_suppkey % 3 != 0 THEN s_name ELSE 'ned ' || s_nationkey END AS object_name FROM supplier""",
    "v_mention_texts": """SELECT s_suppkey::VARCHAR AS mention_id, 'abs/' || s_suppkey AS arxiv_url, s_name AS summary
        FROM supplier WHERE s_acctbal > 0""",
    "v_second": f"""SELECT o_orderkey AS oid, o_orderstatus AS prefphytype, {_at('o_custkey', 'o_orderkey % 9 + 0.5')},
        o_orderkey % 13 AS n_crosref FROM orders""",
    "v_has_ref": "SELECT DISTINCT l_partkey AS oidref, l_orderkey AS oidbibref FROM lineitem",
    "v_ref": """SELECT o_orderkey AS oidbib, year(o_orderdate) || 'B' || o_orderkey AS bibcode, year(o_orderdate)::INT AS year,
        o_orderpriority AS title FROM orders""",
    "v_papers": """SELECT l_partkey AS object_name, l_orderkey AS bibcode, max(year(l_shipdate))::INT AS year,
        max(l_returnflag) AS title, max(l_linestatus) AS alias, l_orderkey AS seq FROM lineitem GROUP BY l_partkey, l_orderkey""",
    "v_biblio": """SELECT l_linestatus AS catalog, l_suppkey AS filename, l_orderkey AS bibcode, max(year(l_shipdate))::INT AS year,
        max(l_returnflag) AS title, l_orderkey AS seq FROM lineitem GROUP BY l_linestatus, l_suppkey, l_orderkey""",
    "v_matched": """SELECT c_custkey AS filename, c_acctbal AS avg_score, c_custkey AS ordinal, 'obj' || (c_custkey // 3) AS object_name,
        c_mktsegment AS object_type, (c_nationkey * 2)::BIGINT AS ref_count,
        CASE c_custkey % 4 WHEN 0 THEN 'HF' WHEN 1 THEN 'NED' ELSE 'SIMBAD' END AS matched_source FROM customer""",
    "v_verdicts": """SELECT p_partkey AS object_name, p_size::BIGINT AS n_papers_checked, 0::BIGINT AS n_name_hits,
        p_size % 3 = 0 AS genuinely_discussed, p_type AS reasoning FROM part""",
    "v_hits": """SELECT l_partkey AS object_name, l_orderkey + l_linenumber % 2 AS bibcode, max(year(l_shipdate))::INT AS year,
        max(l_linestatus) AS title, max(l_returnflag) AS matched_alias, min(l_orderkey) AS seq FROM lineitem
        WHERE l_returnflag = 'R' GROUP BY l_partkey, l_orderkey + l_linenumber % 2""",
    "v_text_aliases": """SELECT 'src' || (item_id % 20) AS object_name, text AS alias FROM benchmark
        UNION SELECT source, unnest([substr(text, 1, 24), split_part(text, chr(10), 1)]) FROM (
        SELECT source, arg_min(text, doc_id) AS text FROM documents GROUP BY source)""",
    "v_names": """SELECT 'o' || c_custkey AS object_name,
        CASE c_custkey % 4 WHEN 0 THEN 'SDSS ' WHEN 1 THEN 'NAME ' WHEN 2 THEN 'Gaia DR3 ' ELSE '' END ||
        CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment || ' ' || c_name
        ELSE 'J' || lpad((c_custkey * 7919 % 240000)::VARCHAR, 6, '0') || '.' || (c_custkey % 90 + 10) ||
        CASE WHEN c_custkey % 2 = 0 THEN '+' ELSE '-' END || lpad((c_custkey * 104729 % 900000)::VARCHAR, 6, '0') || '.' ||
        (c_custkey % 10) END || CASE WHEN c_custkey % 3 = 0 THEN ' galaxy' ELSE '' END AS alias FROM customer""",
    "v_reg": """SELECT CASE WHEN l_orderkey % 11 != 0 THEN l_discount END AS x2, l_quantity AS x1, l_extendedprice / 1000 AS y
        FROM lineitem""",
}


def with_views(body: str, *names: str, more: str = "") -> str:
    """SQL text: the named views as CTEs, further CTEs, and the body."""
    parts = [f"{n} AS ({SQL[n]})" for n in names]
    if more:
        parts.append(more.strip())
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


# A field of thousands of positions inside one cell of the sky, a third of them in a knot of some millionths of a degree.
FIELD_RA, FIELD_DEC = 150.0, -30.0


def _in_field(k, prime, steps_ra, steps_dec):
    """Whole-number steps across the field; every third position lies in the knot."""
    knot = k % 3 == 0
    across = F.when(knot, 50000000 + k * steps_ra % prime).otherwise(k * steps_ra % prime * 10000)
    up = F.when(knot, 50000000 + k * steps_dec % prime).otherwise(k * steps_dec % prime * 10000)
    return (FIELD_RA + across / 34000000000.0).alias("ra"), (FIELD_DEC + up / 34000000000.0).alias("dec")


def field_images(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("id"), *_in_field(k, 10007, 7919, 3571))


def field_objects(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k.alias("oid"), *_in_field(k, 9973, 6131, 7873), F.col("p_size").alias("nbref"))
