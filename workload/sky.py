"""Queries on positions: labels, cones, cascades and the papers behind them."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysift.operators import matching, skyjoin, views as report
from skysift.plans.cascade import Catalog, cascade
from skysift.session import TableStore
from workload import views
from workload.registry import r6, register
from workload.views import SEP, with_views

# Every truth entry's nearest image, by brute force.
NEAREST = f"""pairs AS (SELECT t.ordinal, t.class, i.id, {SEP.format(a='t', b='i')} AS sep FROM v_truth t, v_images i
    WHERE abs(t.dec - i.dec) < 0.01),
  hits AS (SELECT * FROM pairs WHERE sep <= 10 QUALIFY row_number() OVER (PARTITION BY ordinal ORDER BY sep, id) = 1)"""


@register("sky_nearest", with_views("SELECT ordinal, id, round(sep, 4) AS sep FROM hits", "v_truth", "v_images", more=NEAREST))
def sky_nearest(spark, sf):
    near = skyjoin.sky_nearest(views.truth(spark, sf), views.images(spark, sf), 10.0, left_id="ordinal")
    return near.select(F.col("left_id").alias("ordinal"), F.col("right_id").alias("id"), F.round("sep", 4).alias("sep"))


LABELS = NEAREST + """, labels AS (SELECT id, class FROM hits QUALIFY row_number() OVER (PARTITION BY id ORDER BY ordinal DESC) = 1)"""


@register("sky_label", with_views(
    """SELECT i.id, coalesce(class, '') AS classification, CASE WHEN class IS NULL THEN 0 ELSE 1 END AS interesting
    FROM v_images i LEFT JOIN labels l ON i.id = l.id""", "v_truth", "v_images", more=LABELS))
def sky_label(spark, sf):
    images = views.images(spark, sf)
    labels = skyjoin.label_by_truth(images, views.truth(spark, sf), 10.0)
    return skyjoin.labeled_records(images, labels).select("id", "classification", "interesting")


RELABEL = LABELS + """, best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY id ORDER BY sep, ordinal) = 1),
  r AS (SELECT i.id, l.id IS NOT NULL AS was, b.sep, b.class, coalesce(b.sep <= 1, false) AS now FROM v_images i
    LEFT JOIN labels l ON i.id = l.id LEFT JOIN best b ON i.id = b.id)"""


def _relabel(spark, sf):
    images = views.images(spark, sf)
    labels = skyjoin.label_by_truth(images, views.truth(spark, sf), 10.0)
    # Results to be labelled anew are stored ones.
    old = TableStore(spark).write(skyjoin.labeled_records(images, labels), "results")
    return skyjoin.relabel(old, views.truth(spark, sf), 10.0, 1.0)


@register("sky_relabel", with_views(
    "SELECT id, CASE WHEN now THEN class ELSE '' END AS classification, now::INT AS interesting FROM r",
    "v_truth", "v_images", more=RELABEL))
def sky_relabel(spark, sf):
    return _relabel(spark, sf)[0].select("id", "classification", "interesting")


@register("sky_relabel_audit", with_views(
    """SELECT count(*) FILTER (was) AS old_labels, count(*) FILTER (was AND sep IS NULL) AS not_recovered,
    count(*) FILTER (now) AS kept, count(*) FILTER (was AND NOT now) AS demoted FROM r""", "v_truth", "v_images", more=RELABEL))
def sky_relabel_audit(spark, sf):
    return _relabel(spark, sf)[1]


def _field(table, key, prime, steps_ra, steps_dec, more=""):
    def at(start, steps):
        return (f"({start} + CASE WHEN {key} % 3 = 0 THEN 50000000 + {key} * {steps} % {prime} ELSE {key} * {steps} % {prime} * 10000 END"
                " / 34000000000.0::DOUBLE)")
    return f"(SELECT {key} AS id, {at('150.0::DOUBLE', steps_ra)} AS ra, {at('-30.0::DOUBLE', steps_dec)} AS dec{more} FROM {table})"


FIELD = f"""field AS (SELECT i.id, o.id AS oid, o.nbref, {SEP.format(a='i', b='o')} AS sep FROM {_field("customer", "c_custkey", 10007, 7919, 3571)} i,
    {_field("part", "p_partkey", 9973, 6131, 7873, ", p_size AS nbref")} o)"""


@register("field_nearest", f"""WITH {FIELD} SELECT id, arg_min(oid, sep) AS oid, round(min(sep), 6) AS sep FROM field WHERE sep <= 3 GROUP BY id""")
def field_nearest(spark, sf):
    near = skyjoin.sky_nearest(views.field_images(spark, sf), views.field_objects(spark, sf), 3.0, right_id="oid")
    return near.select(F.col("left_id").alias("id"), F.col("right_id").alias("oid"), F.round("sep", 6).alias("sep"))


@register("field_best", f"""WITH {FIELD} SELECT id, arg_min(oid, (-nbref, oid)) AS oid, max(nbref) AS nbref FROM field WHERE sep <= 0.5 GROUP BY id""")
def field_best(spark, sf):
    best = skyjoin.best_in_cone(views.field_images(spark, sf), views.field_objects(spark, sf), 0.5, [("nbref", True)], right_id="oid", keep=["nbref"])
    return best.select(F.col("left_id").alias("id"), F.col("right_id").alias("oid"), "nbref")


CONE = f"""cone AS (SELECT i.id, o.oid, o.main_id, o.otype, coalesce(o.nbref, 0) AS nbref, {SEP.format(a='i', b='o')} AS sep
    FROM v_images i, v_objects o WHERE abs(i.dec - o.dec) < 0.01)"""


@register("sky_cone", with_views(
    "SELECT id, oid, round(sep, 4) AS sep FROM cone WHERE sep <= 3", "v_images", "v_objects", more=CONE))
def sky_cone(spark, sf):
    pairs = skyjoin.sky_cone(views.images(spark, sf), views.objects(spark, sf), 3.0, right_id="oid", spread="right")
    return pairs.select(F.col("left_id").alias("id"), F.col("right_id").alias("oid"), F.round("sep", 4).alias("sep"))


@register("cone_best", with_views(
    """SELECT id, oid, main_id AS object_name, otype AS object_type, nbref AS ref_count FROM cone WHERE sep <= 3
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY nbref DESC, oid) = 1""", "v_images", "v_objects", more=CONE))
def cone_best(spark, sf):
    return skyjoin.most_referenced(views.images(spark, sf), views.objects(spark, sf), 3.0)


@register("cone_bibliography", with_views(
    """SELECT id, main_id, bibcode, year, title FROM cone JOIN v_has_ref ON oid = oidref JOIN v_ref ON oidbibref = oidbib WHERE sep <= 3""",
    "v_images", "v_objects", "v_has_ref", "v_ref", more=CONE))
def cone_bibliography(spark, sf):
    return skyjoin.cone_bibliography(views.images(spark, sf), views.objects(spark, sf), views.has_ref(spark, sf),
                                     views.ref(spark, sf), 3.0)


MENTIONED = f"""m AS (SELECT i.id, m.mention_id, m.object_name, {SEP.format(a='i', b='m')} AS sep FROM v_images i, v_mentions m
    WHERE abs(i.dec - m.dec) < 0.01 AND sep <= 3 QUALIFY row_number() OVER (PARTITION BY i.id ORDER BY sep, m.mention_id) = 1)"""


@register("nearest_mention", with_views(
    """SELECT id, m.mention_id, object_name, coalesce(arxiv_url, '') AS arxiv_url, coalesce(summary, '') AS summary
    FROM m LEFT JOIN v_mention_texts t ON m.mention_id = t.mention_id""",
    "v_images", "v_mentions", "v_mention_texts", more=MENTIONED))
def nearest_mention(spark, sf):
    return skyjoin.nearest_mention(views.images(spark, sf), views.mentions(spark, sf), views.mention_texts(spark, sf), 3.0).drop("sep")


# Three catalogs one after the other, the last on the best-scored 200 that are left.
STEPS = MENTIONED + ", " + CONE + f""",
  s2 AS (SELECT id, main_id, otype, nbref FROM cone WHERE sep <= 1 AND id NOT IN (SELECT id FROM m)
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY nbref DESC, oid) = 1),
  left2 AS (SELECT * FROM v_images WHERE id NOT IN (SELECT id FROM m) AND id NOT IN (SELECT id FROM s2)),
  top AS (SELECT * FROM left2 ORDER BY avg_score DESC, id LIMIT 200),
  s3 AS (SELECT i.id, o.oid, o.prefphytype, o.n_crosref, {SEP.format(a='i', b='o')} AS sep FROM top i, v_second o
    WHERE abs(i.dec - o.dec) < 0.01 AND sep <= 1.6 QUALIFY row_number() OVER (PARTITION BY i.id ORDER BY sep, o.oid) = 1),
  found AS (SELECT id, 'HF' AS matched_source, object_name, NULL AS object_type, NULL::BIGINT AS ref_count FROM m
    UNION ALL SELECT id, 'SIMBAD', main_id, otype, nbref FROM s2
    UNION ALL SELECT id, 'NED', 'ned ' || oid, prefphytype, n_crosref FROM s3)"""
STEP_VIEWS = ("v_images", "v_mentions", "v_objects", "v_second")


def _cascade(spark, sf):
    seen = views.mentions(spark, sf).withColumnsRenamed({"resolved_ra_deg": "ra", "resolved_dec_deg": "dec"})
    name = F.when(F.col("resolved_name") != "", F.col("resolved_name")).otherwise(F.col("ned_object_name"))
    catalogs = [
        Catalog("HF", seen, 3.0, "mention_id", {"object_name": name}),
        Catalog("SIMBAD", views.objects(spark, sf), 1.0, "oid",
                {"object_name": F.col("main_id"), "object_type": F.col("otype"), "ref_count": F.coalesce("nbref", F.lit(0))},
                pick=[(F.coalesce("nbref", F.lit(0)), True)]),
        Catalog("NED", views.second_objects(spark, sf), 1.6, "oid",
                {"object_name": F.concat(F.lit("ned "), F.col("oid").cast("string")), "object_type": F.col("prefphytype"),
                 "ref_count": F.col("n_crosref")}, top_n=200),
    ]
    return cascade(views.images(spark, sf), catalogs, id_col="id")


@register("cascade_matched", with_views(
    "SELECT f.*, avg_score, segment FROM found f JOIN v_images i ON f.id = i.id", *STEP_VIEWS, more=STEPS))
def cascade_matched(spark, sf):
    return _cascade(spark, sf)[0].select("id", "matched_source", "object_name", "object_type", "ref_count", "avg_score", "segment")


@register("cascade_unmatched", with_views(
    """SELECT i.id, avg_score, CASE WHEN id IN (SELECT id FROM top) THEN 1 ELSE 0 END AS checked_ned FROM v_images i
    WHERE id NOT IN (SELECT id FROM found)""", *STEP_VIEWS, more=STEPS))
def cascade_unmatched(spark, sf):
    return _cascade(spark, sf)[1].select("id", "avg_score", "checked_ned")


# --- matches by name -----------------------------------------------------------


@register("metadata_enrich", """SELECT c_name, round(r, 6) AS volunteer_rating, ra AS RA, url AS URL FROM customer LEFT JOIN (
    SELECT 'Customer#' || lpad(user_id::VARCHAR, 9, '0') AS stem, last(value * 0.01 ORDER BY event_id) AS r,
    last(event_id ORDER BY event_id) AS ra, last(props ORDER BY event_id) AS url FROM events GROUP BY user_id) m ON m.stem = c_name""")
def metadata_enrich(spark, sf):
    e = views.table(spark, sf, "events")
    subjects = e.select(
        F.concat(F.lit(" Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0"), F.lit(".png")).alias("filename"),
        F.col("event_id").alias("RA"), F.col("value").alias("Dec"), F.lit(0.0).alias("anomaly_score"), F.col("props").alias("URL"),
        F.col("value").alias("normalized_weighted_count"), F.col("event_id").alias("ordinal"))
    results = views.table(spark, sf, "customer").select("c_name", F.concat("c_name", F.lit(".jpg")).alias("filename"))
    found = matching.enrich(results, matching.metadata_lookup(subjects, "ordinal"))
    return r6(found.select("c_name", "volunteer_rating", "RA", "URL"))


NAME_KEYS = """SELECT {row} AS row, unnest(list_distinct([n, regexp_extract(n, '([^/]*)$', 1), s, lower(n), lower(regexp_extract(n, '([^/]*)$', 1)), lower(s)])) AS k
    FROM (SELECT *, regexp_replace(regexp_extract(n, '([^/]*)$', 1), '([^./])\\.[^./]*$', '\\1') AS s FROM ({src}))"""


@register("filename_match", with_views("""SELECT l.n AS url, min(r.row) AS page_id FROM (SELECT DISTINCT row AS n, k FROM l0) l
    LEFT JOIN (SELECT k, min(row) AS row FROM r0 GROUP BY k) r ON l.k = r.k AND r.k != '' GROUP BY l.n""", more=
    "l0 AS (" + NAME_KEYS.format(row="n", src="SELECT url AS n FROM pages") + "), r0 AS ("
    + NAME_KEYS.format(row="id", src="SELECT page_id + 1000000 AS id, '/p/' || upper(regexp_extract(url, '([^/]*)$', 1)) || '.JPG' AS n FROM pages")
    + ")"))
def filename_match(spark, sf):
    pages = views.table(spark, sf, "pages")
    left = pages.select("url").distinct()
    base = F.upper(F.regexp_extract("url", r"([^/]*)$", 1))
    right = pages.select((F.col("page_id") + 1000000).alias("page_id"), F.concat(F.lit("/p/"), base, F.lit(".JPG")).alias("name"))
    return matching.match_by_name(left, right, "url", "name", "page_id")


@register("resume_anti", """SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)""")
def resume_anti(spark, sf):
    done = views.table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return matching.unmatched(views.table(spark, sf, "part").select("p_partkey"), done, "p_partkey")


@register("mark_done", """SELECT p_partkey, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) THEN 1 ELSE 0 END AS matched FROM part""")
def mark_done(spark, sf):
    parts = views.table(spark, sf, "part").select("p_partkey")
    done = parts.limit(0).withColumn("matched", F.lit(1))
    found = views.table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return matching.mark_done(done, parts, found, "p_partkey")


@register("missing_and_extra", """SELECT c_custkey AS id, 'missing' AS problem FROM customer WHERE c_custkey NOT IN (SELECT o_custkey * 2 FROM orders)
    UNION ALL SELECT DISTINCT o_custkey * 2, 'extra' FROM orders WHERE o_custkey * 2 NOT IN (SELECT c_custkey FROM customer)""")
def missing_and_extra(spark, sf):
    customers = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    seen = views.table(spark, sf, "orders").select((F.col("o_custkey") * 2).alias("id"))
    return report.missing_and_extra(customers, seen, "id")
