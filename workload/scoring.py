"""Queries on sampling, assignment and the scoring protocols, judged by rules on md5."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysift.functions import numbers
from skysift.operators import assignment
from skysift.operators.ordering import hash_key
from skysift.plans import protocols
from skysift.plans.judges import best_of_pair, rule_judge
from workload import views
from workload.registry import register
from workload.views import md5_key

SEED = 42
RUNS = {1: 44, 2: 45, 3: 46}  # run -> seed


# --- assignment ---------------------------------------------------------------------

PLACED = f"""SELECT c_custkey AS id, row_number() OVER (ORDER BY {md5_key("'42'", "'3'", "c_custkey")}, c_custkey) - 1 AS idx,
    count(*) OVER () AS n FROM customer"""


def _pool(spark, sf):
    return views.judged_items(spark, sf).withColumn("run", F.lit(1))


@register("assign_groups", f"""SELECT id, idx, CASE WHEN idx < n - n % 7 THEN idx // 7 + 1 END AS grp,
    CASE WHEN idx < n - n % 7 THEN idx % 7 + 1 END AS slot FROM ({PLACED})""")
def assign_groups(spark, sf):
    return assignment.assign_groups(_pool(spark, sf), 7, SEED, 3).select("id", "idx", "grp", "slot")


@register("assign_groups_ragged", f"SELECT id, idx // 7 + 1 AS grp, idx % 7 + 1 AS slot FROM ({PLACED})")
def assign_groups_ragged(spark, sf):
    return assignment.assign_groups(_pool(spark, sf), 7, SEED, 3, leftover="ragged").select("id", "grp", "slot")


@register("assign_pairs", f"SELECT id, CASE WHEN idx < n - n % 2 THEN idx // 2 + 1 END AS grp FROM ({PLACED})")
def assign_pairs(spark, sf):
    return assignment.assign_pairs(_pool(spark, sf), SEED, 3).select("id", "grp")


BATCHES = f"""SELECT c_custkey AS id, copy, row_number() OVER (ORDER BY {md5_key("'42'", "'0'", "c_custkey", "copy")}, c_custkey, copy) - 1 AS idx
    FROM customer, generate_series(1, 10) t(copy)"""


@register("assign_batches", f"SELECT id, copy, idx // 16 + 1 AS batch, idx % 16 + 1 AS slot FROM ({BATCHES})")
def assign_batches(spark, sf):
    return assignment.assign_batches(_pool(spark, sf), 10, 16, SEED).select("id", "copy", "batch", "slot")


@register("stratified_subset", f"""WITH r AS (SELECT run, seed, c_custkey AS id, CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS interesting
      FROM customer, (VALUES (1, 44), (2, 45), (3, 46)) s(run, seed)),
    p AS (SELECT *, row_number() OVER (PARTITION BY run, interesting ORDER BY {md5_key("seed", "'-1'", "id")}, id) AS place,
      sum(interesting) OVER (PARTITION BY run) AS pos FROM r),
    k AS (SELECT * FROM p WHERE interesting = 1 OR place <= 800 - pos)
    SELECT run, id, interesting, row_number() OVER (PARTITION BY run ORDER BY {md5_key("seed", "'0'", "id")}, id) - 1 AS index FROM k""")
def stratified_subset(spark, sf):
    records = views.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(0).alias("interesting"))
    return assignment.stratified_subset(records, 800, list(RUNS.values())).select("run", "id", "interesting", "index")


@register("fixed_slice", "SELECT c_custkey AS id FROM customer ORDER BY c_custkey LIMIT 100")
def fixed_slice(spark, sf):
    return assignment.fixed_slice(views.judged_items(spark, sf), 100)


# --- protocols ------------------------------------------------------------------------


def keeps(share: int):
    """Keep an image in a round by a draw on (round, id)."""
    draw = hash_key(F.lit("keep"), "round", "id") % 10
    return rule_judge(F.when(draw < share, 1).otherwise(0))


def _kept(share: int, r: int) -> str:
    return f"""({md5_key("'keep'", f"'{r}'", "id")} % 10 < {share})"""


def strength():
    return best_of_pair(hash_key(F.lit("strength"), "id"))


def _seeded(spark, sf):
    return assignment.with_runs(views.judged_items(spark, sf), list(RUNS.values()))


START = "p0 AS (SELECT run, seed, c_custkey AS id, 0 AS score FROM customer, (VALUES (1, 44), (2, 45), (3, 46)) s(run, seed))"


def _rounds(n: int, size: int, share: int, start: str = START) -> str:
    """CTEs of n retention rounds: pool, places, kept rows with their score."""
    parts = [start]
    for r in range(1, n + 1):
        parts.append(f"""g{r} AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY {md5_key("seed", f"'{r}'", "id")}, id) - 1 AS idx,
            count(*) OVER (PARTITION BY run) AS n FROM p{r - 1}),
          p{r} AS (SELECT run, seed, id, score + 1 AS score FROM g{r} WHERE idx >= n - n % {size} OR {_kept(share, r)})""")
    return "WITH " + ",\n".join(parts)


def _best_score(n: int) -> str:
    """Highest score each image reached; 0 for none."""
    union = " UNION ALL ".join(f"SELECT run, id, score FROM p{r}" for r in range(n + 1))
    return f"SELECT run, id, max(score)::BIGINT AS imagescore FROM ({union}) GROUP BY run, id"


@register("retention_tournament", _rounds(10, 4, 7) + _best_score(10))
def retention_tournament(spark, sf):
    return protocols.retention(_seeded(spark, sf), keeps(7), size=4).scores


@register("retention_log", _rounds(2, 4, 7) + """SELECT run, 1 AS round, id, idx, CASE WHEN idx < n - n % 4 THEN idx // 4 + 1 END AS grp,
    CASE WHEN idx >= n - n % 4 OR """ + _kept(7, 1) + " THEN 1 ELSE 0 END AS kept FROM g1 UNION ALL SELECT run, 2, id, idx, "
    "CASE WHEN idx < n - n % 4 THEN idx // 4 + 1 END, CASE WHEN idx >= n - n % 4 OR " + _kept(7, 2) + " THEN 1 ELSE 0 END FROM g2")
def retention_log(spark, sf):
    out = protocols.retention(_seeded(spark, sf), keeps(7), size=4, stop=protocols.rounds(2))
    return out.log.select("run", "round", "id", "idx", "grp", "kept")


def _elimination() -> str:
    """Rounds until one is left; a pool of one goes through unchanged. Each row stands with the size of its pool."""
    strong = md5_key("'strength'", "id")
    return f"""WITH RECURSIVE p AS (SELECT c_custkey AS id, 0 AS score, count(*) OVER () AS n FROM customer UNION ALL
      SELECT id, score + 1, count(*) OVER () FROM (SELECT * FROM (
          SELECT *, row_number() OVER (ORDER BY {md5_key("'42'", "score + 1", "id")}, id) - 1 AS idx FROM p WHERE n > 1)
        QUALIFY row_number() OVER (PARTITION BY idx // 2 ORDER BY {strong} DESC, idx) = 1))
    """


@register("single_elimination", _elimination() + "SELECT id, max(score)::BIGINT AS imagescore FROM p GROUP BY id")
def single_elimination(spark, sf):
    return protocols.elimination(views.judged_items(spark, sf), strength(), seed=SEED).scores.select("id", "imagescore")


@register("champion", _elimination() + "SELECT id, score::BIGINT AS imagescore FROM p WHERE n = 1")
def champion(spark, sf):
    out = protocols.elimination(views.judged_items(spark, sf), strength(), seed=SEED)
    return protocols.champion(out).select("id", "imagescore")


def grades():
    """Grade an image by a draw on its place; about half the places select it."""
    draw = hash_key(F.lit("grade"), "idx", "id") % 10
    # Draws 0 to 4 are grades 1 to 5, others none; the draw is worked out once.
    return rule_judge(F.get(F.array(*[F.lit(g) for g in range(1, 6)]), draw.cast("int")), "score")


def _graded(pool: str, size: int) -> str:
    return f"""b AS (SELECT run, seed, id, copy, row_number() OVER (PARTITION BY run ORDER BY {md5_key("seed", "'0'", "id", "copy")}, id, copy) - 1 AS idx
      FROM {pool}, generate_series(1, 10) t(copy)),
    s AS (SELECT run, id, {md5_key("'grade'", "idx", "id")} % 10 + 1 AS grade FROM b WHERE {md5_key("'grade'", "idx", "id")} % 10 < 5)"""


@register("rating_grid", "WITH " + START + ", " + _graded("p0", 16) + """SELECT p0.run, p0.id, coalesce(sum(grade), 0)::BIGINT AS imagescore
    FROM p0 LEFT JOIN s ON p0.run = s.run AND p0.id = s.id GROUP BY p0.run, p0.id""")
def rating_grid(spark, sf):
    return protocols.rating_grid(_seeded(spark, sf), grades()).scores


@register("selection_grid", "WITH " + START + ", " + _graded("p0", 9) + """SELECT p0.run, p0.id, count(grade) AS imagescore
    FROM p0 LEFT JOIN s ON p0.run = s.run AND p0.id = s.id GROUP BY p0.run, p0.id""")
def selection_grid(spark, sf):
    return protocols.rating_grid(_seeded(spark, sf), grades(), side=3, score="count").scores


@register("hybrid", _rounds(1, 4, 7) + ", " + _graded("p1", 16) + """SELECT p0.run, p0.id, coalesce(sum(grade), 0)::BIGINT AS imagescore
    FROM p0 LEFT JOIN s ON p0.run = s.run AND p0.id = s.id GROUP BY p0.run, p0.id""")
def hybrid(spark, sf):
    return protocols.hybrid(_seeded(spark, sf), keeps(7), grades())[2]


@register("weak_stop", _rounds(2, 2, 9) + """, n1 AS (SELECT run, (SELECT count(*) FROM p0 x WHERE x.run = p1.run) - count(*) AS removed FROM p1 GROUP BY run)
    SELECT p0.run, p0.id, CASE WHEN removed < 20 THEN p1.id IS NOT NULL ELSE p2.id IS NOT NULL END::INT::BIGINT AS imagescore FROM p0
    JOIN n1 ON p0.run = n1.run LEFT JOIN p1 ON p0.run = p1.run AND p0.id = p1.id LEFT JOIN p2 ON p0.run = p2.run AND p0.id = p2.id""")
def weak_stop(spark, sf):
    out = protocols.retention(_seeded(spark, sf), keeps(9), size=2, stop=protocols.weak(), score="final")
    return out.scores.withColumn("imagescore", F.col("imagescore").cast("bigint"))


def _to_target(left: int) -> str:
    """Rounds that remove at most as many as the target allows, first places first, until the target is reached."""
    return f"""WITH RECURSIVE p AS (SELECT c_custkey AS id, 0 AS round, count(*) OVER () AS n FROM customer UNION ALL
      SELECT id, round + 1, count(*) OVER () FROM (SELECT *, row_number() OVER (PARTITION BY kept ORDER BY idx) AS place FROM (
          SELECT *, {md5_key("'keep'", "round + 1", "id")} % 10 < 7 AS kept,
            row_number() OVER (ORDER BY {md5_key("'42'", "round + 1", "id")}, id) - 1 AS idx FROM p WHERE n > {left}))
        WHERE kept OR place > n - {left})
    SELECT c_custkey AS id, (c_custkey IN (SELECT id FROM p WHERE n <= {left}))::INT::BIGINT AS imagescore FROM customer"""


@register("exact_target", _to_target(100))
def exact_target(spark, sf):
    out = protocols.retention(views.judged_items(spark, sf), keeps(7), size=4, stop=protocols.target(100), seed=SEED,
                              leftover="ragged", score="final")
    return out.scores.select("id", F.col("imagescore").cast("bigint").alias("imagescore"))


@register("result_assembly", _rounds(3, 4, 6) + """, best AS (""" + _best_score(3) + """),
    why AS (SELECT user_id AS id, last(event_type ORDER BY event_id) AS reasoning FROM events GROUP BY user_id)
    SELECT run, b.id, imagescore, CASE WHEN imagescore > 0 THEN coalesce(reasoning, '') ELSE '' END AS reasoning, c_mktsegment AS segment,
      CASE WHEN imagescore >= 2.1 THEN 'high' WHEN imagescore >= 1.2 THEN 'middle' ELSE 'low' END AS tier
    FROM best b JOIN customer ON c_custkey = b.id LEFT JOIN why ON why.id = b.id""")
def result_assembly(spark, sf):
    out = protocols.retention(_seeded(spark, sf), keeps(6), size=4, stop=protocols.rounds(3))
    meta = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    e = views.table(spark, sf, "events")
    why = e.groupBy(F.col("user_id").alias("id")).agg(F.max_by("event_type", "event_id").alias("reasoning"))
    rows = protocols.assemble(out.scores, meta, why)
    return rows.withColumn("tier", numbers.score_tier("imagescore", 3.0))
