"""Sky joins against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysift.operators import skyjoin
from skysift.plans.cascade import Catalog, cascade


def sep(a, b):
    r1, d1, r2, d2 = map(math.radians, (*a, *b))
    h = math.sin((d2 - d1) / 2) ** 2 + math.cos(d1) * math.cos(d2) * math.sin((r2 - r1) / 2) ** 2
    return math.degrees(2 * math.asin(math.sqrt(min(1, h)))) * 3600


def field(rng, n, kind):
    out = []
    for _ in range(n):
        if kind == "wrap":
            p = ((rng.uniform(-0.004, 0.004)) % 360, rng.uniform(-0.004, 0.004))
        elif kind == "north":
            p = (rng.uniform(0, 360), 90 - abs(rng.gauss(0, 0.003)))
        elif kind == "south":
            p = (rng.uniform(0, 360), -90 + abs(rng.gauss(0, 0.003)))
        elif kind == "high":
            p = (rng.uniform(120.0, 120.2), 88 + rng.uniform(0, 0.004))
        else:
            p = (rng.uniform(200, 200.01), rng.uniform(-30.01, -30))
        out.append(p)
    return out


def frame(spark, points):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, ra double, dec double").repartition(3)


@pytest.mark.parametrize("kind", ["plain", "wrap", "north", "south", "high"])
@pytest.mark.parametrize("radius", [3.0, 10.0])
@pytest.mark.parametrize("spread", ["left", "right"])
def test_cone_equals_brute_force(spark, kind, radius, spread):
    rng = random.Random(f"{kind}{radius}")
    a, b = field(rng, 150, kind), field(rng, 150, kind)
    want = {(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if sep(p, q) <= radius}
    got = skyjoin.sky_cone(frame(spark, a), frame(spark, b), radius, spread=spread).collect()
    assert len(got) == len({(r["left_id"], r["right_id"]) for r in got})
    assert {(r["left_id"], r["right_id"]) for r in got} == want and want


def separations(a, b):
    """All distances in arc seconds, a row per entry of a."""
    (r1, d1), (r2, d2) = (np.radians(np.array(x)).T for x in (a, b))
    h = np.sin((d2 - d1[:, None]) / 2) ** 2 + np.cos(d1[:, None]) * np.cos(d2) * np.sin((r2 - r1[:, None]) / 2) ** 2
    return np.degrees(2 * np.arcsin(np.sqrt(np.minimum(1, h)))) * 3600


def crowds(rng):
    """Thousands of positions in one cell: even, in a tight knot, on a line, and searches from inside, beside and far off."""
    even = [(200 + rng.uniform(0, 0.003), -30 + rng.uniform(0, 0.003)) for _ in range(600)]
    knot = [(200.0011 + rng.gauss(0, 1e-7), -29.9989 + rng.gauss(0, 1e-7)) for _ in range(600)]
    line = [(200.002 + k * 1e-9, -29.998) for k in range(400)]
    return even + knot + line


@pytest.mark.parametrize("kind", ["plain", "wrap", "north", "south", "high", "crowd"])
@pytest.mark.parametrize("radius", [2.0, 10.0])
def test_nearest_equals_brute_force(spark, kind, radius):
    rng = random.Random(kind)
    a, b = (crowds(rng), crowds(rng)) if kind == "crowd" else (field(rng, 200, kind), field(rng, 200, kind))
    a += [a[0]] * 50  # many rows at one place
    b += [b[3]] * 50
    seps = separations(a, b)
    got = skyjoin.sky_nearest(frame(spark, a), frame(spark, b), radius)
    found = {r["left_id"]: (r["right_id"], r["sep"]) for r in got.collect()}
    nearest = seps.min(axis=1)
    assert set(found) == set(np.flatnonzero(nearest <= radius).tolist())
    for i, (j, s) in found.items():
        # Where rounding decides between two, either is right; copies go to the first.
        assert abs(seps[i, j] - nearest[i]) <= 1e-9 and abs(s - nearest[i]) <= 1e-9
        assert j == b.index(b[j])


@pytest.mark.parametrize("kind", ["plain", "north", "crowd"])
def test_best_equals_brute_force(spark, kind):
    rng = random.Random(8)
    a, b = (crowds(rng)[::3], crowds(rng)) if kind == "crowd" else (field(rng, 150, kind), field(rng, 300, kind))
    b += [b[3]] * 40
    rank = [rng.choice([None, *range(20)]) for _ in b]
    inside = separations(a, b) <= 6
    key = sorted(range(len(b)), key=lambda j: (rank[j] is None, -(rank[j] or 0), j))
    place = np.argsort(key)
    want = {i: key[place[row].min()] for i, row in enumerate(inside) if row.any()}
    right = frame(spark, b).join(spark.createDataFrame(list(enumerate(rank)), "id long, rank int"), "id")
    got = skyjoin.best_in_cone(frame(spark, a), right, 6.0, [("rank", True)], keep=["rank"])
    assert {r["left_id"]: r["right_id"] for r in got.collect()} == want


def test_no_job_runs_while_a_search_is_built_and_each_side_is_read_once(spark, tmp_path):
    rng = random.Random(4)
    for name in ("left", "right"):
        frame(spark, crowds(rng)).write.parquet(f"{tmp_path}/{name}")
    left, right = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("left", "right"))
    spark.sparkContext.setJobGroup("build", "build")
    out = skyjoin.sky_nearest(left, right, 3.0)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("build")
    spark.sparkContext.setJobGroup("run", "run")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert final.count("FileScan parquet") <= 2


def test_descending_order_needs_a_number(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, "a")], "id long, ra double, dec double, name string")
    with pytest.raises(ValueError):
        skyjoin.best_in_cone(df, df, 1.0, [("name", True)], keep=["name"])


def test_result_does_not_depend_on_partitions(spark):
    rng = random.Random(5)
    a, b = field(rng, 100, "plain"), field(rng, 100, "plain")
    rows = []
    for n in (1, 7):
        got = skyjoin.sky_nearest(frame(spark, a).repartition(n), frame(spark, b).repartition(n), 10.0)
        rows.append(sorted(map(tuple, got.collect())))
    assert rows[0] == rows[1]


def test_nulls_and_exact_radius(spark):
    left = spark.createDataFrame([(1, 10.0, 0.0), (2, None, 0.0), (3, 10.0, None)], "id long, ra double, dec double")
    right = spark.createDataFrame([(1, 10.0, 0.001)], "id long, ra double, dec double")
    exact = left.crossJoin(right.select(F.col("ra").alias("r"), F.col("dec").alias("d"))).filter("id = 1").select(
        skyjoin.sky.separation_arcsec(F.col("ra"), F.col("dec"), F.col("r"), F.col("d"))).first()[0]
    assert [r["left_id"] for r in skyjoin.sky_cone(left, right, exact).collect()] == [1]
    assert skyjoin.sky_cone(left, right, exact - 1e-6).count() == 0


TRUTH = "ordinal long, ra double, dec double, class string"


def test_labels_last_entry_wins_and_relabel_closest_wins(spark):
    images = spark.createDataFrame([(1, 10.0, 0.0), (2, 20.0, 0.0), (3, 30.0, 0.0)], "id long, ra double, dec double")
    s = 1 / 3600
    truth = spark.createDataFrame(
        [(0, 10.0, 1 * s, "near"), (1, 10.0, 5 * s, "far"), (2, 20.0, 8 * s, " wide "), (3, 30.0, 11 * s, "out"), (4, None, 1.0, "x")], TRUTH)
    labels = skyjoin.label_by_truth(images, truth, 10.0)
    assert {r["id"]: r["classification"] for r in labels.collect()} == {1: "far", 2: "wide"}
    records = skyjoin.labeled_records(images, labels)
    assert {r["id"]: (r["interesting"], r["classification"]) for r in records.collect()} == {1: (1, "far"), 2: (1, "wide"), 3: (0, "")}
    new, audit = skyjoin.relabel(records, truth)
    assert {r["id"]: (r["interesting"], r["classification"]) for r in new.collect()} == {1: (1, "near"), 2: (0, ""), 3: (0, "")}
    assert audit.first().asDict() == {"old_labels": 2, "not_recovered": 0, "kept": 1, "demoted": 1}


def test_audit_reports_labels_not_recovered(spark):
    old = spark.createDataFrame([(1, 10.0, 0.0, 1, "a")], "id long, ra double, dec double, interesting int, classification string")
    truth = spark.createDataFrame([(0, 50.0, 0.0, "a")], TRUTH)
    assert skyjoin.relabel(old, truth)[1].first().asDict() == {"old_labels": 1, "not_recovered": 1, "kept": 0, "demoted": 1}


def test_cascade(spark):
    items = spark.createDataFrame(
        [(f"f{i}", float(i), 10.0 * i, 0.0) for i in range(1, 6)] + [("nowhere", 9.0, None, None)],
        "filename string, avg_score double, ra double, dec double")
    one = spark.createDataFrame([(1, 10.0, 0.0)], "id long, ra double, dec double")
    two = spark.createDataFrame([(1, 10.0, 0.0, 5), (2, 20.0, 0.0, None), (3, 20.0, 0.0001, 2)], "id long, ra double, dec double, refs int")
    three = spark.createDataFrame([(i, 10.0 * i, 0.0) for i in (3, 4)], "id long, ra double, dec double")
    name = {"object_name": F.concat(F.lit("o"), F.col("id").cast("string"))}
    matched, left = cascade(items, [
        Catalog("HF", one, 3.0, columns=name),
        Catalog("SIMBAD", two, 3.0, columns=name, pick=[(F.coalesce("refs", F.lit(0)), True)]),
        Catalog("NED", three, 3.0, columns=name, top_n=3),
    ])
    assert {r["filename"]: (r["matched_source"], r["object_name"]) for r in matched.collect()} == {
        "f1": ("HF", "o1"), "f2": ("SIMBAD", "o3"), "f4": ("NED", "o4")}
    # The best three of what is left go to the last catalog: nowhere, f5, f4.
    assert {r["filename"]: r["checked_ned"] for r in left.collect()} == {"f3": 0, "f5": 1, "nowhere": 1}


def test_mentions(spark):
    images = spark.createDataFrame([("a", 1.0, 0.0), ("b", 2.0, 0.0), ("c", 3.0, 0.0)], "id string, ra double, dec double")
    seen = spark.createDataFrame(
        [("m1", 1.0, 0.0, "", "NGC 1"), ("m2", 2.0, 0.0, "M 2", "NGC 2"), ("m3", 3.0, 0.01, None, None)],
        "mention_id string, resolved_ra_deg double, resolved_dec_deg double, resolved_name string, ned_object_name string")
    texts = spark.createDataFrame([("m2", "u", "s")], "mention_id string, arxiv_url string, summary string")
    got = {r["id"]: (r["object_name"], r["arxiv_url"], r["summary"]) for r in skyjoin.nearest_mention(images, seen, texts).collect()}
    assert got == {"a": ("NGC 1", "", ""), "b": ("M 2", "u", "s")}


def test_many_searches_from_few_positions(spark):
    """Each position is searched from once, and all that stand there get its answer with their own columns."""
    rng = random.Random(5)
    spots = [(200.0 + rng.random() / 1000, 10.0 + rng.random() / 1000) for _ in range(20)]
    left = spark.createDataFrame([(i, *spots[i % 20], f"c{i}") for i in range(2000)], "id long, ra double, dec double, class string")
    right = spark.createDataFrame([(j, 200.0 + rng.random() / 1000, 10.0 + rng.random() / 1000) for j in range(300)], "oid long, ra double, dec double")
    found = skyjoin.best_in_cone(left, right, 3.0, right_id="oid", left_keep=["class"]).collect()
    assert len(found) == 2000 and all(r["class"] == f"c{r['left_id']}" for r in found)
    one = {r["left_id"]: (r["right_id"], r["sep"]) for r in skyjoin.best_in_cone(left.filter("id < 20"), right, 3.0, right_id="oid").collect()}
    assert all((r["right_id"], r["sep"]) == one[r["left_id"] % 20] for r in found)
    plan = skyjoin.best_in_cone(left, right, 3.0, right_id="oid")._jdf.queryExecution().optimizedPlan().toString()
    assert "min(mine" in plan
