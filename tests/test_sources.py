"""Readers, sinks and streams on small written files."""

import datetime

import pytest
from pyspark.sql import functions as F

from skysift.operators import matching
from skysift.sources import readers, sinks
from skysift.sources.schemas import MissingColumns, require_columns
from skysift.streaming import progress

RESULT_A = """index,filename,imagescore,interesting,classification,SourceRA,SourceDec
0,/d/a.png,5,1,Ring,10.5,-3.25
1,b.png,x,0,,,
2,c.png,2,0,,,
3,c.png,3,yes,,,

# TOKEN USAGE SUMMARY
# TotalInputTokens,"1,234"
# TotalOutputTokens,56
# TotalTokens,1290
# TotalCostUSD,0.5
"""
RESULT_A2 = "﻿Filename,ImageScore,interesting,classification,SourceRA,SourceDec\nd.png,1,1,Lens,,\n"
RESULT_B = """Filename,ImageScore,Reasoning,RA,Dec,AnomalyScore,URL,volunteer_rating
e.png,7,"two, ""quoted""
lines",1.5,2.5,n/a,http://x,0.4
"""


@pytest.fixture
def results(tmp_path):
    folder = tmp_path / "runs" / "qwen_likert"
    folder.mkdir(parents=True)
    (tmp_path / "runs" / "gemini_tournament_1.csv").write_text(RESULT_A, encoding="utf-8")
    (tmp_path / "runs" / "gemini_tournament_2.csv").write_text(RESULT_A2, encoding="utf-8")
    (folder / "run_1.csv").write_text(RESULT_B, encoding="utf-8")
    (folder / "notes.csv").write_text("a,b\n1,2\n", encoding="utf-8")
    return str(tmp_path / "runs")


def test_results_of_any_header(spark, results):
    rows, meta = readers.read_results(spark, results)
    got = {(r["stem"], r["image"], r["score"]): r for r in rows.collect()}
    assert set(got) == {("gemini_tournament_1", "a.png", 5.0), ("gemini_tournament_1", "c.png", 2.0), ("gemini_tournament_1", "c.png", 3.0),
                        ("gemini_tournament_2", "d.png", 1.0), ("run_1", "e.png", 7.0)}
    a = got[("gemini_tournament_1", "a.png", 5.0)]
    assert (a["truth"], a["classification"], a["ra"], a["dec"]) == (1, "Ring", 10.5, -3.25)
    e = got[("run_1", "e.png", 7.0)]
    assert e["parent"] == "qwen_likert" and e["reasoning"] == 'two, "quoted"\nlines' and e["truth"] is None
    assert e["anomaly_score"] is None and e["volunteer_rating"] == 0.4
    last = {(r["stem"], r["image"]): (r["score"], r["truth"]) for r in readers.last_rows(rows).collect()}
    assert last[("gemini_tournament_1", "c.png")] == (3.0, 1) and len(last) == 4
    tokens = {r["stem"]: (r["input_tokens"], r["output_tokens"], r["total_tokens"], r["cost_usd"]) for r in meta.collect()}
    assert tokens == {"gemini_tournament_1": (1234, 56, 1290, 0.5), "gemini_tournament_2": (None,) * 4, "run_1": (None,) * 4}


def test_votes(spark, tmp_path):
    (tmp_path / "expert_scores_Ann Lee.csv").write_text("name,url,interesting\n/p/x.png,u,Yes\n,u,1\nx.png,,no\n", encoding="utf-8")
    (tmp_path / "expert_scores_Bob.csv").write_text("Filename,vote\ny.png,selected\n", encoding="utf-8")
    (tmp_path / "other.csv").write_text("name,interesting\nz.png,1\n", encoding="utf-8")
    votes = readers.read_votes(spark, str(tmp_path))
    assert {(r["image"], r["expert"], r["vote"]) for r in votes.collect()} == {("x.png", "Ann Lee", 1), ("x.png", "Ann Lee", 0), ("y.png", "Bob", 1)}
    from skysift.operators.agreement import first_urls, latest_votes

    assert {(r["image"], r["vote"]) for r in latest_votes(votes).collect()} == {("x.png", 0), ("y.png", 1)}
    assert [(r["image"], r["url"]) for r in first_urls(votes).collect()] == [("x.png", "u")]
    few = spark.createDataFrame([("y.png",)], "image string")
    assert [r["image"] for r in readers.expert_images(votes, few).collect()] == ["x.png"]


def test_catalog_last_row_wins_and_reads_three_columns(spark, tmp_path):
    path = str(tmp_path / "catalog")
    rows = spark.createDataFrame([(1, 10.0, 1.0, "F814W"), (2, 20.0, 2.0, "x"), (1, 11.0, 1.5, "y")],
                                 "SourceID long, SourceRA double, SourceDec double, Filter string").coalesce(1)
    rows.write.parquet(path)
    got = readers.read_coordinates(spark, path)
    assert {r["id"]: (r["ra"], r["dec"]) for r in got.collect()} == {"1": (11.0, 1.5), "2": (20.0, 2.0)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "struct<SourceID:bigint,SourceRA:double,SourceDec:double>" in plan
    with pytest.raises(MissingColumns, match="SourceID"):
        spark.range(3).write.parquet(str(tmp_path / "bad"))
        readers.read_coordinates(spark, str(tmp_path / "bad"))


def test_truth_keeps_file_order(spark, tmp_path):
    f = tmp_path / "truth.csv"
    f.write_text("SourceID,Classification,RA,Dec,Referenced\n1, Ring ,10,1,y\n2,Lens,bad,2,n\n", encoding="utf-8")
    got = readers.read_truth(spark, str(f)).orderBy("ordinal").collect()
    assert [(r["class"], r["ra"], r["dec"]) for r in got] == [("Ring", 10.0, 1.0), ("Lens", None, 2.0)]
    f.write_text("SourceID,RA,Dec\n", encoding="utf-8")
    with pytest.raises(MissingColumns, match="Classification"):
        readers.read_truth(spark, str(f))


def test_volunteer_files(spark, tmp_path):
    (tmp_path / "subjects.csv").write_text(
        "subject_id,count,selected_count,unique_user_count,filename,RA,Dec,URL,anomaly_score,image_score,feature_score,percent_selected,normalized_weighted_count\n"
        "86394676,20,3,18,69590307125089141,229.6,42.3,http://a,217.71469,207.23587,259.62997,16.67,25.0\n"
        "1,2,3\n"
        "86394677,12,0,11,70413712485288973,245.3,44.3,http://b,222.18658,209.88295,271.40112,0.0,\n", encoding="utf-8")
    rows = readers.read_subjects(spark, str(tmp_path / "subjects.csv"), drop_malformed=True).orderBy("ordinal").collect()
    assert [r["filename"] for r in rows] == ["69590307125089141", "70413712485288973"]  # text, all digits kept
    lookup = matching.metadata_lookup(readers.read_subjects(spark, str(tmp_path / "subjects.csv")), "ordinal")
    results = spark.createDataFrame([("69590307125089141.png",), ("70413712485288973.png",), ("none.png",)], "filename string")
    got = {r["filename"]: (r["volunteer_rating"], r["URL"]) for r in matching.enrich(results, lookup).collect()}
    assert got == {"69590307125089141.png": (0.25, "http://a"), "70413712485288973.png": (None, "http://b"), "none.png": (None, None)}

    (tmp_path / "consensus.dat").write_text("subject_id count selected_count unique_user_count\n88387883 21 4 20\n", encoding="utf-8")
    assert tuple(readers.read_consensus(spark, str(tmp_path / "consensus.dat")).first()) == (88387883, 21, 4, 20)

    (tmp_path / "meta.csv").write_text(
        "subject_id,project_id,workflow_id,subject_set_id,metadata,locations,classifications_count,retired_at,retirement_reason,created_at,updated_at\n"
        '458021,14993,17619,92123,"{""link"":""http://x"",""subject_id"":1}","{""0"":""http://img""}",0,,,2015-05-25 21:02:58 UTC,2015-05-25 21:02:58 UTC\n',
        encoding="utf-8")
    m = readers.read_subject_metadata(spark, str(tmp_path / "meta.csv")).first()
    assert m["metadata"] == {"link": "http://x", "subject_id": "1"} and m["locations"]["0"] == "http://img"
    assert m["created_at"] == datetime.datetime(2015, 5, 25, 21, 2, 58) and m["retired_at"] is None

    (tmp_path / "tags.json").write_text(
        '[{"id":1,"name":"lens","section":"project-1","created_at":"2023-04-12T14:24:37.018Z","user_id":2,"comment_id":3,"taggable_id":4,'
        '"taggable_type":"Subject","project_id":5,"user_login":"u"},{"id":2,"name":"ring"}]', encoding="utf-8")
    tags = readers.read_tags(spark, str(tmp_path / "tags.json")).orderBy("id").collect()
    assert [t["name"] for t in tags] == ["lens", "ring"] and tags[0]["created_at"].year == 2023
    (tmp_path / "comments.json").write_text('[{"board_id":1,"comment_body":"two\\nlines","comment_created_at":"2021-09-11T00:34:54.115Z"}]', encoding="utf-8")
    assert readers.read_comments(spark, str(tmp_path / "comments.json")).first()["comment_body"] == "two\nlines"


def test_mentions_and_bibliography(spark, tmp_path):
    nan = float("nan")
    rows = spark.createDataFrame(
        [("a", True, 1.0, 2.0, "n", ""), ("b", False, 1.0, 2.0, "n", ""), ("c", True, None, 2.0, "n", ""), ("d", True, nan, 2.0, "n", ""), ("e", None, 1.0, 2.0, "n", "")],
        "mention_id string, has_resolved_coordinates boolean, resolved_ra_deg double, resolved_dec_deg double, resolved_name string, ned_object_name string")
    rows.write.parquet(str(tmp_path / "m"))
    assert [r["mention_id"] for r in readers.read_resolved_mentions(spark, str(tmp_path / "m")).collect()] == ["a"]
    spark.createDataFrame([("a", "u", "s", 1)], "mention_id string, arxiv_url string, summary string, more int").write.parquet(str(tmp_path / "t"))
    assert readers.read_mention_texts(spark, str(tmp_path / "t")).columns == ["mention_id", "arxiv_url", "summary"]
    (tmp_path / "bib.csv").write_text('filename,main_id,bibcode,year,title\nf,M 1,b2,2001,"a, b"\nf,,b1,,t\n', encoding="utf-8")
    bib = readers.read_bibliography(spark, str(tmp_path / "bib.csv"))
    papers = readers.papers_per_file(bib).first()["papers"]
    assert [(p["bibcode"], p["alias"], p["title"]) for p in papers] == [("b2", "M 1", "a, b"), ("b1", "", "t")]


def test_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG")
    assert tuple(readers.read_images(spark, str(tmp_path), "*.png").select("filename", "length").first()) == ("a.png", 4)


def test_required_columns(spark):
    df = spark.range(1)
    assert require_columns(df, "id") is df
    with pytest.raises(MissingColumns, match="a, b"):
        require_columns(df, "b", "a", "id")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2), (2, 9), (3, 9)], "id long, imagescore long")
    meta = spark.createDataFrame([(7,)], "input_tokens long")
    sinks.write_results(rows, meta, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "results")).count() == 3
    assert spark.read.parquet(str(tmp_path / "out" / "run_meta")).first()[0] == 7
    sinks.write_cascade(rows, rows.limit(1), {"simbad": rows}, str(tmp_path / "cascade"), fmt="csv")
    assert spark.read.csv(str(tmp_path / "cascade" / "bibliography_simbad"), header=True).count() == 3


def test_log_append_and_stream(spark, tmp_path):
    path = str(tmp_path / "log")
    cols = "id long, grp long, slot int, kept int, input_tokens long, output_tokens long, run int, round int"
    sinks.append_log(spark.createDataFrame([(1, 1, 1, 1, 10, 1, 1, 1), (2, 1, 2, 0, 10, 1, 1, 1)], cols), path)
    store, mark = str(tmp_path / "scores"), str(tmp_path / "mark")

    def catch_up():
        q = progress.catch_up(progress.running_scores(progress.log_stream(spark, path)), store, mark)
        q.awaitTermination()
        return {r["id"]: r["imagescore"] for r in progress.latest(spark, store, ["run", "id"]).collect()}

    assert catch_up() == {1: 1, 2: 0}
    # The second round arrives later, with one judgment written twice.
    sinks.append_log(spark.createDataFrame([(1, 1, 1, 1, 5, 2, 1, 2), (1, 1, 1, 1, 5, 2, 1, 2), (3, 1, 2, 1, 5, 2, 1, 2)], cols), path)
    assert catch_up() == {1: 2, 2: 0, 3: 1}
    assert sinks.read_log(spark, path).filter("run = 1 and round = 2").count() == 3
    tok = progress.catch_up(progress.running_tokens(progress.log_stream(spark, path)), str(tmp_path / "tok"), str(tmp_path / "tokmark"))
    tok.awaitTermination()
    assert tuple(progress.latest(spark, str(tmp_path / "tok"), ["run"]).select("calls", "input_tokens", "output_tokens").first()) == (2, 15, 3)


def test_totals_write_changed_keys_only_and_compact(spark, tmp_path):
    path, store, mark = (str(tmp_path / n) for n in ("log", "totals", "mark"))
    cols = "id long, grp long, slot int, kept int, input_tokens long, output_tokens long, run int, round int"
    want = {}
    for turn in range(1, 5):  # every turn is a restart
        ids = [1, turn + 10]
        sinks.append_log(spark.createDataFrame([(i, 1, 1, 1, 1, 1, 1, turn) for i in ids], cols), path)
        for i in ids:
            want[i] = want.get(i, 0) + 1
        progress.catch_up(progress.running_scores(progress.log_stream(spark, path)), store, mark).awaitTermination()
        assert {r["id"]: r["imagescore"] for r in progress.latest(spark, store, ["run", "id"]).collect()} == want
        newest = max(int(n.name.split("=")[1]) for n in (tmp_path / "totals").glob("batch=*"))
        assert {r["id"] for r in spark.read.parquet(f"{store}/batch={newest}").collect()} <= set(ids)
        (tmp_path / "totals" / "batch=99").mkdir(exist_ok=True)  # a batch that never ended
        if turn == 2:
            progress.compact(spark, store, ["run", "id"])
            assert [n.name for n in (tmp_path / "totals").glob("batch=*")] == ["batch=99"]
        (tmp_path / "totals" / "batch=99").rmdir()


def test_versioned_table(spark, tmp_path):
    t = sinks.VersionedTable(spark, str(tmp_path / "verdicts"))
    assert t.read() is None
    t.extend(spark.createDataFrame([("a", 1)], "object_name string, v int"), "object_name")
    t.extend(spark.createDataFrame([("a", 2), ("b", 3)], "object_name string, v int"), "object_name")
    assert {r["object_name"]: r["v"] for r in t.read().collect()} == {"a": 1, "b": 3}
    # Written over what it is read from.
    t.write(t.read().withColumn("v", F.col("v") * 10))
    assert {r["object_name"]: r["v"] for r in t.read().collect()} == {"a": 10, "b": 30}
    (tmp_path / "verdicts" / "v9").mkdir()  # an unfinished version does not count
    assert t.versions() == [1, 2, 3]


def test_extensions_write_their_own_rows_and_writers_never_share_a_number(spark, tmp_path):
    path = str(tmp_path / "log")
    one, two = sinks.VersionedTable(spark, path), sinks.VersionedTable(spark, path)
    schema = "k string, v int"
    one.write(spark.createDataFrame([("a", 1), (None, 0)], schema))
    one.extend(spark.createDataFrame([("a", 2), ("b", 3)], schema), "k")
    assert [(r["k"], r["v"]) for r in spark.read.parquet(f"{path}/d2").collect()] == [("b", 3)]
    # Two writers that both saw the table before either was done.
    assert one._claim() == 3 and two._claim() == 4
    spark.createDataFrame([("c", 5)], schema).write.parquet(f"{path}/d4")
    spark.createDataFrame([("c", 4), ("d", 6)], schema).write.parquet(f"{path}/d3")
    want = {("a", 1), (None, 0), ("b", 3), ("c", 4), ("d", 6)}
    assert {tuple(r) for r in two.read("k").collect()} == want and two.read("k").count() == 5
    two.compact("k")
    assert two.versions() == [1, 2, 3, 4, 5] and {tuple(r) for r in one.read().collect()} == want
    two.extend(spark.createDataFrame([("e", 7, "x")], "k string, v int, more string"), "k")
    assert {tuple(r) for r in one.read("k").collect()} == {(*r, None) for r in want} | {("e", 7, "x")}


def test_places_follow_files_and_rows(spark, tmp_path):
    rows = spark.range(0, 5000, 1, 7).selectExpr("id", "id * 7919 % 5003 as score")
    sinks.write_results(rows, None, str(tmp_path / "out"), score="score")
    got = sinks.read_places(spark, str(tmp_path / "out" / "results")).collect()
    order = sorted(((-r.score, r.id) for r in rows.collect()))
    assert [(-r.score, r.id) for r in sorted(got, key=lambda r: r.place)] == order and {r.place for r in got} == set(range(5000))


def test_done_table(spark):
    done = spark.createDataFrame([("a", 1)], "k string, matched int")
    todo = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    rest = matching.unmatched(todo, done, "k")
    found = spark.createDataFrame([("b",), ("b",)], "k string")
    after = matching.mark_done(done, rest, found, "k")
    assert {r["k"]: r["matched"] for r in after.collect()} == {"a": 1, "b": 1, "c": 0}
    assert matching.unmatched(todo, after, "k").count() == 0


def test_match_by_name(spark):
    left = spark.createDataFrame([("x",), ("/q/Y.JPG",), ("z.png",)], "n string")
    right = spark.createDataFrame([(5, "X.jpg"), (2, "/p/x.png"), (7, "y"), (9, "w")], "row long, name string")
    got = {r["n"]: r["row"] for r in matching.match_by_name(left, right, "n", "name", "row").collect()}
    assert got == {"x": 2, "/q/Y.JPG": 7, "z.png": None}


def test_wide_result_file_and_first_known_header(spark, tmp_path):
    from skysift.sources.readers import read_results

    names = [f"extra{i}" for i in range(200)]
    (tmp_path / "wide.csv").write_text(",".join(["Filename", *names, "ai", "imagescore"]) + "\n" + ",".join(["x.jpg", *["0"] * 200, "0.25", "0.75"]) + "\n")
    rows, _ = read_results(spark, str(tmp_path))
    got = rows.collect()
    assert [(r.image, r.score) for r in got] == [("x.jpg", 0.25)]
