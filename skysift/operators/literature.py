"""From matched objects to the papers that may discuss them, and back to verdicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.functions import text
from skysift.operators.ordering import first_in, stacked, top_in
from skysift.session import TableStore

PAPERS_CAP = 40  # fixed value: papers shown per object, name hits beyond it stay
NEWEST = 8  # fixed value: papers per object in a summary
BUDGET = 4500  # fixed value: look-ups per run
CLASSIFY_CHARS, SUMMARY_CHARS = 1200, 1500  # fixed values: abstract length in a payload
HIT_NOTE = (  # fixed value
    " [NOTE: this object's name/designation was found as a direct text match in this "
    "paper's title/abstract - likely but not certainly a sign of individual discussion, "
    "confirm from context]"
)
NO_PAPERS = "No papers found in bibliography."  # fixed value


def best_image_per_object(
    matched: DataFrame, first: DataFrame, second: DataFrame, ordinal: str = "ordinal"
) -> tuple[DataFrame, DataFrame]:
    """(objects, papers): the best-scored image of each object and that image's papers.

    Papers come from the first bibliography if it knows the image, else from the
    second. Bibliographies hold filename, bibcode, year, title, alias, seq.
    """
    best = first_in(matched.filter(F.col("object_name") != ""), ["object_name"],
                    [F.col("avg_score").desc(), F.col(ordinal)])
    names = best.select("object_name", "filename")
    cols = ["object_name", "bibcode", "year", "title", "alias", "seq"]
    from_first = names.join(first, "filename").select(*cols)
    rest = names.join(first.select("filename"), "filename", "left_anti")
    papers = from_first.unionByName(rest.join(second, "filename").select(*cols))
    counts = papers.groupBy("object_name").agg(F.count("*").alias("n_papers"))
    counted = best.join(counts, "object_name", "left").fillna(0, ["n_papers"])
    own = F.coalesce(F.col("ref_count").cast("bigint"), F.lit(0))
    refs = F.when(F.col("n_papers") > 0, F.col("n_papers")).otherwise(own)
    return counted.withColumn("ref_count", refs), papers


def shown_ref_count(source: str, n_papers: str, ref_count: str, fetched: tuple[str, ...] = ("SIMBAD", "NED")) -> Column:
    """Paper count to sort by: fetched papers where a source has a fetch, else its own count, unknown -1."""
    own = F.coalesce(F.col(ref_count).cast("bigint"), F.lit(-1))
    return F.when(F.col(source).isin(*fetched), F.coalesce(n_papers, F.lit(0)).cast("bigint")).otherwise(own)


def top_objects(objects: DataFrame, by: str, n: int, require_papers: bool = True) -> DataFrame:
    pool = objects.filter(F.col("n_papers") > 0) if require_papers else objects
    return pool.orderBy(F.col(by).desc(), F.col("object_name")).limit(n)


def top_by_either(objects: DataFrame, n_refs: int, n_score: int) -> tuple[DataFrame, DataFrame]:
    """(union of both top lists with each object once, size of their overlap)."""
    refs, score = top_objects(objects, "ref_count", n_refs), top_objects(objects, "avg_score", n_score)
    both = refs.withColumn("_list", F.lit(0)).unionByName(score.withColumn("_list", F.lit(1)))
    union = first_in(both, ["object_name"], [F.col("_list")]).drop("_list")
    overlap = refs.select("object_name").intersect(score.select("object_name")).agg(F.count("*").alias("overlap"))
    return union, overlap


def newest_papers(papers: DataFrame, k: int = NEWEST) -> DataFrame:
    """The k newest papers per object with their rank; years that are no number come last."""
    return top_in(papers, ["object_name"], [text.year_number("year").desc(), F.col("seq")], k, "rank")


def with_abstracts(papers: DataFrame, cache: DataFrame) -> DataFrame:
    """Papers with title and abstract from the cache where it has them."""
    known = cache.select("bibcode", F.col("title").alias("_t"), F.col("abstract").alias("_a"))
    joined = papers.join(known, "bibcode", "left")
    title = F.coalesce(F.when(F.col("_t") != "", F.col("_t")), F.col("title"))
    return joined.withColumn("title", title).withColumn("abstract", F.coalesce("_a", F.lit(""))).drop("_t", "_a")


def aliases_of(objects: DataFrame, papers: DataFrame) -> DataFrame:
    """Distinct aliases per object: its own name and those its papers were found by."""
    own = objects.select("object_name", F.col("object_name").alias("alias"))
    found = papers.filter(F.col("alias") != "").select("object_name", "alias")
    return own.union(found).distinct()


def alias_keys(aliases: DataFrame) -> DataFrame:
    """Distinct (object, key) for all search keys of its aliases. Each alias is worked out once."""
    keys = aliases.select("alias").distinct().withColumn("key", F.explode(text.search_keys("alias")))
    return aliases.join(keys, "alias").select("object_name", "key").distinct()


# Texts of one object that meet its keys in one task, and keys of one object that meet a text there.
TEXTS_PER_SHARE, KEYS_PER_SHARE = 2048, 4096


def name_hits(papers: DataFrame, aliases: DataFrame, texts_per_share: int = TEXTS_PER_SHARE, keys_per_share: int = KEYS_PER_SHARE) -> DataFrame:
    """(object_name, bibcode) of papers whose title or abstract names the object.

    Papers hold object_name, bibcode, title, abstract. Each distinct text is
    normalised once; the substring test runs inside a semi join, which stops at the
    first key found. The texts of an object are dealt over shares, as many as its
    number of texts asks for, and its keys over parts, so that an object that holds a
    third of all papers or keys spreads over many tasks; every share meets every part.
    """
    body = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))
    texts = papers.select("object_name", "bibcode", text.normalize_text(body).alias("_text"))
    keys = alias_keys(aliases).select(F.col("object_name").alias("_object"), "key")

    def deal(n: str, most: int) -> Column:
        return F.ceil(F.col(n) / most).cast("int")

    # Only objects beyond one share or part have a row here, which is none but in hot cases.
    many = papers.groupBy("object_name").agg(F.count("*").alias("_n")).filter(F.col("_n") > texts_per_share)
    wide = keys.groupBy("_object").agg(F.count("*").alias("_k")).filter(F.col("_k") > keys_per_share)
    sizes = many.join(wide, many["object_name"] == wide["_object"], "full").select(
        F.coalesce("object_name", "_object").alias("_hot"), F.coalesce(deal("_n", texts_per_share), F.lit(1)).alias("_shares"),
        F.coalesce(deal("_k", keys_per_share), F.lit(1)).alias("_parts"))

    def dealt(df: DataFrame, name: str, mine: str, own: Column, other: str) -> DataFrame:
        """Each row under its own share or part, once for each of the other side's."""
        found = df.join(sizes, df[name] == sizes["_hot"], "left").fillna(1, ["_shares", "_parts"])
        at = F.pmod(F.xxhash64(own), F.col(f"_{mine}s")).cast("int").alias(f"_{mine}")
        return found.select(*df.columns, at, F.explode(F.sequence(F.lit(0), F.col(f"_{other}s") - 1)).alias(f"_{other}"))

    texts = dealt(texts, "object_name", "share", F.col("bibcode"), "part")
    keys = dealt(keys, "_object", "part", F.col("key"), "share").withColumnsRenamed({"_share": "_s", "_part": "_p"})
    hit = (
        (texts["object_name"] == keys["_object"]) & (texts["_share"] == keys["_s"]) & (texts["_part"] == keys["_p"])
        & texts["_text"].contains(keys["key"])
    )
    return texts.join(keys, hit, "left_semi").select("object_name", "bibcode").distinct()


def select_papers(papers: DataFrame, hits: DataFrame | Column, cap: int = PAPERS_CAP) -> DataFrame:
    """Name hits, then the oldest and newest of the rest up to the cap.

    Gives part hit / rest and place, the order papers are shown in. Hits are
    never cut. Each task keeps at most cap/2 candidates per object and end. `seq`
    is a number. `hits` are (object_name, bibcode) rows, or a condition where a
    paper's own columns tell, which needs no join.
    """
    if isinstance(hits, Column):
        flagged = papers.withColumn("_hit", F.when(hits, True))
    else:
        flagged = papers.join(hits.withColumn("_hit", F.lit(True)), ["object_name", "bibcode"], "left")
    flagged = flagged.withColumn("_year", text.year_number("year"))
    hit_rows = flagged.filter(F.col("_hit")).drop("_hit")
    rest = flagged.filter(F.col("_hit").isNull()).drop("_hit")
    sizes = flagged.groupBy("object_name").agg(
        F.count("_hit").alias("_h"), (F.count("*") - F.count("_hit")).alias("_r")
    )
    # Each row of the rest stands once at either end of the years; a task keeps the first few of each.
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("_year").alias("y"), F.col("seq").alias("s")),
        F.struct(F.lit(1).alias("side"), (-F.col("_year")).alias("y"), (-F.col("seq")).alias("s")),
    )
    ends = top_in(rest.withColumn("_e", F.explode(sides)), ["object_name", "_e.side"],
                  [F.col("_e.y"), F.col("_e.s")], (cap + 1) // 2, "_rank")
    # Sizes are joined first: what is not kept ends there, and one shuffle by object does for the join and for a
    # row that is kept at either end.
    sized = ends.join(sizes, "object_name")
    slots = F.greatest(F.lit(cap) - F.col("_h"), F.lit(0))
    half = F.floor(slots / 2)
    kept = sized.filter(F.col("_rank") <= F.when(F.col("_e.side") == 0, half).otherwise(slots - half))
    # Rest that fits whole keeps its order, cut rest runs from old to new.
    whole = F.col("_r") <= slots
    placed = kept.select(*rest.columns, F.when(whole, F.lit(0)).otherwise(F.col("_year")).alias("_y")).distinct()
    both = stacked([hit_rows.withColumn("_y", F.lit(0)).withColumn("part", F.lit("hit")),
                    placed.withColumn("part", F.lit("rest"))])
    return both.withColumn("place", F.struct((F.col("part") == "rest").cast("int"), F.col("_y").cast("bigint"), "seq")).drop(
        "_year", "_y"
    )


def discussion_payload(selected: DataFrame) -> DataFrame:
    """One text per object for the verdict judge. Selected papers carry part, place, abstract."""
    note = F.when(F.col("part") == "hit", HIT_NOTE).otherwise("")
    entry = F.concat(
        F.lit("\n["), F.coalesce(F.col("year").cast("string"), F.lit("")), F.lit("]"), note, F.lit(" "),
        F.coalesce("title", F.lit("")), F.lit("\n"), F.substring(F.coalesce("abstract", F.lit("")), 1, CLASSIFY_CHARS),
    )
    grouped = selected.groupBy("object_name").agg(
        F.count("*").alias("n_papers_checked"),
        F.count_distinct(F.when(F.col("part") == "hit", F.col("bibcode"))).alias("n_name_hits"),
        F.array_sort(F.collect_list(F.struct("place", entry.alias("entry")))).alias("_entries"),
    )
    head = F.concat(F.lit("Object: "), "object_name", F.lit("\n\nPapers ("), F.col("n_papers_checked").cast("string"), F.lit("):\n"))
    body = F.array_join(F.transform("_entries", lambda e: e["entry"]), "\n")
    return grouped.withColumn("payload", F.concat(head, body)).drop("_entries")


def summary_payload(objects: DataFrame, newest: DataFrame) -> DataFrame:
    """One text per object for a literature summary, and the codes of the papers in it."""
    entry = F.concat(
        F.lit("\n["), F.coalesce(F.col("year").cast("string"), F.lit("")), F.lit("] "), F.coalesce("title", F.lit("")),
        F.lit("\n"), F.substring(F.coalesce("abstract", F.lit("")), 1, SUMMARY_CHARS),
    )
    grouped = newest.groupBy("object_name").agg(
        F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry"), "bibcode"))).alias("_e")
    )

    def known(c: str) -> Column:
        return F.coalesce(F.when(F.col(c).cast("string") != "", F.col(c).cast("string")), F.lit("unknown"))

    joined = objects.join(grouped, "object_name")
    lines = F.array(
        F.concat(F.lit("Object: "), "object_name"),
        F.concat(F.lit("Catalog type: "), known("object_type")),
        F.concat(F.lit("Redshift: "), known("redshift")),
        F.concat(F.lit("Matched via: "), "matched_source"),
        F.format_string("Our model's average interest score for this image (1-5 scale): %.2f", "avg_score"),
        F.lit(""),
        F.format_string("Papers (%d of %d total found):", F.size("_e"), F.col("ref_count").cast("bigint")),
    )
    return joined.select(
        *objects.columns,
        F.array_join(F.transform("_e", lambda e: e["bibcode"]), ";").alias("papers_used"),
        F.array_join(F.concat(lines, F.transform("_e", lambda e: e["entry"])), "\n").alias("payload"),
    )


def verdicts(
    objects: DataFrame, payloads: DataFrame, judge: Callable[[DataFrame], DataFrame], store: TableStore | None = None
) -> DataFrame:
    """Verdict per object; objects without papers are not discussed and reach no judge.

    `judge` takes object_name, payload and the counts, and returns object_name,
    genuinely_discussed, reasoning. A null verdict is a failed call: no row, so
    the next run tries again. Payloads and verdicts are written before they are
    used, so each payload is judged once whatever is done with the result; a named
    store goes on from the verdicts it holds.
    """
    store = store or TableStore(objects.sparkSession)
    payloads = store.write(payloads, "payloads")
    known = store.read("judged")
    todo = payloads if known is None else payloads.join(known.select("object_name"), "object_name", "left_anti")
    decided = judge(todo).select("object_name", "genuinely_discussed", "reasoning").filter(F.col("genuinely_discussed").isNotNull())
    decided.write.mode("append").parquet(store.path("judged"))
    judged = store.read("judged")
    bare = objects.join(payloads, "object_name", "left_anti").select(
        "object_name", F.lit(0).cast("bigint").alias("n_papers_checked"), F.lit(0).cast("bigint").alias("n_name_hits"),
        F.lit(False).alias("genuinely_discussed"), F.lit(NO_PAPERS).alias("reasoning"),
    )
    counts = payloads.select("object_name", "n_papers_checked", "n_name_hits")
    done = counts.join(judged, "object_name")
    return bare.unionByName(done)


def phrase_query(aliases: DataFrame) -> DataFrame:
    """OR-joined phrase query per object, null when no phrase is left."""
    each = aliases.select("alias").distinct().withColumn("_p", F.explode(text.phrases("alias")))
    each = each.withColumn("_p", text.clean_phrase("_p")).filter(F.col("_p") != "")
    pairs = aliases.join(each, "alias").select("object_name", "_p").distinct()
    joined = pairs.groupBy("object_name").agg(F.array_sort(F.collect_list("_p")).alias("_ps"))
    query = F.array_join(F.transform("_ps", lambda p: F.concat(F.lit('full:"'), p, F.lit('"'))), " OR ")
    names = aliases.select("object_name").distinct()
    return names.join(joined.select("object_name", query.alias("query")), "object_name", "left")


def work_list(
    todo: DataFrame, done: DataFrame, budget: int = BUDGET, *, key: str = "object_name", by: str = "n_papers",
    query: str | None = "query",
) -> tuple[DataFrame, DataFrame]:
    """(work, skipped): what this run looks up, and what it checks off without a look-up.

    Highest `by` first, at most `budget`. An item without a query costs nothing
    and is checked off if its turn comes before the budget is spent.
    """
    open_items = todo.join(done.select(key).distinct(), key, "left_anti")
    order = [F.col(by).desc(), F.col(key)]
    if query is None:
        return open_items.orderBy(*order).limit(budget), open_items.limit(0)
    work = open_items.filter(F.col(query).isNotNull()).orderBy(*order).limit(budget)
    last = work.agg(
        F.count("*").alias("_n"), F.max(F.struct((-F.col(by)).alias("by"), F.col(key).alias("key"))).alias("_last")
    )
    bare = open_items.filter(F.col(query).isNull()).crossJoin(F.broadcast(last))  # one row
    reached = (F.col("_n") < budget) | (F.struct((-F.col(by)).alias("by"), F.col(key).alias("key")) < F.col("_last"))
    return work, bare.filter(reached).drop("_n", "_last")


def new_hits(hits: DataFrame, papers: DataFrame) -> DataFrame:
    """Full-text hits that are not among the papers known for the object."""
    return hits.join(papers.select("object_name", "bibcode"), ["object_name", "bibcode"], "left_anti")


def merge_papers(papers: DataFrame, hits: DataFrame) -> DataFrame:
    """Known papers, then new full-text hits, each bibcode of an object added once."""
    added = first_in(new_hits(hits, papers), ["object_name", "bibcode"], [F.col("seq")])
    late = added.select("object_name", "bibcode", F.col("year").cast("string").alias("year"), "title",
                        F.col("matched_alias").alias("alias"), "seq")
    known = papers.select("object_name", "bibcode", F.col("year").cast("string").alias("year"), "title", "alias", "seq")
    return known.withColumn("added", F.lit(0)).unionByName(late.withColumn("added", F.lit(1)))


def is_true(c: str) -> Column:
    """Verdict text or boolean read as a boolean; anything but "true" is false."""
    return F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) == "true"


def doubtful(verdict_rows: DataFrame) -> DataFrame:
    """Objects whose verdict so far is not true."""
    return verdict_rows.filter(~is_true("genuinely_discussed")).select("object_name")


def reclassify_candidates(hits: DataFrame, verdict_rows: DataFrame) -> DataFrame:
    """Objects with a full-text hit whose verdict so far is not true."""
    return doubtful(verdict_rows).join(hits.select("object_name"), "object_name", "left_semi")


def upsert_verdicts(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts with the new rows in place, count of false-to-true flips)."""
    kept = old.join(new.select("object_name"), "object_name", "left_anti")
    was = old.select("object_name", is_true("genuinely_discussed").alias("_was"))
    flips = new.join(was, "object_name").agg(
        F.count(F.when(is_true("genuinely_discussed") & ~F.col("_was"), 1)).alias("flipped")
    )
    return kept.unionByName(new.select(*old.columns)), flips


def append_done(existing: DataFrame, new: DataFrame, key: str = "object_name") -> DataFrame:
    """Earlier output extended by rows it lacks; earlier rows are never replaced."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti").select(*existing.columns))

