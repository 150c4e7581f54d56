"""Line de-duplication with a log-template tree of fixed depth.

A line's path in the tree is its number of tokens, then its first LEADING
tokens; tokens that hold a digit are wildcards. Below a path a line has one
template of all its tokens and, from GENERALISED_FROM tokens on, one for each
of SEGMENTS equal stretches of its tail in which that stretch is a wildcard: lines
that differ in digits anywhere, or freely within one stretch, meet in a template.
A template of several documents recurs. The document with the smallest id keeps
such a line, all others drop it.

Templates are 64-bit hashes: only hashes and ids are shuffled, and combined
before. Texts are shuffled once, to meet the numbers of their dropped lines.

Defined results: lines are cut at \\n; blank lines stay; null and empty texts stay
as they are; rows without id are one document after all others; a line repeated in
its own document stays; repeated rows are one document; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.session import TableStore

SPACE_RUN = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
LEADING = 2
GENERALISED_FROM = 12
SEGMENTS = 4
LAST = (1 << 63) - 1


def templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (row_key, doc, line, template), one per template of each line that is not blank."""
    base = docs.select(F.xxhash64(docs[id_col], docs[text_col]).alias("row_key"), F.coalesce(docs[id_col].cast("long"), F.lit(LAST)).alias("doc"),
                       F.posexplode(F.split(docs[text_col], "\n")).alias("line", "_line"))
    bare = base.select("row_key", "doc", "line", F.btrim("_line", F.lit(SPACES)).alias("_line")).filter("_line <> ''")
    # A line of digits only, or nearly, has no constant to recognise it by: then digits count.
    masked = F.transform(F.split("_line", SPACE_RUN), lambda t: F.when(t.rlike("[0-9]"), F.lit("<*>")).otherwise(t))
    tokens = bare.select("*", masked.alias("_masked"))
    constant = F.size(F.filter("_masked", lambda t: t != "<*>"))
    tokens = tokens.select("row_key", "doc", "line", F.when(2 * constant >= F.size("_masked"), F.col("_masked")).otherwise(F.split("_line", SPACE_RUN)).alias("_tokens"))
    tokens = tokens.select("*", F.size("_tokens").alias("_n"))
    n = F.col("_n")
    path = F.xxhash64(n, F.slice("_tokens", 1, LEADING))
    tail = n - LEADING

    def without(k: int):
        begin = (LEADING + F.floor(tail * k / SEGMENTS)).cast("int")
        end = (LEADING + F.floor(tail * (k + 1) / SEGMENTS)).cast("int")
        return F.xxhash64(path, F.lit(k), F.slice("_tokens", LEADING + 1, begin - LEADING), F.slice("_tokens", end + 1, n - end))

    exact = F.xxhash64(path, F.lit(-1), F.col("_tokens"))
    every = F.when(n >= GENERALISED_FROM, F.array(exact, *[without(k) for k in range(SEGMENTS)])).otherwise(F.array(exact))
    return tokens.select("row_key", "doc", "line", F.explode(every).alias("template"))


def dropped_lines(docs: DataFrame, store: TableStore) -> DataFrame:
    """row_key and the numbers of the lines to drop, for rows that have some."""
    found = store.write(templates(docs), "templates")
    recurring = found.groupBy("template").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("_last")).filter("first_doc < _last")
    recurring = store.write(recurring.select("template", "first_doc"), "recurring")
    later = found.join(recurring, "template").filter("doc > first_doc").select("row_key", "line")
    return later.groupBy("row_key").agg(F.collect_set("line").alias("lines"))


def drop_recurring(docs: DataFrame, store: TableStore) -> DataFrame:
    """The rows of `docs` with recurring lines taken out of text; adds n_lines and n_dropped.

    n_chars, where it is there, is counted anew.
    """
    dropped = dropped_lines(docs, store).select(F.col("row_key").alias("_row_key"), F.col("lines").alias("_lines"))
    joined = docs.withColumn("_row_key", F.xxhash64("doc_id", "text")).join(dropped, "_row_key", "left")
    numbered = joined.withColumn("_split", F.split("text", "\n")).withColumn("_gone", F.array_sort("_lines"))
    # Kept numbers by difference of sets, so that long lists cost no more than their length.
    numbers = F.sequence(F.lit(0), F.size("_split") - 1)
    kept = numbered.withColumn("_kept", F.when(F.col("_gone").isNotNull(), F.array_except(numbers, F.col("_gone"))))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform("_kept", lambda i: F.get("_split", i)), "\n"))
    out = kept.withColumn("_new", text)
    changed = {"text": F.col("_new"), "n_chars": F.when(F.col("_gone").isNull(), F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)).otherwise(F.length("_new"))}
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*[changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else F.col(f"`{c}`") for c in own],
                      F.when(F.col("text").isNull(), 0).otherwise(F.size("_split")).cast("long").alias("n_lines"),
                      F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"))
