"""Quality rules: fixed limits, then robust multivariate outliers per language and source.

Statistics of every document come from built-in functions on its own row. For
each language and source the minimum covariance determinant is estimated by
concentration steps: from the median and median deviation on, each step takes
the documents within the median distance, summed with one aggregation, and fits
mean and covariance to them anew. A document goes when its squared Mahalanobis
distance from the estimate is above CUTOFF times the median distance of its group.

Only groups' moments and narrow statistics are shuffled, both combined before;
texts stay where they are. Each step reads the written statistics.

Defined results: a null or empty text has no words and fails; null language or
source is a group of its own; a group with fewer than SMALL_GROUP documents to
fit is judged by the estimate of its language, and where that has fewer, of all
rows; repeated rows are judged alike; an empty table
gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.session import TableStore

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
STEPS = 3
# Squared distances in units of the group's median one. For a normal vector of five the median is 4.35.
CUTOFF = 32.0
# From so many documents to fit on, a group or a language has an estimate of its own.
SMALL_GROUP = 30
# Estimates are made per language and source (0), per language (1) and over all rows (2).
KEYS = ["level", "lang", "source"]
# Smallest standard deviation of each transformed statistic: how far clean prose of one kind may always vary.
FLOORS = {"x_length": 0.25, "x_word": 0.06, "x_symbols": 0.06, "x_lines": 0.12, "x_repeats": 0.12}
FEATURES = list(FLOORS)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source, row_key and the counts of each text, one row per row of `docs`."""
    base = docs.select(docs[id_col].alias("doc_id"), docs[lang_col].cast("string").alias("lang"), docs[source_col].cast("string").alias("source"),
                       F.xxhash64(docs[id_col], docs[text_col]).alias("row_key"), F.coalesce(docs[text_col], F.lit("")).alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD))
    bare = F.btrim("_text", F.lit(SPACES))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))
    worded = base.select("*", words.alias("_words"), lines.alias("_lines"))
    worded = worded.select("*", F.size("_words").alias("_n"))
    hashed = worded.select("*", F.transform(
        "_words", lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2))).alias("_all"))
    hashed = hashed.select("*", F.slice("_all", 1, F.greatest(F.col("_n") - 2, F.lit(0))).alias("_windows"))
    # Sorted with their places, equal windows are neighbours. A text without equal windows skips this.
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    hashed = hashed.select("*", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), placed).alias("_sorted"))
    again = F.filter(F.transform("_sorted", lambda x, i: F.when(
        (x["h"] == F.get("_sorted", i - 1)["h"]) | (x["h"] == F.get("_sorted", i + 1)["h"]), x["i"])), lambda i: i.isNotNull())
    hashed = hashed.select("*", again.alias("_again"))
    covered = F.size(F.array_distinct(F.concat("_again", F.transform("_again", lambda i: i + 1), F.transform("_again", lambda i: i + 2))))
    return hashed.select(
        "doc_id", "lang", "source", "row_key",
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.when(F.col("_again").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
    )


def features(stats: DataFrame) -> DataFrame:
    """Add the transformed statistics and base_failed."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return stats.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        "x_length": F.log(n),
        "x_word": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        "x_symbols": F.asinh(F.sqrt(F.col("n_symbols") / n)),
        "x_lines": F.asin(F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)))),
        "x_repeats": F.asin(F.sqrt(F.least(F.col("n_repeat_words") / n, F.lit(1.0)))),
    })


def _pairs() -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[: i + 1]]


def whitening(cov: dict[tuple[str, str], Column]) -> dict[str, Column]:
    """Columns of the Cholesky factor of a covariance, as l_<a>_<b>, to be added one after the other."""
    out: dict[str, Column] = {}
    for i, a in enumerate(FEATURES):
        for j, b in enumerate(FEATURES[: i + 1]):
            rest = reduce(lambda x, y: x - y, [F.col(f"l_{a}_{c}") * F.col(f"l_{b}_{c}") for c in FEATURES[:j]], cov[a, b])
            out[f"l_{a}_{b}"] = F.sqrt(F.greatest(rest, F.lit(FLOORS[a] ** 2 * 1e-3))) if a == b else rest / F.col(f"l_{b}_{b}")
    return out


def _with_factor(moments: DataFrame, cov: dict[tuple[str, str], Column]) -> DataFrame:
    for name, value in whitening(cov).items():
        moments = moments.withColumn(name, value)
    return moments.select(*KEYS, *[f"m_{f}" for f in FEATURES], *[f"l_{a}_{b}" for a, b in _pairs()], *[c for c in ("n_fit", "d_mid") if c in moments.columns])


def _with_keys(rows: DataFrame, more: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null."""
    named = more.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    return rows.join(named, same, how).drop(*[f"_key_{k}" for k in keys])


def distances(rows: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """Add d2, the squared Mahalanobis distance from the model that has the row's keys."""
    out = _with_keys(rows, model, keys, "left")
    for i, a in enumerate(FEATURES):
        z = F.col(a) - F.col(f"m_{a}")
        for b in FEATURES[:i]:
            z = z - F.col(f"l_{a}_{b}") * F.col(f"z_{b}")
        out = out.withColumn(f"z_{a}", z / F.col(f"l_{a}_{a}"))
    d2 = reduce(lambda x, y: x + y, [F.col(f"z_{f}") * F.col(f"z_{f}") for f in FEATURES])
    return out.withColumn("d2", d2).drop(*[f"z_{f}" for f in FEATURES], *[f"m_{f}" for f in FEATURES], *[f"l_{a}_{b}" for a, b in _pairs()])


def levelled(rows: DataFrame) -> DataFrame:
    """Each row to fit once for its language and source, once for its language and once for all."""
    none = F.lit(None).cast("string")
    places = F.array(*[F.struct(F.lit(k).alias("level"), lang.alias("lang"), source.alias("source"))
                       for k, (lang, source) in enumerate([(F.col("lang"), F.col("source")), (F.col("lang"), none), (none, none)])])
    return rows.filter(~F.col("base_failed")).select(F.explode(places).alias("_place"), *FEATURES).select("_place.*", *FEATURES)


def robust_model(rows: DataFrame, store: TableStore, steps: int = STEPS) -> DataFrame:
    """Mean, Cholesky factor, n_fit and d_mid (median d2) per level, language and source."""
    fit = levelled(rows)
    middle = fit.groupBy(*KEYS).agg(*[F.percentile_approx(f, 0.5, 1000).alias(f"m_{f}") for f in FEATURES])
    middle = store.write(middle, "middle")
    first = _with_keys(fit, middle, KEYS).groupBy(*KEYS).agg(
        *[F.first(f"m_{f}").alias(f"m_{f}") for f in FEATURES],
        *[F.percentile_approx(F.abs(F.col(f) - F.col(f"m_{f}")), 0.5, 1000).alias(f"s_{f}") for f in FEATURES])
    spread = {(a, b): F.pow(F.greatest(1.4826 * F.col(f"s_{a}"), F.lit(FLOORS[a])), 2) if a == b else F.lit(0.0) for a, b in _pairs()}
    model = store.write(_with_factor(first, spread), "model0")
    for step in range(1, steps + 1):
        far = distances(fit, model, KEYS)
        mids = store.write(far.groupBy(*KEYS).agg(F.percentile_approx("d2", 0.5, 1000).alias("d_mid")), f"mids{step}")
        sums = _with_keys(far, mids, KEYS).filter("d2 <= d_mid").groupBy(*KEYS).agg(
            F.count("*").alias("n_half"), *[F.avg(f).alias(f"m_{f}") for f in FEATURES],
            *[F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in _pairs()])
        # The half nearest to the middle understates the spread; CUTOFF counts in median distances, so the scale cancels.
        cov = {(a, b): F.col(f"c_{a}_{b}") + F.lit(FLOORS[a] ** 2 if a == b else 0.0) for a, b in _pairs()}
        model = store.write(_with_factor(sums, cov), f"model{step}")
    last = distances(fit, model, KEYS).groupBy(*KEYS).agg(F.percentile_approx("d2", 0.5, 1000).alias("d_mid"), F.count("*").alias("n_fit"))
    return store.write(_with_keys(model, last, KEYS), "model")


def group_models(rows: DataFrame, model: DataFrame, store: TableStore) -> DataFrame:
    """The model each language and source is judged by: its own, its language's or that of all rows."""
    values = [c for c in model.columns if c not in KEYS]
    at = lambda level, name: model.filter((F.col("level") == level) & ((F.col("n_fit") >= SMALL_GROUP) | F.lit(level == 2))).select("lang", "source", F.struct(*values).alias(name))
    groups = rows.groupBy("lang", "source").agg(F.count("*").alias("_rows"))
    groups = _with_keys(groups, at(0, "_own"), ["lang", "source"], "left")
    groups = _with_keys(groups, at(1, "_lang").drop("source"), ["lang"], "left")
    # One row at most.
    groups = groups.join(F.broadcast(at(2, "_all").drop("lang", "source")), how="left")
    return store.write(groups.select("lang", "source", F.coalesce("_own", "_lang", "_all").alias("_m")).select("lang", "source", "_m.*"), "group_models")


def judge(docs: DataFrame, store: TableStore, cutoff: float = CUTOFF) -> DataFrame:
    """Statistics, base_failed, d2 and kept of every row of `docs`."""
    rows = store.write(features(statistics(docs)), "statistics")
    judged = distances(rows, group_models(rows, robust_model(rows, store), store), ["lang", "source"])
    outlier = F.col("d2") > cutoff * F.greatest(F.col("d_mid"), F.lit(0.2))
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(outlier, F.lit(False)))


def keep_good(docs: DataFrame, store: TableStore, cutoff: float = CUTOFF) -> DataFrame:
    """Rows of `docs` that pass, with its columns."""
    good = judge(docs, store, cutoff).filter("kept").select(F.col("row_key").alias("_row_key")).distinct()
    return docs.withColumn("_row_key", F.xxhash64("doc_id", "text")).join(good, "_row_key", "left_semi").select(*[f"`{c}`" for c in docs.columns])
