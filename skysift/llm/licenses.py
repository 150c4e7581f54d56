"""License scans by ordered signature rules on normalised words.

A text is lower-cased and cut into words joined by single blanks. Of the rules only
those are tried whose own keyword begins a word of it; every match of a rule holds
its keyword, so this loses none. Each match is an interval; sorted by start, longer first, then by
priority, a match that lies within an earlier one is suppressed. What is left
gives the labels. Everything happens in the row: nothing is shuffled.

Defined results: null or empty texts have no words, no labels and score 0;
repeated rows give equal rows; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Word characters before lower-casing.
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Keyword, name pattern, label without version, versions as words.
FAMILIES = [
    ("general public license", "gnu general public license", "gpl", ("1", "2", "3")),
    ("lesser general public", "(?:gnu )?lesser general public license", "lgpl", ("2 1", "3")),
    ("library general public", "gnu library general public license", "lgpl", ("2",)),
    ("affero general public", "(?:gnu )?affero general public license", "agpl", ("1", "3")),
    ("gpl", "(?:gnu )?gpl", "gpl", ("1", "2", "3")),
    ("lgpl", "(?:gnu )?lgpl", "lgpl", ("2", "2 1", "3")),
    ("agpl", "(?:gnu )?agpl", "agpl", ("1", "3")),
    ("apache", "apache(?: software)?(?: license)?", "apache", ("1 0", "1 1", "2", "2 0")),
    ("mozilla public", "mozilla public license", "mpl", ("1 0", "1 1", "2", "2 0")),
    ("mpl", "mpl", "mpl", ("1 1", "2 0")),
    ("eclipse public", "eclipse public license", "epl", ("1 0", "2 0")),
    ("academic free", "academic free license", "afl", ("2 1", "3 0")),
    ("artistic", "artistic license", "artistic", ("1 0", "2 0")),
    ("european union public", "european union public licen[cs]e", "eupl", ("1 1", "1 2")),
    ("open font", "(?:sil )?open font license", "ofl", ("1 0", "1 1")),
    ("boost software", "boost software license", "bsl", ("1 0",)),
    ("common development", "common development and distribution license", "cddl", ("1 0", "1 1")),
    ("free documentation", "gnu free documentation license", "gfdl", ("1 1", "1 2", "1 3")),
    ("open database", "open database license", "odbl", ("1 0",)),
    ("open software", "open software license", "osl", ("2 1", "3 0")),
    ("educational community", "educational community license", "ecl", ("1 0", "2 0")),
]
CC_PARTS = {"by": "attribution", "nc": "non ?commercial", "sa": "share ?alike", "nd": "no ?derivati?(?:ve)?s?(?: works)?"}
CC_KINDS = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
# Keyword, pattern, label.
SINGLE = [
    ("mit", "(?:the )?mit licen[cs]e", "mit"), ("mit", "mit licensed", "mit"), ("x11", "x11 license", "x11"),
    ("permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("bsd", "(?:simplified )?(?:the )?bsd 2 clause(?: license)?", "bsd-2-clause"), ("bsd", "simplified bsd license", "bsd-2-clause"),
    ("bsd", "(?:the )?bsd 3 clause(?: license)?", "bsd-3-clause"), ("bsd", "(?:new|modified|revised) bsd license", "bsd-3-clause"),
    ("bsd", "bsd 4 clause(?: license)?", "bsd-4-clause"), ("bsd", "bsd licen[cs]ed?", "bsd"),
    ("redistribution and use", "redistribution and use in source and binary forms", "bsd"),
    ("isc", "isc license", "isc"), ("zlib", "zlib license", "zlib"), ("unlicense", "(?:the )?unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"), ("cc0", "cc0(?: 1 0)?(?: universal)?", "cc0-1.0"), ("public domain dedication", "public domain dedication", "cc0-1.0"),
    ("public domain", "(?:in|into|to) the public domain", "public-domain"), ("all rights reserved", "all rights reserved", "proprietary"),
    ("python software foundation", "python software foundation license", "psf"), ("ruby", "ruby license", "ruby"),
    ("postgresql", "postgresql license", "postgresql"), ("creative commons", "creative commons licen[cs]e", "cc"),
]
NOTICE = "(?:licensed|released|distributed|available|provided|published|covered|dual licensed) under (?:the terms of )?(?:the |an? )?"
# Words between a name and its version, and what may follow.
VERSION = "(?: licen[cs]e)? (?:version |v |ver )?"


def rules() -> list[tuple[str, str, str, int, float]]:
    """(keyword, pattern, label, priority, score): versions, combinations and notices of the tables above, made by rule.

    A notice comes before a name, a versioned name before a bare one.
    """
    named = []
    for keyword, name, label, versions in FAMILIES:
        for v in versions:
            number = v.replace(" ", ".")
            later = ("" if f"{v} 0" in versions else "(?: 0)?") + " (?:or|and) (?:at your option )?(?:any )?later(?: version)?"
            named.append((keyword, f"{name}{VERSION}{v}{later}", f"{label}-{number}-or-later", 1))
            named.append((keyword, f"{name}{VERSION}{v}(?: only)?", f"{label}-{number}", 2))
            named.append((keyword, f"{name}v{v}", f"{label}-{number}", 2))
        named.append((keyword, f"{name}" if keyword not in ("apache", "mpl") else f"{name} licen[cs]e", label, 3))
    for kind in CC_KINDS:
        words = kind.split(" ")
        short, long = f"cc {kind}", "creative commons " + " ".join(CC_PARTS[w] for w in words)
        for pattern, keyword in ((short, "cc by"), (long, "creative commons")):
            label = f"cc-{'-'.join(words)}"
            named += [(keyword, f"{pattern}{VERSION}{v}(?: international| unported| generic)?", f"{label}-{v.replace(' ', '.')}", 2) for v in CC_VERSIONS]
            named.append((keyword, pattern, label, 3))
    named += [(keyword, pattern, label, 2) for keyword, pattern, label in SINGLE]
    out = [(k, f" {NOTICE}{p}(?= )", label, rank, 1.0) for k, p, label, rank in named]
    return out + [(k, f" {p}(?= )", label, rank + 10, round(0.9 - 0.1 * rank, 2)) for k, p, label, rank in named]


def _literal_groups() -> Column:
    """The rules as an array of (keyword, rules of that keyword), known when the plan is made."""
    by_keyword: dict[str, list] = {}
    for keyword, *rule in rules():
        by_keyword.setdefault(keyword, []).append(rule)
    one = lambda pattern, label, priority, score: F.struct(
        F.lit(pattern).alias("pattern"), F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.lit(score).alias("score"))
    return F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(f" {k}").alias("word"), F.array(*[one(*r) for r in v]).alias("rules")) for k, v in by_keyword.items()])


def _intervals(text: Column, rule: Column) -> Column:
    """Matches of one rule as (start, -end, priority, label, score)."""
    pieces = F.transform(F.split(text, rule["pattern"], -1), lambda p: F.length(p))
    found = F.transform(F.regexp_extract_all(text, rule["pattern"], F.lit(0)), lambda m: F.length(m))
    at = F.aggregate(
        F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(p.alias("p"), m.alias("m"))),
        F.struct(F.lit(0).alias("upto"), F.array().cast("array<struct<a:int,b:int>>").alias("all")),
        lambda acc, x: F.struct((acc["upto"] + x["p"] + x["m"]).alias("upto"), F.concat(acc["all"], F.array(F.struct(
            (acc["upto"] + x["p"]).alias("a"), (acc["upto"] + x["p"] + x["m"]).alias("b")))).alias("all")),
        lambda acc: acc["all"])
    return F.transform(at, lambda x: F.struct(x["a"].alias("start"), (-x["b"]).alias("minus_end"), rule["priority"].alias("priority"),
                                              rule["label"].alias("label"), rule["score"].alias("score")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, one row per row of `docs`."""
    base = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("_text"))
    base = base.select("doc_id", F.regexp_count("_text", F.lit(WORD_ANY_CASE)).cast("long").alias("n_words"),
                       F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.lower("_text"), SEPARATORS, " ")), F.lit(" ")).alias("_norm"))

    words = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    counts, firsts, lasts, labels = [], [], [], []
    for k, (phrase, label) in enumerate(BASE.items()):
        base = base.withColumn(f"_p{k}", F.when(F.contains("_norm", F.lit(f" {phrase} ")), F.split("_norm", f" {phrase}(?= )", -1)))
        pieces = F.col(f"_p{k}")
        counts.append(F.coalesce(F.size(pieces) - 1, F.lit(0)))
        firsts.append(words(F.element_at(pieces, 1)))
        lasts.append(F.col("n_words") - (words(F.element_at(pieces, -1)) - 1) - len(phrase.split(" ")))
        labels.append(F.when(pieces.isNotNull(), F.lit(label)))
    marked = base.select(
        "doc_id", "n_words", "_norm", reduce(lambda a, b: a + b, counts).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*labels))).alias("_base"))
    # The word alone is the faster test, and mostly fails.
    active = F.filter(_literal_groups(), lambda g: F.contains(F.col("_norm"), g["keyword"]) & F.contains(F.col("_norm"), g["word"]))
    matches = F.flatten(F.transform(active, lambda g: F.flatten(F.transform(g["rules"], lambda r: _intervals(F.col("_norm"), r)))))
    marked = marked.withColumn("_matches", F.sort_array(matches))
    empty = F.struct(F.lit(0).alias("upto"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))
    kept = F.aggregate("_matches", empty, lambda acc, m: F.when(-m["minus_end"] > acc["upto"], F.struct(
        (-m["minus_end"]).alias("upto"), F.array_union(acc["labels"], F.array(m["label"])).alias("labels"),
        F.greatest(acc["score"], m["score"]).alias("score"))).otherwise(acc))
    marked = marked.withColumn("_kept", kept)
    every = F.array_sort(F.array_union("_base", F.coalesce(F.col("_kept")["labels"], F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.col("_kept")["score"], F.lit(0.0)))
    return marked.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"),
                         F.array_join(every, ",").alias("labels"), score.alias("score"))
