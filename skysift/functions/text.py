"""Column functions on names, free text and literature designations."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Text taken as "yes".
YES_WORDS = ["1", "yes", "y", "true", "interesting", "selected"]

# Text taken as "no number".
NO_NUMBER_WORDS = ["", "nan", "none", "null", "n/a", "na"]

# Survey and catalog names dropped from the front of an alias.
CATALOG_PREFIXES = [
    "NAME", "SLACS", "SDSS", "FIRST", "WISEA", "2MASS", "2MASX", "COSMOS2015",
    "COSMOS2020", "COSMOS-DASH", "COSMOS", "CANDELS", "MCPS", "OMS2023",
    "LFC2025", "NVSS", "VLASS", "GALEX", "PSO", "PS1", "Gaia DR2", "Gaia DR3",
]

# Descriptors dropped from the end of an alias.
TRAILING_WORDS = ["source", "lens", "system", "component", "counterpart", "galaxy"]

# Fixed value: a coordinate designation such as J120540.43+491029.3.
DESIGNATION = r"J(\d{4,10}(?:\.\d+)?)([+\-])(\d{2,9}(?:\.\d+)?)"

PREFIX_PATTERN = r"(?i)^(" + "|".join(CATALOG_PREFIXES) + r")\s+"
TRAILING_PATTERN = r"(?i)\s+(" + "|".join(TRAILING_WORDS) + r")$"

# White space as Unicode text tools see it: the White_Space class and the four separators.
_SPACE = r"(?U)[\s\x1c-\x1f]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim all leading and trailing white space, not only blanks."""
    return F.regexp_replace(_col(c), rf"{_SPACE}+$|^{_SPACE}+", "")


def _by_name(df: DataFrame, names: tuple[str, ...]) -> list[Column]:
    lowered = {}
    for c in df.columns:
        lowered[c.lower()] = c
    exact = [n for n in names if n in df.columns]
    loose = [lowered[n.lower()] for n in names if n.lower() in lowered]
    return [F.col(f"`{c}`") for c in dict.fromkeys(exact + loose)]


def first_non_empty(df: DataFrame, *names: str, default: str = "") -> Column:
    """First value that is neither null nor empty over column aliases."""
    found = [F.when(c.cast("string") != "", c.cast("string")) for c in _by_name(df, names)]
    return F.coalesce(*found, F.lit(default))


def first_present(df: DataFrame, *names: str, default: str = "") -> Column:
    """First value that is not null over column aliases; an empty text counts."""
    lowered = {c.lower(): c for c in df.columns}
    found = [F.col(f"`{lowered[n.lower()]}`").cast("string") for n in names if n.lower() in lowered]
    return F.coalesce(*found, F.lit(default))


def parse_float(c: Column | str, default: float | None = None) -> Column:
    """Number in a text; words for "no number" and unreadable text give the default."""
    text = F.lower(strip(_col(c).cast("string")))
    value = F.when(~text.isin(NO_NUMBER_WORDS), text.try_cast("double"))
    return F.coalesce(value, F.lit(default).cast("double"))


def safe_float(c: Column | str, default: float = 0.0) -> Column:
    return F.coalesce(strip(_col(c).cast("string")).try_cast("double"), F.lit(default).cast("double"))


def safe_int(c: Column | str, default: int | None = 0) -> Column:
    """Whole part of a number in a text, towards zero; NaN and infinity give the default."""
    value = strip(_col(c).cast("string")).try_cast("double")
    return F.coalesce(value.try_cast("bigint"), F.lit(default).cast("bigint"))


def parse_binary(c: Column | str) -> Column:
    text = F.lower(strip(F.coalesce(_col(c).cast("string"), F.lit(""))))
    return F.when(text.isin(YES_WORDS), 1).otherwise(0)


def base_name(c: Column | str) -> Column:
    return F.regexp_extract(strip(F.coalesce(_col(c).cast("string"), F.lit(""))), r"([^/]*)$", 1)


def stem(c: Column | str) -> Column:
    """Name without its last extension; leading dots are not an extension."""
    return F.regexp_replace(_col(c), r"(?<=[^./])\.[^./]*$", "")


def name_keys(c: Column | str) -> Column:
    """All spellings a file name can be looked up by, in a fixed order."""
    name = strip(_col(c))
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    plain = stem(base)
    keys = F.array(name, base, plain, F.lower(name), F.lower(base), F.lower(plain))
    return F.filter(F.array_distinct(keys), lambda k: k != "")


def percent_text(c: Column | str) -> Column:
    return F.format_string("%.1f%%", _col(c) * 100)


def expert_name(path: Column | str) -> Column:
    """Expert in a file name such as expert_scores_Name.csv."""
    plain = stem(F.regexp_extract(_col(path), r"([^/]*)$", 1))
    name = F.regexp_replace(plain, "^expert_scores_", "")
    return F.when(name == "", F.lit("Unknown")).otherwise(name)


@F.pandas_udf(StringType())
def _nfkd(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


def normalize_text(c: Column | str) -> Column:
    """Compatibility-decomposed lower-case text without white space and periods.

    Only text outside ASCII is sent to Python: decomposition leaves ASCII as it is.
    """
    text = F.coalesce(_col(c), F.lit(""))
    foreign = F.when(text.rlike(r"[^\x00-\x7f]"), text)
    return F.lower(F.regexp_replace(F.coalesce(_nfkd(foreign), text), r"(?U)[\s\x1c-\x1f.]+", ""))


def designations(c: Column | str) -> Column:
    """All coordinate designations in a name."""
    return F.regexp_extract_all(_col(c), F.lit(DESIGNATION), F.lit(0))


def designation_variants(found: Column) -> Column:
    """Designations cut to every precision down to their whole digits, lower-case, no periods."""

    def parts(d: Column) -> Column:
        ra, sign, dec = (F.regexp_extract(d, DESIGNATION, i) for i in (1, 2, 3))
        return F.struct(
            F.replace(ra, F.lit("."), F.lit("")).alias("ra"), F.length(F.substring_index(ra, ".", 1)).alias("ra_min"),
            F.replace(dec, F.lit("."), F.lit("")).alias("dec"), F.length(F.substring_index(dec, ".", 1)).alias("dec_min"),
            sign.alias("sign"),
        )

    def cuts(p: Column, digits: str) -> Column:
        """The first n digits for every n from the whole digits up."""
        places = F.sequence(p[f"{digits}_min"], F.length(p[digits]))
        return F.transform(places, lambda n: F.substring(p[digits], F.lit(1), n))

    def variants(p: Column) -> Column:
        return F.flatten(
            F.transform(
                cuts(p, "ra"),
                lambda ra: F.transform(cuts(p, "dec"), lambda dec: F.concat(F.lit("j"), ra, p["sign"], dec)),
            )
        )

    return F.flatten(F.transform(F.transform(found, parts), variants))


def search_keys(alias: Column | str, normalized_name: Column | str | None = None) -> Column:
    """Normalised substrings that show a paper names the object.

    `normalized_name` may carry `normalize_text(stripped_alias(alias))` computed
    beforehand, which keeps the Python step out of nested expressions.
    """
    alias = F.coalesce(_col(alias), F.lit(""))
    name = stripped_alias(alias)
    norm = normalize_text(name) if normalized_name is None else _col(normalized_name)
    whole = F.when(
        (F.length(name) >= 4) & ~name.rlike(f"^(?:{DESIGNATION})$"), F.array(norm)
    ).otherwise(F.array().cast("array<string>"))
    coords = designation_variants(designations(alias))
    return F.filter(F.array_distinct(F.concat(coords, whole)), lambda k: F.length(k) >= 6)


def stripped_alias(alias: Column | str) -> Column:
    return strip(F.regexp_replace(F.coalesce(_col(alias), F.lit("")), PREFIX_PATTERN, ""))


def phrases(alias: Column | str) -> Column:
    """Phrases to look an alias up by in a full-text index."""
    alias = F.coalesce(_col(alias), F.lit(""))
    ra, sign, dec = (F.regexp_extract(alias, DESIGNATION, i) for i in (1, 2, 3))
    ra_whole, dec_whole = F.substring_index(ra, ".", 1), F.substring_index(dec, ".", 1)

    def short(n: int) -> Column:
        fits = (ra != "") & (F.length(ra_whole) >= n) & (F.length(dec_whole) >= n)
        return F.when(fits, F.concat(F.lit("J"), F.substring(ra_whole, 1, n), sign, F.substring(dec_whole, 1, n)))

    full = F.when(ra != "", F.concat(F.lit("J"), ra, sign, dec))
    name = strip(F.regexp_replace(F.regexp_replace(alias, PREFIX_PATTERN, ""), TRAILING_PATTERN, ""))
    plain = F.when(F.length(name) >= 4, name)
    return F.array_distinct(F.array_compact(F.array(full, short(4), short(6), plain)))


def clean_phrase(c: Column | str) -> Column:
    return strip(F.regexp_replace(_col(c), r'["\\]', ""))


def year_of(bibcode: Column | str) -> Column:
    """First four characters of a bibliographic code when they are digits, else empty."""
    head = F.substring(_col(bibcode), 1, 4)
    return F.when(head.rlike(r"^\d{1,4}$"), head).otherwise("")


def year_number(c: Column | str) -> Column:
    """Year for ordering; text that is not a whole number comes lowest."""
    text = _col(c).cast("string")
    return F.when(text.rlike(r"^\d+$"), text.try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def search_text(*cols: Column | str) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(_col(c).cast("string"), F.lit("")) for c in cols]))


def survey_link(ra: Column | str, dec: Column | str) -> Column:
    """Link to a public sky viewer; a record at exactly (0, 0) has no position."""
    ra, dec = _col(ra), _col(dec)
    url = F.format_string("https://www.legacysurvey.org/viewer?ra=%s&dec=%s&layer=ls-dr9&zoom=12", ra, dec)
    return F.when((ra != 0) | (dec != 0), url).otherwise("")


def paper_link(bibcode: Column | str) -> Column:
    code = F.coalesce(_col(bibcode), F.lit(""))
    url = F.concat(F.lit("https://ui.adsabs.harvard.edu/abs/"), F.url_encode(code), F.lit("/abstract"))
    return F.when(code != "", url).otherwise("")
