"""Value standardisation as Column expressions (no Python in the data path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean "no value" in the typed sources, compared trimmed and lower-cased.
MISSING_TEXTS = ["", "unknown", "n/e", "no entry", "nk", "na", "ng"]


def plain(value: Column | str) -> Column:
    """Lower-cased, each run of characters other than letters and digits one blank, trimmed. Null stays null."""
    c = F.col(value) if isinstance(value, str) else value
    low = F.lower(c)
    # Most values are one word already, which a look tells; writing the text anew costs several times as much.
    return F.when(low.rlike(r"^[\p{L}\p{N}]+$"), low).otherwise(F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " ")))


def is_missing(value: Column | str) -> Column:
    """True for null and for the texts in MISSING_TEXTS."""
    c = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.lower(F.trim(c)).isin(MISSING_TEXTS), F.lit(True))


def plain_or_null(value: Column | str) -> Column:
    """The plain form; null where the value is missing or has no letter or digit."""
    c = F.col(value) if isinstance(value, str) else value
    p = plain(c)
    return F.when(~is_missing(c) & (p != ""), p)


# --- standard values of records --------------------------------------------------------------------------------

#: Texts that stand for no value, compared before lower-casing, and cleaned texts that do.
NULL_TEXTS = ["n/e", "unknown", "no entry", "ng", "nk", "na"]
NULL_CLEANED = ["", "anonymous", "n e"]


def standard_string(c: Column | str) -> Column:
    """Lower case, punctuation to blanks, blanks joined; null for what stands for no value."""
    c = F.col(c) if isinstance(c, str) else c
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[!-/:-@\[-`{-~]", " "), r"\s+", " "))
    return F.when(~c.isin(NULL_TEXTS) & ~clean.isin(NULL_CLEANED), clean)


def standard_number(c: Column | str) -> Column:
    """'' is null, digits a number, 'm:s' seconds, other numbers cut to whole ones, and what is no number 0."""
    c = F.col(c) if isinstance(c, str) else c
    parts = F.split(c, ":")
    seconds = F.try_element_at(parts, F.lit(1)).try_cast("int") * 60 + F.try_element_at(parts, F.lit(2)).try_cast("int")
    number = F.when(c.rlike(r"^\d+$"), c.try_cast("long")).when(c.rlike(r"^\d+:\d+$"), seconds.cast("long")).otherwise(c.try_cast("double").cast("long"))
    return F.when((c != "") & c.isNotNull(), F.coalesce(number, F.lit(0).cast("long")))


def strip_entities(c: Column | str) -> Column:
    """Without HTML entities and the blanks around them, from the first & to the last ; of the text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, r"\s*&.*;\s*", " ")


def split_name(c: Column | str) -> Column:
    """struct(fname, mname, sname): one word is both first and surname, of more than three only the first three count."""
    c = F.col(c) if isinstance(c, str) else c
    w = F.filter(F.split(F.lower(F.regexp_replace(c, r"[!-/:-@\[-`{-~]", " ")), r"\s+"), lambda x: x != "")
    first, second, third = (F.try_element_at(w, F.lit(i)) for i in (1, 2, 3))
    n = F.size(w)
    return F.struct(first.alias("fname"), F.when(n > 2, second).alias("mname"), F.when(n == 1, first).when(n == 2, second).otherwise(third).alias("sname"))


#: Formats of dates, in the order they are tried, and impossible dates with what was meant.
DATE_FORMATS = ["d/M/yyyy", "d/M/yyyy HH:mm:ss", "yyyy", "d/M/yyyy HH:mm", "d/M/yyyyHH:mm:ss"]
IMPOSSIBLE_DATES = {"31/4/1905": "30/4/1905", "30/2/1853": "28/2/1853", "29/2/1849": "28/2/1849", "31/6/1857": "30/6/1857"}


def parse_date(c: Column | str) -> Column:
    """A timestamp from text in one of DATE_FORMATS, null if in none; a leading 'None/' is dropped."""
    c = F.col(c) if isinstance(c, str) else c
    c = F.regexp_replace(F.trim(c), "^None/", "")
    for wrong, right in IMPOSSIBLE_DATES.items():
        c = F.when(c == wrong, right).otherwise(c)
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS])


def epoch_seconds(date: Column | str) -> Column:
    return F.unix_timestamp(F.to_timestamp(date))


def gender(c: Column | str) -> Column:
    """F, M, or null for anything else, which agrees with both."""
    c = F.upper(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.when(c.isin("F", "M"), c)


def birth_year(event_year: Column, age: Column) -> Column:
    """Event year less age; null if the age has letters."""
    return F.when(~F.lower(age).rlike("[a-z]"), (event_year - age.try_cast("double")).cast("int"))


def clean_marriage_year(c: Column, first: int = 1800, last: int = 1901) -> Column:
    return F.when(c.between(first, last), c)


def census_text(c: Column | str) -> Column:
    """Code texts such as '2.0' without the decimals."""
    t = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(F.endswith(t, F.lit(".0")), F.substring(t, F.lit(1), F.length(t) - 2)).otherwise(t)


#: Census codes for "not known".
UNKNOWN_CODES = {"bpl": ["999"], "stateicp": ["99"], "city": ["0"], "occ1950": ["995", "997", "999"]}


def census_code(c: Column | str, kind: str) -> Column:
    code = census_text(c)
    return F.when(~code.isin(UNKNOWN_CODES.get(kind, [])), code)


# --- keys --------------------------------------------------------------------------------------------------------


def prefixed_id(source: Column, id_: Column) -> Column:
    """Ids of two sources made distinct: 'DA-' and 'DB-' before the number."""
    return F.concat(F.lit("D"), source, F.lit("-"), id_.cast("string"))


def concat_key(*columns: str) -> Column:
    """Values joined by '-', a null as the text None."""
    return F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns])


def pair_key(a: Column, b: Column) -> Column:
    """An unordered pair as struct(a, b) with a <= b."""
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


#: Suffix of a certificate number by role and sex of the person on it.
CERTIFICATE_SUFFIX = {
    ("Bb", "M"): "bb", ("Bb", "F"): "bb", ("Bp", "F"): "bm", ("Bp", "M"): "bf", ("Dp", "F"): "dm", ("Dp", "M"): "df", ("Mbp", "F"): "mbm", ("Mbp", "M"): "mbf",
    ("Mgp", "F"): "mgm", ("Mgp", "M"): "mgf", ("Mm", "F"): "b", ("Mm", "M"): "g", ("Dd", "M"): "dd", ("Dd", "F"): "dd", ("Ds", "M"): "ds", ("Ds", "F"): "ds",
}


def certificate_key(cert: Column, role: Column, sex: Column) -> Column:
    suffix = F.lit(None).cast("string")
    for (r, s), text in CERTIFICATE_SUFFIX.items():
        suffix = F.when((role == r) & ((sex == s) | (sex.isNull() & F.lit(r in ("Bb", "Dd", "Ds")))), text).otherwise(suffix)
    return F.concat(cert.cast("string"), F.lit("_"), suffix)


def link_name(role1: Column, role2: Column, listed: list[str]) -> Column:
    """role1-role2 if that link is listed, else the roles the other way round."""
    forward = F.concat(role1, F.lit("-"), role2)
    return F.when(forward.isin(listed), forward).otherwise(F.concat(role2, F.lit("-"), role1))
