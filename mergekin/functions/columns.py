"""Comparators, encoders and vector functions as Column expressions.

What the JVM can express is a native expression and stays inside whole-stage code generation; the other
comparators and encoders are Arrow-batched functions, meant for distinct values.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergekin.functions import compare, phonetic
from mergekin.functions.phonetic import MOD_SOUNDEX_DIGITS, PHONIX_DIGITS, SOUNDEX_DIGITS

_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _contract(a: Column, b: Column, score: Column) -> Column:
    """0 where either side is empty or null, 1 where they are equal."""
    return F.when(F.coalesce(a, F.lit("")).eqNullSafe("") | F.coalesce(b, F.lit("")).eqNullSafe(""), 0.0).when(a == b, 1.0).otherwise(score)


def exact(a: Column | str, b: Column | str) -> Column:
    return _contract(_col(a), _col(b), F.lit(0.0))


def edit_dist(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    return _contract(a, b, 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def _bag_common(x: Column, y: Column) -> Column:
    """Size of the bag intersection of two arrays."""
    count = lambda arr, v: F.size(F.filter(arr, lambda w: w == v))
    return F.aggregate(F.array_intersect(x, y), F.lit(0), lambda acc, v: acc + F.least(count(x, v), count(y, v)))


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def grams(c: Column | str, q: int, padded: bool = True) -> Column:
    c = _col(c)
    s = F.concat(F.lit("\x01" * (q - 1)), c, F.lit("\x02" * (q - 1))) if padded and q > 1 else c
    n = F.length(s) - q + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(s, i, F.lit(q)))).otherwise(F.array().cast("array<string>"))


def _divide(common: Column, x: Column, y: Column, divisor: str) -> Column:
    by = {"average": (F.size(x) + F.size(y)) / 2, "shortest": F.least(F.size(x), F.size(y)), "longest": F.greatest(F.size(x), F.size(y))}[divisor]
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(common / by)


def qgram(a: Column | str, b: Column | str, q: int = 2, divisor: str = "average", padded: bool = True) -> Column:
    a, b = _col(a), _col(b)
    x, y = grams(a, q, padded), grams(b, q, padded)
    return _contract(a, b, _divide(_bag_common(x, y), x, y, divisor))


def bag_dist(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    longest = F.greatest(F.length(a), F.length(b))
    return _contract(a, b, 1 - (longest - _bag_common(_chars(a), _chars(b))) / longest)


def sorted_words(c: Column | str) -> Column:
    c = _col(c)
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    return F.when(c.contains(" "), F.array_join(F.array_sort(words), " ")).otherwise(c)


def abs_difference(a: Column | str, b: Column | str, most: float = 10) -> Column:
    """1 - |a - b| / most, 0 beyond most; null if either is null."""
    gap = F.abs(_col(a) - _col(b))
    return F.when(gap <= most, 1 - gap / most).when(gap.isNotNull(), 0.0)


def geo_distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(h))


def geo_likeness(km: Column, most: float = 20) -> Column:
    return F.greatest(F.lit(0.0), 1 - km / most)


# --- encoders ----------------------------------------------------------------------------------------------------


def soundex(c: Column | str) -> Column:
    """First letter and three digits; vowels part equal digits, the first letter does not swallow any. Empty or null: '0000'."""
    c = F.coalesce(_col(c), F.lit(""))
    digits = F.translate(F.replace(F.substring(c, F.lit(2), F.length(c)), F.lit(" "), F.lit("")), _LETTERS, SOUNDEX_DIGITS)
    runs = F.regexp_replace(digits, r"(.)\1+", "$1")
    return F.when(c == "", "0000").otherwise(F.rpad(F.concat(F.substring(c, 1, 1), F.regexp_replace(runs, "0", "")), 4, "0"))


def mod_soundex(c: Column | str) -> Column:
    c = F.coalesce(_col(c), F.lit(""))
    kept = F.regexp_replace(F.substring(c, F.lit(2), F.length(c)), "[aeiouhwy ]", "")
    return F.when(c == "", "0000").otherwise(F.rpad(F.concat(F.substring(c, 1, 1), F.regexp_replace(F.translate(kept, _LETTERS, MOD_SOUNDEX_DIGITS), r"(.)\1+", "$1")), 4, "0"))


def freq_vector(c: Column | str, scheme: str | None = None) -> Column:
    """Counts per letter or per digit of a scheme; null for the empty string."""
    c = F.lower(_col(c))
    table = {None: None, "phonix": PHONIX_DIGITS, "soundex": SOUNDEX_DIGITS, "mod_soundex": MOD_SOUNDEX_DIGITS}[scheme]
    kept = F.regexp_replace(c, "[^a-z]", "")
    coded = kept if table is None else F.translate(kept, _LETTERS, table)
    marks = list(_LETTERS) if table is None else [str(i) for i in range(int(max(table)) + 1)]
    counts = F.array(*[F.length(coded) - F.length(F.replace(coded, F.lit(m), F.lit(""))) for m in marks])
    return F.when(F.length(c) > 0, counts)


# --- vectors -----------------------------------------------------------------------------------------------------


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def _pairwise(a: Column | str, b: Column | str, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: f(x.cast("double"), y.cast("double")))


def dist_l1(a: Column | str, b: Column | str) -> Column:
    return _sum(_pairwise(a, b, lambda x, y: F.abs(x - y)))


def dist_l2(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(_sum(_pairwise(a, b, lambda x, y: (x - y) * (x - y))))


def dist_linf(a: Column | str, b: Column | str) -> Column:
    """Largest difference; -1 for empty vectors."""
    return F.coalesce(F.array_max(_pairwise(a, b, lambda x, y: F.abs(x - y))), F.when(F.size(_col(a)) == 0, -1.0))


def dist_canberra(a: Column | str, b: Column | str) -> Column:
    return _sum(_pairwise(a, b, lambda x, y: F.when(F.abs(x) + F.abs(y) > 0, F.abs(x - y) / (F.abs(x) + F.abs(y))).otherwise(0.0)))


def dist_cosine(a: Column | str, b: Column | str) -> Column:
    """1 - cosine, at least 0; 1 if a vector is all zeros."""
    dot = _sum(_pairwise(a, b, lambda x, y: x * y))
    norm = F.sqrt(_sum(_pairwise(a, a, lambda x, y: x * y))) * F.sqrt(_sum(_pairwise(b, b, lambda x, y: x * y)))
    return F.when(norm == 0, 1.0).otherwise(1 - F.least(F.lit(1.0), dot / norm))


# --- by name -----------------------------------------------------------------------------------------------------

NATIVE: dict[str, Callable[[Column | str, Column | str], Column]] = {
    "exact": exact, "editdist": edit_dist, "bagdist": bag_dist, "bigram": qgram,
    **{f"{q}gram{'P' * p}{d}": (lambda a, b, q=q, p=p, d=d: qgram(a, b, q, d, p)) for q in (1, 2, 3) for p in (False, True) for d in compare.DIVISORS},
}


def compare_udf(name: str) -> Callable[[Column | str, Column | str], Column]:
    """The comparator as an Arrow-batched function; a pair that recurs in a batch is scored once. Null counts as empty."""

    @F.pandas_udf(T.DoubleType())
    def scored(a: pd.Series, b: pd.Series) -> pd.Series:
        if name == "sortwinkler":
            return pd.Series(compare.sort_winkler_many([v or "" for v in a], [v or "" for v in b]))
        f, memo = compare.comparator(name), {}
        out = []
        for pair in zip(a, b, strict=True):
            if pair not in memo:
                memo[pair] = f(pair[0] or "", pair[1] or "")
            out.append(memo[pair])
        return pd.Series(out, dtype=float)

    return lambda a, b: scored(_col(a), _col(b))


def similarity(name: str) -> Callable[[Column | str, Column | str], Column]:
    """A comparator by name: native where there is a native form."""
    return NATIVE.get(name) or compare_udf(name)


def encode_udf(name: str) -> Callable[[Column | str], Column]:
    @F.pandas_udf(T.StringType())
    def coded(s: pd.Series) -> pd.Series:
        f = phonetic.encoder(name)
        distinct = {v: f(v or "") for v in s.unique()}
        return s.map(distinct) if len(s) else s

    return lambda c: coded(F.coalesce(_col(c), F.lit("")))


def with_code(df: DataFrame, column: str, name: str, out: str) -> DataFrame:
    """df plus a phonetic code of a column, computed once for each distinct value and joined back."""
    codes = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn(out, encode_udf(name)(column))
    return df.join(codes, column, "left")


def register(spark) -> list[str]:
    """Makes all comparators and encoders SQL functions: sim_<name>(a, b) and enc_<name>(s), with '-' as '_'."""
    names = []
    for name in compare.COMPARATORS:
        spark.udf.register(f"sim_{name.replace('-', '_')}", F.pandas_udf(_bound_compare(name), T.DoubleType()))
        names.append(f"sim_{name.replace('-', '_')}")
    for name in phonetic.ENCODERS:
        spark.udf.register(f"enc_{name}", F.pandas_udf(_bound_encode(name), T.StringType()))
        names.append(f"enc_{name}")
    return names


def _bound_compare(name: str) -> Callable[[pd.Series, pd.Series], pd.Series]:
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        f = compare.comparator(name)
        return pd.Series([f(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)

    return score


def _bound_encode(name: str) -> Callable[[pd.Series], pd.Series]:
    def code(s: pd.Series) -> pd.Series:
        f = phonetic.encoder(name)
        return s.map(lambda v: f(v or ""))

    return code
