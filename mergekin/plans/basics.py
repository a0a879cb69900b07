"""Queries of the row-wise operators: standardisers, keys, predicates, native comparators, encoders and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mergekin import predicates as P
from mergekin import standardise as S
from mergekin.functions import columns as C
from mergekin.functions import compare, phonetic
from mergekin.functions.maths import random_expo, random_linear, summary, tag_sequences
from mergekin.functions.phonetic import MOD_SOUNDEX_DIGITS, PHONIX_DIGITS, SOUNDEX_DIGITS
from mergekin.session import read

_AZ = "abcdefghijklmnopqrstuvwxyz"
_PUNCT = r"[!-/:-@\[-`{-~]"


def _r(c, n: int = 9):
    return F.round(c, n)


# --- standardisers -------------------------------------------------------------------------------------------------


def standard_titles(spark: SparkSession, d: str) -> DataFrame:
    pubs = read(spark, d, "publication_dict")
    return pubs.select("id", S.standard_string("pub_name").alias("title"), S.standard_string("venue").alias("venue"))


def standard_numbers(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "couples_csv")
    return c.select("couple_id", *[S.standard_number(f).alias(f) for f in ("age_1", "occ1950_1", "linktype")], S.standard_number(F.concat_ws(":", F.col("pernum_1").cast("string"), F.lit("30"))).alias("as_time"))


def author_name_parts(spark: SparkSession, d: str) -> DataFrame:
    people = read(spark, d, "people_dict")
    return people.select("id", S.split_name(S.strip_entities("fullname")).alias("n")).select("id", "n.fname", "n.mname", "n.sname")


def parsed_dates(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "d/M/yyyy")).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("None/"), F.date_format("o_orderdate", "dd/MM/yyyy"))).when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "yyyy")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss"))
    t = S.parse_date(text)
    return o.select("o_orderkey", F.to_date(t).cast("string").alias("day"), S.epoch_seconds(t).alias("seconds"))


def census_values(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "couples_csv")
    year = F.col("year_1").cast("int")
    return c.select(
        "couple_id", S.gender(F.when(S.census_text("sex_1") == "1", " m").when(S.census_text("sex_1") == "2", "f ")).alias("sex"), S.birth_year(year, F.col("age_1")).alias("born"),
        *[S.census_code(f"{k}_1", k).alias(k) for k in ("bpl", "stateicp", "city", "occ1950")], S.clean_marriage_year(year + 20, 1800, 1889).alias("wed"),
    )


def geo_distances(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 6.5 - 80).alias("lat"), (F.col("n_nationkey") * 14.0 - 170).alias("lon"), (F.col("n_nationkey") + 1).alias("next"))
    m = n.select(F.col("n_nationkey").alias("next"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    km = C.geo_distance_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return n.join(m, "next").select("n_nationkey", _r(km, 6).alias("km"), _r(C.geo_likeness(km, 2000), 6).alias("alike"))


def prefixed_records(spark: SparkSession, d: str) -> DataFrame:
    pubs = read(spark, d, "publication_dict").select("id", "source", "origin_id", "author_ids")
    one = pubs.select(S.prefixed_id(F.col("source"), F.col("origin_id")).alias("record"), F.col("source"), F.array_join(F.transform("author_ids", lambda x: S.prefixed_id(F.col("source"), x)), " ").alias("authors"), "id")
    return one.where("source = 'A'").unionByName(one.where("source = 'B'"))


def certificate_keys(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "couples_csv")
    rel, sex = S.census_text("relate_1"), F.when(S.census_text("sex_1") == "1", "M").when(S.census_text("sex_1") == "2", "F")
    role = F.when(rel == "3", "Bb").otherwise("Bp")
    return c.select("couple_id", S.certificate_key(F.col("serial_1"), role, sex).alias("cert"), S.concat_key("serial_1", "pernum_1", "serial_2").alias("key"), S.link_name(role, F.lit("Bp"), ["Bb-Bp", "Bp-Bp"]).alias("link"))


def pair_keys(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "valid").where("ltable_id is not null and rtable_id is not null")
    k = S.pair_key(F.col("ltable_id"), F.col("rtable_id"))
    return v.select(k.alias("k")).select("k.a", "k.b").where("a != b").distinct()


# --- predicates ----------------------------------------------------------------------------------------------------


def temporal_predicates(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    pairs = o.select("o_orderkey", F.col("o_orderdate").alias("d2"), F.lag("o_orderdate").over(w).alias("d1"), F.lag("o_orderkey").over(w).alias("before"))
    y1, y2 = F.year("d1"), F.year("d2")
    return pairs.select(
        "o_orderkey", "before", P.one_generation(y1 - 13, y2).alias("one_generation"), P.one_generation_dates(F.col("d1"), F.col("d2")).alias("one_generation_dates"), P.two_generations(y1 - 29, y2).alias("two_generations"),
        P.years_close(y1, y2).alias("years_close"), P.marriage_years_close(y1 - 19, y2).alias("weddings_close"), P.is_after(F.col("d1"), F.col("d2")).alias("is_after"),
        P.nine_months_apart(F.col("d1"), F.col("d2")).alias("nine_apart"), P.at_most_nine_months_before(F.col("d2"), F.col("d1")).alias("nine_before"), P.earliest_year(y1, y2).alias("earliest"), P.latest_year(y1, y2).alias("latest"),
    )


def sexes_agreeing(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "couples_csv")
    sex = lambda n: F.when(S.census_text(f"sex_{n}") == "1", "M").when(S.census_text(f"sex_{n}") == "2", "F").otherwise("")
    return c.select("couple_id", P.sexes_agree(sex(1), sex(2)).alias("agree"), P.common_sex(sex(1), sex(2)).alias("sex"))


# --- comparators and encoders ------------------------------------------------------------------------------------------


def _name_pairs(spark: SparkSession, d: str) -> DataFrame:
    """First names of linked persons in the two censuses, as typed: distinct pairs."""
    c = read(spark, d, "couples_csv")
    return c.select(S.plain("namefrst_1").alias("a"), S.plain("namefrst_2").alias("b")).where("a is not null and b is not null").distinct()


def native_comparators(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _name_pairs(spark, d).select(
        "a", "b", C.exact(a, b).alias("exact"), _r(C.edit_dist(a, b)).alias("editdist"), _r(C.qgram(a, b)).alias("bigram"), _r(C.qgram(a, b, 2, "shortest", False)).alias("bigram_short"),
        _r(C.qgram(a, b, 3, "longest")).alias("trigram_long"), _r(C.bag_dist(a, b)).alias("bagdist"), C.sorted_words(a).alias("sorted_a"),
    )


def all_comparators(spark: SparkSession, d: str) -> DataFrame:
    """Every comparator, by name, on every distinct name pair: long form."""
    pairs = _name_pairs(spark, d)
    names = [*compare.COMPARATORS, "jaro-winkler", "bigram-winkler"]

    def score(batches):
        import pandas as pd

        fs = {n: compare.comparator(n) for n in names}
        for x in batches:
            rows = [(a, b, n, f(a, b)) for a, b in zip(x["a"], x["b"], strict=True) for n, f in fs.items()]
            yield pd.DataFrame(rows, columns=["a", "b", "comparator", "score"])

    return pairs.mapInPandas(score, "a string, b string, comparator string, score double")


def native_encoders(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "people_dict").select(S.plain("sname").alias("name")).where("name is not null").distinct()
    vec = lambda scheme: F.array_join(C.freq_vector("name", scheme), " ")
    ascii_only = F.regexp_replace("name", "[^a-z ]", "")
    n = n.select(ascii_only.alias("name")).distinct()
    return n.select("name", C.soundex("name").alias("soundex"), C.mod_soundex("name").alias("mod_soundex"), vec(None).alias("letters"), vec("soundex").alias("by_soundex"), vec("mod_soundex").alias("by_mod_soundex"), vec("phonix").alias("by_phonix"))


def all_encoders(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "people_dict").select(F.regexp_replace(S.plain("sname"), "[^a-z ]", "").alias("name")).where("name is not null").distinct()
    return n.select("name", *[C.encode_udf(f"{e}4")("name").alias(e) for e in phonetic.ENCODERS], C.encode_udf("phonix_transform")("name").alias("phonix_text"))


# --- vectors and maths -----------------------------------------------------------------------------------------------


def vector_distances(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select("vec_id", "label", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"))
    j = e.join(other, "vec_id")
    return j.select("vec_id", *[_r(f("embedding", "e2"), 5).alias(n) for n, f in (("l1", C.dist_l1), ("l2", C.dist_l2), ("linf", C.dist_linf), ("canberra", C.dist_canberra), ("cosine", C.dist_cosine))])


def price_summary(spark: SparkSession, d: str) -> DataFrame:
    s = summary(read(spark, d, "part"), "p_retailprice", (0.1, 0.25, 0.5, 0.9))
    return s.select("n", _r(F.col("mean"), 6).alias("mean"), _r(F.col("stddev"), 6).alias("stddev"), *[_r(F.col("quantiles")[i], 6).alias(f"q{q}") for i, q in enumerate((10, 25, 50, 90))])


def tag_expansions(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "publication_dict").select("id", F.array(F.col("source"), F.lit("P/W"), F.when(F.col("year") > 2000, "new").otherwise("old/mid")).alias("tags"))
    return p.select("id", F.explode(tag_sequences(F.col("tags"))).alias("sequence"))


def random_draws(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation").select("n_nationkey")
    return n.select("n_nationkey", random_linear(10, 1).alias("linear"), random_expo(10, 2).alias("expo"))


def embedded_json(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", "event_type", F.from_json("props", "map<string,string>").alias("m"))
    return e.select("event_id", F.size("m").alias("keys"), F.array_join(F.array_sort(F.map_keys("m")), " ").alias("names"))


QUERIES = {
    "standard_titles": standard_titles, "standard_numbers": standard_numbers, "author_name_parts": author_name_parts, "parsed_dates": parsed_dates, "census_values": census_values, "geo_distances": geo_distances,
    "prefixed_records": prefixed_records, "certificate_keys": certificate_keys, "pair_keys": pair_keys, "temporal_predicates": temporal_predicates, "sexes_agreeing": sexes_agreeing,
    "native_comparators": native_comparators, "all_comparators": all_comparators, "native_encoders": native_encoders, "all_encoders": all_encoders, "vector_distances": vector_distances,
    "price_summary": price_summary, "tag_expansions": tag_expansions, "random_draws": random_draws, "embedded_json": embedded_json,
}


def _sql_standard(c: str) -> str:
    clean = rf"trim(regexp_replace(regexp_replace(lower({c}), '{_PUNCT}', ' ', 'g'), '\s+', ' ', 'g'))"
    return f"CASE WHEN {c} NOT IN ('n/e', 'unknown', 'no entry', 'ng', 'nk', 'na') AND {clean} NOT IN ('', 'anonymous', 'n e') THEN {clean} END"


def _sql_number(c: str) -> str:
    return rf"""CASE WHEN {c} <> '' THEN coalesce(CASE WHEN regexp_matches({c}, '^\d+$') THEN TRY_CAST({c} AS BIGINT)
        WHEN regexp_matches({c}, '^\d+:\d+$') THEN TRY_CAST(split_part({c}, ':', 1) AS BIGINT) * 60 + TRY_CAST(split_part({c}, ':', 2) AS BIGINT)
        ELSE CAST(trunc(TRY_CAST({c} AS DOUBLE)) AS BIGINT) END, 0) END"""


def _code(c: str) -> str:
    return rf"regexp_replace(trim({c}), '\.0$', '')"


def _plain(c: str) -> str:
    return rf"trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def _grams(c: str, q: int, padded: bool) -> str:
    s = f"(repeat(chr(1), {q - 1}) || {c} || repeat(chr(2), {q - 1}))" if padded else c
    return f"list_transform(range(1, greatest(length({s}) - {q} + 2, 1)), lambda i: substring({s}, CAST(i AS INTEGER), {q}))"


def _bag(x: str, y: str) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct(list_intersect({x}, {y})), lambda g: least(len(list_filter({x}, lambda h: h = g)), len(list_filter({y}, lambda h: h = g))))), 0)"


def _qgram(q: int, divisor: str, padded: bool) -> str:
    x, y = _grams("a", q, padded), _grams("b", q, padded)
    by = {"average": f"((len({x}) + len({y})) / 2.0)", "shortest": f"least(len({x}), len({y}))", "longest": f"greatest(len({x}), len({y}))"}[divisor]
    return f"CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0 WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE round(CAST({_bag(x, y)} AS DOUBLE) / {by}, 9) END"


def _freq(table: str | None) -> str:
    kept = "regexp_replace(lower(name), '[^a-z]', '', 'g')"
    coded = kept if table is None else f"translate({kept}, '{_AZ}', '{table}')"
    marks = list(_AZ) if table is None else [str(i) for i in range(int(max(table)) + 1)]
    return "CASE WHEN length(name) > 0 THEN " + " || ' ' || ".join(f"CAST(length({coded}) - length(replace({coded}, '{m}', '')) AS VARCHAR)" for m in marks) + " END"


def _runs(c: str) -> str:
    """DuckDB's patterns have no back references, so every digit's runs are joined in turn."""
    for i in range(10):
        c = f"regexp_replace({c}, '{i}+', '{i}', 'g')"
    return c


_LAT = "SELECT n_nationkey, n_nationkey * 6.5 - 80 AS lat, n_nationkey * 14.0 - 170 AS lon FROM nation"
_KM = "2 * 6371.0 * asin(sqrt(pow(sin((radians(m.lat) - radians(n.lat)) / 2), 2) + cos(radians(n.lat)) * cos(radians(m.lat)) * pow(sin((radians(m.lon) - radians(n.lon)) / 2), 2)))"

SQL = {
    "standard_titles": f"SELECT id, {_sql_standard('pub_name')} AS title, {_sql_standard('venue')} AS venue FROM publication_dict",
    "standard_numbers": f"SELECT couple_id, {_sql_number('age_1')} AS age_1, {_sql_number('occ1950_1')} AS occ1950_1, {_sql_number('linktype')} AS linktype, CASE WHEN pernum_1 IS NOT NULL THEN CAST(pernum_1 AS BIGINT) * 60 + 30 ELSE 30 END AS as_time FROM couples_csv",
    "author_name_parts": rf"""
        WITH w AS (SELECT id, list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(fullname, '\s*&.*;\s*', ' '), '{_PUNCT}', ' ', 'g')), '\s+'), lambda x: x <> '') AS w FROM people_dict)
        SELECT id, w[1] AS fname, CASE WHEN len(w) > 2 THEN w[2] END AS mname, CASE WHEN len(w) = 1 THEN w[1] WHEN len(w) = 2 THEN w[2] ELSE w[3] END AS sname FROM w""",
    "parsed_dates": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 2 THEN CAST(date_trunc('year', o_orderdate) AS DATE) ELSE CAST(o_orderdate AS DATE) END::VARCHAR AS day,
               CAST(epoch(CASE WHEN o_orderkey % 4 = 2 THEN date_trunc('year', o_orderdate) WHEN o_orderkey % 4 = 3 THEN date_trunc('second', o_orderdate) ELSE date_trunc('day', o_orderdate) END) AS BIGINT) AS seconds
        FROM orders""",
    "census_values": f"""
        SELECT couple_id, CASE {_code('sex_1')} WHEN '1' THEN 'M' WHEN '2' THEN 'F' END AS sex, CAST(trunc(year_1 - TRY_CAST(age_1 AS DOUBLE)) AS INTEGER) AS born,
               CASE WHEN {_code('bpl_1')} NOT IN ('999') THEN {_code('bpl_1')} END AS bpl, CASE WHEN {_code('stateicp_1')} NOT IN ('99') THEN {_code('stateicp_1')} END AS stateicp,
               CASE WHEN {_code('city_1')} NOT IN ('0') THEN {_code('city_1')} END AS city, CASE WHEN {_code('occ1950_1')} NOT IN ('995', '997', '999') THEN {_code('occ1950_1')} END AS occ1950,
               CASE WHEN year_1 + 20 BETWEEN 1800 AND 1889 THEN year_1 + 20 END AS wed
        FROM couples_csv""",
    "geo_distances": f"WITH n AS ({_LAT}) SELECT n.n_nationkey, round({_KM}, 6) AS km, round(greatest(0.0, 1 - {_KM} / 2000), 6) AS alike FROM n JOIN n m ON m.n_nationkey = n.n_nationkey + 1",
    "prefixed_records": "SELECT 'D' || source || '-' || CAST(origin_id AS VARCHAR) AS record, source, array_to_string(list_transform(author_ids, lambda x: 'D' || source || '-' || CAST(x AS VARCHAR)), ' ') AS authors, id FROM publication_dict WHERE source IN ('A', 'B')",
    "certificate_keys": f"""
        SELECT couple_id, CAST(serial_1 AS VARCHAR) || '_' || CASE WHEN {_code('relate_1')} = '3' THEN 'bb' WHEN {_code('sex_1')} = '2' THEN 'bm' WHEN {_code('sex_1')} = '1' THEN 'bf' END AS cert,
               coalesce(CAST(serial_1 AS VARCHAR), 'None') || '-' || coalesce(CAST(pernum_1 AS VARCHAR), 'None') || '-' || coalesce(CAST(serial_2 AS VARCHAR), 'None') AS key,
               CASE WHEN {_code('relate_1')} = '3' THEN 'Bb-Bp' ELSE 'Bp-Bp' END AS link
        FROM couples_csv""",
    "pair_keys": "SELECT DISTINCT least(ltable_id, rtable_id) AS a, greatest(ltable_id, rtable_id) AS b FROM valid WHERE ltable_id IS NOT NULL AND rtable_id IS NOT NULL AND ltable_id <> rtable_id",
    "temporal_predicates": """
        WITH p AS (SELECT o_orderkey, o_orderdate AS d2, lag(o_orderdate) OVER w AS d1, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
        y AS (SELECT *, year(d1) AS y1, year(d2) AS y2, (year(d2) - year(d1)) * 12 + month(d2) - month(d1) AS m FROM p)
        SELECT o_orderkey, before, coalesce(y2 - (y1 - 13) >= 15, true) AS one_generation, coalesce(y2 - y1 >= 15, true) AS one_generation_dates, coalesce(y2 - (y1 - 29) >= 30, true) AS two_generations,
               coalesce(abs(y1 - y2) <= 2, true) AS years_close, coalesce(abs(y1 - 19 - y2) <= 20, true) AS weddings_close, coalesce(date_diff('day', CAST(d2 AS DATE), CAST(d1 AS DATE)) <= 2, true) AS is_after,
               coalesce(abs(m) >= 9, true) AS nine_apart, coalesce(-m >= -9, true) AS nine_before, CAST(coalesce(least(y1, y2), 0) AS INTEGER) AS earliest, CAST(coalesce(greatest(y1, y2), 3000) AS INTEGER) AS latest
        FROM y""",
    "sexes_agreeing": f"""
        WITH s AS (SELECT couple_id, CASE {_code('sex_1')} WHEN '1' THEN 'M' WHEN '2' THEN 'F' END AS a, CASE {_code('sex_2')} WHEN '1' THEN 'M' WHEN '2' THEN 'F' END AS b FROM couples_csv)
        SELECT couple_id, coalesce(a = b, true) AS agree, CASE WHEN coalesce(a = b, true) THEN coalesce(a, b) END AS sex FROM s""",
    "native_comparators": rf"""
        WITH n AS (SELECT DISTINCT {_plain('namefrst_1')} AS a, {_plain('namefrst_2')} AS b FROM couples_csv WHERE namefrst_1 IS NOT NULL AND namefrst_2 IS NOT NULL)
        SELECT a, b, CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0 ELSE 0.0 END::DOUBLE AS exact,
               CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0 ELSE round(1 - levenshtein(translate(a, 'éöüäáàèêëíï', '!#$%&()*+,-'), translate(b, 'éöüäáàèêëíï', '!#$%&()*+,-'))::DOUBLE / greatest(length(a), length(b)), 9) END AS editdist,
               {_qgram(2, 'average', True)} AS bigram, {_qgram(2, 'shortest', False)} AS bigram_short, {_qgram(3, 'longest', True)} AS trigram_long,
               CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0 ELSE round(1 - (greatest(length(a), length(b)) - {_bag(_grams('a', 1, False), _grams('b', 1, False))})::DOUBLE / greatest(length(a), length(b)), 9) END AS bagdist,
               array_to_string(list_sort(list_filter(string_split(a, ' '), lambda w: w <> '')), ' ') AS sorted_a
        FROM n""",
    "native_encoders": rf"""
        WITH n AS (SELECT DISTINCT regexp_replace({_plain('sname')}, '[^a-z ]', '', 'g') AS name FROM people_dict WHERE sname IS NOT NULL)
        SELECT name, CASE WHEN name = '' THEN '0000' ELSE substring(rpad(substring(name, 1, 1) || replace({_runs(f"translate(replace(substring(name, 2), ' ', ''), '{_AZ}', '{SOUNDEX_DIGITS}')")}, '0', ''), 4, '0'), 1, 4) END AS soundex,
               CASE WHEN name = '' THEN '0000' ELSE substring(rpad(substring(name, 1, 1) || {_runs(f"translate(regexp_replace(substring(name, 2), '[aeiouhwy ]', '', 'g'), '{_AZ}', '{MOD_SOUNDEX_DIGITS}')")}, 4, '0'), 1, 4) END AS mod_soundex,
               {_freq(None)} AS letters, {_freq(SOUNDEX_DIGITS)} AS by_soundex, {_freq(MOD_SOUNDEX_DIGITS)} AS by_mod_soundex, {_freq(PHONIX_DIGITS)} AS by_phonix
        FROM n""",
    "vector_distances": """
        WITH j AS (SELECT a.vec_id, list_zip(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)) AS z FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
        SELECT vec_id, round(list_sum(list_transform(z, lambda p: abs(p[1] - p[2]))), 5) AS l1, round(sqrt(list_sum(list_transform(z, lambda p: pow(p[1] - p[2], 2)))), 5) AS l2,
               round(list_max(list_transform(z, lambda p: abs(p[1] - p[2]))), 5) AS linf,
               round(list_sum(list_transform(z, lambda p: CASE WHEN abs(p[1]) + abs(p[2]) > 0 THEN abs(p[1] - p[2]) / (abs(p[1]) + abs(p[2])) ELSE 0 END)), 5) AS canberra,
               round(1 - least(1.0, list_sum(list_transform(z, lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(z, lambda p: p[1] * p[1]))) * sqrt(list_sum(list_transform(z, lambda p: p[2] * p[2]))))), 5) AS cosine
        FROM j""",
    "price_summary": "SELECT count(p_retailprice) AS n, round(avg(p_retailprice), 6) AS mean, round(stddev_pop(p_retailprice), 6) AS stddev, round(quantile_cont(p_retailprice, 0.1), 6) AS q10, round(quantile_cont(p_retailprice, 0.25), 6) AS q25, round(quantile_cont(p_retailprice, 0.5), 6) AS q50, round(quantile_cont(p_retailprice, 0.9), 6) AS q90 FROM part",
    "tag_expansions": "SELECT id, source || ' ' || t || ' ' || y AS sequence FROM publication_dict, (VALUES ('P'), ('W')) a(t), (VALUES ('new'), ('old'), ('mid')) b(y) WHERE source IS NOT NULL AND ((coalesce(year > 2000, false) AND y = 'new') OR (NOT coalesce(year > 2000, false) AND y <> 'new'))",
    "embedded_json": "SELECT event_id, CAST(len(json_keys(props)) AS INTEGER) AS keys, array_to_string(list_sort(json_keys(props)), ' ') AS names FROM events",
}
