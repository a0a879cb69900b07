"""Queries of the builders of known links, on the census and the labelled pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergekin import standardise as S
from mergekin.operators import evaluate as V
from mergekin.operators import truth as T
from mergekin.plans.basics import _code
from mergekin.plans.linkage import _CENSUS, _CENSUS_TRUTH, _HOUSEHOLDS, _census, _sql_quality
from mergekin.plans.reports import _REACH
from mergekin.session import read, stash


def _triangles(spark: SparkSession, d: str) -> DataFrame:
    """Children with the names of their parents: id, census_year, fname, sname, mother, father, birth_year."""
    people, _ = _census(spark, d)
    people = stash(people.select("id", "census_year", "serial", "role", "fname", "sname", "bpl"), "people")
    parent = lambda role, name: people.where(F.col("role") == role).groupBy("census_year", "serial").agg(F.min("fname").alias(name))
    children = people.where("role = 'C'")
    return children.join(parent("M", "mother"), ["census_year", "serial"], "left").join(parent("F", "father"), ["census_year", "serial"], "left")


def unique_triangles(spark: SparkSession, d: str) -> DataFrame:
    """Children whose name and parents' names occur once in each census, with the same birthplace or none in both."""
    t = _triangles(spark, d)
    side = lambda y: t.where(F.col("census_year") == y).select("id", "fname", "sname", "mother", "father", "bpl")
    return T.unique_triangles(side(1870), side(1880), ["fname", "sname", "mother", "father"], ["bpl"])


def triangle_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each name of a child with its parents' names occurs in the first census."""
    return T.key_counts(_triangles(spark, d).where("census_year = 1870"), ["fname", "sname", "mother", "father"])


def parents_told(spark: SparkSession, d: str) -> DataFrame:
    """Linked children by whether their mothers are named on both sides, and their parents at all."""
    t = _triangles(spark, d)
    _, links = _census(spark, d)
    both = links.join(t.select(F.col("id").alias("a"), F.col("mother").alias("m1"), F.col("father").alias("f1"), F.col("sname").alias("s1")), "a").join(t.select(F.col("id").alias("b"), F.col("mother").alias("m2")), "b")
    return both.groupBy(T.parents_known(F.col("m1"), F.col("m2")).alias("mothers"), T.marriage_parents_known(F.col("m1"), F.lit(None).cast("string"), F.col("f1"), F.lit(None).cast("string")).alias("parents")).agg(F.count("*").alias("n"))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "couples_csv").where("couple_id is not null").dropDuplicates(["couple_id"])
    child = S.census_text("relate_1") == "3"
    adult = S.census_text("relate_2").isin("1", "2")
    s = c.select(F.col("couple_id").alias("person"), F.when(child, F.concat(F.lit("b"), "couple_id")).alias("birth"), F.when(adult, F.concat(F.lit("m"), "serial_2")).alias("marriage"), F.concat(F.lit("c"), "serial_1").alias("census"))
    return T.life_segments(s, {"birth": "Bb", "marriage": "Mm", "census": "Cc"})


def life_certificates(spark: SparkSession, d: str) -> DataFrame:
    """Certificates of each person of the census by role: how many, and of how many people."""
    return _segments(spark, d).groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("record").alias("records"), F.count_distinct("person").alias("people"))


def life_links(spark: SparkSession, d: str) -> DataFrame:
    """Links between the certificates of one life."""
    return T.segment_links(_segments(spark, d), ["Bb", "Mm", "Cc"])


def sibling_parents(spark: SparkSession, d: str) -> DataFrame:
    """Parents on the birth certificates of siblings, led back to one record each."""
    c = read(spark, d, "couples_csv").where("couple_id is not null and serial_1 is not null").dropDuplicates(["couple_id"]).where(S.census_text("relate_1") == "3")
    each = F.explode(F.array(F.lit("mother"), F.lit("father"))).alias("relation")
    children = c.select(F.col("serial_1").alias("sibset"), "couple_id", each).select("sibset", "relation", F.concat(F.lit("b"), "couple_id", F.lit("_"), "relation").alias("parent"))
    return T.sibling_parents(children)


def truth_union(spark: SparkSession, d: str) -> DataFrame:
    """Matches labelled early and late, put together."""
    v = read(spark, d, "valid").where("label = 1")
    pair = lambda c: v.where(c).select(F.lit("P-P").alias("link"), (F.col("ltable_id") * 2).alias("a"), (F.col("rtable_id") * 2 + 1).alias("b"))
    return T.union_of(pair("month(decided_at) <= 6"), pair("month(decided_at) > 6"), pair("decided_at is null"))


def truth_entities(spark: SparkSession, d: str) -> DataFrame:
    """Groups that the labelled matches form, with their records."""
    return T.entities_from(truth_union(spark, d))


def initial_quality(spark: SparkSession, d: str) -> DataFrame:
    """The measures on the candidate pairs of the censuses, before any linking."""
    from mergekin.plans.linkage import household_pairs

    people, links = _census(spark, d)
    role = people.select(F.col("id").alias("a"), "role")
    truth = links.join(role, "a").where("role is not null").select(F.concat_ws("-", "role", "role").alias("link"), "a", "b")
    found = household_pairs(spark, d).select(F.concat_ws("-", "role", "role").alias("link"), F.col("r1").alias("a"), F.col("r2").alias("b"))
    return V.quality(found, truth)


def nodes_by_link(spark: SparkSession, d: str) -> DataFrame:
    """Candidate pairs of the censuses by link, with the records they hold."""
    from mergekin.plans.linkage import household_pairs

    n = household_pairs(spark, d)
    return n.groupBy(F.concat_ws("-", "role", "role").alias("link")).agg(F.count("*").alias("nodes"), F.count_distinct("r1").alias("left_records"), F.count_distinct("r2").alias("right_records"))


QUERIES = {
    "unique_triangles": unique_triangles, "triangle_counts": triangle_counts, "parents_told": parents_told, "life_certificates": life_certificates, "life_links": life_links, "sibling_parents": sibling_parents,
    "truth_union": truth_union, "truth_entities": truth_entities, "initial_quality": initial_quality, "nodes_by_link": nodes_by_link,
}

_TRIANGLES = f"""
    {_CENSUS}, par AS (SELECT census_year, serial, min(fname) FILTER (role = 'M') AS mother, min(fname) FILTER (role = 'F') AS father FROM people GROUP BY census_year, serial),
    tri AS (SELECT p.id, p.census_year, p.fname, p.sname, p.bpl, mother, father FROM people p LEFT JOIN par USING (census_year, serial) WHERE p.role = 'C')"""
_LIFE = f"""
    c AS (SELECT DISTINCT couple_id, {_code('relate_1')} AS r1, {_code('relate_2')} AS r2, serial_1, serial_2 FROM couples_csv WHERE couple_id IS NOT NULL),
    s AS (SELECT couple_id AS person, 'Bb' AS role, 'b' || couple_id AS record FROM c WHERE r1 = '3' UNION SELECT couple_id, 'Mm', 'm' || serial_2 FROM c WHERE r2 IN ('1', '2') AND serial_2 IS NOT NULL
          UNION SELECT couple_id, 'Cc', 'c' || serial_1 FROM c WHERE serial_1 IS NOT NULL)"""
SQL = {
    "unique_triangles": f"""
        WITH {_TRIANGLES}, u AS (SELECT *, count(*) OVER (PARTITION BY census_year, fname, sname, mother, father) AS c FROM tri WHERE fname IS NOT NULL AND sname IS NOT NULL AND mother IS NOT NULL AND father IS NOT NULL)
        SELECT x.id AS a, y.id AS b FROM u x JOIN u y ON x.census_year = 1870 AND y.census_year = 1880 AND x.c = 1 AND y.c = 1 AND x.fname = y.fname AND x.sname = y.sname AND x.mother = y.mother AND x.father = y.father AND x.bpl IS NOT DISTINCT FROM y.bpl""",
    "triangle_counts": f"WITH {_TRIANGLES} SELECT fname, sname, mother, father, count(*) AS n FROM tri WHERE census_year = 1870 AND fname IS NOT NULL AND sname IS NOT NULL AND mother IS NOT NULL AND father IS NOT NULL GROUP BY ALL",
    "initial_quality": f"WITH {_CENSUS}, {_HOUSEHOLDS}, {_CENSUS_TRUTH}, found AS (SELECT role || '-' || role AS link, r1 AS a, r2 AS b FROM hp), {_sql_quality('found')}",
    "nodes_by_link": f"WITH {_CENSUS}, {_HOUSEHOLDS} SELECT role || '-' || role AS link, count(*) AS nodes, count(DISTINCT r1) AS left_records, count(DISTINCT r2) AS right_records FROM hp GROUP BY 1",
    "parents_told": f"""
        WITH {_TRIANGLES}, {_CENSUS_TRUTH} SELECT x.mother IS NOT NULL AND y.mother IS NOT NULL AS mothers, x.mother IS NOT NULL AND x.father IS NOT NULL AS parents, count(*) AS n
        FROM lk JOIN tri x ON x.id = lk.a JOIN tri y ON y.id = lk.b GROUP BY 1, 2""",
    "life_certificates": f"WITH {_LIFE} SELECT role, count(*) AS n, count(DISTINCT record) AS records, count(DISTINCT person) AS people FROM s GROUP BY role",
    "life_links": f"WITH {_LIFE} SELECT DISTINCT x.role || '-' || y.role AS link, x.record AS a, y.record AS b FROM s x JOIN s y ON x.person = y.person AND ((x.role = 'Bb' AND y.role IN ('Mm', 'Cc')) OR (x.role = 'Mm' AND y.role = 'Cc'))",
    "sibling_parents": f"""
        WITH c AS (SELECT DISTINCT couple_id, serial_1 FROM couples_csv WHERE couple_id IS NOT NULL AND serial_1 IS NOT NULL AND {_code('relate_1')} = '3'),
        p AS (SELECT serial_1, 'b' || couple_id || '_' || rel AS record, rel FROM c, (SELECT unnest(['mother', 'father']) AS rel))
        SELECT record, min(record) OVER (PARTITION BY serial_1, rel) AS parent FROM p""",
    "truth_union": "SELECT DISTINCT 'P-P' AS link, least(2 * ltable_id, 2 * rtable_id + 1) AS a, greatest(2 * ltable_id, 2 * rtable_id + 1) AS b FROM valid WHERE label = 1 AND ltable_id IS NOT NULL AND rtable_id IS NOT NULL",
    "truth_entities": f"WITH RECURSIVE {_REACH} SELECT entity, record FROM m",
}
