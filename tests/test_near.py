import random
import time

import numpy as np
from pyspark.sql import functions as F

from mergekin.functions.maths import hash_longs
from mergekin.operators import graphs as G
from mergekin.plans import linkage as L


def test_near_matching_is_the_sequential_one(spark):
    r = random.Random(7)
    side = lambda at: [(at + k * 2, r.choice(["x", "y", "z", None]), r.choice([1990, 1991, 1992, 1993, 1996, None])) for k in r.sample(range(200), 90)]
    a, b = side(0), side(1)
    left, right = (spark.createDataFrame(rows, "id long, title string, year int") for rows in (a, b))
    pairs = sorted((abs(p[2] - q[2]), p[0], q[0]) for p in a for q in b if p[1] and p[1] == q[1] and p[2] and q[2] and abs(p[2] - q[2]) <= 2)
    used, want = set(), set()
    for gap, p, q in pairs:
        if p not in used and q not in used:
            used |= {p, q}
            want.add((p, q, gap))
    assert {tuple(x) for x in G.one_to_one_near(left, right, "title", "year", 2).collect()} == want and len(want) > 20


def test_a_title_of_very_many_records(spark, tmp_path):
    source = F.when(F.col("id") % 2 == 0, "A").otherwise("B")
    spark.range(40000).select("id", source.alias("source"), F.col("id").alias("origin_id"), F.lit("Book Notes").alias("pub_name"), F.lit("v").alias("venue"), F.lit(1990).alias("year")).write.parquet(f"{tmp_path}/publication_dict.parquet")
    began = time.time()
    got = {tuple(x) for x in L.matched_publications(spark, str(tmp_path)).collect()}
    assert got == {(k, k + 1, 1.0) for k in range(0, 40000, 2)} and time.time() - began < 60  # 400 million pairs


def test_hash_of_longs_is_sparks(spark):
    rows = [(1, 2), (-5, 7), (0, 0), (2**62, -(2**63)), (123456789, -1)]
    want = [x.h for x in spark.createDataFrame(rows, "a long, b long").select(F.xxhash64("a", "b").alias("h")).collect()]
    assert hash_longs(np.array([a for a, _ in rows]), np.array([b for _, b in rows])).tolist() == want


def _works(spark, path, n, titles, names, years):
    r = random.Random(11)
    pubs = [(k, r.choice("AB"), k, r.choice(titles), "v", r.choice(years)) for k in range(n)]
    people = [(10 * k + i, s, k, r.choice(names), r.choice(["Arlen", "Berg"]), y) for k, s, _, _, _, y in pubs for i in range(r.choice([0, 0, 1, 2]))]
    spark.createDataFrame(pubs, "id long, source string, origin_id long, pub_name string, venue string, year int").write.parquet(f"{path}/publication_dict.parquet")
    spark.createDataFrame(people, "id long, source string, pub_id long, fname string, sname string, year int").write.parquet(f"{path}/people_dict.parquet")


def test_linked_without_pairs_is_linked_with_all(spark, tmp_path):
    _works(spark, tmp_path, 240, ["Book Notes", "On Graphs", "A Letter", None], ["Mary", "M", "Mark", "Jan", "J", None], [1990, 1991, 1992, 1993, 1996, None, 0])
    got = {tuple(x) for x in L.linked_bibliography(spark, str(tmp_path)).collect()}
    want = G.greedy_groups(L._bib_nodes(spark, str(tmp_path)), 0.85, 0.9, ("P-P",)).select("group_id", "r1", "r2", "link", F.round("sim", 6), "entity")
    assert got == {tuple(x) for x in want.collect()} and len({x[5] for x in got}) > 30


def test_linked_titles_of_very_many_records(spark, tmp_path):
    source = F.when(F.col("id") % 2 == 0, "A").otherwise("B")
    year = (1980 + F.floor(F.col("id") / 2) % 20).cast("int").alias("year")
    spark.range(30000).select("id", source.alias("source"), F.col("id").alias("origin_id"), F.lit("Book Notes").alias("pub_name"), F.lit("v").alias("venue"), year).write.parquet(f"{tmp_path}/publication_dict.parquet")
    people = spark.range(30000).select("id", source.alias("source"), F.col("id").alias("pub_id"), F.lit("jan").alias("fname"), F.concat(F.lit("s"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("sname"), year)
    people.write.parquet(f"{tmp_path}/people_dict.parquet")
    began = time.time()
    got = L.linked_bibliography(spark, str(tmp_path)).collect()
    assert len(got) == 15000 == len({x.r1 for x in got}) and {x.sim for x in got} == {1.0} and time.time() - began < 60  # 53 million pairs


def test_single_pairs_of_one_title_and_year_in_time(spark):
    n = spark.range(120).select(F.col("id").alias("r1")).crossJoin(spark.range(120).select((F.col("id") + 1000).alias("r2")))
    none = F.lit(None).cast("long")
    n = n.select(F.xxhash64("r1", "r2").alias("group_id"), "r1", "r2", F.lit("P-P").alias("link"), (0.9 + (F.col("r1") + F.col("r2")) % 3 / 100).alias("sim"), none.alias("year1"), none.alias("year2"))
    n = n.unionByName(n.where("r1 % 7 = 0 and r2 % 7 = 6").select("group_id", (-F.col("r1") - 1).alias("r1"), (-F.col("r2")).alias("r2"), F.lit("A-A").alias("link"), F.lit(1.0).alias("sim"), "year1", "year2"))
    want = G.link_component(n.toPandas(), 0.85, 0.9, {"P-P"}, None, True)
    began = time.time()
    got = G.greedy_groups(n, 0.85, 0.9, ("P-P",), task_rows=1000).collect()  # in rounds it would take nearly as many as records
    assert {(x.group_id, x.r1, x.r2, x.link, x.sim, x.entity) for x in got} == set(want.itertuples(index=False, name=None)) and len(want) > 120
    assert time.time() - began < 90
