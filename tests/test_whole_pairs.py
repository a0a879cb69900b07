import random
import time

from pyspark.sql import functions as F

from mergekin.functions.compare import sort_winkler
from mergekin.plans import bibliography as B


def _tables(spark, path, pubs, people):
    spark.createDataFrame(pubs, "id long, source string, origin_id long, pub_name string, venue string, year int").write.parquet(f"{path}/publication_dict.parquet")
    spark.createDataFrame(people, "id long, pub_id long, author_no int, fname string, sname string").write.parquet(f"{path}/people_dict.parquet")


def _pairs(spark, path):
    return {(r.r1, r.r2): r.score for r in B.rule_publication_pairs(spark, str(path)).collect()}


def test_titles_alone_make_a_pair(spark, tmp_path):
    pubs = [(1, "A", 1, "Book Notes", "Annals", 1950), (2, "B", 1, "Book Notes", "Annals", 1990), (3, "B", 2, "Book Notes", None, None), (4, "B", 3, "On Graphs", "Annals", 1950)]
    _tables(spark, tmp_path, pubs, [(1, 1, 1, "mary", "arlen"), (2, 2, 1, "jan", "berg")])
    assert _pairs(spark, tmp_path) == {(2, 3): 0.8, (2, 5): 0.7}


def test_title_and_year_of_different_deliveries(spark, tmp_path):
    pubs = [(1, "A", 1, "Book Notes", None, None), (2, "A", 1, None, None, 1950), (3, "B", 1, "Book Notes", None, 1951), (4, "B", 1, "Book Notes", None, 1970)]
    _tables(spark, tmp_path, pubs, [(1, 1, 1, "mary", "arlen")])
    assert _pairs(spark, tmp_path) == {(2, 3): 0.97}
    b = B.load(spark, str(tmp_path))
    nodes, evidence = B.publication_nodes(b, B.atomic(b))  # linking has them, too
    assert [tuple(x) for x in nodes.selectExpr("r1", "r2", "round(sim, 6)").collect()] == [(2, 3, 0.97)]
    assert {(x.attr, round(x.sim, 6)) for x in evidence.collect()} == {("pub_name", 1.0), ("year", 0.9)}


def test_all_pairs_of_alike_titles(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "ONE_PART", 7)
    r = random.Random(3)
    titles, venues, years = ["Book Notes", "Book Notse", "Joins of joins", "Joins of join", "On Graphs", None], ["Annals", "Annalls", "Letters", None], [1950, 1951, 1953, 1990, 0, None]
    pubs = [(k, r.choice("AB"), r.randrange(60), r.choice(titles), r.choice(venues), r.choice(years)) for k in range(200)]
    _tables(spark, tmp_path, pubs, [(1, 1, 1, "mary", "arlen")])
    held = {}
    for _, source, number, *values in pubs:
        of = held.setdefault((source, number), ({}, {}, {}))
        for k, v in enumerate(values):
            if v:
                of[k][v.lower() if k < 2 else v] = 1
    best = lambda x, y, f, least: max((s for p in x for q in y if (s := f(p, q)) >= least), default=None)
    want = {}
    for (s1, n1), (t1, v1, y1) in held.items():
        for (s2, n2), (t2, v2, y2) in held.items():
            if (s1, s2) == ("A", "B") and (t := best(t1, t2, sort_winkler, 0.9)) is not None:
                year, venue = best(y1, y2, lambda p, q: 1 - min(abs(p - q), 10) / 10, 0.8) or 0.0, best(v1, v2, sort_winkler, 0.8)
                want[2 * n1, 2 * n2 + 1] = round(0.7 * t + 0.3 * year if venue is None else 0.6 * t + 0.2 * year + 0.2 * venue, 6)
    assert _pairs(spark, tmp_path) == want and len(want) > 300 and min(want.values()) < 0.7


def test_a_title_of_very_many_records_pairs_them_all(spark, tmp_path):
    source = F.when(F.col("id") % 2 == 0, "A").otherwise("B")
    spark.range(4000).select("id", source.alias("source"), F.col("id").alias("origin_id"), F.lit("Book Notes").alias("pub_name"), F.lit("v").alias("venue"), (1900 + F.col("id") % 100).cast("int").alias("year")).write.parquet(f"{tmp_path}/publication_dict.parquet")
    spark.createDataFrame([(1, 1, 1, "mary", "arlen")], "id long, pub_id long, author_no int, fname string, sname string").write.parquet(f"{tmp_path}/people_dict.parquet")
    began = time.time()
    got = B.rule_publication_pairs(spark, str(tmp_path)).agg(F.count("*").alias("n"), F.countDistinct("r1", "r2").alias("d"), F.min("score").alias("least")).first()
    assert tuple(got) == (2000 * 2000, 2000 * 2000, 0.8) and time.time() - began < 60
