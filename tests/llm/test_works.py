from itertools import permutations

import pytest
from pyspark.sql import functions as F

from mergekin.llm import p2_works as W

PUB = "id long, source string, origin_id long, year int, venue string, pub_name string, flat string, rec int, x int"
PEOPLE = "pub_id long, fullname string, id long, words string"
VENUES = ["International Conference on Record Archives", "Journal of Record Archives"]


def run(spark, pubs, people, **kw):
    p = spark.createDataFrame([(*r, None, 7, 7) for r in pubs], PUB)
    a = spark.createDataFrame([(*r, 1, "w") for r in people], PEOPLE)
    v = spark.createDataFrame([(x,) for x in VENUES], "venue_name string")
    return {(r.id_1, r.id_2) for r in W.matched_works(p, a, v, **kw).collect()}


def test_matches_dirty_copies_and_keeps_parts_versions_and_issues_apart(spark):
    pubs = [
        (1, "A", 10, 1998, "ICRA", "Merging censuses in truncated joins"),
        (2, "B", 10, 1998, "Int. Conf. on Record Archives", "Merging-censuses in trunctaed joins."),
        (3, "B", 10, 0, None, "MERGING CENSUSES IN TRUNCATED JOINS"),  # the same record of B once more
        (4, "A", 11, 2001, "ICRA", "Linking registers: part 1"),
        (5, "B", 12, 2002, "ICRA", "Linking registers: part 2"),
        (6, "A", 13, 1990, "ICRA", "Blocking names over parish data"),
        (7, "B", 14, 1991, "Journal of Record Archives", "Blocking names over parish data"),
        (8, "A", 15, None, None, None),
        (9, "B", 16, None, None, None),
        (2, "B", 10, 1998, "Int. Conf. on Record Archives", "Merging-censuses in trunctaed joins."),
    ]
    people = [(1, "Mary Krolt"), (2, "krolt, mary"), (3, "M Krolt"), (4, "Jo Binst"), (5, "Jo Binst"), (6, "Ann Vaur"), (7, "Ann Vaur"), (None, "x"), (8, None)]
    assert run(spark, pubs, people) == {(1, 2), (1, 3)}


def test_empty_tables(spark):
    assert run(spark, [], []) == set()
    assert run(spark, [(1, "A", 1, 1990, "ICRA", "One title of a work"), (2, "B", 1, 1990, "ICRA", "One title of a work")], []) == {(1, 2)}


def test_window_does_not_depend_on_partitions(spark, sf):
    rows = W.prepared(*(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("publication_dict", "people_dict", "venues")))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    got = []
    for n in ("1", "7", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append({tuple(r) for r in W.neighbourhood_pairs(rows).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got[0] == got[1] == got[2] and got[0]


@pytest.mark.parametrize("edges", [
    [(1, 1, 0.9), (1, 2, 0.85), (2, 1, 0.85)],
    [(1, 1, 0.9), (2, 1, 0.9), (3, 1, 0.9)],
    [(a, b, 0.5 + ((a * 7 + b * 3) % 10) / 20) for a in range(1, 6) for b in range(1, 6)],
    [],
])
def test_assignment_is_one_to_one_and_of_maximal_total(spark, edges):
    got = [tuple(r) for r in W.assign(spark.createDataFrame(edges, "a_rec long, b_rec long, confidence double"), 0.001).collect()]
    assert len({a for a, *_ in got}) == len(got) == len({b for _, b, _ in got})
    w = {(a, b): c for a, b, c in edges}
    left, right = sorted({a for a, _ in w}), sorted({b for _, b in w})
    k = max(len(left), len(right))
    best = max((sum(w.get((a, b), 0.0) for a, b in zip(left + [None] * (k - len(left)), p, strict=True)) for p in permutations(right + [None] * (k - len(right)))), default=0.0)
    assert sum(c for *_, c in got) >= best - 0.001 * (k + 1)


def test_title_likeness(spark):
    pairs = [("a b c", "a b c", 1.0), ("merging large censuses experiments", "merging large censuses foundations", None), ("", "x", -1)]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    got = [r.title for r in W.with_title_likeness(df.select(words(F.col("a")).alias("x"), words(F.col("b")).alias("y")), "x", "y").collect()]
    assert got[0] == 1.0 and got[1] < 0.6 and got[2] is None
