import pytest
from pyspark.sql import functions as F

from mergekin.functions import columns as C
from mergekin.operators import evaluate as V
from mergekin.operators import evidence as E
from mergekin.operators import graphs as G
from mergekin.operators import truth as T


def test_unique_triangles(spark):
    schema = "id string, f string, m string, place string"
    left = spark.createDataFrame([("a", "jo", "ann", "x"), ("b", "jo", "bet", None), ("c", "al", "ann", "x"), ("d", "al", "ann", "x"), ("e", None, "z", "x"), ("g", "ed", "fay", "x")], schema)
    right = spark.createDataFrame([("p", "jo", "ann", "x"), ("q", "jo", "bet", None), ("r", "al", "ann", "x"), ("s", "ed", "fay", None)], schema)
    assert {tuple(r) for r in T.unique_triangles(left, right, ["f", "m"], ["place"]).collect()} == {("a", "p"), ("b", "q")}
    assert {tuple(r) for r in T.unique_triangles(left, right, ["f", "m"]).collect()} == {("a", "p"), ("b", "q"), ("g", "s")}
    assert {(r.f, r.m, r.n) for r in T.key_counts(left, ["f", "m"]).collect()} == {("jo", "ann", 1), ("jo", "bet", 1), ("al", "ann", 2), ("ed", "fay", 1)}


def test_life_segments_and_siblings(spark):
    s = spark.createDataFrame([(1, "b1", "d1", "m1", "m2"), (2, "b2", None, None, None), (2, "b2", None, None, None)], "person long, birth string, death string, w1 string, w2 string")
    c = T.life_segments(s, {"birth": "Bb", "w1": "Mm", "w2": "Mm", "death": "Dd"})
    assert c.count() == 5
    assert {tuple(r) for r in T.segment_links(c, ["Bb", "Mm", "Dd"]).collect()} == {("Bb-Mm", "b1", "m1"), ("Bb-Mm", "b1", "m2"), ("Bb-Dd", "b1", "d1"), ("Mm-Mm", "m1", "m2"), ("Mm-Dd", "m1", "d1"), ("Mm-Dd", "m2", "d1")}
    kids = spark.createDataFrame([(1, "mother", "x1"), (1, "mother", "x2"), (1, "father", "y1"), (2, "mother", "x2"), (2, "mother", "x3")], "sibset long, relation string, parent string")
    assert {tuple(r) for r in T.sibling_parents(kids).collect()} == {("x1", "x1"), ("x2", "x1"), ("x3", "x1"), ("y1", "y1")}


def test_union_and_entities(spark):
    one = spark.createDataFrame([("L", 1, 2), ("L", 2, 1), ("L", 3, 3), ("L", None, 4)], "link string, a long, b long")
    two = spark.createDataFrame([("L", 1, 2), ("M", 2, 5)], "link string, a long, b long")
    all_ = T.union_of(one, two)
    assert {tuple(r) for r in all_.collect()} == {("L", 1, 2), ("M", 2, 5)}
    assert {tuple(r) for r in T.entities_from(all_).collect()} == {(1, 1), (1, 2), (1, 5)}


def test_availability(spark):
    df = spark.createDataFrame([("a", None, None, "d"), ("a", "b", None, None), (None, None, None, None)], "a string, b string, c string, d string")
    got = df.select(T.parents_known(F.col("a"), F.col("b")), T.marriage_parents_known(*[F.col(c) for c in "abcd"])).collect()
    assert [tuple(r) for r in got] == [(False, True), (True, False), (False, False)]


def test_phrases_meet_where_all_words_but_one_sound_alike(spark):
    titles = ["merging large censuses of parishes", "merging of large censuses parishs", "merging large censuses and parishes", "linking small registers", "linking", "a b", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "id long, t string")
    got = {(r.v1, r.v2) for r in E.alike_phrases(df, None, "t", "t", 0.6).collect() if r.v1 != r.v2}
    assert len(got) == 3 and all("censuses" in a and "censuses" in b for a, b in got), got


def test_evidence_of_records_with_several_values(spark):
    left = spark.createDataFrame([(1, "jon"), (1, "john"), (2, "x")], "id long, f string")
    right = spark.createDataFrame([(7, "johnny"), (8, "x")], "id long, f string")
    atomic = spark.createDataFrame([("f", "john", "johnny", 0.9), ("f", "jon", "johnny", 0.7), ("f", "x", "x", 1.0)], "attr string, v1 string, v2 string, sim double")
    pairs = spark.createDataFrame([(1, 7), (2, 7)], "r1 long, r2 long")
    ev = E.evidence_of(pairs, left, right, atomic, ["f"])
    assert [tuple(r) for r in ev.collect()] == [(1, 7, "f", 0.9)]
    assert [tuple(r) for r in E.addable_pairs(ev).collect()] == [(1, 7)]


def test_list_average(spark):
    df = spark.createDataFrame([(["ab", "x"], ["ab", "cd"]), ([], ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(E.list_average(F.col("a"), F.col("b"), C.exact)).collect()] == [1.0, 0.0]


def test_bootstrap_and_what_it_leaves(spark):
    n = spark.createDataFrame([(1, 1, 11, "P-P", 1.0), (1, -1, -11, "A-A", 0.95), (2, 1, 12, "P-P", 0.96), (2, -1, -12, "A-A", 0.9), (3, 2, 13, "P-P", 1.0), (4, 3, 14, "P-P", 1.0), (4, -3, -14, "A-A", 0.7)], "group_id long, r1 long, r2 long, link string, sim double")
    assert {r.group_id for r in G.bootstrap_groups(n, 0.95).collect()} == {1}
    assert {r.group_id for r in G.without_used(n, n.where("group_id = 1"), ("P-P",)).collect()} == {3, 4}


def test_dependency_goes_on_to_the_end(spark):
    nodes = spark.createDataFrame([(i, 1.0 if i == 0 else 0.9) for i in range(70)], "node long, sim_attr double")
    edges = spark.createDataFrame([(i, i + 1, True) for i in range(69)], "src long, dst long, strong boolean")
    assert G.dependency_linkage(nodes, edges, 0.9).where("merged").count() == 70


@pytest.mark.parametrize(("arity", "size", "want"), [(4, 4, 1), (4, 3, 2), (3, 3, 3), (3, 2, 4), (2, 2, 5), (2, 1, None), (1, 1, None)])
def test_priorities_of_the_first_merge(spark, arity, size, want):
    assert spark.range(1).select(V.bootstrap_priority(F.lit(arity), F.lit(size))).first()[0] == want
