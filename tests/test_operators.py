import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from mergekin import predicates as P
from mergekin import standardise as S
from mergekin.config import rule, rules
from mergekin.operators import evidence as E
from mergekin.operators import graphs as G
from mergekin.operators import names as N
from mergekin.operators.evaluate import quality


def test_standard_values(spark):
    df = spark.createDataFrame([("A.B-c",), (" x   y ",), ("NG",), ("ng",), ("Anonymous",), ("",), (None,), ("N/E",), ("n/e",)], "s string")
    assert [r[0] for r in df.select(S.standard_string("s")).collect()] == ["a b c", "x y", "ng", None, None, None, None, None, None]
    df = spark.createDataFrame([("12",), ("3:05",), ("7.9",), ("junk",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(S.standard_number("s")).collect()] == [12, 185, 7, 0, None, None]
    df = spark.createDataFrame([("ann",), ("ann lee",), ("ann b lee",), ("ann b lee jones",), ("",), (None,)], "s string")
    assert [tuple(r[0]) for r in df.select(S.split_name("s")).collect()] == [("ann", None, "ann"), ("ann", None, "lee"), ("ann", "b", "lee"), ("ann", "b", "lee"), (None, None, None), (None, None, None)]
    df = spark.createDataFrame([("3/4/1880",), ("None/1/2/1890",), ("1877",), ("3/4/1880 10:20",), ("31/4/1905",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(S.parse_date("s").cast("date")).collect()] == [date(1880, 4, 3), date(1890, 2, 1), date(1877, 1, 1), date(1880, 4, 3), date(1905, 4, 30), None, None]


def test_unknown_satisfies(spark):
    df = spark.createDataFrame([(1850, 1870), (1850, 1851), (0, 1851), (None, 5)], "a int, b int")
    got = df.select(P.one_generation(F.col("a"), F.col("b")), P.years_close(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, True), (True, True), (True, True)]
    df = spark.createDataFrame([("F", "M"), ("F", ""), (None, "M"), ("F", "F")], "a string, b string")
    assert [r[0] for r in df.select(P.sexes_agree(F.col("a"), F.col("b"))).collect()] == [False, True, True, True]


def test_all_rules_are_there():
    assert len(rules()) == 24 and rules(0.8)["def_pubs"].core.min_sim == pytest.approx(0.7)


def test_acceptance_and_weights(spark):
    r = rule("r", "a b", "c", "d", (1, 1, 0))
    ev = spark.createDataFrame([(1, 2, "a", 1.0), (1, 2, "b", 0.5), (1, 2, "c", 0.95), (1, 3, "a", 1.0), (1, 4, "a", 0.9), (1, 4, "c", 0.9), (1, 4, "d", 0.8), (1, 4, "zz", 1.0)], "r1 long, r2 long, attr string, sim double")
    assert {(x.r1, x.r2) for x in E.accepted_pairs(ev, r).collect()} == {(1, 2), (1, 4)}
    w = {x.r2: x.sim_attr for x in E.weighted_scores(ev, r).collect()}
    assert w[2] == pytest.approx(0.3 * 0.95 + 0.7 * 0.5)
    assert w[4] == pytest.approx(0.2 * 0.9 + 0.6 * 0.45 + 0.2 * 0.8)
    assert w[3] == pytest.approx(0.7 * 0.5)
    only = rule("o", "a", "", "")
    assert E.weighted_scores(ev.where("attr = 'a' and r2 = 3"), only).first().sim_attr == pytest.approx(1.0)
    with pytest.raises(ValueError):
        E.weighted_scores(ev, rule("none"))


def test_values_pairs_and_ambiguity(spark):
    left = spark.createDataFrame([(1, "john smith"), (2, "mary"), (3, None)], "id long, fname string")
    right = spark.createDataFrame([(4, "smith jon"), (5, "mary"), (6, "zeta")], "id long, fname string")
    atomic = E.alike_values(left, right, "fname", "fname", 0.8)
    assert {(r.v1, r.v2) for r in atomic.collect()} == {("john smith", "smith jon"), ("mary", "mary")}
    pairs = E.pair_evidence(left, right, atomic, ["fname"])
    assert {(r.r1, r.r2) for r in pairs.collect()} == {(1, 4), (2, 5)}
    f = spark.createDataFrame([(1, 1, 100), (1, 0, 1), (0, 0, 9)], "a long, b long, n long").select(E.ambiguity(F.col("a"), F.col("b"), F.col("n")))
    got = [r[0] for r in f.collect()]
    assert got[0] == pytest.approx(1 - 0.30103 / 2, abs=1e-4) and got[1] is None and got[2] is None
    combos = N.combined_frequency(spark.createDataFrame([("smith", "jon"), ("smyth", "jon"), ("smith", "jon"), ("smith", None)], "s string, f string"), ["s", "f"])
    near = N.variations(combos.where("f is not null"), ["s", "f"], 0.8)
    got = {r.key: r.freq for r in N.clustered_frequency(combos, near).collect()}
    assert got == {"smith-jon": 3, "smyth-jon": 3, "smith-None": 1}


def brute_components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {v: find(v) for v in parent}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.v: r.component for r in G.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == brute_components(edges)
    assert G.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_one_to_one_equals_the_sequential_greedy(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(25), rng.randrange(25), rng.randrange(10) / 10) for _ in range(150)]
    best = {}
    for a, b, s in pairs:
        best[a, b] = max(s, best.get((a, b), 0))
    want, used_a, used_b = set(), set(), set()
    for (a, b), s in sorted(best.items(), key=lambda x: (-x[1], x[0])):
        if a not in used_a and b not in used_b:
            want.add((a, b))
            used_a.add(a)
            used_b.add(b)
    got = {(r.r1, r.r2) for r in G.one_to_one(spark.createDataFrame(pairs, "r1 long, r2 long, sim double")).collect()}
    assert got == want


def test_trimming_and_linking(spark):
    nodes = spark.createDataFrame([(1, 1, 11, "P", 1.0), (1, 2, 12, "P", 0.9), (1, 3, 13, "P", 0.2), (2, 1, 14, "P", 0.99), (3, 5, 15, "P", 0.95), (4, 6, 16, "P", 0.5)], "group_id long, r1 long, r2 long, link string, sim double")
    kept = {(r.r1, r.r2) for r in G.trimmed_groups(nodes, 0.9).collect()}
    assert kept == {(1, 11), (2, 12)}
    full = nodes.withColumn("year1", F.lit(None).cast("long")).withColumn("year2", F.lit(None).cast("long"))
    merged = {(r.r1, r.r2) for r in G.greedy_groups(full, 0.85, 0.9, ("P",)).collect()}
    assert merged == {(1, 11), (2, 12), (5, 15)}


def test_a_component_larger_than_a_task_is_linked_alike(spark):
    rng = random.Random(8)
    rows = []
    for g in range(120):
        for k in range(rng.randint(1, 4)):
            rows.append((g, rng.randrange(60), 1000 + rng.randrange(60), "P" if k == 0 else rng.choice("PA"), rng.randrange(70, 101) / 100, None, None))
    rows = [*{(r[0], r[1], r[2]): r for r in rows}.values()]
    df = spark.createDataFrame(rows, "group_id long, r1 long, r2 long, link string, sim double, year1 long, year2 long")
    whole = {tuple(r) for r in G.greedy_groups(df, 0.85, 0.9, ("P",)).collect()}
    assert whole and {tuple(r) for r in G.greedy_groups(df, 0.85, 0.9, ("P",), task_rows=40).collect()} == whole
    with pytest.raises(ValueError):
        G.greedy_groups(df, 0.85, 0.9, ("P",), year_gap=2, task_rows=40)


def test_bridges_and_density(spark):
    tri = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (5, 6), (4, 6)]
    assert G.bridges_of(tri) == {(3, 4)}
    df = spark.createDataFrame([("e", a, b) for a, b in tri], "entity string, r1 long, r2 long")
    assert {(r.r1, r.r2) for r in G.without_bridges(df, 5).collect()} == set(tri) - {(3, 4)}
    assert G.without_bridges(df, 50).count() == 7
    star = spark.createDataFrame([("s", 0, i) for i in range(1, 9)] + [("p", 1, 2), ("p", 2, 3), ("p", 3, 4), ("p", 4, 5), ("p", 5, 6), ("p", 6, 7), ("p", 7, 1), ("p", 7, 8)], "entity string, r1 long, r2 long")
    assert {(r.entity, r.record) for r in G.sparse_members(star).collect()} == {("p", 8)}


def test_dependency_linkage(spark):
    nodes = spark.createDataFrame([("a", 1.0), ("b", 0.9), ("c", 0.85), ("d", 0.1)], "node string, sim_attr double")
    edges = spark.createDataFrame([("a", "b", True), ("b", "c", True), ("c", "d", False)], "src string, dst string, strong boolean")
    got = {r.node: r.merged for r in G.dependency_linkage(nodes, edges, 0.86).collect()}
    assert got == {"a": True, "b": True, "c": True, "d": False}


def test_propagation(spark):
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "record long, entity long")
    values = spark.createDataFrame([(1, "f", "jon"), (2, "f", "john"), (3, "f", "johnny")], "record long, attr string, v string")
    atomic = spark.createDataFrame([("f", "john", "johnny", 0.9), ("f", "jon", "johnny", 0.7)], "attr string, v1 string, v2 string, sim double")
    got = G.value_propagation(members, values, spark.createDataFrame([(1, 3)], "r1 long, r2 long"), atomic).collect()
    assert [(r.r1, r.r2, r.sim) for r in got] == [(1, 3, 0.9)]


def test_quality(spark):
    found = spark.createDataFrame([("L", 1, 2), ("L", 2, 1), ("L", 3, 4)], "link string, a long, b long")
    truth = spark.createDataFrame([("L", 2, 1), ("L", 5, 6), ("M", 7, 8)], "link string, a long, b long")
    got = {r.link: (r.tp, r.fp, r.fn, r.precision, r.recall, r.f_star) for r in quality(found, truth).collect()}
    assert got == {"L": (1, 1, 1, 50.0, 50.0, 33.33), "M": (0, 0, 1, 0.0, 0.0, 0.0)}
