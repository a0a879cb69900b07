import random

import pytest

from mergekin.llm.p1_groups import connected_groups, match_groups


def brute(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            parent[find(a)] = find(b)
    sets = {}
    for x in list(parent):
        sets.setdefault(find(x), set()).add(x)
    return {frozenset(s) for s in sets.values()}


def groups(df):
    sets = {}
    for r in df.collect():
        assert r.label is not None
        sets.setdefault(r.label, set()).add(r.v)
    return {frozenset(s) for s in sets.values()}


CASES = {
    "chain": [(i, i + 1) for i in range(40)],
    "cycle": [(i, (i + 1) % 17) for i in range(17)],
    "two cycles and a bridge": [(0, 1), (1, 2), (2, 0), (10, 11), (11, 12), (12, 10), (2, 3), (3, 4), (4, 10)],
    "star with tails": [(0, i) for i in range(1, 30)] + [(i, 100 + i) for i in range(1, 30)],
    "clique": [(i, j) for i in range(7) for j in range(i)],
    "nulls, loops, repeats": [(1, 2), (2, 1), (1, 2), (3, 3), (None, 4), (5, None), (None, None), (-7, 2)],
    "theta": [(0, 1), (1, 2), (2, 9), (0, 3), (3, 4), (4, 9), (0, 5), (5, 9)],
}


@pytest.mark.parametrize("name", CASES)
def test_shapes(spark, name):
    df = spark.createDataFrame(CASES[name], "a long, b long")
    assert groups(connected_groups(df)) == brute(CASES[name])


def test_random_graph_with_clashing_columns(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(200 + i, 200 + i // 3) for i in range(1, 60)]
    df = spark.createDataFrame([(a, b, 1, "x", 2.0) for a, b in pairs], "a long, b long, deg int, label string, v double")
    assert groups(connected_groups(df)) == brute(pairs)


def test_empty(spark):
    assert connected_groups(spark.createDataFrame([], "a long, b long")).count() == 0
    assert match_groups(spark.createDataFrame([], "ltable_id long, rtable_id long, label int")).count() == 0


def test_sides_are_apart_and_the_smallest_left_id_names_the_group(spark):
    rows = [(5, 1, 1), (5, 1, 0), (2, 1, 1), (1, 5, 1), (9, 9, 0), (None, 3, 1), (4, None, 1), (8, 8, None)]
    got = {(r.side, r.record_id): r.group_id for r in match_groups(spark.createDataFrame(rows, "ltable_id long, rtable_id long, label int")).collect()}
    assert got == {("l", 5): 2, ("l", 2): 2, ("r", 1): 2, ("l", 1): 1, ("r", 5): 1}
