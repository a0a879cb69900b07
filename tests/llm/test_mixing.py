import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mergekin.llm import p7_mixing as M

shares = st.lists(st.floats(0, 1), min_size=1, max_size=6)


@settings(max_examples=200, deadline=None)
@given(shares, st.lists(st.integers(0, 1000), min_size=6, max_size=6), st.floats(0, 5000))
def test_water_filling(weights, ceilings, total):
    t = {f"s{i}": w for i, w in enumerate(weights)}
    c = {f"s{i}": ceilings[i] for i in range(len(weights))}
    size = M.water_fill(t, c, total)
    usable = sum(c[s] for s in t if t[s] > 0)
    assert all(-1e-9 <= size[s] <= c[s] + 1e-6 for s in t)
    assert sum(size.values()) == pytest.approx(min(total, usable), rel=1e-6, abs=1e-6)
    free = [s for s in t if 1e-6 < size[s] < c[s] - 1e-3 and t[s] > 1e-6]
    assert all(size[a] / t[a] == pytest.approx(size[b] / t[b], rel=1e-4) for a in free for b in free)


def run(spark, docs, targets, **kw):
    sizes = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, source string, n_tokens long, whole string")
    plan = M.planned(sizes, spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), kw.get("total"))
    return {r.source: r.planned for r in plan.collect()}, M.mixed(sizes, plan, buckets=kw.get("buckets", 64)).collect()


def test_shares_and_repeats(spark):
    docs = [(i, "a", 50 + i % 30) for i in range(2000)] + [(5000 + i, "b", 40) for i in range(100)] + [(9000, None, 10), (9001, "c", 0), (9002, "other", 99), (9003, "a", None)]
    plan, rows = run(spark, docs, [("A", 0.5, 1), ("b", 0.3, 4), ("ledgers", 0.1, 3), ("c", 0.1, 2), (None, 0.1, 1)])
    used = {}
    for r in rows:
        used[r.source] = used.get(r.source, 0) + r.n_tokens * r.repeats
    assert plan["ledgers"] == plan["c"] == 0 and set(used) == {"a", "b"}
    assert all(r.repeats <= {"a": 1, "b": 4}[r.source] for r in rows)
    assert used["b"] == pytest.approx(plan["b"], abs=80) and used["a"] == pytest.approx(plan["a"], abs=160)
    again = run(spark, docs, [("A", 0.5, 1), ("b", 0.3, 4)])[1]
    assert {(r.doc_id, r.repeats) for r in again} == {(r.doc_id, r.repeats) for r in run(spark, docs, [("A", 0.5, 1), ("b", 0.3, 4)], buckets=64)[1]}


def test_the_cut_is_the_same_for_any_number_of_buckets(spark):
    docs = [(i, "a", 1 + i % 90) for i in range(800)] + [(5000 + i, "b", 7) for i in range(300)]
    got = [{(r.doc_id, r.repeats) for r in run(spark, docs, [("a", 0.2, 3), ("b", 0.8, 9)], buckets=1)[1]}]
    assert got[0]


def test_empty(spark):
    assert run(spark, [], [("a", 1.0, 1)]) == ({"a": 0.0}, [])
    assert run(spark, [(1, "a", 5)], []) == ({}, [])


def test_source_names(spark):
    df = spark.createDataFrame([("Family_Notes",), (" family-notes ",), ("FAMILY NOTES",), (None,)], "s string")
    assert [r[0] for r in df.select(M.source_name("s")).collect()] == ["family_notes"] * 3 + [None]
