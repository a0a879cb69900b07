from datetime import datetime, timedelta

from pyspark.sql import functions as F

from mergekin.llm import p5_survivors as S

SCHEMA = "e long, v string, feed string, at timestamp, pattern string, g string, field int"


def best(spark, rows, standing=None):
    df = spark.createDataFrame([(e, v, f, datetime(2022, 1, 1) + timedelta(days=d), "x", "y", 1) for e, v, f, d in rows], SCHEMA)
    known = None if standing is None else spark.createDataFrame(standing, "field string, value string, known double")
    return {r.g: r.v for r in S.survivors(df, "e", {"v": F.col("v")}, "feed", "at", {"good": 1, "bad": 3}, known).collect()}


def many(n, start=1000):
    """Groups in which the good feed and a fair one agree and the bad one errs."""
    return [row for k in range(start, start + n) for row in ((k, f"true{k}", "good", 1), (k, f"true{k}", "fair", 2), (k, f"wrong{k}", "bad", 3), (k, f"odd{k}", "bad", 4))]


def test_learns_which_sources_to_believe(spark):
    rows = many(60) + [(1, "x", "good", 1), (1, "y", "bad", 2), (2, "x", "bad", 1), (2, "y", "bad", 2), (2, "z", "good", 3), (3, None, "good", 1), (3, "only", "bad", 1), (4, None, "good", 1), (None, "q", "good", 1), (5, "w", None, 1)]
    got = best(spark, rows)
    assert got[1] == "x" and got[2] == "z" and got[3] == "only" and got[4] is None and got[5] == "w" and None not in got
    assert all(got[k] == f"true{k}" for k in range(1000, 1060))


def test_better_known_values_win_and_ties_are_settled(spark):
    standing = [("v", "william", 500.0), ("v", "bill", 20.0), ("v", "willaim", 1.0)]
    got = best(spark, many(40) + [(1, "bill", "fair", 1), (1, "william", "fair", 2), (2, "willaim", "fair", 1), (2, "william", "fair", 1), (3, "aa", "fair", 1), (3, "ab", "fair", 1)], standing + [("v", f"true{k}", 9.0) for k in range(1000, 1040)])
    assert got[1] == "william" and got[2] == "william" and got[3] in ("aa", "ab")


def test_empty(spark):
    assert best(spark, []) == {}


def test_multi_valued_fields_keep_what_is_judged_true(spark):
    rows = many(50) + [(1, "a", "good", 1), (1, "b", "good", 1), (1, "a", "fair", 1), (1, "b", "fair", 1), (1, "c", "bad", 1)]
    df = spark.createDataFrame([(e, "v", v, f, datetime(2022, 1, 1) + timedelta(days=d)) for e, v, f, d in rows], "g long, field string, value string, source string, at timestamp")
    judged = {r.value: r.is_true for r in S.judged_facts(df, {"good": 1, "bad": 3}).where("g = 1").collect()}
    assert not judged["c"]
    assert set(judged) == {"a", "b", "c"}
