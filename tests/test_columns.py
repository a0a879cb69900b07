from pyspark.sql import functions as F

from mergekin.functions import columns as C
from mergekin.functions import compare, phonetic
from mergekin.functions.maths import expand_tags, random_expo, random_linear, summary, tag_sequences

PAIRS = [("peter", "pedro"), ("", "a"), ("a", ""), ("same", "same"), ("aab", "aba"), ("éa", "ea"), ("x y", "y x"), (None, "a"), ("a", None), (None, None)]


def test_native_comparators_equal_the_python_ones(spark):
    df = spark.createDataFrame(PAIRS, "a string, b string")
    for name, f in C.NATIVE.items():
        for r in df.select("a", "b", f("a", "b").alias("s")).collect():
            assert abs(r.s - compare.comparator(name)(r.a or "", r.b or "")) < 1e-9, (name, r)


def test_udfs_take_nulls(spark):
    df = spark.createDataFrame(PAIRS, "a string, b string")
    got = [r[0] for r in df.select(C.similarity("sortwinkler")("a", "b")).collect()]
    assert got == [compare.sort_winkler(a or "", b or "") for a, b in PAIRS]
    codes = [r[0] for r in df.select(C.encode_udf("dmetaphone4")("a")).collect()]
    assert codes[0] == "ptr" and codes[-1] == ""
    assert "enc_soundex" in C.register(spark)
    assert spark.sql("SELECT sim_jaro('martha', 'marhta') > 0.9").first()[0]


def test_native_encoders(spark):
    names = ["peter", "", "a", "van der berg", "pfister", "mississippi", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for r in df.select("n", C.soundex("n").alias("s"), C.mod_soundex("n").alias("m"), C.freq_vector("n", "phonix").alias("v")).collect():
        assert r.s == phonetic.soundex(r.n or "") and r.m == phonetic.mod_soundex(r.n or "")
        assert r.v == phonetic.freq_vector(r.n or "", "phonix")


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([], [])], "a array<double>, b array<double>")
    got = df.select(C.dist_l1("a", "b"), C.dist_l2("a", "b"), C.dist_linf("a", "b"), C.dist_canberra("a", "b"), C.dist_cosine("a", "b")).collect()
    assert tuple(got[0])[:4] == (2.0, 2.0, 2.0, 0.5)
    assert got[1][4] == 1.0 and got[2][2] == -1.0


def test_maths(spark):
    df = spark.createDataFrame([(["a", "b/c", "d/e"],)], "t array<string>")
    assert df.select(tag_sequences(F.col("t"))).first()[0] == [" ".join(x) for x in expand_tags(["a", "b/c", "d/e"])]
    s = summary(spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,)], "x double"), "x", (0.5, 0.25)).first()
    assert s.n == 3 and s.quantiles == [2.0, 1.5]
    assert summary(spark.createDataFrame([], "x double"), "x").first().mean is None
    draws = spark.range(500).select(random_linear(10, 1).alias("l"), random_expo(10, 2).alias("e")).collect()
    assert all(0 <= r.l <= 10 and 0 <= r.e <= 10 for r in draws)
    assert sum(r.l for r in draws) / 500 > 6 and sum(r.e for r in draws) / 500 < 2
