import random
import time

from pyspark.sql import functions as F

from mergekin.functions import columns as C
from mergekin.functions import compare
from mergekin.operators import evidence as E


def _texts(n, seed, words=1):
    r = random.Random(seed)
    return [" ".join("".join(r.choice("aabcdéo1") for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, words))) for _ in range(n)]


def test_many_pairs_score_as_each():
    a = [*_texts(3000, 1), *_texts(1500, 2, 5), "", "a", "x", " ", "ab  cd", "cd ab", "smith", "😀b"]
    b = [*_texts(3000, 3), *_texts(1500, 4, 5), "a", "", "x", "b", "cd ab", "ab cd", "smyth", "b😀"]
    assert compare.sort_winkler_many(a, b).tolist() == [compare.sort_winkler(p, q) for p, q in zip(a, b, strict=True)]
    assert compare.sort_winkler_many([], []).tolist() == []


def test_bounds_lose_no_pair(spark):
    a, b = _texts(150, 5, 3), [*_texts(150, 6, 3), ""]
    left, right = spark.createDataFrame([(x,) for x in a], "v string"), spark.createDataFrame([(x,) for x in b], "v string")
    one = lambda df: df.select("v", F.lit("all").alias("block"))
    for text, score, least in (("sortwinkler", compare.sort_winkler, 0.8), (C.edit_dist, compare.comparator("editdist"), 0.6)):
        got = {(r.v1, r.v2): round(r.sim, 12) for r in E.alike_values(left, right, "name", "v", least, text, blocks=one).collect()}
        want = {(p, q): round(score(p, q), 12) for p in a for q in b if score(p, q) >= least}
        assert got == want and len(want) > 20


def test_surnames_of_one_block_in_time(spark):
    names = spark.range(12000).select(F.concat(F.lit("x"), F.translate(F.sha2(F.col("id").cast("string"), 256).substr(1, 20), "0123456789", "ghijklmnop")).alias("v"))
    began = time.time()
    alike = E.alike_values(names, names, "name", "v", 0.9, blocks=lambda df: df.select("v", F.lit("x").alias("block")))
    assert alike.count() >= 12000 and time.time() - began < 60  # 144 million pairs in a block


def test_far_surnames_are_told_by_their_letters(spark):
    rows = spark.createDataFrame([("smithson", "s"), ("smitson", "s"), ("sandoval", "s")], "v string, block string")
    x, y = (E._signed(rows, False).withColumnsRenamed({c: f"{c}_{k}" for c in ("n", "h1", "h2", "few", "many")}).withColumnRenamed("v", f"v{k}") for k in (1, 2))
    met = {(r.v1, r.v2) for r in x.join(y, "block").where("v1 < v2").where(E._may_be_alike(C.edit_dist, 0.8)).collect()}
    assert met == {("smithson", "smitson")}
