import random

from pyspark.sql import functions as F

from mergekin.functions import columns as C
from mergekin.operators import evidence as E
from mergekin.plans import linkage


def test_variations_with_unlike_given_name_codes(spark, tmp_path):
    names = ["mqtilda", "matilda", "harrict", "harriet", "jo"]
    rows = [(i, 1, "A", f, "arlen", 1990) for i, f in enumerate(names)]
    spark.createDataFrame(rows, "id long, pub_id long, source string, fname string, sname string, year long").write.parquet(str(tmp_path / "people_dict.parquet"))
    got = {(r.key, r.other) for r in linkage.name_variations(spark, str(tmp_path)).collect()}
    pairs = [("arlen-matilda", "arlen-mqtilda"), ("arlen-harrict", "arlen-harriet")]
    assert got == {*pairs, *((b, a) for a, b in pairs)}
    assert {r.key: r.freq for r in linkage.clustered_names(spark, str(tmp_path)).collect()}["arlen-matilda"] == 2


def test_alike_by_edits_is_complete(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 26))) for _ in range(120)}
    for w in list(words):
        for _ in range(4):
            x = list(w)
            for _ in range(rng.randrange(1, 5)):
                i = rng.randrange(len(x) + 1)
                x[i : i + rng.randrange(2)] = rng.choice(["", "a", "b", "ab"])
            words.add("".join(x))
    v = spark.createDataFrame([(w,) for w in sorted(words)], "v string")
    for t in (0.7, 0.85, 0.9):
        want = v.select(F.col("v").alias("v1")).crossJoin(v.select(F.col("v").alias("v2"))).where(C.edit_dist("v1", "v2") >= t).collect()
        got = [tuple(r) for r in E.alike_by_edits(v, t).collect()]
        assert len(want) > len(words) and len(got) == len(set(got)) and set(got) == {tuple(r) for r in want}
