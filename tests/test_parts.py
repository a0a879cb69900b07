import time

from pyspark.sql import functions as F

from mergekin.operators import evidence as E
from mergekin.plans import linkage as L


def _many_parts(spark, folder):
    """20,000 parts of one brand and type; names of all but four pairs are far from each other."""
    name = F.when(F.col("id") < 4, F.concat(F.lit("small ring "), (F.col("id") % 2).cast("string"))).otherwise(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 20))
    spark.range(20000).select(F.col("id").alias("p_partkey"), name.alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("LARGE").alias("p_type"), F.lit(7).alias("p_size"), F.when(F.col("id") != 1, 900.0).alias("p_retailprice")).write.parquet(f"{folder}/part.parquet")


def test_accepted_parts_of_unlike_names_never_meet(spark, tmp_path):
    _many_parts(spark, tmp_path)
    began = time.time()
    got = {tuple(r) for r in L.accepted_parts(spark, str(tmp_path)).collect()}
    assert got == {(a, b, 1, 1, 0 if 1 in (a, b) else 1) for a in range(4) for b in range(a + 1, 4)}
    assert time.time() - began < 45  # all pairs are 200 million


def test_wide_acceptance_is_that_of_evidence(spark):
    rows = [(1, 2, 0.8, 0.5, None), (1, 3, 0.75, 0.4, 0.5), (1, 4, 0.7, 1.0, 1.0), (2, 3, 1.0, None, 0.4), (2, 4, None, 1.0, 1.0)]
    wide = spark.createDataFrame(rows, "r1 long, r2 long, name double, size double, price double")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("attr"), F.col(c).alias("sim")) for c in ("name", "size", "price")])).alias("x")
    evidence = wide.select("r1", "r2", each).select("r1", "r2", "x.attr", "x.sim")
    told = lambda df: sorted(tuple(r) for r in df.collect())
    assert told(E.accepted_wide(wide, L.PARTS_RULE)) == told(E.accepted_pairs(evidence, L.PARTS_RULE))
    of = {(r.r1, r.r2): r.sim_attr for r in E.weighted_wide(wide, L.PARTS_RULE).collect()}
    assert {k: of[k] for k in ((r.r1, r.r2) for r in E.weighted_scores(evidence, L.PARTS_RULE).collect())} == {(r.r1, r.r2): r.sim_attr for r in E.weighted_scores(evidence, L.PARTS_RULE).collect()}


def test_linked_parts_of_unlike_names_never_meet(spark, tmp_path):
    _many_parts(spark, tmp_path)
    began = time.time()
    got = {(r.r1, r.r2): r.score for r in L.linked_parts(spark, str(tmp_path)).collect()}
    near = round(1 - 1 / 12, 9)
    name = lambda a, b: 1.0 if a % 2 == b % 2 else near
    assert got == {(a, b): round(0.7 * name(a, b) + 0.3 if 1 in (a, b) else 0.6 * name(a, b) + 0.4, 6) for a in range(4) for b in range(a + 1, 4)}
    assert time.time() - began < 45  # all pairs are 200 million
