"""Mixing sources to target weights.

Capped water-filling: a source whose target would need more than its documents repeated the allowed number of times is
clamped there and its excess goes to the others in proportion, until all fit.  Every document of a source is then used the
whole number of times, and once more if it stands before the fractional cut in a seeded hash order.  The cut is found
from token sums of hash buckets, so no source is ever sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mergekin.llm.tokens import TOKENIZER, with_token_counts
from mergekin.session import read, stash

#: Hash buckets a source, and again of the bucket that holds the cut: what is left to be sorted is a 16-millionth of a source.
BUCKETS = 4096


def source_name(c: Column | str) -> Column:
    """A source in the standard spelling: lower case, blanks, hyphens and underscores one underscore."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_\-]+", "_")


def water_fill(targets: dict[str, float], ceilings: dict[str, float], total: float) -> dict[str, float]:
    """Size of every source: in proportion to targets, none above its ceiling, summing to total or to all ceilings if that is less."""
    size = {s: 0.0 for s in targets}
    open_, rest = {s for s in targets if targets[s] > 0 and ceilings.get(s, 0) > 0}, float(total)
    while open_ and rest > 0:
        weight = sum(targets[s] for s in open_)
        over = {s for s in open_ if rest * targets[s] / weight > ceilings[s]}
        if not over:
            size.update({s: rest * targets[s] / weight for s in open_})
            break
        for s in over:
            size[s] = float(ceilings[s])
        rest -= sum(ceilings[s] for s in over)
        open_ -= over
    return size


def planned(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """(source, target_share, max_repeats, available, planned): tokens each source has and is to give.

    total: size of the mix; by default all tokens of the targeted sources once.  targets is a small table, one row per source.
    """
    spark = sizes.sparkSession
    rows = targets.select(source_name("source").alias("source"), "target_share", "max_repeats").where("source is not null and target_share is not null").dropDuplicates(["source"]).collect()
    have = {r.source: int(r.n or 0) for r in sizes.where(F.col("source").isin([r.source for r in rows])).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    plan = water_fill({r.source: r.target_share for r in rows}, {r.source: have.get(r.source, 0) * max(0, r.max_repeats or 0) for r in rows}, sum(have.values()) if total is None else total)
    out = [(r.source, float(r.target_share), int(r.max_repeats or 0), have.get(r.source, 0), plan[r.source]) for r in rows]
    return spark.createDataFrame(out, "source string, target_share double, max_repeats int, available long, planned double")


def mixed(sizes: DataFrame, plan: DataFrame, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, source, n_tokens, repeats), repeats > 0: how often each document is used.

    sizes: (doc_id, source in the standard spelling, n_tokens); rows of other or null sources and of no tokens are left out.  doc_id is taken as
    unique; equal hashes go by doc_id; an empty table gives no rows.
    """
    epochs = plan.where("available > 0 and planned > 0").select("source", F.floor(F.col("planned") / F.col("available")).alias("whole"), F.col("planned").alias("want"), "available")
    epochs = epochs.withColumn("part", F.col("want") - F.col("whole") * F.col("available")).select("source", "whole", "part")
    h = F.xxhash64("doc_id", F.lit(seed))
    docs = sizes.select("doc_id", "source", "n_tokens").where("n_tokens > 0").join(F.broadcast(epochs), "source")  # epochs: one row per source
    docs = docs.select("doc_id", "source", "n_tokens", "whole", "part", h.alias("h"))

    def before_and_after(rows: DataFrame, place: Column) -> tuple[DataFrame, DataFrame]:
        """(rows of the bucket in which the running sum reaches part, with part less what lies before; the others, with extra)."""
        rows = rows.withColumn("bucket", place)
        sums = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"), F.first("part").alias("part"))
        before = F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")  # at most `buckets` rows a source
        cut = sums.withColumn("before", before).where("before <= part and part < before + n").select("source", F.col("bucket").alias("cut"), "before")
        rows = rows.join(F.broadcast(cut), "source", "left")  # one row a source
        outside = rows.where("cut is null or bucket != cut").withColumn("extra", F.when(F.col("cut").isNull(), 0).when(F.col("bucket") < F.col("cut"), 1).otherwise(0))
        return rows.where("bucket = cut").withColumn("part", F.col("part") - F.col("before")).drop("bucket", "cut", "before"), outside.select("doc_id", "source", "n_tokens", "whole", "extra")

    inside, first = before_and_after(docs, F.pmod("h", F.lit(buckets)))
    inside, second = before_and_after(inside, F.pmod(F.xxhash64("h"), F.lit(buckets)))
    upto = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("h", "doc_id"))  # one bucket of a bucket of a source
    last = inside.withColumn("extra", (upto - F.col("n_tokens") / 2 <= F.col("part")).cast("int")).select("doc_id", "source", "n_tokens", "whole", "extra")
    both = first.unionByName(second).unionByName(last)
    return both.select("doc_id", "source", "n_tokens", (F.col("whole") + F.col("extra")).cast("int").alias("repeats")).where("repeats > 0")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", source_name("source").alias("source"), "text")
    return stash(with_token_counts(docs, ["doc_id", "source"], path=TOKENIZER), "sizes")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _sizes(spark, sf_dir)
    return mixed(sizes, planned(sizes, read(spark, sf_dir, "mix_targets")))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every source: target, planned and reached share, tokens, documents and the most a document was used."""
    sizes = _sizes(spark, sf_dir)
    plan = planned(sizes, read(spark, sf_dir, "mix_targets"))
    got = mixed(sizes, plan).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    out = plan.join(got, "source", "left").na.fill(0, ["tokens", "documents", "most_repeats"])
    whole = Window.partitionBy()  # one row per source
    return out.select("source", "target_share", (F.col("planned") / F.sum("planned").over(whole)).alias("planned_share"), (F.col("tokens") / F.sum("tokens").over(whole)).alias("reached_share"), "available", "tokens", "documents", "most_repeats", "max_repeats")


SQL: dict[str, str] = {}
QUERIES = {"p7_mix": p7_mix, "p7_shares": p7_shares}
