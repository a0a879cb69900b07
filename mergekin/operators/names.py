"""How common a name is: counts of combined attributes, their variations, and counts over variations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergekin.functions.columns import edit_dist, encode_udf, similarity
from mergekin.operators.evidence import alike_by_edits
from mergekin.standardise import concat_key


def combined_frequency(records: DataFrame, columns: list[str]) -> DataFrame:
    """(key, <columns>, freq): how many records share each combination; a null is the text None in the key."""
    return records.groupBy(*columns).agg(F.count("*").alias("freq")).withColumn("key", concat_key(*columns))


def variations(combos: DataFrame, columns: list[str], min_sim: float = 0.9, comparator="sortwinkler", block="dmetaphone4") -> DataFrame:
    """(key, other): combinations whose every component is at least min_sim alike; direct neighbours only, never itself.

    Only combinations that share the phonetic key of the first attribute are compared.  A common surname makes a large block, so distinct
    values are compared, each pair once, and combinations join on alike values.
    """
    compare = similarity(comparator) if isinstance(comparator, str) else comparator
    code = encode_udf(block) if isinstance(block, str) else block
    values = combos.select(columns[0]).where(F.col(columns[0]).isNotNull()).distinct().withColumn("_block", code(F.col(columns[0])))
    keyed = combos.select("key", *columns).join(values, columns[0])
    found, others = keyed, [f"{c}_o" for c in columns]
    for c, o in zip(columns, others, strict=True):
        if comparator is edit_dist and c != columns[0]:
            alike = alike_by_edits(keyed.select(F.col(c).alias("v")), min_sim).select(F.col("v1").alias(c), F.col("v2").alias(o))
        else:
            v = keyed.select("_block", c).distinct()
            pairs = v.join(v.withColumnRenamed(c, o), "_block").select(c, o).distinct()
            alike = pairs.where(compare(F.col(c), F.col(o)) >= min_sim)
        found = found.join(alike, c)
    other = keyed.select(F.col("key").alias("other"), "_block", *[F.col(c).alias(o) for c, o in zip(columns, others, strict=True)])
    return found.join(other, ["_block", *others]).where("key != other").select("key", "other")


def clustered_frequency(combos: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(key, freq): a combination's own count plus those of its variations; an unseen key counts 1."""
    counts = combos.select("key", "freq")
    around = neighbours.join(counts.withColumnRenamed("key", "other"), "other", "left").groupBy("key").agg(F.sum(F.coalesce("freq", F.lit(1))).alias("more"))
    return counts.join(around, "key", "left").select("key", (F.coalesce("freq", F.lit(1)) + F.coalesce("more", F.lit(0))).alias("freq"))
