"""Writers: graph tables, results, entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Links with fewer known pairs than this are not reported.
LEAST_KNOWN = 100
RESULT_COLUMNS = ["link", "individual_link", "merge_t", "atomic_t", "def", "scenario", "GT", "P", "TP", "FP", "FN", "Pre", "Re", "Fstar", "time"]


def write_graph(path: str, **tables: DataFrame) -> None:
    """Each table (atomic pairs, nodes, edges, evidence, groups) as Parquet under its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_graph(spark, path: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def result_rows(quality: DataFrame, merge_t: float, atomic_t: float, rule: str, scenario: str, seconds: float, least_known: int = LEAST_KNOWN) -> DataFrame:
    """Rows of the results file from evaluate.quality(); links with fewer than least_known known pairs are left out."""
    rows = quality.withColumn("GT", F.col("tp") + F.col("fn")).withColumn("P", F.col("tp") + F.col("fp")).where(F.col("GT") >= least_known)
    return rows.select(
        "link", F.col("link").alias("individual_link"), F.lit(merge_t).alias("merge_t"), F.lit(atomic_t).alias("atomic_t"), F.lit(rule).alias("def"), F.lit(scenario).alias("scenario"), "GT", "P",
        F.col("tp").alias("TP"), F.col("fp").alias("FP"), F.col("fn").alias("FN"), F.col("precision").alias("Pre"), F.col("recall").alias("Re"), F.col("f_star").alias("Fstar"), F.lit(float(seconds)).alias("time"),
    )


def append_results(rows: DataFrame, path: str) -> None:
    """Appends as CSV; each run adds files of its own, so parallel runs need no lock."""
    rows.coalesce(1).write.mode("append").option("header", True).csv(path)


def entities_json(members: DataFrame, records: DataFrame, columns: list[str]) -> DataFrame:
    """(entity, json): each entity with its size and the sets of its records' values."""
    held = members.join(records, members["record"] == records["id"]).groupBy("entity").agg(F.count("*").alias("size"), *[F.sort_array(F.collect_set(F.col(c).cast("string"))).alias(c) for c in columns])
    return held.select("entity", F.to_json(F.struct("size", *columns)).alias("json"))


def write_entities(entities: DataFrame, path: str) -> None:
    entities.write.mode("overwrite").text(path) if entities.columns == ["value"] else entities.select("json").write.mode("overwrite").text(path)
