"""Records that arrive over time.

Linkage is batch work; what streams here is delivery: later deliveries correct earlier ones, and new records are linked
against what is known.  Both have a batch form and a foreachBatch form that shares it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_deliveries(df: DataFrame, keys: list[str], when: str, tie: str = "id") -> DataFrame:
    """One row per key, the latest by `when`; ties go to the larger `tie`. A null key is a key like others."""
    last = Window.partitionBy(*keys).orderBy(F.desc(when), F.desc(tie))
    return df.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")


#: Buckets of keys that upsert_stream keeps apart: a batch rewrites those it touches only.
BUCKETS = 64
_BUCKET = "mergekin_bucket"


def upsert_stream(deliveries: DataFrame, path: str, keys: list[str], when: str, checkpoint: str, tie: str = "id", buckets: int = BUCKETS):
    """A streaming query that keeps the latest delivery per key in Parquet under path, by batch and bucket of keys.

    A batch joins the last state of the buckets its keys fall into and writes those anew; older states are removed but for the one before, which a
    batch that is run again after a failure starts from.  So the files hold at most two states, and a batch costs what its buckets hold.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        placed = batch.withColumn(_BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in placed.select(_BUCKET).distinct().collect()]  # at most `buckets` numbers
        if not touched:
            return
        states = _states(spark, path)
        last = {k: max(n for n in states[k] if n < number) for k in touched if any(n < number for n in states.get(k, []))}
        both = placed
        for k, n in last.items():
            both = both.unionByName(spark.read.schema(batch.schema).parquet(_at(path, n, k)).withColumn(_BUCKET, F.lit(k)))
        latest_deliveries(both, keys, when, tie).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{path}/batch={number:09d}")
        for k, n in last.items():
            for older in states[k]:
                if older < n:
                    _remove(spark, _at(path, older, k))

    return deliveries.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def _at(path: str, number: int, bucket: int) -> str:
    return f"{path}/batch={number:09d}/{_BUCKET}={bucket}"


def _files(spark, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _remove(spark, path: str) -> None:
    at, fs = _files(spark, path)
    fs.delete(at, True)


def _states(spark, path: str) -> dict[int, list[int]]:
    """The batches that hold a state of each bucket. As many folders as there are buckets, twice at most."""
    at, fs = _files(spark, f"{path}/batch=*/{_BUCKET}=*")
    found: dict[int, list[int]] = {}
    for status in fs.globStatus(at) or []:
        folder = status.getPath()
        found.setdefault(int(folder.getName().split("=")[1]), []).append(int(folder.getParent().getName().split("=")[1]))
    return found


def snapshot(spark, path: str, batches: int) -> DataFrame | None:
    """The latest delivery per key after so many batches, of which the last two can be told apart; None if there is none."""
    last = {k: max(n for n in ns if n < batches) for k, ns in _states(spark, path).items() if any(n < batches for n in ns)}
    return spark.read.parquet(*[_at(path, n, k) for k, n in sorted(last.items())]) if last else None


def link_stream(records: DataFrame, known: DataFrame, link: Callable[[DataFrame, DataFrame], DataFrame], path: str, checkpoint: str):
    """A streaming query that appends link(new records, known records) of each batch to Parquet under path."""

    def score(batch: DataFrame, number: int) -> None:
        link(batch, known).withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return records.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
