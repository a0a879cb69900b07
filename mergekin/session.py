"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "mergekin", cores: str | int = "*", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session with the settings the operators are tested under."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; where none is set, as in tests, make one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="mergekin-ckpt-")
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there: survives lost executors and cuts lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def stash(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df as Parquet into the shared checkpoint folder and read it back.

    Like cut(), but columnar and compressed, and the reader knows the size, so later
    joins can be planned on it.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._mergekin_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the files of a stashed table that nothing will read again, as the last round's state of a loop; other tables are left alone."""
    path = getattr(df, "_mergekin_path", None)
    if path is not None:
        sc = df.sparkSession.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
