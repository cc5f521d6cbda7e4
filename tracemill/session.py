"""Session settings, and the shared folder used to cut lineage and to hand files over."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "tracemill", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    b = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(cores if cores != "*" else 8))
        .config("spark.sql.adaptive.enabled", "true")
        # Traces are small in bytes and dear in work: keep all cores busy on small inputs.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "10000")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A fresh path below the folder that the session names in ``spark.checkpoint.dir`` or by ``setCheckpointDir``."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, where the Arrow functions import it."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = os.path.dirname(os.path.abspath(__file__))
        name = os.path.basename(root)
        base = os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), name)
        sc.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(root), name))
        _shipped.add(sc.applicationId)


def through_table(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    For results that several later branches read: they then share one
    computation, and a lost executor re-reads files.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(table: DataFrame) -> None:
    """Removes the files of a result of ``through_table`` that nothing reads any more: they lie below the shared folder."""
    spark = table.sparkSession
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)
