"""Reading and writing query, result, episode and example files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from tracemill import schemas
from tracemill.functions import jsontext as J
from tracemill.functions import text as X
from tracemill.sources import csvsplit


def list_literal(items: Column) -> Column:
    """An array of strings as a Python list literal."""
    quoted = F.transform(
        items,
        lambda s: F.concat(
            F.lit("'"),
            F.replace(
                F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")),
                F.lit("\n"), F.lit("\\n"),
            ),
            F.lit("'"),
        ),
    )
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def read_queries(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """Query and answer table; list literals become arrays, ``seq`` numbers the rows in the order of files and lines."""
    rows = csvsplit.read_csv(spark, path, schemas.QUERIES_CSV)
    if first is not None:
        rows = rows.where(F.col("seq") < first)
    return rows.select(
        F.sha2("query", 256).alias("query_id"), "seq", "query",
        J.string_list(F.col("answer")).alias("answer"), X.domain_list(F.col("domains")).alias("domains"),
    )


def write_queries(df: DataFrame, path: str) -> None:
    flat = df.select("query", list_literal(F.col("answer")).alias("answer"), list_literal(F.col("domains")).alias("domains"))
    flat.write.options(header=True, quoteAll=True, escape='"').csv(path)


def write_results(df: DataFrame, root: str) -> None:
    """Result rows as Parquet, a folder per domain and configuration."""
    df.write.mode("append").partitionBy("domain", "config").parquet(root)


def read_results(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(schemas.RESULTS).parquet(root)


def export_results(df: DataFrame, root: str, domain: str, label: str, mode: str, time: str) -> str:
    """One run's rows as fully quoted CSV below ``<domain>/<label>_<mode>_<time>.csv``."""
    path = f"{root}/{domain}/{label}_{mode}_{time}.csv"
    flat = df.select(
        "query", list_literal(F.col("function_calls")).alias("function_calls"), "full_response",
        F.coalesce("error", F.lit("")).alias("error"),
    )
    flat.write.options(header=True, quoteAll=True, escape='"', emptyValue="").csv(path)
    return path


def read_history(spark: SparkSession, root: str) -> DataFrame:
    """All exported runs below ``root`` with what their paths say about them.

    ``run_id`` names the file of a run, ``query_id`` is that of ``read_queries``, so that runs can be scored as they are.
    """
    raw = csvsplit.read_csv(spark, f"{root}/*/*.csv", schemas.RESULTS_CSV)
    name = r"/([^/]+)/([a-z0-9-]+)_([^/]+)_(\d{4}-\d\d-\d\d_\d\d-\d\d-\d\d)\.csv"
    part = lambda i: F.regexp_extract("_file", name, i)
    run = F.concat(part(1), F.lit("/"), F.concat_ws("_", part(2), part(3), part(4)))
    return raw.select(
        part(1).alias("domain"), part(2).alias("label"), part(3).alias("mode"), part(4).alias("time"),
        "query", J.string_list(F.col("function_calls")).alias("function_calls"), "full_response",
        F.coalesce("error", F.lit("")).alias("error"), run.alias("run_id"), F.sha2("query", 256).alias("query_id"),
    )


def _stored(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame | None:
    """The table at ``path``; None if nothing has been written there yet."""
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None


def read_episodes(spark: SparkSession, path: str, fmt: str = "parquet", before: int | None = None) -> DataFrame:
    """The stored episodes; none if nothing has been stored yet.

    ``before`` reads a store of versions as it was before that batch: complete versions below it, whatever has been or is being
    written since.
    """
    if before is not None:
        known = store_version(spark, path)
        stored = _stored(spark, path, StructType([*schemas.EPISODES.fields, StructField("batch", LongType())]), fmt)
        if stored is not None:
            return stored.where(F.col("batch") < min(before, known + 1)).select(*schemas.EPISODES.names)
    else:
        stored = _stored(spark, path, schemas.EPISODES, fmt)
        if stored is not None:
            return stored.select(*schemas.EPISODES.names)
    return spark.createDataFrame([], schemas.EPISODES)


def store_version(spark: SparkSession, path: str) -> int:
    """The last complete version of a store of versions; -1 if there is none."""
    done = _stored(spark, f"{path}/_versions", StructType([StructField("version", LongType())]))
    last = done.agg(F.max("version")).first()[0] if done is not None else None
    return -1 if last is None else last


def write_version(episodes: DataFrame, path: str, number: int) -> None:
    """Writes the episodes of batch ``number`` as a folder of their own, then says that it is complete. Writing it again replaces it.

    Nothing of the store is read: the caller sees to it that an episode comes in one batch only.
    """
    episodes.select(*schemas.EPISODES.names).write.mode("overwrite").parquet(f"{path}/batch={number}")
    version = episodes.sparkSession.createDataFrame([(number,)], "version long")
    version.coalesce(1).write.mode("overwrite").parquet(f"{path}/_versions/batch={number}")


def append_episodes(new: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Adds the episodes that the store does not hold yet, by run and sequence number."""
    known = read_episodes(new.sparkSession, path, fmt).select("run_id", "seq")
    fresh = new.dropDuplicates(["run_id", "seq"]).join(known, ["run_id", "seq"], "left_anti")
    fresh.select(*schemas.EPISODES.names).write.mode("append").format(fmt).save(path)


def read_examples(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Few-shot examples with the key of their domains, whatever order these are in.

    A JSON array in one file, or one object per ``lines``, which splits across tasks.
    """
    raw = spark.read.schema(schemas.EXAMPLES).option("multiLine", not lines).json(path)
    return raw.withColumn("domain_key", X.key_of(F.transform("domains", X.domain_name)))
