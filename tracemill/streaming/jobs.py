"""Incremental scoring and episode store upkeep with Structured Streaming.

A result row carries its whole trace, so scoring keeps no state between batches; the episode store keeps the keys it has
seen. Each batch may be run again after a failure: scored rows, retrieved episodes and stored episodes go to a folder per
batch that is overwritten.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracemill import schemas
from tracemill.operators import episodes as E
from tracemill.operators import score as S
from tracemill.session import through_table
from tracemill.sources import files


def result_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.RESULTS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _run(stream: DataFrame, work, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def score_stream(
    stream: DataFrame, gold: DataFrame, tools: DataFrame, base_state: DataFrame, out: str,
    checkpoint: str, keys: Sequence[str] = S.KEYS, on: str = "query_id",
) -> StreamingQuery:
    """Scores new result rows against static gold lists into ``out/batch=<n>``.

    The gold lists are replayed once, before the first batch.
    """
    wanted = through_table(S.gold_outcomes(gold, tools, base_state, on))

    def work(batch: DataFrame, number: int) -> None:
        scored = S.score(batch, gold, tools, base_state, keys, on, gold_out=wanted)
        scored.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return _run(stream, work, checkpoint)


def _once(stream: DataFrame, watermark: tuple[str, str] | None) -> DataFrame:
    """The first row of each (run, seq), remembered in the state of the stream, which is spread over the executors by key.

    ``watermark`` (a time column and a delay) lets the state forget keys; repeats then have to come within the delay.
    """
    keys = ["run_id", "seq"]
    return stream.dropDuplicates(keys) if watermark is None else stream.withWatermark(*watermark).dropDuplicatesWithinWatermark(keys)


def _passed(rows: DataFrame) -> DataFrame:
    return E.gate(rows).where("gate_status = 'stored'").withColumn("verified", F.lit(True))


def keep_episodes(stream: DataFrame, store: str, checkpoint: str, watermark: tuple[str, str] | None = None) -> StreamingQuery:
    """Stores newly verified episodes once, a version per batch.

    Rows need the columns of an episode plus those that ``episodes.gate`` reads. What is known already is known by the state of
    the stream, so no batch reads the store; a store belongs to its checkpoint.
    """

    def work(batch: DataFrame, number: int) -> None:
        files.write_version(batch, store, number)

    return _run(_once(_passed(stream), watermark), work, checkpoint)


def retrieve_and_keep(
    stream: DataFrame, store: str, out: str, checkpoint: str, k: int, watermark: tuple[str, str] | None = None
) -> StreamingQuery:
    """For each batch: the k most similar usable episodes of every query into ``out/batch=<n>``, then its verified episodes into the store.

    Rows are those of ``keep_episodes`` with the tools ``available`` to the query. Retrieval reads the store as it was before the
    batch, so that a batch that runs again retrieves the same and replaces what it wrote.
    """

    def work(batch: DataFrame, number: int) -> None:
        rows = through_table(batch)
        past = files.read_episodes(rows.sparkSession, store, before=number)
        past = past.withColumn("tools", F.array_distinct(F.transform("actions", lambda a: a["name"])))
        picks = E.similar_episodes(past, rows.select("run_id", "seq", "query", "available"), k)
        picks.write.mode("overwrite").parquet(f"{out}/batch={number}")
        files.write_version(_passed(rows), store, number)

    return _run(_once(stream, watermark), work, checkpoint)
