"""The corpus pipeline: quality, near copies, benchmark passages, personal data, mixing.

Each stage reads the table its predecessor kept, and its decisions take effect: rows go, or texts change. All stages but
the last return the columns of ``documents``; the last says how often each row is taken, and ``run`` draws the rows. The second and third stage give each row
a key of its own, so that rows that repeat a doc_id or have none are matched like all others.

Defined cases: a null or empty text is kept by every stage but the first, which judges it like other texts, and takes no word of the mix. Rows
that repeat a text are near copies of it, so one of them stays. Very long texts are worked on whole. An empty table gives an empty one.
Columns beside those of ``documents`` are carried to the last stage, whatever their names, and are not part of the mix.

No stage can be put in SQL: the first, fourth and last one draw on trained models or seeded draws.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tracemill.llm import contamination, mixing, ngram_join, pii, quality
from tracemill.llm.sieve import marked
from tracemill.session import shared_dir, ship_package, through_table

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    ship_package(spark)
    return quality.kept(docs, quality.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _free(name: str, taken: list[str]) -> str:
    """``name``, made longer until no column has it; column names differ in more than case."""
    low = {c.lower() for c in taken}
    while name in low:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a key of their own, and the key's name, which no column has.

    Rows of a file are known by their place in it, so nothing is written: the key is the number of the file (one row per file is
    collected) and the row's place. Rows that come from elsewhere get their keys through a table.
    """
    key = _free("row_key", docs.columns)
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias(f"{key}_file"), F.col("_metadata.row_index").alias(f"{key}_at"))
    except AnalysisException:
        return through_table(docs.withColumn(key, F.monotonically_increasing_id())), key
    files = sorted(r[0] for r in placed.select(f"{key}_file").distinct().collect())
    numbers = docs.sparkSession.createDataFrame(list(zip(files, range(len(files)))), f"{key}_file string, {key}_number long")
    number = F.shiftleft(F.col(f"{key}_number"), 40)
    return placed.join(F.broadcast(numbers), f"{key}_file").select(*docs.columns, (number + F.col(f"{key}_at")).alias(key)), key


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class of near copies (shingles of five words, similarity 0.8) the row with the least doc_id, null last."""
    ship_package(spark)
    rows, key = _keyed(docs)
    classes = through_table(ngram_join.joined(rows.select(F.col(key).alias("doc_id"), "text"), k=5, percent=80))
    member = classes.select(F.col("doc_id").alias(key), "component_id").join(rows.select(key, "doc_id"), key)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", key)).alias("least")
    left = through_table(member.groupBy("component_id").agg(least).select(f"least.{key}"))
    # Rows that the sieve does not mark are not among those that go; only the marked ones move to be told apart by the exact keys.
    gone = through_table(member.select(key).join(left, key, "left_anti"))
    seen = marked(rows.select(key, F.struct(*docs.columns).alias("held_row")), gone, [key])
    told = seen.where("likely").join(left, key, "left_semi")
    kept = seen.where("not likely").select("held_row").unionByName(told.select("held_row"))
    return kept.select(*(F.col("held_row").getField(c).alias(c) for c in docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that hold a benchmark item."""
    ship_package(spark)
    rows, key = _keyed(docs)
    found = contamination.contaminated(rows.select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = through_table(found.select(F.col("doc_id").alias(key)).distinct())
    return rows.join(bad, key, "left_anti").select(*docs.columns)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind; ``n_chars`` follows the text. Other columns go along as one, whatever their names."""
    ship_package(spark)
    own = docs.select("doc_id", "text")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    carried = docs.select("doc_id", "text", F.struct(*rest).alias("other_columns")) if rest else own
    spans = pii.with_spans(carried, pii.trained(own), *(["other_columns"] if rest else []))
    text = F.when(F.col("was_null"), F.lit(None)).otherwise(pii.redacted(F.col("text"), F.col("spans")))
    place = {"doc_id": F.col("doc_id"), "text": text.alias("text")} | {c: F.col("other_columns").getField(c).alias(c) for c in rest}
    out = spans.select(*(place[c] for c in docs.columns))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each row, and the shards that hold it; ``run`` draws the rows by it."""
    ship_package(spark)
    return mixing.taken_rows(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("benchmark decontamination", decontamination_stage),
    ("personal data", personal_data_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each is written to the shared folder and read again. Returns the rows of the mix:
    doc_id, text, source, epoch, shard, place."""
    sf_dir = sf_dir.rstrip("/")
    docs = read = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path, read = shared_dir(spark), docs
        stage(spark, read, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return mixing.drawn(docs, read)
