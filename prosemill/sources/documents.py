"""Reading documents, guarding their analysis, and writing its sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents from Parquet; only the two columns are scanned."""
    return spark.read.parquet(path).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """One document for each text file; its path is its id."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` over all cores, if they are too few bytes for one split each; larger tables are read in place, without a shuffle.

    The size is the optimiser's estimate of what the plan reads: no job runs. Where it has none it is taken for large.
    """
    if docs.isStreaming:
        return docs
    spark = docs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return docs.repartition(3 * cores) if 0 < size < cores * split else docs


def guard(docs: DataFrame, limit: int, muted: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``skip``: why a document is not analysed, or null. Muting is named before size.

    A document of exactly ``limit`` characters is analysed. ``muted`` has one doc_id for each muted document.
    """
    chars = F.length(F.coalesce("text", F.lit("")))
    rows = docs.withColumn("_muted", F.lit(False))
    if muted is not None:
        names = muted.select("doc_id").distinct().withColumn("_muted", F.lit(True))
        rows = docs.join(names, "doc_id", "left").withColumn("_muted", F.coalesce("_muted", F.lit(False)))
    none = F.lit(None).cast("int")
    skip = F.when(F.col("_muted"), F.struct(F.lit("muted").alias("reason"), none.alias("chars"), none.alias("limit"))).when(
        chars > limit, F.struct(F.lit("too-large").alias("reason"), chars.alias("chars"), F.lit(limit).alias("limit"))
    )
    return rows.withColumn("skip", skip).drop("_muted")


def changed(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Documents whose text is not the one analysed before; ``known`` has doc_id and text_hash."""
    rows = docs.withColumn("text_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    return rows.join(known.select("doc_id", "text_hash"), ["doc_id", "text_hash"], "left_anti").select(*docs.columns, "text_hash")


def keep_bucketed(rows: DataFrame, name: str, buckets: int = 64, mode: str = "errorifexists") -> DataFrame:
    """``rows`` as a table bucketed and sorted by doc_id, for joins by it that move nothing."""
    rows.write.mode(mode).bucketBy(buckets, "doc_id").sortBy("doc_id").saveAsTable(name)
    return rows.sparkSession.table(name)


def hashes(docs: DataFrame) -> DataFrame:
    """What is known of documents after their analysis: doc_id and text_hash."""
    return docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))


def changed_in_place(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``changed`` for tables that are both bucketed alike: texts and hashes meet bucket by bucket, without an exchange.

    A doc_id is in ``known`` once. Null ids are always new.
    """
    old = known.select(F.col("doc_id"), F.col("text_hash").alias("_known"))
    rows = docs.withColumn("text_hash", F.sha2(F.coalesce("text", F.lit("")), 256)).hint("merge").join(old, "doc_id", "left")
    return rows.where(~F.col("text_hash").eqNullSafe(F.col("_known"))).select(*docs.columns, "text_hash")


def write_sections(sections: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Each section as a Parquet table below ``path``."""
    for name, df in sections.items():
        df.write.mode(mode).parquet(f"{path.rstrip('/')}/{name}")
