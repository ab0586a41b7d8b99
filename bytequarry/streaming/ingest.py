"""Continuous ingest: a stream of files or documents, deduplicated as it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cdc import Profile
from ..operators.ingest import file_chunks


def document_stream(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def store_chunks(stream: DataFrame, target: str, checkpoint: str, profile: Profile):
    """Append chunks that the target doesn't have yet; a batch that is tried again finds its own chunks there already."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        c = file_chunks(df.select(F.col("doc_id").alias("file_id"), F.to_binary("text", F.lit("utf-8")).alias("content")), profile)
        new = c.select("chunk_hash", "size").distinct()
        jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        if jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm):
            new = new.join(spark.read.parquet(target), ["chunk_hash", "size"], "left_anti")
        new.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
