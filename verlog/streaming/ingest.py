"""Continuous ingest: files of a log that appear in a folder are appended to another, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import LOG, split_faulty


def follow(spark: SparkSession, source: str, log_dir: str, checkpoint: str, *, files_per_batch: int = 1000, once: bool = True) -> StreamingQuery:
    """Append sound rows to log_dir, one sub-folder for each micro-batch, so that a batch that is run
    again replaces what it wrote; faulty rows go to log_dir + '-faulty'."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()  # it is read twice
        sound, faulty = split_faulty(batch)
        sound.repartitionByRange("key").sortWithinPartitions("key", F.desc("seq")).write.mode("overwrite").parquet(f"{log_dir}/batch={number}")
        faulty.write.mode("overwrite").parquet(f"{log_dir}-faulty/batch={number}")
        batch.unpersist()

    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def read_log(spark: SparkSession, log_dir: str) -> DataFrame:
    return spark.read.option("basePath", log_dir).schema(LOG).parquet(f"{log_dir}/batch=*")
