"""A stream of file versions against a snapshot.

Each micro-batch holds (path, hash) of files that were seen, with ``hash`` null for those
that are gone.  The batch is joined with the state table, its changes are appended to the
change log, and the next state is written beside the old one and named by a marker, so a
batch that is run again after a failure starts from the same state and gives the same
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

STATE = "path string, hash string"


def _state(spark: SparkSession, at: str, batch: int) -> DataFrame:
    """The newest state before ``batch``."""
    try:
        all_ = spark.read.schema(STATE + ", batch long").parquet(f"{at}/state")
        last = all_.filter(F.col("batch") < batch).agg(F.max("batch")).first()[0]
    except AnalysisException:
        last = None
    if last is None:
        return spark.createDataFrame([], STATE)
    return all_.filter(F.col("batch") == last).drop("batch")


def apply_batch(batch: DataFrame, number: int, at: str) -> None:
    """Changes of one micro-batch to ``at``/changes, and the next state to ``at``/state."""
    spark = batch.sparkSession
    seen = batch.groupBy("path").agg(F.max_by("hash", "seq").alias("hash"))
    old = _state(spark, at, number)
    both = seen.withColumnRenamed("hash", "new_hash").withColumn("seen", F.lit(True)).join(old.withColumnRenamed("hash", "old_hash"), "path", "full_outer").cache()
    status = F.when(F.col("old_hash").isNull() & F.col("new_hash").isNotNull(), "new").when(F.col("new_hash").isNull() & F.col("old_hash").isNotNull(), "deleted").when(F.col("old_hash") != F.col("new_hash"), "modified")
    changes = both.filter("seen").select("path", status.alias("status"), "old_hash", "new_hash").filter("status IS NOT NULL")
    changes.write.mode("overwrite").parquet(f"{at}/changes/batch={number}")
    following = both.select("path", F.when(F.col("seen"), F.col("new_hash")).otherwise(F.col("old_hash")).alias("hash")).filter("hash IS NOT NULL")
    following.write.mode("overwrite").parquet(f"{at}/state/batch={number}")
    both.unpersist()


def watch(versions: DataFrame, at: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Start the stream: ``versions`` has path, hash and seq (order within a batch)."""
    writer = versions.writeStream.foreachBatch(lambda df, n: apply_batch(df, n, at)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def change_log(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.schema("path string, status string, old_hash string, new_hash string, batch long").parquet(f"{at}/changes")
