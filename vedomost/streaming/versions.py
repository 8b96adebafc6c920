"""Versions that arrive as a stream, merged as they come. Beyond the batch engine's reference behaviour.

Each micro-batch appends its versions to a table partitioned by a hash of the permit number, reads back the buckets it touched and merges only the
permits it touched, so the state is a plain table that survives any loss, and the result equals the batch merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from vedomost.operators.merge import merge_versions

BUCKETS = 64


def merge_stream(versions: DataFrame, state: str, output: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Runs the incremental merge of a streaming DataFrame of versions.

    ``state`` keeps all versions, ``output`` the merged permits by batch (the highest ``batch`` of a number is current, see
    ``current_merged``). A batch that is run again after a failure overwrites its own part.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("bucket", F.pmod(F.xxhash64("number"), F.lit(BUCKETS)).cast("int"))
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{state}/batch={batch_id}/")
        mine = spark.read.schema(new.schema).option("basePath", state).parquet(f"{state}/batch={batch_id}/")
        buckets = [r[0] for r in mine.select("bucket").distinct().collect()]  # BUCKETS numbers at most
        seen = spark.read.schema(StructType([*new.schema.fields, StructField("batch", LongType())])).option("basePath", state).parquet(state).where((F.col("batch") <= batch_id) & F.col("bucket").isin(buckets))
        merged = merge_versions(seen.drop("batch", "bucket").join(mine.select("number").distinct(), "number", "left_semi"))
        merged.write.mode("overwrite").parquet(f"{output}/batch={batch_id}/")

    writer = versions.writeStream.option("checkpointLocation", checkpoint).foreachBatch(one)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


def current_merged(merged: DataFrame) -> DataFrame:
    """The latest merge of each permit."""
    columns = [c for c in merged.columns if c not in ("number", "batch")]
    top = merged.groupBy("number").agg(F.max_by(F.struct(*columns), "batch").alias("m"))
    return top.select("number", "m.*")
