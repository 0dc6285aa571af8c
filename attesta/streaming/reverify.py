"""Captured pages as a stream: each micro-batch of snapshots is checked against the claims that cite it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import claims as K


def snapshot_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(K.SNAPSHOT_SCHEMA).parquet(folder)


def reverify(stream: DataFrame, claims: DataFrame, leads: DataFrame, today: str, out: str, checkpoint: str) -> StreamingQuery:
    """Writes checked claims of the arrived snapshots to out/batch=N, over again if a batch is repeated."""
    spark = claims.sparkSession
    rules = K.policy(spark)

    def each(batch: DataFrame, number: int) -> None:
        cited = claims.join(batch.selectExpr("scope", "id as snapshot").distinct(), ["scope", "snapshot"], "left_semi").select(*claims.columns)
        K.verify(cited, batch, rules, today, leads).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
