"""Run a stream over everything that is there, then read the result as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from deskmill.session import fresh_dir


def run_available(stream: DataFrame, name: str, checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Append the stream's rows to Parquet until the present input is used up."""
    spark = stream.sparkSession
    out = out or fresh_dir(spark, f"{name}-out")
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint or fresh_dir(spark, f"{name}-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
