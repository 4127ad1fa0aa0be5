"""Run records as a stream: scored as they arrive by the same projection that scores tables.

New files of JSON lines are picked up once each; the checkpoint decides what is new, so a restarted
stream goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scoring import scored_side
from ..sources.records import RUN


def incoming(spark: SparkSession, folder: str, schema: str = RUN, files_at_once: int | None = None) -> DataFrame:
    """A stream of records from a folder that gains files."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).json(folder)


def score_arrivals(spark: SparkSession, folder: str, target: str, checkpoint: str, schema: str = RUN, once: bool = True):
    """Append scored records to Parquet; returns the running query. ``once``: take what is there and stop."""
    writer = scored_side(incoming(spark, folder, schema)).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def anomaly_rates(records: DataFrame, time: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(start, n, odd) by window of event time; records later than ``late`` behind the newest are left out, which bounds the state."""
    scored = scored_side(records.withWatermark(time, late))
    return scored.groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.size("anomalies") > 0).alias("odd")).select(F.col("w.start").alias("start"), "n", "odd")
