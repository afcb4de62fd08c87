"""Granules as a stream: every micro-batch of new samples is regridded by itself and appended to the product.

A granule's product depends on that granule alone, so there is no state between batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..config import Config
from ..operators import neighbours
from ..plans.regrid import regrid


def regrid_stream(spark: SparkSession, samples: DataFrame, config: Config, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Regrid each batch of a streaming samples table into out/batch=<number>; a batch that runs again replaces its own folder."""

    def each(batch: DataFrame, number: int) -> None:
        regrid(spark, batch, config).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = samples.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def cell_means(samples: DataFrame, grid: str, variables: list[str], time: str = "acq_time_utc", late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Means by cell and day over a stream, with samples later than `late` dropped: a daily drop-in-bucket map."""
    placed = neighbours.assign_cells(samples.withWatermark(time, late), grid)
    by = placed.groupBy(F.window(time, window), "cell_row", "cell_col")
    return by.agg(*(F.avg(v).alias(v) for v in variables), F.count("*").alias("regridding_n_samples"))
