"""Voxel queries over a stream of observations against a static run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from arborlake.operators import voxel


def answer_stream(obs: DataFrame, points: DataFrame, cylinders: DataFrame, out_path: str, checkpoint: str, sizes: tuple[float, ...] = voxel.SIZES, default_h: float = voxel.DEFAULT_HEIGHT) -> StreamingQuery:
    """Each micro-batch of observations is one batch query; its answers go to a Parquet
    folder of its own number, so that a batch that is run again replaces its files."""

    def one(batch: DataFrame, number: int) -> None:
        voxel.batch_query(batch, points, cylinders, sizes, default_h).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return obs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
