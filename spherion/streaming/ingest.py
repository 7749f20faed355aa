"""Vectors from a stream into an inverted-file index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spherion.operators.ivf import IvfIndex


def stream_into(index: IvfIndex, vectors: DataFrame, checkpoint: str, id_col: str = "vec_id", vec_col: str = "embedding", once: bool = False) -> StreamingQuery:
    """Appends each micro-batch to the index.  Ids that the index holds are left out, so it gets each id once, also where a
    batch is tried again after a failure.  Of the index only rows between the batch's least and greatest id are looked at
    (Parquet's statistics skip the rest), which are few where ids rise with time."""

    def add(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates([id_col])
        ends = new.agg(F.min(id_col).alias("least"), F.max(id_col).alias("most")).first()
        if ends["least"] is None:
            return
        known = index.rows().where(F.col("id").between(ends["least"], ends["most"])).select("id")
        index.insert(new.join(known, new[id_col] == known["id"], "left_anti"), id_col, vec_col)

    writer = vectors.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
