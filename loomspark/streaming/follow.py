"""Follow a folder of snapshots: a file stream wakes the batch build whenever one arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from loomspark.plans import ingest_plan


def follow(spark: SparkSession, root: str, dictionary: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Every micro-batch with new deck files rebuilds the artifact from all snapshots: the gate
    needs the whole sequence, and a late snapshot then falls into its place by name. ``once``
    takes what is there and stops."""

    def rebuild(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            ingest_plan.run(spark, root, dictionary, out)

    lines = spark.readStream.schema("value string").format("text").option("wholetext", True).load(f"{root}/*/decks.json")
    writer = lines.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
