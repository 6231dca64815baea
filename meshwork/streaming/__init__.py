"""Structures as they arrive: each new file is one structure of its own, so no state is kept between batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meshwork.functions import file_stem
from meshwork.sources.structures import FILES, residues


def watch(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None], once: bool = False) -> StreamingQuery:
    """Calls handle(residues, batch number) for the structures of every batch of new files."""
    stream = spark.readStream.option("pathGlobFilter", FILES).option("wholetext", "true").text(folder)
    stream = stream.select(file_stem(F.col("_metadata.file_name")).alias("structure_id"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: handle(residues(batch), n))
    return (writer.trigger(availableNow=True) if once else writer).start()
