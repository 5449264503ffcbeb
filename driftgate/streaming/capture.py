"""Incremental capture: log files that arrive are parsed, redacted and added to a baseline.

Each micro-batch is deduplicated against the store by an anti-join, so a batch that runs again after
a failure adds nothing twice and no state grows with the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftgate.functions import redaction
from driftgate.sources import cases, logs, store

#: What a stored case keeps of a log line.
KEPT = ("case_id", "position", "messages", "base_text", "base_tools", "base_finish", "reference", "tags", *logs.INPUT, *cases.COLUMNS)


def prepared(rows: DataFrame) -> DataFrame:
    """Parsed lines to redacted cases; ids that were derived follow the redacted input."""
    return logs.accepted(redaction.redact_case(rows.where("reason is null")))


def capture(spark: SparkSession, source: str, baseline_path: str, checkpoint: str, once: bool = True, rejects: str | None = None) -> StreamingQuery:
    """Start the capture of a folder of JSON lines; ``once`` takes what is there and ends.

    Lines that can't be cases are appended to ``rejects``, a Parquet table of number (of the batch),
    position and reason; a batch that runs again replaces its own.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = spark.readStream.text(source).select("value", "_metadata").where(F.trim("value") != "")

    def add(batch: DataFrame, number: int) -> None:
        # parsed once, then read for the texts to redact, for the cases and for the rejects
        kept = logs.parsed(batch.select(place.alias("position"), "value")).persist()
        try:
            store.extend(spark, prepared(kept).select(*KEPT), baseline_path)
            if rejects:
                bad = logs.rejected(kept).withColumn("number", F.lit(number).cast("long"))
                bad.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("number").parquet(rejects)
        finally:
            kept.unpersist()

    writer = lines.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
