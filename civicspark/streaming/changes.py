"""Change detection on a stream of probes, with the known state kept per URL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.operators import store


def stream_changes(probes: DataFrame, table: store.Table, log: store.Table, checkpoint: str):
    """Logs what each micro-batch of probes changes in the inventory, and updates it.

    ``probes`` is a stream with the inventory's columns.  Changes are logged
    with their batch's number; a batch that is delivered again after a failure
    finds its number in the log and logs nothing, and bringing the inventory up
    to date twice gives the same one.  Within a batch the last probe of a URL
    counts; one without an instant comes before all others.
    """

    def apply(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("pdf_url").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "pdf_url"]), F.coalesce("last_checked", F.timestamp_seconds(F.lit(0)))).alias("x")).select("pdf_url", "x.*")
        known = table.read() if table.current() else last.limit(0)
        logged = log.current() is not None and not log.read().where(F.col("batch") == number).isEmpty()
        if not logged:
            # also an empty batch begins the log, so its number is known
            log.append(store.change_log(known, last).withColumn("batch", F.lit(number).cast("long")))
        table.replace(store.upsert_coalesced(known, last, "pdf_url", ["first_seen"]))

    return probes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events and their total value in tumbling windows; events later than ``late`` may be left out of a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
