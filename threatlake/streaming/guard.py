"""Messages that come more than once, taken once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from threatlake.sources import messages, tables

MESSAGE_SCHEMA = "message_id string, publish_time timestamp, data string"


def once(events: DataFrame, id_col: str, time_col: str, delay: str) -> DataFrame:
    """The first delivery of every event; a redelivered event has its id and its time.

    Ids are remembered until ``delay`` after their time has passed, on the clock of the events
    themselves, so the state holds the ids of that period and no more.  What comes later than that
    is not taken, whether it came before or not, since nothing tells any more: ``late_rows`` counts
    it.  Events without an id are told apart by their whole content.  In a batch DataFrame there is
    no lateness and every id is taken once.
    """
    # Of one type, and no id can look like a digest of content.
    own = F.concat(F.lit("id:"), F.col(id_col).cast("string"))
    content = F.concat(F.lit("row:"), F.sha2(F.to_json(F.struct(*events.columns)), 256))
    keyed = events.withColumn("_delivery", F.coalesce(own, content))
    if not events.isStreaming:
        return keyed.dropDuplicates(["_delivery"]).drop("_delivery")
    marked = keyed.withWatermark(time_col, delay)
    return marked.dropDuplicatesWithinWatermark(["_delivery"]).drop("_delivery")


def late_rows(query: StreamingQuery) -> int:
    """Rows that a run left out because they came after the delay.

    The run's progress reports are counted; a session keeps as many of them as
    ``spark.sql.streaming.numRecentProgressUpdates`` says.
    """
    states = [s for p in query.recentProgress for s in p["stateOperators"]]
    return sum(s["numRowsDroppedByWatermark"] for s in states)


def land_messages(
    spark: SparkSession,
    path: str,
    table_path: str,
    checkpoint: str,
    delay: str = "1 hour",
    received_at: Column | None = None,
) -> StreamingQuery:
    """Start the stream of messages to a table: each once, those that are base64 JSON, with ``body``.

    A batch owns its partition of the table and replaces it when it is run again.
    """
    arriving = spark.readStream.schema(MESSAGE_SCHEMA).json(path)
    bodies = messages.decode(once(arriving, "message_id", "publish_time", delay)).drop("data")
    stamp = F.current_timestamp() if received_at is None else received_at

    def land(batch: DataFrame, batch_id: int) -> None:
        tables.append_indicators(batch.withColumn("received_at", stamp), table_path, batch_id)

    return (
        bodies.writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
