"""Audit events to violation notifications as they arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from threatlake.functions.columns import is_json
from threatlake.operators import asof, policy
from threatlake.sources import messages
from threatlake.sources.schemas import AUDIT_EVENT, RESOURCE_CONFIG
from threatlake.streaming import guard

EVENT_SCHEMA = "event_id bigint, ts timestamp, data string"


def named_events(events: DataFrame) -> DataFrame:
    """Events (event_id, ts, data) whose resource a configuration can be looked up for.

    Audit-log entries count only for the methods that change a resource; notifications of stored
    objects have no method.  A message that is not base64 JSON has no resource name either.
    """
    event = F.from_json(messages.decoded(F.col("data")), AUDIT_EVENT)
    parsed = events.select("event_id", "ts", event.alias("event")).select(
        "event_id",
        "ts",
        policy.resource_name(F.col("event")).alias("resource_name"),
        F.col("event.protoPayload.serviceName").alias("service"),
        F.col("event.protoPayload.methodName").alias("method"),
        F.col("event.protoPayload").isNull().alias("stored"),
    )
    audited = F.col("stored") | policy.is_audited(F.col("service"), F.col("method"))
    named = parsed.where(audited).select("event_id", "ts", "resource_name")
    return named.where(policy.has_project(F.col("resource_name")))


def check_events(
    named: DataFrame, history: DataFrame, signatures: DataFrame | None = None
) -> DataFrame:
    """Named events against the configuration history, with their violations.

    ``history`` has resource_name, ts, version and config (JSON text).  Events without a
    configuration go no further.  With ``signatures`` (image, issuer, identity) the images of the
    resources are checked too.
    """
    matched = asof.as_of(named, history, "resource_name", "ts", ["version", "config"], "version")
    rows = matched.where(F.col("version").isNotNull()).select(
        "*",
        policy.resource_type(F.col("resource_name")).alias("resource_type"),
        F.from_json("config", RESOURCE_CONFIG).alias("parsed"),
        is_json(F.col("config")).alias("readable"),
    )
    found = policy.evaluate(F.col("resource_type"), F.col("parsed"), F.col("readable"))
    rows = rows.withColumn("policy_violations", found)
    if signatures is None:
        return policy.results(rows, ["policy_violations"])
    imaged = rows.withColumn("image", policy.image_of(F.col("parsed")))
    both = policy.with_supply_chain(imaged, signatures)
    return policy.results(both, ["policy_violations", "supply_chain_violations"])


def enforce(
    spark: SparkSession,
    events_path: str,
    history: DataFrame,
    out_path: str,
    checkpoint: str,
    timestamp: Column | None = None,
    signatures: DataFrame | None = None,
    delay: str = "1 hour",
) -> StreamingQuery:
    """Start the stream; non-compliant resources of every batch are written out.

    An event that is delivered again within ``delay`` is not checked again (``guard.once``).
    """
    arriving = spark.readStream.schema(EVENT_SCHEMA).json(events_path)
    events = guard.once(arriving, "event_id", "ts", delay)

    def publish(batch: DataFrame, batch_id: int) -> None:
        named = named_events(batch).persist()
        # The history is large and a batch small: only the batch's resources are looked up.
        wanted = named.select("resource_name").distinct()
        checked = check_events(named, history.join(wanted, "resource_name", "left_semi"), signatures)
        stamp = F.unix_timestamp(F.current_timestamp()) if timestamp is None else timestamp
        try:
            (
                policy.notifications(checked, stamp)
                .withColumn("batch_id", F.lit(batch_id))
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("batch_id")
                .parquet(out_path)
            )
        finally:
            named.unpersist()

    return (
        events.writeStream.foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
