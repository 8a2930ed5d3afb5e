"""OTX pulses to indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threatlake.functions.columns import blank_to_null, clamp01, empty_array, first_true, lookup
from threatlake.functions.columns import word_list
from threatlake.operators.entities import explode_array
from threatlake.sources.schemas import to_indicator_schema

# Feed type to indicator type, tags that decide category and severity.
TYPES = {
    "IPv4": "ipv4",
    "IPv6": "ipv6",
    "domain": "domain",
    "hostname": "domain",
    "URL": "url",
    "FileHash-MD5": "filehash_md5",
    "FileHash-SHA1": "filehash_sha1",
    "FileHash-SHA256": "filehash_sha256",
}
CATEGORY_TAGS = [
    (["malware", "ransomware"], "malware"),
    (["phishing"], "phishing"),
    (["c2", "command and control"], "c2"),
    (["exploit"], "exploit_kit"),
    (["apt"], "apt"),
    (["scan", "scanner"], "scanner"),
    (["botnet"], "botnet"),
]
NETWORK_TYPES = ["IPv4", "IPv6", "domain", "hostname", "URL"]
HIGH_TAGS = ["ransomware", "exploit", "zero-day", "apt", "critical"]
MEDIUM_TAGS = ["malware", "c2", "phishing", "botnet"]
PULSE_URL = "https://otx.alienvault.com/pulse/"


def indicator_type(feed_type: Column) -> Column:
    """Null for a type that is not supported."""
    return lookup(TYPES, feed_type)


def _lower(tags: Column) -> Column:
    return F.transform(F.coalesce(tags, empty_array("string")), F.lower)


def category(tags: Column, feed_type: Column) -> Column:
    lowered = _lower(tags)
    rules = [(F.arrays_overlap(lowered, word_list(t)), name) for t, name in CATEGORY_TAGS]
    rules += [
        (feed_type.isin(NETWORK_TYPES), "suspicious_network_activity"),
        (feed_type.startswith("FileHash"), "suspicious_file"),
    ]
    return first_true(rules, "unknown")


def _many(tags: Column) -> Column:
    return F.coalesce(F.size(tags) > 3, F.lit(False))


def confidence(adversary: Column, tags: Column) -> Column:
    named = F.coalesce(adversary != "", F.lit(False))
    score = F.lit(0.5) + F.when(named, 0.1).otherwise(0.0) + F.when(_many(tags), 0.1).otherwise(0.0)
    return clamp01(score)


def severity(tags: Column) -> Column:
    lowered = _lower(tags)
    return first_true(
        [
            (F.arrays_overlap(lowered, word_list(HIGH_TAGS)), "high"),
            (F.arrays_overlap(lowered, word_list(MEDIUM_TAGS)) | _many(tags), "medium"),
        ],
        "low",
    )


def pulse_indicators(pulses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per indicator of a pulse, the pulse's own fields repeated."""
    items = pulses.select(*keep, "id", "name", "description", "tags", "created", "adversary",
                          "indicators")
    return explode_array(items, "indicators")


def normalize(
    pulses: DataFrame, processed_at: Column | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Indicators of pulses (columns of ``OTX_PULSE``); unsupported types are dropped."""
    rows = pulse_indicators(pulses, keep)
    tags, feed_type = F.col("tags"), F.col("type")
    rows = rows.withColumn("indicator_type", indicator_type(feed_type))
    rows = rows.where(F.col("indicator_type").isNotNull())
    return to_indicator_schema(
        rows.select(
            *keep,
            F.lit("alienvault").alias("source"),
            "indicator_type",
            F.col("indicator").alias("indicator_value"),
            category(tags, feed_type).alias("threat_category"),
            confidence(F.col("adversary"), tags).alias("confidence_score"),
            severity(tags).alias("severity"),
            F.sort_array(F.array_distinct(F.coalesce(tags, empty_array("string")))).alias("tags"),
            F.concat(F.lit(PULSE_URL), "id").alias("source_reference"),
            F.coalesce(blank_to_null(F.col("description")), "name").alias("description"),
            F.col("created").alias("last_seen"),
            (F.lit(None) if processed_at is None else processed_at).alias("processed_at"),
        ),
        keep,
    )
