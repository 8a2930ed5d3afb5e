"""IP address reports to indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threatlake.functions.columns import blank_to_null, clamp01, empty_array, first_true
from threatlake.sources.schemas import VT_REPORT, to_indicator_schema

# Engine categories that say nothing, and the link of a report.
NEUTRAL_CATEGORIES = ["undetected", "harmless", "timeout"]
REPORT_URL = "https://www.virustotal.com/gui/ip-address/"


def stat(stats: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(stats, F.lit(name)), F.lit(0))


def total(stats: Column) -> Column:
    """Sum of every count, whatever its name."""
    counts = F.coalesce(F.map_values(stats), empty_array("int"))
    return F.aggregate(counts, F.lit(0), lambda s, n: s + F.coalesce(n, F.lit(0)))


def confidence(malicious: Column, suspicious: Column, engines: Column) -> Column:
    bad = malicious + suspicious * F.lit(0.5)
    return F.when(engines == 0, 0.0).otherwise(clamp01(F.try_divide(bad, engines)))


def severity(malicious: Column, suspicious: Column) -> Column:
    return first_true(
        [(malicious >= 10, "high"), (malicious > 0, "medium"), (suspicious > 0, "low")],
        "informational",
    )


def engine_categories(categories: Column) -> Column:
    """Distinct lower-case categories that carry a verdict."""
    telling = F.filter(
        categories, lambda c: c.isNotNull() & (c != "") & ~c.isin(NEUTRAL_CATEGORIES)
    )
    return F.coalesce(F.array_distinct(F.transform(telling, F.lower)), empty_array("string"))


def category(
    malicious: Column, suspicious: Column, harmless: Column, categories: Column
) -> Column:
    """``categories`` as returned by :func:`engine_categories`."""
    named = (
        F.when(F.array_contains(categories, "malware"), "malware")
        .when(F.array_contains(categories, "phishing"), "phishing")
        .otherwise(F.coalesce(F.array_min(categories), F.lit("malicious_generic")))
    )
    return (
        F.when(malicious > 0, named)
        .when(suspicious > 0, "suspicious_generic")
        .when(harmless > 0, "benign")
        .otherwise("unknown")
    )


def tags(country: Column, owner: Column, categories: Column) -> Column:
    labels = F.array(
        F.concat(F.lit("geo:"), blank_to_null(country)),
        F.concat(F.lit("asn_owner:"), blank_to_null(owner)),
    )
    return F.sort_array(F.array_distinct(F.concat(F.array_compact(labels), categories)))


def last_seen(unix_seconds: Column) -> Column:
    """ISO time in UTC; zero and null give null."""
    return F.when(
        unix_seconds != 0,
        F.date_format(
            F.to_utc_timestamp(F.timestamp_seconds(unix_seconds), F.current_timezone()),
            "yyyy-MM-dd'T'HH:mm:ss'+00:00'",
        ),
    )


def description(
    malicious: Column, suspicious: Column, harmless: Column, undetected: Column
) -> Column:
    counts = {"M": malicious, "S": suspicious, "H": harmless, "U": undetected}
    parts = [F.concat(F.lit(f"{k}:"), v.cast("string")) for k, v in counts.items()]
    return F.concat(F.lit("VT analysis: "), F.concat_ws(", ", *parts))


def reference_url(address: Column) -> Column:
    return F.concat(F.lit(REPORT_URL), address)


def reports_in(content: Column) -> Column:
    """Reports of a document that holds either one report or a list of them."""
    is_list = F.ltrim(content).startswith("[")
    return F.when(is_list, F.from_json(content, f"array<{VT_REPORT}>")).otherwise(
        F.array(F.from_json(content, VT_REPORT))
    )


def normalize(
    reports: DataFrame, processed_at: Column | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Indicators of reports (column ``data``); anything but an IP address report is dropped."""
    attributes = F.col("data.attributes")
    stats = attributes["last_analysis_stats"]
    found = F.map_values(attributes["last_analysis_results"])
    rows = reports.where(F.col("data.type") == "ip_address").select(
        *keep,
        F.col("data.id").alias("address"),
        *[
            stat(stats, n).alias(n)
            for n in ("malicious", "suspicious", "harmless", "undetected")
        ],
        total(stats).alias("engines"),
        engine_categories(F.transform(found, lambda r: r["category"])).alias("categories"),
        attributes["country"].alias("country"),
        attributes["asn"].alias("asn"),
        attributes["as_owner"].alias("asn_owner"),
        attributes["last_analysis_date"].alias("analysed"),
    )
    malicious, suspicious, harmless = F.col("malicious"), F.col("suspicious"), F.col("harmless")
    return to_indicator_schema(
        rows.select(
            *keep,
            F.lit("virustotal").alias("source"),
            F.lit("ipv4").alias("indicator_type"),
            F.col("address").alias("indicator_value"),
            category(malicious, suspicious, harmless, F.col("categories")).alias(
                "threat_category"
            ),
            malicious.alias("malicious_verdicts"),
            F.col("engines").alias("total_verdicts"),
            confidence(malicious, suspicious, F.col("engines")).alias("confidence_score"),
            severity(malicious, suspicious).alias("severity"),
            tags(F.col("country"), F.col("asn_owner"), F.col("categories")).alias("tags"),
            "country",
            "asn",
            "asn_owner",
            reference_url(F.col("address")).alias("source_reference"),
            description(malicious, suspicious, harmless, F.col("undetected")).alias(
                "description"
            ),
            last_seen(F.col("analysed")).alias("last_seen"),
            (F.lit(None) if processed_at is None else processed_at).alias("processed_at"),
        ),
        keep,
    )
