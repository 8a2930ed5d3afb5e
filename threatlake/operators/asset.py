"""Cloud asset inventory to indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threatlake.functions.columns import blank_to_null, first_true, last_segment
from threatlake.sources.schemas import to_indicator_schema

# Ordered type rules (all of one group must occur) and console links.
TYPE_RULES = [
    ([["compute", "instance"]], "compute"),
    ([["storage", "bucket"]], "storage"),
    ([["container"], ["kubernetes"]], "container"),
    ([["sql"], ["database"]], "database"),
    ([["iam"], ["serviceaccount"]], "account"),
    ([["dns"]], "domain"),
    ([["network"], ["firewall"]], "network"),
    ([["kms"], ["key"]], "key"),
]
CONSOLE = "https://console.cloud.google.com"
CONSOLE_LINKS = [
    (
        "compute.googleapis.com/Instance",
        CONSOLE + "/compute/instancesDetail/zones/global/instances/%1$s?project=%2$s",
    ),
    ("storage.googleapis.com/Bucket", CONSOLE + "/storage/browser/%1$s?project=%2$s"),
    (
        "container.googleapis.com/Cluster",
        CONSOLE + "/kubernetes/clusters/details/global/%1$s?project=%2$s",
    ),
    ("sqladmin.googleapis.com", CONSOLE + "/sql/instances/%1$s/overview?project=%2$s"),
]
OTHER_LINK = CONSOLE + "/asset-inventory/overview?project=%2$s"
NEUTRAL_CONFIDENCE = 0.5
NEUTRAL_SEVERITY = "0"


def project_id(name: Column) -> Column:
    return blank_to_null(F.regexp_extract(name, "//[^/]+/projects/([^/]+)", 1))


def reference_url(name: Column, asset_type: Column) -> Column:
    """Console link; null without a project."""
    arguments = (last_segment(name), project_id(name))
    link = F.format_string(OTHER_LINK, *arguments)
    for part, template in reversed(CONSOLE_LINKS):
        link = F.when(asset_type.contains(part), F.format_string(template, *arguments)).otherwise(
            link
        )
    return F.when((asset_type != "") & project_id(name).isNotNull(), link)


def indicator_type(asset_type: Column) -> Column:
    lowered = F.lower(asset_type)
    rules = []
    for groups, label in TYPE_RULES:
        any_group = F.lit(False)
        for group in groups:
            every = F.lit(True)
            for part in group:
                every = every & lowered.contains(part)
            any_group = any_group | every
        rules.append((any_group, label))
    return first_true(rules, "gcp_resource")


def indicator_value(name: Column) -> Column:
    return F.when(name != "", last_segment(name)).otherwise("unknown")


def description(name: Column, asset_type: Column, display_name: Column) -> Column:
    shown = F.coalesce(blank_to_null(display_name), indicator_value(name))
    kind = F.when(asset_type != "", last_segment(asset_type)).otherwise("Resource")
    return F.concat(F.lit("GCP "), kind, F.lit(": "), shown)


def location(
    zone: Column, region: Column, location_name: Column, name: Column
) -> Column:
    """Region of the zone, else the region, else the location, else what the name says."""
    return F.coalesce(
        F.regexp_replace(zone, "-[^-]*$", ""),
        region,
        location_name,
        blank_to_null(F.regexp_extract(name, "/locations/([^/]+)/", 1)),
    )


def tags(name: Column, asset_type: Column, place: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(asset_type.contains("/"), F.lower(last_segment(asset_type))),
            F.when(
                asset_type.contains("."),
                blank_to_null(F.lower(F.substring_index(asset_type, ".", 1))),
            ),
            F.concat(F.lit("project_"), project_id(name)),
            F.concat(F.lit("location_"), blank_to_null(place)),
        )
    )


def first_seen(
    time_created: Column, creation_timestamp: Column, create_time: Column, update_time: Column
) -> Column:
    return F.coalesce(time_created, creation_timestamp, create_time, update_time)


def normalize(
    assets: DataFrame, processed_at: Column | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Indicators of assets (columns of ``ASSET``); those without a name or type are dropped."""
    rows = assets.where((F.col("name") != "") & (F.col("assetType") != ""))
    name, kind = F.col("name"), F.col("assetType")
    data = F.col("resource.data")
    place = location(data["zone"], data["region"], data["location"], name)
    created = first_seen(
        data["timeCreated"], data["creationTimestamp"], data["createTime"], F.col("updateTime")
    )
    return to_indicator_schema(
        rows.select(
            *keep,
            F.lit("gcp_asset").alias("source"),
            indicator_type(kind).alias("indicator_type"),
            indicator_value(name).alias("indicator_value"),
            F.lit("cloud_asset").alias("threat_category"),
            F.lit(0).alias("malicious_verdicts"),
            F.lit(1).alias("total_verdicts"),
            F.lit(NEUTRAL_CONFIDENCE).alias("confidence_score"),
            F.lit(NEUTRAL_SEVERITY).alias("severity"),
            tags(name, kind, place).alias("tags"),
            place.alias("country"),
            reference_url(name, kind).alias("source_reference"),
            description(name, kind, F.col("displayName")).alias("description"),
            F.coalesce(blank_to_null(created), F.col("updateTime")).alias("first_seen"),
            F.col("updateTime").alias("last_seen"),
            (F.lit(None) if processed_at is None else processed_at).alias("processed_at"),
        ),
        keep,
    )
