"""Security findings put together with the assets they are about, and a risk score.

The original only announces this step, without a rule, so matching and formula are this library's
own.  A finding belongs to the asset with the longest name that is its resource's name or one of
its ancestors: ``//service/projects/p`` holds ``//service/projects/p/items/i``.

score = severity weight + 0.1 if the asset can be reached from outside + 0.1 if the finding is about
exposure, 1 at most; a finding without an asset has its severity weight alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threatlake.functions.columns import lookup

SALTS = 16

# The formula's own values.
SEVERITY_WEIGHTS = {"CRITICAL": "0.8", "HIGH": "0.6", "MEDIUM": "0.4", "LOW": "0.2"}
REACHABLE_TYPES = ["compute.googleapis.com/Instance", "storage.googleapis.com/Bucket", "sqladmin.googleapis.com/Instance"]
EXPOSURE = ["PUBLIC", "OPEN", "EXPOSED"]
MITIGATIONS = {"CRITICAL": "isolate now", "HIGH": "fix within a day", "MEDIUM": "fix within a week", "LOW": "plan a fix"}


def ancestors(name: Column) -> Column:
    """array<struct<depth, name>> of a resource name and all that it lies in, service names alone left out."""
    parts = F.split(name, "/", -1)
    return F.transform(
        F.filter(F.sequence(F.lit(4), F.greatest(F.size(parts), F.lit(4))), lambda n: n <= F.size(parts)),
        lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("name")),
    )


def with_asset(findings: DataFrame, assets: DataFrame, key: str, name_col: str = "resource_name") -> DataFrame:
    """Add ``asset`` and ``asset_type`` of the nearest asset, null where there is none.

    Assets have ``name`` and ``asset_type``; of assets with one name the first type by name counts.  The
    ancestors are looked up once per resource, not per finding.  A project may hold a third of all
    resources, so every ancestor is joined under one of ``SALTS`` numbers, and every asset stands under
    each.  Findings without a resource match nothing and are spread by ``key``.
    """
    known = assets.where(F.col("name").isNotNull()).groupBy("name").agg(F.min("asset_type").alias("asset_type"))
    spread = known.select("name", "asset_type", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    resource = F.col(name_col)
    names = findings.where(resource.isNotNull()).select(resource.alias("_resource")).distinct()
    every = names.select(
        "_resource",
        F.pmod(F.xxhash64("_resource"), F.lit(SALTS)).cast("int").alias("_salt"),
        F.explode(ancestors(F.col("_resource"))).alias("_a"),
    )
    met = every.select("_resource", "_salt", F.col("_a.depth").alias("_depth"), F.col("_a.name").alias("name"))
    none = F.lit(0).cast("bigint")
    nearest = (
        met.join(spread, ["name", "_salt"])
        .groupBy("_resource")
        .agg(F.max_by(F.struct("name", "asset_type"), "_depth").alias("_asset"))
        .withColumn("_spread", none)
    )
    keyed = findings.withColumns(
        {"_resource": resource, "_spread": F.when(resource.isNull(), F.xxhash64(key)).otherwise(none)}
    )
    joined = keyed.join(nearest, ["_resource", "_spread"], "left")
    return joined.select(*findings.columns, F.col("_asset.name").alias("asset"), F.col("_asset.asset_type").alias("asset_type"))


def risk_score(severity: Column, category: Column, asset_type: Column) -> Column:
    weight = F.coalesce(lookup(SEVERITY_WEIGHTS, F.upper(severity)), F.lit("0.1")).cast("decimal(4,1)")
    shown = F.lit(False)
    for word in EXPOSURE:
        shown = shown | F.coalesce(F.contains(F.upper(category), F.lit(word)), F.lit(False))
    tenth = F.lit("0.1").cast("decimal(4,1)")
    more = F.when(asset_type.isin(REACHABLE_TYPES), tenth).otherwise(0) + F.when(asset_type.isNotNull() & shown, tenth).otherwise(0)
    return F.least(weight + more, F.lit(1)).cast("double")


def correlate(findings: DataFrame, assets: DataFrame, key: str) -> DataFrame:
    """Findings (``key``, resource_name, severity, category) with asset, risk_score and mitigation."""
    rows = with_asset(findings, assets, key)
    score = risk_score(F.col("severity"), F.col("category"), F.col("asset_type"))
    advice = F.coalesce(lookup(MITIGATIONS, F.upper("severity")), F.lit("review"))
    return rows.withColumns({"risk_score": score, "mitigation": advice})
