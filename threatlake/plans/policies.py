"""Queries over audit events, configurations and policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threatlake.operators import asof, policy
from threatlake.plans import bridge
from threatlake.plans.registry import query
from threatlake.sources.schemas import AUDIT_EVENT

CONFIGS = bridge.ansi(bridge.CONFIGS)
AUDIT = bridge.ansi(bridge.AUDIT)
HISTORY = bridge.ansi(bridge.HISTORY)


def configs(spark: SparkSession, sf: str) -> DataFrame:
    """Configurations in their nested shape, with resource name and type."""
    flat = bridge.view(spark, sf, bridge.CONFIGS)
    binding = F.struct(F.col("role").alias("role"), F.split("members_bar", r"\|", -1).alias("members"))
    access = F.when(
        F.col("access_type").isNotNull(),
        F.array(F.struct(F.col("access_type").alias("type"), F.lit("nat").alias("name"))),
    ).otherwise(F.array().cast("array<struct<type:string,name:string>>"))
    interface = F.struct(F.lit("default").alias("network"), access.alias("accessConfigs"))
    container = F.struct(F.col("image").alias("image"))
    config = F.struct(
        F.struct(F.array(binding).alias("bindings")).alias("iamConfiguration"),
        F.array(interface).alias("networkInterfaces"),
        F.struct(
            F.col("secure_boot").alias("enableSecureBoot"),
            F.col("vtpm").alias("enableVtpm"),
            F.col("integrity").alias("enableIntegrityMonitoring"),
        ).alias("shieldedInstanceConfig"),
        F.struct(
            F.struct(
                F.struct(F.array(container).alias("containers")).alias("spec")
            ).alias("template")
        ).alias("spec"),
    )
    return flat.select(
        "cfg_id",
        "resource_name",
        policy.resource_type(F.col("resource_name")).alias("resource_type"),
        config.alias("config"),
        "image",
    )


# --- events -----------------------------------------------------------------------------------------

_EVENT_NAME = (
    "CASE event_id % 6 WHEN 0 THEN concat('//compute.googleapis.com/projects/p/instances/v', user_id) WHEN 1 THEN concat('//storage.googleapis.com/projects/p/buckets/b', user_id)"
    " WHEN 2 THEN concat('projects/p/topics/t', user_id) WHEN 3 THEN concat('//storage.googleapis.com/projects/_/buckets/b', user_id, '/objects/o', event_id) END"
)


@query("pol_name", f"SELECT event_id, {_EVENT_NAME} AS resource_name FROM events")
def pol_name(spark: SparkSession, sf: str) -> DataFrame:
    """Names from the three places of an audit event and from storage events."""
    key = F.col("event_id") % 6
    body = (
        F.when(key == 0, F.format_string('{"protoPayload":{"resourceName":"//compute.googleapis.com/projects/p/instances/v%s"}}', "user_id"))
        .when(key == 1, F.format_string('{"protoPayload":{"resourceName":"","resource":{"name":"//storage.googleapis.com/projects/p/buckets/b%s"}}}', "user_id"))
        .when(key == 2, F.format_string('{"protoPayload":{"resource":{"name":""},"requestMetadata":{"callerSuppliedResourceName":"projects/p/topics/t%s"}}}', "user_id"))
        .when(key == 3, F.format_string('{"kind":"storage#object","bucket":"b%s","name":"o%s"}', "user_id", "event_id"))
        .when(key == 4, F.format_string('{"kind":"storage#object","bucket":"b%s"}', "user_id"))
        .otherwise(F.lit('{"protoPayload":{}}'))
    )
    events = bridge.table(spark, sf, "events").select("event_id", F.from_json(body, AUDIT_EVENT).alias("e"))
    return events.select("event_id", policy.resource_name(F.col("e")).alias("resource_name"))


_SERVICE = "CASE event_id % 3 WHEN 0 THEN 'compute.googleapis.com' WHEN 1 THEN 'storage.googleapis.com' ELSE 'run.googleapis.com' END"
_METHOD = "CASE event_id % 4 WHEN 0 THEN 'beta.compute.instances.insert' WHEN 1 THEN 'storage.setIamPermissions' WHEN 2 THEN 'beta.compute.instances.update' ELSE 'other' END"
_CALLS = f"SELECT event_id, {_SERVICE} AS service, {_METHOD} AS method FROM {{events}}"


@query(
    "pol_events",
    f"SELECT * FROM ({bridge.ansi(_CALLS)}) AS c WHERE (service = 'compute.googleapis.com' AND method LIKE 'beta.compute.instances.%')"
    " OR (service = 'storage.googleapis.com' AND method = 'storage.setIamPermissions')",
)
def pol_events(spark: SparkSession, sf: str) -> DataFrame:
    return policy.audited_events(bridge.view(spark, sf, _CALLS), "service", "method")


_NAMES = """
SELECT event_id, CASE event_id%10 WHEN 0 THEN concat('//compute.googleapis.com/projects/p/zones/z/instances/v', user_id) WHEN 1 THEN concat('//storage.googleapis.com/projects/p/buckets/b', user_id)
 WHEN 2 THEN concat('//compute.googleapis.com/projects/p/disks/d', user_id) WHEN 3 THEN concat('projects/p/instances/v', user_id) WHEN 4 THEN concat('//pubsub.googleapis.com/projects/p/topics/t', user_id)
 WHEN 5 THEN concat('//run.googleapis.com/projects/p/locations/l/services/s', user_id) WHEN 6 THEN concat('//container.googleapis.com/projects/p/clusters/c', user_id) WHEN 7 THEN concat('//sqladmin.googleapis.com/projects/p/databases/d', user_id)
 WHEN 8 THEN '//compute.googleapis.com/projects/p/instances' ELSE '/x' END AS resource_name
FROM {events}
"""
_TYPE = (
    "CASE WHEN resource_name LIKE '//%/instances/%' THEN 'compute.googleapis.com/Instance' WHEN resource_name LIKE '//%/buckets/%' THEN 'storage.googleapis.com/Bucket'"
    " WHEN resource_name LIKE '//%/disks/%' THEN 'compute.googleapis.com/Disk' WHEN resource_name LIKE '//%/topics/%' THEN 'pubsub.googleapis.com/Topic'"
    " WHEN resource_name LIKE '//%/services/%' THEN 'run.googleapis.com/Service' WHEN resource_name LIKE '//%/clusters/%' THEN 'container.googleapis.com/Cluster'"
    " WHEN resource_name LIKE '//%' THEN concat(split_part(resource_name, '/', 3), '/Unknown') ELSE 'unknown/Unknown' END"
)


@query("pol_type", f"SELECT event_id, {_TYPE} AS resource_type FROM ({bridge.ansi(_NAMES)}) AS n")
def pol_type(spark: SparkSession, sf: str) -> DataFrame:
    names = bridge.view(spark, sf, _NAMES)
    return names.select("event_id", policy.resource_type(F.col("resource_name")).alias("resource_type"))


@query(
    "pol_asof",
    f"SELECT a.event_id, a.rid, a.ts, h.version FROM ({AUDIT}) AS a"
    f" ASOF LEFT JOIN ({HISTORY}) AS h ON a.rid = h.rid AND a.ts >= h.ts",
)
def pol_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Every event with the version of its resource at that time."""
    events = bridge.view(spark, sf, bridge.AUDIT)
    history = bridge.view(spark, sf, bridge.HISTORY)
    return asof.as_of(events, history, "rid", "ts", ["version"], "version").select(
        "event_id", "rid", "ts", "version"
    )


@query(
    "pol_find",
    f"SELECT event_id, resource_type, p.policy_id FROM (SELECT event_id, {_TYPE} AS resource_type FROM ({bridge.ansi(_NAMES)}) AS n) AS t"
    " JOIN (VALUES ('compute.googleapis.com/Instance', 'vm_no_external_ip'), ('compute.googleapis.com/Instance', 'vm_shielded'),"
    " ('storage.googleapis.com/Bucket', 'bucket_public_access')) AS p(kind, policy_id) ON t.resource_type = p.kind",
)
def pol_find(spark: SparkSession, sf: str) -> DataFrame:
    names = bridge.view(spark, sf, _NAMES)
    typed = names.select("event_id", policy.resource_type(F.col("resource_name")).alias("resource_type"))
    return policy.applicable(typed, "resource_type").select("event_id", "resource_type", "policy_id")


# --- policies -------------------------------------------------------------------------------------------

_PUBLIC = (
    "(list_has_any(string_split(members_bar, '|'), ['allUsers', 'allAuthenticatedUsers'])"
    " AND role IN ('roles/storage.objectViewer', 'roles/storage.legacyObjectReader'))"
)
_EXTERNAL = "(access_type IS NOT NULL)"
_UNSHIELDED = "(NOT (secure_boot AND vtpm AND integrity))"


def _rule(name: str, sql: str, violated) -> None:
    @query(name, f"SELECT cfg_id, {sql} AS violated FROM ({CONFIGS}) AS c")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return configs(spark, sf).select("cfg_id", violated(F.col("config")).alias("violated"))


_rule("pol_public", _PUBLIC, policy.public_bucket)
_rule("pol_extip", _EXTERNAL, policy.external_address)
_rule("pol_shield", _UNSHIELDED, policy.not_shielded)

_BUCKET, _VM = "cfg_id % 2 = 0", "cfg_id % 2 = 1"
_VIOLATIONS = (
    f"SELECT cfg_id, resource_name, 'bucket_public_access' AS policy_id, 'HIGH' AS severity, 'NIST-SC-7' AS compliance FROM c WHERE {_BUCKET} AND {_PUBLIC}"
    f" UNION ALL SELECT cfg_id, resource_name, 'vm_no_external_ip', 'MEDIUM', 'NIST-SC-7' FROM c WHERE {_VM} AND {_EXTERNAL}"
    f" UNION ALL SELECT cfg_id, resource_name, 'vm_shielded', 'MEDIUM', 'NIST-SI-7' FROM c WHERE {_VM} AND {_UNSHIELDED}"
)


def evaluated(spark: SparkSession, sf: str) -> DataFrame:
    found = policy.evaluate(F.col("resource_type"), F.col("config"))
    return configs(spark, sf).withColumn("policy_violations", found)


@query(
    "pol_eval",
    f"WITH c AS ({CONFIGS}) SELECT cfg_id, policy_id, severity, compliance FROM ({_VIOLATIONS}) AS v WHERE cfg_id % 25 <> 3"
    " UNION ALL SELECT cfg_id, 'framework_error', NULL, '' FROM c WHERE cfg_id % 25 = 3",
)
def pol_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Violations per configuration; some configurations are not readable."""
    rows = configs(spark, sf).withColumn("readable", F.col("cfg_id") % 25 != 3)
    found = policy.evaluate(F.col("resource_type"), F.col("config"), F.col("readable"))
    exploded = rows.select("cfg_id", F.posexplode_outer(found).alias("pos", "v"))
    return exploded.where(F.col("pos").isNotNull()).select(
        "cfg_id",
        "v.policy_id",
        "v.severity",
        F.array_join("v.compliance", ",").alias("compliance"),
    )


@query(
    "pol_collect",
    "SELECT event_id, policy_id, severity FROM (SELECT event_id, 'deep' AS policy_id, 'MEDIUM' AS severity FROM events WHERE event_id % 4 <> 3"
    " UNION ALL SELECT event_id, concat('p', user_id), 'HIGH' FROM events WHERE event_id % 2 = 0"
    " UNION ALL SELECT event_id, 'deep', 'MEDIUM' FROM events WHERE event_id % 4 = 1) AS v",
)
def pol_collect(spark: SparkSession, sf: str) -> DataFrame:
    """Results nested to a depth that differs from row to row."""
    key = F.col("event_id")
    named = F.format_string('{"policy_id":"p%s","message":"m","metadata":{"severity":"HIGH"}}', "user_id")
    bare = '{"message":"m"}'
    listed = F.when(key % 4 == 0, F.concat(named, F.lit(f",{bare}"))).when(
        key % 4 == 1, F.lit(f"{bare},{bare}")
    ).when(key % 4 == 2, F.concat(F.lit(f"{bare},"), named)).otherwise("")
    inner = F.concat(F.lit('{"ok":[1,{"violation":[]}],"violation":['), listed, F.lit("]}"))
    depth = (key % 5).cast("int")
    nested = F.concat(
        F.repeat(F.lit('{"result":[{"x":'), depth), inner, F.repeat(F.lit("}]}"), depth)
    )
    results = bridge.table(spark, sf, "events").select("event_id", nested.alias("result"))
    found = policy.collect_violations(results, "result", F.lit("deep"))
    return found.select("event_id", "policy_id", "severity")


# --- images ------------------------------------------------------------------------------------------------

_IMAGE_TYPE = "CASE WHEN cfg_id % 3 = 0 THEN 'run.googleapis.com/Service' WHEN cfg_id % 3 = 1 THEN 'container.googleapis.com/Cluster' ELSE 'compute.googleapis.com/Instance' END"


def _images(spark: SparkSession, sf: str) -> DataFrame:
    rows = configs(spark, sf)
    kind = (
        F.when(F.col("cfg_id") % 3 == 0, "run.googleapis.com/Service")
        .when(F.col("cfg_id") % 3 == 1, "container.googleapis.com/Cluster")
        .otherwise("compute.googleapis.com/Instance")
    )
    return rows.select("cfg_id", kind.alias("kind"), policy.image_of(F.col("config")).alias("image"))


@query(
    "pol_image",
    f"SELECT cfg_id, image, (image IS NOT NULL AND {_IMAGE_TYPE} <> 'compute.googleapis.com/Instance') AS needs_check FROM ({CONFIGS}) AS c",
)
def pol_image(spark: SparkSession, sf: str) -> DataFrame:
    rows = _images(spark, sf)
    return rows.select(
        "cfg_id", "image", policy.needs_signature(F.col("kind"), F.col("image")).alias("needs_check")
    )


SIGNATURES = """
SELECT concat('img', s_nationkey) AS image, CASE WHEN s_suppkey%3=0 THEN 'https://accounts.google.com' ELSE 'https://other.example.com' END AS issuer,
 CASE WHEN s_suppkey%2=0 THEN 'ci@your-builder-project.iam.gserviceaccount.com' ELSE 'me@home.example.com' END AS identity
FROM {supplier}
"""
_UNSIGNED = (
    f"SELECT cfg_id, image FROM ({CONFIGS}) AS c WHERE image IS NOT NULL AND cfg_id % 3 <> 2"
    f" AND image NOT IN (SELECT image FROM ({bridge.ansi(SIGNATURES)}) AS s WHERE issuer = 'https://accounts.google.com'"
    " AND regexp_matches(identity, '.*@your-builder-project\\.iam\\.gserviceaccount\\.com'))"
)


@query("pol_signed", f"SELECT cfg_id, image, 'supply_chain_violation' AS policy_id FROM ({_UNSIGNED}) AS u")
def pol_signed(spark: SparkSession, sf: str) -> DataFrame:
    rows = _images(spark, sf)
    to_check = rows.where(policy.needs_signature(F.col("kind"), F.col("image")))
    unsigned = policy.unsigned(to_check, bridge.view(spark, sf, SIGNATURES))
    found = policy.supply_chain_violation(F.col("image"))
    return unsigned.select("cfg_id", "image", found["policy_id"].alias("policy_id"))


# --- results ---------------------------------------------------------------------------------------------------


@query(
    "pol_result",
    f"WITH c AS ({CONFIGS}), v AS (SELECT cfg_id, policy_id FROM ({_VIOLATIONS}) AS x UNION ALL SELECT cfg_id, 'supply_chain_violation' FROM ({_UNSIGNED}) AS u)"
    " SELECT c.cfg_id, count(v.policy_id) AS violation_count, count(v.policy_id) = 0 AS compliant,"
    " coalesce(string_agg(v.policy_id, ',' ORDER BY v.policy_id), '') AS policies FROM c LEFT JOIN v ON c.cfg_id = v.cfg_id GROUP BY c.cfg_id",
)
def pol_result(spark: SparkSession, sf: str) -> DataFrame:
    """Policy and supply-chain violations of every resource together."""
    images = _images(spark, sf)
    to_check = images.where(policy.needs_signature(F.col("kind"), F.col("image")))
    unsigned = policy.unsigned(to_check, bridge.view(spark, sf, SIGNATURES)).select(
        "cfg_id", F.array(policy.supply_chain_violation(F.col("image"))).alias("chain_violations")
    )
    rows = evaluated(spark, sf).join(unsigned, "cfg_id", "left")
    checked = policy.results(rows, ["policy_violations", "chain_violations"])
    names = F.array_sort(F.transform("violations", lambda v: v["policy_id"]))
    return checked.select(
        "cfg_id",
        F.col("violation_count").cast("bigint").alias("violation_count"),
        "compliant",
        F.array_join(names, ",").alias("policies"),
    )


@query(
    "pol_summary",
    f"WITH c AS ({CONFIGS}), v AS ({_VIOLATIONS}), a AS (SELECT cfg_id, 'bucket_public_access' AS policy_id FROM c WHERE {_BUCKET}"
    f" UNION ALL SELECT cfg_id, 'vm_no_external_ip' FROM c WHERE {_VM} UNION ALL SELECT cfg_id, 'vm_shielded' FROM c WHERE {_VM})"
    " SELECT a.cfg_id, a.policy_id, v.policy_id IS NULL AS compliant, v.severity FROM a LEFT JOIN v ON a.cfg_id = v.cfg_id AND a.policy_id = v.policy_id",
)
def pol_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Compliant and violated policies of every resource."""
    return policy.policy_summary(
        evaluated(spark, sf), F.col("resource_type"), F.col("policy_violations"), ["cfg_id"]
    )


@query(
    "snk_viol",
    f"WITH c AS ({CONFIGS}) SELECT resource_name, 'compute.googleapis.com/Instance' AS resource_type, CAST(1700000000 AS BIGINT) AS timestamp,"
    f" string_agg(policy_id, ',' ORDER BY policy_id) AS policies FROM ({_VIOLATIONS}) AS v WHERE cfg_id % 2 = 1 GROUP BY resource_name"
    " UNION ALL SELECT resource_name, 'storage.googleapis.com/Bucket', CAST(1700000000 AS BIGINT), string_agg(policy_id, ',' ORDER BY policy_id)"
    f" FROM ({_VIOLATIONS}) AS v WHERE cfg_id % 2 = 0 GROUP BY resource_name",
)
def snk_viol(spark: SparkSession, sf: str) -> DataFrame:
    """The notifications of non-compliant resources."""
    checked = policy.results(evaluated(spark, sf), ["policy_violations"])
    sent = policy.notifications(checked, F.lit(1700000000).cast("bigint"))
    names = F.array_sort(F.transform("violations", lambda v: v["policy_id"]))
    return sent.select(
        "resource_name", "resource_type", "timestamp", F.array_join(names, ",").alias("policies")
    )
