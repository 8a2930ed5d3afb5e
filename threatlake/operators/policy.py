"""Policies over resource configurations named by audit events."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

from threatlake.functions import fixed, json_walk
from threatlake.functions.columns import (
    blank_to_null,
    empty_array,
    is_json,
    let,
    lookup,
    word_list,
)

VIOLATION = (
    "struct<policy_id:string,message:string,severity:string,compliance:array<string>,"
    "extra:map<string,string>>"
)


# --- events ---------------------------------------------------------------------------------------


def resource_name(event: Column) -> Column:
    """Name of the resource an audit event (``AUDIT_EVENT``) is about, null when it has none."""
    proto = event["protoPayload"]
    storage_object = F.when(
        (event["kind"] == "storage#object"),
        F.concat(
            F.lit("//storage.googleapis.com/projects/_/buckets/"),
            event["bucket"],
            F.lit("/objects/"),
            event["name"],
        ),
    )
    return F.coalesce(
        blank_to_null(proto["resourceName"]),
        blank_to_null(proto["resource"]["name"]),
        blank_to_null(proto["requestMetadata"]["callerSuppliedResourceName"]),
        storage_object,
    )


def is_audited(service: Column, method: Column) -> Column:
    """Whether a method of a service triggers an evaluation."""
    wanted = F.lit(False)
    for own_service, own_method in fixed.AUDITED_METHODS:
        wanted = wanted | ((service == own_service) & (method == own_method))
    return F.coalesce(wanted, F.lit(False))


def audited_events(events: DataFrame, service_col: str, method_col: str) -> DataFrame:
    """Events of the methods that trigger an evaluation."""
    return events.where(is_audited(F.col(service_col), F.col(method_col)))


def resource_type(name: Column) -> Column:
    """<service>/<Kind> from a full resource name; the kind is the first known path segment."""

    def from_parts(parts: Column) -> Column:
        inner = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
        kinds = F.filter(inner, lambda p: p.isin(list(fixed.RESOURCE_KINDS)))
        kind = F.coalesce(lookup(fixed.RESOURCE_KINDS, F.get(kinds, F.lit(0))), F.lit("Unknown"))
        full = (F.size(parts) >= 3) & (parts[0] == "")
        return F.when(full, F.concat_ws("/", F.get(parts, F.lit(2)), kind)).otherwise(
            "unknown/Unknown"
        )

    return let(F.split(name, "/", -1), from_parts)


def service_and_kind(kind: Column) -> tuple[Column, Column]:
    """Where the policies of a resource type are filed."""
    service = F.substring_index(F.substring_index(kind, "/", 1), ".", 1)
    return service, F.regexp_replace(kind, "^[^/]*/", "")


def has_project(name: Column) -> Column:
    """A configuration can only be looked up for a name with a project."""
    return name.rlike("projects/[^/]+")


# --- policies ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Policy:
    """A rule on a configuration column; violated where ``violated`` holds."""

    policy_id: str
    service: str
    kind: str
    message: str
    severity: str
    compliance: tuple[str, ...]
    violated: Callable[[Column], Column]


def public_bucket(config: Column) -> Column:
    """A reader role granted to everyone, in one and the same binding."""
    bindings = config["iamConfiguration"]["bindings"]
    return F.coalesce(
        F.exists(
            bindings,
            lambda b: F.arrays_overlap(b["members"], word_list(fixed.PUBLIC_MEMBERS))
            & b["role"].isin(fixed.READER_ROLES),
        ),
        F.lit(False),
    )


def external_address(config: Column) -> Column:
    access = F.flatten(F.transform(config["networkInterfaces"], lambda n: n["accessConfigs"]))
    return F.coalesce(F.exists(access, lambda a: a["type"] == "ONE_TO_ONE_NAT"), F.lit(False))


def not_shielded(config: Column) -> Column:
    shield = config["shieldedInstanceConfig"]
    features = [shield[f] for f in ("enableSecureBoot", "enableVtpm", "enableIntegrityMonitoring")]
    on = [F.coalesce(f, F.lit(False)) for f in features]
    return ~(on[0] & on[1] & on[2])


POLICIES = [
    Policy(
        "bucket_public_access",
        "storage",
        "Bucket",
        "Storage buckets should not grant 'allUsers' or 'allAuthenticatedUsers' read access.",
        "HIGH",
        ("NIST-SC-7",),
        public_bucket,
    ),
    Policy(
        "vm_no_external_ip",
        "compute",
        "Instance",
        "VM instances should not have external addresses.",
        "MEDIUM",
        ("NIST-SC-7",),
        external_address,
    ),
    Policy(
        "vm_shielded",
        "compute",
        "Instance",
        "VM instances should have all Shielded VM features enabled.",
        "MEDIUM",
        ("NIST-SI-7",),
        not_shielded,
    ),
]


def applicable(resources: DataFrame, type_col: str, policies: list[Policy] | None = None):
    """Resources with the policies filed for their type, as an equi-join with the catalogue."""
    catalogue = resources.sparkSession.createDataFrame(
        [(p.policy_id, p.service, p.kind) for p in policies or POLICIES],
        "policy_id string, service string, kind string",
    )
    service, kind = service_and_kind(F.col(type_col))
    typed = resources.withColumn("service", service).withColumn("kind", kind)
    # The catalogue is a list in the program, a few rows whatever the data.
    return typed.join(F.broadcast(catalogue), ["service", "kind"])


def violation(policy_id: str, message, severity=None, compliance=(), extra=None) -> Column:
    return F.struct(
        F.lit(policy_id).alias("policy_id"),
        F.lit(message).alias("message"),
        F.lit(severity).cast("string").alias("severity"),
        (word_list(list(compliance)) if compliance else empty_array("string")).alias("compliance"),
        (F.create_map().cast("map<string,string>") if extra is None else extra).alias("extra"),
    ).cast(VIOLATION)


def evaluate(
    kind: Column, config: Column, readable: Column | None = None,
    policies: list[Policy] | None = None,
) -> Column:
    """Violations of all policies that apply to a resource type.

    A configuration that could not be read yields a framework error where a policy applies.
    """
    service, name = service_and_kind(kind)
    chosen = policies or POLICIES
    applies = [(service == p.service) & (name == p.kind) for p in chosen]
    found = F.array_compact(
        F.array(
            *[
                F.when(
                    a & p.violated(config),
                    violation(p.policy_id, p.message, p.severity, p.compliance),
                )
                for p, a in zip(chosen, applies)
            ]
        )
    )
    if readable is None:
        return found
    any_applies = F.lit(False)
    for a in applies:
        any_applies = any_applies | a
    broken = violation(
        "framework_error",
        "Configuration is not readable",
        extra=F.create_map(F.lit("resource_type"), kind),
    )
    return (
        F.when(readable, found)
        .when(any_applies, F.array(broken))
        .otherwise(empty_array(VIOLATION))
    )


# --- violations at any depth ---------------------------------------------------------------------------


@F.pandas_udf(ArrayType(StringType()))
def _violation_texts(results: pd.Series) -> pd.Series:
    return results.map(lambda result: json_walk.listed_items(result, "violation"), na_action="ignore")


def collect_violations(
    results: DataFrame, result_col: str, default_policy: Column | None = None
) -> DataFrame:
    """Every item of a ``violation`` list at any depth of a JSON result, one row each.

    Spark SQL has no walk over JSON of unknown depth, so texts that mention such a list go
    through a small Arrow function, which keeps a stack of its own and follows any depth; all others
    stay in the JVM.  Results that are not JSON have no rows here but in ``unreadable_results``.
    """
    result = F.col(result_col)
    # A name may be written with escapes.
    relevant = F.when(result.contains('"violation"') | result.contains("\\u"), result)
    rest = [c for c in results.columns if c != result_col]
    texts = results.select(*rest, _violation_texts(relevant).alias("_texts"))
    rows = texts.select(*rest, F.posexplode_outer("_texts").alias("position", "violation"))
    rows = rows.where(F.col("position").isNotNull())
    stated = F.get_json_object("violation", "$.policy_id")
    default = F.lit(None).cast("string") if default_policy is None else default_policy
    return rows.select(
        *rest,
        "position",
        F.coalesce(stated, default).alias("policy_id"),
        F.get_json_object("violation", "$.message").alias("message"),
        F.coalesce(F.get_json_object("violation", "$.metadata.severity"), F.lit("MEDIUM")).alias(
            "severity"
        ),
        "violation",
    )


def unreadable_results(results: DataFrame, result_col: str) -> DataFrame:
    """Results that are null or not one JSON value to the end; depth is no reason."""
    # Spark's parser refuses very deep texts, which the walk then reads.
    doubtful = results.where(~is_json(F.col(result_col)))
    return doubtful.where(_violation_texts(F.col(result_col)).isNull())


# --- images ------------------------------------------------------------------------------------------------


def image_of(config: Column) -> Column:
    """Image of the first container."""
    containers = config["spec"]["template"]["spec"]["containers"]
    return blank_to_null(F.get(containers, F.lit(0))["image"])


def needs_signature(kind: Column, image: Column) -> Column:
    return kind.isin(fixed.IMAGE_RESOURCE_TYPES) & image.isNotNull()


def valid_signatures(
    signatures: DataFrame,
    issuer: str = fixed.SIGNATURE_ISSUER,
    identity: str = fixed.SIGNATURE_IDENTITY,
) -> DataFrame:
    """Images with a signature of the expected issuer and identity."""
    good = (F.col("issuer") == issuer) & F.col("identity").rlike(identity)
    return signatures.where(good).select("image").distinct()


def unsigned(resources: DataFrame, signatures: DataFrame, **expected) -> DataFrame:
    """Resources (column ``image``) whose image has no valid signature.

    An anti-join on the image; a popular image is only a hot key of the left side, which adaptive
    execution splits because the right side is distinct.
    """
    return resources.join(valid_signatures(signatures, **expected), "image", "left_anti")


def supply_chain_violation(image: Column) -> Column:
    return violation(
        "supply_chain_violation",
        "Image signature verification failed",
        extra=F.create_map(F.lit("image"), image),
    )


def supply_chain_error(image: Column) -> Column:
    return violation(
        "supply_chain_error",
        "Image signature was never checked",
        extra=F.create_map(F.lit("image"), image),
    )


def with_supply_chain(
    resources: DataFrame,
    signatures: DataFrame,
    issuer: str = fixed.SIGNATURE_ISSUER,
    identity: str = fixed.SIGNATURE_IDENTITY,
) -> DataFrame:
    """Add ``supply_chain_violations`` (columns ``resource_type`` and ``image`` are given).

    An image that was checked and refused is a violation; an image without any check is an error.
    One row per image is joined, so a popular image is a hot key of one side only.
    """
    good = (F.col("issuer") == issuer) & F.col("identity").rlike(identity)
    checks = signatures.groupBy("image").agg(F.coalesce(F.bool_or(good), F.lit(False)).alias("_signed"))
    wanted = needs_signature(F.col("resource_type"), F.col("image"))
    found = (
        F.when(wanted & F.col("_signed").isNull(), F.array(supply_chain_error(F.col("image"))))
        .when(wanted & ~F.col("_signed"), F.array(supply_chain_violation(F.col("image"))))
        .otherwise(empty_array(VIOLATION))
    )
    joined = resources.join(checks, "image", "left")
    return joined.withColumn("supply_chain_violations", found).drop("_signed")


# --- results -------------------------------------------------------------------------------------------------


def results(
    evaluated: DataFrame, violations_cols: list[str], name_col: str = "resource_name"
) -> DataFrame:
    """Add all violations of an event's resource, their number and the compliant flag.

    The violations of a resource are few by construction, one per policy, and sit in its row.
    """
    every = F.concat(*[F.coalesce(c, empty_array(VIOLATION)) for c in violations_cols])
    rows = evaluated.withColumn("violations", every)
    return rows.withColumn("violation_count", F.size("violations")).withColumn(
        "compliant", F.size("violations") == 0
    )


def notifications(checked: DataFrame, timestamp: Column) -> DataFrame:
    """What is published: non-compliant resources only."""
    return checked.where(~F.col("compliant")).select(
        "resource_name",
        timestamp.alias("timestamp"),
        "violations",
        "resource_type",
    )


def policy_summary(evaluated: DataFrame, kind: Column, violations: Column, keep: list[str],
                   policies: list[Policy] | None = None) -> DataFrame:
    """One row per resource and applicable policy: compliant, or violated with a severity."""
    service, name = service_and_kind(kind)
    chosen = policies or POLICIES

    def outcome(policy: Policy) -> Column:
        hits = F.filter(violations, lambda v: v["policy_id"] == policy.policy_id)
        severity = F.coalesce(F.get(hits, F.lit(0))["severity"], F.lit("MEDIUM"))
        return F.when(
            (service == policy.service) & (name == policy.kind),
            F.struct(
                F.lit(policy.policy_id).alias("policy_id"),
                (F.size(hits) == 0).alias("compliant"),
                F.when(F.size(hits) > 0, severity).alias("severity"),
            ),
        )

    outcomes = F.array_compact(F.array(*[outcome(p) for p in chosen]))
    rows = evaluated.select(*keep, F.posexplode_outer(outcomes).alias("pos", "outcome"))
    return rows.where(F.col("pos").isNotNull()).select(*keep, "outcome.*")
