"""Security findings to indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threatlake.functions.columns import blank_to_null, clamp01, first_true, last_segment
from threatlake.functions.fixed import EDGE_AFTER, EDGE_BEFORE, IPV4
from threatlake.sources.schemas import SCC_FINDING, to_indicator_schema

# Ordered substring rules, severity scale and link format.
TYPE_RULES = [
    (["DNS", "DOMAIN"], [], "domain"),
    (["IP", "OPEN_SSH", "OPEN_RDP"], [], "ip"),
    (["IAM"], [], "account"),
    (["BUCKET"], ["storage.googleapis.com"], "storage"),
    (["CONTAINER"], ["container.googleapis.com"], "container"),
    (["VIRTUAL_MACHINE"], ["compute.googleapis.com"], "compute"),
    (["SQL"], ["sqladmin.googleapis.com"], "database"),
]
CATEGORY_RULES = [
    (["MALWARE"], "malware"),
    (["VULNERABILITY", "CVE"], "vulnerability"),
    (["ACCESS", "IAM", "PRIVILEGE"], "access_control"),
    (["MISCONFIG"], "misconfiguration"),
    (["COMPLIANCE"], "compliance"),
    (["DLP", "DATA_LEAK"], "data_leak"),
    (["NETWORK", "FIREWALL"], "network_security"),
    (["ENCRYPTION", "KMS"], "encryption"),
    (["LOGGING", "AUDIT"], "logging"),
]
RESOURCE_TAGS = [
    ("compute.googleapis.com", "resource_compute"),
    ("storage.googleapis.com", "resource_storage"),
    ("container.googleapis.com", "resource_container"),
    ("cloudsql.googleapis.com", "resource_database"),
]
CONFIDENCES = [("CRITICAL", 0.9), ("HIGH", 0.8), ("MEDIUM", 0.6), ("LOW", 0.4)]
OTHER_CONFIDENCE = 0.3
MUTED_PENALTY = 0.2
SEVERITIES = [("CRITICAL", "9"), ("HIGH", "7"), ("MEDIUM", "5"), ("LOW", "3")]
OTHER_SEVERITY = "1"
FINDING_URL = (
    "https://console.cloud.google.com/security/command-center/findings"
    "?organizationId=%s&findingId=%s"
)
FINDING_IP = f"{EDGE_BEFORE}{IPV4}{EDGE_AFTER}"
_LABEL = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
_ENDING = rf"[a-z0-9][a-z0-9-]{{0,61}}[a-z0-9]{EDGE_AFTER}"
# Whole labels up to the last one that an ending follows; see the pattern of domains.
FINDING_DOMAIN = (
    rf"{EDGE_BEFORE}(?=[a-z0-9][a-z0-9-]{{0,62}}+\.)(?:(?<!\.)|(?<!{EDGE_BEFORE}{_LABEL}\.))"
    rf"(?:(?:{_LABEL}\.(?!{_ENDING}))*+{_LABEL}\.(?={_ENDING}))++{_ENDING}"
)


def _has_any(text: Column, parts: list[str]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | text.contains(part)
    return found


def project_id(resource_name: Column) -> Column:
    return blank_to_null(F.regexp_extract(resource_name, "projects/([^/]+)", 1))


def reference_url(name: Column) -> Column:
    """Console link; only for a full finding name."""
    parts = F.split(name, "/", -1)
    full = (F.size(parts) >= 4) & (parts[0] == "organizations")
    return F.when(full, F.format_string(FINDING_URL, F.get(parts, F.lit(1)), last_segment(name)))


def indicator_type(category: Column, resource_name: Column) -> Column:
    return first_true(
        [
            (_has_any(category, words) | _has_any(resource_name, services), label)
            for words, services, label in TYPE_RULES
        ],
        "gcp_resource",
    )


def indicator_value(kind: Column, raw: Column, resource_name: Column, name: Column) -> Column:
    """First address or domain anywhere in the raw finding, else the end of a name."""
    address = blank_to_null(F.regexp_extract(raw, FINDING_IP, 0))
    domain = blank_to_null(F.regexp_extract(raw, FINDING_DOMAIN, 0))
    return F.coalesce(
        F.when(kind == "ip", address).when(kind == "domain", domain),
        F.when(resource_name != "", last_segment(resource_name)),
        F.when(name != "", last_segment(name)),
        F.lit("unknown"),
    )


def tags(category: Column, severity_text: Column, resource_name: Column, mute: Column) -> Column:
    resource = F.lit(None).cast("string")
    for part, label in reversed(RESOURCE_TAGS):
        resource = F.when(resource_name.contains(part), label).otherwise(resource)
    return F.array_compact(
        F.array(
            F.replace(F.lower(blank_to_null(category)), F.lit(" "), F.lit("_")),
            F.concat(F.lit("severity_"), F.lower(blank_to_null(severity_text))),
            resource,
            F.when(mute == "MUTED", "muted"),
        )
    )


def threat_category(category: Column) -> Column:
    upper = F.upper(F.coalesce(category, F.lit("")))
    return first_true([(_has_any(upper, words), label) for words, label in CATEGORY_RULES],
                      "cloud_security")


def confidence(severity_text: Column, mute: Column) -> Column:
    upper = F.upper(F.coalesce(severity_text, F.lit("")))
    base = F.lit(OTHER_CONFIDENCE)
    for word, value in CONFIDENCES:
        base = F.when(upper == word, value).otherwise(base)
    penalty = F.when(mute == "MUTED", MUTED_PENALTY).otherwise(0.0)
    return clamp01(base - penalty)


def severity(severity_text: Column) -> Column:
    upper = F.upper(severity_text)
    return first_true([(upper == word, value) for word, value in SEVERITIES], OTHER_SEVERITY)


def malicious_verdicts(severity_text: Column) -> Column:
    """Case matters here, unlike in the severity."""
    return F.when(severity_text.isin("HIGH", "CRITICAL"), 1).otherwise(0)


def last_seen(event_time: Column, create_time: Column) -> Column:
    return F.coalesce(blank_to_null(event_time), create_time)


def normalize(
    findings: DataFrame, processed_at: Column | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Indicators of findings, given as raw JSON text in the column ``finding``.

    The text is kept beside the parsed fields because "first address in the finding" depends on
    the order of its keys.
    """
    rows = findings.select(*keep, "finding", F.from_json("finding", SCC_FINDING).alias("f"))
    name = F.coalesce("f.name", F.lit(""))
    category = F.coalesce("f.category", F.lit("UNKNOWN"))
    resource = F.coalesce("f.resourceName", F.lit(""))
    severity_text = F.coalesce("f.severity", F.lit("UNKNOWN"))
    kind = indicator_type(category, resource)
    return to_indicator_schema(
        rows.select(
            *keep,
            F.lit("gcp_scc").alias("source"),
            kind.alias("indicator_type"),
            indicator_value(kind, F.col("finding"), resource, name).alias("indicator_value"),
            threat_category(category).alias("threat_category"),
            malicious_verdicts(severity_text).alias("malicious_verdicts"),
            F.lit(1).alias("total_verdicts"),
            confidence(F.col("f.severity"), F.col("f.mute")).alias("confidence_score"),
            severity(severity_text).alias("severity"),
            tags(F.col("f.category"), F.col("f.severity"), resource, F.col("f.mute")).alias("tags"),
            reference_url(name).alias("source_reference"),
            F.coalesce("f.description", F.lit("")).alias("description"),
            F.col("f.createTime").alias("first_seen"),
            last_seen(F.col("f.eventTime"), F.col("f.createTime")).alias("last_seen"),
            (F.lit(None) if processed_at is None else processed_at).alias("processed_at"),
        ),
        keep,
    )
