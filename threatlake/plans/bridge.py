"""Views that give the given tables the shape of the feeds, the same in Spark and in ANSI SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

ADVISORIES = """
SELECT event_id AS doc_id, concat(
 'Campaign ', event_id, ': host ', (event_id*7)%223+1, '.', (event_id*13)%256, '.', user_id%256, '.', event_id%254+1,
 CASE event_id%4 WHEN 0 THEN ' communicates with ' WHEN 1 THEN ' is hosted on ' WHEN 2 THEN ' dropped ' ELSE ' near ' END,
 'c', user_id, '.evil-', event_type, '.org . ',
 CASE event_type WHEN 'error' THEN 'Active exploitation and widespread ransomware, a critical vulnerability.'
  WHEN 'purchase' THEN 'Privilege escalation and data loss are serious.'
  WHEN 'view' THEN 'This could affect users; moderate, denial of service.'
  WHEN 'click' THEN 'Minor and unlikely, low risk.'
  ELSE 'This is not a zero-day and was patched; no vulnerability.' END,
 CASE WHEN event_id%3=0 THEN concat(' CVE-', 2015+event_id%10, '-', 1000+event_id%9000, ' CVSS Score: ', event_id%10, '.', (event_id*3)%10, '.') ELSE '' END,
 CASE WHEN event_id%5=0 THEN concat(' <b>Malicious</b> file ', md5(concat('f', event_id)), ' at http://dl', event_id%17, '.bad.net/p', event_id%7, '?q=1 mail op', event_id%11, '@bad.net') ELSE '' END,
 CASE WHEN event_id%8=1 THEN concat(' Hashes ', md5(concat('s', event_id)), md5(concat('t', event_id)), ' and ', md5(concat('u', event_id)), substr(md5(concat('v', event_id)), 1, 8), ' from ',
  substr(md5(concat('w', event_id)), 1, 4), ':', substr(md5(concat('w', event_id)), 5, 4), ':', substr(md5(concat('w', event_id)), 9, 4), ':', substr(md5(concat('w', event_id)), 13, 4), ':',
  substr(md5(concat('w', event_id)), 17, 4), ':', substr(md5(concat('w', event_id)), 21, 4), ':', substr(md5(concat('w', event_id)), 25, 4), ':', substr(md5(concat('w', event_id)), 29, 4), ' seen by example.com and 127.0.0.1.') ELSE '' END,
 CASE WHEN event_id%6=2 THEN '  The national security bulletin was never   fixed in Time for the very large number of people who asked about remote code execution.' ELSE '' END,
 CASE event_id%18
  WHEN 0 THEN concat(' Also s', user_id, '.drop.net communicates with ', event_id%200+20, '.', user_id%256, '.7.8 today.')
  WHEN 1 THEN concat(' Also s', user_id, '.drop.net connects to ', event_id%200+20, '.', user_id%256, '.7.8 today.')
  WHEN 2 THEN concat(' Also s', user_id, '.drop.net reached out to ', event_id%200+20, '.', user_id%256, '.7.8 today.')
  WHEN 3 THEN concat(' Connections from s', user_id, '.drop.net to ', event_id%200+20, '.', user_id%256, '.7.8 today.')
  WHEN 4 THEN concat(' Also s', user_id, '.drop.net contains ', md5(concat('x', event_id)), ' today.')
  WHEN 5 THEN concat(' Also s', user_id, '.drop.net embeds ', md5(concat('x', event_id)), ' today.')
  WHEN 6 THEN concat(' Also s', user_id, '.drop.net dropped ', md5(concat('x', event_id)), ' today.')
  WHEN 7 THEN concat(' Then ', md5(concat('x', event_id)), ' was found in s', user_id, '.drop.net today.')
  WHEN 8 THEN concat(' Also s', user_id, '.drop.net was hosted on ', event_id%200+20, '.', user_id%256, '.7.8 today.')
  WHEN 9 THEN concat(' And ', event_id%200+20, '.', user_id%256, '.7.8 hosts s', user_id, '.drop.net today.')
  WHEN 10 THEN concat(' Also s', user_id, '.drop.net located on ', event_id%200+20, '.', user_id%256, '.7.8 today.')
  WHEN 11 THEN concat(' Also s', user_id, '.drop.net exploits ', event_id%200+20, '.', user_id%256, '.7.8 today.')
  WHEN 12 THEN concat(' And ', event_id%200+20, '.', user_id%256, '.7.8 was exploited by s', user_id, '.drop.net today.')
  WHEN 13 THEN concat(' The exploitation of ', event_id%200+20, '.', user_id%256, '.7.8 by s', user_id, '.drop.net today.')
  WHEN 14 THEN concat(' Also s', user_id, '.drop.net is attributed to ', event_id%200+20, '.', user_id%256, '.7.8 today.')
  WHEN 15 THEN concat(' And ', event_id%200+20, '.', user_id%256, '.7.8 is responsible for s', user_id, '.drop.net today.')
  WHEN 16 THEN concat(' A ', event_id%200+20, '.', user_id%256, '.7.8 campaign using s', user_id, '.drop.net today.')
  ELSE '' END,
 CASE WHEN event_id%9=4 THEN concat(' Then ', event_id%200+20, '.', user_id%256, '.9.9 communicates with ', event_id%200+20, '.', user_id%256, '.9.8 and ',
  event_id%200+20, '.', user_id%256, '.9.9 met r', user_id, '.drop.net, then ', event_id%200+20, '.', user_id%256, '.9.9 and ', event_id%200+20, '.', user_id%256, '.9.8 met r', user_id, '.drop.net.') ELSE '' END) AS text
FROM {events}
"""

# Advisories and documents with ids of their own.
TEXTS = f"SELECT doc_id, text FROM ({ADVISORIES}) AS advisories UNION ALL SELECT -1 - doc_id, text FROM {{documents}}"

OTX = """
SELECT event_id - event_id%5 AS pulse_id, event_id AS ind_seq,
 concat('pulse ', event_id - event_id%5) AS name,
 CASE WHEN (event_id - event_id%5)%2=0 THEN '' ELSE concat('d', event_id - event_id%5) END AS description,
 CASE WHEN (event_id - event_id%5)%3=0 THEN 'grp' END AS adversary,
 CASE (event_id - event_id%5)%7 WHEN 0 THEN 'Malware|apt' WHEN 1 THEN 'phishing' WHEN 2 THEN 'a|b|c|d' WHEN 3 THEN 'scanner|scanner' WHEN 4 THEN 'command and control' WHEN 5 THEN 'zero-day|exploit' ELSE 'misc' END AS tags_bar,
 CASE event_id%9 WHEN 0 THEN 'IPv4' WHEN 1 THEN 'IPv6' WHEN 2 THEN 'domain' WHEN 3 THEN 'hostname' WHEN 4 THEN 'URL' WHEN 5 THEN 'FileHash-MD5' WHEN 6 THEN 'FileHash-SHA1' WHEN 7 THEN 'FileHash-SHA256' ELSE 'email' END AS ind_type,
 md5(concat('i', event_id)) AS indicator
FROM {events}
"""

VT = """
SELECT l_orderkey, l_linenumber, concat(l_partkey%223+1, '.', l_suppkey%256, '.', l_orderkey%256, '.', l_linenumber) AS ip,
 CASE WHEN l_orderkey%11=0 THEN 'file' ELSE 'ip_address' END AS rtype,
 CASE WHEN l_partkey%3=0 THEN l_partkey%15 ELSE 0 END AS malicious, CASE WHEN l_partkey%4=0 THEN l_suppkey%5 ELSE 0 END AS suspicious,
 CASE WHEN l_partkey%5=0 THEN 0 ELSE l_suppkey%40 END AS harmless, l_orderkey%30 AS undetected, l_orderkey%2 AS timeout_n,
 CASE l_returnflag WHEN 'A' THEN 'US' WHEN 'R' THEN 'DE' END AS country, CASE WHEN l_suppkey%2=0 THEN concat('AS-', l_suppkey) END AS as_owner, l_suppkey AS asn,
 CASE l_linenumber%5 WHEN 0 THEN 'Malware|harmless' WHEN 1 THEN 'phishing|suspicious' WHEN 2 THEN 'undetected|timeout' WHEN 3 THEN 'suspicious|malicious' ELSE '' END AS cats_bar,
 CASE WHEN l_orderkey%6=0 THEN NULL ELSE 1700000000 + l_orderkey*60 END AS last_analysis_date
FROM {lineitem}
"""

SCC = """
SELECT o_orderkey, CASE WHEN o_orderkey%9=0 THEN '' WHEN o_orderkey%10=0 THEN concat('findings/f', o_orderkey) ELSE concat('organizations/', o_custkey, '/sources/1/findings/f', o_orderkey) END AS name,
 CASE o_orderkey%12 WHEN 0 THEN 'PUBLIC_IP_ADDRESS' WHEN 1 THEN 'DNS_MALWARE' WHEN 2 THEN 'IAM_PRIVILEGE' WHEN 3 THEN 'PUBLIC BUCKET ACL' WHEN 4 THEN 'CONTAINER_VULNERABILITY' WHEN 5 THEN 'OPEN_SSH_PORT' WHEN 6 THEN 'SQL_MISCONFIG' WHEN 7 THEN 'AUDIT_LOGGING_DISABLED' WHEN 8 THEN 'KMS_ENCRYPTION' WHEN 9 THEN 'FIREWALL_OFF' WHEN 10 THEN 'COMPLIANCE' ELSE 'OTHER' END AS category,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'LOW' ELSE 'UNKNOWN' END AS severity,
 concat('//', CASE o_custkey%4 WHEN 0 THEN 'compute.googleapis.com' WHEN 1 THEN 'storage.googleapis.com' WHEN 2 THEN 'container.googleapis.com' ELSE 'cloudsql.googleapis.com' END, '/projects/p', o_custkey%50, '/items/r', o_custkey) AS resource_name,
 CASE WHEN o_orderkey%7=0 THEN NULL ELSE CAST(o_orderdate AS STRING) END AS event_time, concat('2020-01-0', 1+o_orderkey%9) AS create_time,
 CASE WHEN o_orderkey%8=0 THEN 'MUTED' ELSE 'UNMUTED' END AS mute, concat('seen 9.', o_orderkey%256, '.1.2 near h', o_custkey, '.bad.org') AS description, CASE WHEN o_orderstatus='F' THEN 'INACTIVE' ELSE 'ACTIVE' END AS state,
 o_orderdate
FROM {orders}
"""

ASSETS = """
SELECT p_partkey, CASE p_partkey%9 WHEN 0 THEN 'compute.googleapis.com/Instance' WHEN 1 THEN 'storage.googleapis.com/Bucket' WHEN 2 THEN 'container.googleapis.com/Cluster' WHEN 3 THEN 'sqladmin.googleapis.com/Instance' WHEN 4 THEN 'iam.googleapis.com/ServiceAccount' WHEN 5 THEN 'dns.googleapis.com/ManagedZone' WHEN 6 THEN 'compute.googleapis.com/Firewall' WHEN 7 THEN 'cloudkms.googleapis.com/CryptoKey' ELSE '' END AS asset_type,
 CASE WHEN p_partkey%13=0 THEN concat('//storage.googleapis.com/b', p_partkey) WHEN p_partkey%13=1 THEN concat('//x.googleapis.com/projects/p', p_partkey%20, '/locations/eu-west', p_size, '/k/', p_partkey) ELSE concat('//x.googleapis.com/projects/p', p_partkey%20, '/items/', p_partkey) END AS name,
 CASE WHEN p_size%2=0 THEN p_name ELSE '' END AS display_name,
 CASE WHEN p_size%4=0 THEN 'us-central1-a' END AS zone, CASE WHEN p_size%4=1 THEN 'europe-west4' END AS region, CASE WHEN p_size%4=2 THEN 'asia' END AS location,
 CASE WHEN p_partkey%3=0 THEN '2021-01-01T00:00:00Z' END AS time_created, CASE WHEN p_partkey%3=1 THEN '2022-02-02T00:00:00Z' END AS creation_timestamp, '2024-03-03T00:00:00Z' AS update_time
FROM {part}
"""

# Assets that findings are about: some of the items, and the projects of two services.
INVENTORY = """
SELECT concat('//', CASE c_custkey%4 WHEN 0 THEN 'compute.googleapis.com' WHEN 1 THEN 'storage.googleapis.com' WHEN 2 THEN 'container.googleapis.com' ELSE 'cloudsql.googleapis.com' END, '/projects/p', c_custkey%50, '/items/r', c_custkey) AS name,
 CASE c_custkey%4 WHEN 0 THEN 'compute.googleapis.com/Instance' WHEN 1 THEN 'storage.googleapis.com/Bucket' ELSE 'other/Item' END AS asset_type
FROM {customer} WHERE c_custkey%3=0
UNION ALL SELECT DISTINCT concat('//', CASE WHEN c_custkey%2=0 THEN 'compute.googleapis.com' ELSE 'storage.googleapis.com' END, '/projects/p', c_custkey%50) AS name, 'project' AS asset_type FROM {customer}
"""

CONFIGS = """
SELECT c_custkey AS cfg_id, CASE WHEN c_custkey%2=0 THEN concat('//storage.googleapis.com/projects/p', c_nationkey, '/buckets/b', c_custkey) ELSE concat('//compute.googleapis.com/projects/p', c_nationkey, '/zones/z/instances/v', c_custkey) END AS resource_name,
 CASE c_custkey%6 WHEN 0 THEN 'roles/storage.objectViewer' WHEN 2 THEN 'roles/storage.legacyObjectReader' ELSE 'roles/storage.admin' END AS role,
 CASE c_custkey%5 WHEN 0 THEN 'allUsers|user:a' WHEN 1 THEN 'allAuthenticatedUsers' ELSE 'user:b' END AS members_bar,
 CASE WHEN c_custkey%7<3 THEN 'ONE_TO_ONE_NAT' END AS access_type,
 c_custkey%3<>0 AS secure_boot, c_custkey%4<>0 AS vtpm, c_custkey%5<>0 AS integrity,
 CASE WHEN c_custkey%10=0 THEN concat('img', c_nationkey) END AS image
FROM {customer}
"""

HISTORY = "SELECT user_id AS rid, ts, event_id AS version FROM {events} WHERE event_type = 'view'"

AUDIT = """
SELECT user_id AS rid, ts, event_id, CASE event_id%4 WHEN 0 THEN concat('//storage.googleapis.com/projects/p/buckets/b', user_id) WHEN 1 THEN '' ELSE concat('//compute.googleapis.com/projects/p/instances/v', user_id) END AS resource_name FROM {events} WHERE event_type <> 'view'
"""

LABELLED = """
SELECT event_id, CASE event_type WHEN 'error' THEN 'domain' WHEN 'view' THEN 'url' WHEN 'click' THEN NULL ELSE 'ipv4' END AS indicator_type,
 CASE WHEN user_id%2=0 THEN 'alienvault' ELSE 'virustotal' END AS source,
 CASE event_id%6 WHEN 0 THEN 'malware|x' WHEN 1 THEN 'Malware' WHEN 2 THEN 'apt' ELSE 'misc' END AS tags_bar,
 CASE WHEN event_id%7<2 THEN 1 ELSE 0 END AS prediction
FROM {events}
"""

# Labelled rows whose class follows from the features, but for one row in ten.
LEARNABLE = """
SELECT event_id, indicator_type, source, CASE WHEN (event_id%10=3) <> (coalesce(indicator_type, 'x')='domain' OR (coalesce(indicator_type, 'x')='url' AND source='alienvault')) THEN 'x|phishing' ELSE 'Phishing' END AS tags_bar
FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'domain' WHEN 'view' THEN 'url' WHEN 'click' THEN NULL ELSE 'ipv4' END AS indicator_type,
 CASE WHEN user_id%2=0 THEN 'alienvault' ELSE 'virustotal' END AS source FROM {events}) AS e
"""

OBJECTS = """
SELECT event_id, CASE event_id%8 WHEN 0 THEN concat('raw/AlienVault/f', event_id, '.json') WHEN 1 THEN concat('raw/virustotal/d/f', event_id, '.json') WHEN 2 THEN concat('raw/scc/placeholder', event_id)
 WHEN 3 THEN concat('raw/f', event_id, '.json') WHEN 4 THEN concat('normalized/scc/f', event_id) WHEN 5 THEN concat('raw/nvd/f', event_id, '.json') WHEN 6 THEN concat('raw/asset/f', event_id, '.json') ELSE concat('raw/scc/f', event_id, '.json') END AS name
FROM {events}
"""

REQUESTS = """
SELECT event_id, CASE WHEN event_id%50=0 THEN 0 ELSE 1 END AS has_body,
 CASE event_id%7 WHEN 0 THEN 'ip' WHEN 1 THEN 'domain' WHEN 2 THEN 'ipv4' WHEN 3 THEN NULL WHEN 4 THEN 'email' WHEN 5 THEN 'file_hash' ELSE 'url' END AS indicator_type,
 CASE event_id%5 WHEN 0 THEN 'alienvault' WHEN 1 THEN 'nlp_extraction' WHEN 2 THEN NULL WHEN 3 THEN 'other' ELSE 'mandiant' END AS source,
 CASE WHEN event_id%3=0 THEN concat('v', event_id) END AS value
FROM {events}
"""

_TABLE = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out to all cores where the files give too few tasks for that.

    Parsing text is bound by the processor, and a row group is one task, which no reader setting
    splits.  A table of less than two splits a core is dealt out to four tasks a core, or to as many as
    the setting ``threatlake.textPartitions`` says; larger ones are read as they are, without an
    exchange.
    """
    spark = df.sparkSession
    parts = spark.conf.get("threatlake.textPartitions", None)
    cores = spark.sparkContext.defaultParallelism
    if not parts and df.rdd.getNumPartitions() < 2 * cores:
        parts = 4 * cores
    return df.repartition(int(parts)) if parts else df


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A bridge view over the parquet tables."""
    names = sorted(set(_TABLE.findall(sql)))
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def spread_view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A bridge view whose rows are costly to work on."""
    names = sorted(set(_TABLE.findall(sql)))
    return spark.sql(sql, **{n: spread(table(spark, sf_dir, n)) for n in names})


def ansi(sql: str) -> str:
    """The same view for the checking engine, where the tables are registered by name."""
    return _TABLE.sub(r"\1", sql)
