"""Policies, configuration at a point in time, violations at any depth."""

import datetime as dt
import json
import random

import pytest
from hypothesis import given, settings as hypothesis_settings, strategies as st
from pyspark.sql import functions as F

from threatlake import session
from threatlake.functions import json_walk
from threatlake.operators import asof, policy
from threatlake.sources.schemas import RESOURCE_CONFIG

BINDING = {"role": "roles/storage.objectViewer", "members": ["allUsers"]}
SHIELD = {"enableSecureBoot": True, "enableVtpm": True, "enableIntegrityMonitoring": True}
NAT = [{"accessConfigs": [{"type": "ONE_TO_ONE_NAT", "name": "External NAT"}]}]
BUCKET = "//storage.googleapis.com/projects/p/buckets/b"
VM = "//compute.googleapis.com/projects/p/zones/z/instances/v"

CASES = [
    (BUCKET, {"iamConfiguration": {"bindings": [BINDING]}}, ["bucket_public_access"]),
    (BUCKET, {"iamConfiguration": {"bindings": [{**BINDING, "members": ["user:a"]}]}}, []),
    (BUCKET, {"iamConfiguration": {"bindings": [{**BINDING, "role": "roles/storage.admin"}]}}, []),
    (BUCKET, {"name": "b"}, []),
    (VM, {"networkInterfaces": NAT, "shieldedInstanceConfig": SHIELD}, ["vm_no_external_ip"]),
    (VM, {"networkInterfaces": [{"accessConfigs": []}], "shieldedInstanceConfig": SHIELD}, []),
    (VM, {"shieldedInstanceConfig": {**SHIELD, "enableSecureBoot": False}}, ["vm_shielded"]),
    (VM, {"networkInterfaces": NAT}, ["vm_no_external_ip", "vm_shielded"]),
    ("projects/p/instances/v", {"networkInterfaces": NAT}, []),
    (BUCKET, "{broken", ["framework_error"]),
    ("//pubsub.googleapis.com/projects/p/topics/t", "{broken", []),
]


def test_policies(spark):
    rows = [(i, n, c if isinstance(c, str) else json.dumps(c)) for i, (n, c, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, name string, config string").withColumn(
        "kind", policy.resource_type(F.col("name"))
    )
    found = policy.evaluate(
        F.col("kind"), F.from_json("config", RESOURCE_CONFIG), F.try_parse_json("config").isNotNull()
    )
    got = {r.i: [v.policy_id for v in r.v] for r in df.select("i", found.alias("v")).collect()}
    assert got == {i: expected for i, (_, _, expected) in enumerate(CASES)}


@pytest.fixture
def settings(spark):
    """Session settings for one test."""
    before = {}

    def put(name, value):
        before.setdefault(name, spark.conf.get(name))
        spark.conf.set(name, value)

    yield put
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("seed, ranges, batch", [(1, 1, 10_000), (2, 7, 3), (3, 40, 10_000), (4, 5, 1)])
def test_as_of_equals_brute_force(spark, settings, seed, ranges, batch):
    """Ties, repeated events, events before any version, a hot key and hot hour, nulls everywhere."""
    settings("spark.sql.shuffle.partitions", ranges)
    settings("spark.sql.adaptive.coalescePartitions.enabled", "false")
    settings("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rnd = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    key = lambda: "hot" if rnd.random() < 0.8 else rnd.choice([None, *(f"k{i}" for i in range(6))])
    when = lambda: None if rnd.random() < 0.03 else start + dt.timedelta(seconds=rnd.randint(100, 300))
    versions = [(key(), when(), v, rnd.choice([None, "c"])) for v in range(150)]
    # Long stretches without versions reach over several ranges.
    versions += [("rare", start, 900, "r"), ("last", start, 901, None)]
    events = [(key(), when(), e) for e in range(300)] + [("none", start, 999), ("hot", start, 998)]
    events += [(k, start + dt.timedelta(seconds=i), 1000 + i) for k in ("rare", "last") for i in range(60)]
    events += events[:40]
    history = spark.createDataFrame(versions, "k string, ts timestamp, version int, config string")
    asked = spark.createDataFrame(events, "k string, ts timestamp, e int")
    rows = asof.as_of(asked, history, "k", "ts", ["version", "config"], "version").collect()
    expected = []
    for k, ts, e in events:
        past = [(t, v, c) for kk, t, v, c in versions if k and ts and kk == k and t and t <= ts]
        _, version, config = max(past, key=lambda p: p[:2]) if past else (None, None, None)
        expected.append((k, ts, e, version, config))
    assert sorted(map(tuple, rows), key=repr) == sorted(expected, key=repr)


def test_as_of_of_empty_tables(spark):
    history = spark.createDataFrame([], "k string, ts timestamp, version int")
    asked = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 1)], "k string, ts timestamp, e int")
    assert [r.version for r in asof.as_of(asked, history, "k", "ts", ["version"], "version").collect()] == [None]
    assert asof.as_of(asked.limit(0), history, "k", "ts", ["version"], "version").count() == 0


def test_as_of_spreads_one_hour_of_one_key(spark, settings, monkeypatch):
    """Nine in ten rows in one key and hour, and a third of those in one instant."""
    settings("spark.sql.shuffle.partitions", 16)
    settings("spark.sql.adaptive.coalescePartitions.enabled", "false")
    seen = []
    monkeypatch.setattr(asof, "written", lambda df, purpose: seen.append(session.written(df, purpose)) or seen[-1])
    second = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 3600)
    rows = spark.range(40_000).select(
        "id", F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("k"),
        F.timestamp_seconds(1_700_000_000 + second).alias("ts"),
    )
    found = asof.as_of(rows, rows.withColumnRenamed("id", "version").where("version % 50 = 1"), "k", "ts", ["version"], "version")
    assert found.count() == 40_000
    sizes = [r["count"] for r in seen[0].groupBy("_range").count().collect()]
    assert len(sizes) == 16
    assert max(sizes) < 2 * sum(sizes) / len(sizes)


def test_violations_at_any_depth(spark):
    def nest(depth, leaf):
        return leaf if depth == 0 else {"a": [nest(depth - 1, leaf)], "violation": "text"}

    results = [
        {"violation": [{"policy_id": "x", "metadata": {"severity": "LOW"}}, {"message": "m"}]},
        nest(60, {"violation": [{"message": "deep"}]}),
        {"violation": []}, {"other": 1}, "not json at all \"violation\"",
    ]
    rows = [(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(results)]
    df = spark.createDataFrame(rows, "i int, result string")
    got = policy.collect_violations(df, "result", F.lit("file")).collect()
    assert sorted((r.i, r.policy_id, r.severity) for r in got) == [
        (0, "file", "MEDIUM"), (0, "x", "LOW"), (1, "file", "MEDIUM"),
    ]


def test_violations_below_any_depth(spark):
    depth = 100_000
    deep = '{"a":[' * depth + '{"violation":[{"policy_id":"x"},2]}' + "]}" * depth
    item = '{"violation":[{"policy_id":"y","z":' + "[" * depth + "]" * depth + "}]}"
    rows = [
        (1, deep), (2, item), (3, deep[:-1]), (4, None), (5, '{"violation":[1],"violation":[{"policy_id":"last"}]}'),
        (6, '{"viol\\u0061tion":[{"policy_id":"escaped"}]}'), (7, '{"violation":[{"violation":[1]}]} x'), (8, "{}"),
    ]
    df = spark.createDataFrame(rows, "i int, result string")
    got = policy.collect_violations(df, "result", F.lit("file")).select("i", "position", "policy_id").collect()
    # The fields of an item that is itself too deep for Spark's parser count as absent.
    assert sorted(map(tuple, got)) == [(1, 0, "x"), (1, 1, "file"), (2, 0, "file"), (5, 0, "last"), (6, 0, "escaped")]
    assert sorted(r.i for r in policy.unreadable_results(df, "result").collect()) == [3, 4, 7]


@given(st.recursive(
    st.none() | st.booleans() | st.integers() | st.text(max_size=4),
    lambda inner: st.lists(inner, max_size=4) | st.dictionaries(st.sampled_from(["violation", "a", "b"]), inner, max_size=3),
    max_leaves=25,
), st.integers(0, 200), st.sampled_from(["", "}", "]", ",", '"', " 1"]))
@hypothesis_settings(max_examples=300, deadline=None)
def test_walk_equals_a_plain_one(value, place, extra):
    def items(node):
        if isinstance(node, list):
            return [v for item in node for v in items(item)]
        if not isinstance(node, dict):
            return []
        listed = node.get("violation")
        own = listed if isinstance(listed, list) else []
        return own + [v for key, value in node.items() if key != "violation" for v in items(value)]

    text = json.dumps(value)
    text = text[:place] + extra + text[place:]
    try:
        expected = items(json.loads(text))
    except ValueError:
        expected = None
    found = json_walk.listed_items(text, "violation")
    assert (found if found is None else [json.loads(v) for v in found]) == expected


def test_signatures(spark):
    resources = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "none")], "id int, image string")
    signatures = spark.createDataFrame(
        [("good", "https://accounts.google.com", "ci@your-builder-project.iam.gserviceaccount.com"),
         ("good", "https://accounts.google.com", "ci@your-builder-project.iam.gserviceaccount.com"),
         ("bad", "https://accounts.google.com", "me@home.org")],
        "image string, issuer string, identity string",
    )
    assert sorted(r.id for r in policy.unsigned(resources, signatures).collect()) == [2, 3]


def test_supply_chain_of_events(spark):
    """A refused image, one that was never checked, a signed one, and types that need no signature."""
    kinds = ["run.googleapis.com/Service"] * 3 + ["storage.googleapis.com/Bucket", "run.googleapis.com/Service"]
    images = ["bad", "never", "good", "bad", None]
    rows = [(i, k, m) for i, (k, m) in enumerate(zip(kinds, images, strict=True))]
    resources = spark.createDataFrame(rows, "id int, resource_type string, image string")
    signatures = spark.createDataFrame(
        [("good", "https://accounts.google.com", "ci@your-builder-project.iam.gserviceaccount.com"),
         ("good", "https://other", None), ("bad", "https://accounts.google.com", "me@home.org"), ("bad", None, None)],
        "image string, issuer string, identity string",
    )
    found = policy.with_supply_chain(resources, signatures).collect()
    assert {r.id: [v.policy_id for v in r.supply_chain_violations] for r in found} == {
        0: ["supply_chain_violation"], 1: ["supply_chain_error"], 2: [], 3: [], 4: [],
    }
