"""Streams leave what the batch jobs give, also when they run twice."""

import base64
import datetime as dt
import json

from pyspark.sql import functions as F

from threatlake.operators import routing
from threatlake.plans import feeds, landing
from threatlake.sources import raw, tables
from threatlake.streaming import enforce, guard, ingest


def test_ingest_equals_batch_and_picks_up_new_files(spark, sf_dir, tmp_path):
    base = str(tmp_path)
    documents = feeds.raw_documents(spark, sf_dir).where(F.col("feed").isin("alienvault", "asset", "nvd"))

    def run():
        ingest.ingest(
            spark, f"{base}/raw", f"{base}/table", f"{base}/archive", f"{base}/checkpoint", whole_files=False
        ).awaitTermination()

    for feed in ("alienvault", "asset", "nvd"):
        tables.write_raw(documents.where(F.col("feed") == feed), f"{base}/raw")
        run()
    run()
    expected = feeds.shown(routing.normalize(raw.records(raw.read_raw(spark, f"{base}/raw", whole_files=False))))
    stored = feeds.shown(tables.load_indicators(spark, f"{base}/table"))
    assert stored.count() == expected.count() > 0
    assert stored.exceptAll(expected).count() == 0
    archived = spark.read.schema("source string").json(f"{base}/archive").count()
    assert archived == expected.count()


def test_what_is_left_out_is_kept_with_a_reason(spark, tmp_path):
    base = str(tmp_path)
    (tmp_path / "raw" / "scc").mkdir(parents=True)
    for name, text in {"cut": '{"findings": [', "none": '{"x": 1}', "odd": '{"findings": [7, {}]}'}.items():
        (tmp_path / "raw" / "scc" / f"{name}.json").write_text(text)
    ingest.ingest(
        spark, f"{base}/raw", f"{base}/table", f"{base}/archive", f"{base}/checkpoint", quarantine_path=f"{base}/bad"
    ).awaitTermination()
    rows = spark.read.parquet(f"{base}/bad").collect()
    assert {(r.object_name, r.reason) for r in rows} == {
        ("raw/scc/cut.json", "not JSON"), ("raw/scc/none.json", "no records"), ("raw/scc/odd.json", "bad record"),
    }


def test_a_batch_is_parsed_once(spark, tmp_path):
    """What is left out comes from one reading; a text with something behind it keeps its records."""
    (tmp_path / "raw" / "scc").mkdir(parents=True)
    (tmp_path / "raw" / "nvd").mkdir()
    texts = {"cut": '{"findings": [', "odd": '{"findings": [7, null, {"name": "a"}]}', "more": '{"findings": [{"name": "b"}, 8]} x', "good": '{"findings": [{"name": "c"}]}'}
    for name, text in texts.items():
        (tmp_path / "raw" / "scc" / f"{name}.json").write_text(text)
    (tmp_path / "raw" / "nvd" / "n.json").write_text("{}")
    files = raw.read_raw(spark, f"{tmp_path}/raw")
    left_out = raw.rejected(files)
    assert left_out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = sorted((r.object_name, r.reason, str(r.content)) for r in left_out.collect())
    assert got == sorted([
        ("raw/scc/cut.json", "not JSON", texts["cut"]), ("raw/scc/more.json", "not JSON", texts["more"]),
        ("raw/scc/more.json", "bad record", "8"), ("raw/scc/odd.json", "bad record", "7"),
        ("raw/scc/odd.json", "bad record", "None"), ("raw/nvd/n.json", "unknown source", "{}"),
    ])
    assert {(r.reason, r.content) for r in raw.quarantine(files).collect()} == {
        ("not JSON", texts["cut"]), ("not JSON", texts["more"]), ("unknown source", "{}"),
    }
    kept = sorted(json.loads(r.record)["name"] for r in raw.records_of(raw.parsed(files)).collect())
    assert kept == sorted(json.loads(r.record)["name"] for r in raw.records(files).collect())
    assert {"a", "c"} <= set(kept)


def test_batches_are_bounded_by_bytes_and_the_archive_is_compressed(spark, tmp_path):
    base = str(tmp_path)
    finding = '{"findings": [{"name": "organizations/1/sources/1/findings/%s", "category": "x", "resourceName": "r"}]}'
    for i in range(3):
        tables.write_feed(spark.createDataFrame([(finding % i,)], "content string").coalesce(1), f"{base}/raw", "scc")
    ingest.ingest(
        spark, f"{base}/raw", f"{base}/table", f"{base}/archive", f"{base}/checkpoint", whole_files=False, max_bytes=1
    ).awaitTermination()
    rows = spark.read.parquet(f"{base}/table").collect()
    assert len(rows) == 3 and len({r.batch_id for r in rows}) == 3
    files = [p.name for p in (tmp_path / "archive").rglob("part-*")]
    assert files and all(name.endswith(".json.gz") for name in files)


def test_the_registered_ingest_keeps_what_it_leaves_out(spark, sf_dir):
    *_, quarantine_path = landing._ingested(spark, sf_dir)
    kept = spark.read.parquet(quarantine_path)
    expected = {r.feed: r.quarantined for r in landing.src_raw(spark, sf_dir).collect() if r.quarantined}
    assert {"alienvault", "nvd"} <= set(expected)
    assert {r.feed: r["count"] for r in kept.groupBy("feed").count().collect()} == expected
    assert kept.where(F.col("reason").isNull() | F.col("content").isNull()).isEmpty()


def test_enforcement_equals_batch(spark, sf_dir, tmp_path):
    base = str(tmp_path)
    events, history = landing.audit_messages(spark, sf_dir), landing.config_history(spark, sf_dir)
    events.write.json(f"{base}/events")
    enforce.enforce(spark, f"{base}/events", history, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    checked = enforce.check_events(enforce.named_events(events), history)
    expected = checked.where(~F.col("compliant")).count()
    assert spark.read.parquet(f"{base}/out").count() == expected > 0


START = dt.datetime(2024, 1, 1)


def message(number, minutes, body=None):
    data = base64.b64encode(b'{"n":%d}' % (minutes if body is None else body)).decode()
    return number and str(number), START + dt.timedelta(minutes=minutes), data


def test_messages_that_come_again_are_taken_once(spark, tmp_path):
    """Within a batch, in a later batch, after a restart; what is too late is counted."""
    base = str(tmp_path)
    first = [message(i, i) for i in range(1, 300)] + [message(i, i) for i in range(1, 300, 3)]
    first += [message(None, 10, 1), message(None, 10, 2), message(None, 10, 2), ("bad", START, "no base64!")]
    # A clock of 300 minutes with one hour's delay: what is older than minute 239 is too late.
    second = [message(i, i) for i in range(300, 400)] + [message(i, i) for i in range(2, 300, 3)]
    second += [message(1000, 5), message(1001, 290), message(None, 290, 7)]
    third = [message(i, i) for i in (120, 395, 396, 400, 401)] + [message(1001, 290)]
    too_late = []
    for rows in (first, second, third):
        spark.createDataFrame(rows, guard.MESSAGE_SCHEMA).coalesce(3).write.mode("append").json(f"{base}/sent")
        run = guard.land_messages(spark, f"{base}/sent", f"{base}/table", f"{base}/checkpoint")
        run.awaitTermination()
        too_late.append(guard.late_rows(run))
    taken = sorted((r.message_id or "", r.body) for r in spark.read.parquet(f"{base}/table").collect())
    expected = [(str(i), '{"n":%d}' % i) for i in range(1, 402)]
    expected += [("", '{"n":1}'), ("", '{"n":2}'), ("", '{"n":7}'), ("1001", '{"n":290}')]
    assert taken == sorted(expected)
    old = [m for m in second if m[1] <= START + dt.timedelta(minutes=299 - 60)]
    older = [m for m in third if m[1] <= START + dt.timedelta(minutes=399 - 60)]
    assert too_late == [0, len(old), len(older)]


def test_batches_have_each_message_once_too(spark):
    rows = [message(1, 1), message(1, 1), message(None, 1), message(None, 1), message(None, 2), ("1", None, "x")]
    assert guard.once(spark.createDataFrame(rows, guard.MESSAGE_SCHEMA), "message_id", "publish_time", "1 hour").count() == 3


def test_audit_events_that_come_again_are_checked_once(spark, sf_dir, tmp_path):
    base = str(tmp_path)
    events, history, signed = landing.audit_messages(spark, sf_dir), landing.config_history(spark, sf_dir), landing.signatures(spark, sf_dir)
    for _ in range(2):
        events.write.mode("append").json(f"{base}/events")
        enforce.enforce(
            spark, f"{base}/events", history, f"{base}/out", f"{base}/checkpoint", signatures=signed, delay="400 days"
        ).awaitTermination()
    checked = enforce.check_events(enforce.named_events(events), history, signed)
    sent = spark.read.parquet(f"{base}/out")
    assert sent.count() == checked.where(~F.col("compliant")).count() > 0
    found = {r.policy_id for r in sent.select(F.explode("violations.policy_id").alias("policy_id")).distinct().collect()}
    assert {"supply_chain_error", "supply_chain_violation", "bucket_public_access", "vm_shielded"} <= found


def test_only_audited_methods_reach_the_policies(spark):
    def event(number, body):
        return number, START, base64.b64encode(body.encode()).decode()

    name = '"resourceName":"//storage.googleapis.com/projects/p/buckets/b"'
    call = '{"protoPayload":{"serviceName":"storage.googleapis.com","methodName":"%s",' + name + "}}"
    rows = [
        event(1, call % "storage.setIamPermissions"), event(2, call % "storage.objects.get"),
        event(3, '{"protoPayload":{' + name + "}}"), event(4, '{"kind":"storage#object","bucket":"b","name":"o"}'),
        (5, START, "?"), (6, START, None),
    ]
    named = enforce.named_events(spark.createDataFrame(rows, enforce.EVENT_SCHEMA))
    assert sorted(r.event_id for r in named.collect()) == [1, 4]
