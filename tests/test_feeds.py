"""Normalisers and sources on small literal inputs."""

import json

import pytest
from pyspark.sql import functions as F

from threatlake.functions import fixed
from threatlake.operators import asset, correlation, otx, routing, scc, vt
from threatlake.plans import landing
from threatlake.sources import messages, raw, schemas, tables

PULSE = {
    "id": "p1", "name": "Pulse", "description": "", "tags": ["test", "malware", "apt"],
    "created": "2024-01-17T10:00:00Z", "adversary": "Group",
    "indicators": [{"type": "IPv4", "indicator": "192.168.1.100"}, {"type": "domain", "indicator": "m.com"},
                   {"type": "CVE", "indicator": "CVE-1"}],
}


def parsed(spark, kind, *records):
    rows = spark.createDataFrame([(json.dumps(r),) for r in records], "record string")
    return rows.select(F.from_json("record", kind).alias("r")).select("r.*")


def test_pulse(spark):
    rows = otx.normalize(parsed(spark, schemas.OTX_PULSE, PULSE)).collect()
    assert [(r.indicator_type, r.indicator_value) for r in rows] == [("ipv4", "192.168.1.100"), ("domain", "m.com")]
    r = rows[0]
    assert (r.threat_category, r.confidence_score, r.severity) == ("malware", pytest.approx(0.6), "high")
    assert (r.tags, r.description, r.last_seen) == (["apt", "malware", "test"], "Pulse", "2024-01-17T10:00:00Z")
    assert rows[0].__fields__ == [name for name, _ in schemas.INDICATOR_COLUMNS]


def test_pulse_without_indicators_or_tags(spark):
    bare = {"id": "p2", "name": "n", "indicators": [{"type": "URL", "indicator": "u"}]}
    rows = otx.normalize(parsed(spark, schemas.OTX_PULSE, {"id": "p0", "name": "n"}, bare)).collect()
    assert [(r.severity, r.confidence_score, r.tags, r.threat_category) for r in rows] == [
        ("low", 0.5, [], "suspicious_network_activity")
    ]
    four = {**PULSE, "tags": list("abcd"), "adversary": None}
    row = otx.normalize(parsed(spark, schemas.OTX_PULSE, four)).first()
    assert (row.confidence_score, row.severity) == (pytest.approx(0.6), "medium")


def report(**stats):
    return {"data": {"id": "1.2.3.4", "type": "ip_address", "attributes": {
        "last_analysis_stats": stats,
        "last_analysis_results": {"e1": {"category": "malicious"}, "e2": {"category": "Undetected"}, "e3": {"category": "timeout"}},
        "country": "US", "asn": 5, "as_owner": "", "last_analysis_date": 1700000000}}}


def test_reports(spark):
    full = report(malicious=25, suspicious=1, undetected=45, harmless=0, timeout=0)
    row = vt.normalize(parsed(spark, schemas.VT_REPORT, full)).first()
    assert (row.total_verdicts, row.confidence_score) == (71, pytest.approx(25.5 / 71))
    assert (row.severity, row.threat_category) == ("high", "malicious")
    # Only the exact words are neutral.
    assert row.tags == ["geo:US", "malicious", "undetected"]
    assert row.last_seen == "2023-11-14T22:13:20+00:00"
    none = vt.normalize(parsed(spark, schemas.VT_REPORT, report(malicious=0))).first()
    assert (none.confidence_score, none.severity, none.threat_category) == (0.0, "informational", "unknown")


def test_file_reports_give_nothing(spark):
    files = {"files": [{"id": "h", "attributes": {"last_analysis_stats": {"malicious": 25}}}]}
    assert vt.normalize(parsed(spark, schemas.VT_REPORT, files)).count() == 0


def finding(**fields):
    return json.dumps({"name": "organizations/1/sources/2/findings/f", "resourceName": "//compute.googleapis.com/projects/p/x/vm1", **fields})


def test_findings(spark):
    rows = [
        finding(category="PUBLIC_IP_ADDRESS", severity="HIGH", mute="MUTED", sourceProperties={"ip": "9.8.7.6"}),
        finding(category="OTHER", severity="high"),
        finding(),
    ]
    df = spark.createDataFrame([(r,) for r in rows], "finding string")
    public, lower, bare = scc.normalize(df).collect()
    assert (public.indicator_type, public.indicator_value, public.severity) == ("ip", "9.8.7.6", "7")
    assert (public.malicious_verdicts, round(public.confidence_score, 6)) == (1, 0.6)
    assert public.tags == ["public_ip_address", "severity_high", "resource_compute", "muted"]
    assert (lower.severity, lower.malicious_verdicts, lower.indicator_type, lower.indicator_value) == ("7", 0, "compute", "vm1")
    assert (bare.severity, bare.confidence_score, bare.description) == ("1", 0.3, "")


def test_assets(spark):
    vm = {"name": "//compute.googleapis.com/projects/p1/zones/us-central1-a/instances/vm1",
          "assetType": "compute.googleapis.com/Instance", "updateTime": "t",
          "resource": {"data": {"zone": "us-central1-a"}}}
    bucket = {"name": "//storage.googleapis.com/bkt", "assetType": "storage.googleapis.com/Bucket"}
    first, second = asset.normalize(parsed(spark, schemas.ASSET, vm, bucket, {"name": "x"})).collect()
    assert (first.indicator_type, first.indicator_value, first.country) == ("compute", "vm1", "us-central1")
    assert first.tags == ["instance", "compute", "project_p1", "location_us-central1"]
    assert (first.first_seen, first.description) == ("t", "GCP Instance: vm1")
    assert (second.source_reference, second.indicator_value) == (None, "bkt")


def test_raw_files(spark, tmp_path):
    """Good, cut-off, empty, unknown and placeholder files side by side."""
    files = {
        "alienvault/a.json": json.dumps({"pulses": [PULSE]}, indent=2),
        "alienvault/cut.json": json.dumps({"pulses": [PULSE]})[:50],
        "alienvault/none.json": "{}",
        "virustotal/one.json": json.dumps(report(malicious=1)),
        "virustotal/list.json": json.dumps([report(malicious=1), report(malicious=2)]),
        "scc/empty.json": "",
        "nvd/n.json": json.dumps({"cves": [{"id": "CVE-1"}]}),
        "scc/placeholder.json": "{}",
        "scc/other.json": json.dumps({"items": []}),
        "scc/odd.json": json.dumps({"findings": [5, "x"]}),
        "asset/trailing.json": json.dumps({"assets": []}) + " x",
    }
    for name, text in files.items():
        path = tmp_path / "raw" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    docs = raw.read_raw(spark, str(tmp_path / "raw"))
    rows = routing.normalize(raw.records(docs)).groupBy("object_name").count().collect()
    assert {r.object_name: r["count"] for r in rows} == {
        "raw/alienvault/a.json": 2, "raw/virustotal/one.json": 1, "raw/virustotal/list.json": 2,
    }
    reasons = {r.object_name: r.reason for r in raw.quarantine(docs).collect()}
    assert reasons.pop("raw/alienvault/cut.json") == "not JSON"
    assert reasons.pop("raw/nvd/n.json") == "unknown source"
    assert reasons.pop("raw/scc/other.json") == "no records"
    assert reasons.pop("raw/asset/trailing.json") == "not JSON"
    assert reasons.pop("raw/alienvault/none.json") == "no records"
    assert set(reasons) <= {"raw/scc/empty.json"}
    bad = [(r.object_name, r.content) for r in raw.rejected(docs).collect() if r.reason == "bad record"]
    assert sorted(bad) == [("raw/scc/odd.json", "5"), ("raw/scc/odd.json", "x")]


def test_messages(spark):
    import base64

    bodies = [b'{"sources":["a"]}', b"{}", b"not json", b"\xff\xfe"]
    rows = [(i, base64.b64encode(b).decode()) for i, b in enumerate(bodies)] + [(4, "***")]
    df = spark.createDataFrame(rows, "i int, data string")
    got = messages.decode(df).select("i", messages.requested_sources(F.col("body")).alias("s")).collect()
    assert {r.i: r.s for r in got} == {0: ["a"], 1: ["alienvault", "virustotal"]}


def test_requests(spark):
    rows = [("ip", "other"), (None, None), ("ipv4", "other"), ("url", "nowhere")]
    df = spark.createDataFrame(rows, "t string, s string")
    got = [r.c for r in df.select(routing.check_request(F.lit(True), F.col("t"), F.col("s")).alias("c")).collect()]
    assert [c.is_valid for c in got] == [True, False, False, False]
    assert got[1].error == "Missing required fields: indicator_type, source"


def test_archive_names(spark):
    names = ["raw/scc/d/f.json", "raw", "other/scc/f.json"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(tables.archive_name(F.col("n"))).collect()] == [
        "normalized/scc/f.json", "normalized/error/unknown_path_raw", "normalized/error/unknown_path_f.json",
    ]


def test_retention_prunes(spark, tmp_path):
    rows = spark.range(10).select("id", F.date_sub(F.lit("2024-06-01").cast("date"), (F.col("id") * 20).cast("int")).alias("ingest_date"))
    rows.write.partitionBy("ingest_date").parquet(str(tmp_path / "t"))
    kept = tables.retained(spark.read.parquet(str(tmp_path / "t")), F.lit("2024-06-01").cast("date"))
    assert kept.count() == 5
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ingest_date" in plan


def test_json_is_checked_to_the_end(spark):
    from threatlake.functions.columns import is_json

    good = ['{"a":1}', '{"a":1,"a":2}', "[1, {}]", ' {"a": "\\u00e9"} ', "5", '{"v": "],["}']
    bad = ['{"a":1} x', "", " ", "{", "{'a':1}", '{"a":1}, {"b":2}', "1],[2", '1,"#"],[2', None]
    rows = spark.createDataFrame([(t,) for t in good + bad], "t string")
    found = {r.t: r.ok for r in rows.select("t", is_json(F.col("t")).alias("ok")).collect()}
    assert [t for t in good if not found[t]] == []
    assert [t for t in bad if found[t]] == []


def test_a_repeated_detail_counts_once(spark):
    basic = spark.createDataFrame([("a", "b1"), ("b", "b2"), (None, "b3")], "id string, payload string")
    details = spark.createDataFrame([("a", "d1"), ("a", "d2")], "id string, payload string")
    rows = raw.with_details(basic, details, "id", "payload").collect()
    assert sorted(r.payload for r in rows) == ["b2", "b3", "d2"]


def test_rows_that_do_not_fit_are_named(spark):
    """Missing, extra and mistyped columns; null fits everywhere."""
    rows = [
        ("otx", "7", 2.0, 0.5, ["a"], "x", None, "12"), ("vt", " 8", 2.5, None, None, None, 1, "1e9"),
        (None, "many", 1e12, float("nan"), [], None, None, None), ("scc", None, float("nan"), 1.0, [None], None, None, "-3"),
        ("scc", "3000000000", None, 1.0, None, None, None, "2.0"),
    ]
    kind = "Source string, malicious_verdicts string, total_verdicts double, confidence_score float, tags array<string>, note string, Extra int, asn string"
    found = schemas.checked(spark.createDataFrame(rows, kind), row_col="given")
    assert [f.name for f in found.schema][:17] == [name for name, _ in fixed.INDICATOR_COLUMNS]
    assert [f.dataType.simpleString() for f in found.schema][:17] == [t for _, t in fixed.INDICATOR_COLUMNS]
    got = found.collect()
    assert [[(f.column, f.reason) for f in r.refusal] for r in got] == [
        [("note", "unknown column")],
        [("total_verdicts", "no int"), ("asn", "no bigint"), ("Extra", "unknown column")],
        [("malicious_verdicts", "no int"), ("total_verdicts", "no int")],
        [("total_verdicts", "no int")],
        [("malicious_verdicts", "no int"), ("asn", "no bigint")],
    ]
    assert (got[0].source, got[0].malicious_verdicts, got[0].total_verdicts, got[0].tags, got[0].asn) == ("otx", 7, 2, ["a"], 12)
    assert (got[1].malicious_verdicts, got[1].total_verdicts, got[1].country) == (8, None, None)
    assert json.loads(got[1].given)["total_verdicts"] == 2.5


def test_columns_of_other_shapes_are_refused(spark):
    df = spark.sql(
        "SELECT named_struct('a', 1) AS source, array(array('t')) AS tags, 'x' AS severity, true AS asn, map('k', 1) AS country,"
        " DATE '2024-01-02' AS first_seen, NULL AS description, array(1, 2) AS asn_owner"
    )
    row = schemas.checked(df).first()
    assert {f.column for f in row.refusal} == {"source", "tags", "asn", "country", "asn_owner"}
    assert (row.severity, row.first_seen, row.description) == ("x", "2024-01-02", None)
    assert schemas.checked(spark.createDataFrame([], "x int")).count() == 0


def test_refused_rows_are_kept_as_given(spark, tmp_path):
    df = spark.createDataFrame([("a", "1"), ("b", "no")], "source string, asn string")
    for _ in range(2):
        tables.append_checked(df, str(tmp_path / "table"), str(tmp_path / "refused"), 3)
    assert [r.source for r in tables.load_indicators(spark, str(tmp_path / "table")).collect()] == ["a"]
    refused = spark.read.parquet(str(tmp_path / "refused")).collect()
    assert [(json.loads(r.given), r.batch_id) for r in refused] == [({"source": "b", "asn": "no"}, 3)]


def test_rows_as_given_are_written_out_only_where_refused(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "no")], "source string, asn string")
    every = schemas.checked(df, row_col="given").orderBy("source").collect()
    some = schemas.checked(df, row_col="given", refused_only=True).orderBy("source").collect()
    assert [r.given is None for r in every] == [False, False]
    assert [r.given for r in some] == [None, every[1].given]


def test_a_batch_that_comes_twice_is_made_once(spark, sf_dir, monkeypatch):
    """Its second run reads what was made for the first."""
    append, scans = tables.append_checked, []

    def spy(rows, path, refused_path, batch_id):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        scans.append((batch_id, "l_orderkey" in plan))
        append(rows, path, refused_path, batch_id)

    monkeypatch.setattr(landing.tables, "append_checked", spy)
    landing.snk_table(spark, sf_dir)
    assert scans == [(0, False), (1, False), (1, False)]


def test_findings_belong_to_the_nearest_asset(spark):
    assets = [("//s/projects/p", "project"), ("//s/projects/p/items/i", "compute.googleapis.com/Instance"),
              ("//s/projects/p/items/i", "z"), (None, "x"), ("//s/projects/p2/items/j", "other")]
    findings = [
        (1, "//s/projects/p/items/i/disks/d", "high", "PUBLIC_IP"), (2, "//s/projects/p/items/i", "CRITICAL", "OPEN_PORT"),
        (3, "//s/projects/p/items/ii", "LOW", None), (4, "//s/projects/p2", "odd", "PUBLIC"), (5, None, None, None), (6, "", "LOW", "x"),
    ]
    findings += [(1000 + i, "//s/projects/p/items/i", "LOW", "x") for i in range(100)]
    df = spark.createDataFrame(findings, "id int, resource_name string, severity string, category string")
    rows = {r.id: r for r in correlation.correlate(df, spark.createDataFrame(assets, "name string, asset_type string"), "id").collect()}
    assert len(rows) == len(findings)
    assert [(rows[i].asset, rows[i].risk_score) for i in range(1, 7)] == [
        ("//s/projects/p/items/i", 0.8), ("//s/projects/p/items/i", 1.0), ("//s/projects/p", 0.2), (None, 0.1), (None, 0.1), (None, 0.2),
    ]
    assert (rows[1].mitigation, rows[4].mitigation) == ("fix within a day", "review")
    assert {rows[1000 + i].risk_score for i in range(100)} == {0.3}


def test_checked_rows_wait_on_disk_without_their_json(spark, tmp_path, monkeypatch):
    kept, persist = [], type(spark.range(1)).persist
    monkeypatch.setattr(type(spark.range(1)), "persist", lambda df, *level: kept.append((df, level)) or persist(df, *level))
    df = spark.createDataFrame([("a", "1"), ("b", "no")], "source string, asn string")
    tables.append_checked(df, str(tmp_path / "table"), str(tmp_path / "refused"), 0)
    ((checked, (level,)),) = kept
    assert not level.useMemory and level.useDisk
    assert {r.source: r.given is None for r in checked.collect()} == {"a": True, "b": False}


def test_raw_documents_are_written_compressed(spark, tmp_path):
    rows = spark.createDataFrame([('{"pulses": []}',), ("x",)], "content string").withColumn("feed", F.lit("scc"))
    tables.write_raw(rows, str(tmp_path / "raw"))
    tables.write_feed(rows.drop("feed"), str(tmp_path / "raw"), "scc")
    files = [p.name for p in (tmp_path / "raw" / "feed=scc").glob("part-*")]
    assert files and all(name.endswith(".txt.gz") for name in files)
    back = raw.read_raw(spark, str(tmp_path / "raw"), whole_files=False)
    assert sorted(r.content for r in back.collect()) == ["x", "x", '{"pulses": []}', '{"pulses": []}']


def test_findings_of_one_key_have_their_own_assets(spark):
    findings = spark.createDataFrame(
        [(None, "//s/projects/a"), (None, "//s/projects/b"), (1, "//s/projects/a"), (1, None)], "id int, resource_name string"
    )
    assets = spark.createDataFrame([("//s/projects/a", "x"), ("//s/projects/b", "y")], "name string, asset_type string")
    rows = correlation.with_asset(findings, assets, "id").collect()
    assert sorted((r.id or 0, r.resource_name or "", r.asset or "") for r in rows) == [
        (0, "//s/projects/a", "//s/projects/a"), (0, "//s/projects/b", "//s/projects/b"), (1, "", ""), (1, "//s/projects/a", "//s/projects/a"),
    ]
