"""Text operators against a plain restatement with CPython's regular expressions."""

import json
import random

import pytest
import samples
from pyspark.sql import functions as F

from threatlake.functions import fixed
from threatlake.operators import clean, documents, entities, relations, severity
from threatlake.plans import landing
from threatlake.plans import text as text_plans


def frame(spark, texts):
    rows = list(texts.items()) if isinstance(texts, dict) else list(enumerate(texts))
    return spark.createDataFrame([(str(k), v) for k, v in rows], "doc_id string, text string")


def dense_text(n, seed=7):
    """Many indicators, repeated values, keywords and negations in one text."""
    rnd = random.Random(seed)
    parts = []
    for i in range(n):
        parts.append(rnd.choice([
            f"{rnd.randint(1, 223)}.{rnd.randint(0, 255)}.7.{rnd.randint(1, 9)}",
            f"h{rnd.randint(1, 20)}.bad.net", "minor", "not", "ransomware", "never-ending",
            samples.MD5, "critical  vulnerability", "critical vulnerability", "word", "a\tb",
            "minor-minor-minor", "CVE-2024-1234", "x" * rnd.randint(1, 60),
        ]))
    return " ".join(parts)


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    """Samples, a dense text of several blocks, and whole documents and pages."""
    found = dict(samples.ADVISORIES)
    found["dense"] = dense_text(2000)
    found["astral"] = "".join(f"{'😀' * (i % 7)} 5.6.7.{i % 250} ü" for i in range(400))
    for name, key, column in (("documents", "doc_id", "text"), ("pages", "page_id", "html")):
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        for row in table.select(key, column).collect():
            found[f"{name}-{row[0]}"] = row[1]
    return found


def test_entities_equal_cpython(spark, texts):
    rows = entities.mentions(frame(spark, texts), ["doc_id"]).orderBy("type_rank", "start").collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.entity_type, r.value, r.start, r.end, r.context))
    expected = {k: samples.entities(t) for k, t in texts.items()}
    assert got == {k: v for k, v in expected.items() if v}
    assert len(got["dense"]) > 300


def test_every_type_is_found(spark):
    ipv6 = "2001:0db8:85a3:0000:0000:8a2e:0370:7334"
    text = f"5.6.7.8 {ipv6} a.bad.net http://a.bad.net/x {samples.MD5} {samples.SHA1} {samples.SHA256} cve-2024-12345 u@b.org"
    rows = entities.mentions(frame(spark, [text]), ["doc_id"]).collect()
    assert {r.entity_type for r in rows} == set(fixed.ENTITY_TYPES)


def test_unknown_type_is_refused():
    with pytest.raises(ValueError, match="Unknown entity type: phone"):
        entities.entities_in(F.col("text"), ["phone"])


def test_ipv4_edges_equal_ipaddress(spark):
    numbers = {n + d for lo, hi in fixed.IPV4_EXCLUDED for n in (lo, hi) for d in (-1, 0, 1)}
    numbers |= {n + d for n in fixed.IPV4_INCLUDED_ANYWAY for d in (-1, 0, 1)}
    values = [
        ".".join(str(n >> s & 255) for s in (24, 16, 8, 0)) for n in numbers if 0 <= n < 2**32
    ] + ["1.2.3.256", "01.2.3.4", "1.2.3", "1.2.3.4.5", "100.64.0.1", "99.99.99.99"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r.v: r.p for r in df.select("v", entities.is_public_ipv4(F.col("v")).alias("p")).collect()}
    assert got == {v: samples.public(v) for v in values}


def test_control_characters_do_not_disturb_offsets(spark):
    text = "a\u0001b 5.6.7.8 \u0002 5.6.7.9"
    rows = entities.mentions(frame(spark, [text]), ["doc_id"]).collect()
    assert [(r.value, r.start) for r in rows] == [("5.6.7.8", 4), ("5.6.7.9", 14)]


def test_severity_equals_restatement(spark, texts):
    rows = severity.text_severity(frame(spark, texts)).collect()
    for row in rows:
        if row.doc_id == "accents":
            continue
        score, level, confidence, lines = samples.severity(texts[row.doc_id])
        s = row.text_severity
        assert (s.level, list(s.evidence)) == (level, lines), row.doc_id
        assert s.score == pytest.approx(score) and s.confidence == pytest.approx(confidence)


def test_negation_windows(spark):
    texts = [
        "no\n longer a minor issue",
        "not one two three four five six seven eight nine minor",
        "not one two three four five six seven eight nine ten minor",
        "never " + "minor-" * 80 + "minor",
        "never " + "minor " * 80,
        '"not"minor minor',
    ]
    rows = severity.explode_hits(frame(spark, texts), ["doc_id"]).groupBy("doc_id").agg(
        F.sum(F.col("negated").cast("int")).alias("negated"), F.count("*").alias("n")
    ).collect()
    got = {int(r.doc_id): (r.negated, r.n) for r in rows}
    expected = {
        i: (sum(n for _, n in samples.hits(t)), len(samples.hits(t))) for i, t in enumerate(texts)
    }
    assert got == expected


def test_keywords_that_start_alike(spark):
    words = [("high", "high", 0.5), ("high risk", "high", 0.8), ("risk", "low", 0.1)]
    df = frame(spark, ["A high risk, high"])
    hits = df.select(severity.keyword_hits(F.col("text"), words).alias("h")).first().h
    assert sorted(h.keyword_rank for h in hits) == [0, 0, 1, 2]


def _edges(df):
    return sorted(
        (r.source.value, r.target.value, r.relationship_type, round(r.confidence, 9),
         r.source.start, r.target.start)
        for r in df.collect()
    )


def _rounded(edges):
    return sorted((*e[:3], round(e[3], 9), *e[4:]) for e in edges)


@pytest.mark.parametrize("pairs_per_task", [2_000_000, 50])
def test_relationships_equal_restatement(spark, monkeypatch, pairs_per_task):
    """Also when the pairs of a document are cut into parts."""
    monkeypatch.setattr(relations, "_PAIRS_PER_TASK", pairs_per_task)
    texts = {k: v for k, v in samples.ADVISORIES.items() if v.strip()}
    texts["dense"] = dense_text(120)
    texts["spaced"] = " ".join(f"{i % 5 + 1}.9.9.9 {'y' * 40} {'z' * 45}" for i in range(40))
    for key, text in texts.items():
        df = documents.analyze(frame(spark, {key: text}))
        cleaned = df.first().cleaned
        found = samples.entities(text)
        near, stated = samples.proximity(found), samples.phrase_edges(cleaned, found)
        assert _edges(relations.proximity(df, ["doc_id"])) == _rounded(near), key
        assert _edges(relations.phrases(df, ["doc_id"])) == _rounded(stated), key
        merged = _edges(relations.relationships(df, ["doc_id"]))
        assert merged == _rounded(samples.merged(near + stated)), key


def test_small_documents_are_merged_in_their_row(spark, monkeypatch):
    """Only documents of many pairs, or whose id comes again or is null, go through a shuffle."""
    whole = dict(enumerate(dense_text(40, i) for i in range(4)))
    rows = [("a", whole[0]), ("b", whole[1]), ("b", whole[2]), (None, whole[3]), (None, whole[0]), ("c", "5.6.7.8")]
    df = documents.analyze(spark.createDataFrame(rows, "doc_id string, text string"))
    dealt_out, by_parts = [], relations._edges_by_parts

    def spy(prepared, *rest):
        dealt_out.append(sorted(str(r.doc_id) for r in prepared.select("doc_id").collect()))
        return by_parts(prepared, *rest)

    def edges(limit):
        monkeypatch.setattr(relations, "_PAIRS_IN_ROW", limit)
        found = relations.relationships(df, ["doc_id"]).collect()
        return sorted((str(r.doc_id), r.source, r.target, r.relationship_type, r.confidence, r.evidence) for r in found)

    monkeypatch.setattr(relations, "_edges_by_parts", spy)
    some = edges(10_000)
    assert dealt_out == [["None", "None", "b", "b"]]
    monkeypatch.setattr(relations, "_REPEATED_IDS", 0)
    assert edges(10_000) == some == edges(0)
    assert dealt_out[-1] == ["None", "None", "a", "b", "b", "c"]
    keys = [(d, s.value, t.value, kind) for d, s, t, kind, *_ in some]
    assert len(keys) == len(set(keys)) > 60


def test_phrases_are_first_looked_for_as_plain_words(spark):
    text = (
        "a.bad.net RESIDES ON 5.6.7.8 and Exploitation of x1 by y1; p's campaign using q, p campaign using q"
        " connections from a to b Connection between c and d \u212a.net was\thosted on e was Hosted On\u2003f"
    )
    found = frame(spark, [text]).select(relations.phrase_matches(F.col("text")).alias("m"))
    assert "RLIKE" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = [(m.pattern_rank, m.src, m.tgt) for m in found.first().m]
    assert got == [
        (3, "a", "b"), (3, "c", "d"), (8, "e", "f"), (10, "a.bad.net", "5.6.7.8"), (13, "y1;", "x1"),
        (16, "q,", "p's"), (16, "q", "p"),
    ]


def test_merging_twice_changes_nothing(spark):
    df = documents.analyze(frame(spark, {"d": dense_text(60)}))
    once = relations.relationships(df, ["doc_id"])
    twice = relations.merge(once.withColumn("o", F.col("source.start")), ["doc_id"], "o")
    assert _edges(once) == _edges(twice)


def test_clean(spark):
    text = "See <a href='x.Evil.com'>HERE</a> Evil.COM  at 1.2.3.4, http://a.B.com/Path www.9 DONE!"
    df = frame(spark, [text])

    def cleaned(**flags):
        return df.select(clean.clean(F.col("text"), **flags)).first()[0]

    assert cleaned(remove_urls=False) == "see here Evil.COM at 1.2.3.4, http://a.B.com/path www.9 done!"
    assert cleaned() == "see here Evil.COM at 1.2.3.4, done!"
    assert cleaned(remove_punctuation=True) == "see here Evil.COM at 1.2.3.4 done"
    assert cleaned(remove_html=False, lowercase=False, keep_special_tokens=False) == (
        "See <a href='x.Evil.com'>HERE</a> Evil.COM at 1.2.3.4, DONE!"
    )
    assert cleaned(remove_urls=False, restore_tokens=False) == (
        "see here __domain_2__ at __ip_1__, http://__domain_0__/path www.9 done!"
    )


def test_stopwords_and_ascii(spark):
    df = frame(spark, [" The cat\tand THE  dög ", "plain", "ﬁne ½ Straße"])
    kept = [r[0] for r in df.select(clean.remove_stopwords(F.col("text"), ["the", "and"])).collect()]
    assert kept == ["cat dög", "plain", "ﬁne ½ Straße"]
    ascii_ = [r[0] for r in df.select(clean.to_ascii(F.col("text"))).collect()]
    assert ascii_ == [" The cat\tand THE  dog ", "plain", "fine 12 Strae"]


def test_documents(spark):
    df = frame(spark, samples.ADVISORIES)
    counts = {r.doc_id: r for r in documents.summary(documents.analyze(df), ["doc_id"]).collect()}
    assert counts["blank"].asDict() == {
        "doc_id": "blank", "source_text_length": 0, "preprocessed_text_length": 0,
        "entity_count": 0, "type_count": 0,
    }
    for key, text in samples.ADVISORIES.items():
        if text.strip():
            found = samples.entities(text)
            assert counts[key].entity_count == len(found)
            assert counts[key].type_count == len({e[0] for e in found})
    blank = documents.analyze(df).where("doc_id = 'blank'").first().text_severity
    assert (blank.level, list(blank.evidence)) == ("unknown", [])


def test_indicators_carry_the_first_severity_of_a_value(spark):
    text = "c.bad.net " + "x " * 60 + "ransomware near c.bad.net and CVE-2024-1111"
    rows = documents.indicators(frame(spark, [text]), ["doc_id"]).collect()
    assert [(r.indicator_type, r.tags) for r in rows] == [
        ("domain", ["extracted", "type:domain"]),
        ("domain", ["extracted", "type:domain"]),
        ("cve", ["extracted", "type:cve", "severity:critical"]),
    ]


def test_highlights_are_ordered(spark):
    row = documents.highlights(frame(spark, samples.ADVISORIES), ["doc_id"]).where("doc_id = 'list'").first()
    starts = [h.start for h in row.highlights]
    assert starts == sorted(starts)
    assert all(row.text[h.start : h.end] == h.text for h in row.highlights)


def test_levels_of_first_mentions(spark):
    """Every mention has the level of the first mention of its value, in extraction order."""
    df = frame(spark, {"dense": dense_text(900), "one": "5.6.7.8", "none": "word", "null": None})
    rated = {r.doc_id: r for r in documents.analyze(df).collect()}
    for row in documents.highlights(df, ["doc_id"]).collect():
        first = {}
        for e, s in zip(rated[row.doc_id].entities, rated[row.doc_id].entity_severities, strict=True):
            first.setdefault(e.value, s.level)
        assert len(row.highlights) == len(rated[row.doc_id].entities)
        assert all(h.severity == first[h.text] for h in row.highlights)
    assert len({s.level for s in rated["dense"].entity_severities}) > 1


def merged_report(rows):
    """The parts of one document laid over each other, as ``documents.report_parts`` says."""
    whole = {"entities": {}, "relationships": [], "entity_severities": []}
    for r in sorted(rows, key=lambda r: (r.section, r.place, r.report)):
        part = json.loads(r.report)
        for kind, items in part.pop("entities", {}).items():
            whole["entities"].setdefault(kind, []).extend(items)
        for name in ("relationships", "entity_severities"):
            whole[name] += part.pop(name, [])
        assert not part or "text_severity" not in whole
        whole |= part
    return whole


@pytest.mark.parametrize("items", [2, 256])
def test_reports_in_parts_are_complete(spark, monkeypatch, tmp_path, items):
    monkeypatch.setattr(documents, "REPORT_ITEMS", items)
    texts = samples.ADVISORIES | {"dense": dense_text(40)}
    df = frame(spark, texts).withColumn("source", F.create_map(F.lit("id"), "doc_id"))
    documents.write_reports(df, ["doc_id"], str(tmp_path / "reports"), metadata_col="source")
    rows = spark.read.schema("doc_id string, section int, place array<long>, report string").json(str(tmp_path / "reports")).collect()
    parts = {}
    for r in rows:
        parts.setdefault(r.doc_id, []).append(r)
    reports = {d: merged_report(own) for d, own in parts.items()}
    assert set(reports) == set(texts)
    analyzed = documents.analyze(df)
    edges = relations.relationships(analyzed, ["doc_id"]).collect()
    for r in analyzed.collect():
        report, own = reports[r.doc_id], [e for e in edges if e.doc_id == r.doc_id]
        by_type = {}
        for e in r.entities:
            whole = {"value": e.value, "type": e.entity_type, "confidence": 1.0, "context": e.context, "position": [e.start, e.end]}
            by_type.setdefault(e.entity_type, []).append(whole)
        assert report["entities"] == by_type
        assert [s["severity_level"] for s in report["entity_severities"]] == [s.level for s in r.entity_severities]
        assert report["text_severity"]["severity_level"] == r.text_severity.level
        assert report["metadata"] == {"id": r.doc_id}
        every = [e for found in by_type.values() for e in found]
        assert all(x[end] in every for x in report["relationships"] for end in ("source", "target"))

        def plain(source, target, kind, confidence, evidence):
            return (*source, *target, kind, round(confidence, 9), evidence)

        assert sorted(
            plain([x["source"]["type"], *x["source"]["position"]], [x["target"]["type"], *x["target"]["position"]],
                  x["relationship_type"], x["confidence"], x["evidence"])
            for x in report["relationships"]
        ) == sorted(
            plain([e.source.entity_type, e.source.start, e.source.end], [e.target.entity_type, e.target.start, e.target.end],
                  e.relationship_type, e.confidence, e.evidence)
            for e in own
        )


def test_lines_of_a_report_follow_each_other(spark, tmp_path):
    path = str(tmp_path / "reports")
    documents.write_reports(frame(spark, {str(i): dense_text(30, i) for i in range(12)}), ["doc_id"], path)
    names = sorted(p.name for p in (tmp_path / "reports").glob("part-*"))
    lines = [json.loads(line) for name in names for line in (tmp_path / "reports" / name).read_text().splitlines()]
    order = [(r["doc_id"], r["section"], r["place"]) for r in lines]
    assert order == sorted(order) and len({d for d, *_ in order}) == 12


def test_registered_reports_are_compressed(spark, sf_dir, monkeypatch, tmp_path):
    """They are read back from compressed lines."""
    monkeypatch.setattr(landing, "scratch_path", lambda _, purpose: str(tmp_path / purpose))
    monkeypatch.setattr(text_plans, "texts", lambda spark, _: frame(spark, samples.ADVISORIES).withColumn("doc_id", F.hash("doc_id").cast("bigint")))
    rows = landing.snk_json(spark, sf_dir).collect()
    assert len(rows) == len(samples.ADVISORIES)
    names = [p.name for p in (tmp_path / "reports").rglob("part-*")]
    assert names and all(name.endswith(".json.gz") for name in names)


def test_text_jobs_do_not_shuffle(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df in (
        documents.indicators(docs, ["doc_id"]),
        documents.analyze(docs),
        entities.mentions(docs, ["doc_id"]),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        # The text is read once, and no other column that is not asked for.
        assert plan.count("FileScan parquet") == 1
    narrow = entities.mentions(docs, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in narrow


def test_long_tokens_need_no_stack(spark):
    """A million labels, or parts of a path, in a session with plain settings."""
    from threatlake.operators import clean, entities, scc

    texts = [
        ("a." * 1_000_000 + "com", ["domain"], 1),
        ("1." * 300_000, ["domain"], 0),
        ("http://a" + "/b" * 300_000 + ",", ["url"], 1),
        ("http://" + "%41" * 300_000 + "-", ["url"], 1),
    ]
    for text, types, n in texts:
        row = spark.createDataFrame([(text,)], "text string").select(
            F.size(entities.entities_in(F.col("text"), types)).alias("n"),
            F.length(clean.analysis_text(F.col("text"))).alias("cleaned"),
            F.regexp_extract("text", scc.FINDING_DOMAIN, 0).alias("finding"),
        ).first()
        assert row["n"] == n
        assert row["cleaned"] == len(text)


def test_patterns_equal_the_published_ones(spark):
    """Random texts of awkward parts, against the patterns as first published."""
    import random
    import re

    from threatlake.operators import entities

    label = r"[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\."
    tail = r"[-\w%!$&'()*+,;=:~/.]"
    published = {
        "domain": rf"\b(?:{label})+[a-zA-Z]{{2,}}\b",
        "url": r"\bhttps?://(?:[-\w.]|(?:%[\da-fA-F]{2}))+(?:/[-\w%!$&'()*+,;=:~]+)*"
        rf"(?:\?{tail}+)?(?:#{tail}+)?\b",
    }
    r = random.Random(3)
    parts = ["a", "bc", "com", ".", ".", "-", "1", "é", "_", " ", "x" * 62, "x" * 63, "x" * 64]
    path = ["a", "bc", ".", "-", "/", "/", "%41", "%", "?", "#", ",", "é", "~", " ", "1", "!"]
    texts = ["".join(r.choices(parts, k=r.randint(2, 16))) for _ in range(4000)]
    texts += ["http://" + "".join(r.choices(path, k=r.randint(1, 14))) for _ in range(4000)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    found = rows.select(
        "text",
        *[F.regexp_extract_all("text", F.lit(entities._PATTERNS[n][0]), F.lit(0)).alias(n) for n in published],
    )
    for row in found.collect():
        for name, pattern in published.items():
            assert list(row[name]) == [m[0] for m in re.finditer(pattern, row["text"])], (name, row["text"])


def test_a_table_of_one_row_group_is_dealt_out(spark, sf_dir):
    cores = spark.sparkContext.defaultParallelism
    assert text_plans.texts(spark, sf_dir).rdd.getNumPartitions() >= 4 * cores
