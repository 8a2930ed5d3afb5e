"""Queries over free text: cleaning, entities, relationships, severity, whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threatlake.functions import fixed
from threatlake.operators import clean, documents, entities, relations, severity
from threatlake.plans import bridge, text_sql
from threatlake.plans.registry import query

KEYS = ["corpus", "doc_id"]


def advisories(spark: SparkSession, sf: str) -> DataFrame:
    return bridge.spread_view(spark, sf, bridge.ADVISORIES)


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Both corpora under one id: documents count down from -1."""
    return bridge.spread_view(spark, sf, bridge.TEXTS)


def _text_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return bridge.spread(bridge.table(spark, sf, name))


def corpora(spark: SparkSession, sf: str) -> DataFrame:
    """Advisories and documents, whole."""
    docs = _text_table(spark, sf, "documents").select(
        F.lit("document").alias("corpus"), "doc_id", "text"
    )
    return advisories(spark, sf).select(F.lit("advisory").alias("corpus"), "doc_id", "text").unionByName(docs)


# --- cleaning ------------------------------------------------------------------------------------


@query(
    "txt_clean",
    f"SELECT corpus, doc_id, {text_sql.cleaned()} AS cleaned FROM ({text_sql.DOCS}) AS d",
)
def txt_clean(spark: SparkSession, sf: str) -> DataFrame:
    return corpora(spark, sf).select(*KEYS, clean.analysis_text(F.col("text")).alias("cleaned"))


@query(
    "txt_protect",
    f"SELECT corpus, doc_id, array_to_string(regexp_extract_all(text, '{text_sql._TOKEN}'), ' ') AS tokens"
    f" FROM ({text_sql.DOCS}) AS d",
)
def txt_protect(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens that must come out of cleaning as they went in."""
    return corpora(spark, sf).select(
        *KEYS, F.array_join(clean.protected_tokens(F.col("text")), " ").alias("tokens")
    )


@query(
    "txt_batch",
    "SELECT page_id, length(cleaned) AS cleaned_length, md5(cleaned) AS cleaned_md5 FROM"
    f" (SELECT page_id, {text_sql.cleaned('html')} AS cleaned FROM pages) AS p",
)
def txt_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Whole web pages."""
    pages = _text_table(spark, sf, "pages").select("page_id", "html")
    done = clean.batch_clean(pages, "html", remove_urls=False)
    return done.select(
        "page_id",
        F.length("cleaned").cast("bigint").alias("cleaned_length"),
        F.md5("cleaned").alias("cleaned_md5"),
    )


_STOPWORDS = ["the", "of", "and", "to", "a", "in", "is", "de", "la", "et", "der", "die", "und"]


@query(
    "txt_stop",
    "SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '" + text_sql._SPACE + "+'),"
    " lambda w: w <> '' AND lower(w) NOT IN (" + ", ".join(f"'{w}'" for w in _STOPWORDS) + ")), ' ') AS kept"
    " FROM documents",
)
def txt_stop(spark: SparkSession, sf: str) -> DataFrame:
    docs = _text_table(spark, sf, "documents")
    return docs.select("doc_id", clean.remove_stopwords(F.col("text"), _STOPWORDS).alias("kept"))


@query(
    "txt_ascii",
    "SELECT doc_id, regexp_replace(strip_accents(text), '[^\\x00-\\x7f]', '', 'g') AS ascii FROM documents",
)
def txt_ascii(spark: SparkSession, sf: str) -> DataFrame:
    docs = _text_table(spark, sf, "documents")
    return docs.select("doc_id", clean.to_ascii(F.col("text")).alias("ascii"))


# --- entities ----------------------------------------------------------------------------------------

_ENTITIES = text_sql.entities(text_sql.DOCS, KEYS)
_TEXT_ENTITIES = text_sql.entities(text_sql.TEXTS, ["doc_id"])


@query(
    "ent_extract",
    f"SELECT corpus, doc_id, entity_type, value, 1.0::DOUBLE AS confidence FROM ({_ENTITIES}) AS e",
)
def ent_extract(spark: SparkSession, sf: str) -> DataFrame:
    found = entities.mentions(corpora(spark, sf), KEYS)
    return found.select(*KEYS, "entity_type", "value", "confidence")


@query(
    "ent_pos",
    f"SELECT corpus, doc_id, entity_type, value, start_pos, end_pos FROM ({_ENTITIES}) AS e",
)
def ent_pos(spark: SparkSession, sf: str) -> DataFrame:
    found = entities.mentions(corpora(spark, sf), KEYS)
    return found.select(
        *KEYS, "entity_type", "value", F.col("start").alias("start_pos"), F.col("end").alias("end_pos")
    )


@query(
    "ent_context",
    f"SELECT corpus, doc_id, entity_type, start_pos, context FROM ({_ENTITIES}) AS e",
)
def ent_context(spark: SparkSession, sf: str) -> DataFrame:
    found = entities.mentions(corpora(spark, sf), KEYS)
    return found.select(*KEYS, "entity_type", F.col("start").alias("start_pos"), "context")


_PAGES = "SELECT page_id AS doc_id, html AS text FROM pages"


@query(
    "ent_fp",
    "SELECT doc_id, entity_type, value, start_pos FROM"
    f" ({text_sql.candidates(text_sql.TEXTS, ['doc_id'], ['ipv4', 'domain'])}) AS c"
    f" WHERE {text_sql.IS_FALSE_POSITIVE}",
)
def ent_fp(spark: SparkSession, sf: str) -> DataFrame:
    """The matches that are dropped as known false positives."""
    found = entities.candidates(texts(spark, sf), ["doc_id"])
    dropped = found.where(entities.is_false_positive(F.col("entity_type"), F.col("value")))
    return dropped.select("doc_id", "entity_type", "value", F.col("start").alias("start_pos"))


_QUADS = (
    "SELECT l_orderkey, l_linenumber, concat(l_partkey % 300, '.', l_suppkey % 260, '.', l_orderkey % 258, '.',"
    " CASE WHEN l_linenumber % 3 = 0 THEN concat('0', l_linenumber) ELSE concat('', l_linenumber) END) AS value FROM {lineitem}"
)


@query(
    "ent_ipv4",
    f"SELECT value, count(*) AS rows, bool_and({text_sql.PUBLIC_IPV4}) AS public"
    f" FROM ({bridge.ansi(_QUADS)}) AS q GROUP BY value",
)
def ent_ipv4(spark: SparkSession, sf: str) -> DataFrame:
    quads = bridge.view(spark, sf, _QUADS)
    checked = quads.select("value", entities.is_public_ipv4(F.col("value")).alias("public"))
    return checked.groupBy("value").agg(
        F.count("*").alias("rows"), F.bool_and("public").alias("public")
    )


@query(
    "ent_bytype",
    f"SELECT doc_id, entity_type, value, start_pos FROM ({text_sql.entities(_PAGES, ['doc_id'], ['domain'])}) AS d"
    " UNION ALL SELECT page_id, entity_type, value, start_pos FROM"
    f" ({text_sql.entities('SELECT page_id, url AS text FROM pages', ['page_id'], ['url'])}) AS u",
)
def ent_bytype(spark: SparkSession, sf: str) -> DataFrame:
    """Domains of whole pages and URLs of their addresses."""
    pages = _text_table(spark, sf, "pages").withColumnRenamed("page_id", "doc_id")
    domains = entities.mentions(pages, ["doc_id"], "html", ["domain"])
    urls = entities.mentions(pages, ["doc_id"], "url", ["url"])
    columns = ["doc_id", "entity_type", "value", F.col("start").alias("start_pos")]
    return domains.select(*columns).unionByName(urls.select(*columns))


@query("ent_unique", f"SELECT DISTINCT value FROM ({_ENTITIES}) AS e")
def ent_unique(spark: SparkSession, sf: str) -> DataFrame:
    return entities.unique_values(entities.mentions(corpora(spark, sf), KEYS))


_INDICATOR_TYPE = (
    "CASE WHEN entity_type IN ('ipv4', 'ipv6') THEN 'ip' WHEN entity_type IN ('md5', 'sha1', 'sha256') THEN 'hash' ELSE entity_type END"
)


@query(
    "ent_format",
    f"SELECT corpus, doc_id, {_INDICATOR_TYPE} AS indicator_type, value, 'nlp_extraction' AS source,"
    f" concat('extracted|type:', entity_type) AS tags FROM ({_ENTITIES}) AS e",
)
def ent_format(spark: SparkSession, sf: str) -> DataFrame:
    rows = entities.as_indicators(entities.mentions(corpora(spark, sf), KEYS))
    return rows.withColumn("tags", F.array_join("tags", "|"))


# --- relationships -----------------------------------------------------------------------------------

_EDGE_COLUMNS = (
    "doc_id, source_type, source_value, source_start, target_type, target_value, target_start,"
    " relationship_type, confidence, evidence"
)


def _edges(edges: DataFrame) -> DataFrame:
    return edges.select(
        "doc_id",
        F.col("source.entity_type").alias("source_type"),
        F.col("source.value").alias("source_value"),
        F.col("source.start").alias("source_start"),
        F.col("target.entity_type").alias("target_type"),
        F.col("target.value").alias("target_value"),
        F.col("target.start").alias("target_start"),
        "relationship_type",
        F.round("confidence", 6).alias("confidence"),
        "evidence",
    )


def _annotated(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf)
    return docs.select(
        "doc_id",
        clean.analysis_text(F.col("text")).alias("cleaned"),
        entities.entities_in(F.col("text")).alias("entities"),
    )


_PROXIMITY = text_sql.proximity(text_sql.TEXTS)
_PHRASES = text_sql.phrases(text_sql.TEXTS)


@query("rel_prox", f"SELECT {_EDGE_COLUMNS} FROM ({_PROXIMITY}) AS p")
def rel_prox(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf)
    found = docs.select("doc_id", entities.entities_in(F.col("text")).alias("entities"))
    return _edges(relations.proximity(found, ["doc_id"]))


@query(
    "rel_prox_nc",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,"
    " CAST(floor((l_suppkey - l_partkey) / 5.0) AS INTEGER) AS tokens,"
    " floor((l_suppkey - l_partkey) / 5.0) <= 10 AS near FROM lineitem",
)
def rel_prox_nc(spark: SparkSession, sf: str) -> DataFrame:
    """Distances from offsets, also negative ones."""
    rows = bridge.table(spark, sf, "lineitem")
    tokens = relations.offset_tokens(F.col("l_partkey"), F.col("l_suppkey"))
    return rows.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", tokens.alias("tokens"),
        (tokens <= fixed.MAX_TOKENS_BETWEEN).alias("near"),
    )


_KINDS = "['ipv4','ipv6','domain','url','md5','sha1','sha256','cve','email']"
_S, _T = f"{_KINDS}[CAST(l_partkey % 9 AS INTEGER) + 1]", f"{_KINDS}[CAST(l_suppkey % 9 AS INTEGER) + 1]"


@query(
    "rel_type",
    f"SELECT source_type, target_type, {text_sql.relation_type('source_type', 'target_type')} AS relationship_type, count(*) AS rows"
    f" FROM (SELECT {_S} AS source_type, {_T} AS target_type FROM lineitem) AS k GROUP BY source_type, target_type",
)
def rel_type(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array(*[F.lit(t) for t in fixed.ENTITY_TYPES])
    pairs = bridge.table(spark, sf, "lineitem").select(
        F.get(kinds, (F.col("l_partkey") % 9).cast("int")).alias("source_type"),
        F.get(kinds, (F.col("l_suppkey") % 9).cast("int")).alias("target_type"),
    )
    kind = relations.relationship_type(F.col("source_type"), F.col("target_type"))
    named = pairs.withColumn("relationship_type", kind)
    return named.groupBy("source_type", "target_type", "relationship_type").agg(
        F.count("*").alias("rows")
    )


@query("rel_ctx", f"SELECT {_EDGE_COLUMNS} FROM ({_PHRASES}) AS p")
def rel_ctx(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(relations.phrases(_annotated(spark, sf), ["doc_id"]))


@query("rel_merge", text_sql.merged(_PROXIMITY))
def rel_merge(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf)
    found = docs.select("doc_id", entities.entities_in(F.col("text")).alias("entities"))
    edges = relations.proximity(found, ["doc_id"])
    order = F.struct("source.start", "target.start")
    return _edges(relations.merge(edges.withColumn("_order", order), ["doc_id"], "_order"))


@query(
    "rel_all",
    text_sql.merged(f"SELECT * FROM ({_PROXIMITY}) AS p UNION ALL SELECT * FROM ({_PHRASES}) AS q"),
)
def rel_all(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(relations.relationships(_annotated(spark, sf), ["doc_id"]))


# --- severity -------------------------------------------------------------------------------------------


@query(
    "sev_cvss",
    f"SELECT corpus, doc_id, {text_sql.cvss('text')} AS cvss FROM ({text_sql.DOCS}) AS d",
)
def sev_cvss(spark: SparkSession, sf: str) -> DataFrame:
    return corpora(spark, sf).select(*KEYS, severity.cvss_score(F.col("text")).alias("cvss"))


_HITS = text_sql.hits(text_sql.DOCS, KEYS, "text")


@query(
    "sev_key",
    f"SELECT corpus, doc_id, keyword, level, weight, count(*) AS occurrences FROM ({_HITS}) AS h"
    " GROUP BY corpus, doc_id, keyword, level, weight",
)
def sev_key(spark: SparkSession, sf: str) -> DataFrame:
    found = severity.explode_hits(corpora(spark, sf), KEYS)
    return found.groupBy(*KEYS, "keyword", "level", "weight").agg(
        F.count("*").alias("occurrences")
    )


@query(
    "sev_neg",
    f"SELECT corpus, doc_id, keyword, negated, count(*) AS occurrences FROM ({_HITS}) AS h"
    " GROUP BY corpus, doc_id, keyword, negated",
)
def sev_neg(spark: SparkSession, sf: str) -> DataFrame:
    found = severity.explode_hits(corpora(spark, sf), KEYS)
    return found.groupBy(*KEYS, "keyword", "negated").agg(F.count("*").alias("occurrences"))


def _severity(column: str):
    s = F.col(column)
    return [
        F.round(s["score"], 6).alias("score"),
        s["level"].alias("level"),
        F.round(s["confidence"], 6).alias("confidence"),
        F.size(s["evidence"]).cast("bigint").alias("evidence_count"),
    ]


@query(
    "sev_text",
    f"SELECT corpus, doc_id, score, level, confidence, evidence_count FROM ({text_sql.assessment(text_sql.DOCS, KEYS, 'text')}) AS s",
)
def sev_text(spark: SparkSession, sf: str) -> DataFrame:
    scored = severity.text_severity(corpora(spark, sf))
    return scored.select(*KEYS, *_severity("text_severity"))


_ENTITY_SEVERITY = text_sql.entity_assessment(text_sql.TEXTS, ["doc_id"])


@query(
    "sev_ent",
    f"SELECT doc_id, entity_type, value, start_pos, score, level, confidence, evidence_count FROM ({_ENTITY_SEVERITY}) AS s",
)
def sev_ent(spark: SparkSession, sf: str) -> DataFrame:
    found = entities.mentions(texts(spark, sf), ["doc_id"])
    entity = F.struct("entity_type", "context")
    scored = found.withColumn("severity", severity.assess_entity(entity, F.lit("")))
    return scored.select(
        "doc_id", "entity_type", "value", F.col("start").alias("start_pos"), *_severity("severity")
    )


# --- whole documents ---------------------------------------------------------------------------------------

_CLEAN_DOCS = f"SELECT corpus, doc_id, text, {text_sql.cleaned()} AS cleaned FROM ({text_sql.DOCS}) AS d"
_COUNTS = (
    "SELECT corpus, doc_id, count(*) AS entity_count, count(DISTINCT entity_type) AS type_count"
    f" FROM ({_ENTITIES}) AS e GROUP BY corpus, doc_id"
)
_SUMMARY = (
    "SELECT c.corpus, c.doc_id, CAST(length(c.text) AS BIGINT) AS source_text_length,"
    " CAST(length(c.cleaned) AS BIGINT) AS preprocessed_text_length,"
    " coalesce(n.entity_count, 0) AS entity_count, coalesce(n.type_count, 0) AS type_count"
    f" FROM ({_CLEAN_DOCS}) AS c LEFT JOIN ({_COUNTS}) AS n ON c.corpus = n.corpus AND c.doc_id = n.doc_id"
)


def _summary(analyzed: DataFrame, keys: list[str]) -> DataFrame:
    counts = documents.summary(analyzed, keys)
    return counts.select(
        *keys, *[F.col(c).cast("bigint").alias(c) for c in counts.columns if c not in keys]
    )


@query("nlp_summary", _SUMMARY)
def nlp_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(documents.analyze(corpora(spark, sf)), KEYS)


# The parts of an analysis: its entities' severities and its relationships.
_RATED = (
    "SELECT doc_id, count(*) FILTER (level <> 'unknown') AS rated_entities, CAST(sum(CAST(round(score * 1000) AS BIGINT)) AS BIGINT) AS entity_score"
    f" FROM ({_ENTITY_SEVERITY}) AS s GROUP BY doc_id"
)
_RELATED = (
    "SELECT doc_id, count(*) AS relationships, CAST(sum(CAST(round(confidence * 1000) AS BIGINT)) AS BIGINT) AS edge_confidence FROM ("
    + text_sql.merged(f"SELECT * FROM ({_PROXIMITY}) AS p UNION ALL SELECT * FROM ({_PHRASES}) AS q")
    + ") AS m GROUP BY doc_id"
)


@query(
    "nlp_pipe",
    "SELECT s.*, t.score, t.level, t.confidence, t.evidence_count, coalesce(e.rated_entities, 0) AS rated_entities,"
    " coalesce(e.entity_score, 0) AS entity_score, coalesce(r.relationships, 0) AS relationships, coalesce(r.edge_confidence, 0) AS edge_confidence"
    f" FROM (SELECT *, CASE corpus WHEN 'advisory' THEN doc_id ELSE -1 - doc_id END AS text_id FROM ({_SUMMARY}) AS y) AS x"
    f" JOIN ({_SUMMARY}) AS s ON s.corpus = x.corpus AND s.doc_id = x.doc_id"
    f" JOIN ({text_sql.assessment('SELECT corpus, doc_id, cleaned FROM (' + _CLEAN_DOCS + ') AS x', KEYS, 'cleaned')}) AS t"
    " ON s.corpus = t.corpus AND s.doc_id = t.doc_id"
    f" LEFT JOIN ({_RATED}) AS e ON e.doc_id = x.text_id LEFT JOIN ({_RELATED}) AS r ON r.doc_id = x.text_id",
)
def nlp_pipe(spark: SparkSession, sf: str) -> DataFrame:
    """Whole analysis of every document, as one summary row."""
    analyzed, edges = documents.whole_analysis(corpora(spark, sf), KEYS)
    related = edges.groupBy(*KEYS).agg(
        F.count("*").alias("relationships"),
        F.sum(F.round(F.col("confidence") * 1000).cast("bigint")).alias("edge_confidence"),
    )
    counts = [
        F.col("source_text_length").cast("bigint").alias("source_text_length"),
        F.col("preprocessed_text_length").cast("bigint").alias("preprocessed_text_length"),
        F.size("entities").cast("bigint").alias("entity_count"),
        F.size(F.array_distinct(F.transform("entities", lambda e: e["entity_type"])))
        .cast("bigint")
        .alias("type_count"),
    ]
    rated = F.filter("entity_severities", lambda s: s["level"] != "unknown")
    points = F.transform("entity_severities", lambda s: F.round(s["score"] * 1000).cast("bigint"))
    summary = analyzed.select(
        *KEYS,
        *counts,
        *_severity("text_severity"),
        F.size(rated).cast("bigint").alias("rated_entities"),
        F.aggregate(points, F.lit(0).cast("bigint"), lambda total, p: total + p).alias("entity_score"),
    )
    none = F.lit(0).cast("bigint")
    return summary.join(related, KEYS, "left").withColumns(
        {c: F.coalesce(c, none) for c in ("relationships", "edge_confidence")}
    )


_TURNS = "SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations"
_TURN_RATED = (
    "SELECT doc_id, count(*) AS entities, count(*) FILTER (level <> 'unknown') AS rated"
    f" FROM ({text_sql.entity_assessment(_TURNS, ['doc_id'])}) AS s GROUP BY doc_id"
)


@query(
    "nlp_batch",
    "SELECT t.level, count(*) AS texts, sum(CAST(length(t.cleaned) AS BIGINT)) AS characters,"
    " CAST(sum(coalesce(e.entities, 0)) AS BIGINT) AS entities, CAST(sum(coalesce(e.rated, 0)) AS BIGINT) AS rated_entities FROM"
    f" ({text_sql.assessment('SELECT doc_id, ' + text_sql.cleaned() + ' AS cleaned FROM (' + _TURNS + ') AS c', ['doc_id'], 'cleaned')}) AS t"
    f" LEFT JOIN ({_TURN_RATED}) AS e ON e.doc_id = t.doc_id GROUP BY t.level",
)
def nlp_batch(spark: SparkSession, sf: str) -> DataFrame:
    """A list of texts: the turns of conversations."""
    analyzed = documents.analyze(_text_table(spark, sf, "conversations"))
    rated = F.filter("entity_severities", lambda s: s["level"] != "unknown")
    return analyzed.groupBy(F.col("text_severity.level").alias("level")).agg(
        F.count("*").alias("texts"),
        F.sum(F.length("cleaned").cast("bigint")).alias("characters"),
        F.sum(F.size("entities").cast("bigint")).alias("entities"),
        F.sum(F.size(rated).cast("bigint")).alias("rated_entities"),
    )


_FIRST_LEVEL = (
    "SELECT *, first_value(level) OVER (PARTITION BY doc_id, value ORDER BY type_rank, start_pos"
    f" ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_level FROM ({_ENTITY_SEVERITY}) AS s"
)


@query(
    "nlp_indic",
    f"SELECT doc_id, {_INDICATOR_TYPE} AS indicator_type, value, 'nlp_extraction' AS source,"
    " concat('extracted|type:', entity_type, CASE WHEN first_level = 'unknown' THEN '' ELSE concat('|severity:', first_level) END) AS tags"
    f" FROM ({_FIRST_LEVEL}) AS f",
)
def nlp_indic(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: documents to indicators."""
    rows = documents.indicators(texts(spark, sf), ["doc_id"])
    return rows.withColumn("tags", F.array_join("tags", "|"))


@query(
    "nlp_hilite",
    "SELECT a.doc_id, coalesce(h.highlights, '') AS highlights"
    f" FROM ({text_sql.TEXTS}) AS a LEFT JOIN ("
    "SELECT doc_id, string_agg(concat(start_pos, '-', start_pos + length(value), ' ', entity_type, ' ', first_level, ' ', value), ';'"
    f" ORDER BY start_pos, type_rank) AS highlights FROM ({_FIRST_LEVEL}) AS f GROUP BY doc_id) AS h ON a.doc_id = h.doc_id",
)
def nlp_hilite(spark: SparkSession, sf: str) -> DataFrame:
    marked = documents.highlights(texts(spark, sf), ["doc_id"])
    line = F.transform(
        "highlights",
        lambda h: F.format_string(
            "%s-%s %s %s %s", h["start"], h["end"], h["type"], h["severity"], h["text"]
        ),
    )
    return marked.select("doc_id", F.array_join(line, ";").alias("highlights"))
