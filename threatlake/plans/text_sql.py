"""SQL texts that state the text operators a second time, for checking."""

from __future__ import annotations

from threatlake.functions import fixed
from threatlake.plans import bridge

ADVISORIES = bridge.ansi(bridge.ADVISORIES)
TEXTS = bridge.ansi(bridge.TEXTS)

# Advisories and documents side by side.
DOCS = (
    f"SELECT 'advisory' AS corpus, doc_id, text FROM ({ADVISORIES}) AS a"
    " UNION ALL SELECT 'document', doc_id, text FROM documents"
)

_SPACE = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NONSPACE = _SPACE.replace("[", "[^", 1)

# The patterns as first published, with the engine's own word boundary.
_DOMAIN = r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}\b"
_QUAD = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
PATTERNS = {
    "ipv4": (_QUAD, ""),
    "ipv6": (r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", ""),
    "domain": (_DOMAIN, ""),
    "url": (
        r"\bhttps?://(?:[-\w.]|(?:%[\da-fA-F]{2}))+(?:/[-\w%!$&''()*+,;=:~]+)*"
        r"(?:\?[-\w%!$&''()*+,;=:~/.]+)?(?:#[-\w%!$&''()*+,;=:~/.]+)?\b",
        "",
    ),
    "md5": (r"\b[a-fA-F0-9]{32}\b", ""),
    "sha1": (r"\b[a-fA-F0-9]{40}\b", ""),
    "sha256": (r"\b[a-fA-F0-9]{64}\b", ""),
    "cve": (r"\bCVE-\d{4}-\d{4,7}\b", "i"),
    "email": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", ""),
}


def spans(source: str, keys: list[str], text: str, pattern: str, flags: str, extra: str) -> str:
    """Matches of one pattern with 0-based offsets; ``extra`` are further output items."""
    k = ", ".join(keys)
    return (
        f"SELECT {k}, {text}, {extra}, ms[i] AS value, i,"
        " CAST(coalesce(list_sum(list_transform(gs[1:i], lambda s: length(s))), 0)"
        " + coalesce(list_sum(list_transform(ms[1:i-1], lambda s: length(s))), 0) AS INTEGER) AS start_pos"
        f" FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT {k}, {text},"
        f" regexp_extract_all({text}, '{pattern}', 0, '{flags}') AS ms,"
        f" regexp_split_to_array({text}, '{pattern}', '{flags}') AS gs FROM ({source}) AS d) AS e"
        " WHERE len(ms) > 0) AS f"
    )


def _octet(n: int) -> str:
    return f"CAST(split_part(value, '.', {n}) AS BIGINT)"


_NUMBER = f"({_octet(1)} * 16777216 + {_octet(2)} * 65536 + {_octet(3)} * 256 + {_octet(4)})"
_IN_RANGE = " OR ".join(f"{_NUMBER} BETWEEN {lo} AND {hi}" for lo, hi in fixed.IPV4_EXCLUDED)
PUBLIC_IPV4 = (
    f"(CASE WHEN regexp_matches(value, '(^|\\.)0[0-9]') THEN false"
    f" WHEN greatest({_octet(1)}, {_octet(2)}, {_octet(3)}, {_octet(4)}) > 255 THEN false"
    f" WHEN {_NUMBER} IN (3221225481, 3221225482) THEN true ELSE NOT ({_IN_RANGE}) END)"
)
IS_FALSE_POSITIVE = (
    "((entity_type = 'ipv4' AND value IN ('0.0.0.0', '127.0.0.1', '255.255.255.255'))"
    " OR (entity_type = 'domain' AND value IN ('example.com', 'domain.com')))"
)


def candidates(source: str, keys: list[str], types: list[str] | None = None) -> str:
    parts = []
    for rank, (name, (pattern, flags)) in enumerate(PATTERNS.items()):
        if types is None or name in types:
            extra = f"'{name}' AS entity_type, {rank} AS type_rank"
            parts.append(spans(source, keys, "text", pattern, flags, extra))
    return " UNION ALL ".join(f"SELECT * FROM ({p}) AS p" for p in parts)


def entities(source: str, keys: list[str], types: list[str] | None = None) -> str:
    """Valid mentions with offsets and context."""
    return (
        f"SELECT {', '.join(keys)}, text, entity_type, type_rank, value, start_pos,"
        " CAST(start_pos + length(value) AS INTEGER) AS end_pos,"
        " substr(text, greatest(start_pos - 50, 0) + 1,"
        " start_pos + length(value) + 50 - greatest(start_pos - 50, 0)) AS context"
        f" FROM ({candidates(source, keys, types)}) AS c"
        f" WHERE NOT {IS_FALSE_POSITIVE} AND (entity_type <> 'ipv4' OR {PUBLIC_IPV4})"
    )


# --- severity -------------------------------------------------------------------------------------

KEYWORDS = ", ".join(
    f"({rank}, '{k}', '{level}', {w}::DOUBLE, {w * fixed.LEVEL_FACTORS[level]}::DOUBLE)"
    for rank, (k, level, w) in enumerate(fixed.SEVERITY_KEYWORDS)
)
_NEGATION = (
    r"\b(?:not|no longer|isn''t|doesn''t|won''t|cannot|can''t|never)\b"
    r"|\b(?:mitigated|resolved|fixed|patched|addressed)\b"
)


def hits(source: str, keys: list[str], text: str) -> str:
    """Keyword occurrences with their offset and whether the ten words before negate them."""
    k = ", ".join(keys)
    marked = (
        f"SELECT {k}, {text}, keyword_rank, keyword, level, weight, points,"
        f" regexp_extract_all({text}, '\\b' || keyword || '\\b', 0, 'i') AS ms,"
        f" regexp_split_to_array({text}, '\\b' || keyword || '\\b', 'i') AS gs"
        f" FROM ({source}) AS d CROSS JOIN (VALUES {KEYWORDS}) AS w(keyword_rank, keyword, level, weight, points)"
        f" WHERE contains(lower({text}), keyword)"
    )
    located = (
        f"SELECT {k}, {text}, keyword_rank, keyword, level, weight, points, i,"
        " CAST(list_sum(list_transform(gs[1:i], lambda s: length(s))) + (i - 1) * length(keyword) AS INTEGER) AS hit_pos"
        f" FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM ({marked}) AS a WHERE len(ms) > 0) AS b"
    )
    window = (
        f"array_to_string(list_filter(regexp_split_to_array(substr({text}, 1, hit_pos), '{_SPACE}+'),"
        " lambda w: w <> '')[-10:], ' ')"
    )
    return f"SELECT *, regexp_matches({window}, '{_NEGATION}', 'i') AS negated FROM ({located}) AS c"


CVSS_TEXT = r"CVSS(?:v\d)?\s+(?:Base\s+)?Score:\s*(\d+\.\d+)"


def cvss(text: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({text}, '{CVSS_TEXT}', 1, 'i'), '') AS DOUBLE)"


def assessment(source: str, keys: list[str], text: str) -> str:
    """score, level, confidence and number of pieces of evidence per text."""
    k = ", ".join(keys)
    on = " AND ".join(f"d.{c} = h.{c}" for c in keys)
    level = "CASE WHEN cvss >= 9 THEN 1.0 WHEN cvss >= 7 THEN 0.75 WHEN cvss >= 4 THEN 0.5 ELSE 0.25 END"
    whole_source, source = source, "SELECT * FROM texts_to_score"
    summed = (
        f"SELECT {k}, sum(weight) AS weight, sum(points) AS points, count(*) AS n"
        f" FROM ({hits(source, keys, text)}) AS x WHERE NOT negated GROUP BY {k}"
    )
    totals = (
        f"SELECT {', '.join('d.' + c for c in keys)}, d.{text}, nullif({cvss('d.' + text)}, 0.0) AS cvss,"
        " coalesce(h.weight, 0.0::DOUBLE) AS weight, coalesce(h.points, 0.0::DOUBLE) AS points, coalesce(h.n, 0) AS n"
        f" FROM ({source}) AS d LEFT JOIN ({summed}) AS h ON {on}"
    )
    whole = (
        f"SELECT *, n + CASE WHEN cvss IS NULL THEN 0 ELSE 1 END AS evidence,"
        f" CASE WHEN weight + CASE WHEN cvss IS NULL THEN 0 ELSE 2 END = 0 THEN 0.0::DOUBLE ELSE"
        f" (points + CASE WHEN cvss IS NULL THEN 0 ELSE 2 * {level} END) / (weight + CASE WHEN cvss IS NULL THEN 0 ELSE 2 END) END AS raw_score"
        f" FROM ({totals}) AS t"
    )
    return (
        f"WITH texts_to_score AS MATERIALIZED ({whole_source})"
        f" SELECT {k}, {text}, CAST(round(raw_score, 6) AS DOUBLE) AS score,"
        " CASE WHEN round(raw_score, 9) >= 0.8 THEN 'critical' WHEN round(raw_score, 9) >= 0.6 THEN 'high'"
        " WHEN round(raw_score, 9) >= 0.4 THEN 'medium' WHEN raw_score > 0 THEN 'low' ELSE 'unknown' END AS level,"
        " CAST(CASE WHEN evidence = 0 THEN 0.0 ELSE round(least(0.5 + 0.1 * evidence, 1.0), 6) END AS DOUBLE) AS confidence,"
        f" CAST(greatest(evidence, 1) AS BIGINT) AS evidence_count FROM ({whole}) AS w"
    )


def entity_assessment(source: str, keys: list[str]) -> str:
    """Entities with the adjusted severity of their context."""
    found = entities(source, keys)
    ek = [*keys, "entity_type", "type_rank", "value", "start_pos"]
    base = assessment(found, ek, "context")
    bad = "(entity_type IN ('ipv4', 'ipv6', 'domain') AND contains(lower(context), 'malicious'))"
    return (
        f"SELECT {', '.join(ek)},"
        f" CASE WHEN entity_type = 'cve' THEN greatest(score, 0.5::DOUBLE) WHEN {bad} THEN greatest(score, 0.7::DOUBLE) ELSE score END AS score,"
        f" CASE WHEN entity_type = 'cve' AND level = 'unknown' THEN 'medium' WHEN {bad} AND level IN ('unknown', 'low') THEN 'high' ELSE level END AS level,"
        " confidence,"
        f" evidence_count + CASE WHEN (entity_type = 'cve' AND level = 'unknown') OR ({bad} AND level IN ('unknown', 'low')) THEN 1 ELSE 0 END AS evidence_count"
        f" FROM ({base}) AS b"
    )


# --- cleaning ----------------------------------------------------------------------------------------

_TOKEN = rf"{_DOMAIN}|{_QUAD}|\b[a-fA-F0-9]{{32,64}}\b"


def cleaned(text: str = "text") -> str:
    """Markup out, white space collapsed, lower case outside protected tokens.

    Markup is taken out first here; tokens hold no angle brackets, so the order does not matter.
    """
    plain = f"regexp_replace({text}, '<[^>\\n]*>', ' ', 'g')"
    squeezed = f"trim(regexp_replace({plain}, '{_SPACE}+', ' ', 'g'), ' ')"
    return (
        "(SELECT array_to_string(list_transform(range(1, len(gs) + 1),"
        " lambda j: lower(gs[j]) || coalesce(ms[j], '')), '')"
        f" FROM (SELECT regexp_extract_all(s, '{_TOKEN}') AS ms, regexp_split_to_array(s, '{_TOKEN}') AS gs"
        f" FROM (SELECT {squeezed} AS s) AS q0) AS q1)"
    )


# --- relationships -----------------------------------------------------------------------------------

_IPS, _HASHES, _NET = "('ipv4','ipv6')", "('md5','sha1','sha256')", "('ipv4','ipv6','domain','url')"


def relation_type(s: str, t: str) -> str:
    return (
        f"CASE WHEN {s} IN {_IPS} AND {t} IN {_IPS} THEN 'communicates_with' WHEN {s} IN {_IPS} AND {t} = 'domain' THEN 'resolves_to'"
        f" WHEN {s} = 'domain' AND {t} IN {_IPS} THEN 'has_ip' WHEN {s} IN {_HASHES} AND {t} IN {_NET} THEN 'communicates_with'"
        f" WHEN {s} IN {_NET} AND {t} IN {_HASHES} THEN 'hosts' WHEN {s} = 'cve' AND {t} IN {_NET} THEN 'affects' ELSE 'related_to' END"
    )


def proximity(source: str) -> str:
    """Every pair of entities of a document whose source is near."""
    nodes = (
        "SELECT doc_id, entity_type, type_rank, value, start_pos, end_pos,"
        f" len(list_filter(regexp_split_to_array(substr(context, length(value) + 1), '{_SPACE}+'), lambda w: w <> '')) AS tokens"
        f" FROM ({entities(source, ['doc_id'])}) AS e"
    )
    return (
        "WITH nodes AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_pos, type_rank) AS seq"
        f" FROM ({nodes}) AS n)"
        " SELECT s.doc_id, s.entity_type AS source_type, s.value AS source_value, s.start_pos AS source_start,"
        " t.entity_type AS target_type, t.value AS target_value, t.start_pos AS target_start,"
        f" {relation_type('s.entity_type', 't.entity_type')} AS relationship_type,"
        " CAST(round(1.0 - s.tokens / 10.0, 6) AS DOUBLE) AS confidence,"
        " concat('Proximity-based relationship (', s.tokens, ' tokens apart)') AS evidence, 0 AS kind"
        " FROM (SELECT * FROM nodes WHERE tokens <= 10) AS s JOIN nodes AS t ON s.doc_id = t.doc_id AND s.seq < t.seq"
    )


def _phrase(template: str) -> tuple[str, bool]:
    source_first = template.index("{S}") < template.index("{T}")
    token = f"({_NONSPACE}+)"
    pattern = template.replace(" {", _SPACE + "+{").replace("} ", "}" + _SPACE + "+")
    pattern = pattern.replace("{S}", token).replace("{T}", token).replace("'", "''")
    return pattern, source_first


def phrases(source: str) -> str:
    """Phrase edges of the cleaned text; the last fitting entity wins."""
    parts = []
    for rank, (name, template) in enumerate(fixed.RELATION_PHRASES):
        pattern, source_first = _phrase(template)
        src, tgt = (1, 2) if source_first else (2, 1)
        parts.append(
            f"SELECT doc_id, {rank} AS pattern_rank, '{name}' AS relationship_type,"
            f" unnest(regexp_extract_all(cleaned, '{pattern}', {src}, 'i')) AS src,"
            f" unnest(regexp_extract_all(cleaned, '{pattern}', {tgt}, 'i')) AS tgt,"
            f" unnest(regexp_extract_all(cleaned, '{pattern}', 0, 'i')) AS evidence,"
            f" generate_subscripts(regexp_extract_all(cleaned, '{pattern}', 0, 'i'), 1) AS occurrence"
            " FROM texts"
        )
    found = " UNION ALL ".join(f"SELECT * FROM ({p}) AS p" for p in parts)
    last = "arg_max({{'entity_type': e.entity_type, 'value': e.value, 'start_pos': e.start_pos}}, CAST(e.type_rank AS BIGINT) * 1000000000 + e.start_pos)"
    pick = last.replace("{{", "{").replace("}}", "}")
    side = (
        "SELECT m.doc_id, m.pattern_rank, m.occurrence, any_value(m.relationship_type) AS relationship_type,"
        " any_value(m.evidence) AS evidence, {pick} AS hit FROM matches AS m JOIN ents AS e"
        " ON m.doc_id = e.doc_id AND contains(m.{token}, e.value) GROUP BY m.doc_id, m.pattern_rank, m.occurrence"
    )
    return (
        f"WITH texts AS (SELECT doc_id, {cleaned()} AS cleaned FROM ({source}) AS d),"
        f" ents AS (SELECT * FROM ({entities(source, ['doc_id'])}) AS e), matches AS ({found}),"
        f" s AS ({side.replace('{pick}', pick).replace('{token}', 'src')}),"
        f" t AS ({side.replace('{pick}', pick).replace('{token}', 'tgt')})"
        " SELECT s.doc_id, s.hit.entity_type AS source_type, s.hit.value AS source_value, s.hit.start_pos AS source_start,"
        " t.hit.entity_type AS target_type, t.hit.value AS target_value, t.hit.start_pos AS target_start,"
        " s.relationship_type, 0.9::DOUBLE AS confidence, s.evidence, s.pattern_rank * 100000 + s.occurrence AS kind"
        " FROM s JOIN t ON s.doc_id = t.doc_id AND s.pattern_rank = t.pattern_rank AND s.occurrence = t.occurrence"
    )


def merged(edges: str) -> str:
    """Highest confidence per source value, target value and type; first on ties."""
    return (
        "SELECT doc_id, source_type, source_value, source_start, target_type, target_value, target_start,"
        " relationship_type, confidence, evidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, source_value,"
        " target_value, relationship_type ORDER BY confidence DESC, kind, source_start, target_start) AS rn"
        f" FROM ({edges}) AS e) AS r WHERE rn = 1"
    )
