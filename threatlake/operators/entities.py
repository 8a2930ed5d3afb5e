"""Indicators of compromise in free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threatlake.functions import fixed
from threatlake.functions.columns import (
    empty_array,
    let,
    lookup,
    marked_pieces,
    match_spans,
    text_blocks,
    text_span,
)

MENTION = (
    "struct<entity_type:string,type_rank:int,value:string,start:int,end:int,"
    "context:string,confidence:double>"
)


def _bounded(kind: str, pattern: str) -> str:
    return f"{fixed.BEGINNINGS[kind]}{fixed.EDGE_BEFORE}{pattern}{fixed.EDGE_AFTER}"


# pattern, and a cheap necessary condition that spares most texts the full pattern
_PATTERNS = {
    "ipv4": (_bounded("ipv4", fixed.IPV4), lambda t: t.rlike(r"[0-9]\.[0-9]{1,3}\.[0-9]")),
    "ipv6": (_bounded("ipv6", fixed.IPV6), lambda t: t.rlike(f"{fixed.HEX}:{fixed.HEX}{{1,4}}:")),
    "domain": (_bounded("domain", fixed.DOMAIN), lambda t: t.rlike(r"\.[a-zA-Z]{2}")),
    "url": (
        f"{fixed.BEGINNINGS['url']}{fixed.EDGE_BEFORE}{fixed.URL}{fixed.EDGE}",
        lambda t: t.contains("://"),
    ),
    "cve": (_bounded("cve", fixed.CVE), lambda t: t.rlike("(?i)CVE-")),
    "email": (
        f"{fixed.BEGINNINGS['email']}{fixed.EDGE}{fixed.EMAIL}{fixed.EDGE}",
        lambda t: t.contains("@"),
    ),
    **{
        name: (_bounded("hash", f"{fixed.HEX}{{{size}}}"), lambda t: t.rlike(f"{fixed.HEX}{{32}}"))
        for name, size in fixed.HEX_LENGTHS.items()
    },
}


def is_public_ipv4(value: Column) -> Column:
    """A well-formed address outside the private, loopback, multicast and reserved networks."""
    octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"

    def outside(octets: Column) -> Column:
        parts = [octets[i].cast("bigint") for i in range(4)]
        number = parts[0] * 16777216 + parts[1] * 65536 + parts[2] * 256 + parts[3]
        return let(
            number,
            lambda n: ~_any([n.between(lo, hi) for lo, hi in fixed.IPV4_EXCLUDED])
            | n.isin(fixed.IPV4_INCLUDED_ANYWAY),
        )

    well_formed = value.rlike(rf"^(?:{octet}\.){{3}}{octet}$")
    return F.coalesce(
        F.when(well_formed, let(F.split(value, r"\."), outside)).otherwise(False), F.lit(False)
    )


def is_false_positive(entity_type: Column, value: Column) -> Column:
    return _any(
        [
            (entity_type == name) & value.isin(values)
            for name, values in fixed.FALSE_POSITIVES.items()
        ]
    )


def context_of(blocks: Column, start: Column, end: Column) -> Column:
    """The match with up to 50 characters on either side."""
    left = F.greatest(start - fixed.CONTEXT_CHARS, F.lit(0))
    return text_span(blocks, left, end + fixed.CONTEXT_CHARS)


_CUT = "struct<entity_type:string,type_rank:int,pieces:array<string>>"


def _cuts(text: Column, types: list[str]) -> Column:
    """The text cut at the matches of each type, in type order; only types that may match."""

    def cut(entity_type: str) -> Column:
        return F.struct(
            F.lit(entity_type).alias("entity_type"),
            F.lit(fixed.ENTITY_TYPES.index(entity_type)).alias("type_rank"),
            marked_pieces(text, _PATTERNS[entity_type][0]).alias("pieces"),
        )

    parts = []
    for entity_type in types:
        if entity_type not in fixed.HEX_LENGTHS:
            guard = _PATTERNS[entity_type][1](text)
            parts.append(F.when(guard, F.array(cut(entity_type))).otherwise(empty_array(_CUT)))
    hexes = [t for t in types if t in fixed.HEX_LENGTHS]
    if hexes:
        # One look for a long hexadecimal run settles all three hash types.
        guard = _PATTERNS[hexes[0]][1](text)
        found = F.when(guard, F.array(*[cut(t) for t in hexes])).otherwise(empty_array(_CUT))
        parts.insert(len([t for t in types if t in ("ipv4", "ipv6", "domain", "url")]), found)
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def _mentions(text: Column, types: list[str], validated: bool) -> Column:
    def mention(cut: Column, m: Column, blocks: Column) -> Column:
        end = m["start"] + F.length(m["value"])
        return F.struct(
            cut["entity_type"].alias("entity_type"),
            cut["type_rank"].alias("type_rank"),
            m["value"].alias("value"),
            m["start"].alias("start"),
            end.alias("end"),
            context_of(blocks, m["start"], end).alias("context"),
            F.lit(1.0).alias("confidence"),
        )

    def of_type(cut: Column, blocks: Column) -> Column:
        found = match_spans(cut["pieces"])
        if validated:
            found = F.filter(found, lambda m: _is_valid(cut["entity_type"], m["value"]))
        return F.transform(found, lambda m: mention(cut, m, blocks))

    both = F.struct(_cuts(text, types).alias("cuts"), text_blocks(text).alias("blocks"))
    found = let(both, lambda b: F.flatten(F.transform(b["cuts"], lambda c: of_type(c, b["blocks"]))))
    return found.cast(f"array<{MENTION}>")


def _is_valid(entity_type: Column, value: Column) -> Column:
    return (
        F.when(is_false_positive(entity_type, value), False)
        .when(entity_type == "ipv4", is_public_ipv4(value))
        .otherwise(True)
    )


def entities_in(text: Column, types: list[str] | None = None) -> Column:
    """All entities of a text as one array, in type order and then by position.

    Types are matched independently, so an email's host is also a domain.
    """
    wanted = fixed.ENTITY_TYPES if types is None else types
    unknown = [t for t in wanted if t not in fixed.ENTITY_TYPES]
    if unknown:
        raise ValueError(f"Unknown entity type: {', '.join(unknown)}")
    ordered = [t for t in fixed.ENTITY_TYPES if t in wanted]
    return F.coalesce(_mentions(text, ordered, True), empty_array(MENTION))


def extract_entities(
    docs: DataFrame, text_col: str = "text", types: list[str] | None = None
) -> DataFrame:
    """Add the array column ``entities``; no shuffle."""
    return docs.withColumn("entities", entities_in(F.col(text_col), types))


def explode_array(df: DataFrame, array_col: str, position: str | None = None) -> DataFrame:
    """One row per struct in ``array_col``, its fields as columns.

    The outer form is deliberate: a plain explode makes the optimizer add ``size(array) > 0``
    below the generator, which would evaluate the regular expressions twice.
    """
    rest = [c for c in df.columns if c != array_col]
    rows = df.select(*rest, F.posexplode_outer(array_col).alias("_pos", "_item"))
    rows = rows.where(F.col("_pos").isNotNull())
    if position:
        rest = [*rest, F.col("_pos").alias(position)]
    return rows.select(*rest, "_item.*")


def mentions(
    docs: DataFrame,
    id_cols: list[str],
    text_col: str = "text",
    types: list[str] | None = None,
) -> DataFrame:
    """One row per entity mention."""
    found = docs.select(*id_cols, entities_in(F.col(text_col), types).alias("entities"))
    return explode_array(found, "entities")


def candidates(docs: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """Mentions before the false-positive and address checks."""
    found = _mentions(F.col(text_col), fixed.ENTITY_TYPES, False)
    return explode_array(docs.select(*id_cols, found.alias("entities")), "entities")


def unique_values(found: DataFrame) -> DataFrame:
    return found.select("value").distinct()


def indicator_type_of(entity_type: Column) -> Column:
    return F.coalesce(lookup(fixed.ENTITY_TO_INDICATOR, entity_type), entity_type)


def as_indicators(found: DataFrame) -> DataFrame:
    """Mentions in the form the risk model scores."""
    rest = [c for c in found.columns if c not in _MENTION_FIELDS]
    return found.select(
        *rest,
        indicator_type_of(F.col("entity_type")).alias("indicator_type"),
        "value",
        F.lit(fixed.EXTRACTED_SOURCE).alias("source"),
        F.array(F.lit("extracted"), F.concat(F.lit("type:"), "entity_type")).alias("tags"),
    )


_MENTION_FIELDS = ["entity_type", "type_rank", "value", "start", "end", "context", "confidence"]


def _any(conditions: list[Column]) -> Column:
    result = conditions[0]
    for condition in conditions[1:]:
        result = result | condition
    return result

