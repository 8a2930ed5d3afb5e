"""Advisory texts and a plain restatement of the text operators to compare with."""

from __future__ import annotations

import ipaddress
import re

from threatlake.functions import fixed

MD5 = "0cc175b9c0f1b6a831c399e269772661"
SHA1 = "86f7e437faa5a7fce15d1ddcb9eaeaea377667b8"
SHA256 = "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"

ADVISORIES = {
    "short": (
        "The loader talks to stage.bad-host.net and 45.77.10.9.\n It uses CVE-2024-3094, which has "
        f"a CVSS Score: 8.5 and needs immediate action. MD5 {MD5}"
    ),
    "list": (
        "Known infrastructure:\n - 5.6.7.8\n - 10.1.2.3 (internal)\n - 192.0.2.7 (example)\n"
        f" - cdn.evil.org, api.evil.org\n - {SHA256}\n - {SHA1}\n Mail ops@evil.org or visit "
        "https://pay.evil.org/a/b?x=1 soon. A critical vulnerability, widespread."
    ),
    "negated": (
        "This is not a zero-day and was patched last week; one two three four five six seven eight "
        "nine ten eleven ransomware. It isn't serious. National security bulletin."
    ),
    "phrases": (
        f"Then a.bad.net communicates with 8.8.4.4 and {MD5} was found in b.bad.net while "
        "8.8.4.4 hosts a.bad.net . <b>Malicious</b> c.bad.net"
    ),
    "accents": "éa.bad.net aé.bad.net x y.bad.net zero day zero day MINOR ſerious",
    "blank": " \n\t ",
    "empty": "",
}

_PY = {
    "ipv4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "ipv6": r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b",
    "domain": r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}\b",
    "url": (
        r"\bhttps?://(?:[-\w.]|(?:%[\da-fA-F]{2}))+(?:/[-\w%!$&'()*+,;=:~]+)*"
        r"(?:\?[-\w%!$&'()*+,;=:~/.]+)?(?:#[-\w%!$&'()*+,;=:~/.]+)?\b"
    ),
    "md5": r"\b[a-fA-F0-9]{32}\b",
    "sha1": r"\b[a-fA-F0-9]{40}\b",
    "sha256": r"\b[a-fA-F0-9]{64}\b",
    "cve": r"(?i)\bCVE-\d{4}-\d{4,7}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
}
_SKIP = {v for values in fixed.FALSE_POSITIVES.values() for v in values}


def public(value: str) -> bool:
    try:
        ip = ipaddress.IPv4Address(value)
    except ValueError:
        return False
    return not (ip.is_multicast or ip.is_private or ip.is_reserved or ip.is_loopback)


def entities(text: str) -> list[tuple]:
    """(type, value, start, end, context) in extraction order."""
    found = []
    for kind, pattern in _PY.items():
        for m in re.finditer(pattern, text):
            value, (start, end) = m.group(0), m.span()
            if value in _SKIP and kind in fixed.FALSE_POSITIVES:
                continue
            if kind == "ipv4" and not public(value):
                continue
            found.append((kind, value, start, end, text[max(0, start - 50) : end + 50]))
    return found


def hits(text: str) -> list[tuple]:
    """(keyword, negated) in keyword order."""
    negation = r"(?i)\b(?:not|no longer|isn't|doesn't|won't|cannot|can't|never)\b"
    mitigation = r"(?i)\b(?:mitigated|resolved|fixed|patched|addressed)\b"
    found = []
    for keyword, _, _ in fixed.SEVERITY_KEYWORDS:
        for m in re.finditer(rf"\b{re.escape(keyword)}\b", text, re.I):
            window = " ".join(text[: m.start()].split()[-10:])
            negated = bool(re.search(negation, window) or re.search(mitigation, window))
            found.append((keyword, negated))
    return found


def severity(text: str) -> tuple:
    """(score, level, confidence, evidence)."""
    table = {k: (level, w) for k, level, w in fixed.SEVERITY_KEYWORDS}
    lines, points, total = [], 0.0, 0.0
    m = re.search(r"CVSS(?:v\d)?\s+(?:Base\s+)?Score:\s*(\d+\.\d+)", text, re.I)
    score = float(m.group(1)) if m else 0.0
    if score:
        level = next((n for n, at in fixed.CVSS_BANDS if score >= at), "low")
        lines.append(f"CVSS Score: {score} ({level.capitalize()})")
        points, total = 2.0 * fixed.LEVEL_FACTORS[level], 2.0
    for keyword, negated in hits(text):
        if not negated:
            level, w = table[keyword]
            lines.append(f"Keyword: '{keyword}' ({level.capitalize()}, weight: {w})")
            points, total = points + w * fixed.LEVEL_FACTORS[level], total + w
    if not total:
        return 0.0, "unknown", 0.0, [fixed.NO_EVIDENCE]
    ratio = points / total
    level = next((n for n, at in fixed.LEVEL_BANDS if round(ratio, 9) >= at), "low")
    return ratio, level, min(0.5 + len(lines) * 0.1, 1.0), lines


def relation(s: str, t: str) -> str:
    ips, net = ("ipv4", "ipv6"), ("ipv4", "ipv6", "domain", "url")
    hashes = ("md5", "sha1", "sha256")
    rules = [
        (s in ips and t in ips, "communicates_with"),
        (s in ips and t == "domain", "resolves_to"),
        (s == "domain" and t in ips, "has_ip"),
        (s in hashes and t in net, "communicates_with"),
        (s in net and t in hashes, "hosts"),
        (s == "cve" and t in net, "affects"),
    ]
    return next((name for holds, name in rules if holds), "related_to")


def proximity(found: list[tuple]) -> list[tuple]:
    """(source value, target value, type, confidence, source start, target start), in order."""
    ordered = sorted(found, key=lambda e: e[2])
    edges = []
    for i, s in enumerate(ordered):
        tokens = len(s[4][len(s[1]) :].split())
        if tokens <= 10:
            for t in ordered[i + 1 :]:
                edges.append((s[1], t[1], relation(s[0], t[0]), 1.0 - tokens / 10, s[2], t[2]))
    return edges


def phrase_edges(text: str, found: list[tuple]) -> list[tuple]:
    edges = []
    for name, template in fixed.RELATION_PHRASES:
        pattern = template.replace(" {", r"\s+{").replace("} ", r"}\s+")
        pattern = pattern.replace("{S}", r"(?P<src>\S+)").replace("{T}", r"(?P<tgt>\S+)")
        for m in re.finditer(pattern, text, re.I):
            s = [e for e in found if e[1] in m.group("src")]
            t = [e for e in found if e[1] in m.group("tgt")]
            if s and t:
                edges.append((s[-1][1], t[-1][1], name, 0.9, s[-1][2], t[-1][2]))
    return edges


def merged(edges: list[tuple]) -> list[tuple]:
    best: dict = {}
    for edge in edges:
        if edge[:3] not in best or best[edge[:3]][3] < edge[3]:
            best[edge[:3]] = edge
    return sorted(best.values())
