"""Small tables with every odd case, and plain reference versions of the operators."""

from __future__ import annotations

import random
import re
from collections import defaultdict

DOCUMENTS = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, "
    "kept string, size string, shard string, n_lines string, items string, pos string, token string, "
    "lang_pred string, score string"
)

SHARED = "  Shared Line here  "
PASSAGE = "this passage of the benchmark has exactly twelve words in its one sentence"
ITEMS = [
    (1, PASSAGE), (2, "short item"), (3, None), (4, ""), (5, PASSAGE.upper()), (6, "... !!"),
    (10, "Another " + PASSAGE),
]


def words(n: int, seed: int = 0) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(n))


def documents() -> list[tuple]:
    near = words(200, 9).split()
    texts = [
        (1, None), (2, ""), (3, "a"), (4, "A b\nC d"), (5, words(30_000, 5)), (6, "A b\nC d"),
        (7, "\n \n\t"), (8, "Grüße ÉTÉ straße 😀 don't <|endoftext|> x" + " y" * 40), (9, "!!! ###"),
        (10, words(40, 1) + " " + PASSAGE.title() + " " + words(30, 2)), (11, PASSAGE), (12, "Short, ITEM!"),
        (13, "x" * 50_000), (14, " ".join(near)), (15, " ".join(near[:-1] + ["zzz"])),
        (16, " ".join(near[:100] + ["q"] + near[100:])), (17, "rep eat ed w ords " * 30), (18, "  two  spaces \n"),
        (19, "one nbsp  em \x1c fs"), (-5, words(25, 3)),
    ]
    texts += [(100 + i, f"own {i} {words(12, i)}\n{SHARED if i % 2 else SHARED.strip().lower()}\nend {i}") for i in range(12)]
    texts += [(6, "A b\nC d"), (14, " ".join(near)), (None, "no id but words"), (None, None)]
    langs = {None: "en", 5: None}
    return [(d, t, langs.get(d, "en" if (d or 0) % 2 else "de"), "s", 0, *["x"] * 10) for d, t in texts]


def jaccard_components(rows: list[tuple], size: int, percent: int) -> dict:
    """(set size, smallest doc_id reachable) by row number, all pairs compared."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n = max(1, len(w) - size + 1)
        sets.append({tuple(w[i : i + size]) for i in range(n)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    return {i: (len(s), min(least[root(i)], default=None)) for i, s in enumerate(sets)}
