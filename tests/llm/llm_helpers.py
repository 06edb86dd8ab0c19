"""Small tables with every awkward case, and brute-force models."""

from __future__ import annotations

import random
import re

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, key string, ids string, row int, pos int, score string, component string"
LETTERS = "bcdfgklmnprstvz"


def words(rnd: random.Random, n: int) -> list[str]:
    return ["".join(rnd.choice(LETTERS) + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4))) for _ in range(n)]


def prose(rnd: random.Random, n: int) -> str:
    out, w = [], words(rnd, n)
    while w:
        size = rnd.randint(4, 14)
        out.append(" ".join(w[:size]).capitalize() + ".")
        w = w[size:]
    return " ".join(out)


def docs_frame(spark, rows):
    """``rows``: (id, text); the other columns clash with names the operators use."""
    full = [(i, t, "en", "s", None if t is None else len(t), "n", None, "i", 1, 2, "x", None) for i, t in rows]
    return spark.createDataFrame(full, DOCS)


def awkward(rnd: random.Random) -> list[tuple[int | None, str | None]]:
    base = prose(rnd, 120)
    return [
        (1, base), (2, base), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "one two three"), (8, prose(rnd, 30_000)),
        (9, base.replace(".", ". ", 3)), (None, base), (None, None), (6, "one"), (10, "x" * 100_000), (11, prose(rnd, 60)),
    ]


def tokens(text: str | None) -> list[str]:
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", folded) if w]


def shingles(text: str | None, size: int = 5) -> set[tuple[str, ...]]:
    w = tokens(text)
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}


def groups(ids: list, linked) -> dict:
    """Least member of each component; ``linked(i, j)`` takes positions."""
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
    return {k: find(k) for k in range(len(ids))}
