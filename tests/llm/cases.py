"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"


def words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(n)]


def documents() -> list[tuple]:
    """Nulls, empty and long texts, copies, near copies, shared passages, repeated rows."""
    passage = words(1, 60)
    base = words(2, 120)
    near = base[:110] + words(3, 10)
    rows = [
        (1, " ".join(base), "en", "b", 1), (2, " ".join(base), "en", "b", 1), (3, " ".join(near), "de", "a", 1),
        (4, " ".join(words(4, 50) + passage + words(5, 40)), "en", "a", 1), (5, "\n".join(words(6, 30) + passage + words(7, 10)), None, "c", 1),
        (6, None, "en", "a", None), (7, "", "en", None, 0), (8, " \t\n ", "en", "a", 4), (9, "one two", "en", "a", 7), (10, "ONE two", "en", "d", 7),
        (11, " ".join(words(8, 30_000)), "en", "a", 1), (12, " ".join(passage * 3), "fr", "é", 1), (13, "x" * 5000, "en", "a", 5000),
        (14, "naïve Σας café\u00a0x e\u0301 <|endoftext|> don't 123", "en", "b", 1),
    ]
    rows += [(100 + k, " ".join(base[:100] + words(200 + k, 8)), "en", "b", 1) for k in range(12)]
    rows.append(rows[3])  # a repeated row
    return [(*r, "x") for r in rows]
