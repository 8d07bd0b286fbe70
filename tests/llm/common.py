"""Documents for the tests: prose made from a seed, with the awkward cases."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "re", "so", "ta", "vi", "da", "pe") for b in ("n", "r", "st", "la", "mo", "ki", "th", "du")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows(texts: list[str | None], source: str = "web", lang: str = "en") -> list[tuple]:
    return [(i, t, lang, source, None if t is None else len(t)) for i, t in enumerate(texts)]


def frame(spark, texts: list[str | None], **kw):
    return spark.createDataFrame(rows(texts, **kw), SCHEMA)
