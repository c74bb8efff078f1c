"""Small tables for the operators' tests."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "the er in on ti ha re nd st en at ou ea ng".split()


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def prose(rng: random.Random, n: int) -> str:
    out = words(rng, n)
    for i in range(0, n, 12):
        out[i] = out[i].capitalize()
        if i:
            out[i - 1] += "."
    return " ".join(out)


def docs(spark, texts: list, ids: list | None = None):
    """documents with an extra column whose name clashes with nothing the tables have."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", f"src{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


#: Rows that every operator must take: null and empty texts, null and repeated ids, repeated rows, a long text.
def awkward(rng: random.Random) -> tuple[list, list]:
    long_text = prose(rng, 6000)
    return [None, "", "   \n\t ", "one", "one", prose(rng, 80), long_text, long_text, None], [1, 2, 3, None, 4, 5, 6, 6, None]
