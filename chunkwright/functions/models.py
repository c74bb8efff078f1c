"""Model hooks: any Python callable over texts becomes a column, with deterministic defaults that run offline.

A hook gets lists of texts and returns lists of results; Arrow carries the batches. A failing text
gives null and doesn't stop its batch.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 64


def embed_text(text: str, dimensions: int = DIMENSIONS) -> list[float]:
    """Hashed bag of words: each word adds to four places that its hash names; unit length."""
    out = [0.0] * dimensions
    for word, n in Counter(re.findall(r"\w+", (text or "").lower())).items():
        digest = hashlib.sha256(word.encode()).digest()
        weight = (1 + math.log(n)) * min(2.0, 0.5 + len(word) / 8)
        for i in range(4):
            out[int.from_bytes(digest[2 * i : 2 * i + 2], "big") % dimensions] += weight if digest[8 + i] & 1 else -weight
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm for x in out] if norm else out


def summarise_text(text: str, most: int = 200) -> str:
    """The first sentence, cut."""
    first = re.split(r"(?<=[.!?])\s", (text or "").strip(), maxsplit=1)[0]
    return first[:most]


def ask_about(text: str) -> list[str]:
    """Questions on the text's longest words."""
    words = sorted(set(re.findall(r"\w{6,}", text or "")), key=lambda w: (-len(w), w))[:2]
    return [f"What does the text say about {w}?" for w in words]


def _safe(fn: Callable, value):
    try:
        return None if value is None else fn(value)
    except Exception:  # noqa: BLE001  a model's failure on one text is a null
        return None


def hook(fn: Callable, returns: str) -> Callable[[Column], Column]:
    """A column function that applies fn to each text."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _safe(fn, t))

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, returns)


def embed(text: Column, fn: Callable = embed_text) -> Column:
    return hook(fn, "array<double>")(text)


def summarise(text: Column, fn: Callable = summarise_text) -> Column:
    return hook(fn, "string")(text)


def questions(text: Column, fn: Callable = ask_about) -> Column:
    return hook(fn, "array<string>")(text)


def describe_image(content: bytes) -> str:
    """Format and size from an image's headers."""
    from chunkwright.sources.readers import image_size

    found = image_size(content)
    return "unknown image" if found is None else "{} image, {} by {} pixels".format(*found)


def caption(content: Column, fn: Callable = describe_image) -> Column:
    """Texts of images (binary); a failing image gives null."""
    return hook(fn, "string")(content)


def image_relevance(text: Column, context: Column, fn: Callable | None = None) -> Column:
    """How much an image's text concerns the text around it, from 0 to 1: by default the share of its words found there.

    fn(text, context), where given, judges each pair instead.
    """
    if fn is not None:

        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([_safe(lambda pair: float(fn(*pair)), None if x is None or y is None else (x, y)) for x, y in zip(a, b)], dtype="float64")

        run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
        return F.pandas_udf(run, "double")(text, context)
    own = F.array_distinct(F.filter(F.split(F.lower(text), " "), lambda w: F.length(w) > 2))
    shared = F.array_intersect(own, F.split(F.lower(context), " "))
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(shared) / F.size(own))


def bridge_texts(a: str, b: str) -> tuple[str, str, float] | None:
    """A question on the longest word that two texts share, the sentences that hold it, and the share of words in common; null without such a word."""
    own, other = set(re.findall(r"[a-z]+", a.lower())), set(re.findall(r"[a-z]+", b.lower()))
    shared = sorted((w for w in own & other if len(w) >= 6), key=lambda w: (-len(w), w))
    if not shared:
        return None
    said = [next(s.strip() for s in re.split(r"[.!?\n]", t) if shared[0] in re.findall(r"[a-z]+", s.lower())) for t in (a, b)]
    return f"What do both passages say about {shared[0]}?", " / ".join(said), len(own & other) / min(len(own), len(other))


def bridge(a: Column, b: Column, fn: Callable = bridge_texts) -> Column:
    """question, answer, score for two related texts; null where fn fails or finds nothing."""

    def run(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        found = [_safe(lambda pair: fn(*pair), None if x is None or y is None else (x, y)) or (None, None, None) for x, y in zip(xs, ys)]
        return pd.DataFrame(found, columns=["question", "answer", "score"])

    run.__annotations__ = {"xs": pd.Series, "ys": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "question string, answer string, score double")(a, b)
