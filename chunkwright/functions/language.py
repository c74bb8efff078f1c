"""Language by script, and chunk sizes for dense scripts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters that language detection reads, and trigrams that a profile ranks (fixed values).
SAMPLE, PROFILE = 10_000, 300

#: Character classes of scripts.
HANGUL = r"\uAC00-\uD7AF\u1100-\u11FF\u3130-\u318F"
KANA = r"\u3040-\u309F\u30A0-\u30FF"
HAN = r"\u4E00-\u9FFF"


def count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]", ""))


def cjk_language(text: Column, sample: int = 10_000) -> tuple[Column, Column]:
    """Language (or unknown) and confidence from the shares of scripts among letters and symbols."""
    t = F.substring(text, 1, sample)
    total = F.length(F.regexp_replace(t, r"[\s\p{P}\p{Nd}]", ""))
    share = lambda chars: F.when(total > 0, count_of(t, chars) / total).otherwise(0.0)
    ko, ja, zh = share(HANGUL), share(KANA), share(HAN)
    dense = t.rlike(f"[{HANGUL}{KANA}{HAN}]")  # most texts hold no such character, and are read once
    sure = lambda x: F.bround(F.least(F.lit(0.95), 0.6 + 0.4 * x), 4)
    language = F.when(ko > 0.1, "ko").when(ja > 0.05, "ja").when(zh > 0.1, "zh").otherwise("unknown")
    return F.when(dense, language).otherwise("unknown"), F.when(~dense, 0.0).when(ko > 0.1, sure(ko)).when(ja > 0.05, sure(ja + 0.3 * zh)).when(zh > 0.1, sure(zh)).otherwise(0.0)


def script_profile(text: Column, sample: int = 1_000) -> Column:
    """The language profile to use: the first script with its share, else English."""
    t = F.substring(text, 1, sample)
    total = F.length(F.regexp_replace(t, r"\s", ""))
    share = lambda chars: F.when(total > 0, count_of(t, chars) / total).otherwise(0.0)
    return (
        F.when(share(HANGUL) > 0.3, "ko").when(share(KANA) > 0.1, "ja").when(share(HAN) > 0.3, "zh")
        .when(share(r"\u0600-\u06FF") > 0.3, "ar").when(share(r"\u0900-\u097F") > 0.3, "hi").when(share(r"\u0400-\u04FF") > 0.3, "ru").otherwise("en")
    )


def first_script(text: Column) -> Column:
    """Any Hangul, else any Han, else any kana, else English: the order is the rule's."""
    return F.when(text.rlike(r"[\uAC00-\uD7AF]"), "ko").when(text.rlike(f"[{HAN}]"), "zh").when(text.rlike(f"[{KANA}]"), "ja").otherwise("en")


def size_factor(text: Column, sample: int = 5_000) -> Column:
    """What a chunk size is multiplied by: less the more characters are CJK."""
    t = F.substring(text, 1, sample)
    total = F.length(F.regexp_replace(t, r"[\s\p{Cc}]", ""))
    ratio = F.when(total > 0, count_of(t, HANGUL + KANA + HAN + r"\u3400-\u4DBF") / total).otherwise(0.0)
    return F.when(ratio < 0.1, 1.0).otherwise(F.greatest(F.lit(0.15), 1 / (1 + 4 * ratio)))


def _trigram_counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of a text's code points, each as one number that orders like the text, and their counts."""
    return np.unique((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:], return_counts=True)


def _texts_of(keys: np.ndarray) -> list[str]:
    three = np.stack([keys >> 42, (keys >> 21) & 0x1FFFFF, keys & 0x1FFFFF], axis=1)
    whole = three.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [whole[3 * i : 3 * i + 3] for i in range(len(keys))]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def _samples(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, F.lower(F.substring("text", 1, SAMPLE)).alias("sample"))


def profiles(docs: DataFrame) -> DataFrame:
    """lang, tri, rank: each language's most frequent trigrams, PROFILE at most. A task sums the counts of a batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lots: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lots.setdefault(lang, []).append(_trigram_counts(_codes(text)))
            for lang, found in lots.items():
                keys, places = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                n = np.bincount(places, np.concatenate([c for _, c in found]), len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(keys)), pa.array(_texts_of(keys)), pa.array(n)], names=["lang", "tri", "n"])

    counted = _samples(docs, "lang").mapInArrow(run, "lang string, tri string, n long").groupBy("lang", "tri").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "tri"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= PROFILE)


def ranked_trigrams(docs: DataFrame) -> DataFrame:
    """doc_id, tris: each text's most frequent trigrams in order, PROFILE at most, ranked within its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                keys, n = _trigram_counts(_codes(text))
                out.append(_texts_of(keys[np.argsort(-n, kind="stable")[:PROFILE]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["doc_id", "tris"])

    return _samples(docs, "doc_id").mapInArrow(run, "doc_id long, tris array<string>")


def nearest_language(docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """doc_id, guess, distance, confidence: the profile at the least mean distance of ranks; ties by name.

    A text's trigrams are ranked and compared within its row; the profiles (PROFILE rows for each
    language) go to the tasks with the function.
    """
    by_language = ranked.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("tri", "rank"))).alias("places"))
    places = {r["lang"]: r["places"] for r in by_language.collect()}  # PROFILE trigrams of each language
    names = sorted(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"guess": [], "distance": [], "next": []}
            for tris in batch.column(1).to_pylist():
                off = lambda lang: sum(min(abs(i + 1 - places[lang].get(t, 2 * PROFILE + i)), PROFILE) for i, t in enumerate(tris)) / len(tris)  # noqa: B023, E731
                found = sorted((off(lang), lang) for lang in names)
                out["guess"].append(found[0][1] if found else None)
                out["distance"].append(found[0][0] if found else None)
                out["next"].append(found[1][0] if len(found) > 1 else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out["guess"], pa.string()), pa.array(out["distance"], pa.float64()), pa.array(out["next"], pa.float64())], names=["doc_id", *out])

    best = ranked_trigrams(docs).mapInArrow(run, "doc_id long, guess string, distance double, next double")
    sure = F.when(F.col("distance") > 0, 0.5 + 0.5 * (F.col("next") - F.col("distance")) / F.col("distance")).otherwise(0.99)
    return best.select("doc_id", "guess", "distance", F.greatest(F.lit(0.1), F.least(F.lit(0.99), sure)).alias("confidence"))
