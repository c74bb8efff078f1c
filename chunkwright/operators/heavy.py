"""The most frequent words of groups, without a shuffle of all words; and those of one text, without any."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkwright.functions.arrays import bound
from chunkwright.operators.ordered import stored

#: Counters that a task keeps for each group.
COUNTERS = 2000
#: Counters that a task holds for all groups before it passes them on.
HELD = 400_000


def counted(words: Column) -> Column:
    """The distinct words of an array with their counts, as structs (n, w), by word: a sort, and the lengths of its runs."""

    def runs(s: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(s) - 1)
        starts = F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        ends = lambda x: F.concat(F.slice(x, 2, F.size(x)), F.array(F.size(s)))
        return bound(starts, lambda x: F.zip_with(x, ends(x), lambda a, b: F.struct((b - a).alias("n"), F.get(s, a).alias("w"))))

    return F.when(F.size(words) > 0, bound(F.array_sort(words), runs)).otherwise(F.array().cast("array<struct<n:int,w:string>>"))


def most_frequent(words: Column, k: int) -> Column:
    """The k most frequent words of an array, ties by word."""
    turned = F.transform(counted(words), lambda x: F.struct((-x["n"]).alias("n"), x["w"].alias("w")))
    return F.slice(F.array_sort(turned), 1, k)["w"]


def _summaries(rows: DataFrame, counters: int) -> DataFrame:
    """grp, w, n, error: what a task counted of each group; an error row (w null) says how much any word's count may be short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        errors: Counter = Counter()

        def passed_on() -> Iterator[pa.RecordBatch]:
            for grp, counts in held.items():
                words = list(counts)
                n = [counts[w] for w in words]
                yield pa.RecordBatch.from_arrays([pa.repeat(grp, len(n) + 1).cast(pa.string()), pa.array([*words, None], pa.string()), pa.array([*n, 0], pa.int64()), pa.array([0] * len(n) + [errors[grp]], pa.int64())], names=["grp", "w", "n", "error"])
            held.clear()
            errors.clear()

        for batch in batches:
            for grp, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = held.setdefault(grp, Counter())
                counts.update(words or ())
                if len(counts) > 2 * counters:  # the count of the first one that goes is taken from all: only those above it stay
                    least = sorted(counts.values(), reverse=True)[counters]
                    held[grp] = Counter({w: n - least for w, n in counts.items() if n > least})
                    errors[grp] += least
            if sum(map(len, held.values())) > HELD:
                yield from passed_on()
        yield from passed_on()

    return rows.mapInArrow(run, "grp string, w string, n long, error long")


def top_words(rows: DataFrame, k: int, counters: int = COUNTERS) -> DataFrame:
    """grp, w, n, rank: the k most frequent words of each group, exactly. rows: grp (string), words (array).

    Tasks keep bounded counters (a word's count is short by the task's error at most), so what is
    shuffled doesn't grow with the texts. Words that could be among the first k are then counted
    exactly. A word that no task kept occurs at most as often as all errors together; groups whose
    k-th word isn't above that are counted whole.
    """
    rows = stored(rows.select("grp", "words"))
    summed = stored(_summaries(rows, counters).groupBy("grp", "w").agg(F.sum("n").alias("n"), F.sum("error").alias("error")))
    errors = summed.where("w IS NULL").select("grp", F.col("error").alias("short"))
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("n"), "w"))
    kth = summed.where("w IS NOT NULL").select("grp", "n", place.alias("rank")).where(F.col("rank") <= k).groupBy("grp").agg(F.min("n").alias("least"), F.count("*").alias("kept"))
    judged = stored(errors.join(kth, "grp", "left").withColumn("settled", (F.col("short") == 0) | ((F.col("kept") == k) & (F.col("least") > F.col("short")))))
    # a kept word may be k-th only if its count and what it may be short reach the k-th sure count
    may = summed.where("w IS NOT NULL").join(judged.where("settled"), "grp").where("n + short >= least").select("grp", "w", "n", "short")
    sure = may.where("short = 0").select("grp", "w", "n")
    words = rows.select("grp", F.explode("words").alias("w"))
    checked = words.join(may.where("short > 0").select("grp", "w"), ["grp", "w"], "left_semi").groupBy("grp", "w").agg(F.count("*").alias("n"))
    whole = words.join(judged.where("NOT settled").select("grp"), "grp", "left_semi").groupBy("grp", "w").agg(F.count("*").alias("n"))
    every = sure.unionByName(checked).unionByName(whole)
    return every.withColumn("rank", place).where(F.col("rank") <= k)
