"""Array expressions that Spark has no function for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a block of running sums.
BLOCK = 32


def _folded(values: Column) -> Column:
    """Running sums by one fold, which copies what it has with each step: for short arrays."""
    none = F.array().cast("array<long>")
    start = F.struct(F.lit(0).cast("long").alias("total"), none.alias("out"))
    step = lambda a, x: F.struct((a["total"] + x).alias("total"), F.concat(a["out"], F.array(a["total"] + x)).alias("out"))
    return F.aggregate(values, start, step, lambda a: a["out"])


def bound(value: Column, use) -> Column:
    """use(value), with value evaluated once, however often lambdas within read it."""
    return F.transform(F.array(value), use)[0]


def running_sums(values: Column) -> Column:
    """For each element, the sum of all up to and with it.

    Sums of blocks come first, so that an array of n elements costs n * BLOCK steps and a fold over n / BLOCK.
    """
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    chunk = lambda xs, b: F.slice(xs, (b * BLOCK + 1).cast("int"), F.lit(BLOCK))

    def summed(xs: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int"))
        before = _folded(F.transform(blocks, lambda b: total(chunk(xs, b))))
        within = lambda ends: F.flatten(F.transform(blocks, lambda b: F.transform(_folded(chunk(xs, b)), lambda x: x + F.when(b > 0, F.get(ends, b - 1)).otherwise(0))))
        return F.when(F.size(xs) > 0, bound(before, within)).otherwise(F.array().cast("array<long>"))

    return bound(values, summed)


def kept_by(values: Column, state: dict[str, Column], step, kind: str) -> Column:
    """A fold over values that keeps items. step(state, value) gives the new state, whether to keep, and the item (of type kind).

    Items are gathered in runs of BLOCK, so that keeping n of them copies n * BLOCK + (n / BLOCK)^2 places, not n^2.
    """
    run, runs = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")
    start = F.struct(*[c.alias(n) for n, c in state.items()], run.alias("__run"), runs.alias("__runs"))

    def fold(a: Column, x: Column) -> Column:
        after, keep, item = step(a, x)
        full = F.size(a["__run"]) >= BLOCK
        held = F.when(~keep, a["__run"]).when(full, F.array(item)).otherwise(F.concat(a["__run"], F.array(item)))
        passed = F.when(keep & full, F.concat(a["__runs"], F.array(a["__run"]))).otherwise(a["__runs"])
        return F.struct(*[after[n].alias(n) for n in state], held.alias("__run"), passed.alias("__runs"))

    return F.aggregate(values, start, fold, lambda a: F.flatten(F.concat(a["__runs"], F.array(a["__run"]))))
