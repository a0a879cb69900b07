"""Word orders, tag expansion, seeded draws and exact statistics."""

from __future__ import annotations

from itertools import permutations, product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@F.udtf(returnType="ordering: string")
class WordOrders:
    """All orders of the words of a string, joined by blanks, made one after the other as they are asked for; an empty or null string gives one empty order."""

    def eval(self, text: str):
        for p in permutations((text or "").split()):
            yield (" ".join(p),)


def expand_tags(tags: list[str]) -> list[list[str]]:
    """Every sequence that picks one of the alternatives 'a/b' at each place; the last place varies slowest."""
    choices = [t.split("/") for t in tags]
    return [list(reversed(p)) for p in product(*reversed(choices))]


def tag_sequences(tags: Column) -> Column:
    """expand_tags as an expression: an array of blank-joined sequences from an array of tags with alternatives."""
    start = F.array(F.lit(""))
    joined = lambda acc, t: F.flatten(F.transform(F.split(t, "/"), lambda c: F.transform(acc, lambda a: F.trim(F.concat(a, F.lit(" "), c)))))
    return F.aggregate(tags, start, joined)


def random_linear(n: Column | int, seed: int) -> Column:
    """A draw from 0 to n whose density rises in proportion to the value."""
    return F.sqrt(F.rand(seed)) * n


def random_expo(n: Column | int, seed: int, rate: float = 10.0) -> Column:
    """A draw from 0 to n of an exponential density cut off at n, by inversion (no rejection)."""
    scale = 1 - F.exp(F.lit(-rate))
    return -F.log(1 - F.rand(seed) * scale) / rate * n


def summary(df: DataFrame, column: str, quantiles: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """n, mean, population standard deviation and linearly interpolated quantiles; nulls where there are no values."""
    qs = F.percentile(column, F.array(*[F.lit(q) for q in quantiles])).alias("quantiles")
    return df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("stddev"), qs)




def hash_longs(a: int | np.ndarray, b: int | np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of two long columns."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    h = np.full(1, 42, np.uint64)
    for v in (a, b):
        h = (h + p5 + np.uint64(8)) ^ (turn(np.atleast_1d(np.asarray(v, np.int64)).view(np.uint64) * p2, 31) * p1)
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h = h ^ (h >> np.uint64(32))
    return h.view(np.int64)
