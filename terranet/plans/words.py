"""Walks without backtracks, as words of a free group.

A step and the step back are a letter and its inverse, so a walk without backtracks is a
reduced word.  Every place of a walk is a node of a tree (the reduced word so far), and the
reduced walk is the path of the tree between its ends: the edges that are crossed an odd
number of times, in the order in which they are crossed last.  So nothing is scanned with a
stack: nodes are prefix products, which blocks of rows compute on their own, and the rest
is a count per edge.

Letters are matrices of determinant one modulo 2^31 - 1, from hashes of their steps; equal
products stand for equal words (about 93 bits).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from terranet.plans.ordered import _blocks
from terranet.plans.scratch import cut

PRIME = 2**31 - 1
_NODE = [f"{end}_{i}" for end in ("_from", "_to") for i in "abcd"]


def _times(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices, one in each row (a, b, c, d)."""
    a, b, c, d = p.T
    e, f, g, h = q.T
    return np.stack([(a * e + b * g) % PRIME, (a * f + b * h) % PRIME, (c * e + d * g) % PRIME, (c * f + d * h) % PRIME], 1)


def times(p: Column, q: Column) -> Column:
    """Product of two nodes, structs of a, b, c, d."""
    at = lambda x, y, z, w: (p[x] * q[y] + p[z] * q[w]) % PRIME
    return F.struct(at("a", "a", "b", "c").alias("a"), at("a", "b", "b", "d").alias("b"), at("c", "a", "d", "c").alias("c"), at("c", "b", "d", "d").alias("d"))


def _prefix(word: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """Products of all letters of the same word up to each row."""
    out, k = letter, 1
    while k < len(word):
        same = np.flatnonzero(word[k:] == word[:-k])
        if not len(same):
            break
        new = out.copy()
        new[same + k] = _times(out[same], out[same + k])
        out, k = new, k * 2
    return out


def _before(word: np.ndarray, after: np.ndarray) -> np.ndarray:
    out = np.tile(np.array([1, 0, 0, 1]), (len(word), 1))
    same = np.flatnonzero(word[1:] == word[:-1])
    out[same + 1] = after[same]
    return out


def _scan(keys: list[str], pos: str, names: list[str]):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(k, "ascending") for k in (*keys, pos)])
        first = np.zeros(len(rows), bool)
        for k in keys:
            code = rows[k].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            first[1:] |= code[1:] != code[:-1]
        word = np.cumsum(first)
        letter = np.stack([rows[f"_{i}"].to_numpy() for i in "abcd"], 1)
        after = _prefix(word, letter)
        for name, column in zip(_NODE, (*_before(word, after).T, *after.T)):
            rows = rows.append_column(name, pa.array(column, pa.int64()))
        return rows.select(names)
    return run


def walked(steps: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Add the nodes ``before`` and ``after`` every step (x, y) -> (x2, y2) of the walks ``keys``, in the order of ``pos``.

    ``keys`` must not be NULL.  A walk may be of any length: only totals of blocks meet by key.
    """
    here, there = F.struct("x", "y"), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    low, high = F.least(here, there), F.greatest(here, there)
    s, t, u = (F.pmod(F.xxhash64(low["x"], low["y"], high["x"], high["y"], F.lit(k)), F.lit(PRIME)) for k in range(3))
    # (1 s; 0 1) (1 0; t 1) (1 u; 0 1)
    a, c = (1 + (s * t) % PRIME) % PRIME, t
    b, d = ((a * u) % PRIME + s) % PRIME, (1 + (t * u) % PRIME) % PRIME
    forth, still = here < there, here == there
    pick = lambda f, g, one: F.when(still, F.lit(one)).when(forth, f).otherwise(g).cast("long")
    minus = lambda v: (PRIME - v) % PRIME
    letters = steps.withColumns({"_a": pick(a, d, 1), "_b": pick(b, minus(b), 0), "_c": pick(c, minus(c), 0), "_d": pick(d, a, 1)})
    blocks = _blocks(letters, keys, [F.col(pos).asc()])
    names = [*steps.columns, "_block", *_NODE]
    schema = StructType([*(blocks.schema[n] for n in (*steps.columns, "_block")), *(StructField(n, LongType()) for n in _NODE)])
    local = cut(blocks.groupBy("_block").applyInArrow(_scan(keys, pos, names), schema), "walked")
    node = lambda end: F.struct(*[F.col(f"_{end}_{i}").alias(i) for i in "abcd"])
    # the product of all blocks before, a row for each walk and block
    totals = local.groupBy(*keys, "_block").agg(F.max_by(F.struct(*[F.col(f"_to_{i}") for i in "abcd"]), pos).alias("_t"))
    totals = totals.select(*keys, "_block", *[F.col(f"_t._to_{i}").alias(f"_{i}") for i in "abcd"])
    width = [totals.schema[n] for n in (*keys, "_block")]
    carried = totals.groupBy(*keys).applyInArrow(_scan(keys, "_block", [*keys, "_block", *_NODE[:4]]),
                                                 StructType([*width, *(StructField(n, LongType()) for n in _NODE[:4])]))
    carried = carried.select(*keys, "_block", node("from").alias("_carry"))
    joined = local.join(carried, [*keys, "_block"])
    return joined.select(*steps.columns, times(F.col("_carry"), node("from")).alias("before"), times(F.col("_carry"), node("to")).alias("after"))


def without_backtracks(steps: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The steps of the reduced walks ``keys``; ``steps`` with their nodes ``before`` and ``after``."""
    rest = [c for c in steps.columns if c not in (*keys, "before", "after")]
    edges = steps.filter("before <> after").groupBy(*keys, F.least("before", "after").alias("_low"), F.greatest("before", "after").alias("_high"))
    last = edges.agg(F.count("*").alias("_n"), F.max_by(F.struct(*rest), pos).alias("_s"))
    return last.filter("_n % 2 = 1").select(*keys, "_s.*")
