"""Piecewise linear functions of height.

A function is ``array<struct<bp, c0, c1>>``: below or at breakpoint ``bp`` (and
above the previous one) the value is ``c0 + c1*h``; the last piece has bp = +inf.
Sand volume functions are sums of corner functions max(0, (h_v - h)/4).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

INF = float("inf")


def piece(bp: Column, c0: Column, c1: Column) -> Column:
    return F.struct(bp.cast("double").alias("bp"), c0.cast("double").alias("c0"), c1.cast("double").alias("c1"))


def corner_volume(corner: Column, h: Column) -> Column:
    """Sand above height h at one face corner; nodata corners hold none."""
    return F.coalesce(0.25 * F.greatest(F.nanvl(corner, F.lit(-INF)) - h, F.lit(0.0)), F.lit(0.0))


def corner_function(corner: Column) -> Column:
    known = corner.isNotNull() & ~F.isnan(corner)
    zero = F.array(piece(F.lit(INF), F.lit(0), F.lit(0)))
    return F.when(known, F.array(piece(corner, 0.25 * corner, F.lit(-0.25)),
                                 piece(F.lit(INF), F.lit(0), F.lit(0)))).otherwise(zero)


def pl_eval(f: Column, h: Column) -> Column:
    p = F.element_at(F.filter(f, lambda q: q["bp"] >= h), 1)
    return p["c0"] + p["c1"] * h


def pl_scale(f: Column, k: Column | float) -> Column:
    return F.transform(f, lambda p: piece(p["bp"], p["c0"] * k, p["c1"] * k))


def pl_add(f: Column, g: Column) -> Column:
    """Sum of two functions of a row; breakpoints are merged."""
    at = lambda fn, b: F.element_at(F.filter(fn, lambda q: q["bp"] >= b), 1)
    points = F.array_sort(F.array_distinct(F.concat(F.transform(f, lambda p: p["bp"]), F.transform(g, lambda p: p["bp"]))))
    return F.transform(points, lambda b: piece(b, at(f, b)["c0"] + at(g, b)["c0"], at(f, b)["c1"] + at(g, b)["c1"]))


def pl_subtract(f: Column, g: Column) -> Column:
    return pl_add(f, pl_scale(g, -1.0))


def pl_prune(f: Column, h: Column) -> Column:
    """Forget everything above h: the piece holding h becomes the last one."""
    i = F.size(F.filter(f, lambda p: p["bp"] < h)) + 1
    kept = F.element_at(f, i)
    return F.concat(F.slice(f, F.lit(1), i - 1), F.array(piece(F.lit(INF), kept["c0"], kept["c1"])))


def pl_zero_above(f: Column, h: Column) -> Column:
    i = F.size(F.filter(f, lambda p: p["bp"] < h)) + 1
    kept = F.element_at(f, i)
    return F.concat(F.slice(f, F.lit(1), i - 1), F.array(piece(h, kept["c0"], kept["c1"]),
                                                        piece(F.lit(INF), F.lit(0), F.lit(0))))


def _height(p: Column, volume: Column) -> Column:
    return F.when(p["c1"] == 0, F.lit(float("nan"))).otherwise((volume - p["c0"]) / p["c1"])


def _upper(a: Column, b: Column) -> Column:
    return F.when(a < b, b).otherwise(a)


def pl_height_for_volume(f: Column, volume: Column) -> Column:
    """Height at which a decreasing function reaches a volume, kept inside the piece that holds it.

    The piece is the first whose upper end has less than that volume left (seen
    from the piece above it), else the last.  A flat piece gives NaN.
    """
    n = F.size(f)
    falls = F.filter(F.sequence(F.lit(1), n), lambda i: (i < n) & (
        F.element_at(f, F.least(i + 1, n))["c0"] + F.element_at(f, F.least(i + 1, n))["c1"] * F.element_at(f, i)["bp"]
        < volume))
    i = F.coalesce(F.get(falls, F.lit(0)), n)
    here = F.element_at(f, i)
    raw = _height(here, volume)
    capped = F.when((i < n) & ~F.isnan(raw), F.least(raw, here["bp"])).otherwise(raw)
    below = F.get(f, i - 2)["bp"]
    return F.when(below.isNotNull() & ~F.isnan(capped), F.greatest(capped, below)).otherwise(capped)


def pl_sum(functions: DataFrame, keys: list[str], column: str = "f") -> DataFrame:
    """Sum functions per key as a table (keys, bp, c0, c1), one row per piece.

    Every function is turned into the changes it makes at its breakpoints; equal
    breakpoints are added up first, then a suffix sum rebuilds the pieces.
    """
    change = F.transform(F.col(column), lambda p, i: F.struct(
        p["bp"].alias("bp"),
        (p["c0"] - F.coalesce(F.get(F.col(column), i + 1)["c0"], F.lit(0.0))).alias("d0"),
        (p["c1"] - F.coalesce(F.get(F.col(column), i + 1)["c1"], F.lit(0.0))).alias("d1")))
    deltas = functions.select(*keys, F.explode(change).alias("p")).groupBy(*keys, F.col("p.bp").alias("bp")).agg(
        F.sum("p.d0").alias("d0"), F.sum("p.d1").alias("d1"))
    from terranet.plans.ordered import sums_before
    from terranet.plans.scratch import cut
    down = sums_before(cut(deltas, "pieces"), keys, [F.col("bp").desc()], ["d0", "d1"])
    return down.select(*keys, "bp", (F.col("d0") + F.col("d0_before")).alias("c0"),
                       (F.col("d1") + F.col("d1_before")).alias("c1"))
