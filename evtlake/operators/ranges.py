"""Points in ranges by an equi-join, whatever the lengths of the ranges.

A range of numbers is the disjoint union of at most two dyadic intervals [p * 2**k, (p + 1) * 2**k) of each size, so a point
lies in it exactly if one of them is (k, point >> k). Ranges become those pairs, points one pair for each size in use; both
grow with the logarithm of the lengths, never with the lengths.

Defined results: an empty or reversed range, and one with a null end, holds nothing; so do the parts of a range below 0 and
beyond 2**61; a null point lies in none; a point in several ranges comes once for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes of intervals, and the greatest point.
LEVELS, TOP = 62, 2**61


def dyadic(first: Column, last: Column) -> Column:
    """The intervals of first..last, both included: an array of structs (level, prefix)."""
    low, end = F.greatest(first, F.lit(0)).cast("bigint"), (F.least(last, F.lit(TOP)) + 1).cast("bigint")

    def pieces(k: int) -> list[Column]:
        left, right = F.shiftright(low + F.lit(2**k - 1), k), F.shiftright(end, k)
        piece = lambda at, prefix: F.when((left < right) & (at % 2 == 1), F.struct(F.lit(k).alias("level"), prefix.alias("prefix")))
        return [piece(left, left), piece(right, right - 1)]

    whole = first.isNotNull() & last.isNotNull()  # greatest and least pass nulls over
    return F.when(whole, F.filter(F.array(*(p for k in range(LEVELS) for p in pieces(k))), lambda p: p.isNotNull()))


def within(points: DataFrame, point: str, ranges: DataFrame, first: str, last: str) -> DataFrame:
    """Each row of points joined with every range that holds its point; columns of both, which must differ in name."""
    pieces = ranges.select("*", F.explode(dyadic(F.col(first), F.col(last))).alias("_piece")).select("*", F.col("_piece.level").alias("_level"), F.col("_piece.prefix").alias("_prefix")).drop("_piece")
    used = pieces.agg(F.collect_set("_level").alias("_levels"))  # one row of at most LEVELS numbers
    spread = points.crossJoin(F.broadcast(used)).withColumn("_level", F.explode("_levels")).drop("_levels")
    spread = spread.withColumn("_prefix", F.expr(f"shiftright(CAST(`{point}` AS BIGINT), _level)"))
    return spread.join(pieces, ["_level", "_prefix"]).drop("_level", "_prefix")
