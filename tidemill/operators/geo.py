"""Points near other points."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.operators.retrieve import top
from tidemill.storage import cut

EARTH_M = 6_371_000.0
#: Levels of an octree's cells, of 12 metres at the last; points beyond which a cell is split.
LEVELS, CELL = 20, 256
#: Straight distance on the unit sphere that rounding may make of nothing: 6 cm.
MARGIN = 1e-8


def distance(lon1, lat1, lon2, lat2) -> Column:
    """Metres on the sphere."""
    r = F.radians
    a = F.pow(F.sin((r(lat2) - r(lat1)) / 2), 2) + F.cos(r(lat1)) * F.cos(r(lat2)) * F.pow(F.sin((r(lon2) - r(lon1)) / 2), 2)
    return F.asin(F.sqrt(F.least(F.lit(1.0), a))) * (2 * EARTH_M)


def near(df: DataFrame, lon: float, lat: float, most: float | None, limit: int, key: str) -> DataFrame:
    """The nearest rows with lon and lat, within `most` metres unless it is 0 or None. Latitudes prune before distances are made."""
    if most:
        reach = math.degrees(most / EARTH_M) * 1.001
        df = df.where(F.col("lat").between(lat - reach, lat + reach))
    out = df.withColumn("metres", F.round(distance(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat")), 3))
    return (out.where(F.col("metres") <= most) if most else out).orderBy("metres", key).limit(limit)


def _xyz(lon: str, lat: str) -> list[Column]:
    """The place on the unit sphere: straight lines through it order places as distances on it do, and there are no poles or date line."""
    a, b = F.radians(lon), F.radians(lat)
    return [(F.cos(b) * F.cos(a)).alias("x"), (F.cos(b) * F.sin(a)).alias("y"), F.sin(b).alias("z")]


def _cell(level: int) -> Column:
    """The cell of a place at a level: three bits a level, those of x, y and z, the coarsest first."""
    own = [F.least(F.floor((F.col(c) + 1) / 2 * (1 << LEVELS)), F.lit((1 << LEVELS) - 1)).cast("long") for c in "xyz"]
    bit = lambda c, k: F.call_function("shiftright", c, F.lit(LEVELS - 1 - k)).bitwiseAND(F.lit(1))
    out = F.lit(0).cast("long")
    for k in range(level):
        for c in own:
            out = out * 2 + bit(c, k)
    return out


def tree(points: DataFrame) -> DataFrame:
    """(level, cell, parent, n, leaf) of points(cell): the cells of an octree that have points and whose parents have more than CELL."""
    nodes, rows, start = None, points.select("cell"), 0
    while start < LEVELS:
        end = min(start + 5, LEVELS)
        up = lambda c, n: F.call_function("shiftright", c, (3 * n).cast("int"))
        fine = rows.groupBy(up(F.col("cell"), F.lit(LEVELS - end)).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        each = fine.select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("level"), "cell", "n").select("level", up(F.col("cell"), F.lit(end) - F.col("level")).alias("cell"), "n")
        sums = cut(each.groupBy("level", "cell").agg(F.sum("n").alias("n")), "cells")
        large = sums.where(F.col("n") > CELL)
        above = large.select((F.col("level") + 1).alias("level"), F.col("cell").alias("parent"))
        below = sums.where(F.col("level") > start).withColumn("parent", up(F.col("cell"), F.lit(1))).join(above, ["level", "parent"], "left_semi")
        made = below.unionByName(sums.where("level = 0").withColumn("parent", F.lit(-1).cast("long"))) if start == 0 else below
        nodes = made if nodes is None else nodes.unionByName(made)
        still = large.where(F.col("level") == end).select(F.col("cell").alias("_big"))
        if end == LEVELS or still.isEmpty():
            break
        rows, start = rows.join(still, up(F.col("cell"), F.lit(LEVELS - end)) == F.col("_big"), "left_semi"), end
    return cut(nodes.select("level", "cell", "parent", "n", ((F.col("n") <= CELL) | (F.col("level") == LEVELS)).alias("leaf")), "tree")


def _third(bit: Callable[[Column, int], Column], at: int) -> Callable[[Column], Column]:
    return lambda k: bit(k - 1, at)


def _reach(level: Column, cell: Column) -> tuple[Column, Column]:
    """(least, greatest) straight distance from (x, y, z) to a cell, with a margin for rounding."""
    side = F.lit(2.0) / F.pow(F.lit(2.0), level)
    low, high = F.lit(0.0), F.lit(0.0)
    # every third bit of the cell
    bit = lambda k, a: F.call_function("shiftleft", F.call_function("shiftright", cell, (3 * k + 2 - a).cast("int")).bitwiseAND(F.lit(1)), k)
    for at, c in enumerate("xyz"):
        place = F.aggregate(F.transform(F.sequence(F.lit(1), level.cast("int")), _third(bit, at)), F.lit(0).cast("long"), lambda s, x: s + x)
        place = F.when(level == 0, F.lit(0).cast("long")).otherwise(place)
        first = place * side - 1
        low = low + F.pow(F.greatest(first - F.col(c), F.col(c) - first - side, F.lit(0.0)), 2)
        high = high + F.pow(F.greatest(F.abs(first - F.col(c)), F.abs(first + side - F.col(c))), 2)
    return F.sqrt(low) - MARGIN, F.sqrt(high) + MARGIN


def near_many(centres: DataFrame, points: DataFrame, most: float | None, k: int) -> DataFrame:
    """(query_id, id, score, rank): for centres(query_id, lon, lat) the k nearest of points(id, lon, lat), as minus metres; ties by id.

    most is the greatest distance, or None. Points are in an octree whose cells split where they are many. A centre goes down from the root: of the cells
    it has come to, those with the least greatest distances that have k points give it a bound, and cells that begin beyond it
    are left; so it only meets the points of a few leaves, of CELL points or fewer, in a dense city as in the open sea. Points at one place count by
    their k smallest ids, and centres at one place go down as one. Rows without a place or id are near to nothing.
    """
    placed = lambda df, key: df.where(f"{key} is not null and lon is not null and lat is not null and not isnan(lon) and not isnan(lat)")
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    some = placed(points, "id").select("id", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    for spread in ([part], []):
        some = some.withColumn("_r", F.row_number().over(Window.partitionBy("lon", "lat", *spread).orderBy("id"))).where(F.col("_r") <= k).drop("_r")
    some = cut(some.select("id", "lon", "lat", *_xyz("lon", "lat")).withColumn("cell", _cell(LEVELS)), "points")
    nodes = tree(some)
    bound = F.lit(float("inf") if most is None else 2 * math.sin(min(most / EARTH_M, math.pi) / 2) + MARGIN)
    asked = placed(centres, "query_id").select("query_id", F.col("lon").cast("double").alias("_lon"), F.col("lat").cast("double").alias("_lat")).distinct()
    places = asked.select("_lon", "_lat").distinct()
    places = places.select("_lon", "_lat", *[c.alias(n) for c, n in zip(_xyz("_lon", "_lat"), "xyz", strict=True)])

    def kept(rows: DataFrame) -> DataFrame:
        """Without cells that begin beyond where k points are sure to be."""
        low, high = _reach(F.col("level"), F.col("cell"))
        w = Window.partitionBy("_lon", "_lat")
        rows = rows.withColumn("_low", low).withColumn("_high", high)
        rows = rows.withColumn("_before", F.coalesce(F.sum("n").over(w.orderBy("_high", "level", "cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        rows = rows.withColumn("_all", F.sum("n").over(w)).withColumn("_sure", F.max(F.when(F.col("_before") < k, F.col("_high"))).over(w))
        return rows.where(F.col("_low") <= F.least(bound, F.when(F.col("_all") >= k, F.col("_sure")).otherwise(F.lit(float("inf"))))).drop("_low", "_high", "_before", "_all", "_sure")

    root = nodes.where("level = 0").select("level", "cell", "n", "leaf")
    front = cut(places.join(F.broadcast(root)), "front")  # one row
    down = nodes.select("level", "parent", F.col("cell").alias("_cell"), F.col("n").alias("_n"), F.col("leaf").alias("_leaf"))
    for level in range(1, LEVELS + 1):
        inner = front.where("not leaf")
        if inner.isEmpty():
            break
        below = inner.drop("level").join(down.where(F.col("level") == level), F.col("cell") == F.col("parent"))
        below = below.select("_lon", "_lat", "x", "y", "z", "level", F.col("_cell").alias("cell"), F.col("_n").alias("n"), F.col("_leaf").alias("leaf"))
        front = cut(kept(front.where("leaf").unionByName(below)), "front")
    leaves = nodes.where("leaf").select(F.col("level").alias("_level"), F.col("cell").alias("_cell"), "n")
    depth = [r[0] for r in leaves.select("_level").distinct().collect()]  # LEVELS + 1 rows at most
    at = F.explode(F.array(*[F.struct(F.lit(d).alias("level"), F.call_function("shiftright", "cell", F.lit(3 * (LEVELS - d))).alias("cell")) for d in depth or [0]]))
    keyed = some.select("id", "lon", "lat", at.alias("_at")).join(leaves.select(F.struct(F.col("_level").alias("level"), F.col("_cell").alias("cell")).alias("_at")), "_at", "left_semi")
    met = front.select("_lon", "_lat", F.struct("level", "cell").alias("_at")).join(keyed, "_at")
    scored = met.withColumn("score", -F.round(distance(F.col("_lon"), F.col("_lat"), F.col("lon"), F.col("lat")), 3))
    found = (scored if most is None else scored.where(F.col("score") >= -most)).select(F.struct("_lon", "_lat").alias("_place"), "id", "score")
    best = cut(top(found, "_place", k).select("_place._lon", "_place._lat", "id", "score"), "nearest")
    return top(asked.join(best, ["_lon", "_lat"]).select("query_id", "id", "score"), "query_id", k)
